"""bermline: Spark DataFrame functions for finding flood embankments in geodata.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); Spark plans, partitions and runs the work.
"""
from bermline.session import cut_lineage, session

__all__ = ["session", "cut_lineage"]
