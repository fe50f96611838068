"""Registered queries and their SQL twins."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bermline.plans import views

QUERIES: dict[str, Callable] = {}
SQL_TEXT: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the names in ``views.SQL`` as tables."""
    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL_TEXT[name] = with_views(sql)
        return fn
    return add


def with_views(sql: str) -> str:
    """Put the view definitions a statement needs in front of it."""
    need: set[str] = set()

    def scan(text: str) -> None:
        for v in views.SQL:
            if v not in need and re.search(rf"\b{v}\b", text):
                need.add(v)
                scan(views.SQL[v])

    scan(sql)
    ctes = [f"{v} AS ({views.SQL[v]})" for v in views.SQL if v in need]
    return (f"WITH {', '.join(ctes)} " if ctes else "") + f"SELECT * FROM ({sql}) _q"


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Round double columns (all when none is named), the form in which results are compared."""
    names = cols or [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    # adding 0.0 turns -0.0 into 0.0
    return df.withColumns({c: F.round(F.col(c), places) + F.lit(0.0) for c in names})


def mix(key: Column) -> Column:
    """Multiplicative hash to [0, 1) with a plain SQL form, used where a twin must draw the same rows."""
    return ((key % 1000003) * 2654435761) % 4294967296 / F.lit(4294967296.0)


MIX = "(((({k}) % 1000003) * 2654435761) % 4294967296) / 4294967296.0"


def all_queries() -> dict[str, Callable]:
    import importlib
    import pkgutil

    import bermline.plans as package
    for m in pkgutil.iter_modules(package.__path__):
        if m.name.startswith("q_"):
            importlib.import_module(f"bermline.plans.{m.name}")
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    all_queries()
    return dict(SQL_TEXT)
