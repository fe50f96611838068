"""Compare registered queries with their SQL twins: python tests/check.py [sf_dir] [name-prefix ...]"""
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(d):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return str([norm(x) for x in v])
    return str(v)


def compare(df, con, sql):
    """None when equal, else a message."""
    cols = sorted(df.columns)
    a = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    idx = [names.index(c) for c in cols]
    b = sorted(tuple(norm(r[i]) for i in idx) for r in cur.fetchall())
    if a == b:
        return None
    only_a, only_b = sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2]
    return f"rows {len(a)} vs {len(b)}; spark {only_a} sql {only_b} {cols}"


if __name__ == "__main__":
    from bermline.plans.registry import all_queries, all_sql
    from bermline.session import session

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    want = sys.argv[2:]
    spark = session("check", "local[8]", **{"spark.sql.shuffle.partitions": 8, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad, n = duck(d), 0, 0
    sqls = all_sql()
    for name, fn in all_queries().items():
        if want and not any(name.startswith(w) for w in want):
            continue
        n += 1
        t = time.time()
        try:
            df = fn(spark, d)
            msg = compare(df, con, sqls[name]) if name in sqls else f"rows-only {df.count()}"
        except Exception as e:  # report and go on
            msg = f"ERROR {type(e).__name__} {str(e)[:700]}"
        ok = msg is None or msg.startswith("rows-only")
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - t:5.1f}s {name} {msg or ''}", flush=True)
    print(f"{n} queries, {bad} failed")
