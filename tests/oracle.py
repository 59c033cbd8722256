"""Compare registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def compare(df, con, sql: str) -> str | None:
    """None when columns and rows agree, else a short account."""
    cols = sorted(df.columns)
    ours = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    index = [names.index(c) for c in cols]
    theirs = sorted((tuple(_norm(r[i]) for i in index) for r in rel.fetchall()), key=repr)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}"
    if not ours:
        return "no rows"
    for a, b in zip(ours, theirs):
        for x, y in zip(a, b):
            if type(x) is not type(y) and not (x is None and y is None):
                return f"type {type(x)} vs {type(y)}: {a} vs {b} ({cols})"
        if repr(a) != repr(b):
            return f"{a} vs {b} ({cols})"
    return None


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from hawkframe.catalog import all_queries, all_sql
    from hawkframe.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf)
    sqls, bad = all_sql(), 0
    for name, fn in all_queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in sqls:
                issue = compare(fn(spark, sf), con, sqls[name])
            else:
                n = fn(spark, sf).count()
                issue = None if n else "no rows"
        except Exception as e:  # report and go on
            issue = "ERROR " + str(e)[:600]
        bad += issue is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if issue is None else 'FAIL ' + issue}", flush=True)
    print("failures", bad)
