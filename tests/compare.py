"""Runs registered queries and their SQL side by side: ``python tests/compare.py SF [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = [str(d[1]) for d in cur.description]
    return names, types, cur.fetchall()


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return v + 0.0
    return v


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x).__name__), x if x is not None else 0) for x in r))


FAMILY = {"int": "int", "bigint": "int", "double": "float", "string": "str", "boolean": "bool"}


def mismatch(spark, name: str, fn, sql: str, sf_dir: str) -> str | None:
    """None if both sides agree exactly, else what differs."""
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    names, types, want = sql_rows(sf_dir, sql)
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    spark_types = dict(df.dtypes)
    sql_types = dict(zip(names, types))
    duck = {"INTEGER": "int", "BIGINT": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool"}
    for c in names:
        if FAMILY.get(spark_types[c]) != duck.get(sql_types[c]):
            return f"type of {c}: {spark_types[c]} vs {sql_types[c]}"
    a, b = canonical(df.columns, got), canonical(names, want)
    for x, y in zip(a, b):
        if x != y:
            return f"values {x} vs {y}"
    return None


if __name__ == "__main__":
    from curate.session import build_session
    from curate.workload.catalog import ORACLES, QUERIES

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    sf = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:] or list(QUERIES)
    bad = 0
    for q in wanted:
        start = time.time()
        try:
            if q in ORACLES:
                why = mismatch(spark, q, QUERIES[q], ORACLES[q], sf)
                note = "ok" if why is None else f"MISMATCH {why}"
            else:
                note = f"rows {len(QUERIES[q](spark, sf).collect())}"
                why = None
        except Exception as e:  # noqa: BLE001
            why = note = f"ERROR {str(e)[:1200]}"
        bad += why is not None
        print(f"{q:34s} {time.time() - start:6.2f}s {note}", flush=True)
    print("bad:", bad)
