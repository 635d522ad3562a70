"""Compares registered queries with their SQL on DuckDB: names, types, rows, values.

    python tests/oracle.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf):
    import duckdb

    con = duckdb.connect(config={"memory_limit": "8GB"})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf, queries, oracles):
    """None if equal, else what differs."""
    df = queries[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in oracles:
        return None if got else "no rows"
    rel = con.sql(oracles[name])
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}
    have = dict(df.dtypes)
    for column, kind in zip(rel.columns, rel.types):
        if kinds.get(str(kind), str(kind)) != have[column]:
            return f"type of {column}: {have[column]} != {kind}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got, df.columns), canonical(want, rel.columns)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} rows differ, e.g. {str(bad[0])[:600]}"
    return None if got else "both empty"


def main():
    import __spark_entry__ as e
    from answerloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = e.queries(), e.oracle_sql()
    names = sys.argv[2:] or list(queries)
    failed = []
    for name in names:
        t = time.time()
        try:
            problem = compare(spark, con, name, sf, queries, oracles)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        mark = "ok " if problem is None else "BAD"
        print(f"{mark} {name} {time.time() - t:.1f}s{'' if name in oracles else ' (rows only)'} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} agree; failed: {failed}")
    spark.stop()


if __name__ == "__main__":
    main()
