"""Run a registered query in Spark and its SQL in DuckDB and compare the rows.

``python tests/compare.py <sf_dir> [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


KIND = {"int": "i", "bigint": "i", "double": "f", "string": "s", "boolean": "b", "date": "d",
        "timestamp": "t", "timestamp_ntz": "t",
        "INTEGER": "i", "BIGINT": "i", "DOUBLE": "f", "VARCHAR": "s", "BOOLEAN": "b", "DATE": "d", "TIMESTAMP": "t"}


def compare(spark, con, fn, sql, sf_dir):
    """None when the results agree, else a text saying how they differ."""
    df = fn(spark, sf_dir)
    rel = con.sql(sql)
    spark_types = {n: KIND.get(t, t) for n, t in df.dtypes}
    duck_types = {n: KIND.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns differ: {names} vs {sorted(rel.columns)}"
    if spark_types != duck_types:
        return f"types differ: { {n: (spark_types[n], duck_types[n]) for n in names if spark_types[n] != duck_types[n]} }"
    left = sorted((tuple(normal(r[n]) for n in names) for r in df.collect()), key=repr)
    index = [rel.columns.index(n) for n in names]
    right = sorted((tuple(normal(r[i]) for i in index) for r in rel.fetchall()), key=repr)
    if len(left) != len(right):
        return f"row counts differ: {len(left)} vs {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, first: {names}\n   {bad[0][0]}\n   {bad[0][1]}"
    return None if left else "no rows on either side"


def main(argv):
    import __spark_entry__ as entry
    from remitlens.session import build_session

    sf_dir, names = argv[0], argv[1:]
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = build_session(
        "remitlens-compare", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
        spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failures = 0
    picked = [n for n in queries if not names or any(n == p or (p.endswith("*") and n.startswith(p[:-1])) for p in names)]
    for name in picked:
        started = time.time()
        try:
            if name in oracles:
                error = compare(spark, con, queries[name], oracles[name], sf_dir)
            else:
                error = None if queries[name](spark, sf_dir).count() > 0 else "no rows"
        except Exception as exc:  # report every query, then fail
            error = f"{type(exc).__name__}: {str(exc)[:1500]}"
        failures += error is not None
        print(f"{'ok  ' if error is None else 'FAIL'} {name} {time.time() - started:.1f}s {error or ''}", flush=True)
    print(f"{len(picked) - failures} of {len(picked)} agree")
    spark.stop()
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
