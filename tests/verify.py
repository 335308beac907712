"""Run registered queries in Spark and their SQL in DuckDB and compare the results.

usage: python tests/verify.py [sf] [name prefix ...]
"""
import datetime
import decimal
import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def normal(value):
    if value is None or isinstance(value, (str, bool)):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)[:10]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(row[i]) for i in order) for row in rows), key=repr), [columns[i] for i in order]


def compare(spark_df, relation):
    left, lcols = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    right, rcols = rows_of(relation.columns, relation.fetchall())
    if lcols != rcols:
        return f"columns {lcols} != {rcols}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)} of {len(left)} rows differ, e.g.\n    {lcols}\n    spark {bad[0][0]}\n    sql   {bad[0][1]}"
    types = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "boolean": "BOOLEAN"}
    have = {c: types.get(t, t) for c, t in spark_df.dtypes}
    want = dict(zip(relation.columns, map(str, relation.types)))
    if have != want:
        diff = {c: (have[c], want[c]) for c in have if have[c] != want[c]}
        return f"types differ: {diff}"
    return None if left else "EMPTY"


def main():
    import duckdb
    import __spark_entry__ as entry
    from gridlake.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    shuffle = os.environ.get("SHUFFLE_PARTITIONS")
    path = f"/root/testdata/sf{sf}"
    spark = local_session()
    if shuffle:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    queries, sql = entry.queries(), entry.oracle_sql()
    failed, slow = [], []
    for name, query in queries.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = query(spark, path)
            if name in sql:
                problem = compare(df, con.sql(sql[name]))
            else:
                problem = None if df.count() else "EMPTY"
        except Exception as error:  # report and go on
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - start
        slow.append((took, name))
        if problem:
            failed.append(name)
            print(f"FAIL {name} ({took:.1f}s): {problem}", flush=True)
    print(f"{len(slow) - len(failed)} of {len(slow)} ok; without SQL: "
          f"{[n for n in queries if n not in sql]}; failed: {failed}")
    print("slowest:", [(round(t, 1), n) for t, n in sorted(slow, reverse=True)[:12]], "total", round(sum(t for t, _ in slow)))


if __name__ == "__main__":
    main()
