"""Compare registered queries with their SQL: python tests/compare.py [folder] [names...]"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as entry  # noqa: E402
from tabulon.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return repr(float(v)) if type(v).__name__ == "Decimal" else repr(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, folder, name):
    """(matches, text) for one query with SQL."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    start = time.time()
    df = entry.queries()[name](spark, folder)
    got, got_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no SQL ({spent:.1f}s)"
    start = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want, want_columns = rows_of(columns, result.fetchall())
    took = time.time() - start
    kinds = {d[0]: str(d[1]) for d in result.description}
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return False, f"{len(got)} vs {len(want)} rows; {bad}"
    types = [(n, k, kinds[n]) for n, k in df.dtypes]
    odd = [t for t in types if not same_kind(t[1], t[2])]
    return True, f"{len(got)} rows ({spent:.1f}s, sql {took:.1f}s) {odd or ''}"


def same_kind(spark_type, duck_type):
    pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    return pairs.get(spark_type) == duck_type or duck_type in ("NUMBER", "STRING")


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("compare", "local[8]")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.sparkContext.setLogLevel("OFF")
    failed = []
    for name in names:
        try:
            fine, text = compare(spark, folder, name)
        except Exception as error:  # noqa: BLE001
            fine, text = False, f"{type(error).__name__}: {str(error)[:400]}"
        print("ok  " if fine else "BAD ", name, text, flush=True)
        failed += [] if fine else [name]
    print(len(names) - len(failed), "of", len(names), "match;", failed)
