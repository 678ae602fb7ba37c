"""Compare registered queries with their check SQL: python -m tests.compare [--sf DIR] [names...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if value is None:
        return "~"
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, name, function, sql):
    started = time.time()
    df = function(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return len(rows) > 0, f"{len(rows)} rows, no check, {took:.1f}s"
    started = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want_types = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    sql_took = time.time() - started
    a_cols, a = normal(df.columns, rows)
    b_cols, b = normal(names, want)
    note = f"{len(rows)} rows, {took:.1f}s / {sql_took:.1f}s"
    if a_cols != b_cols:
        return False, f"columns {a_cols} != {b_cols}"
    kinds = [f"{f.name}:{f.dataType.simpleString()}/{want_types[f.name]}" for f in df.schema.fields
             if not same_kind(f.dataType.simpleString(), want_types[f.name])]
    if kinds:
        note += f" TYPES {kinds}"
    if a != b:
        left, right = set(a) - set(b), set(b) - set(a)
        return False, f"{note}; {len(a)} != {len(b)}; spark {sorted(left)[:3]} sql {sorted(right)[:3]}"
    return not kinds and len(rows) > 0, note


def same_kind(spark_type, duck_type):
    table = {"bigint": {"BIGINT", "NUMBER"}, "string": {"VARCHAR", "STRING"}, "double": {"DOUBLE", "NUMBER"}, "boolean": {"BOOLEAN", "bool"}}
    return duck_type in table.get(spark_type, set())


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from siftline.session import local_session

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = local_session("8")
    con = connect(sf_dir)
    checks = entry.oracle_sql()
    bad = 0
    for name, function in entry.queries().items():
        if args and name not in args:
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name, function, checks.get(name))
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name, note, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
