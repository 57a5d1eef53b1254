"""Runs catalog queries on Spark and their SQL twins on DuckDB and compares the rows."""

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        if math.isnan(value):
            return "nan"
        text = f"{value:.6f}"
        return "0.000000" if text == "-0.000000" else text
    if isinstance(value, int):
        return f"{value:.6f}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(normal(v) for v in value) + "]"
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in data)


def compare(spark, con, sf, fn, sql):
    df = fn(spark, sf)
    left = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows([d[0] for d in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] == right[1]:
        return None
    extra = [r for r in left[1] if r not in set(right[1])][:2]
    missing = [r for r in right[1] if r not in set(left[1])][:2]
    return f"{len(left[1])} vs {len(right[1])} rows; spark only {extra}; sql only {missing}"[:1500]


def main():
    sys.path.insert(0, ".")
    import __spark_entry__ as entry
    from lakesearch.session import build_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = build_session("oracle", "local[8]", 8)
    con = connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, sf, fn, sql[name])
            else:
                n = fn(spark, sf).count()
                problem = None if n else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
