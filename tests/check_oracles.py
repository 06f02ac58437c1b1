"""Compare every query with its SQL on the same tables: ``python tests/check_oracles.py [sf] [names]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _canon(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    return value


def compare(df, con, sql):
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    want_rows = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    odd = {c: (t, types[c]) for c, t in df.dtypes if kinds.get(t) != types[c]}
    if odd:
        return f"types {odd}"
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    got = sorted((tuple(_canon(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(_canon(r[i]) for i in order) for r in want_rows), key=repr)
    if got == want:
        return None
    only_got = [r for r in got if r not in set(want)][:2]
    only_want = [r for r in want if r not in set(got)][:2]
    return f"rows {len(got)} vs {len(want)}\n  spark {only_got}\n  sql   {only_want}"


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    names = sys.argv[2:] or list(entry.queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            if name in oracles:
                verdict = compare(df, con, oracles[name])
                verdict = "ok" if verdict is None else "DIFFERS " + verdict
            else:
                verdict = f"rows only: {len(df.collect())}"
        except Exception as error:  # noqa: BLE001
            verdict = f"FAILED {type(error).__name__} {str(error)[:700]}"
        bad += verdict.startswith(("DIFFERS", "FAILED"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
