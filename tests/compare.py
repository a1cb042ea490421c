"""Run registered queries beside their SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


LAST = {"spark": 0.0}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, bool) or isinstance(value, (int, str)):
        return value
    return str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql):
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())


def compare(spark, con, folder, fn, sql):
    """Empty string when equal, else what differs."""
    start = time.time()
    names, got = spark_rows(fn(spark, folder))
    LAST["spark"] = time.time() - start
    expected_names, expected = sql_rows(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    kinds = lambda rows: [{type(v).__name__ for v in col if v is not None} for col in zip(*list(rows)[:2000])]
    if got == expected:
        a, b = kinds(got), kinds(expected)
        return "" if a == b else f"types {list(zip(names, a, b))}"
    extra, missing = got - expected, expected - got
    return (
        f"rows {sum(got.values())} vs {sum(expected.values())}; extra {sum(extra.values())} "
        f"{[str(x)[:600] for x in list(extra)[:2]]}; missing {sum(missing.values())} {[str(x)[:600] for x in list(missing)[:2]]}"
    )


def main(argv):
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from scriptoria.session import build_session

    folder = argv[1]
    prefixes = argv[2:]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
                                                "spark.log.level": "ERROR", "spark.ui.showConsoleProgress": "false"})
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start, LAST["spark"] = time.time(), 0.0
        try:
            if name in oracles:
                verdict = compare(spark, con, folder, fn, oracles[name])
            else:
                verdict = f"rows only: {len(fn(spark, folder).collect())}"
        except Exception as error:  # report and go on with the next query
            verdict = f"ERROR {str(error)[:1500]}"
        seconds = time.time() - start
        bad += bool(verdict) and not verdict.startswith("rows only")
        print(f"{'ok ' if not verdict else '** '} {name} {LAST["spark"]:.1f}/{seconds:.1f}s {verdict}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main(sys.argv)
