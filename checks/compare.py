"""Run registered queries beside their SQL in DuckDB and report where they part.

    python -m checks.compare /root/testdata/sf0.01 [QUERY ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, bool):
        return value
    return value if isinstance(value, (int, str)) else str(value)


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(row[i]) for i in order) for row in rows)


def main(sf_dir: str, names: list[str]) -> int:
    import duckdb
    from pyspark.sql import SparkSession

    from checks.oracle import ORACLE
    from checks.queries import QUERIES

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    def connect():
        con = duckdb.connect()
        for table in TABLES:
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        return con

    con = connect()
    bad = 0
    for name in names or list(QUERIES):
        if name not in ORACLE:
            print(f"{name:28s} no SQL", flush=True)
            continue
        try:
            start = time.time()
            cur = con.execute(ORACLE[name])
            want_cols = [d[0] for d in cur.description]
            types = {d[0]: str(d[1]) for d in cur.description}
            want = rows_of(want_cols, cur.fetchall())
            mid = time.time()
            df = QUERIES[name](spark, sf_dir)
            got = rows_of(df.columns, [tuple(r) for r in df.collect()])
            took = f"sql {mid - start:5.2f}s spark {time.time() - mid:5.2f}s"
            odd = [c for c, t in types.items() if t not in ("VARCHAR", "BIGINT", "DOUBLE", "BOOLEAN", "STRING", "NUMBER")]
            kinds = dict(df.dtypes)
            pair = {"string": "VARCHAR", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN"}
            odd += [c for c in types if c in kinds and pair.get(kinds[c]) != types[c]]
            if sorted(df.columns) != sorted(want_cols):
                print(f"{name:28s} COLUMNS {set(df.columns) ^ set(want_cols)}", flush=True)
                bad += 1
            elif got != want:
                bad += 1
                print(f"{name:28s} DIFFERS spark={sum(got.values())} sql={sum(want.values())} {took}", flush=True)
                print("   columns", sorted(df.columns))
                for label, rest in (("only spark", got - want), ("only sql  ", want - got)):
                    for row in sorted(rest, key=str)[:3]:
                        print("   ", label, row)
            else:
                print(f"{name:28s} ok {sum(got.values()):6d} rows {took} {'TYPES ' + str(sorted(set(odd))) if odd else ''}", flush=True)
        except Exception as error:  # noqa: BLE001 - a report, not control flow
            bad += 1
            con = connect()
            print(f"{name:28s} FAILED {str(error).split('JVM stacktrace')[0][:600]}", flush=True)
    print(f"{bad} of {len(names or QUERIES)} not in agreement")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
