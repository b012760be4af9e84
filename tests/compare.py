"""Run registered queries next to their DuckDB oracles and report differences."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            if v is None or v is pd.NaT:
                cells.append("<null>")
            elif isinstance(v, float):
                cells.append("<null>" if v != v else repr(v + 0.0))
            else:
                cells.append(str(v))
        out.append(tuple(cells))
    return sorted(out)


def compare(spark, con, root: str, name: str, fn, sql: str | None) -> tuple[str, str]:
    df = fn(spark, root)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return ("ROWS", f"{len(got)} rows, no oracle")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return ("COLUMNS", f"{sorted(df.columns)} != {sorted(names)}")
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    odd = [
        (f.name, f.dataType.simpleString(), types[f.name])
        for f in df.schema.fields
        if SPARK_TO_DUCK.get(f.dataType.simpleString()) != types[f.name]
    ]
    a, b = canonical(got, df.columns), canonical(want, names)
    if a != b:
        only_a = sorted(set(a) - set(b))[:3]
        only_b = sorted(set(b) - set(a))[:3]
        return ("VALUES", f"{len(a)} vs {len(b)} rows\n   spark {only_a}\n   duck  {only_b}")
    if odd:
        return ("TYPES", str(odd))
    if not a:
        return ("EMPTY", "no rows on either side")
    return ("ok", f"{len(a)} rows")


def main(argv: list[str]) -> int:
    repo = Path(__file__).resolve().parent.parent
    sys.path.insert(0, str(repo))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    root = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", "/tmp/spark-warehouse-compare")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(root)
    oracles, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            verdict, detail = compare(spark, con, root, name, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001 - a report, not a handler
            verdict, detail = "ERROR", f"{type(error).__name__}: {str(error)[:600]}"
        bad += verdict not in ("ok", "ROWS")
        print(f"{verdict:8s}{name:44s}{time.time() - started:6.2f}s  {detail}", flush=True)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
