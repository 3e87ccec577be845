"""Run registered queries beside their SQL: ``python -m checks.compare [folder] [names]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def local_spark(cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    # Python workers import the package, wherever they are started.
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH")]))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def given_tables(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def _kind(name: str) -> str:
    name = name.lower()
    return {"long": "bigint", "integer": "int", "string": "varchar", "boolean": "bool"}.get(name, name)


def _rows(rows, names: list[str]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else repr(value + 0.0)
        return repr(value)

    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, connection, folder: str, name: str) -> tuple[int, list[str]]:
    """Row count, and what differs between the query and its SQL."""
    df = QUERIES[name](spark, folder)
    mine = [tuple(row) for row in df.collect()]
    cursor = connection.execute(ORACLE[name])
    names = [column[0] for column in cursor.description]
    theirs = cursor.fetchall()
    faults = []
    if sorted(df.columns) != sorted(names):
        return len(mine), [f"columns {sorted(df.columns)} / {sorted(names)}"]
    kinds = {c[0]: _kind({"INTEGER": "int"}.get(str(c[1]), str(c[1]))) for c in cursor.description}
    for field in df.schema.fields:
        if _kind(field.dataType.typeName()) != _kind(kinds[field.name]):
            faults.append(f"type of {field.name}: {field.dataType.typeName()} / {kinds[field.name]}")
    left, right = _rows(mine, df.columns), _rows(theirs, names)
    if left != right:
        only_left = [row for row in left if row not in set(right)][:2]
        only_right = [row for row in right if row not in set(left)][:2]
        faults.append(f"{len(left)} / {len(right)} rows; only here {only_left}; only there {only_right}")
    return len(mine), faults


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_spark(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    connection = given_tables(folder)
    bad = 0
    for name in names:
        if name not in ORACLE:
            print(f"{name}: no SQL")
            continue
        start = time.time()
        try:
            rows, faults = compare(spark, connection, folder, name)
        except Exception as error:  # show it and go on with the next query
            rows, faults = 0, [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(faults)
        print(f"{name}: {rows} rows, {time.time() - start:.1f} s, {'; '.join(faults) or 'ok'}", flush=True)
    missing = sorted(set(ORACLE) - set(QUERIES))
    print(f"{len(names)} queries, {bad} differ; SQL without a query: {missing}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
