"""Compares a query with its SQL: column names, row counts and rows, order aside."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def by_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    con.sql("SET threads = 4")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    return got.columns, rows(got.columns, got.fetchall())


def by_spark(df) -> tuple[list[str], list[tuple]]:
    return df.columns, rows(df.columns, [tuple(r) for r in df.collect()])


def dealt(spark, run) -> int:
    """Rows that Spark writes to shuffles while run() runs."""
    sc = spark.sparkContext
    jvm, context = sc._jvm, sc._jsc.sc()

    def written() -> int:
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    run()
    return written() - before
