"""Fact tables from dictionaries: columns that aren't given are null."""

from factloom.sources import facts


def table(spark, name, rows):
    names = spark.createDataFrame([], facts.SCHEMAS[name]).columns
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], facts.SCHEMAS[name])
