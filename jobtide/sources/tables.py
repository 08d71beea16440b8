"""Access to source tables by catalog name or by path."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession


def read_source(spark: SparkSession, location: str, fmt: str = "parquet") -> DataFrame:
    """A catalog table, or files when ``location`` looks like a path."""
    if "/" in location:
        return spark.read.format(fmt).load(location)
    return spark.table(location)


def read_sources(
    spark: SparkSession, locations: Mapping[str, str], fmt: str = "parquet"
) -> dict[str, DataFrame]:
    return {name: read_source(spark, place, fmt) for name, place in locations.items()}


def local_rows(spark: SparkSession, rows: Iterable[Mapping], schema) -> DataFrame:
    """A few driver-side records (a run-log row) as a DataFrame of a declared schema."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
