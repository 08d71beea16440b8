"""Can every source be read, and how many rows does it hold?"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Loader = Callable[[], DataFrame]


def _readable(load: Loader) -> bool:
    try:
        load().limit(1).collect()
    except PySparkException:
        return False
    except Exception as error:  # a JVM error PySpark does not wrap
        if type(error).__module__.startswith("py4j"):
            return False
        raise
    return True


def probe_sources(spark: SparkSession, loaders: Mapping[str, Loader]) -> DataFrame:
    """One row per source: ``source``, ``accessible`` (one row could be fetched)."""
    found = [(name, _readable(load)) for name, load in loaders.items()]
    return spark.createDataFrame(found, "source STRING, accessible BOOLEAN")


def require_sources(spark: SparkSession, loaders: Mapping[str, Loader]) -> None:
    """Raise PermissionError naming the sources that cannot be read."""
    blocked = [
        row["source"]
        for row in probe_sources(spark, loaders).where(~F.col("accessible")).collect()
    ]
    if blocked:
        raise PermissionError(f"sources not readable: {sorted(blocked)}")


def count_sources(sources: Mapping[str, DataFrame]) -> DataFrame:
    """One row per source: ``source``, ``row_count``, in a single job."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("source"), "row_count"
        )
        for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, counts)
