"""A place for result tables: a catalog database or a folder."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from jobtide.schemas import TABLES, conform


def shared_folder(spark: SparkSession) -> str:
    """The name of a new folder that driver and executors see alike.

    It lies below ``spark.checkpoint.dir``, or, where that is unset, below the warehouse, which tables share as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/jobtide-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder, in whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Error classes of a table or folder that is not there, or holds nothing.
ABSENT = ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "SCHEMA_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


@contextmanager
def session_setting(spark: SparkSession, key: str, value: str):
    """A session setting for what takes it from nowhere else, then put back."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass(frozen=True)
class Store:
    """Tables ``<database>.<name>`` in the catalog, or ``<folder>/<name>`` as files."""

    spark: SparkSession
    folder: str | None = None
    database: str | None = None
    fmt: str = "parquet"

    def __post_init__(self):
        if (self.folder is None) == (self.database is None):
            raise ValueError("give either a folder or a database")

    def name_of(self, table: str) -> str:
        return f"{self.folder}/{table}" if self.folder else f"{self.database}.{table}"

    def read(self, table: str, merge_schema: bool = False) -> DataFrame:
        """The table; ``merge_schema`` unites files of several schema versions."""
        if self.folder:
            reader = self.spark.read.format(self.fmt)
            if merge_schema:
                reader = reader.option("mergeSchema", "true")
            return reader.load(self.name_of(table))
        return self.spark.table(self.name_of(table))

    def exists(self, table: str) -> bool:
        try:
            self.read(table)
        except AnalysisException as error:
            if error.getCondition() in ABSENT:
                return False
            raise
        return True

    def write(
        self,
        df: DataFrame,
        table: str,
        mode: str = "overwrite",
        partition_by: Sequence[str] = (),
    ) -> int:
        """Write ``df`` in one action and return its row count.

        Declared tables are cast to their schema first; further columns are kept. An
        overwrite replaces the schema too, an append may bring new columns.
        """
        counted, df = self._counted(df, table, partition_by)
        if self.database:
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {self.database}")
            if mode == "append" and self.exists(table):
                self._aligned(df, table).write.insertInto(self.name_of(table))
                return counted.get["rows"]
        writer = df.write.format(self.fmt).mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        if self.database:
            writer.saveAsTable(self.name_of(table))
        else:
            writer.save(self.name_of(table))
        return counted.get["rows"]

    def replace_partitions(self, df: DataFrame, table: str, partition_by: Sequence[str]) -> int:
        """Replace only the partitions that ``df`` has rows for.

        Dynamic overwrite swaps them in when the job commits, so ``df`` may read the
        table itself.
        """
        counted, df = self._counted(df, table, partition_by)
        if self.database:
            with session_setting(self.spark, "spark.sql.sources.partitionOverwriteMode", "dynamic"):
                self._aligned(df, table).write.insertInto(self.name_of(table), overwrite=True)
        else:
            writer = df.write.format(self.fmt).mode("overwrite").partitionBy(*partition_by)
            writer.option("partitionOverwriteMode", "dynamic").save(self.name_of(table))
        return counted.get["rows"]

    def _counted(self, df: DataFrame, table: str, partition_by: Sequence[str]):
        """The frame to write, with a row counter in its last stage.

        Partitioned output is rebalanced by Spark at run time, which splits a hot
        partition value over several tasks and merges small ones.
        """
        if table in TABLES:
            df = conform(df, TABLES[table], keep_extra=True)
        if partition_by:
            df = df.hint("rebalance", *[F.col(c) for c in partition_by])
        counted = Observation()
        return counted, df.observe(counted, F.count(F.lit(1)).alias("rows"))

    def _aligned(self, df: DataFrame, table: str) -> DataFrame:
        """``df`` in the stored column order; columns new to the table are added to it."""
        known = set(self.read(table).columns)
        added = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in known]
        if added:
            self.spark.sql(f"ALTER TABLE {self.name_of(table)} ADD COLUMNS ({', '.join(added)})")
        return conform(df, self.read(table).schema, fill_missing=True)

    def write_if_any(self, df: DataFrame, table: str, persist: bool = True, **how) -> int:
        """Write ``df`` unless it has no rows; an existing table then stays as it is.

        ``persist`` lets the emptiness check and the write compute ``df`` once. Switch
        it off for plain scans too large to keep, where finding one row is cheap.
        """
        if not persist:
            return 0 if df.isEmpty() else self.write(df, table, **how)
        kept = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return 0 if kept.isEmpty() else self.write(kept, table, **how)
        finally:
            kept.unpersist()

    def write_all(self, frames: Mapping[str, DataFrame | None], **how) -> dict[str, int]:
        """Write every frame that is given and has rows; the row count of each."""
        return {
            table: 0 if df is None else self.write_if_any(df, table, **how)
            for table, df in frames.items()
        }
