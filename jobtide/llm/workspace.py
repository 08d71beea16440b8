"""Tables between the steps of an operator, in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobtide.sinks.store import shared_folder


class Workspace:
    """Parquet tables below one new shared folder.

    A table cuts the lineage: when an executor is lost, its readers start from the files.
    ``drop`` removes what later steps no longer read; tables behind a returned
    frame have to stay until it has been used.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_folder(spark)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def save(self, frame: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write the frame and return it as read back."""
        writer = frame.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(self.path(name))
        # An empty partitioned table has no file to take a schema from.
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
