"""Small tables that are written anew as a whole, version by version."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_VERSION = re.compile(r"batch_id=(\d+)")
KEPT_VERSIONS = 2


@dataclass(frozen=True)
class Versions:
    """A table with a version per batch, below one folder of any file system Spark knows."""

    path: str

    def _folder(self, spark: SparkSession):
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()), path

    def whole(self, spark: SparkSession) -> list[int]:
        """The batches whose version was written to its end, from a listing of the folder."""
        files, path = self._folder(spark)
        if not files.exists(path):
            return []
        names = (_VERSION.fullmatch(s.getPath().getName()) for s in files.listStatus(path))
        found = (int(m[1]) for m in names if m)
        done = spark._jvm.org.apache.hadoop.fs.Path
        return sorted(n for n in found if files.exists(done(self.of(n), "_SUCCESS")))

    def of(self, batch_id: int) -> str:
        return f"{self.path}/batch_id={batch_id}"

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """What the batch before this one left; None before the first. A version that should
        be there and is not is an error, never an empty start."""
        return spark.read.parquet(self.of(batch_id - 1)) if batch_id > 0 else None

    def write(self, df: DataFrame, batch_id: int) -> DataFrame:
        """Write a batch's version and drop those that no batch or reader needs any more."""
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(self.of(batch_id))
        files, _ = self._folder(spark)
        for old in self.whole(spark):
            if old <= batch_id - KEPT_VERSIONS:
                files.delete(spark._jvm.org.apache.hadoop.fs.Path(self.of(old)), True)
        return spark.read.parquet(self.of(batch_id))

    def newest(self, spark: SparkSession) -> DataFrame:
        """The last whole version."""
        return spark.read.parquet(self.of(self.whole(spark)[-1]))
