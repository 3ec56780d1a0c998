"""Writable tables: Parquet snapshots under version folders and a pointer that is swapped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class SnapshotTable:
    """A folder with ``v000001`` ... and ``current``, a one-line file that names the version to read.

    A write makes a whole new version first and then replaces the pointer by a rename, so
    readers see the old table or the new one, and a failed write leaves the old one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        if not self.fs.exists(self._at("current")):
            return 0
        source = self.fs.open(self._at("current"))
        try:
            return int(bytes(source.readAllBytes()).decode().strip())
        finally:
            source.close()

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self.version():06d}")

    def write(self, df: DataFrame, keep: int = 2) -> int:
        old = self.version()
        new = old + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{new:06d}")
        out = self.fs.create(self._at(f".current-{new}"), True)
        out.write(bytearray(str(new).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        files = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at("current").toUri() if self._at("current").toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        files.rename(self._at(f".current-{new}"), self._at("current"), options)
        if old > keep:
            self.fs.delete(self._at(f"v{old - keep:06d}"), True)
        return new
