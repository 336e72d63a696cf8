"""Tables that a stream carries from micro-batch to micro-batch, and what it writes, one folder for each batch id.

A batch reads the tables of the batch before and overwrites its own, so a batch that runs again gives the same rows
and nothing twice, and a query that starts again from its checkpoint goes on where it was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Carried:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def folder(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def _files(self, folder: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def load(self, name: str, batch: int, schema) -> DataFrame:
        """The table of a batch; empty where there was none."""
        files, path = self._files(self.folder(name, batch))
        if not files.exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder(name, batch))

    def save(self, df: DataFrame, name: str, batch: int, keep: bool = False) -> DataFrame:
        """df as the table of a batch; only the batch before is kept as well, unless all are."""
        df.write.mode("overwrite").parquet(self.folder(name, batch))
        if not keep:
            files, path = self._files(self.folder(name, batch - 2))
            files.delete(path, True)
        return self.spark.read.schema(df.schema).parquet(self.folder(name, batch))

    def last(self, name: str) -> int:
        """The largest batch that the table has; -1 without any."""
        files, path = self._files(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return max((int(f.removeprefix("batch=")) for f in found if f.startswith("batch=")), default=-1)

    def all(self, name: str, schema) -> DataFrame:
        """The rows of all batches."""
        return self.spark.read.schema(schema).parquet(*[self.folder(name, k) for k in range(self.last(name) + 1)])
