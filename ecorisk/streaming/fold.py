"""Folding new features into a kept assessment: cell extents add up, hulls merge, so state is two small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecorisk.operators.distribution import aoo_grid, assembled, eoo, folded, merged_hulls, one_percent


class Assessment:
    """State under `path`: one folder per folded batch number; a batch that is folded again changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _last(self) -> int:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(hadoop):
            return -1
        done = [int(s.getPath().getName()) for s in system.listStatus(hadoop) if s.getPath().getName().isdigit() and system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "points/_SUCCESS"))]
        return max(done, default=-1)

    def extents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._last()}/extents")

    def points(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self._last()}/points")

    def fold(self, features: DataFrame, batch: int) -> None:
        """Adds a batch of features; to be called by foreachBatch."""
        last = self._last()
        if batch <= last:
            return
        new, shape = folded(features)
        if last >= 0:
            new = new.unionByName(self.extents())
        total = new.groupBy("ecosystem", "col", "row").agg(F.sum("extent_m2").alias("extent_m2"))
        total.write.mode("overwrite").parquet(f"{self.path}/{batch}/extents")
        points = shape.select("ecosystem", F.explode("hull").alias("p")).select("ecosystem", "p.x", "p.y")
        if last >= 0:
            points = merged_hulls(points.unionByName(self.points())).select("ecosystem", F.explode("hull").alias("p")).select("ecosystem", "p.x", "p.y")
        points.write.mode("overwrite").parquet(f"{self.path}/{batch}/points")
        self._forget(batch)

    def _forget(self, batch: int) -> None:
        """Removes the states before the last but one, which no reader can still be going on with."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = sorted(int(s.getPath().getName()) for s in system.listStatus(hadoop) if s.getPath().getName().isdigit() and int(s.getPath().getName()) < batch)
        for n in old[:-1]:
            system.delete(self.spark._jvm.org.apache.hadoop.fs.Path(hadoop, str(n)), True)

    def metrics(self) -> DataFrame:
        shape = merged_hulls(self.points())
        return assembled(shape.select("ecosystem"), one_percent(aoo_grid(self.extents())), eoo(shape))


def start(features: DataFrame, state: str, checkpoint: str):
    """A streaming query that folds each new batch of a streaming features frame into the state."""
    kept = Assessment(features.sparkSession, state)
    return features.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: kept.fold(df, n)).start()
