"""A kept copy of the features, rebuilt when it is marked dirty or the corpus has changed."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.schema import DIMS, FEATURES


def checked(features: DataFrame, dims: dict[str, int] | None = None) -> DataFrame:
    """``features`` with an error in place of a vector that is missing or has the wrong width, raised when it is read."""
    for f, n in (dims or DIMS).items():
        good = F.coalesce(F.size(f) == n, F.lit(False))
        features = features.withColumn(f, F.when(good, F.col(f)).otherwise(F.raise_error(F.lit(f"{f}: a vector is missing or has the wrong width"))))
    return features


class Snapshots:
    """One kept copy for each table of features, for sessions that search it again and again.

    ``get`` gives the kept rows as long as the table's number of rows stays and nobody has called ``mark_dirty``; else
    it reads them anew, one caller at a time. Above ``most`` rows there is no copy (None): such tables are searched
    where they lie. Executors keep the rows and may put them on disk; those of a lost one are read again.
    """

    def __init__(self, spark: SparkSession, most: int, dims: dict[str, int] | None = None):
        self.spark, self.most, self.dims = spark, most, dims
        self.kept: dict[str, tuple[int, DataFrame]] = {}
        self.lock = Lock()

    def get(self, path: str, id_col: str = "image_id") -> DataFrame | None:
        self.spark.catalog.refreshByPath(path)
        table = self.spark.read.parquet(path)
        n = table.count()
        with self.lock:
            old = self.kept.get(path)
            if old and (old[0] != n or n > self.most):
                self._drop(path)
                old = None
            if n > self.most:
                return None
            if not old:
                self.kept[path] = (n, checked(table.select(id_col, *FEATURES), self.dims).persist())
            return self.kept[path][1]

    def mark_dirty(self, path: str) -> None:
        with self.lock:
            self._drop(path)

    def reset(self) -> None:
        with self.lock:
            for path in list(self.kept):
                self._drop(path)

    def _drop(self, path: str) -> None:
        if path in self.kept:
            self.kept.pop(path)[1].unpersist()
