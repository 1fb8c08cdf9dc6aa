"""Kept tables: laid out by id so that they join without being dealt again, under a version of their schema that steps raise."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from nearfield.functions.schema import SCHEMA_VERSION, STEPS, SchemaError
from nearfield.operators.shared import children, claimed, exists, removed

Steps = Mapping[int, Callable[[DataFrame], DataFrame]]

#: The table property that tells the version.
VERSION = "schema.version"


@dataclass(frozen=True)
class Kept:
    """A table in a folder, in buckets of its id and sorted by it.

    ``path``/version=n/rows has the rows of schema version n, ``path``/version=n/layout, written last, how they lie. Reading
    makes them a table of the session's catalog, whose buckets joins and groupings by id use as they are: tables of the same
    number of buckets meet bucket by bucket, without a shuffle.
    """

    spark: SparkSession
    path: str

    def _at(self, version: int, name: str) -> str:
        return f"{self.path}/version={version}/{name}"

    def versions(self) -> list[int]:
        """Versions that are whole, in order."""
        names = [x.removeprefix("version=") for x in children(self.spark, self.path) if x.startswith("version=")]
        return sorted(int(x) for x in names if x.isdigit() and exists(self.spark, f"{self._at(int(x), 'layout')}/_SUCCESS"))

    def write(self, df: DataFrame, id_col: str = "id", buckets: int | None = None, version: int = SCHEMA_VERSION) -> Kept:
        """Lays ``df`` out. A version that is there is an error; null ids lie in a bucket too. ``buckets`` is as many as a
        shuffle has partitions, if it is not told; one id, however frequent, lies in one bucket."""
        if version in self.versions():
            raise SchemaError(f"{self.path} has version {version}")
        n = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows, name = self._at(version, "rows"), self._name(version)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        removed(self.spark, rows)  # of a write that did not come to its end
        df.repartition(n, id_col).write.bucketBy(n, id_col).sortBy(id_col).option("path", rows).format("parquet").saveAsTable(name)
        self._tell(version)
        layout = [(id_col, n, version, df.schema.json())]
        self.spark.createDataFrame(layout, "id_col string, buckets int, version int, columns string").coalesce(1).write.mode("overwrite").parquet(self._at(version, "layout"))
        return self

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the highest if none is named; one that this library does not know is an error."""
        have = self.versions()
        if not have or (version is not None and version not in have):
            raise SchemaError(f"{self.path} has no table" if not have else f"{self.path} has no version {version}")
        version = have[-1] if version is None else version
        if version > SCHEMA_VERSION:
            raise SchemaError(f"{self.path} is of version {version}, and {SCHEMA_VERSION} is the highest that is known")
        name = self._name(version)
        if not self.spark.catalog.tableExists(name):
            at = self._layout(version)
            columns, key = StructType.fromJson(json.loads(at["columns"])).toDDL(), f"`{at['id_col']}`"
            rows = self._at(version, "rows").replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {at['buckets']} BUCKETS LOCATION '{rows}'")
            self._tell(version)
        return self.spark.table(name)

    def raised(self, table: str, steps: Mapping[str, Steps] = STEPS, to: int = SCHEMA_VERSION) -> DataFrame:
        """The rows in version ``to``, step by step from the highest version below it that there is.

        A step is taken once: its version is then there and is read. One caller takes it; others, and those that come after one
        that did not come to its end, get an error that names its mark. Earlier versions stay until somebody removes them.
        A step that is missing is an error, and a table of a version above ``to`` too; rows that are written meanwhile are lost to a step.
        """
        have = self.versions()
        if not have or have[-1] > to:
            raise SchemaError(f"{self.path} has no table" if not have else f"{self.path} is of version {have[-1]}, above {to}")
        for old in range(have[-1], to):
            step = steps.get(table, {}).get(old)
            if step is None:
                raise SchemaError(f"{table}: no step leads on from version {old}")
            mark = f"{self.path}/_raising-{old + 1}"
            if not claimed(self.spark, mark):
                raise SchemaError(f"{self.path} is being raised to version {old + 1}; if that broke off, remove {mark}")
            try:
                at = self._layout(old)
                self.write(step(self.read(old)), at["id_col"], at["buckets"], old + 1)
            finally:
                removed(self.spark, mark)
        return self.read(to)

    def _layout(self, version: int):
        return self.spark.read.parquet(self._at(version, "layout")).first()

    def _name(self, version: int) -> str:
        return f"kept_{hashlib.md5(f'{self.path}/{version}'.encode()).hexdigest()}"  # of this folder, in any session

    def _tell(self, version: int) -> None:
        self.spark.sql(f"ALTER TABLE {self._name(version)} SET TBLPROPERTIES ('{VERSION}' = '{version}')")

    def version(self) -> int:
        """The version that the table's property tells."""
        self.read()
        shown = self.spark.sql(f"SHOW TBLPROPERTIES {self._name(self.versions()[-1])} ('{VERSION}')").first()
        return int(shown["value"])


def met(left: DataFrame, right: DataFrame, id_col: str = "id", how: str = "inner") -> DataFrame:
    """A join by id that keeps to the buckets of kept tables: no side is dealt again, nor sent whole."""
    return left.hint("merge").join(right.hint("merge"), id_col, how)

