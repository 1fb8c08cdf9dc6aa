"""The folder that driver and executors share: rows written there cost no recomputation when executors are lost."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's, else the one that spark.checkpoint.dir names. Only a local master, whose
    executors are the driver itself, may do with a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="nearfield-"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows from the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def removed(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def claimed(spark: SparkSession, path: str) -> bool:
    """Makes an empty file that nobody else has made; False if somebody has. Of several callers one gets True."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p.getParent())
    try:
        if fs.getScheme() == "file":  # whose create looks first and makes then
            jvm.java.nio.file.Files.createFile(jvm.java.io.File(p.toUri().getPath()).toPath(), spark.sparkContext._gateway.new_array(jvm.java.nio.file.attribute.FileAttribute, 0))
        else:
            fs.create(p, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def appended(df: DataFrame, path: str) -> None:
    """Adds few rows to a Parquet table, as one file that is moved into it: appends at the same time do not meet."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    staged = f"{path}/_staged-{name}"
    df.coalesce(1).write.parquet(staged)
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for part in children(spark, staged):
        if part.endswith(".parquet"):
            fs.rename(p(f"{staged}/{part}"), p(f"{path}/{name}-{part}"))
    fs.delete(p(staged), True)


def row_numbers(df: DataFrame, by: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """``df`` with the place of each row from 1 within ``by`` (nothing for all rows), in ``order``.

    Rows lie in sorted ranges that are written once. A row's place is the one in its range, less where its group begins
    there, more what ranges before hold of the group; a group of any size spreads over ranges, and no range is dealt
    again. Rows equal in ``order`` get some order; ranges don't part them. Nulls sort first.
    """
    ranged = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ordered = written(ranged.withColumn("__nf_m", F.monotonically_increasing_id()))  # the range, and 33 bits of the place in it
    part, nth = F.shiftright("__nf_m", 33), F.col("__nf_m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = ordered.groupBy(part.alias("__nf_q"), *by).agg(F.count("*").alias("__nf_n"), F.min(nth).alias("__nf_least"))
    earlier = Window.partitionBy(*by).orderBy("__nf_q").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.coalesce(F.sum("__nf_n").over(earlier), F.lit(0)) - F.col("__nf_least")
    starts = sizes.select("__nf_q", *[F.col(c).alias(f"__nf_by{i}") for i, c in enumerate(by)], begins.alias("__nf_start"))
    same: Column = part == F.col("__nf_q")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__nf_by{i}"))
    return ordered.join(starts, same).select(*df.columns, (F.col("__nf_start") + nth + 1).cast("long").alias(name))
