"""What several operators share: cutting lineage, text batches, linked components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.shared import shared_folder

#: Characters of text that a Python worker holds as words at any time.
BATCH_CHARS = 1_000_000
#: Bytes of a batch between the JVM and a Python worker, unless the session sets its own.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4194304")


def use_shared_folder(spark: SparkSession) -> None:
    """Make sure checkpoints have a folder that driver and executors share."""
    shared_folder(spark)


def bound_batches(spark: SparkSession) -> None:
    """Keep batches small whatever the length of texts: their buffers lie outside the JVM's heap and wait for its GC."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def once(value: Column) -> Column:
    """``value`` as a generated column, so that no later expression computes it again."""
    return F.explode(F.array(value))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder, so that lost executors cost no recomputation."""
    use_shared_folder(df.sparkSession)
    bound_batches(df.sparkSession)
    return df.checkpoint(eager=True)


def in_parts(batch: pa.RecordBatch, text: str, most: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``most`` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_text(df: DataFrame, text: str, keep: list[str], fn: Callable[[list[str | None]], dict], schema: str) -> DataFrame:
    """Columns ``keep`` of each row beside what ``fn`` returns for the rows' texts: a list or array for each new column.

    ``schema`` describes the new columns, whose names must not be among ``keep``. Rows stay in their partitions; nothing
    is shuffled.
    """
    clash = set(keep) & set(df.sparkSession.createDataFrame([], schema).columns)
    if clash:
        raise ValueError(f"kept columns {sorted(clash)} have the names of new ones")
    bound_batches(df.sparkSession)
    source = df.select(*[F.col(k) for k in keep], F.col(text).cast("string").alias("__nf_text"))
    fields = df.select(*keep).schema
    for f in df.sparkSession.createDataFrame([], schema).schema:
        fields = fields.add(f)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_parts(batch, "__nf_text"):
                new = fn(part.column("__nf_text").to_pylist())
                cols = [part.column(i) for i in range(len(keep))]
                cols += [pa.array(new[arrow.field(i).name], type=arrow.field(i).type) for i in range(len(keep), len(arrow))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, arrow, strict=True)], schema=arrow)

    return source.mapInArrow(run, fields)


def union_find(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes and links (a[i], b[i]), each node's smallest linked node, by hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        far = ra != rb
        a, b, ra, rb = a[far], b[far], ra[far], rb[far]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps, each an aggregation by node and a join back, until the
    links no longer change. Links are deduplicated and written to the checkpoint folder after each round.
    A hub's links pass through a join that adaptive execution can split; nothing is collected.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
