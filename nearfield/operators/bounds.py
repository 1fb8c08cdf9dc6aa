"""Best results of all items against all, exactly, by bounds: blocks of near items, and only pairs of them that may matter."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.schema import FEATURES
from nearfield.operators import ann, blocks
from nearfield.operators.shared import row_numbers, written

#: Blocks up to which all pairs are met, as bounds cost more than they save; full blocks that a tile holds, and that a task meets in
#: turn at least: every block goes to each tile, and every tile to each turn, so few and large ones keep what is dealt small. Turns are
#: up to ``LONGER`` times as long while there are ``TURNS`` for each core.
FEW, TILE, MET, LONGER, TURNS = 16, 64, 64, 8, 4
#: Heads of blocks that are compared at a time; blocks that each block meets before bounds are known.
HEADS, FIRST = 256, 4
#: Labels by which cells are made larger at most, so that blocks of one label are full.
LABELS = 64
#: Bounds may fall below the scores that they bound by this much, as both are rounded.
SLACK = 1e-9

Weights = dict[str, float]


def near_blocks(features: DataFrame, id_col: str, label: str, weights: Weights, by_label: bool = False) -> tuple[DataFrame, bool]:
    """Blocks (ids, labels, widths, vectors) of near items with block, tile, and by feature their centre, its norm and their radius; whether they are few.

    Items lie in the order of cells round centres that are fitted to the weighted features together; a block is of one cell
    (and, if ``by_label``, of one label). Tables of up to ``FEW`` blocks are cut as they come. Blocks are written once.
    """
    times = lambda f, w: F.transform(F.col(f).cast("array<double>"), lambda x: x * F.lit(w))
    n, scaled = features.count(), F.concat(*[times(f, float(np.sqrt(weights.get(f, 0.0)))) for f in FEATURES])
    mark = F.xxhash64(F.col(label).cast("string")) if by_label else F.lit(0).cast("long")
    few = n <= FEW * min(blocks.BLOCK, blocks.BLOCK_BYTES // max(1, blocks.bytes_of(features, FEATURES)))
    if not few:
        rows = features.select(F.col(id_col).alias("id"), scaled.alias("v"))
        labels = min(LABELS, features.select(mark.alias("m")).distinct().count()) if by_label else 1  # a cell is cut by labels
        cells = ann.celled(rows, "v", ann.fit(rows, "v", n, cell=blocks.BLOCK * labels), "id", 1).select(F.col("id").alias("__nf_id"), "cell")
        features = features.join(cells, F.col(id_col) == F.col("__nf_id")).withColumn("__nf_by", F.when(F.lit(by_label), F.xxhash64(mark, F.col("cell"))).otherwise(F.col("cell")))
        parts = max(features.sparkSession.sparkContext.defaultParallelism, -(-n // (TILE * blocks.BLOCK)))
        dealt = features.repartitionByRange(parts, "__nf_by", id_col).sortWithinPartitions("__nf_by", id_col)
    else:
        dealt = features.withColumn("__nf_by", mark).repartition(max(1, FEW), F.col(id_col)).sortWithinPartitions("__nf_by", id_col)
    packed = blocks.blocks(dealt, id_col, FEATURES, F.col(label), by=F.col("__nf_by"))
    layout = "ids binary, labels array<string>, widths array<int>, vectors binary, centre binary, norms array<double>, radii array<double>, tile long"
    lists = {"labels": pa.string(), "widths": pa.int32(), "norms": pa.float64(), "radii": pa.float64()}
    kinds = pa.schema([(c, pa.list_(lists[c]) if c in lists else pa.binary()) for c in ("ids", "labels", "widths", "vectors", "centre", "norms", "radii")] + [("tile", pa.int64())])
    room = TILE * blocks.BLOCK

    def summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = held = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, v = blocks.unpacked(row)
                mean, at = v.mean(0), np.concatenate(([0], np.cumsum(row["widths"])))
                parts = [slice(a, b) for a, b in zip(at, at[1:])]
                norms = [float(np.linalg.norm(mean[s])) for s in parts]
                radii = [float(np.linalg.norm(v[:, s] - mean[s], axis=1).max()) for s in parts]
                if held and held + len(v) > room:
                    tile, held = tile + 1, 0
                held += len(v)
                one = {c: row[c] for c in ("ids", "labels", "widths", "vectors")} | {"tile": tile, "centre": mean.tobytes(), "norms": norms, "radii": radii}
                yield pa.RecordBatch.from_pylist([one], schema=kinds)

    numbered = packed.mapInArrow(summed, layout).withColumn("block", F.monotonically_increasing_id())
    return written(numbered.withColumn("tile", F.shiftleft(F.shiftright("block", 33), 33) + F.col("tile"))), few


def upper(a: dict, b: dict, weights: Weights) -> np.ndarray:
    """For heads a and b (centres, norms, radii) no score of an item of one block with an item of the other is higher.

    An item is its block's centre and a rest no longer than the radius, so a product of two is at most that of the centres
    and, of the others, that of the lengths; it is no more than 1 for unit vectors either.
    """
    out, at = np.zeros((len(a["norms"]), len(b["norms"]))), 0
    for k, f in enumerate(FEATURES):
        w, to = weights.get(f, 0.0), at + a["widths"][k]
        if w:
            one = a["centre"][:, at:to] @ b["centre"][:, at:to].T
            one += np.outer(a["norms"][:, k], b["radii"][:, k]) + np.outer(a["radii"][:, k], b["norms"][:, k] + b["radii"][:, k])
            out += w * np.minimum(one, a["longest"][:, k][:, None] * b["longest"][:, k][None, :])
        at = to
    return out + SLACK


def head_pairs(packed: DataFrame, fn: Callable[[dict, dict], dict], schema: str, extra: dict[str, Column] | None = None) -> DataFrame:
    """What ``fn`` makes of the heads of each pair of groups of blocks (dicts of arrays: block, centre, norms, radii and ``extra``)."""
    extra = extra or {}
    more = list(extra)
    heads = packed.select("block", "widths", "centre", "norms", "radii", *[c.alias(k) for k, c in extra.items()])
    heads = row_numbers(heads.select("block", "widths", "centre", "norms", "radii", *extra), [], ["block"], "nth").withColumn("g", F.floor((F.col("nth") - 1) / HEADS))
    groups = written(heads.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("nth", "block", "widths", "centre", "norms", "radii", *extra))).alias("h")))
    last = groups.agg(F.max("g")).first()[0]
    if last is None:
        return packed.sparkSession.createDataFrame([], schema)
    asked = groups.select(F.col("h").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("g"))
    both = asked.join(groups.select("g", F.col("h").alias("b")), "g")
    from pyspark.sql.pandas.types import to_arrow_schema

    layout = to_arrow_schema(packed.sparkSession.createDataFrame([], schema).schema)

    def unpack(rows: list[dict]) -> dict:
        out = {"block": np.array([r["block"] for r in rows]), "widths": rows[0]["widths"], "centre": np.array([np.frombuffer(r["centre"]) for r in rows])}
        out |= {c: np.array([r[c] for r in rows], float) for c in ("norms", "radii")}
        return out | {"longest": out["norms"] + out["radii"]} | {k: np.array([r[k] for r in rows]) for k in more}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                got = fn(unpack(row["a"]), unpack(row["b"]))
                yield pa.RecordBatch.from_pydict(got, schema=layout)

    return both.select("a", "b").mapInArrow(run, schema)


def meet(packed: DataFrame, pairs: DataFrame, fn: Callable[[dict, dict], None], done: Callable[[dict], pa.RecordBatch | None], schema: str, begun: DataFrame | None = None) -> DataFrame:
    """Meets blocks as ``pairs`` (asking, met) say: ``fn`` is called with the asking block and the met one, ``done`` with the asking
    one in the end; what a block has gathered lies in the dict of it, with what ``begun`` (block, one binary column) has for it.

    A met block is sent once to each tile (consecutive blocks, which a task holds) that has a block that asks for it.
    """
    asks = pairs.join(packed.select(F.col("block").alias("asking"), "tile"), "asking").groupBy("tile", F.col("met").alias("block")).agg(F.collect_set("asking").alias("by"))
    asks = written(asks.join(packed.select("block", F.size("labels").alias("n")), "block"))
    turns = TURNS * packed.sparkSession.sparkContext.defaultParallelism
    length = min(max(MET * blocks.BLOCK, -(-(asks.agg(F.sum("n")).first()[0] or 0) // turns)), LONGER * MET * blocks.BLOCK)
    before = F.sum("n").over(Window.partitionBy("tile").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    asks = asks.withColumn("share", F.floor(F.coalesce(before, F.lit(0)) / length).cast("int"))
    # Each turn of a tile is a task of its own, those with the most pairs first.
    work = asks.groupBy("tile", "share").agg((-F.sum(F.col("n") * F.size("by"))).alias("less"))
    tasks = row_numbers(work, [], ["less", "tile", "share"], "task").drop("less")
    count = max(1, tasks.count())
    asks = asks.join(tasks, ["tile", "share"]).select("task", "block", "by")
    payload = packed.select("block", "ids", "labels", "widths", "vectors")
    own = asks.groupBy("task").agg(F.flatten(F.collect_set("by")).alias("by")).select("task", F.explode(F.array_distinct("by")).alias("block"))
    own, more = (own, []) if begun is None else (own.join(begun, "block", "left"), [c for c in begun.columns if c != "block"])
    rows = asks.select("task", F.lit(False).alias("own"), "block", "by", *[F.lit(None).cast("binary").alias(c) for c in more])
    rows = rows.unionByName(own.select("task", F.lit(True).alias("own"), "block", F.array().cast("array<long>").alias("by"), *more))
    sent = rows.join(payload, "block").repartitionById(count, (F.col("task") - 1).cast("int")).sortWithinPartitions("task", F.desc("own"), "block")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, dict] = {}
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if row["task"] != now:
                    yield from filter(None, map(done, held.values()))
                    now, held = row["task"], {}
                row["ids"], row["vectors"] = blocks.unpacked(row)
                if row["own"]:
                    held[row["block"]] = row
                else:
                    for b in row["by"]:
                        fn(held[b], row)
        yield from filter(None, map(done, held.values()))

    return sent.mapInArrow(run, schema)


def meet_all(packed: DataFrame, fn: Callable[[dict, dict], None], done: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """The same for all pairs of few blocks, which are sent to every task: some 64 MB at most."""
    payload = packed.select("block", "ids", "labels", "widths", "vectors")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if own is None or row["q_block"] != own["block"]:
                    yield from filter(None, map(done, [own] if own else []))
                    own = {c.removeprefix("q_"): v for c, v in row.items() if c.startswith("q_")}
                    own["ids"], own["vectors"] = blocks.unpacked(own)
                row["ids"], row["vectors"] = blocks.unpacked(row)
                fn(own, row)
        yield from filter(None, map(done, [own] if own else []))

    return blocks.asking(payload).crossJoin(F.broadcast(payload)).mapInArrow(run, schema)  # of FEW blocks


def first_pairs(packed: DataFrame, weights: Weights) -> DataFrame:
    """asking, met: each block with itself and the ``FIRST`` blocks of the highest bounds."""

    def fn(a: dict, b: dict) -> dict:
        top = upper(a, b, weights)
        top[a["block"][:, None] == b["block"][None, :]] = np.inf
        k = min(FIRST + 1, top.shape[1])
        j = np.argpartition(-top, k - 1, axis=1)[:, :k]
        return {"asking": np.repeat(a["block"], k), "met": b["block"][j.ravel()], "top": np.take_along_axis(top, j, 1).ravel()}

    found = head_pairs(packed, fn, "asking long, met long, top double")
    nth = F.row_number().over(Window.partitionBy("asking").orderBy(F.desc("top"), "met"))
    return found.withColumn("nth", nth).filter(F.col("nth") <= FIRST + 1).select("asking", "met")


def further_pairs(packed: DataFrame, met: DataFrame, least: DataFrame, variants: dict[str, Weights]) -> DataFrame:
    """asking, met of the pairs beyond ``met`` whose bound reaches ``least`` (asking, one column for each variant) of the asking block."""
    names = [f"least_{k}" for k in range(len(variants))]
    told = packed.join(least.withColumnRenamed("asking", "block"), "block", "left")

    def fn(a: dict, b: dict) -> dict:
        some = np.zeros((len(a["block"]), len(b["block"])), bool)
        for k, w in enumerate(variants.values()):
            some |= upper(a, b, w) >= a[names[k]][:, None]
        i, j = np.nonzero(some)
        return {"asking": a["block"][i], "met": b["block"][j]}

    extra = {n: F.coalesce(F.col(n), F.lit(float("-inf"))) for n in names}
    return head_pairs(told, fn, "asking long, met long", extra).join(met, ["asking", "met"], "left_anti")
