"""Exact fused top-k from stored lists, one for each feature, read from their best ends until no unread item can matter."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.schema import EXTRACTOR_VERSION, FEATURES, EmptyCorpusError
from nearfield.operators import ann
from nearfield.operators.blocks import BLOCK, SENT_BYTES, asking, blocks, bytes_of, crossed, gathered, joined
from nearfield.operators.retrieval import FUSED_HITS, fused, fused_of, ranked
from nearfield.operators.shared import exists, written

#: Items of a cell, rings of a cell at most, and items of a ring (more if a cell has more than so many rings).
CELL, RINGS, RING = 64, 16, 64
#: Items of each list that are read first, how many times as many next, and the share of a list after which one list does the rest.
DEPTH, TIMES, SHARE = 256, 4, 0.125
#: Rows that queries are dealt to rings in at most, after the first round, as a multiple of all items.
DEALT = 6
#: Angles come from rounded products, and scores from rounded sums: bounds are wider by this much.
ANGLE_SLACK, SLACK = 1e-6, 1e-9
#: Queries whose bounds are worked out at a time.
ASKED = 64

VECTORS = ", ".join(f"{f} array<double>" for f in FEATURES)


@dataclass(frozen=True)
class Lists:
    """Lists of one version of the features, made once by ``build`` and read by ``search``.

    A feature's list is its items in rings: cells round centres, and in each cell up to ``RINGS`` ranges of the angle to the
    centre. A query's order of the rings is that of the highest product that an item in them can have with it, so the list
    is sorted for every query without being stored for any. Items lie in blocks with all their vectors, as looking up the
    other features of a few items would read a whole columnar table: six times the space buys that.

    ``path``/version=v/blocks has the blocks by feature and cell, rings what is known of each ring, centres the centres; these,
    written last, tell finished lists. Rings and centres are bounded in number and bytes and go to every task.
    """

    spark: SparkSession
    path: str
    version: str = EXTRACTOR_VERSION

    def _at(self, name: str) -> str:
        return f"{self.path}/version={self.version}/{name}"

    def build(self, corpus: DataFrame, id_col: str = "id") -> Lists:
        """Lists of all rows of ``corpus``: whole-number ids and an array for each feature, of length 1 or (zero vectors) less.

        A null vector, or vectors of one feature with different widths, are errors, and so are an empty corpus and a version
        that is there. A row that comes twice is listed twice and found once.
        """
        if exists(self.spark, self._at("centres")):
            raise ValueError(f"{self.path} has lists of version {self.version}")
        n = corpus.count()
        if not n:
            raise EmptyCorpusError("the corpus is empty")
        rows = corpus.select(F.col(id_col).cast("long").alias("id"), *[F.col(f).cast("array<double>").alias(f) for f in FEATURES])
        centres = {f: ann.fit(rows, f, n, "id", CELL) for f in FEATURES}
        made = [self._listed(rows, f, centres[f]) for f in FEATURES]
        reduce(DataFrame.unionByName, [m[0] for m in made]).write.mode("overwrite").partitionBy("feature", "cell").parquet(self._at("blocks"))
        reduce(DataFrame.unionByName, [m[1] for m in made]).coalesce(1).write.mode("overwrite").parquet(self._at("rings"))
        known = [(f, i, c.tolist()) for f in FEATURES for i, c in enumerate(centres[f])]
        self.spark.createDataFrame(known, "feature string, cell long, centre array<double>").coalesce(1).write.mode("overwrite").parquet(self._at("centres"))
        return self

    def _listed(self, rows: DataFrame, feature: str, centres: np.ndarray) -> tuple[DataFrame, DataFrame]:
        """The blocks of a feature's list, and its rings."""
        placed = _placed(rows, feature, centres)
        marks = written(placed.select("cell", "angle", "length"))
        parts = [i / RINGS for i in range(1, RINGS)]
        cells = written(marks.groupBy("cell").agg(F.count("*").alias("n"), F.percentile_approx("angle", parts, 1000).alias("edges")))
        cells = cells.select("cell", "edges", F.least(F.lit(RINGS), F.ceil(F.col("n") / RING)).cast("long").alias("most"), F.greatest(F.lit(1), F.ceil(F.col("n") / (4 * BLOCK))).cast("long").alias("slices"))

        def ringed(df: DataFrame) -> DataFrame:
            nth = F.size(F.filter("edges", lambda e: e < F.col("angle")))
            return df.join(F.broadcast(cells), "cell").withColumn("at", F.col("cell") * RINGS + F.floor(nth * F.col("most") / RINGS))  # of CENTRES cells

        rings = ringed(marks).groupBy("at").agg(F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
        dealt = ringed(placed).repartition("cell", F.pmod(F.xxhash64("id"), F.col("slices"))).sortWithinPartitions("at", "id")
        packed = blocks(dealt, "id", FEATURES, by=F.col("at")).drop("labels").withColumnRenamed("by", "at")
        name = F.lit(feature).alias("feature")
        return packed.select(name, F.floor(F.col("at") / RINGS).alias("cell"), "*"), rings.select(name, "*")

    def search(self, queries: DataFrame, weights: dict[str, float], k: int, exclude_self: bool = False, id_col: str = "id") -> DataFrame:
        """query_id, id, the six sub-scores, score and looked: each query's ``k`` best items by fused score, lower ids first
        among equal ones; looked is how many items it was held against, those of several lists more than once.

        Round by round every open query reads on in each list of a weight above 0. An item that none of its lists has shown
        yet scores at most the sum of what their next rings can give: once the k-th score is higher, or a list is at
        its end, the query is closed. Queries that are still open when ``SHARE`` of the lists is read take what rest of the
        heaviest list can matter, as every item stands in it: no query is held against more than 1 + 6 * SHARE times all items, up to whole rings.

        A query's vectors are dealt to each ring that it asks for. Where a round after the first, or that rest, would deal more rows than
        ``DEALT`` times all items, the open queries go to the blocks of the heaviest list instead, and meet all of it.
        """
        used = [f for f in FEATURES if weights.get(f, 0.0) > 0]
        heads, total = self._heads(used)
        asks = written(queries.select(F.col(id_col).cast("long").alias("id"), *[F.col(f).cast("array<double>").alias(f) for f in FEATURES]).dropDuplicates(["id"]))
        size = bytes_of(asks, FEATURES)
        empty = self.spark.createDataFrame([], f"{FUSED_HITS}, score double")
        tops, looked = empty, self.spark.createDataFrame([], "query_id long, looked long")
        active, before, depth = asks.withColumn("kth", F.lit(None).cast("double")), 0, DEPTH
        while not active.isEmpty():
            last = depth > SHARE * total and depth > DEPTH
            if before:
                rings = {f: len(heads[f]["at"]) / total for f in used}
                last = last or active.count() * (depth - before) * sum(rings.values()) > DEALT * total
                main = max(used, key=lambda f: weights[f])
                if last and _asked(active, heads, weights, before, before, last, False).agg(F.sum("looked")).first()[0] * rings[main] > DEALT * total:
                    every = joined(self._stored().filter(F.col("feature") == main))
                    found = gathered(crossed(active.drop("kth"), every, "id", FEATURES), *fused_of(weights, k, exclude_self), FUSED_HITS).withColumn("score", fused(weights))
                    tops = written(ranked(tops.unionByName(found).dropDuplicates(["query_id", "id"]), ["query_id"], "score", k).drop("rank"))
                    rest = active.select(F.col("id").alias("query_id"), F.lit(total).cast("long").alias("looked"))
                    looked = looked.unionByName(rest).groupBy("query_id").agg(F.sum("looked").alias("looked"))
                    break
            asked = written(_asked(active, heads, weights, before, before if last else depth, last))
            found = gathered(self._met(asked, active, used, size), *fused_of(weights, k, exclude_self), FUSED_HITS).withColumn("score", fused(weights))
            tops = written(ranked(tops.unionByName(found).dropDuplicates(["query_id", "id"]), ["query_id"], "score", k).drop("rank"))
            marks = asked.filter("feature IS NULL")
            looked = written(looked.unionByName(marks.select("query_id", "looked")).groupBy("query_id").agg(F.sum("looked").alias("looked")))
            kth = tops.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
            left = marks.filter("bound IS NOT NULL").join(kth, "query_id", "left").filter(F.col("kth").isNull() | (F.col("kth") <= F.col("bound") + SLACK))
            active = written(asks.join(left.select(F.col("query_id").alias("id"), "kth"), "id"))
            before, depth = depth, depth * TIMES
        return tops.join(looked, "query_id")

    def _heads(self, used: list[str]) -> tuple[dict[str, dict[str, np.ndarray]], int]:
        """By feature centres and rings as arrays, and the number of items: at most CENTRES cells of RINGS rings."""
        cells = self.spark.read.parquet(self._at("centres")).filter(F.col("feature").isin(used)).orderBy("feature", "cell").collect()
        rings = self.spark.read.parquet(self._at("rings")).filter(F.col("feature").isin(used)).orderBy("feature", "at").toPandas()
        out = {}
        for f in used:
            mine = rings[rings["feature"] == f]
            out[f] = {"centres": np.array([r["centre"] for r in cells if r["feature"] == f])} | {c: mine[c].to_numpy() for c in ("at", "n", "low", "high", "shortest", "longest")}
        return out, int(out[used[0]]["n"].sum())

    def _stored(self) -> DataFrame:
        return self.spark.read.schema("widths array<int>, ids binary, vectors binary, at long, feature string, cell long").parquet(self._at("blocks"))

    def _met(self, asked: DataFrame, active: DataFrame, used: list[str], size: int) -> DataFrame:
        """Blocks of queries (q_ columns) with the blocks of the rings that they ask for; other cells' files are not read."""
        cells = asked.filter("feature IS NOT NULL").groupBy("feature", F.floor(F.col("at") / RINGS).alias("cell")).agg(F.count("*").alias("n")).collect()  # of CENTRES a feature
        stored = self._stored()
        met = []
        for f in used:
            mine = {r["cell"]: r["n"] for r in cells if r["feature"] == f}
            rows = asked.filter(F.col("feature") == f).join(active.withColumnRenamed("id", "query_id"), "query_id")
            q = asking(blocks(rows.repartition("at", F.pmod(F.xxhash64("query_id"), F.lit(16))).sortWithinPartitions("at"), "query_id", FEATURES, by=F.col("at")))
            few = sum(mine.values()) * size <= SENT_BYTES
            part = stored.filter((F.col("feature") == f) & F.col("cell").isin(list(mine)))
            met.append((F.broadcast(q) if few else q).join(part, F.col("q_by") == F.col("at")).select("q_ids", "q_vectors", "ids", "vectors", "widths"))
        return reduce(DataFrame.unionByName, met)


def _placed(rows: DataFrame, feature: str, centres: np.ndarray) -> DataFrame:
    """``rows`` with cell, angle and length: the nearest centre, the angle to it, and the vector's length."""
    kept = rows.sparkSession.sparkContext.broadcast(centres)  # CENTRE_BYTES at most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                if part.column(feature).null_count:
                    raise ValueError(f"{feature}: vectors are missing or differ in width")
                v = part.column(feature).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                angles, length = _angles(v, kept.value)
                cell = angles.argmin(1)
                extra = [pa.array(cell, pa.int64()), pa.array(angles[np.arange(len(v)), cell]), pa.array(length)]
                yield pa.RecordBatch.from_arrays([*part.columns, *extra], [*part.schema.names, "cell", "angle", "length"])

    return rows.mapInArrow(run, f"id long, {VECTORS}, cell long, angle double, length double")


def _angles(v: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The angle of each vector to each centre (a quarter turn for zeros), and the vectors' lengths."""
    length = np.linalg.norm(v, axis=1)
    sizes = np.outer(length, np.linalg.norm(centres, axis=1))
    cos = np.divide(v @ centres.T, sizes, out=np.zeros_like(sizes), where=sizes > 1e-12)
    return np.arccos(np.clip(cos, -1, 1)), length


def highest(q: np.ndarray, head: dict[str, np.ndarray]) -> np.ndarray:
    """For each query and ring no product of the query with an item of the ring is higher.

    Two directions at angles a and b to a third are at least |a - b| apart. Zeros have no direction, but then the
    shortest length is 0, and 0 is among the values.
    """
    angles, length = _angles(q, head["centres"])
    a = angles[:, head["at"] // RINGS]
    gap = np.maximum(0, np.maximum(a - head["high"], head["low"] - a) - ANGLE_SLACK)
    gap[length <= 1e-12] = 0
    cos = np.cos(gap)
    return length[:, None] * np.maximum(cos * head["longest"], cos * head["shortest"])


def _asked(active: DataFrame, heads: dict[str, dict[str, np.ndarray]], weights: dict[str, float], before: int, depth: int, last: bool, rings: bool = True) -> DataFrame:
    """query_id, feature, at: the rings from ``before`` items of each list to ``depth``; and a row without feature for each
    query, with the bound of what it has not read then (null: it has read all) and looked, the items of its rings.

    With ``last`` the rings of the heaviest list beyond ``before`` in which an item may come up to kth. Without ``rings`` only the
    rows without feature.
    """
    kept, main = active.sparkSession.sparkContext.broadcast(heads), max(heads, key=lambda f: weights[f])
    layout = pa.schema([("query_id", pa.int64()), ("feature", pa.string()), ("at", pa.int64()), ("bound", pa.float64()), ("looked", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ASKED):
                part = batch.slice(start, ASKED)
                ids, kth = part.column("id").to_numpy(), part.column("kth").to_pylist()
                at: list[list] = [[] for _ in ids]  # (feature, rings)
                bound, looked, ended, rest = np.zeros(len(ids)), np.zeros(len(ids), int), np.zeros(len(ids), bool), {}
                for f, head in kept.value.items():
                    v = part.column(f).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                    top = highest(v, head)
                    order = np.argsort(-top, axis=1, kind="stable")
                    held = np.cumsum(head["n"][order], axis=1)
                    for i in range(len(ids)):
                        old, new = (min(len(held[i]), int(np.searchsorted(held[i], d)) + 1) if d else 0 for d in (before, depth))
                        next_ = top[i, order[i, new]] if new < len(held[i]) else None
                        ended[i] |= next_ is None
                        bound[i] += weights[f] * (next_ or 0.0)
                        if last and f == main:
                            rest[i] = (order[i, old:], top[i, order[i, old:]], next_ or 0.0)
                        elif not last:
                            at[i].append((f, head["at"][order[i, old:new]]))
                            looked[i] += head["n"][order[i, old:new]].sum()
                for i, (unread, top, next_) in rest.items():
                    others = bound[i] - weights[main] * next_
                    good = unread if kth[i] is None else unread[weights[main] * top + others + SLACK >= kth[i]]
                    at[i].append((main, kept.value[main]["at"][good]))
                    looked[i] += kept.value[main]["n"][good].sum()
                rows = [{"query_id": int(q), "bound": None if last or ended[i] else float(bound[i]), "looked": int(looked[i])} for i, q in enumerate(ids)]
                rows += [{"query_id": int(q), "feature": f, "at": int(x)} for i, q in enumerate(ids) if rings for f, mine in at[i] for x in mine]
                yield pa.RecordBatch.from_pylist(rows, schema=layout)

    return active.select("id", "kth", *heads).mapInArrow(run, "query_id long, feature string, at long, bound double, looked long")
