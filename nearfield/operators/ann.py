"""Approximate candidates from a stored index: cells round centres, and in each cell small-world graphs that are walked."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.schema import CANDIDATE_K, EXTRACTOR_VERSION, FEATURES, EmptyCorpusError
from nearfield.operators.blocks import SENT_BYTES, asking, blocks, dots, each_pair
from nearfield.operators.retrieval import HITS, hits_batch, merged, rows_of
from nearfield.operators.shared import exists, written

# Links of a node, and nodes that are looked at to choose them.
LINKS, EF_CONSTRUCTION = 16, 64
#: Nodes that a walk keeps, how many of them it leaves at a time, and cells that a query looks into.
EF_SEARCH, STEP, PROBES = 64, 4, 16
#: Rows and bytes of vectors in a graph at most, nodes that walks begin at, and the part of a graph that new parts fill.
PART, PART_BYTES, ENTRIES, FILLED = 4096, 16 << 20, 16, 0.9
#: Rows and bytes that centres are fitted on at most, centres and their bytes at most, rounds of fitting.
SAMPLE, SAMPLE_BYTES, CENTRES, CENTRE_BYTES, ROUNDS = 20_000, 64 << 20, 4_096, 32 << 20, 8


# --- graphs --------------------------------------------------------------------------------------------------


def linked(vectors: np.ndarray, links: int = LINKS, ef: int = EF_CONSTRUCTION) -> tuple[np.ndarray, np.ndarray]:
    """A graph over unit vectors: each node's links (-1 fills up) and the nodes that walks begin at.

    Of a node's ``ef`` nearest those stay, nearest first, that are nearer to it than to any that stays before, ``links`` at
    most; with what is left over the nearest others fill up. Links go both ways as long as the other node has room for
    twice as many. What can't be reached from the entries is linked to the nearest node that can.
    """
    n = len(vectors)
    sims = vectors.astype(np.float32) @ vectors.astype(np.float32).T  # PART squared; these only choose links
    np.fill_diagonal(sims, -np.inf)
    rows, few = np.arange(n), min(ef, n - 1)
    near = np.argpartition(-sims, few, axis=1)[:, :few] if few else np.zeros((n, 0), int)
    near = np.take_along_axis(near, np.argsort(-sims[rows[:, None], near], axis=1, kind="stable"), 1)
    kept, size = np.full((n, links), -1), np.zeros(n, int)
    for fill in (False, True):
        for c in near.T:
            to = np.where(kept >= 0, sims[c[:, None], kept], -np.inf)
            good = (size < links) & ~(kept == c[:, None]).any(1) & (fill | (to.max(1, initial=-np.inf) < sims[rows, c]))
            kept[rows[good], size[good]] = c[good]
            size += good
    i, slot = np.nonzero(kept >= 0)
    own = np.column_stack([i, kept[i, slot]])
    back = own[:, ::-1]
    back = back[~(kept[back[:, 0]] == back[:, 1:]).any(1)]
    order = np.lexsort((-sims[back[:, 0], back[:, 1]], back[:, 0]))
    back = back[order]
    place = np.arange(len(back)) - np.searchsorted(back[:, 0], back[:, 0])
    edges = np.vstack([own, back[place < 2 * links - size[back[:, 0]]]])
    entries, nearest = [int((vectors @ vectors.mean(0)).argmax())], np.full(n, -np.inf)
    while len(entries) < min(ENTRIES, n):  # the middle, then again and again what lies farthest from those there are
        nearest = np.maximum(nearest, np.where(rows == entries[-1], np.inf, sims[entries[-1]]))
        entries.append(int(nearest.argmin()))
    entries = np.unique(entries)
    far = np.column_stack([rows, np.random.default_rng(7).permutation(n)])  # a link to anywhere, so that walks leave dense groups
    far = far[(far[:, 0] != far[:, 1]) & (sims[far[:, 0], far[:, 1]] < sims[rows[:, None], near].min(1, initial=np.inf)[far[:, 0]])]
    edges = np.unique(np.vstack([edges, far]), axis=0)
    reached = np.zeros(n, bool)
    front = entries
    while True:
        while len(front):
            reached[front] = True
            to = edges[np.isin(edges[:, 0], front), 1]
            front = np.unique(to[~reached[to]])
        if reached.all():
            break
        lost, known = np.flatnonzero(~reached)[0], np.flatnonzero(reached)
        edges = np.vstack([edges, [known[sims[lost, known].argmax()], lost]])
        front = np.array([lost])
    edges = edges[np.argsort(edges[:, 0], kind="stable")]
    place = np.arange(len(edges)) - np.searchsorted(edges[:, 0], edges[:, 0])
    out = np.full((n, int(place.max(initial=0)) + 1), -1, np.int32)
    out[edges[:, 0], place] = edges[:, 1]
    return out, entries.astype(np.int32)


def walk(queries: np.ndarray, vectors: np.ndarray, links: np.ndarray, entries: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` best nodes (-1: none) that each query's best-first walk finds, and which nodes it looked at.

    All queries walk side by side: each leaves the best few nodes of its beam that it has not left yet and looks at
    their neighbours, until every node in its beam has been left.
    """
    n, m = len(queries), len(vectors)
    ef = min(ef, m)
    seen, left = np.zeros((n, m), bool), np.zeros((n, m), bool)
    beam, score = np.full((n, ef), -1), np.full((n, ef), -np.inf)

    def meet(rows: np.ndarray, nodes: np.ndarray) -> None:
        """Puts nodes (sorted by query) into the beams of their queries."""
        seen[rows, nodes] = True
        who, first, count = np.unique(rows, return_index=True, return_counts=True)
        place = np.arange(len(rows)) - np.repeat(first, count)
        new, value = np.full((len(who), count.max()), -1), np.full((len(who), count.max()), -np.inf)
        at = np.repeat(np.arange(len(who)), count)
        new[at, place], value[at, place] = nodes, dots(queries[rows], vectors[nodes])
        new, value = np.hstack([beam[who], new]), np.hstack([score[who], value])
        best = np.argpartition(-value, ef - 1, axis=1)[:, :ef] if value.shape[1] > ef else np.broadcast_to(np.arange(value.shape[1]), value.shape)
        beam[who], score[who] = np.take_along_axis(new, best, 1), np.take_along_axis(value, best, 1)

    meet(np.repeat(np.arange(n), len(entries)), np.tile(entries, n))
    live = np.arange(n)
    while len(live):
        some = beam[live]
        open_ = np.where((some >= 0) & ~left[live[:, None], some], score[live], -np.inf)
        best = np.argpartition(-open_, min(STEP, ef) - 1, axis=1)[:, :STEP]
        good = np.take_along_axis(open_, best, 1) > -np.inf
        q, at = np.nonzero(good)
        live, q, nodes = live[good.any(1)], live[q], some[q, best[q, at]]
        left[q, nodes] = True
        q, to = np.repeat(q, links.shape[1]), links[nodes].ravel()
        fresh = to >= 0
        fresh[fresh] = ~seen[q[fresh], to[fresh]]
        key = np.unique(q[fresh] * m + to[fresh])
        if len(key):
            meet(key // m, key % m)
    return beam, seen


# --- the index -----------------------------------------------------------------------------------------------


def centres_of(sample: np.ndarray, n: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """``n`` unit centres of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(rounds if len(centres) > 1 else 0):
        own = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
    return centres


def fit(corpus: DataFrame, feature: str, n: int, id_col: str = "id", cell: int | None = None) -> np.ndarray:
    """Centres for ``n`` rows, one for about ``cell`` of them. They are fitted on a sample chosen by a hash of the id, of at most
    about ``SAMPLE`` rows and ``SAMPLE_BYTES``; sample and centres are bounded in bytes, every row is indexed afterwards."""
    first = corpus.select(F.size(feature).alias("d")).first()
    width = max(1, first["d"]) if first else 1
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width)))
    many = int(max(1, min(CENTRES, CENTRE_BYTES // (8 * width), round(n / (cell or PART)), most)))
    part = F.pmod(F.xxhash64(F.lit(feature), F.col(id_col)), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, most / max(1, n))) + 1)
    rows = corpus.filter(part).select(F.col(feature).cast("array<double>").alias("v")).limit(most).toArrow()
    sample = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((1, width))
    return centres_of(sample, many)


def celled(df: DataFrame, feature: str, centres: np.ndarray, id_col: str, probes: int) -> DataFrame:
    """id, v, cell: each row in the ``probes`` cells whose centres are nearest."""
    kept = df.sparkSession.sparkContext.broadcast(centres)  # CENTRE_BYTES at most
    names = ["id", "v", "cell"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                m = min(probes, len(kept.value))
                near = np.argsort(-(v @ kept.value.T), axis=1, kind="stable")[:, :m]
                rows = part.take(pa.array(np.repeat(np.arange(part.num_rows), m)))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(near.ravel(), pa.int64())], names)

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(feature).cast("array<double>").alias("v")).mapInArrow(run, "id long, v array<double>, cell long")


GRAPH = "n int, ids binary, vectors binary, links binary, entries binary"


def _graphs(rows: DataFrame) -> DataFrame:
    """cell and a graph of at most ``PART`` rows for each slice of a cell (id, v, cell, slice), where they lie in order."""
    layout = pa.schema([("cell", pa.int64()), ("n", pa.int32()), *[(c, pa.binary()) for c in ("ids", "vectors", "links", "entries")]])

    def graph(cell: int, ids: list[int], vectors: list[list[float]]) -> pa.RecordBatch:
        v = np.array(vectors)
        links, entries = linked(v)
        row = {"cell": cell, "n": len(ids), "ids": np.array(ids, np.int64).tobytes(), "vectors": v.tobytes(), "links": links.tobytes(), "entries": entries.tobytes()}
        return pa.RecordBatch.from_pylist([row], schema=layout)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors = None, [], []
        for batch in batches:
            for i, v, cell, part in zip(*(batch.column(c).to_pylist() for c in ("id", "v", "cell", "slice")), strict=True):
                if ids and ((cell, part) != now or len(ids) >= min(PART, max(1, PART_BYTES // (8 * len(v))))):
                    yield graph(now[0], ids, vectors)
                    ids, vectors = [], []
                now = (cell, part)
                ids.append(i)
                vectors.append(v)
        if ids:
            yield graph(now[0], ids, vectors)

    return rows.mapInArrow(run, f"cell long, {GRAPH}")


@dataclass(frozen=True)
class Index:
    """A stored index of one version of the features: ``build`` makes it once, searches read the cells that they look into.

    ``path``/version=v/centres has feature, cell, centre; ``path``/version=v/graph, by feature and cell, one row for each graph of
    at most ``PART`` vectors. A cell that holds more is several graphs, each walked for itself. ``add`` puts new
    rows into the cells as further graphs, without touching those that are there; ``compact`` makes one of the small ones.
    """

    spark: SparkSession
    path: str
    version: str = EXTRACTOR_VERSION
    features: tuple[str, ...] = FEATURES

    def _at(self, name: str) -> str:
        return f"{self.path}/version={self.version}/{name}"

    def build(self, corpus: DataFrame, id_col: str = "id") -> Index:
        """Indexes all rows of ``corpus`` (id, one array of unit length for each feature). A version is built once: an
        index that is there is an error, and its centres, written last, tell a whole one from one that was not finished."""
        if exists(self.spark, self._at("centres")):
            raise ValueError(f"{self.path} has an index of version {self.version}")
        n = corpus.count()
        if not n:
            raise EmptyCorpusError("the corpus is empty")
        centres = {f: fit(corpus, f, n, id_col) for f in self.features}
        self._put(corpus, centres, id_col, "overwrite")
        rows = [(f, i, c.tolist()) for f in self.features for i, c in enumerate(centres[f])]
        self.spark.createDataFrame(rows, "feature string, cell long, centre array<double>").coalesce(1).write.mode("overwrite").parquet(self._at("centres"))
        return self

    def add(self, rows: DataFrame, id_col: str = "id") -> Index:
        """Puts new rows in, as graphs of their own; a row that is there already must not come again."""
        self._put(rows, self.centres(), id_col, "append")
        return self

    def centres(self) -> dict[str, np.ndarray]:
        rows = self.spark.read.parquet(self._at("centres")).orderBy("feature", "cell").collect()  # CENTRE_BYTES a feature at most
        return {f: np.array([r["centre"] for r in rows if r["feature"] == f]) for f in self.features}

    def graphs(self) -> DataFrame:
        """feature, cell and the graphs."""
        return self.spark.read.schema(f"{GRAPH}, feature string, cell long").parquet(self._at("graph"))

    def _put(self, rows: DataFrame, centres: dict[str, np.ndarray], id_col: str, mode: str) -> None:
        made = []
        for f in self.features:
            own = written(celled(rows, f, centres[f], id_col, 1))
            made.append(self._made(own, centres[f].shape[1]).select(F.lit(f).alias("feature"), "*"))
        reduce(DataFrame.unionByName, made).write.mode(mode).partitionBy("feature", "cell").parquet(self._at("graph"))

    def _made(self, own: DataFrame, width: int) -> DataFrame:
        size = FILLED * min(PART, max(1, PART_BYTES // (8 * width)))
        slices = own.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(size))).cast("long").alias("slices"))
        dealt = own.join(F.broadcast(slices), "cell")  # a row for each of CENTRES cells at most
        dealt = dealt.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices"))).repartition("cell", "slice").sortWithinPartitions("cell", "slice", "id")
        return _graphs(dealt.select("id", "v", "cell", "slice"))

    def compact(self, below: int | None = None) -> Index:
        """Puts the graphs of cells together that hold more than one of fewer than ``below`` rows; other cells stay as they are."""
        below = below or int(PART * FILLED / 2)
        graphs = self.graphs()
        small = graphs.groupBy("feature", "cell").agg(F.sum((F.col("n") < below).cast("int")).alias("small")).filter("small > 1").select("feature", "cell").collect()  # of CENTRES a feature
        made = []
        for f in {r["feature"] for r in small}:
            cells = [r["cell"] for r in small if r["feature"] == f]
            own = written(_rows(graphs.filter((F.col("feature") == f) & F.col("cell").isin(cells))))
            made.append(self._made(own, len(own.first()["v"])).select(F.lit(f).alias("feature"), "*"))
        if made:
            every = written(reduce(DataFrame.unionByName, made))
            every.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature", "cell").parquet(self._at("graph"))
        return self

    def met(self, queries: DataFrame, probes: int = PROBES, id_col: str = "id") -> dict[str, DataFrame]:
        """For each feature blocks of queries (q_ columns) with the graphs of the cells that they look into; only these are read."""
        centres = self.centres()
        routed = [celled(queries, f, centres[f], id_col, probes).select(F.lit(f).alias("feature"), "*") for f in self.features]
        asks = written(reduce(DataFrame.unionByName, routed))
        cells = asks.groupBy("feature", "cell").agg(F.count("*").alias("n")).collect()  # of CENTRES a feature
        out = {}
        for f in self.features:
            mine = {r["cell"]: r["n"] for r in cells if r["feature"] == f}
            q = blocks(asks.filter(F.col("feature") == f).repartition("cell").sortWithinPartitions("cell"), "id", ("v",), by=F.col("cell"))
            few = sum(mine.values()) * 8 * centres[f].shape[1] <= SENT_BYTES
            graphs = self.graphs().filter((F.col("feature") == f) & F.col("cell").isin(list(mine)))
            out[f] = (F.broadcast(asking(q)) if few else asking(q)).join(graphs, F.col("q_by") == F.col("cell"))
        return out

    def walked(self, queries: DataFrame, k: int = CANDIDATE_K, exclude_self: bool = False, id_col: str = "id", ef_search: int = EF_SEARCH, probes: int = PROBES) -> DataFrame:
        """HITS and looked: of each graph a query's ``k`` best, and how many vectors its walk there looked at."""
        found = []
        for f, pairs in self.met(queries, probes, id_col).items():
            found.append(each_pair(pairs, _walks(f, k, exclude_self, max(ef_search, k + 1)), f"{HITS}, looked long"))
        return reduce(DataFrame.unionByName, found)

    def nearest(self, queries: DataFrame, k: int = CANDIDATE_K, exclude_self: bool = False, id_col: str = "id", ef_search: int = EF_SEARCH, probes: int = PROBES) -> DataFrame:
        """As ``retrieval.nearest``: query_id, feature, place, id, sim, of the items that walks of ``ef_search`` nodes (k + 1 at least) find."""
        return rows_of(self.walked(queries, k, exclude_self, id_col, ef_search, probes), k, self.features)


def _walks(feature: str, k: int, exclude_self: bool, ef: int):
    def search(row: dict) -> pa.RecordBatch:
        q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
        q, v = np.frombuffer(row["q_vectors"]).reshape(len(q_ids), -1), np.frombuffer(row["vectors"]).reshape(len(ids), -1)
        beam, seen = walk(q, v, np.frombuffer(row["links"], np.int32).reshape(len(ids), -1), np.frombuffer(row["entries"], np.int32), ef)
        i, slot = np.nonzero(beam >= 0)
        j = beam[i, slot]
        if exclude_self:
            i, j = i[q_ids[i] != ids[j]], j[q_ids[i] != ids[j]]
        sim = dots(q[i], v[j])
        order = np.lexsort((ids[j], -sim, i))
        i, j, sim = i[order], j[order], sim[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        i, j, sim = (x[nth < k] for x in (i, j, sim))
        hits = hits_batch(q_ids, [feature] * len(q_ids), np.append(0, np.cumsum(np.bincount(i, minlength=len(q_ids)))), ids[j], sim)
        return hits.append_column("looked", pa.array(seen.sum(1)))

    return search


def _rows(graphs: DataFrame) -> DataFrame:
    """id, v, cell of the rows that graphs hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                ids = np.frombuffer(r["ids"], np.int64)
                v = np.frombuffer(r["vectors"])
                offsets = pa.array(np.arange(len(ids) + 1) * (len(v) // len(ids)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(v)), pa.array(np.full(len(ids), r["cell"]))], ["id", "v", "cell"])

    return graphs.select("ids", "vectors", "cell").mapInArrow(run, "id long, v array<double>, cell long")


def recall_of(found: DataFrame, exact: DataFrame, k: int, feature_names: tuple[str, ...] = FEATURES) -> DataFrame:
    """The same of the ``k`` best hits out of HITS: both sides' hits of a query meet in one task, and only the numbers leave it."""
    sides = tuple(f"{side}.{f}" for f in feature_names for side in ("exact", "found"))
    named = [df.select("query_id", F.concat(F.lit(f"{side}."), F.col("feature")).alias("feature"), "hits", "sims") for side, df in (("exact", exact), ("found", found))]

    def tell(query: np.ndarray, feature: np.ndarray, place: np.ndarray, sim: np.ndarray, id_: np.ndarray) -> pa.RecordBatch:
        rows = []
        for n, f in enumerate(feature_names):
            want, got = (np.rec.fromarrays([query[feature == c], id_[feature == c]]) for c in (2 * n, 2 * n + 1))
            rows.append({"feature": f, "n_exact": len(want), "n_found": int(np.isin(want, got).sum())})
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("feature", pa.string()), ("n_exact", pa.int64()), ("n_found", pa.int64())]))

    parts = merged(named[0].unionByName(named[1]), k, sides, tell, "feature string, n_exact long, n_found long")
    sums = parts.groupBy("feature").agg(F.sum("n_exact").alias("n_exact"), F.sum("n_found").alias("n_found"))
    return sums.filter("n_exact > 0").withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 4))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """feature, n_exact, n_found, recall of (query_id, feature, id) rows."""
    by = ["query_id", "feature", "id"]
    both = exact.select(*by).join(found.select(*by, F.lit(1).alias("hit")), by, "left")
    return both.groupBy("feature").agg(F.count("*").alias("n_exact"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_found")).withColumn("recall", F.round(F.col("n_found") / F.col("n_exact"), 4))
