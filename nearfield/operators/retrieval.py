"""Top-k retrieval: candidates by feature, late fusion, ranking, hydration."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.schema import CANDIDATE_K, FEATURES, MAX_TOP_K, TOP_K, EmptyCorpusError
from nearfield.functions.vectors import dot
from nearfield.functions.weights import as_map, normalise
from nearfield.operators.blocks import Best, dots, gathered, pairs, unpacked

if TYPE_CHECKING:
    from nearfield.operators.ann import Index
    from nearfield.operators.threshold import Lists

#: What a task leaves of a query and feature: ids and similarities of its best hits.
HITS = "query_id long, feature string, hits array<long>, sims array<double>"
NEAREST = "query_id long, feature string, place int, id long, sim double"
#: Hits that wait in a task before they are sorted in, if no more are held already, and queries that are told at a time.
WAITING, TOLD = 1 << 20, 256
FUSED_HITS = "query_id long, id long, " + ", ".join(f"{f} double" for f in FEATURES)


def long_features(features: DataFrame, id_col: str, feature_names: tuple[str, ...] = FEATURES) -> DataFrame:
    """id, feature, vec: a row for each feature of each item."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("vec")) for f in feature_names])
    return features.select(F.col(id_col).alias("id"), F.explode(pairs).alias("p")).select("id", "p.feature", "p.vec")


def nearest_of(k: int, exclude_self: bool, feature_names: tuple[str, ...]) -> tuple[Callable[[dict, dict], None], Callable[[dict], pa.RecordBatch]]:
    """For ``gathered``: the ``k`` nearest items of each query by each feature (unit vectors), as a row of HITS for each query and feature."""

    def meet(held: dict, row: dict) -> None:
        (q_ids, q), (ids, c), at = unpacked(row, "q_"), unpacked(row), np.concatenate(([0], np.cumsum(row["widths"])))
        same = np.nonzero(q_ids[:, None] == ids[None, :]) if exclude_self else None
        for name, lo, hi in zip(feature_names, at, at[1:]):
            a, b = q[:, lo:hi], c[:, lo:hi]
            approx = a @ b.T
            if same is not None:
                approx[same] = -np.inf
            held.setdefault(name, Best(len(q_ids), k)).meet(approx, ids, lambda i, j: (dots(a[i], b[j]), None))  # noqa: B023

    def told(held: dict) -> pa.RecordBatch:
        query, feature, starts, sims, items = [], [], [0], [], []
        for name in feature_names:
            i, nth = held[name].hits()
            who, count = np.unique(i, return_counts=True)
            query.append(held["q_ids"][who])
            feature += [name] * len(who)
            starts.extend(starts[-1] + np.cumsum(count))
            sims.append(held[name].score[i, nth])
            items.append(held[name].id[i, nth])
        return hits_batch(np.concatenate(query), feature, starts, np.concatenate(items), np.concatenate(sims))

    return meet, told


def hits_batch(query: np.ndarray, feature: list[str], starts: Iterable[int], ids: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    """Rows of HITS, of which each has the hits from its start to the next one's."""
    starts = pa.array(starts, pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(query), pa.array(feature, pa.string()), pa.ListArray.from_arrays(starts, pa.array(ids)), pa.ListArray.from_arrays(starts, pa.array(sims))], ["query_id", "feature", "hits", "sims"])


def merged(found: DataFrame, k: int, feature_names: tuple[str, ...], tell: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """What ``tell`` makes of each query's ``k`` best hits by feature, out of what all tasks left of it (HITS).

    Queries are dealt by id, and their best hits so far are kept in arrays: a task holds the hits of its own queries, whatever the
    number of tasks that found some, and Spark neither sorts nor hashes them. ``tell`` gets a few queries at a time: query, number of the
    feature, place from 1, similarity and id of each hit, in order.
    """
    names = pa.array(feature_names, pa.string())

    def best(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        query, feature, _, sim, id_ = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((id_, -sim, feature, query))
        query, feature, sim, id_ = (x[order] for x in (query, feature, sim, id_))
        first = np.flatnonzero(np.append(True, (np.diff(query) != 0) | (np.diff(feature) != 0)))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query)))) + 1
        return tuple(x[place <= k] for x in (query, feature, place, sim, id_))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, n = [], [], 0
        for batch in batches:
            count = pc.list_value_length(batch.column("hits")).to_numpy(zero_copy_only=False)
            ids, sims = (batch.column(c).flatten().to_numpy() for c in ("hits", "sims"))
            if not len(ids):
                continue
            feature = pc.index_in(batch.column("feature"), names).to_numpy()
            waiting.append((np.repeat(batch.column("query_id").to_numpy(), count), np.repeat(feature, count), np.zeros(len(ids), int), sims, ids))
            n += len(ids)
            if n > max(WAITING, sum(len(x[0]) for x in held)):
                held, waiting, n = [best(held + waiting)], [], 0
        if held or waiting:
            hits = best(held + waiting)
            edges = np.append(np.flatnonzero(np.append(True, np.diff(hits[0]) != 0))[::TOLD], len(hits[0]))
            yield from (tell(*(x[lo:hi] for x in hits)) for lo, hi in zip(edges, edges[1:]))

    return found.select("query_id", "feature", "hits", "sims").repartition("query_id").mapInArrow(run, schema)


def rows_of(found: DataFrame, k: int, feature_names: tuple[str, ...] = FEATURES) -> DataFrame:
    """query_id, feature, place, id, sim: the ``k`` best hits out of HITS."""
    names = pa.array(feature_names, pa.string())

    def tell(query: np.ndarray, feature: np.ndarray, place: np.ndarray, sim: np.ndarray, id_: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query), names.take(pa.array(feature)), pa.array(place, pa.int32()), pa.array(id_), pa.array(sim)], ["query_id", "feature", "place", "id", "sim"])

    return merged(found, k, feature_names, tell, NEAREST)


def lists_of(found: DataFrame, k: int, feature_names: tuple[str, ...] = FEATURES, missing: float | None = 0.0) -> DataFrame:
    """query_id, found: a row for each query with the union of each feature's ``k`` best hits out of HITS, by id: structs of id and the
    features, ``missing`` where a feature did not propose the item."""

    def tell(query: np.ndarray, feature: np.ndarray, place: np.ndarray, sim: np.ndarray, id_: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((id_, query))[::-1]  # backwards, so that of an item that comes twice the better one stays
        query, id_ = query[order], id_[order]
        new = np.append(True, (np.diff(query) != 0) | (np.diff(id_) != 0))
        at = np.cumsum(new) - 1
        at = at[-1] - at
        sims, gone = np.full((at[0] + 1, len(feature_names)), missing or 0.0), np.full((at[0] + 1, len(feature_names)), missing is None)
        sims[at, feature[order]], gone[at, feature[order]] = sim[order], False
        query, id_ = query[new][::-1], id_[new][::-1]
        who, first = np.unique(query, return_index=True)
        items = pa.StructArray.from_arrays([pa.array(id_), *[pa.array(np.ascontiguousarray(sims[:, n]), mask=gone[:, n]) for n in range(len(feature_names))]], ["id", *feature_names])
        return pa.RecordBatch.from_arrays([pa.array(who), pa.ListArray.from_arrays(pa.array(np.append(first, len(query)), pa.int32()), items)], ["query_id", "found"])

    return merged(found, k, feature_names, tell, f"query_id long, found array<struct<id: long, {', '.join(f'{f}: double' for f in feature_names)}>>")


def near_hits(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATE_K, exclude_self: bool = False, id_col: str = "id", feature_names: tuple[str, ...] = FEATURES) -> DataFrame:
    """HITS: of each query and feature the ``k`` nearest items (unit vectors) that a task has met, the ``k`` nearest of all among them.

    Both sides meet block by block; a task leaves one row for each query and feature, with at most ``k`` hits, whatever the
    number of blocks that it meets.
    """
    return gathered(pairs(queries, corpus, id_col, feature_names), *nearest_of(k, exclude_self, feature_names), HITS)


def nearest(corpus: DataFrame, queries: DataFrame, k: int = CANDIDATE_K, exclude_self: bool = False, id_col: str = "id", feature_names: tuple[str, ...] = FEATURES) -> DataFrame:
    """query_id, feature, place, id, sim: the ``k`` nearest items of each query by each feature (unit vectors)."""
    return rows_of(near_hits(corpus, queries, k, exclude_self, id_col, feature_names), k, feature_names)


def fused_of(weights: dict[str, float], k: int, exclude_self: bool) -> tuple[Callable[[dict, dict], None], Callable[[dict], pa.RecordBatch]]:
    """For ``gathered``: the ``k`` best items of each query by fused score, as rows of FUSED_HITS."""
    used = [f for f in FEATURES if weights.get(f)]

    def meet(held: dict, row: dict) -> None:
        (q_ids, q), (ids, c), at = unpacked(row, "q_"), unpacked(row), np.concatenate(([0], np.cumsum(row["widths"])))
        side = dict(zip(FEATURES, zip(at, at[1:])))
        scale = np.repeat([weights.get(f, 0.0) for f in FEATURES], row["widths"])
        approx = (q * scale) @ c.T
        if exclude_self:
            approx[q_ids[:, None] == ids[None, :]] = -np.inf

        def exact(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            sims = np.column_stack([dots(q[i, slice(*side[f])], c[j, slice(*side[f])]) for f in FEATURES])
            return sum((weights[f] * sims[:, FEATURES.index(f)] for f in used), np.zeros(len(i))), sims

        held.setdefault("best", Best(len(q_ids), k, len(FEATURES))).meet(approx, ids, exact)

    def told(held: dict) -> pa.RecordBatch:
        best = held["best"]
        i, nth = best.hits()
        return pa.RecordBatch.from_pydict({"query_id": held["q_ids"][i], "id": best.id[i, nth], **{f: best.extra[i, nth, n] for n, f in enumerate(FEATURES)}})

    return meet, told


def best_fused(corpus: DataFrame, queries: DataFrame, weights: dict[str, float], k: int, exclude_self: bool = False, id_col: str = "id") -> DataFrame:
    """query_id, id and the six sub-scores: each query's ``k`` best of each task by fused score, its ``k`` best of all among them."""
    return gathered(pairs(queries, corpus, id_col, FEATURES), *fused_of(weights, k, exclude_self), FUSED_HITS)


def ranked(df: DataFrame, by: list[str], score: str, k: int | None, id_col: str = "id", name: str = "rank") -> DataFrame:
    """``name`` from 1 by score, highest first, then id; the first ``k`` of each ``by``."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(id_col))
    out = df.withColumn(name, F.row_number().over(order))
    return out if k is None else out.filter(F.col(name) <= k)


def fused(weights: dict[str, float], feature_names: tuple[str, ...] = FEATURES, of: Callable[[str], Column] = F.col) -> Column:
    terms = [F.lit(float(weights[f])) * of(f) for f in feature_names if weights.get(f)]
    return sum(terms[1:], terms[0]) if terms else F.lit(0.0)


def top_listed(weights: dict[str, float], k: int) -> Column:
    """The ``k`` best of ``found`` by fused score, then id: structs of fall (the negative score), id and the six sub-scores."""
    hit = lambda e: F.struct((-fused(weights, of=lambda f: e[f])).alias("fall"), e["id"].alias("id"), *[e[f].alias(f) for f in FEATURES])
    return F.slice(F.sort_array(F.transform("found", hit)), 1, k)


def best_listed(lists: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """id, the six sub-scores, score and rank of the ``k`` best of each row's ``found``, beside the row's other columns."""
    keep = [c for c in lists.columns if c != "found"]
    rows = lists.select(*keep, F.posexplode(top_listed(weights, k)).alias("pos", "h"))
    return rows.select(*keep, "h.id", *[F.col("h")[f].alias(f) for f in FEATURES], (-F.col("h.fall")).alias("score"), (F.col("pos") + 1).alias("rank"))


def checked_k(k: int) -> int:
    if not 1 <= k <= MAX_TOP_K:
        raise ValueError(f"top_k must lie in 1 to {MAX_TOP_K}")
    return k


def search(
    corpus: DataFrame, queries: DataFrame, weights: dict | None = None, top_k: int = TOP_K, mode: str = "candidate",
    candidate_k: int = CANDIDATE_K, exclude_self: bool = False, id_col: str = "id", role: str | None = None, ef_search: int | None = None, index: Index | None = None, lists: Lists | None = None,
) -> DataFrame:
    """query_id, rank, id, score and the six sub-scores of each query's ``top_k`` items.

    ``candidate`` mode fuses the union of each feature's ``candidate_k`` nearest, ``ann`` mode the same as a stored index
    finds them, ``exact`` mode all items. Ties go to the lower id. ``role`` keeps corpus rows of one role. In ``ann`` mode
    ``index`` is needed, made once by ``Index.build`` of the rows to be found (those of one role, if only they are wanted); ``corpus`` is
    not read then. ``ef_search`` is how many nodes a walk there keeps. In ``exact`` mode with ``lists``, made once by ``Lists.build``,
    only those parts of them are read that may matter, and ``corpus`` is not.
    """
    if mode not in ("candidate", "exact", "ann"):
        raise ValueError("mode is candidate, ann or exact")
    w, k = normalise(weights), checked_k(top_k)
    if mode == "ann" or (mode == "candidate" and lists is None):
        return best_listed(candidate_lists(corpus, queries, mode, candidate_k, exclude_self, id_col, role, ef_search, index), w, k)
    return ranked(candidates(corpus, queries, w, k, mode, candidate_k, exclude_self, id_col, role, ef_search, index, lists).withColumn("score", fused(w)), ["query_id"], "score", k)


def candidates(
    corpus: DataFrame, queries: DataFrame, w: dict[str, float], k: int, mode: str = "candidate", candidate_k: int = CANDIDATE_K, exclude_self: bool = False,
    id_col: str = "id", role: str | None = None, ef_search: int | None = None, index: Index | None = None, lists: Lists | None = None,
) -> DataFrame:
    """query_id, id and the six sub-scores of the items that ``search`` ranks."""
    if lists is not None and mode != "ann":
        if mode != "exact" or role:
            raise ValueError("lists are for exact mode, and made of the rows of the role that is wanted")
        return lists.search(queries, w, k, exclude_self, id_col).drop("looked", "score")
    if mode == "exact":
        return best_fused(_of_role(corpus, role), queries, w, k, exclude_self, id_col)
    return candidate_lists(corpus, queries, mode, candidate_k, exclude_self, id_col, role, ef_search, index).select("query_id", F.inline("found"))


def candidate_lists(
    corpus: DataFrame, queries: DataFrame, mode: str = "candidate", candidate_k: int = CANDIDATE_K, exclude_self: bool = False,
    id_col: str = "id", role: str | None = None, ef_search: int | None = None, index: Index | None = None,
) -> DataFrame:
    """query_id, found: the same of ``candidate`` and ``ann`` mode, a row for each query, its items by id."""
    if mode == "ann":
        if index is None or role:
            raise ValueError("ann mode needs a stored index, made of the rows of the role that is wanted")
        return lists_of(index.walked(queries, candidate_k, exclude_self, id_col, **({"ef_search": ef_search} if ef_search else {})), candidate_k)
    return lists_of(near_hits(_of_role(corpus, role), queries, candidate_k, exclude_self, id_col), candidate_k)


def _of_role(corpus: DataFrame, role: str | None) -> DataFrame:
    corpus = corpus.filter(F.col("role") == role) if role else corpus
    if corpus.isEmpty():
        raise EmptyCorpusError("the corpus is empty")
    return corpus


def corpus_size(features: DataFrame, id_col: str = "image_id") -> DataFrame:
    """n: the items that have features."""
    return features.agg(F.count(id_col).alias("n"))


def assembled(results: DataFrame) -> DataFrame:
    """query_id, rank, id, score and per_feature as a map."""
    per = F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])
    return results.select("query_id", "rank", "id", "score", per.alias("per_feature"))


def hydrate(results: DataFrame, items: DataFrame, id_col: str = "id") -> DataFrame:
    """``results`` with the items' columns, null where an item is gone. A result set is small beside the items."""
    items = items.withColumnRenamed(id_col, "id") if id_col != "id" else items
    return results.join(items, "id", "left")


def contributions(results: DataFrame, weights: dict | None = None) -> DataFrame:
    """query_id, id, feature, sim, weight, contribution: what each feature adds to a fused score."""
    w = as_map(normalise(weights))
    long = results.unpivot(["query_id", "rank", "id"], list(FEATURES), "feature", "sim")
    return long.withColumn("weight", F.element_at(w, F.col("feature"))).withColumn("contribution", F.round(F.col("weight") * F.col("sim"), 4))


def compare(features: DataFrame, pairs: DataFrame, id_col: str = "id", weights: dict | None = None) -> DataFrame:
    """left, right, a cosine for each feature, fused, and both sides' widths, for a list of pairs."""
    side = lambda s: features.select(F.col(id_col).alias(s), F.struct(*FEATURES).alias(f"{s}_v"))
    both = pairs.join(side("left"), "left").join(side("right"), "right")
    sims = both.withColumns({f: dot(f"left_v.{f}", f"right_v.{f}") for f in FEATURES})
    dims = {f"{s}_dims": F.array(*[F.size(f"{s}_v.{f}") for f in FEATURES]) for s in ("left", "right")}
    return sims.withColumn("fused", fused(normalise(weights))).withColumns(dims).drop("left_v", "right_v")
