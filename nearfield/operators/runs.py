"""Stored search runs: sub-scores, re-ranking under other weights, versions of a run."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.schema import FEATURES, NoStashError, UnknownRunError
from nearfield.functions.weights import as_map, normalise
from nearfield.operators.retrieval import best_listed, checked_k, fused, ranked, top_listed
from nearfield.operators.shared import appended, claimed, written

# The stage that holds a run's sub-scores, last in its trace, and what it holds.
STASH = "_sub_scores"
_STASH_TYPE = "struct<image_ids: array<bigint>, scores: map<string, array<double>>>"


def run_scores(sub: DataFrame) -> DataFrame:
    """run_id, id, feature, sim: the sub-scores of dense candidate rows (query_id names the run)."""
    return sub.select(F.col("query_id").alias("run_id"), "id", *FEATURES).unpivot(["run_id", "id"], list(FEATURES), "feature", "sim")


def listed(sub: DataFrame) -> DataFrame:
    """query_id, found: candidate rows as ``retrieval.candidate_lists`` gives them, which stay as they are."""
    if "found" in sub.columns:
        return sub
    return sub.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("id", *FEATURES))).alias("found"))


def stash(sub: DataFrame) -> DataFrame:
    """query_id, detail: one JSON object for each run with its items in order of id and each feature's scores."""
    return listed(sub).select("query_id", _detail().alias("detail"))


def _detail() -> Column:
    part = lambda f: F.transform("found", lambda e: e[f])
    scores = F.create_map(*[x for f in FEATURES for x in (F.lit(f), part(f))])
    return F.to_json(F.struct(part("id").alias("image_ids"), scores.alias("scores")))


def trace_stash(trace: Column) -> Column:
    """The stash in a trace's last stage; null if there is none or it is malformed."""
    last = F.when(F.size(trace) > 0, F.element_at(trace, -1))
    found = F.from_json(last["detail"], _STASH_TYPE)
    sound = found["image_ids"].isNotNull() & found["scores"].isNotNull() & F.forall(F.map_values(found["scores"]), lambda v: v.isNotNull())
    return F.when((last["name"] == STASH) & sound, found)


def parse_stash(stashes: DataFrame, by: str = "query_id", found: Column | None = None) -> DataFrame:
    """by, id and the six sub-scores from stashed JSON (or a parsed ``found``); a missing feature counts 0."""
    return stash_lists(stashes, by, found).select(by, F.inline("found"))


def stash_lists(stashes: DataFrame, by: str = "query_id", found: Column | None = None) -> DataFrame:
    """by, found: the same, a row for each stash."""
    x = found if found is not None else F.from_json("detail", _STASH_TYPE)
    rows = stashes.select(by, x.alias("x")).filter("x.image_ids IS NOT NULL AND x.scores IS NOT NULL")
    parts = F.struct(F.col("x.image_ids").alias("ids"), *[F.element_at("x.scores", f).alias(f) for f in FEATURES])
    item = lambda p, i, at: F.struct(i.alias("id"), *[F.coalesce(F.get(p[f], at), F.lit(0.0)).alias(f) for f in FEATURES])
    lists = F.transform(F.array(parts), lambda p: F.transform(p["ids"], lambda i, at: item(p, i, at)))  # as a lambda's variable the JSON is parsed once, not for each item
    return rows.select(by, F.get(lists, F.lit(0)).alias("found"))


def rerank(sub: DataFrame, weights: dict | None, top_k: int, by: str = "query_id") -> DataFrame:
    """The stored candidates (rows, or lists) in the order of new weights; no corpus is read. candidate_count: of each run."""
    if "found" in sub.columns:
        return best_listed(sub.withColumn("candidate_count", F.size("found").cast("long")), normalise(weights), checked_k(top_k))
    count = F.count("*").over(Window.partitionBy(by))
    return ranked(sub.withColumns({"score": fused(normalise(weights)), "candidate_count": count}), [by], "score", checked_k(top_k))


def flips(lists: DataFrame, weights: dict | None, top_k: int, old: dict | None, old_k: int) -> DataFrame:
    """query_id, id, new_rank, old_rank: the ``top_k`` items of each list under new weights, and their ranks among the ``old_k``
    best under the old ones, null for those beyond."""
    before = F.transform(top_listed(normalise(old), checked_k(old_k)), lambda h: h["id"]).alias("before")
    rows = best_listed(lists.select("query_id", "found", before), normalise(weights), checked_k(top_k))
    return rows.select("query_id", "id", F.col("rank").alias("new_rank"), F.nullif(F.array_position("before", F.col("id")), F.lit(0)).cast("int").alias("old_rank"))


def visible_trace(trace: Column) -> Column:
    return F.filter(trace, lambda s: s["name"] != STASH)


def query_dims(trace: Column) -> Column:
    """The widths that the extract stage noted, as a map."""
    stage = F.element_at(F.filter(trace, lambda s: s["name"] == "extract"), 1)
    return F.from_json(F.get_json_object(stage["detail"], "$.dims"), "map<string,int>")


class Stages:
    """Timings of the stages of a run, in whole milliseconds: ``with stages.stage("rank", {...})``."""

    def __init__(self):
        self.done: list[tuple[str, int, str]] = []

    @contextmanager
    def stage(self, name: str, detail: dict | None = None) -> Iterator[None]:
        began = time.perf_counter()
        yield
        self.done.append((name, int((time.perf_counter() - began) * 1000), json.dumps(detail or {})))


def trace_json(trace: Column) -> Column:
    """The trace as a JSON list of name, elapsed_ms and detail (an object)."""
    each = F.transform(trace, lambda s: F.concat(F.lit('{"name":'), F.to_json(F.array(s["name"])).substr(F.lit(2), F.length(F.to_json(F.array(s["name"]))) - 2), F.lit(',"elapsed_ms":'), s["elapsed_ms"].cast("string"), F.lit(',"detail":'), F.coalesce(s["detail"], F.lit("{}")), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(each, ","), F.lit("]"))


def results_json(results: Column) -> Column:
    """The results as a JSON list of image_id, score, rank and per_feature."""
    return F.to_json(results)


def _results(w: dict[str, float], top_k: int) -> Column:
    """The ``top_k`` best of ``found`` as an array in order of rank, with sub-scores as maps."""
    names = F.array(*map(F.lit, FEATURES))
    shaped = lambda h, at: F.struct(h["id"].alias("image_id"), (-h["fall"]).alias("score"), (at + 1).cast("int").alias("rank"), F.map_from_arrays(names, F.array(*[h[f] for f in FEATURES])).alias("per_feature"))
    return F.transform(top_listed(w, checked_k(top_k)), shaped)


def recorded(sub: DataFrame, weights: dict | None, top_k: int, stages: Stages | None = None, created: str | None = None) -> DataFrame:
    """A run of each query as search_runs keeps it: weights, the ``top_k`` results, the stages passed and, last, the stash.

    ``sub``: query_id, id and the six sub-scores of the candidates, or lists of them; the query's id names the run.
    """
    w = normalise(weights)
    both = listed(sub).select("query_id", _detail().alias("detail"), _results(w, top_k).alias("results"))
    stage = lambda name, ms, detail: F.struct(F.lit(name).alias("name"), F.lit(ms).cast("int").alias("elapsed_ms"), detail.alias("detail"))
    done = stages.done if stages else []
    trace = F.array(*[stage(n, ms, F.lit(d)) for n, ms, d in done], stage(STASH, 0, F.col("detail")))
    return both.select(
        F.col("query_id").alias("id"), F.lit(1).alias("version"), F.lit(None).cast("bigint").alias("query_image_id"), as_map(w).alias("weights"), "results",
        trace.alias("pipeline_trace"), F.lit(sum(ms for _, ms, _ in done)).cast("int").alias("elapsed_ms"), (F.lit(created).cast("timestamp") if created else F.current_timestamp()).alias("created_at"),
    )


def candidates_of(runs: DataFrame) -> DataFrame:
    """query_id, id and the six sub-scores that stored runs hold; a run without a stash gives none."""
    return candidate_lists_of(runs).select("query_id", F.inline("found"))


def candidate_lists_of(runs: DataFrame) -> DataFrame:
    """query_id, found: the same, a row for each run."""
    return stash_lists(runs.withColumnRenamed("id", "query_id"), "query_id", trace_stash(F.col("pipeline_trace")))


def current(runs: DataFrame) -> DataFrame:
    """The latest version of each run. Runs that have one version stay where they lie; only rows of others are dealt by id."""
    several = runs.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if several.isEmpty():
        return runs
    row = F.struct(*runs.columns)
    latest = runs.join(several, "id", "left_semi").groupBy("id").agg(F.max_by(row, "version").alias("r")).select("r.*")
    return runs.join(several, "id", "left_anti").unionByName(latest)


def save(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)


def rerank_run(spark: SparkSession, path: str, run_id: int, weights: dict | None, top_k: int) -> DataFrame:
    """Appends the next version of a stored run, and gives it: new weights and results, a ``rerank`` stage before the stash.

    A version belongs to the caller that first makes its mark in ``path``/_versions; others take the next one. So callers at the
    same time get versions of their own, each on top of the one that it has read.
    """
    run = current(spark.read.parquet(path).filter(F.col("id") == run_id))
    head = run.select("version", trace_stash(F.col("pipeline_trace")).isNotNull().alias("ok")).first()
    if head is None:
        raise UnknownRunError(run_id)
    if not head["ok"]:
        raise NoStashError(run_id)
    w = normalise(weights)
    began = time.perf_counter()
    hits = candidate_lists_of(run).select(F.col("query_id").alias("id"), _results(w, top_k).alias("new_results"))
    hits = written(hits)
    version = head["version"] + 1
    while not claimed(spark, f"{path}/_versions/{run_id}/{version}"):
        version += 1
    took = int((time.perf_counter() - began) * 1000)
    detail = F.to_json(F.struct(F.lit(top_k).alias("top_k"), as_map(w).alias("weights"), F.col("weights").alias("previous_weights")))
    stage = F.array(F.struct(F.lit("rerank").alias("name"), F.lit(took).alias("elapsed_ms"), detail.alias("detail")))
    trace = F.col("pipeline_trace")
    new = run.join(hits, "id").withColumns({
        "pipeline_trace": F.concat(F.slice(trace, 1, F.size(trace) - 1), stage, F.slice(trace, -1, 1)),
        "weights": as_map(w), "results": F.col("new_results"), "version": F.lit(version), "elapsed_ms": F.lit(took),
    }).drop("new_results")
    appended(new.select(*run.columns), path)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path).filter((F.col("id") == run_id) & (F.col("version") == version))
