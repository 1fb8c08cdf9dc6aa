"""The engine's operators applied to a data folder, and the same in SQL.

``embeddings`` stands for a feature table: each 64-wide vector gives six named features by slices, made unit vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions import storage, vectors, weights
from nearfield.functions.schema import CANDIDATE_K, DEFAULT_WEIGHTS, DIMS, EVAL_TOP_K, EVALUATION_RUNS, FEATURES, SEARCH_RUNS, conform
from nearfield.operators import ann, evaluate, kept, plots, retrieval, runs, shared, threshold
from nearfield.sources import ingest
from nearfield.streaming import events as timeline
from nearfield.streaming import live

#: 1-based inclusive slices of the 64-wide vectors.
BOUNDS = {"hsv": (1, 16), "cm": (17, 25), "lbp": (26, 34), "glcm": (35, 44), "hog": (45, 57), "hu": (58, 64)}
CUSTOM = {"hsv": 0.5, "hog": -0.2, "other": 0.3, "lbp": 0.25}
NEW = {"hu": 0.6, "glcm": 0.4}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.slices(table(spark, sf_dir, "embeddings"), "embedding", BOUNDS).select(F.col("vec_id").alias("id"), "label", *FEATURES)


def asked(df: DataFrame) -> DataFrame:
    """The query set: the items whose number is divisible by 20."""
    return df.filter(F.col("id") % 20 == 0)


# --- SQL parts -----------------------------------------------------------------------------------------------

FEAT = "raw AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), sl AS (" + " UNION ALL ".join(
    f"SELECT id, label, '{f}' AS feature, {i} AS fno, e[{a}:{b}] AS v FROM raw" for i, (f, (a, b)) in enumerate(BOUNDS.items())
) + "), nn AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM sl), feat AS (SELECT id, label, feature, fno, CASE WHEN n <= 1e-12 THEN v ELSE list_transform(v, lambda x: x / n) END AS v FROM nn)"


def sims(where: str) -> str:
    return f"WITH {FEAT}, sims AS (SELECT q.id AS query_id, c.feature, c.id, list_inner_product(c.v, q.v) AS sim FROM feat c JOIN feat q USING (feature) WHERE {where} AND c.id <> q.id)"


def placed(k: int = CANDIDATE_K) -> str:
    return f", cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, feature ORDER BY sim DESC, id) AS place FROM sims) WHERE place <= {k})"


def wide(source: str, name: str = "sub") -> str:
    cols = ", ".join(f"coalesce(max(CASE WHEN feature = '{f}' THEN sim END), 0.0) AS {f}" for f in FEATURES)
    return f", {name} AS (SELECT query_id, id, {cols} FROM {source} GROUP BY query_id, id)"


def top(w: dict[str, float], k: int, source: str = "sub", name: str = "res") -> str:
    score = " + ".join(f"{float(w[f])!r}::DOUBLE * {f}" for f in FEATURES if w.get(f))
    return f", {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT *, {score} AS score FROM {source})) WHERE rank <= {k})"


ROUNDED = ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES)
CANDIDATE = sims("q.id % 20 = 0") + placed() + wide("cand")


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.round(c, 6).alias(c) for c in ("score", *FEATURES) if c in df.columns])


# --- retrieval -----------------------------------------------------------------------------------------------


@query("search_topk", CANDIDATE + top(DEFAULT_WEIGHTS, 5) + f" SELECT query_id, CAST(rank AS INTEGER) AS rank, id AS vec_id, e.label, round(score, 6) AS score, {ROUNDED} FROM res JOIN embeddings e ON e.vec_id = id")
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    found = retrieval.search(f.drop("label"), asked(f), exclude_self=True)
    return rounded(retrieval.hydrate(found, f.select("id", "label")), "query_id", "rank", "id", "label").withColumnRenamed("id", "vec_id")


@query("search_exact_topk", sims("q.id % 20 = 0") + wide("sims") + top(DEFAULT_WEIGHTS, 5) + f" SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, {ROUNDED} FROM res")
def search_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounded(retrieval.search(f, asked(f), mode="exact", exclude_self=True), "query_id", "rank", "id")


@query("search_threshold_topk", sims("q.id % 20 = 0") + wide("sims") + top(DEFAULT_WEIGHTS, 5) + f" SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, {ROUNDED} FROM res")
def search_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact five best items of each query from stored lists, one for each feature."""
    f = features(spark, sf_dir)
    lists = threshold.Lists(spark, shared.new_folder(spark, "lists")).build(f)
    return rounded(retrieval.search(f, asked(f), mode="exact", exclude_self=True, lists=lists), "query_id", "rank", "id")


@query("search_batch_topk", CANDIDATE + top(DEFAULT_WEIGHTS, 5) + f" SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, {ROUNDED} FROM res")
def search_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounded(retrieval.search(f, asked(f), exclude_self=True), "query_id", "rank", "id")


@query("search_custom_weights", CANDIDATE + top(weights.normalise(CUSTOM), 10) + f" SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, {ROUNDED} FROM res")
def search_custom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return rounded(retrieval.search(f, asked(f), CUSTOM, 10, exclude_self=True), "query_id", "rank", "id")


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return retrieval.candidate_lists(f, asked(f), exclude_self=True)


@query("search_per_feature_topk", sims("q.id % 20 = 0") + placed() + " SELECT query_id, feature, CAST(place AS INTEGER) AS place, id, round(sim, 6) AS sim FROM cand")
def search_per_feature_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    return retrieval.nearest(f, asked(f), exclude_self=True).select("query_id", "feature", "place", "id", F.round("sim", 6).alias("sim"))


@query("candidate_union", sims("q.id % 20 = 0") + placed() + " SELECT query_id, id, count(*) AS n_features FROM cand GROUP BY 1, 2")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    lists = retrieval.lists_of(retrieval.near_hits(f, asked(f), exclude_self=True), CANDIDATE_K, missing=None)
    return lists.select("query_id", F.inline("found")).select("query_id", "id", sum((F.col(f).isNotNull().cast("long") for f in FEATURES), F.lit(0)).alias("n_features"))


@query("mode_overlap", CANDIDATE + top(DEFAULT_WEIGHTS, 5) + wide("sims", "exact") + top(DEFAULT_WEIGHTS, 5, "exact", "ex") + " SELECT ex.query_id, count(res.id) AS shared, count(*) AS k FROM ex LEFT JOIN res ON ex.query_id = res.query_id AND ex.id = res.id GROUP BY 1")
def mode_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    a = retrieval.search(f, asked(f), exclude_self=True).select("query_id", "id", F.lit(1).alias("hit"))
    b = retrieval.search(f, asked(f), mode="exact", exclude_self=True).select("query_id", "id")
    return b.join(a, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("hit").alias("shared"), F.count("*").alias("k"))


@query("fusion_contributions", CANDIDATE + top(DEFAULT_WEIGHTS, 5) + ", long AS (" + " UNION ALL ".join(f"SELECT query_id, rank, id, '{f}' AS feature, {f} AS sim, {w!r}::DOUBLE AS weight FROM res" for f, w in DEFAULT_WEIGHTS.items()) + ") SELECT query_id, CAST(rank AS INTEGER) AS rank, id, feature, round(weight, 6) AS weight, round(sim, 6) AS sim, round(weight * sim, 4) AS contribution, round(greatest(0.0, least(1.0, sim)), 6) AS shown FROM long")
def fusion_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    rows = retrieval.contributions(retrieval.search(f, asked(f), exclude_self=True))
    return rows.select("query_id", "rank", "id", "feature", F.round("weight", 6).alias("weight"), F.round("sim", 6).alias("sim"), "contribution", F.round(vectors.clamp01("sim"), 6).alias("shown"))


@query("hydrate_results", CANDIDATE + top(DEFAULT_WEIGHTS, 5) + " SELECT query_id, CAST(rank AS INTEGER) AS rank, res.id, d.lang, d.source, l.quality FROM res LEFT JOIN documents d ON d.doc_id = res.id LEFT JOIN labels l ON l.doc_id = res.id")
def hydrate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    found = retrieval.search(f, asked(f), exclude_self=True).select("query_id", "rank", "id")
    named = retrieval.hydrate(found, table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return retrieval.hydrate(named, table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").select("query_id", "rank", "id", "lang", "source", "quality")


_DOTS = ", ".join(f"list_inner_product(max(CASE WHEN feature = '{f}' THEN lv END), max(CASE WHEN feature = '{f}' THEN rv END)) AS {f}" for f in FEATURES)


@query("pairwise_compare", f"WITH {FEAT}, p AS (SELECT l.id AS \"left\", r.id AS \"right\", l.feature, l.v AS lv, r.v AS rv FROM feat l JOIN feat r ON r.id = l.id + 1 AND l.feature = r.feature), c AS (SELECT \"left\", \"right\", {_DOTS} FROM p GROUP BY 1, 2) SELECT \"left\", \"right\", {ROUNDED}, round({' + '.join(f'{w!r}::DOUBLE * {f}' for f, w in DEFAULT_WEIGHTS.items())}, 6) AS fused, CAST(64 AS BIGINT) AS total_dims FROM c")
def pairwise_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    pairs = f.select(F.col("id").alias("left"), (F.col("id") + 1).alias("right"))
    got = retrieval.compare(f, pairs)
    dims = F.aggregate("left_dims", F.lit(0), lambda s, x: s + x).cast("long")
    return got.select("left", "right", *[F.round(f, 6).alias(f) for f in FEATURES], F.round("fused", 6).alias("fused"), dims.alias("total_dims"))


@query("l2_normalize", f"WITH {FEAT} SELECT id, feature, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1], 6) AS first, CAST(len(v) AS BIGINT) AS width FROM feat")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = retrieval.long_features(features(spark, sf_dir), "id")
    return long.select("id", "feature", F.round(vectors.norm("vec"), 6).alias("norm"), F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.size("vec").cast("long").alias("width"))


@query("similarity_matrix_stats", sims("TRUE") + wide("sims") + f", sc AS (SELECT query_id, id, {' + '.join(f'{w!r}::DOUBLE * {f}' for f, w in DEFAULT_WEIGHTS.items())} AS score FROM sub) SELECT a.label AS left_label, b.label AS right_label, count(*) AS n, round(avg(score), 6) AS mean, round(max(score), 6) AS best FROM sc JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = sc.id GROUP BY 1, 2")
def similarity_matrix_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.label_pairs(features(spark, sf_dir), "id", "label", DEFAULT_WEIGHTS)
    return got.select(F.col("left_label").cast("int").alias("left_label"), F.col("right_label").cast("int").alias("right_label"), "n", F.round("mean", 6).alias("mean"), F.round("best", 6).alias("best"))


def stored_index(spark: SparkSession, sf_dir: str) -> ann.Index:
    """An index of the items' features in a new folder of the shared one."""
    return ann.Index(spark, shared.new_folder(spark, "index")).build(features(spark, sf_dir))


@query("ann_recall")
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By feature, how many of the 50 nearest of every 20th item walks in the stored index find, and the share of all pairs
    that they look at."""
    f, index = features(spark, sf_dir), stored_index(spark, sf_dir)
    found = shared.written(index.walked(asked(f), exclude_self=True))
    seen = found.groupBy("feature").agg(F.sum("looked").alias("looked"))
    sizes = f.agg((F.count("*") * F.sum((F.col("id") % 20 == 0).cast("long"))).alias("pairs"))
    got = ann.recall_of(found, retrieval.near_hits(f, asked(f), exclude_self=True), CANDIDATE_K).join(seen, "feature").crossJoin(sizes)  # one row
    return got.select("feature", "n_exact", "n_found", "recall", "looked", F.round(F.col("looked") / F.col("pairs"), 4).alias("share"))


@query("search_ann_topk", CANDIDATE + top(DEFAULT_WEIGHTS, 5) + f" SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, {ROUNDED} FROM res")
def search_ann_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best items of each query among those that the stored index of six features finds. Over these tables walks
    miss none of the 50 nearest (``ann_recall``), so that SQL over all pairs gives the same."""
    f = features(spark, sf_dir)
    return rounded(retrieval.search(f, asked(f), mode="ann", exclude_self=True, index=stored_index(spark, sf_dir)), "query_id", "rank", "id")


@query("assembled_results", CANDIDATE + top(DEFAULT_WEIGHTS, 5) + " SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, round(hsv, 6) AS hsv, round(hog, 6) AS hog, CAST(6 AS INTEGER) AS n_features FROM res")
def assembled_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    got = retrieval.assembled(retrieval.search(f, asked(f), exclude_self=True))
    sub = lambda name: F.round(F.element_at("per_feature", name), 6).alias(name)
    return got.select("query_id", "rank", "id", F.round("score", 6).alias("score"), sub("hsv"), sub("hog"), F.size("per_feature").alias("n_features"))


@query("corpus_count", "SELECT count(*) AS n FROM embeddings")
def corpus_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.corpus_size(features(spark, sf_dir), "id")


_ZERO = "CASE WHEN a.vec_id % 10 = 0 THEN list_transform(b.embedding, lambda x: 0.0::DOUBLE) ELSE CAST(b.embedding AS DOUBLE[]) END"


@query("guarded_cosine", f"WITH p AS (SELECT a.vec_id AS id, CAST(a.embedding AS DOUBLE[]) AS x, {_ZERO} AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT id, round(CASE WHEN list_inner_product(y, y) = 0 THEN 0.0 ELSE list_inner_product(x, y) / (sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y))) END, 6) AS cosine FROM p")
def guarded_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine with the next vector, every tenth of which is taken for zero."""
    e = table(spark, sf_dir, "embeddings")
    a = e.select(F.col("vec_id").alias("id"), vectors.to_doubles("embedding").alias("x"))
    b = e.select((F.col("vec_id") - 1).alias("id"), vectors.to_doubles("embedding").alias("y"))
    y = F.when(F.col("id") % 10 == 0, F.transform("y", lambda v: F.lit(0.0))).otherwise(F.col("y"))
    return a.join(b, "id").select("id", F.round(vectors.cosine(F.col("x"), y), 6).alias("cosine"))


@query("sql_functions", f"WITH {FEAT}, w AS (SELECT id, max(CASE WHEN feature = 'cm' THEN v END) AS cm, max(CASE WHEN feature = 'lbp' THEN v END) AS lbp, max(CASE WHEN feature = 'hsv' THEN v END) AS hsv FROM feat GROUP BY 1) SELECT id, round(list_inner_product(cm, lbp) / (sqrt(list_inner_product(cm, cm)) * sqrt(list_inner_product(lbp, lbp))), 6) AS cosine, round(hsv[1] / sqrt(list_inner_product(hsv, hsv)), 6) AS first, round(0.4::DOUBLE * cm[1], 6) AS fused FROM w")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that ``vectors.register`` gives to SQL."""
    vectors.register(spark)
    f = features(spark, sf_dir)
    return f.selectExpr("id", "round(cosine_sim(cm, lbp), 6) AS cosine", "round(l2_normalize(hsv)[0], 6) AS first", "round(fuse(map('cm', cm[0], 'hu', 0.5D), map('cm', 0.4D)), 6) AS fused")


# --- weights -------------------------------------------------------------------------------------------------


#: Raw weights of an event; every thirteenth has none over 0.
_GIVEN = {
    f: f"CASE WHEN event_id % 13 = 0 THEN 0.0 ELSE {x} END"
    for f, x in zip(FEATURES, ("value - 50", "CAST(event_id % 7 - 3 AS DOUBLE)", "CAST(event_id % 5 AS DOUBLE)", "0 - value", "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value / 10 END", "CAST(user_id % 3 AS DOUBLE)"), strict=True)
}


def _weight_sql(gone: str) -> str:
    """SQL for an event's normalised weights, without the feature whose number is ``gone``."""
    raw = ", ".join(f"CAST(greatest(coalesce(CASE WHEN {gone} = {i} THEN 0.0 ELSE {x} END, 0.0), 0.0) AS DOUBLE) AS {f}" for i, (f, x) in enumerate(_GIVEN.items()))
    out = ", ".join(f"round(CASE WHEN total > 0 THEN {f} / total ELSE {w!r}::DOUBLE END, 6) AS {f}" for f, w in DEFAULT_WEIGHTS.items())
    return f"WITH g AS (SELECT event_id, {raw} FROM events), t AS (SELECT *, {' + '.join(FEATURES)} AS total FROM g) SELECT event_id, {out} FROM t"


@query("weights_normalise", _weight_sql("-1"))
def weights_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's raw weights (null, negative or none over 0 among them) as they are used."""
    found = weights.normalised_columns({f: F.expr(x).cast("double") for f, x in _GIVEN.items()})
    return table(spark, sf_dir, "events").select("event_id", *[F.round(c, 6).alias(f) for f, c in found.items()])


@query("weights_parse_json", "WITH p AS (SELECT event_id, coalesce(try_cast(json_extract_string(replace(props, '\"k\"', '\"hu\"'), '$.hu') AS DOUBLE), 0.0) AS hu FROM events) SELECT event_id, round(CASE WHEN hu > 0 THEN 1.0 ELSE 0.15 END, 6)::DOUBLE AS hu, round(CASE WHEN hu > 0 THEN 0.0 ELSE 0.25 END, 6)::DOUBLE AS hog, TRUE AS valid FROM p")
def weights_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.regexp_replace("props", '"k"', '"hu"')
    found = weights.normalised_columns(weights.parsed_columns(raw))
    return table(spark, sf_dir, "events").select("event_id", F.round(found["hu"], 6).alias("hu"), F.round(found["hog"], 6).alias("hog"), weights.is_valid(raw).alias("valid"))


_RAW = ("'{not-json'", "'[1]'", "'{\"hu\": \"x\"}'", "' '", "'{\"hu\": \"0.3\", \"hog\": 0.1}'")


@query("weights_parse_invalid", "WITH p AS (SELECT event_id % 5 AS kind FROM events) SELECT kind, kind > 2 AS valid, count(*) AS n, CASE WHEN kind = 4 THEN 0.75 ELSE 0.15 END::DOUBLE AS hu, 0.25::DOUBLE AS hog FROM p GROUP BY 1")
def weights_parse_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as text that is no JSON, no object, no numbers, blank, or numbers and their strings; defaults where nothing is given."""
    kind = F.col("event_id") % 5
    raw = F.get(F.array(*map(F.expr, _RAW)), kind.cast("int"))
    rows = table(spark, sf_dir, "events").select(kind.alias("kind"), raw.alias("raw"))
    found = weights.normalised_columns(weights.parsed_columns(F.col("raw")))
    each = rows.select("kind", weights.is_valid(F.col("raw")).alias("valid"), F.round(found["hu"], 6).alias("hu"), F.round(found["hog"], 6).alias("hog"))
    return each.groupBy("kind", "valid", "hu", "hog").agg(F.count("*").alias("n"))


@query("weights_ablated", _weight_sql("event_id % 6"))
def weights_ablated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's weights without one feature, the rest making up for it."""
    left = {f: F.when(F.col("event_id") % 6 != i, F.expr(x).cast("double")) for i, (f, x) in enumerate(_GIVEN.items())}
    return table(spark, sf_dir, "events").select("event_id", *[F.round(c, 6).alias(f) for f, c in weights.normalised_columns(left).items()])


# --- stored runs ---------------------------------------------------------------------------------------------


_STORES: dict[tuple[str, str], str] = {}


def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The present versions of the runs of every 20th item as a query, searched and stored once by a Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        stages, path = runs.Stages(), shared.new_folder(spark, "runs")
        with stages.stage("extract", {"dims": {f: b - a + 1 for f, (a, b) in BOUNDS.items()}}):
            f = features(spark, sf_dir)
        with stages.stage("load_corpus"):
            f.count()
        with stages.stage("cosine"):
            sub = shared.written(retrieval.candidate_lists(f, asked(f), exclude_self=True))
        with stages.stage("rank"):
            runs.rerank(sub, None, 5).count()
        runs.save(runs.recorded(sub, None, 5, stages), path)
        _STORES[key] = path
    return runs.current(spark.read.schema(SEARCH_RUNS).parquet(_STORES[key]))


@query("rerank_stored", CANDIDATE + top(weights.normalise(NEW), 5) + ", n AS (SELECT query_id, count(*) AS candidate_count FROM sub GROUP BY 1) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, candidate_count FROM res JOIN n USING (query_id)")
def rerank_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New weights for the stored runs: only what they hold is read."""
    sub = runs.candidate_lists_of(stored_runs(spark, sf_dir))
    return runs.rerank(sub, NEW, 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"), "candidate_count")


@query("rerank_flip_report", CANDIDATE + top(DEFAULT_WEIGHTS, 50, name="old") + top(weights.normalise(NEW), 5) + " SELECT res.query_id, res.id, CAST(res.rank AS INTEGER) AS new_rank, CAST(old.rank AS INTEGER) AS old_rank FROM res LEFT JOIN old ON res.query_id = old.query_id AND res.id = old.id")
def rerank_flip_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.flips(runs.candidate_lists_of(stored_runs(spark, sf_dir)), NEW, 5, None, 50)


@query("run_roundtrip", CANDIDATE + top(DEFAULT_WEIGHTS, 5) + f" SELECT query_id AS run_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, {ROUNDED}, n_candidates, CAST(4 AS INTEGER) AS n_stages, CAST(16 AS INTEGER) AS hsv_width, 0.25::DOUBLE AS hog_weight FROM res JOIN (SELECT query_id, count(*) AS n_candidates FROM sub GROUP BY 1) USING (query_id)")
def run_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored runs written as JSON and read back: results, visible stages, noted widths and weights."""
    rows = stored_runs(spark, sf_dir).select("id", "weights", "pipeline_trace", F.from_json(runs.results_json(F.col("results")), "array<struct<image_id:bigint,score:double,rank:int,per_feature:map<string,double>>>").alias("results"))
    trace = F.from_json(runs.trace_json(runs.visible_trace(F.col("pipeline_trace"))), "array<struct<name:string,elapsed_ms:int,detail:string>>")
    rows = rows.select("id", F.explode("results").alias("r"), F.size(trace).alias("n_stages"), F.element_at(runs.query_dims(trace), "hsv").alias("hsv_width"), F.element_at("weights", "hog").alias("hog_weight"), F.size(runs.trace_stash(F.col("pipeline_trace"))["image_ids"]).cast("long").alias("n_candidates"))
    subs = [F.round(F.element_at("r.per_feature", f), 6).alias(f) for f in FEATURES]
    return rows.select(F.col("id").alias("run_id"), "r.rank", F.col("r.image_id").alias("id"), F.round("r.score", 6).alias("score"), *subs, "n_candidates", "n_stages", "hsv_width", "hog_weight")


@query("stash_roundtrip", CANDIDATE + f" SELECT query_id, id, {ROUNDED} FROM sub")
def stash_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(runs.parse_stash(runs.stash(_lists(spark, sf_dir))), "query_id", "id")


@query("run_scores_long", CANDIDATE + ", long AS (" + " UNION ALL ".join(f"SELECT query_id AS run_id, id, '{f}' AS feature, {f} AS sim FROM sub" for f in FEATURES) + ") SELECT run_id, feature, count(*) AS n, round(sum(sim), 4) AS total FROM long GROUP BY 1, 2")
def run_scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runs.run_scores(_lists(spark, sf_dir).select("query_id", F.inline("found")))
    return rows.groupBy("run_id", "feature").agg(F.count("*").alias("n"), F.round(F.sum("sim"), 4).alias("total"))


# --- evaluation ----------------------------------------------------------------------------------------------


def loo(k: int, variants: dict[str, dict[str, float]]) -> str:
    parts = [f"SELECT '{v}' AS variant, query_id, id, {' + '.join(f'{float(w[f])!r}::DOUBLE * {f}' for f in FEATURES if w[f])} AS score FROM sub" for v, w in variants.items()]
    return sims("TRUE") + wide("sims") + f""", sc AS ({" UNION ALL ".join(parts)}),
hit AS (SELECT * FROM (SELECT variant, query_id, sc.id, row_number() OVER (PARTITION BY variant, query_id ORDER BY score DESC, sc.id) AS rank FROM sc) WHERE rank <= {k}),
rel AS (SELECT variant, query_id, q.label, rank, CASE WHEN q.label = i.label THEN 1 ELSE 0 END AS rel FROM hit JOIN embeddings q ON q.vec_id = query_id JOIN embeddings i ON i.vec_id = hit.id),
gain AS (SELECT *, CASE WHEN rel = 1 THEN sum(rel) OVER (PARTITION BY variant, query_id ORDER BY rank) / rank ELSE 0 END AS g FROM rel),
size AS (SELECT label, count(*) - 1 AS relevant FROM embeddings GROUP BY 1 HAVING count(*) > 1),
met AS (SELECT variant, query_id, gain.label, avg(rel) AS p, sum(g) / least(count(*), any_value(relevant)) AS ap FROM gain JOIN size ON size.label = gain.label GROUP BY 1, 2, 3)"""


def _metrics(spark: SparkSession, sf_dir: str, k: int, variants: dict) -> DataFrame:
    f = features(spark, sf_dir)
    return evaluate.query_metrics(evaluate.ranks(f, "id", "label", variants, k), evaluate.class_sizes(f, "label"), k)


def _six(df: DataFrame, *keep) -> DataFrame:
    return df.select(*keep, F.round("precision", 6).alias("precision"), F.round("map", 6).alias("map"), "n_queries")


@query("eval_loo_overall", loo(10, evaluate.BASE) + " SELECT round(avg(p), 6) AS precision, round(avg(ap), 6) AS map, count(*) AS n_queries FROM met")
def eval_loo_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(evaluate.overall(_metrics(spark, sf_dir, 10, evaluate.BASE)))


@query("eval_loo_per_class", loo(10, evaluate.BASE) + " SELECT CAST(label AS VARCHAR) AS label, round(avg(p), 6) AS precision, round(avg(ap), 6) AS map, count(*) AS n_queries FROM met GROUP BY 1")
def eval_loo_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(evaluate.per_class(_metrics(spark, sf_dir, 10, evaluate.BASE)), F.col("query_label").alias("label"))


@query("eval_ablation", loo(10, weights.ablations()) + " SELECT variant, round(avg(p), 6) AS precision, round(avg(ap), 6) AS map, count(*) AS n_queries FROM met GROUP BY 1")
def eval_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _six(evaluate.overall(_metrics(spark, sf_dir, 10, weights.ablations())), "variant")


@query("eval_p5_map10", loo(10, evaluate.BASE) + ", p5 AS (SELECT query_id, avg(rel) AS p FROM rel WHERE rank <= 5 GROUP BY 1) SELECT CAST(round((SELECT avg(p) FROM p5), 4) AS DOUBLE) AS precision_at_5, CAST(round(avg(ap), 4) AS DOUBLE) AS map_at_10 FROM met")
def eval_p5_map10(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features(spark, sf_dir)
    hits = shared.written(evaluate.ranks(f, "id", "label", evaluate.BASE, 10))
    sizes = evaluate.class_sizes(f, "label")
    got = evaluate.evaluation_run(evaluate.query_metrics(hits, sizes, 5), evaluate.query_metrics(hits, sizes, 10))
    return got.select(*[F.col(c).cast("double").alias(c) for c in got.columns])


_EACH = "round(avg(p), 6) AS precision, round(avg(ap), 6) AS map, count(*) AS n_queries"


@query("evaluation_runs", loo(10, weights.ablations()) + f""", p5 AS (SELECT query_id, avg(rel) AS p FROM rel WHERE variant = 'base' AND rank <= 5 GROUP BY 1),
n AS (SELECT CAST(round((SELECT avg(p) FROM p5), 4) AS DOUBLE) AS precision_at_5, CAST(round(avg(ap), 4) AS DOUBLE) AS map_at_10 FROM met WHERE variant = 'base'),
r AS (SELECT 'default' AS method, 'default' AS variant, CAST(label AS VARCHAR) AS label, {_EACH} FROM met WHERE variant = 'base' GROUP BY met.label
 UNION ALL SELECT 'ablation', CASE WHEN variant = 'base' THEN 'default' ELSE variant END, CAST(label AS VARCHAR), {_EACH} FROM met GROUP BY variant, met.label
 UNION ALL SELECT 'ablation', CASE WHEN variant = 'base' THEN 'default' ELSE variant END, 'all', {_EACH} FROM met GROUP BY variant)
SELECT * FROM r CROSS JOIN n""")
def evaluation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both kinds of stored evaluations, their JSON read back."""
    f = features(spark, sf_dir)
    stored = shared.new_folder(spark, "evaluations")
    hits = shared.written(evaluate.ranks(f, "id", "label", weights.ablations(), EVAL_TOP_K))  # has the default weights as well
    for i, method in enumerate(("default", "ablation")):
        runs.save(evaluate.evaluated(f, "id", "label", method, run_id=i + 1, found=hits), stored)
    rows = spark.read.schema(EVALUATION_RUNS).parquet(stored)
    numbers = [F.col(c).cast("double").alias(c) for c in ("precision_at_5", "map_at_10")]
    by_class = rows.filter("ablation IS NULL").select("method", F.lit("default").alias("variant"), *numbers, F.explode(F.from_json("per_class", evaluate.PER_CLASS)).alias("label", "m"))
    found = F.from_json("ablation", evaluate.ABLATION)
    reports = rows.filter("per_class IS NULL").select("method", *numbers, F.explode(F.concat(F.array(found["base"]), F.map_values(found["variants"]))).alias("r"))
    each = reports.select("method", F.col("r.method").alias("variant"), "precision_at_5", "map_at_10", F.explode(F.map_concat(F.create_map(F.lit("all"), F.col("r.overall")), F.col("r.per_class"))).alias("label", "m"))
    return by_class.unionByName(each).select("method", "variant", "label", F.round("m.precision_at_k", 6).alias("precision"), F.round("m.map_at_k", 6).alias("map"), "m.n_queries", "precision_at_5", "map_at_10")


@query("labelled_snapshot", f"WITH {FEAT} SELECT id, CAST(label AS VARCHAR) AS label, CAST(sum(len(v)) AS BIGINT) AS width FROM feat GROUP BY ALL")
def labelled_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features joined to their labels, vectors of a wrong width being errors."""
    f = features(spark, sf_dir)
    dims = {name: b - a + 1 for name, (a, b) in BOUNDS.items()}
    both = evaluate.labelled(f.drop("label"), f.select("id", "label"), "id", "label", dims)
    return both.select("id", F.col("label").cast("string").alias("label"), sum((F.size(x) for x in FEATURES[1:]), F.size(FEATURES[0])).cast("long").alias("width"))


@query("bucketed_snapshot", f"WITH {FEAT} SELECT id, CAST(label AS VARCHAR) AS label, CAST(sum(len(v)) AS BIGINT) AS width FROM feat GROUP BY ALL")
def bucketed_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labelled_snapshot`` of features and labels that lie in buckets of their ids."""
    f, folder = features(spark, sf_dir), shared.new_folder(spark, "kept")
    sides = [kept.Kept(spark, f"{folder}/{name}").write(df, buckets=8).read() for name, df in (("features", f.drop("label")), ("items", f.select("id", "label")))]
    both = evaluate.labelled(*sides, "id", "label", {name: b - a + 1 for name, (a, b) in BOUNDS.items()})
    return both.select("id", F.col("label").cast("string").alias("label"), sum((F.size(x) for x in FEATURES[1:]), F.size(FEATURES[0])).cast("long").alias("width"))


@query("runs_raised", "SELECT user_id AS id, 1 AS version, count(*)::INTEGER AS elapsed_ms FROM events GROUP BY 1")
def runs_raised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user, kept under the first version of the schema and raised to the present one."""
    old = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("elapsed_ms"))
    runs_ = kept.Kept(spark, shared.new_folder(spark, "kept")).write(conform(old, "search_runs").drop("version"), buckets=8, version=1)
    return runs_.raised("search_runs").select("id", "version", "elapsed_ms")


@query("class_counts_guard", "SELECT CAST(label AS VARCHAR) AS label, count(*) - 1 AS relevant FROM embeddings GROUP BY 1 HAVING count(*) > 1")
def class_counts_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    evaluate.guard(items, "label")
    return evaluate.class_sizes(items, "label")


@query("labelled_join", "SELECT d.lang, l.quality, l.toxic, count(*) AS n, sum(d.n_chars)::BIGINT AS n_chars FROM documents d JOIN labels l USING (doc_id) GROUP BY ALL")
def labelled_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    both = docs.join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


# --- ingestion -----------------------------------------------------------------------------------------------


@query("content_dedupe", "SELECT doc_id, sha256(text) AS sha256, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", storage.content_hash(F.col("text")).alias("sha256"), "lang", "source")
    return ingest.first_of_each(docs, "sha256", "doc_id").select("doc_id", "sha256", "lang", "source")


@query("per_class_cap", "SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS nth FROM documents) WHERE nth <= 50")
def per_class_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.cap(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 50)


_LABEL = "'  ' || upper(lang) || ' ' || source || '!! '"
_SLUG = r"nullif(regexp_replace(regexp_replace(lower(trim({})), '[^a-zA-Z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), '')"


@query("label_slug", f"SELECT {_SLUG.format(_LABEL)} AS slug, count(*) AS n FROM documents GROUP BY 1")
def label_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.concat(F.lit("  "), F.upper("lang"), F.lit(" "), F.col("source"), F.lit("!! "))
    return table(spark, sf_dir, "documents").select(storage.slug(label).alias("slug")).groupBy("slug").agg(F.count("*").alias("n"))


_NAME = "url || CASE page_id % 4 WHEN 0 THEN '.JPG' WHEN 1 THEN '.exe' WHEN 2 THEN '.webp' ELSE '' END"
_EXT = r"lower(regexp_extract(name, '\.([A-Za-z0-9]+)$', 1))"
_KNOWN = ", ".join(f"'{e}'" for e in storage.EXTENSIONS)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", storage.content_hash(F.col("html")).alias("sha256"))
    suffix = F.get(F.array(F.lit(".JPG"), F.lit(".exe"), F.lit(".webp"), F.lit("")), (F.col("page_id") % 4).cast("int"))
    return pages.withColumn("name", F.concat("url", suffix))


@query("storage_path", rf"WITH p AS (SELECT page_id, sha256(html) AS sha256, {_NAME} AS name FROM pages) SELECT page_id, 'originals/red_fox/' || sha256 || '.' || CASE WHEN {_EXT} IN ({_KNOWN}) THEN {_EXT} ELSE 'bin' END AS storage_path, TRUE AS inside FROM p")
def storage_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = storage.storage_path(F.lit("  Red Fox!! "), F.col("sha256"), F.col("name"))
    return _pages(spark, sf_dir).select("page_id", path.alias("storage_path")).withColumn("inside", storage.is_inside(F.col("storage_path")))


@query("path_guard", "SELECT page_id, page_id % 4 = 3 OR page_id % 4 = 2 AS inside FROM pages")
def path_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from the root, through a parent folder, with dots in a name, and plain ones."""
    tail = F.concat(F.lit("originals/"), F.col("page_id").cast("string"))
    path = F.get(F.array(F.concat(F.lit("/"), tail), F.concat(F.lit("originals/../"), tail), F.concat(tail, F.lit("..jpg")), tail), (F.col("page_id") % 4).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", storage.is_inside(path).alias("inside"))


@query("media_type", rf"WITH p AS (SELECT {_NAME} AS name FROM pages) SELECT CASE {_EXT} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in storage.MEDIA_TYPES.items()) + f" ELSE '{storage.FALLBACK_TYPE}' END AS media_type, count(*) AS n FROM p GROUP BY 1")
def media_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(storage.media_type(F.col("name")).alias("media_type")).groupBy("media_type").agg(F.count("*").alias("n"))


@query("ingest_status_counts", "WITH d AS (SELECT doc_id, source, sha256(text) AS sha, CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN length(text) > 5000 THEN 'too_large' END AS reason FROM documents), f AS (SELECT *, min(CASE WHEN reason IS NULL THEN doc_id END) OVER (PARTITION BY sha) AS first FROM d) SELECT source, CASE WHEN reason IS NOT NULL THEN 'failed' WHEN doc_id = first THEN 'inserted' ELSE 'deduped' END AS status, count(*) AS n FROM f GROUP BY 1, 2")
def ingest_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", storage.content_hash(F.col("text")).alias("sha"), ingest.reject_reason(F.col("text"), F.col("source"), most=5000).alias("reason"))
    return ingest.statuses(docs, "sha", "doc_id", "reason").groupBy("source", "status").agg(F.count("*").alias("n"))


@query("validated_rows", "SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty' WHEN length(text) > 900 THEN 'too_large' ELSE 'taken' END AS reason FROM documents WHERE source IS NOT NULL")
def validated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("source IS NOT NULL").select("doc_id", "text", "source")
    good, bad = ingest.validated(docs, "text", "source", 900)
    return good.select("doc_id", F.lit("taken").alias("reason")).unionByName(bad.select("doc_id", "reason"))


@query("shard_rows", "WITH n AS (SELECT row_number() OVER (ORDER BY doc_id) AS row, lang, text FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY row) AS nth FROM n WHERE lang IN ('en', 'de', 'fr') AND length(text) > 0) SELECT row, lang AS label, sha256(text) AS sha256 FROM k WHERE nth <= 40")
def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled shards read in order: every row counts, those of other labels are left out, 40 of each class are taken."""
    classes, paths = ["en", "de", "fr"], []
    docs = table(spark, sf_dir, "documents")
    label = F.coalesce(F.array_position(F.array(*map(F.lit, classes)), F.col("lang")) - 1, F.lit(-1))
    image = F.struct(F.col("text").cast("binary").alias("bytes")).alias("image")
    middle = docs.agg(F.percentile_approx("doc_id", 0.4)).first()[0]
    for part in (F.col("doc_id") <= middle, F.col("doc_id") > middle):
        paths.append(shared.new_folder(spark, "shard"))
        docs.filter(part).orderBy("doc_id").select(image, F.when(label >= 0, label).otherwise(len(classes)).alias("label")).write.parquet(paths[-1])
    return ingest.read_shards(spark, paths, classes, 40).select("row", "label", storage.content_hash(F.col("content")).alias("sha256"))


@query("items_to_extract", "WITH d AS (SELECT doc_id, sha256(text) AS sha FROM documents), i AS (SELECT sha, min(doc_id) AS id FROM d WHERE doc_id % 3 <> 0 GROUP BY 1) SELECT d.doc_id, i.id, CASE WHEN i.id IS NULL THEN 'new' WHEN i.id % 2 = 0 THEN 'done' ELSE 'lacking' END AS state FROM d LEFT JOIN i USING (sha)")
def items_to_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch against a store of two thirds of it, half of which has features."""
    batch = table(spark, sf_dir, "documents").select("doc_id", storage.content_hash(F.col("text")).alias("sha256"))
    images = ingest.first_of_each(batch.filter("doc_id % 3 <> 0"), "sha256", "doc_id").select("sha256", F.col("doc_id").alias("id"))
    return ingest.to_extract(batch, images, images.filter("id % 2 = 0").select(F.col("id").alias("image_id"))).select("doc_id", "id", "state")


@query("backfilled_vectors", f"WITH {FEAT} SELECT id, feature, round(v[1], 6) AS first, CAST(len(v) AS INTEGER) AS width FROM feat")
def backfilled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other row has only a JSON map of its vectors, from which the columns are filled."""
    f = features(spark, sf_dir)
    as_json = F.to_json(F.create_map(*[x for name in FEATURES for x in (F.lit(name), F.col(name))]))
    old = f.withColumn("vectors", as_json).withColumns({name: F.when(F.col("id") % 2 == 1, F.col(name)) for name in FEATURES})
    return retrieval.long_features(ingest.backfilled(old), "id").select("id", "feature", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.size("vec").alias("width"))


@query("schema_conform", "SELECT CAST(doc_id AS BIGINT) AS id, sha256(text) AS sha256, CAST(n_chars AS INTEGER) AS size_bytes, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS INTEGER) AS width FROM documents")
def schema_conform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an older version of the table of images in its present one."""
    old = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), storage.content_hash(F.col("text")).alias("sha256"), F.col("n_chars").alias("size_bytes"))
    return conform(old, "images").select("id", "sha256", "size_bytes", "role", "width")


# --- events --------------------------------------------------------------------------------------------------

_SEQ = "seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, CAST(epoch_us(ts) // 1000 - min(epoch_us(ts) // 1000) OVER (PARTITION BY user_id) AS BIGINT) AS at_ms FROM events)"


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.numbered(table(spark, sf_dir, "events"), "user_id", "ts", "event_id")


@query("events_seq", f"WITH {_SEQ} SELECT user_id, event_id, seq, at_ms FROM seq")
def events_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("user_id", "event_id", "seq", "at_ms")


@query("events_sealed", f"WITH {_SEQ}, e AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN seq END) OVER (PARTITION BY user_id) AS last FROM seq) SELECT user_id, event_id, seq, event_type FROM e WHERE last IS NULL OR seq <= last")
def events_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.sealed(_numbered(spark, sf_dir), "user_id", "event_type", ("purchase",)).select("user_id", "event_id", "seq", "event_type")


@query("events_kind_counts", "SELECT event_type, count(*) AS n, event_type IN ('purchase', 'error') AS terminal FROM events GROUP BY 1")
def events_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("terminal", F.col("event_type").isin("purchase", "error"))


@query("stage_order_check", f"WITH {_SEQ}, f AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN seq END) AS a, min(CASE WHEN event_type = 'click' THEN seq END) AS b, min(CASE WHEN event_type = 'purchase' THEN seq END) AS c, count(*) AS n, max(seq) AS top FROM seq GROUP BY 1) SELECT user_id, a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AS complete, coalesce(a < b, FALSE) AND coalesce(b < c, FALSE) AS in_order, n = top AS increasing FROM f")
def stage_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.order_check(_numbered(spark, sf_dir), "user_id", "event_type", ("view", "click", "purchase"))


@query("features_done_check", "WITH k AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS f, event_type FROM events) SELECT user_id, count(DISTINCT CASE WHEN event_type <> 'error' THEN f END) AS n_features, count(DISTINCT CASE WHEN event_type <> 'error' THEN f END) = 6 AS complete FROM k GROUP BY 1")
def features_done_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams for which all six features came, an event's feature being its number's remainder by 6."""
    feature = F.get_json_object("props", "$.k").cast("long") % 6
    return timeline.features_done(table(spark, sf_dir, "events"), "user_id", feature, list(range(6)), F.col("event_type") != "error")


@query("events_closed", f"WITH {_SEQ}, e AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN seq END) OVER (PARTITION BY user_id) AS last FROM seq), k AS (SELECT user_id, seq, event_type AS kind, at_ms FROM e WHERE last IS NULL OR seq <= last) SELECT * FROM k UNION ALL SELECT user_id, max(seq) + 1, 'error', max(at_ms) FROM k GROUP BY 1 HAVING NOT max(kind = 'purchase')")
def events_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timelines sealed by a purchase; the others end with an error."""
    rows = timeline.sealed(_numbered(spark, sf_dir), "user_id", "event_type", ("purchase",)).select("user_id", "seq", F.col("event_type").alias("kind"), F.col("props").alias("payload"), "at_ms")
    return timeline.closed_with_error(rows, "user_id", "boom", ("purchase",)).select("user_id", "seq", "kind", "at_ms")


@query("events_unknown_kinds", "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'signup') GROUP BY 1")
def events_unknown_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.unknown_kinds(table(spark, sf_dir, "events"), "event_type", ("click", "view", "signup"))


@query("streams_retained", "WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN epoch_us(ts) // 1000 END) AS done_ms, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1) SELECT user_id, done_ms - (SELECT max(last_ms) FROM s) AS done_ms FROM s WHERE done_ms IS NULL OR (SELECT max(last_ms) FROM s) - done_ms <= 86400000")
def streams_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that the registry still holds when the newest event comes; when they ended, before that."""
    ms = timeline.millis("ts")
    streams = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "purchase", ms)).alias("done_ms"), F.max(ms).alias("last_ms"))
    now = streams.agg(F.max("last_ms")).first()[0] or 0
    return timeline.retained(streams, now, most_ms=86_400_000).select("user_id", (F.col("done_ms") - now).alias("done_ms"))


@query("events_live_sealed", f"WITH {_SEQ}, e AS (SELECT *, min(CASE WHEN event_type = 'purchase' THEN seq END) OVER (PARTITION BY user_id) AS last FROM seq) SELECT CAST(user_id AS VARCHAR) AS stream_id, seq, event_type AS kind, props AS payload, at_ms FROM e WHERE last IS NULL OR seq <= last")
def events_live_sealed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of ten micro-batches, numbered and sealed as they arrive, from the sink's files."""
    folder = shared.new_folder(spark, "live")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("stream_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("tie"), F.col("event_type").alias("kind"), F.col("props").alias("payload"))
    cuts = rows.agg(F.percentile_approx(timeline.millis("ts"), [k / 10 for k in range(1, 10)])).first()[0] or []
    edges, files = [None, *cuts, None], 2
    for low, high in zip(edges, edges[1:]):  # in order of time, as events arrive
        part = rows if low is None else rows.filter(timeline.millis("ts") > low)
        (part if high is None else part.filter(timeline.millis("ts") <= high)).repartition(files).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema("stream_id string, ts timestamp, tie long, kind string, payload string").option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    sink = live.Live(folder, ("purchase",))
    sink.start(stream, availableNow=True).awaitTermination()
    return sink.out(spark)


# --- plot data -----------------------------------------------------------------------------------------------

_POS = f"WITH {FEAT}, x AS (SELECT id, feature, v, unnest(range(0, len(v))) AS pos FROM feat)"


# The labels of the nine colour moments.
_MOMENTS = ("H mean", "H std", "H skew", "S mean", "S std", "S skew", "V mean", "V std", "V skew")


@query("plot_bars_long", _POS + f" SELECT id, pos::INTEGER AS pos, {list(_MOMENTS)!r}[pos + 1] AS label, round(v[pos + 1], 6) AS value FROM x WHERE feature = 'cm'")
def plot_bars_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots.bars(features(spark, sf_dir), "id", "cm").select("id", "pos", "label", F.round("value", 6).alias("value"))


@query("plot_heatmap_grid", _POS + " SELECT id, (pos // 5)::INTEGER AS row, (pos % 5)::INTEGER AS col, round(v[pos + 1], 6) AS value FROM x WHERE feature = 'glcm'")
def plot_heatmap_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots.grid(features(spark, sf_dir), "id", columns=5).select("id", "row", "col", F.round("value", 6).alias("value"))


@query("plot_subsample", _POS + " SELECT id, (pos // 3)::INTEGER AS nth, pos::INTEGER AS pos, round(v[pos + 1], 6) AS value FROM x WHERE feature = 'hog' AND pos % 3 = 0 AND pos // 3 < 4")
def plot_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plots.subsample(features(spark, sf_dir), "id", most=4).select("id", "nth", "pos", F.round("value", 6).alias("value"))


@query("extract_features_synthetic", "SELECT p_partkey AS id, feature, CAST(width AS INTEGER) AS width, 1.0::DOUBLE AS norm FROM part, (VALUES " + ", ".join(f"('{f}', {n})" for f, n in DIMS.items()) + ") t(feature, width)")
def extract_features_synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six features of one small synthetic image for each part: id, feature, width, norm."""
    from nearfield.operators.extract import extract

    side = 32
    cells = F.sequence(F.lit(0), F.lit(side * side * 3 - 1))
    value = lambda i: F.hex(F.pmod(i * (F.col("p_partkey") % 7 + 1) + F.floor(i / (side * 3)) * 5, F.lit(256)).cast("int"))
    data = F.unhex(F.array_join(F.transform(cells, lambda i: F.lpad(value(i), 2, "0")), ""))
    image = F.struct(F.lit(side).alias("height"), F.lit(side).alias("width"), data.alias("data")).alias("image")
    items = _dealt_parts(spark, sf_dir).select(F.col("p_partkey").alias("id"), image)
    long = retrieval.long_features(extract(items), "id")
    return long.select("id", "feature", F.size("vec").alias("width"), F.round(vectors.norm(F.col("vec").cast("array<double>")), 4).alias("norm"))


def _dealt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' numbers, dealt before images are made of them: a task of its own for every few, as each takes far longer than to
    read, and a table of millions of numbers may be one file that one task reads."""
    return table(spark, sf_dir, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")


_PIXEL = """WITH px AS (SELECT p_partkey AS id, (x * 7 + p_partkey * 3 + y) % 256 AS b, (y * 11 + p_partkey * 5) % 256 AS g, (x * y + p_partkey * 17) % 256 AS r FROM part, range(8) t(x), range(8) u(y)),
m AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM px),
k AS (SELECT *, CASE WHEN v > 0 THEN round_even(255 * 4096.0::DOUBLE / v, 0) ELSE 0 END AS pv, CASE WHEN d > 0 THEN round_even(30 * 4096.0::DOUBLE / d, 0) ELSE 0 END AS pc,
  CASE WHEN v = r THEN g - b WHEN v = g THEN b - r + 2 * d ELSE r - g + 4 * d END AS h0 FROM m),
h AS (SELECT id, CAST(v AS BIGINT) AS v, CAST(floor((d * pv + 2048) / 4096) AS BIGINT) AS s, CAST(floor((h0 * pc + 2048) / 4096) AS BIGINT) AS h FROM k),
hsv AS (SELECT id, CASE WHEN h < 0 THEN h + 180 ELSE h END AS h, s, v FROM h)"""
_MOMENT = ", ".join(f"cbrt(avg(({c} - m{c}) * ({c} - m{c}) * ({c} - m{c}))) AS k{c}, sqrt(avg(({c} - m{c}) * ({c} - m{c}))) AS s{c}, any_value(m{c}) AS m{c}" for c in "hsv")


@query("pixel_features", _PIXEL + f""", mean AS (SELECT *, {", ".join(f"avg({c}) OVER (PARTITION BY id) AS m{c}" for c in "hsv")} FROM hsv),
cm AS (SELECT id, {_MOMENT} FROM mean GROUP BY 1),
w AS (SELECT id, [mh, sh, kh, ms, ss, ks, mv, sv, kv] AS x FROM cm),
c AS (SELECT id, unnest(range(0, 9)) AS pos, x, sqrt(list_inner_product(x, x)) AS n FROM w),
bins AS (SELECT id, (h * 12 // 180) * 64 + (s // 32) * 8 + v // 32 AS pos, count(*) AS k FROM hsv GROUP BY 1, 2),
b AS (SELECT id, pos, k, sqrt(sum(k * k) OVER (PARTITION BY id)) AS n FROM bins)
SELECT id, 'cm' AS feature, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(x[pos + 1] / n AS FLOAT) AS DOUBLE), 4) AS value FROM c
UNION ALL SELECT id, 'hsv', CAST(pos AS INTEGER), round(CAST(CAST(k / n AS FLOAT) AS DOUBLE), 4) FROM b""")
def pixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour moments and the bins of the colour histogram that are not empty, of an image of 8 x 8 for each part."""
    found = _extracted(spark, sf_dir, ("hsv", "cm"))
    long = retrieval.long_features(found, "id", ("cm", "hsv")).select("id", "feature", F.posexplode("vec").alias("pos", "value"))
    return long.filter("feature = 'cm' OR value > 0").select("id", "feature", "pos", F.round(F.col("value").cast("double"), 4).alias("value"))


def _extracted(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """Features of an image of 8 x 8 for each part."""
    from nearfield.operators.extract import extract

    p = F.col("p_partkey")
    part = _dealt_parts(spark, sf_dir)
    value = lambda i, k: [(i % 8) * 7 + p * 3 + F.floor(i / 8), F.floor(i / 8) * 11 + p * 5, (i % 8) * F.floor(i / 8) + p * 17][k]
    byte = lambda v: F.lpad(F.hex((v % 256).cast("int")), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.concat(*[byte(value(i, k)) for k in range(3)])), ""))
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), data.alias("data")).alias("image")
    return extract(part.select(p.alias("id"), image), names=names, prepared=True)


def _corners() -> str:
    """(point, dy, dx, weight) of the pixels that a point of the circle of radius 2 lies between, sixteen points round it."""
    rows = []
    for k in range(16):
        a = 2 * math.pi * k / 16
        y, x = -2 * round(math.sin(a), 10), 2 * round(math.cos(a), 10)
        for dy in (math.floor(y), math.floor(y) + 1):
            for dx in (math.floor(x), math.floor(x) + 1):
                w = (1 - abs(y - dy)) * (1 - abs(x - dx))
                if w > 0:
                    rows.append(f"({k}, {dy}, {dx}, {w!r}::DOUBLE)")
    return ", ".join(rows)


_STEPS = ", ".join(f"({n}, {dy}, {dx})" for n, (dy, dx) in enumerate((dy, dx) for d, r in ((1, 1), (3, 2)) for dy, dx in ((0, d), (r, r), (d, 0), (r, -r))))


@query("pixel_textures", f"""WITH px AS (SELECT p_partkey AS id, x, y, (1868 * ((x * 7 + p_partkey * 3 + y) % 256) + 9617 * ((y * 11 + p_partkey * 5) % 256) + 4899 * ((x * y + p_partkey * 17) % 256) + 8192) >> 14 AS v FROM part, range(8) t(x), range(8) u(y)),
pair AS (SELECT a.id, n, a.v // 8 AS i, b.v // 8 AS j FROM px a, (VALUES {_STEPS}) s(n, dy, dx), px b WHERE b.id = a.id AND b.y = a.y + dy AND b.x = a.x + dx),
twice AS (SELECT id, n, i, j FROM pair UNION ALL SELECT id, n, j, i FROM pair),
m AS (SELECT id, n, i, j, count(*) / sum(count(*)) OVER (PARTITION BY id, n) AS p FROM twice GROUP BY 1, 2, 3, 4),
mu AS (SELECT *, sum(i * p) OVER (PARTITION BY id, n) AS mi FROM m),
g AS (SELECT id, n, sum((i - j) * (i - j) * p) AS f0, sum(abs(i - j) * p) AS f1, sum(p / (1 + (i - j) * (i - j))) AS f2, sqrt(sum(p * p)) AS f3,
  CASE WHEN sum((i - mi) * (i - mi) * p) > 1e-15 THEN sum((i - mi) * (j - mi) * p) / sum((i - mi) * (i - mi) * p) ELSE 1.0 END AS f4 FROM mu GROUP BY 1, 2),
flat AS (SELECT id, 8 * k + n AS pos, CASE k WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN f3 ELSE f4 END AS x FROM g, range(5) t(k)),
around AS (SELECT a.id, a.x, a.y, k, round(sum(coalesce(b.v, 0) * w), 9) >= any_value(a.v) AS bit FROM px a CROSS JOIN (VALUES {_corners()}) c(k, dy, dx, w) LEFT JOIN px b ON b.id = a.id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3, 4),
turn AS (SELECT *, lag(bit) OVER o AS before, last_value(bit) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS at_end FROM around WINDOW o AS (PARTITION BY id, x, y ORDER BY k)),
code AS (SELECT id, x, y, CASE WHEN count(*) FILTER (bit <> coalesce(before, at_end)) <= 2 THEN count(*) FILTER (bit) ELSE 17 END AS pos FROM turn GROUP BY 1, 2, 3),
bins AS (SELECT id, pos, count(*) AS x FROM code GROUP BY 1, 2)
SELECT id, 'glcm' AS feature, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE), 4) AS value FROM flat
UNION ALL SELECT id, 'lbp', CAST(pos AS INTEGER), round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE), 4) FROM bins""")
def pixel_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textures of co-occurring grays, and the binary patterns that occur, of an image of 8 x 8 for each part."""
    long = retrieval.long_features(_extracted(spark, sf_dir, ("lbp", "glcm")), "id", ("glcm", "lbp")).select("id", "feature", F.posexplode("vec").alias("pos", "value"))
    return long.filter("feature = 'glcm' OR value > 0").select("id", "feature", "pos", F.round(F.col("value").cast("double"), 4).alias("value"))
