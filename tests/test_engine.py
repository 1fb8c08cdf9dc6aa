import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import kernels, storage, weights
from nearfield.functions.schema import DEFAULT_WEIGHTS, DIMS, FEATURES, EmptyCorpusError
from nearfield.operators import evaluate, retrieval, runs
from nearfield.sources import ingest
from nearfield.streaming import events


def test_weights():
    w = weights.normalise({"hsv": 0.4, "hog": -0.1, "bogus": 0.5, "cm": 0.6})
    assert w["hsv"] == pytest.approx(0.4) and w["cm"] == pytest.approx(0.6) and sum(w.values()) == pytest.approx(1)
    assert weights.normalise({}) == weights.normalise({"hsv": 0.0}) == DEFAULT_WEIGHTS
    assert weights.parse("  ") is None and weights.parse('{"hu": "1"}') == {"hu": 1.0}
    assert weights.without("hog")["hsv"] == pytest.approx(0.2 / 0.75)
    for bad in ("{not-json", "[1]", '{"a": "x"}'):
        with pytest.raises(ValueError):
            weights.parse(bad)
    with pytest.raises(ValueError):
        weights.normalise({"hu": math.nan})


def test_metrics():
    assert evaluate.precision_at_k([1, 1, 1, 0], 4) == 0.75 and evaluate.precision_at_k([], 5) == evaluate.precision_at_k([1], 0) == 0
    assert evaluate.average_precision_at_k([1, 0, 1, 0, 1], 3, 5) == pytest.approx(0.755556, abs=1e-6)
    assert evaluate.average_precision_at_k([1], 0, 5) == 0


def items(spark, vecs, labels=None):
    rows = [(i, (labels or ["x"] * len(vecs))[i], *[v] * 6) for i, v in enumerate(vecs)]
    return spark.createDataFrame(rows, "id long, label string, " + ", ".join(f"{f} array<double>" for f in FEATURES))


def test_ties_go_to_the_lower_id_and_modes_agree(spark):
    f = items(spark, [[1.0, 0.0]] * 7)
    a = retrieval.search(f, f.filter("id = 3"), top_k=4)
    b = retrieval.search(f, f.filter("id = 3"), top_k=4, mode="exact")
    assert [r["id"] for r in a.orderBy("rank").collect()] == [r["id"] for r in b.orderBy("rank").collect()] == [0, 1, 2, 3]
    with pytest.raises(EmptyCorpusError):
        retrieval.search(f.filter("id < 0"), f)
    with pytest.raises(ValueError):
        retrieval.search(f, f, top_k=51)


def test_small_corpus_never_counts_itself(spark):
    f = items(spark, [[1.0, 0.0]] * 3 + [[0.0, 1.0]] * 3 + [[0.6, 0.8]], ["cat"] * 3 + ["dog"] * 3 + ["fox"])
    hits = evaluate.leave_one_out(f, "id", "label", evaluate.BASE, 10)
    got = evaluate.overall(evaluate.query_metrics(hits, evaluate.class_sizes(f, "label"), 10)).first()
    assert got["n_queries"] == 6 and got["map"] == pytest.approx(1.0) and got["precision"] == pytest.approx(2 / 6)


def test_rerank_and_stash(spark):
    rows = [(1, i, *[x if f == "hsv" else y if f == "hog" else 0.0 for f in FEATURES]) for i, x, y in ((10, 0.9, 0.1), (20, 0.1, 0.1), (30, 0.1, 0.9))]
    sub = spark.createDataFrame(rows, "query_id long, id long, " + ", ".join(f"{f} double" for f in FEATURES))
    back = runs.parse_stash(runs.stash(sub))
    assert [r["id"] for r in runs.rerank(back, {"hsv": 1}, 2).orderBy("rank").collect()] == [10, 20]
    assert runs.rerank(back, {"hog": 1}, 2).orderBy("rank").first()["id"] == 30


def test_stored_run_versions(spark, tmp_path):
    from nearfield.functions.schema import SEARCH_RUNS

    sub = spark.createDataFrame([(1, 10, *[0.5] * 6), (1, 20, *[0.4] * 6)], "query_id long, id long, " + ", ".join(f"{f} double" for f in FEATURES))
    detail = runs.stash(sub).first()["detail"]
    trace = [("extract", 1, '{"dims": {"hsv": 768}}'), (runs.STASH, 0, detail)]
    runs.save(spark.createDataFrame([(1, 1, None, DEFAULT_WEIGHTS, [], trace, 5, None)], SEARCH_RUNS), str(tmp_path / "runs"))
    new = runs.rerank_run(spark, str(tmp_path / "runs"), 1, {"hu": 1}, 1).first()
    assert new["version"] == 2 and [s["name"] for s in new["pipeline_trace"]] == ["extract", "rerank", runs.STASH] and new["results"][0]["image_id"] == 10
    with pytest.raises(KeyError):
        runs.rerank_run(spark, str(tmp_path / "runs"), 9, {}, 1)


def test_names(spark):
    df = spark.createDataFrame([("  Red Fox!! ", "x.JPG"), ("!!", "x.exe"), ("a", "none")], "label string, name string")
    got = df.select(storage.slug(F.col("label")).alias("s"), storage.safe_extension(F.col("name")).alias("e")).collect()
    assert [tuple(r) for r in got] == [("red_fox", "jpg"), (None, "bin"), ("a", "bin")]
    paths = spark.createDataFrame([("../../etc/passwd",), ("/a",), ("a/b..c",)], "p string").select(storage.is_inside(F.col("p")).alias("x"))
    assert [r["x"] for r in paths.collect()] == [False, False, True]


def test_statuses_and_dense_ids(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "empty")], "id0 long, sha string, reason string")
    assert {r["id0"]: r["status"] for r in ingest.statuses(df, "sha", "id0", "reason").collect()} == {1: "inserted", 2: "deduped", 3: "failed"}
    ids = [r["id"] for r in ingest.numbered(spark.range(0, 50).withColumnRenamed("id", "k"), "k", 5).orderBy("k").collect()]
    assert ids == list(range(6, 56))


def test_timelines(spark):
    rows = [("s", 1, "stage.start"), ("s", 2, "rank.done"), ("s", 3, "stage.start"), ("t", 1, "stage.start")]
    df = spark.createDataFrame(rows, "stream_id string, k int, kind string").withColumn("ts", F.timestamp_seconds("k"))
    sealed = events.sealed(events.numbered(df, "stream_id", "ts", "k"), "stream_id")
    assert sealed.filter("stream_id = 's'").count() == 2
    closed = events.closed_with_error(sealed.select("stream_id", "seq", "kind", F.lit("").alias("payload"), "at_ms"), "stream_id", "boom")
    assert [(r["stream_id"], r["seq"]) for r in closed.filter("kind = 'error'").collect()] == [("t", 2)]


def test_kernels():
    y, x = np.mgrid[:256, :256]
    img = np.stack([x, y, x + y], -1).astype(np.uint8)
    small = kernels.preprocess(img)
    assert small.shape == (128, 128, 3) and small.dtype == np.uint8
    for name, v in kernels.extract_all(small).items():
        assert v.shape == (DIMS[name],) and v.dtype == np.float32 and abs(np.linalg.norm(v) - 1) < 1e-5
        assert (v == kernels.EXTRACTORS[name](small)).all()
    flat = np.full((128, 128, 3), 90, np.uint8)
    assert not kernels.hog(flat).any() and (kernels.hsv_histogram(flat) > 0).sum() == 1
    t = kernels.glcm_textures(flat).reshape(5, 8)
    assert not t[:2].any() and np.allclose(t[2:], t[2, 0])
    for bad in (img[..., 0], img.astype(float)):
        with pytest.raises(ValueError):
            kernels.preprocess(bad)
    with pytest.raises(ValueError):
        kernels.hog(img)


def test_blocks_agree_with_brute_force(spark, monkeypatch):
    from nearfield.operators import blocks

    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(60, 4))
    vecs = np.vstack([vecs, vecs[:20], np.zeros((1, 4))])  # ties, and a vector that is like nothing
    vecs[:-1] /= np.linalg.norm(vecs[:-1], axis=1, keepdims=True)
    f = items(spark, [list(map(float, v)) for v in vecs], [str(i % 3) for i in range(len(vecs))]).repartition(4)
    monkeypatch.setattr(blocks, "SENT_BYTES", 0)  # as with a query set too large to broadcast
    for mode in ("exact", "candidate"):
        got = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.search(f, f.filter("id % 20 = 0"), top_k=9, mode=mode, exclude_self=True).collect()}
        for q in range(0, len(vecs), 20):
            sim = [float(sum(a * b for a, b in zip(v, vecs[q], strict=True))) for v in vecs]
            order = sorted((i for i in range(len(vecs)) if i != q), key=lambda i: (-round(sim[i], 12), i))
            assert [got[q, k + 1] for k in range(9)] == order[:9]
    sums = {(r["left_label"], r["right_label"]): r["n"] for r in evaluate.label_pairs(f, "id", "label", DEFAULT_WEIGHTS).collect()}
    assert sum(sums.values()) == len(vecs) * (len(vecs) - 1) and sums["0", "1"] == 27 * 27


def test_blocks_refuse_missing_vectors(spark):
    f = spark.createDataFrame([(1, [1.0]), (2, None)], "id long, vec array<double>")
    with pytest.raises(Exception, match="missing or differ in width"):
        retrieval.nearest(f, f.filter("id = 1"), 1, feature_names=("vec",)).collect()
