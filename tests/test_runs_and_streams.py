"""Stored runs and evaluations, snapshots, blobs and shards."""

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import schema
from nearfield.functions.schema import DEFAULT_WEIGHTS, EVALUATION_RUNS, FEATURES, SEARCH_RUNS, EvaluationError, NoStashError
from nearfield.operators import evaluate, retrieval, runs, shared, snapshot
from nearfield.sources import ingest
from nearfield.streaming import events


def items(spark, n, width=4, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6, width))
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    rows = [(i, f"l{i % 3}", *[list(map(float, x)) for x in v[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label string, " + ", ".join(f"{f} array<double>" for f in FEATURES))


def test_runs_are_recorded_and_ranked_anew(spark, tmp_path):
    f, path = items(spark, 30), str(tmp_path / "runs")
    stages = runs.Stages()
    with stages.stage("extract", {"dims": {"hsv": 4}}):
        pass
    sub = retrieval.candidates(f, f.filter("id < 3"), DEFAULT_WEIGHTS, 5, exclude_self=True)
    runs.save(runs.recorded(sub, {"hog": 1}, 4, stages), path)
    stored = spark.read.schema(SEARCH_RUNS).parquet(path)
    one = stored.filter("id = 1").first()
    assert [s["name"] for s in one["pipeline_trace"]] == ["extract", runs.STASH] and len(one["results"]) == 4 and one["version"] == 1
    sims = [r["per_feature"]["hog"] for r in one["results"]]
    assert sims == sorted(sims, reverse=True) and [r["score"] for r in one["results"]] == pytest.approx(sims)
    assert runs.candidates_of(stored).count() == sub.count()
    want = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.search(f, f.filter("id < 3"), {"hu": 1}, 4, exclude_self=True).collect()}
    assert {(r["query_id"], r["rank"]): r["id"] for r in runs.rerank(runs.candidates_of(stored), {"hu": 1}, 4).collect()} == want
    trace = json.loads(stored.filter("id = 1").select(runs.trace_json(F.col("pipeline_trace"))).first()[0])
    assert trace[0]["detail"]["dims"] == {"hsv": 4} and sorted(trace[1]["detail"]) == ["image_ids", "scores"]
    assert json.loads(stored.filter("id = 1").select(runs.results_json(F.col("results"))).first()[0])[0]["rank"] == 1
    first = runs.rerank_run(spark, path, 1, {"hu": 1}, 2).first()
    again = runs.rerank_run(spark, path, 1, {"cm": 1}, 3).first()
    assert first["version"] == 2 and again["version"] == 3 and len(again["results"]) == 3
    assert [s["name"] for s in again["pipeline_trace"]] == ["extract", "rerank", "rerank", runs.STASH]
    detail = json.loads(again["pipeline_trace"][2]["detail"])
    assert detail["top_k"] == 3 and detail["previous_weights"]["hu"] == 1


def test_runs_ranked_anew_at_the_same_time_are_versions_of_their_own(spark, tmp_path):
    f, path = items(spark, 20), str(tmp_path / "runs")
    runs.save(runs.recorded(retrieval.candidates(f, f.filter("id < 2"), DEFAULT_WEIGHTS, 5, exclude_self=True), None, 4), path)
    weights = [{"hog": 1.0, "hu": k / 10} for k in range(8)]
    with ThreadPoolExecutor(8) as pool:
        got = list(pool.map(lambda w: runs.rerank_run(spark, path, 1, w, 3).first(), weights))
    assert sorted(r["version"] for r in got) == list(range(2, 10))
    stored = {r["version"]: r["weights"] for r in spark.read.parquet(path).filter("id = 1").collect()}
    assert sorted(stored) == list(range(1, 10)) and all(stored[r["version"]] == r["weights"] for r in got)
    assert {round(r["weights"]["hu"] / r["weights"]["hog"], 6) for r in got} == {k / 10 for k in range(8)}
    assert spark.read.parquet(path).filter("id = 0").count() == 1 and not list((tmp_path / "runs").glob("_staged*"))


def test_runs_without_a_stash_are_refused(spark, tmp_path):
    path = str(tmp_path / "runs")
    bad = ([], [("extract", 1, "{}")], [(runs.STASH, 0, '{"image_ids": "bad", "scores": {}}')], [(runs.STASH, 0, '{"image_ids": [1], "scores": {"hsv": null}}')])
    runs.save(spark.createDataFrame([(i, 1, None, DEFAULT_WEIGHTS, [], t, 5, None) for i, t in enumerate(bad)], SEARCH_RUNS), path)
    for i in range(len(bad)):
        with pytest.raises(NoStashError):
            runs.rerank_run(spark, path, i, {}, 1)
    assert runs.candidates_of(spark.read.parquet(path)).count() == 0


def test_evaluations_are_stored(spark, tmp_path):
    f = items(spark, 24)
    row = evaluate.evaluated(f, "id", "label", weights={"hsv": 1}, top_k=3).first()
    assert row["ablation"] is None and sorted(json.loads(row["per_class"])) == ["l0", "l1", "l2"]
    got = json.loads(row["per_class"])["l0"]
    hits = evaluate.leave_one_out(f, "id", "label", {"base": {"hsv": 1.0}}, 3)
    want = evaluate.per_class(evaluate.query_metrics(hits, evaluate.class_sizes(f, "label"), 3)).filter("query_label = 'l0'").first()
    assert got["precision_at_k"] == pytest.approx(want["precision"]) and got["map_at_k"] == pytest.approx(want["map"]) and got["n_queries"] == 8
    row = evaluate.evaluated(f, "id", "label", "ablation", top_k=4).first()
    found = json.loads(row["ablation"])
    assert row["per_class"] is None and found["top_k"] == 4 and sorted(found["variants"]) == sorted(f"minus_{x}" for x in FEATURES)
    assert found["base"]["method"] == "default" and found["variants"]["minus_hu"]["weights"]["hu"] == 0 and sum(found["variants"]["minus_hu"]["weights"].values()) == pytest.approx(1)
    for few in (f.limit(1), f.filter("label = 'l1'")):
        with pytest.raises(EvaluationError):
            evaluate.evaluated(few, "id", "label")


def test_both_kinds_of_evaluations_share_a_search(spark, monkeypatch):
    from nearfield.plans import queries

    calls, real = [], evaluate._hits_of
    monkeypatch.setattr(evaluate, "_hits_of", lambda *a: calls.append(a) or real(*a))
    monkeypatch.setattr(queries, "features", lambda *_: items(spark, 24))
    rows = queries.evaluation_runs(spark, "").collect()
    assert len(calls) == 1 and len(rows) == 3 + 7 * 4
    each = {(r["method"], r["variant"], r["label"]): (r["precision"], r["map"]) for r in rows}
    assert all(each["default", "default", x] == each["ablation", "default", x] for x in ("l0", "l1", "l2"))


def test_leave_one_out_over_many_blocks(spark, monkeypatch):
    from nearfield.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 4)
    f = items(spark, 30, seed=5).repartition(3)
    rows = {r["id"]: (r["label"], np.concatenate([np.sqrt(DEFAULT_WEIGHTS[x]) * np.array(r[x]) for x in FEATURES])) for r in f.collect()}
    for q, hits in _by_query(evaluate.leave_one_out(f, "id", "label", evaluate.BASE, 6)).items():
        order = sorted((i for i in rows if i != q), key=lambda i: (-round(float(rows[i][1] @ rows[q][1]), 10), i))[:6]
        assert [h["id"] for h in hits] == order and [h["rel"] for h in hits] == [int(rows[i][0] == rows[q][0]) for i in order]


def _by_query(hits):
    out = {}
    for r in sorted(hits.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append(r)
    return out


def test_labelled_snapshot_refuses_bad_vectors(spark, tmp_path):
    f = items(spark, 5)
    assert evaluate.labelled(f.drop("label"), f.select("id", "label"), "id", "label", dict.fromkeys(FEATURES, 4)).count() == 5
    with pytest.raises(Exception, match="wrong width"):
        evaluate.labelled(f.drop("label"), f.select("id", "label"), "id", "label", dict.fromkeys(FEATURES, 5)).collect()


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "features")
    items(spark, 6).drop("label").write.parquet(path)
    kept = snapshot.Snapshots(spark, 10, dict.fromkeys(FEATURES, 4))
    one = kept.get(path, "id")
    assert one.count() == 6 and kept.get(path, "id") is one
    kept.mark_dirty(path)
    two = kept.get(path, "id")
    assert two is not one
    items(spark, 3, seed=2).drop("label").write.mode("append").parquet(path)
    assert kept.get(path, "id").count() == 9  # the table has changed
    items(spark, 3, seed=3).drop("label").write.mode("append").parquet(path)
    assert kept.get(path, "id") is None  # too large now
    kept.reset()
    assert not kept.kept
    with pytest.raises(Exception, match="wrong width"):
        snapshot.Snapshots(spark, 99, dict.fromkeys(FEATURES, 7)).get(path, "id").collect()


def test_row_numbers(spark):
    rows = [(i % 7 if i % 5 else None, (i * 37) % 101, i) for i in range(400)]
    df = spark.createDataFrame(rows, "g int, o int, i int")
    got = {r["i"]: r["seq"] for r in shared.row_numbers(df, ["g"], ["o", "i"]).collect()}
    groups = {}
    for g, o, i in rows:
        groups.setdefault(g, []).append((o, i))
    assert got == {i: k + 1 for g in groups.values() for k, (_, i) in enumerate(sorted(g))}
    assert shared.row_numbers(df.limit(0), ["g"], ["o"]).count() == 0


def test_stream_ids_and_kinds(spark):
    ids = [r["x"] for r in spark.range(50).select(events.new_stream_id().alias("x")).collect()]
    assert len(set(ids)) == 50 and all(len(x) == 32 and int(x, 16) >= 0 for x in ids)
    df = spark.createDataFrame([("stage.start",), ("bogus",), (None,), ("error",)], "kind string")
    assert {r["kind"]: r["n"] for r in events.unknown_kinds(df).collect()} == {"bogus": 1, None: 1}
    streams = spark.createDataFrame([("a", None), ("b", 40_000), ("c", 39_999)], "id string, done_ms long")
    assert {r["id"] for r in events.retained(streams, 100_000).collect()} == {"a", "b"}


def test_blobs(spark, tmp_path):
    rows = spark.createDataFrame([("originals/cat/a.jpg", bytearray(b"one")), ("originals/dog/b.png", bytearray(b"two")), ("originals/dog/e.png", None)], "storage_path string, content binary")
    root = str(tmp_path / "blobs")
    assert {r["written"] for r in ingest.write_blobs(rows, root).collect()} == {True}
    assert (tmp_path / "blobs/originals/dog/b.png").read_bytes() == b"two" and not list((tmp_path / "blobs").rglob("*.part"))
    again = rows.withColumn("content", F.when(F.col("storage_path").endswith("b.png"), F.lit("longer").cast("binary")).otherwise(F.col("content")))
    assert {r["path"]: r["written"] for r in ingest.write_blobs(again, root).collect()} == {"originals/cat/a.jpg": False, "originals/dog/b.png": True, "originals/dog/e.png": False}
    with pytest.raises(Exception, match="not a path inside"):
        ingest.write_blobs(spark.createDataFrame([("../x", bytearray(b"y"))], "storage_path string, content binary"), root).collect()


def test_shards(spark, tmp_path):
    kind = "image struct<bytes: binary, path: string>, label int"
    shards = ([(0, b"a"), (1, b"b"), (7, b"c"), (0, b"")], [(1, b"d"), (None, b"e"), (0, b"f"), (0, b"g")])
    paths = []
    for i, rows in enumerate(shards):
        paths.append(str(tmp_path / f"z{1 - i}"))  # in the order given, not that of names
        spark.createDataFrame([((bytearray(b), ""), k) for k, b in rows], kind).coalesce(1).write.parquet(paths[-1])
    files = [next(str(x) for x in (tmp_path / p.rsplit("/", 1)[1]).glob("*.parquet")) for p in paths]
    for source in (files, paths):
        got = sorted((r["row"], r["label"], bytes(r["content"])) for r in ingest.read_shards(spark, source, ["cat", "dog"]).collect())
        assert got == [(1, "cat", b"a"), (2, "dog", b"b"), (5, "dog", b"d"), (7, "cat", b"f"), (8, "cat", b"g")]
    capped = sorted(r["row"] for r in ingest.read_shards(spark, files, ["cat", "dog"], 1).collect())
    assert capped == [1, 2]


def test_store_and_backfill(spark):
    batch = spark.createDataFrame([("x",), ("y",), ("z",)], "sha256 string")
    images = spark.createDataFrame([(1, "x"), (2, "y")], "id long, sha256 string")
    features = spark.createDataFrame([(1,)], "image_id long")
    assert {r["sha256"]: (r["id"], r["state"]) for r in ingest.to_extract(batch, images, features).collect()} == {"x": (1, "done"), "y": (2, "lacking"), "z": (None, "new")}
    new, known = ingest.against_store(batch, images)
    assert [r["sha256"] for r in new.collect()] == ["z"] and known.count() == 2
    old = spark.createDataFrame([(1, '{"hsv": [1.0], "hu": [2.0]}', None), (2, '{"hsv": [1.0]}', [9.0]), (3, None, None)], "id long, vectors string, hsv array<double>")
    got = {r["id"]: (r["hsv"], r["hu"], r["cm"]) for r in ingest.backfilled(old).collect()}
    assert got == {1: ([1.0], [2.0], None), 2: ([9.0], None, None), 3: (None, None, None)}


def test_tables_conform(spark):
    old = spark.createDataFrame([(5, "s")], "id int, sha256 string")
    row = schema.conform(old, "images")
    assert row.schema == spark.createDataFrame([], schema.IMAGES).schema and row.first()["role"] is None
    assert schema.conform(spark.createDataFrame([(1,)], "id long"), "search_runs").first()["version"] == 1
    with pytest.raises(schema.SchemaError):
        schema.conform(old.withColumn("other", F.lit(1)), "images")


def test_sql_functions(spark):
    from nearfield.functions import vectors

    vectors.register(spark)
    got = spark.sql("SELECT cosine_sim(array(1D, 0D), array(2D, 0D)) a, cosine_sim(array(0D), array(1D)) b, l2_normalize(array(3D, 4D)) c, l2_normalize(array(0D)) d, fuse(map('hu', 0.5D), map('hu', 0.4D, 'cm', 1D)) e").first()
    assert (got["a"], got["b"], got["c"], got["d"], got["e"]) == (1.0, 0.0, [0.6, 0.8], [0.0], pytest.approx(0.2))
