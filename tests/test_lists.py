"""Searches give a row for each query, which Spark neither sorts nor hashes to rank, store or rank anew."""

import re

import numpy as np
from pyspark.sql import functions as F

from nearfield.functions.schema import DEFAULT_WEIGHTS, FEATURES, SEARCH_RUNS
from nearfield.operators import ann, retrieval, runs

HOLDS_ROWS = r"\b(Sort|SortAggregate|HashAggregate|ObjectHashAggregate|Window|SortMergeJoin)\b"


def items(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 6, 3))
    v[n // 2 :] = v[: n - n // 2]  # every item twice
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    rows = [(i, *[x.tolist() for x in v[i]]) for i in range(n)]
    return v, spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} array<double>" for f in FEATURES)).repartition(3)


def held(df):
    return re.findall(HOLDS_ROWS, df._jdf.queryExecution().executedPlan().toString())


def test_tasks_hold_hits_of_their_own_queries_only(spark, monkeypatch):
    v, f = items(spark, 200)
    asked = f.filter("id % 20 = 0")
    assert not held(retrieval.nearest(f, asked, 7, True)) and not held(retrieval.search(f, asked, exclude_self=True))
    for waiting, told in ((1 << 20, 256), (1, 1)):  # sorted in at the end, or with each batch
        monkeypatch.setattr(retrieval, "WAITING", waiting)
        monkeypatch.setattr(retrieval, "TOLD", told)
        near = {(r["query_id"], r["feature"], r["place"]): r["id"] for r in retrieval.nearest(f, asked, 7, True).collect()}
        some = retrieval.lists_of(retrieval.near_hits(f, asked, 7, True), 7, missing=None).collect()
        found = {r["query_id"]: r["found"] for r in retrieval.candidate_lists(f, asked, candidate_k=7, exclude_self=True).collect()}
        top = {(r["query_id"], r["rank"]): r["id"] for r in retrieval.search(f, asked, top_k=4, candidate_k=7, exclude_self=True).collect()}
        assert len(some) == len(found) == 10 and len(near) == 10 * 6 * 7
        for r in some:
            q, union, score = r["query_id"], {}, {}
            for n, name in enumerate(FEATURES):
                order = sorted((i for i in range(200) if i != q), key=lambda i: (-round(float(v[i, n] @ v[q, n]), 12), i))[:7]  # noqa: B023
                assert [near[q, name, p + 1] for p in range(7)] == order
                for i in order:
                    union.setdefault(i, {})[name] = float(v[i, n] @ v[q, n])
            assert [e["id"] for e in r["found"]] == [e["id"] for e in found[q]] == sorted(union)
            for e, full in zip(r["found"], found[q]):
                for name in FEATURES:
                    want = union[e["id"]].get(name)
                    assert (e[name] is None) == (want is None) and abs(full[name] - (want or 0.0)) < 1e-12
                score[e["id"]] = sum(DEFAULT_WEIGHTS[n] * (e[n] or 0.0) for n in FEATURES)
            assert [top[q, p + 1] for p in range(4)] == sorted(score, key=lambda i: (-round(score[i], 12), i))[:4]  # noqa: B023


def test_runs_are_stored_and_ranked_anew_query_by_query(spark, tmp_path):
    _, f = items(spark, 60)
    lists, path = retrieval.candidate_lists(f, f.filter("id % 20 = 0"), candidate_k=9, exclude_self=True), str(tmp_path / "runs")
    rows = lists.select("query_id", F.inline("found"))
    of_lists, of_rows = runs.recorded(lists, {"hog": 1}, 4, created="2026-01-01"), runs.recorded(rows, {"hog": 1}, 4, created="2026-01-01")
    assert not held(of_lists) and sorted(map(str, of_lists.collect())) == sorted(map(str, of_rows.collect()))
    runs.save(of_lists, path)
    stored = runs.current(spark.read.schema(SEARCH_RUNS).parquet(path))
    back = runs.candidate_lists_of(stored)
    again = runs.rerank(back, {"hu": 1}, 3)
    flips = runs.flips(back, {"hu": 1}, 3, None, 5)
    assert not held(stored) and not held(again) and not held(flips)
    assert sorted(back.select("query_id", F.inline("found")).collect()) == sorted(rows.collect())
    by_rows = runs.rerank(rows, {"hu": 1}, 3)
    assert sorted(again.select(by_rows.columns).collect()) == sorted(by_rows.collect())
    old = runs.rerank(rows, None, 5).select("query_id", "id", F.col("rank").alias("old_rank"))
    want = by_rows.select("query_id", "id", F.col("rank").alias("new_rank")).join(old, ["query_id", "id"], "left")
    assert sorted(map(str, flips.collect())) == sorted(map(str, want.collect())) and flips.filter("old_rank IS NULL").count()


def test_the_latest_of_several_versions_and_single_ones(spark, tmp_path):
    _, f = items(spark, 60)
    path = str(tmp_path / "runs")
    runs.save(runs.recorded(retrieval.candidate_lists(f, f.filter("id % 20 = 0"), exclude_self=True), None, 4), path)
    runs.rerank_run(spark, path, 20, {"hu": 1}, 2)
    got = runs.current(spark.read.schema(SEARCH_RUNS).parquet(path)).collect()
    assert sorted((r["id"], r["version"], len(r["results"])) for r in got) == [(0, 1, 4), (20, 2, 2), (40, 1, 4)]


def test_recall_is_counted_where_hits_meet(spark, tmp_path):
    _, f = items(spark, 200)
    asked = f.filter("id % 20 = 0")
    index = ann.Index(spark, str(tmp_path / "index")).build(f)
    walked, exact = index.walked(asked, 20, True, ef_search=21), retrieval.near_hits(f, asked, 20, True)
    parts = ann.recall_of(walked.filter("feature <> 'hu' OR query_id < 100"), exact, 20)
    assert "Join" not in re.sub("BroadcastHashJoin|BroadcastNestedLoopJoin", "", parts._jdf.queryExecution().executedPlan().toString())
    want = ann.recall(index.nearest(asked, 20, True, ef_search=21).filter("feature <> 'hu' OR query_id < 100"), retrieval.nearest(f, asked, 20, True))
    got = sorted(map(tuple, parts.select(want.columns).collect()))
    assert got == sorted(map(tuple, want.collect()))
    assert {r[0]: r[1] for r in got} == dict.fromkeys(FEATURES, 200) and 80 < {r[0]: r[2] for r in got}["hu"] <= 100  # half of its queries
