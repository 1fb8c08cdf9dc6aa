"""Searches gather the best hits of a task, however many blocks meet in it."""

import numpy as np

from nearfield.functions.schema import DEFAULT_WEIGHTS
from nearfield.operators import blocks, retrieval


def vectors(spark, n):
    v = np.random.default_rng(5).normal(size=(n, 4))
    v[n // 2 :] = v[: n - n // 2]  # every vector twice
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, *[x.tolist()] * 6) for i, x in enumerate(v)]
    return v, spark.createDataFrame(rows, "id long, hsv array<double>, cm array<double>, lbp array<double>, glcm array<double>, hog array<double>, hu array<double>").repartition(3)


def test_a_task_leaves_k_hits_whatever_it_meets(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 8)
    monkeypatch.setattr(blocks, "PAIRS", 7)
    v, f = vectors(spark, 200)
    asked = f.filter("id % 20 = 0")
    for name, (meet, told), schema, size in (
        ("nearest", retrieval.nearest_of(3, True, ("hsv",)), retrieval.HITS, "size(hits)"),
        ("fused", retrieval.fused_of(DEFAULT_WEIGHTS, 3, True), retrieval.FUSED_HITS, "1"),
    ):
        met = blocks.pairs(asked, f, "id", ("hsv",) if name == "nearest" else retrieval.FEATURES)
        left = blocks.gathered(met, meet, told, schema).selectExpr(f"sum({size}) AS n").first()["n"]
        assert 10 * 3 <= left <= 10 * 3 * 3, name  # ten queries, three hits, three tasks
    for held in (384 << 20, 0):  # with no room hits are told block by block
        monkeypatch.setattr(blocks, "HELD_BYTES", held)
        for found in (retrieval.nearest(f, asked, 3, True, feature_names=("hsv",)), retrieval.search(f, asked, top_k=3, mode="exact", exclude_self=True).withColumnRenamed("rank", "place")):
            got = {(r["query_id"], r["place"]): r["id"] for r in found.collect()}
            for q in range(0, 200, 20):
                order = sorted((i for i in range(200) if i != q), key=lambda i: (-round(float(v[i] @ v[q]), 12), i))  # noqa: B023
                assert [got[q, p + 1] for p in range(3)] == order[:3]
