"""Exact top-k from stored lists: bounds, equal results, what is read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.schema import DEFAULT_WEIGHTS, FEATURES, EmptyCorpusError
from nearfield.functions.weights import normalise
from nearfield.operators import retrieval, threshold


def table(spark, n, groups=0, seed=3, width=6, zeros=0, copies=0):
    rng = np.random.default_rng(seed)
    columns = []
    for i in range(len(FEATURES)):
        v = rng.normal(size=(n, width + i))
        if groups:
            v = rng.normal(size=(groups, width + i))[np.arange(n) % groups] + 0.05 * v
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        v[:zeros] = 0
        if copies:
            v[-copies:] = v[-1]
        columns.append(v)
    rows = [(i, *[c[i].tolist() for c in columns]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{f} array<double>" for f in FEATURES))


def results(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9), *[round(r[f], 9) for f in FEATURES]) for r in df.collect())


@pytest.mark.parametrize("zeros", [0, 3])
def test_no_product_is_above_its_bound(zeros):
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    v, q, centres = unit(rng.normal(size=(400, 5))), unit(rng.normal(size=(50, 5))), unit(rng.normal(size=(7, 5)))
    v[:zeros] = 0
    q[:zeros] = 0
    v[10:20] = q[10:20]
    angles, length = threshold._angles(v, centres)
    at = angles.argmin(1) * threshold.RINGS + (angles.min(1) * 4).astype(int)
    rings = np.unique(at)
    of = lambda fn, x: np.array([fn(x[at == r]) for r in rings])
    head = {"centres": centres, "at": rings, "low": of(np.min, angles.min(1)), "high": of(np.max, angles.min(1)), "shortest": of(np.min, length), "longest": of(np.max, length)}
    best = np.array([[(v[at == r] @ x).max() for r in rings] for x in q])
    top = threshold.highest(q, head)
    assert (top + 1e-12 >= best).all()
    assert (top < 0.9).any()


@pytest.mark.parametrize(("n", "groups", "zeros", "copies", "weights", "k"), [
    (1200, 20, 0, 0, DEFAULT_WEIGHTS, 5), (900, 0, 0, 0, DEFAULT_WEIGHTS, 5), (900, 30, 40, 300, {"hu": 0.7, "hog": 0.3}, 10), (7, 0, 2, 3, {"cm": 1.0}, 10), (1, 0, 0, 0, DEFAULT_WEIGHTS, 3),
])
def test_same_as_a_scan(spark, tmp_path, monkeypatch, n, groups, zeros, copies, weights, k):
    monkeypatch.setattr(threshold, "DEPTH", 16)
    f = table(spark, n, groups, zeros=zeros, copies=copies)
    lists, asks = threshold.Lists(spark, str(tmp_path / "lists")).build(f), f.filter("id % 20 = 0 OR id < 5")
    own = n == 1200
    want = results(retrieval.search(f, asks, weights, k, "exact", exclude_self=own))
    assert want and results(retrieval.search(f, asks, weights, k, "exact", exclude_self=own, lists=lists)) == want


def test_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(threshold, "DEPTH", 32)
    f = table(spark, 4000, 80)
    lists, asks = threshold.Lists(spark, str(tmp_path / "lists")).build(f), f.filter("id % 40 = 0")
    found = lists.search(asks, normalise(None), 5, True)
    looked = [r["looked"] for r in found.select("query_id", "looked").distinct().collect()]
    assert len(looked) == 100 and sum(looked) < 0.25 * 100 * 4000
    scattered = table(spark, 2000, 0, seed=8)
    lists = threshold.Lists(spark, str(tmp_path / "scattered")).build(scattered)
    most = lists.search(scattered.filter("id % 100 = 0"), normalise(None), 5).agg(F.max("looked")).first()[0]
    assert most <= 2000 * (1 + 6 * threshold.SHARE) + 6 * 2 * threshold.RING


def test_a_stored_list_is_read_without_the_corpus(spark, tmp_path):
    f = table(spark, 600, 10).withColumn("widths", F.lit(1)).withColumn("at", F.lit("x"))  # names of the lists' own columns
    threshold.Lists(spark, str(tmp_path / "lists")).build(f.withColumnRenamed("id", "image"), "image")
    again = threshold.Lists(spark, str(tmp_path / "lists"))
    asks = f.filter("id = 40").withColumnRenamed("id", "image")
    got = retrieval.search(f.limit(0), asks, mode="exact", top_k=3, id_col="image", lists=again)
    assert results(got) == results(retrieval.search(f, f.filter("id = 40"), mode="exact", top_k=3))
    assert retrieval.search(f, f.limit(0), mode="exact", lists=again).count() == 0
    twice = retrieval.search(f, asks.unionByName(asks), mode="exact", top_k=3, id_col="image", lists=again)
    assert results(twice) == results(got)


def test_errors(spark, tmp_path):
    f = table(spark, 20)
    lists = threshold.Lists(spark, str(tmp_path / "lists")).build(f)
    with pytest.raises(ValueError):
        lists.build(f)
    with pytest.raises(EmptyCorpusError):
        threshold.Lists(spark, str(tmp_path / "other")).build(f.limit(0))
    for bad in ({"mode": "candidate"}, {"mode": "exact", "role": "corpus"}):
        with pytest.raises(ValueError):
            retrieval.search(f, f, lists=lists, **bad)


def test_what_would_deal_too_much_is_scanned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(threshold, "DEPTH", 16)
    monkeypatch.setattr(threshold, "DEALT", 0)
    met, rounds = threshold.Lists._met, []
    monkeypatch.setattr(threshold.Lists, "_met", lambda self, *a: rounds.append(1) or met(self, *a))
    f = table(spark, 900, 0)
    lists, asks = threshold.Lists(spark, str(tmp_path / "lists")).build(f), f.filter("id % 20 = 0")
    want = results(retrieval.search(f, asks, None, 5, "exact", exclude_self=True))
    assert want and results(retrieval.search(f, asks, None, 5, "exact", exclude_self=True, lists=lists)) == want
    assert len(rounds) == 1  # vectors were dealt to rings once
