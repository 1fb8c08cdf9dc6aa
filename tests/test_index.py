"""Stored indexes: graphs, walks, cells; what searches read and find; rows added, versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.schema import FEATURES, EmptyCorpusError
from nearfield.operators import ann, retrieval


def unit(n, width, seed=1, groups=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, width))
    if groups:
        v = rng.normal(size=(groups, width))[np.arange(n) % groups] + 0.2 * v
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def table(spark, n, width=6, seed=1, names=("hsv", "hu"), start=0, groups=0):
    v = [unit(n, width + i, seed + i, groups) for i in range(len(names))]
    return spark.createDataFrame([(start + i, *[list(map(float, x[i])) for x in v]) for i in range(n)], "id long, " + ", ".join(f"{f} array<double>" for f in names))


@pytest.mark.parametrize(("n", "width", "groups"), [(1, 3, 0), (2, 3, 0), (17, 3, 0), (40, 5, 0), (1500, 8, 0), (900, 12, 7)])
def test_graphs(n, width, groups):
    v = unit(n, width, groups=groups)
    links, entries = ann.linked(v)
    assert links.shape[0] == n and links.max(initial=-1) < n and not (links == np.arange(n)[:, None]).any()
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in links)
    reached, front = set(), set(entries.tolist())
    while front:
        reached |= front
        front = {int(x) for i in front for x in links[i] if x >= 0} - reached
    assert len(reached) == n
    q = unit(30, width, seed=9)
    beam, seen = ann.walk(q, v, links, entries, 64)
    exact = np.argsort(-(q @ v.T), axis=1)[:, :20]
    found = sum(len(set(b) & set(e)) for b, e in zip(beam, exact, strict=True))
    assert found >= 0.97 * exact.size
    assert n < 1000 or seen.mean() < 0.45
    beam, seen = ann.walk(q, v, links, entries, n)  # nothing is left out when all nodes are kept
    assert seen.all() and (np.sort(beam, axis=1) == np.arange(n)).all()


def test_equal_vectors_are_all_found():
    v = np.repeat(unit(3, 4), 50, axis=0)
    links, entries = ann.linked(v)
    assert ann.walk(v[:1], v, links, entries, 150)[1].all()


def test_a_stored_index_is_searched_without_the_corpus(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "PART", 128)
    f = table(spark, 1500)
    index = ann.Index(spark, str(tmp_path / "index"), features=("hsv", "hu")).build(f)
    with pytest.raises(ValueError):
        index.build(f)
    asks = f.filter("id % 20 = 0")
    exact = retrieval.nearest(f, asks, 50, exclude_self=True, feature_names=("hsv", "hu"))
    again = ann.Index(spark, str(tmp_path / "index"), features=("hsv", "hu"))  # of another session
    for r in ann.recall(again.nearest(asks, 50, exclude_self=True), exact).collect():
        assert r["n_exact"] == 75 * 50 and r["recall"] >= 0.95
    every = {(r["query_id"], r["feature"], r["place"]): (r["id"], round(r["sim"], 9)) for r in again.nearest(asks, 50, exclude_self=True, ef_search=1500, probes=10**6).collect()}
    assert every == {(r["query_id"], r["feature"], r["place"]): (r["id"], round(r["sim"], 9)) for r in exact.collect()}
    # Few cells are read, and of these the walks look at a part.
    one = f.filter("id = 40")
    read = again.met(one, probes=2)["hsv"]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and read.select("cell").distinct().count() == 2 < again.graphs().filter("feature = 'hsv'").select("cell").distinct().count()
    assert again.graphs().agg(F.sum("n")).first()[0] == 2 * 1500 and again.graphs().agg(F.max("n")).first()[0] <= 128


def test_rows_are_added_and_small_graphs_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "PART", 64)
    index = ann.Index(spark, str(tmp_path / "index"), "v7", ("hsv",)).build(table(spark, 200, names=("hsv",)))
    before = sorted(p.name for p in (tmp_path / "index").rglob("*.parquet"))
    for k in range(3):
        index.add(table(spark, 30, names=("hsv",), seed=5 + k, start=1000 + 100 * k))
    after = sorted(p.name for p in (tmp_path / "index").rglob("*.parquet"))
    assert set(before) < set(after)  # no graph is made anew
    every = table(spark, 200, names=("hsv",))
    for k in range(3):
        every = every.unionByName(table(spark, 30, names=("hsv",), seed=5 + k, start=1000 + 100 * k))
    asks = every.filter("id % 10 = 0")
    exact = {tuple(r) for r in retrieval.nearest(every, asks, 10, feature_names=("hsv",)).select("query_id", "place", "id").collect()}
    parts = index.graphs().count()
    for _ in range(2):
        assert {tuple(r) for r in index.nearest(asks, 10, ef_search=300, probes=99).select("query_id", "place", "id").collect()} == exact
        index.compact()
        assert index.graphs().agg(F.sum("n")).first()[0] == 290
    assert index.graphs().count() < parts


def test_versions_lie_beside_each_other(spark, tmp_path):
    one = ann.Index(spark, str(tmp_path), "v1", ("hsv",)).build(table(spark, 20, names=("hsv",)))
    two = ann.Index(spark, str(tmp_path), "v2", ("hsv",)).build(table(spark, 30, names=("hsv",), seed=4))
    assert one.graphs().agg(F.sum("n")).first()[0] == 20 and two.graphs().agg(F.sum("n")).first()[0] == 30
    with pytest.raises(EmptyCorpusError):
        ann.Index(spark, str(tmp_path), "v3", ("hsv",)).build(table(spark, 20, names=("hsv",)).limit(0))


def test_search_by_index(spark, tmp_path):
    f = table(spark, 300, names=FEATURES)
    index = ann.Index(spark, str(tmp_path / "index")).build(f)
    asks = f.filter("id % 50 = 0")
    want = retrieval.search(f, asks, top_k=5, exclude_self=True).select("query_id", "rank", "id").collect()
    got = retrieval.search(f, asks, mode="ann", top_k=5, exclude_self=True, index=index, ef_search=300)
    assert sorted(got.select("query_id", "rank", "id").collect()) == sorted(want)
    for bad in ({"mode": "none"}, {"mode": "ann"}, {"mode": "ann", "index": index, "role": "corpus"}):
        with pytest.raises(ValueError):
            retrieval.search(f, asks, **bad)


def test_samples_and_centres_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_BYTES", 8 * 6 * 50)
    monkeypatch.setattr(ann, "CENTRE_BYTES", 8 * 6 * 9)
    assert ann.fit(table(spark, 400, names=("hsv",)), "hsv", 400, cell=1).shape == (9, 6)
