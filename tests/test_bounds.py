"""Evaluation and label statistics by bounds, against all pairs held in one array."""

import numpy as np
import pytest

from nearfield.functions.schema import DEFAULT_WEIGHTS, FEATURES
from nearfield.functions.weights import ablations
from nearfield.operators import blocks, bounds, evaluate

WIDTH = 4
VARIANTS = {k: w for k, w in ablations().items() if k in ("base", "minus_hog", "minus_hu")}


def items(spark, n, groups=12, seed=3, spread=0.05, labels=5):
    """Unit vectors in groups, each group near a centre; some are equal, one is zero, some have no label."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(groups, 6, WIDTH))[np.arange(n) % groups] + spread * rng.normal(size=(n, 6, WIDTH))
    v /= np.linalg.norm(v, axis=2, keepdims=True)
    v[5], v[7], v[9, 2] = v[17], v[17], 0.0
    names = [f"l{i % groups % labels}" if i % 31 else None for i in range(n)]
    rows = [(i, names[i], *[list(map(float, x)) for x in v[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, label string, " + ", ".join(f"{f} array<double>" for f in FEATURES))
    return df.repartition(3), v, names


def scores(v, weights):
    return sum(weights.get(f, 0.0) * (v[:, k] @ v[:, k].T) for k, f in enumerate(FEATURES))


@pytest.fixture
def small(monkeypatch):
    for where, name, n in ((blocks, "BLOCK", 8), (bounds, "FEW", 0), (bounds, "TILE", 3), (bounds, "MET", 2), (bounds, "HEADS", 7), (bounds, "FIRST", 2)):
        monkeypatch.setattr(where, name, n)


def test_bounds_lose_nothing(spark, small):
    df, v, names = items(spark, 160)
    got = {}
    for r in evaluate.leave_one_out(df, "id", "label", VARIANTS, 6).collect():
        got.setdefault((r["variant"], r["query_id"]), []).append((r["rank"], r["id"], r["score"], r["rel"], r["label"], r["query_label"]))
    for name, weights in VARIANTS.items():
        s = scores(v, weights)
        np.fill_diagonal(s, -np.inf)
        for q in range(len(v)):
            hits = sorted(got[name, q])
            want = np.sort(s[q])[::-1][:6]
            assert [h[0] for h in hits] == list(range(1, 7)) and np.allclose([h[2] for h in hits], want, atol=1e-9)
            assert all(abs(s[q, h[1]] - h[2]) < 1e-9 and h[3] == int(names[h[1]] == names[q]) and h[4:] == (names[h[1]], names[q]) for h in hits)


@pytest.mark.parametrize("sifted", [0.0, 1.0])
def test_variants_share_what_is_worked_out(spark, small, monkeypatch, sifted):
    steps = evaluate._steps(ablations())
    assert [len(w) for _, w, _ in steps] == [6, 1, 1, 1, 1, 1, 1] and all(added for _, _, added in steps[1:])
    monkeypatch.setattr(evaluate, "SIFTED", sifted)
    df, v, names = items(spark, 160, spread=0.3)
    variants = ablations() | {"one": {"hsv": 1.0}, "other": {"hsv": 0.1, "cm": 0.9, "hu": 0.4}, "twice": {f: 2 * w for f, w in DEFAULT_WEIGHTS.items()}}
    got = {}
    for r in evaluate.leave_one_out(df, "id", "label", variants, 6).collect():
        got.setdefault((r["variant"], r["query_id"]), []).append((r["rank"], r["id"], r["score"]))
    rels = {(r["variant"], r["query_id"]): (r["query_label"], r["rels"]) for r in evaluate.ranks(df, "id", "label", variants, 6).collect()}
    assert len(got) == len(rels) == 160 * len(variants)
    for name, weights in variants.items():
        s = np.round(scores(v, weights), 9)
        for q in range(160):
            want = sorted((i for i in range(160) if i != q), key=lambda i: (-s[q, i], i))[:6]
            hits = sorted(got[name, q])
            assert [h[1] for h in hits] == want and np.allclose([h[2] for h in hits], s[q, want], atol=1e-8)
            assert rels[name, q] == (names[q], [int(names[i] == names[q]) for i in want])


def test_a_task_leaves_a_row_for_each_block(spark, small):
    df, _, _ = items(spark, 160)
    hits, packed, met = evaluate._hits_of(df, "id", "label", VARIANTS, 6)
    assert packed.count() <= hits.count() <= met.count()  # as many as items and variants before


def test_turns_are_tasks_of_their_own(spark, small):
    df, _, _ = items(spark, 160)
    packed, _ = bounds.near_blocks(df, "id", "label", DEFAULT_WEIGHTS)
    every = packed.selectExpr("block AS asking").crossJoin(packed.selectExpr("block AS met"))
    one = lambda own: bounds.pa.RecordBatch.from_pydict({"block": [own["block"]], "met": [own["met"]]})
    rows = bounds.meet(packed, every, lambda own, row: own.update(met=own.get("met", 0) + 1), one, "block long, met long")
    told = rows.selectExpr("spark_partition_id() AS p", "block", "met").join(packed.select("block", "tile"), "block").collect()
    tiles = {}
    for r in told:
        tiles.setdefault(r["p"], set()).add(r["tile"])
    assert len(tiles) > len({r["tile"] for r in told}) > 4 and all(len(t) == 1 for t in tiles.values())  # hashes would put some together
    assert sum(r["met"] for r in told) == packed.count() ** 2


def test_best_takes_in_items_in_any_order():
    rng = np.random.default_rng(1)
    score, floor = rng.integers(0, 12, (5, 90)) / 4, np.array([-np.inf, 0.0, 1.0, 2.5, 9.0])
    best = blocks.Best(5, 7, 1, floor)
    for at in range(0, 90, 30):
        i, j = np.divmod(rng.permutation(150), 30)
        best.take(i, score[i, at + j], at + j, -(at + j)[:, None].astype(float))
    for q in range(5):
        want = [x for x in sorted(range(90), key=lambda x: (-score[q, x], x)) if score[q, x] >= floor[q]][:7]
        n = len(want)
        assert list(best.id[q, :n]) == want and list(best.score[q, :n]) == list(score[q, want]) and list(-best.extra[q, :n, 0]) == want
        assert (best.score[q, n:] == -np.inf).all()
    # A better block after a poor one: little more than the best of it is looked at.
    best, near = blocks.Best(8, 5), rng.normal(size=(8, 400))
    best.meet(near - 50, np.arange(400), lambda i, j: (near[i, j] - 50, None))
    place = best.near(near)
    assert len(place) < 8 * 20 and set(place) >= {q * 400 + x for q in range(8) for x in np.argsort(-near[q])[:5]}
    mask = rng.random((16, 24)) < 0.05
    assert list(blocks.places(mask)) == list(np.flatnonzero(mask)) and list(blocks.places(mask[:3, :5])) == list(np.flatnonzero(mask[:3, :5]))


def test_far_blocks_are_left_out(spark, small):
    df, _, _ = items(spark, 400, spread=0.02)
    met = evaluate.pairs_met(df, "id", "label", evaluate.BASE, 3).first()
    assert met["blocks"] >= 50 and met["pairs"] == met["blocks"] ** 2 and met["met"] < met["pairs"] and met["skipped"] > 0.5
    plan = evaluate.leave_one_out(df, "id", "label", evaluate.BASE, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_few_blocks_meet_all(spark):
    df, v, _ = items(spark, 100)
    met = evaluate.pairs_met(df, "id", "label", evaluate.BASE, 3).first()
    assert met["met"] == met["pairs"] and met["skipped"] == 0
    s = scores(v, DEFAULT_WEIGHTS)
    np.fill_diagonal(s, -np.inf)
    best = {r["query_id"]: r["score"] for r in evaluate.leave_one_out(df, "id", "label", evaluate.BASE, 1).collect()}
    assert np.allclose([best[q] for q in range(100)], s.max(1))


def test_label_pairs(spark, small):
    df, v, names = items(spark, 200, labels=4)
    s, found = scores(v, DEFAULT_WEIGHTS), {}
    for i in range(200):
        for j in range(200):
            if i != j:
                found.setdefault((names[i], names[j]), []).append(s[i, j])
    got = {(r["left_label"], r["right_label"]): (r["n"], r["mean"], r["best"]) for r in evaluate.label_pairs(df, "id", "label", DEFAULT_WEIGHTS).collect()}
    assert got.keys() == found.keys()
    for k, x in found.items():
        assert got[k][0] == len(x) and got[k][1:] == pytest.approx((np.mean(x), max(x)), abs=1e-9)


def test_tiles_are_full_of_small_blocks(spark, small):
    df, _, _ = items(spark, 160, labels=40)
    packed, few = bounds.near_blocks(df, "id", "label", DEFAULT_WEIGHTS, by_label=True)
    rows = packed.selectExpr("tile", "size(labels) AS n").collect()
    assert not few and sum(r["n"] for r in rows) == 160
    assert len({r["tile"] for r in rows}) <= 3 * 7  # seven times three blocks of eight, and what is left over in a partition
