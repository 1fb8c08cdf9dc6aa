"""Leave-one-out evaluation of retrieval: precision and average precision at k, by class, with ablation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.schema import DEFAULT_WEIGHTS, EVAL_TOP_K, FEATURES, EvaluationError
from nearfield.functions.weights import ablations, as_map, normalise
from nearfield.operators import bounds
from nearfield.operators.blocks import PAIRS, SLACK, Best, dots, places
from nearfield.operators.shared import written

#: Products of single precision differ from those of double by no more than this share of the lengths and the largest weight.
ROUGH = 2e-5
#: Share of a block's pairs up to which they are looked at one by one.
SIFTED = 0.02


def labelled(features: DataFrame, items: DataFrame, id_col: str, label: str, dims: dict[str, int] | None = None) -> DataFrame:
    """Features joined to labels; a null vector, or one of the wrong width, is an error when the rows are read. Kept tables of the same
    number of buckets (``kept.Kept``) are not dealt again."""
    both = features.join(items.select(id_col, label), id_col)
    for f in FEATURES:
        good = F.col(f).isNotNull() if dims is None else F.coalesce(F.size(f) == dims[f], F.lit(False))
        both = both.withColumn(f, F.when(good, F.col(f)).otherwise(F.raise_error(F.lit(f"{f}: a vector is missing or has the wrong width"))))
    return both


def guard(items: DataFrame, label: str) -> None:
    found = items.agg(F.count("*").alias("n"), F.approx_count_distinct(label).alias("k")).first()
    if found["n"] < 2 or found["k"] < 2:
        raise EvaluationError("evaluation needs two items and two labels")


def _label_sums(features: DataFrame, label: str, weights: dict[str, float]) -> DataFrame:
    """block, name, n, own and the weighted sum of the vectors (centre) of each label; own: the sum of each vector with itself."""
    kept = features.select(F.col(label).cast("string").alias("name"), F.concat(*[F.transform(F.col(f).cast("array<double>"), lambda x: x) for f in FEATURES]).alias("v"), F.array(*[F.size(f) for f in FEATURES]).alias("widths"))
    scale = [weights.get(f, 0.0) for f in FEATURES]
    layout = pa.schema([("name", pa.string()), ("widths", pa.list_(pa.int32())), ("n", pa.int64()), ("own", pa.float64()), ("v", pa.binary())])

    def rows_of(sums: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"name": k, "widths": w, "n": n, "own": own, "v": v.tobytes()} for k, (w, n, own, v) in sums.items()], schema=layout)

    def within(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                widths = batch.column("widths")[0].as_py()
                own = (v * v) @ np.repeat(scale, widths)
                names, at = _numbered(batch.column("name").to_pylist())
                for i, k in enumerate(names):
                    _, n, o, total = sums.get(k, (widths, 0, 0.0, 0.0))
                    sums[k] = (widths, n + int((at == i).sum()), o + float(own[at == i].sum()), total + v[at == i].sum(0))
        yield rows_of(sums)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            for r in batch.to_pylist():
                _, n, own, v = sums.get(r["name"], (None, 0, 0.0, 0.0))
                sums[r["name"]] = (r["widths"], n + r["n"], own + r["own"], v + np.frombuffer(r["v"]))
        yield rows_of(sums)

    kind = "name string, widths array<int>, n long, own double, v binary"
    every = kept.mapInArrow(within, kind).repartition("name").mapInArrow(over, kind)
    return every.select(F.xxhash64("name").alias("block"), "name", "n", "own", "widths", F.col("v").alias("centre"), F.array().cast("array<double>").alias("norms"), F.array().cast("array<double>").alias("radii"))


def label_pairs(features: DataFrame, id_col: str, label: str, weights: dict[str, float]) -> DataFrame:
    """left_label, right_label, n, mean, best: fused similarity over the ordered pairs of different items, by their labels.

    Means need no pairs: a sum of products of all pairs is the product of the sums of both labels' vectors. The best pair is
    looked for in blocks of one label: those of each two labels with the highest bound first, then those whose bound reaches what
    these gave. Ids are those of one row each.
    """
    names = _label_sums(features, label, weights)
    scale = [weights.get(f, 0.0) for f in FEATURES]

    def total(a: dict, b: dict) -> dict:
        one = (a["centre"] * np.repeat(scale, a["widths"])) @ b["centre"].T
        same = a["block"][:, None] == b["block"][None, :]
        n = np.outer(a["n"], b["n"]) - same * a["n"][:, None]
        one -= same * a["own"][:, None]
        i, j = np.nonzero(n)
        return {"left_label": a["name"][i], "right_label": b["name"][j], "n": n[i, j].astype(int), "total": one[i, j]}

    means = bounds.head_pairs(names, total, "left_label string, right_label string, n long, total double", {k: F.col(k) for k in ("name", "n", "own")})
    best = _best_of_labels(features, id_col, label, weights)
    same = [F.col(f"{x}_label").eqNullSafe(F.col(f"{x}_b")) for x in ("left", "right")]
    both = means.join(best.withColumnsRenamed({"left_label": "left_b", "right_label": "right_b"}), same)
    return both.select("left_label", "right_label", "n", (F.col("total") / F.col("n")).alias("mean"), "best")


def _best_of_labels(features: DataFrame, id_col: str, label: str, weights: dict[str, float]) -> DataFrame:
    """left_label, right_label, best."""
    packed, few = bounds.near_blocks(features, id_col, label, weights, by_label=True)
    scale = [weights.get(f, 0.0) for f in FEATURES]

    def search(own: dict, row: dict) -> None:
        scores = (own["vectors"] * np.repeat(scale, row["widths"])) @ row["vectors"].T
        scores[own["ids"][:, None] == row["ids"][None, :]] = -np.inf
        (left, at), (right, to), held = _numbered(own["labels"]), _numbered(row["labels"]), own.setdefault("held", {})
        for i, x in enumerate(left):
            for j, y in enumerate(right):
                top = float(scores[np.ix_(at == i, to == j)].max())
                if top > held.get((x, y), -np.inf):
                    held[x, y] = top

    def done(own: dict) -> pa.RecordBatch | None:
        found = own.get("held")
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)] + [pa.array(list(found.values()), pa.float64())], ["left_label", "right_label", "best"]) if found else None

    schema = "left_label string, right_label string, best double"
    over = lambda rows: rows.groupBy("left_label", "right_label").agg(F.max("best").alias("best"))
    if few:
        return over(bounds.meet_all(packed, search, done, schema))
    name = F.get("labels", F.lit(0))

    def first(a: dict, b: dict) -> dict:
        top = bounds.upper(a, b, weights)
        i, j = (x.ravel() for x in np.indices(top.shape))
        (_, x), (_, y) = _numbered(a["name"].tolist()), _numbered(b["name"].tolist())
        order = np.lexsort((-top.ravel(), y[j], x[i]))
        pair = np.column_stack([x[i], y[j]])[order]
        order = order[np.append(True, (pair[1:] != pair[:-1]).any(1))]
        i, j = i[order], j[order]
        return {"left_label": a["name"][i], "right_label": b["name"][j], "asking": a["block"][i], "met": b["block"][j], "top": top[i, j]}

    found = bounds.head_pairs(packed, first, "left_label string, right_label string, asking long, met long, top double", {"name": name})
    highest = found.groupBy("left_label", "right_label").agg(F.max_by(F.struct("asking", "met"), "top").alias("p"))
    begun = written(highest.select("p.asking", "p.met").distinct())
    hits = written(over(bounds.meet(packed, begun, search, done, schema)))
    # A block asks for others by the least score of its label with any; which of them may hold a better pair is told by both labels.
    least = hits.groupBy(F.col("left_label").alias("l")).agg(F.min("best").alias("least_0"), F.count("*").alias("k"))
    labels = hits.select("left_label").distinct().count()
    asking = packed.select("block", name.alias("l0")).join(least, F.col("l0").eqNullSafe(F.col("l")), "left")
    asking = asking.select(F.col("block").alias("asking"), F.when(F.col("k") == labels, F.col("least_0")).alias("least_0"))
    more = written(bounds.further_pairs(packed, begun, asking, {"one": weights}))
    return over(hits.unionByName(bounds.meet(packed, more, search, done, schema)))


def _numbered(labels: list) -> tuple[list, np.ndarray]:
    names = list(dict.fromkeys(labels))
    return names, np.array([names.index(x) for x in labels])


def leave_one_out(features: DataFrame, id_col: str, label: str, variants: dict[str, dict[str, float]], top_k: int) -> DataFrame:
    """variant, query_id, query_label, id, label, score, rank, rel: each item's ``top_k`` others under each variant's weights.

    Blocks meet in single precision first; what reaches an item's ``top_k``-th score is scored in double. Ties go to the lower id; an item is
    never its own result. Items lie in blocks of near ones. Each block first meets itself and those of the highest
    bounds, which gives every item a ``top_k``-th score; then it meets only blocks whose bound reaches the least of these in it.
    """
    names = np.array(list(variants), object)

    def tell(best: dict) -> pa.RecordBatch:
        i, j = np.nonzero(best["score"] > -np.inf)
        q, code = i % len(best["ids"]), best["code"][i, j]
        known, own = np.array(best["known"], object), np.array(best["labels"], object)
        cols = (names[i // len(best["ids"])], best["ids"][q], own[q], best["id"][i, j], known[code], best["score"][i, j], j + 1, code == best["own"][q])
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32) if k == pa.int32() else x, k) for x, k in zip(cols, kinds, strict=True)], names_of)

    schema = "variant string, query_id long, query_label string, id long, label string, score double, rank int, rel int"
    names_of = [x.split()[0] for x in schema.split(", ")]
    return _told(_hits_of(features, id_col, label, variants, top_k)[0], top_k, tell, schema)


def ranks(features: DataFrame, id_col: str, label: str, variants: dict[str, dict[str, float]], top_k: int) -> DataFrame:
    """variant, query_id, query_label, rels: a row for each item and variant with the ``rel`` of what ``leave_one_out`` finds, by rank."""
    names = np.array(list(variants), object)

    def tell(best: dict) -> pa.RecordBatch:
        held = best["score"] > -np.inf
        some = np.flatnonzero(held[:, 0])
        q = some % len(best["ids"])
        rel = (best["code"][some] == best["own"][q, None]).astype(np.int32)[held[some]]
        rels = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(held[some].sum(1))), pa.int32()), pa.array(rel))
        cols = [pa.array(names[some // len(best["ids"])], pa.string()), pa.array(best["ids"][q]), pa.array(np.array(best["labels"], object)[q], pa.string()), rels]
        return pa.RecordBatch.from_arrays(cols, ["variant", "query_id", "query_label", "rels"])

    return _told(_hits_of(features, id_col, label, variants, top_k)[0], top_k, tell, "variant string, query_id long, query_label string, rels array<int>")


#: The best hits of a block's items that a task has found: ids and labels of the items, the labels met (known), and by variant, item and
#: place the score (-inf: none), id and label's place in known.
_HITS = "block long, ids binary, labels array<string>, known array<string>, score binary, id binary, code binary"


def _told(hits: DataFrame, top_k: int, tell: Callable[[dict], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``tell`` makes of the best hits of each block out of _HITS; the rows of a block meet one by one."""

    def read(row: dict) -> dict:
        out = {"ids": np.frombuffer(row["ids"], np.int64), "labels": row["labels"], "known": list(row["known"]), "block": row["block"]}
        return out | {c: np.frombuffer(row[c], kind).reshape(-1, top_k) for c, kind in (("score", np.float64), ("id", np.int64), ("code", np.int32))}

    def both(a: dict, b: dict) -> dict:
        place = {x: i for i, x in enumerate(a["known"])}
        b["code"] = np.array([place.setdefault(x, len(place)) for x in b["known"]] or [0], np.int32)[b["code"]]
        every = {c: np.concatenate([a[c], b[c]], axis=1) for c in ("score", "id", "code")}
        order = np.lexsort((every["id"], -every["score"]))[:, :top_k]
        return a | {"known": list(place)} | {c: np.take_along_axis(x, order, 1) for c, x in every.items()}

    def end(best: dict) -> pa.RecordBatch:
        place = {x: i for i, x in enumerate(best["known"])}
        return tell(best | {"own": np.array([place.get(x, -1) for x in best["labels"]], np.int32)})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = read(batch.slice(i, 1).to_pylist()[0])
                if best is not None and row["block"] == best["block"]:
                    best = both(best, row)
                    continue
                if best is not None:
                    yield end(best)
                best = row
        if best is not None:
            yield end(best)

    return hits.repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def _steps(variants: dict[str, dict[str, float]]) -> list[tuple[float, dict[str, float], bool]]:
    """times, weights, added of each variant: its scores are ``times`` those by ``weights``, which are ``added`` to the first variant's
    scores where that leaves fewer features to multiply. Without one feature, weights are in proportion, so just this one is taken off."""
    first, *_ = variants.values()
    out = []
    for n, w in enumerate(variants.values()):
        own = {f: w[f] for f in FEATURES if w.get(f)}
        found = [(1.0, own, False)]
        for c in sorted({w[f] / first[f] for f in own if n and first.get(f)}):
            rest = {f: w.get(f, 0.0) / c - first.get(f, 0.0) for f in FEATURES} if c > 0 else {}
            found += [(c, {f: x for f, x in rest.items() if abs(x) > 1e-12 * abs(first.get(f, 0.0))}, True)] if rest else []
        out.append(min(found, key=lambda x: len(x[1])))
    return out


def _hits_of(features: DataFrame, id_col: str, label: str, variants: dict[str, dict[str, float]], top_k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """_HITS among which the best are, blocks, and the pairs of them that met."""
    mean = {f: float(np.mean([w.get(f, 0.0) for w in variants.values()])) for f in FEATURES}
    packed, few = bounds.near_blocks(features, id_col, label, mean)
    steps, spare = _steps(variants), {}
    # Sums of single precision are off by their parts' errors: those of the first variant's scores and of what is added.
    largest = [max(map(abs, x.values()), default=0.0) for _, x, _ in steps]
    off = [ROUGH * times * (most + largest[0] * added) for (times, _, added), most in zip(steps, largest, strict=True)]

    def scaled(own: dict, weights: dict[str, float]) -> tuple[np.ndarray, slice | np.ndarray]:
        at = np.concatenate(([0], np.cumsum(own["widths"])))
        cols = np.concatenate([np.arange(at[k], at[k + 1]) for k, f in enumerate(FEATURES) if f in weights] or [np.arange(0)])
        times = np.concatenate([np.full(own["widths"][k], weights[f]) for k, f in enumerate(FEATURES) if f in weights] or [np.zeros(0)])
        cols = slice(cols[0], cols[-1] + 1) if len(cols) and cols[-1] - cols[0] + 1 == len(cols) else cols
        return (own["vectors"][:, cols] * times).astype(np.float32), cols

    def room(name: str, n: int, m: int) -> np.ndarray:
        if len(spare.get(name, ())) < n * m:
            spare[name] = np.empty(n * m, np.float32)
        return spare[name][: n * m].reshape(n, m)

    def near(own: dict, row: dict, itself: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """Places of what may be a hit, by variant. Scores are worked out once, and for the others only what is added; where the first
        variant's score must be high for any of it to be enough, for these pairs only."""
        best, n, m = own["best"], len(own["ids"]), len(row["ids"])
        slack = [SLACK + o * own["longest"] * row["longest"] for o in off]
        base = np.matmul(own["sides"][0][0], row["met"][0].T, out=room("first", n, m))
        base[itself] = -np.inf
        out, sifted = [best.near(base, slack[0], 0, steps[0][0])], {}
        for v, (times, _, added) in enumerate(steps):
            bar = (best.least(v * n, n) - slack[v]) / times
            low = (bar - own["lengths"][v] * row["reach"][v]).astype(np.float32)
            if v and added and np.isfinite(bar).all() and np.count_nonzero(base[::8] >= low[::8, None]) <= SIFTED * base[::8].size:
                sifted[v] = bar, low
        if sifted:
            some = places(base >= np.min([low for _, low in sifted.values()], axis=0)[:, None])
            i, j = np.divmod(some, m)
            high = base.ravel().take(some)
        for v in range(1, len(steps)):
            times, _, added = steps[v]
            a, b = own["sides"][v][0], row["met"][v]
            if v in sifted:
                out.append(some[high + np.einsum("ij,ij->i", a.take(i, 0), b.take(j, 0)) >= sifted[v][0].take(i)])
                continue
            approx = np.matmul(a, b.T, out=room("more", n, m))
            if added:
                approx += base
            else:
                approx[itself] = -np.inf
            out.append(best.near(approx, slack[v], v * n, times))
        return out

    def search(own: dict, row: dict) -> None:
        n, m = len(own["ids"]), len(row["ids"])
        at = np.concatenate(([0], np.cumsum(row["widths"])))
        side = dict(zip(FEATURES, zip(at, at[1:])))
        if "best" not in own:
            floor = np.frombuffer(own["floor"]) if own.get("floor") else None
            own |= {"best": Best(n * len(steps), top_k, 1, floor), "sides": [scaled(own, x) for _, x, _ in steps], "codes": {}}
            own |= {"lengths": [np.sqrt((a.astype(float) ** 2).sum(1)) for a, _ in own["sides"]], "longest": float(np.sqrt((own["vectors"] ** 2).sum(1).max(initial=0.0)))}
        if "met" not in row:  # a block that others meet as well
            known = {}
            row |= {"code": np.array([known.setdefault(x, len(known)) for x in row["labels"]], int), "known": known}
            row["met"] = [np.ascontiguousarray(row["vectors"][:, cols], np.float32) for _, cols in own["sides"]]
            row["longest"] = float(np.sqrt((row["vectors"] ** 2).sum(1).max(initial=0.0)))
            row["reach"] = [float(np.sqrt((b.astype(float) ** 2).sum(1).max(initial=0.0))) for b in row["met"]]
        best, codes = own["best"], own["codes"]
        code = np.array([codes.setdefault(x, len(codes)) for x in row["known"]], float)[row["code"]]
        twins = np.flatnonzero(np.isin(own["ids"], row["ids"]))
        x, y = np.nonzero(own["ids"][twins, None] == row["ids"]) if len(twins) else (twins, twins)
        found = near(own, row, (twins[x], y))
        which = np.repeat(np.arange(len(steps)), [len(p) for p in found])
        place, back = np.unique(np.concatenate(found), return_inverse=True)
        for lo in range(0, len(place), PAIRS):
            i, j = np.divmod(place[lo : lo + PAIRS], m)
            left, right = own["vectors"].take(i, 0), row["vectors"].take(j, 0)
            sims = {f: dots(left[:, slice(*side[f])], right[:, slice(*side[f])]) for f in FEATURES}
            score = np.column_stack([sum((w[f] * sims[f] for f in FEATURES if w.get(f)), np.zeros(len(i))) for w in variants.values()])
            here = np.flatnonzero((back >= lo) & (back < lo + PAIRS))
            nth, v = back[here] - lo, which[here]
            best.take(v * n + i[nth], score[nth, v], row["ids"][j[nth]], code[j[nth], None])

    def done(own: dict) -> pa.RecordBatch | None:
        if "best" not in own:
            return None
        best = own["best"]
        found = {"block": own["block"], "ids": own["ids"].tobytes(), "labels": own["labels"], "known": list(own["codes"])}
        found |= {"score": best.score.tobytes(), "id": best.id.tobytes(), "code": best.extra[:, :, 0].astype(np.int32).tobytes()}
        return pa.RecordBatch.from_pylist([found], schema=layout)

    texts = pa.list_(pa.string())
    layout = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("labels", texts), ("known", texts), ("score", pa.binary()), ("id", pa.binary()), ("code", pa.binary())])
    if few:
        every = packed.select(F.col("block").alias("asking")).crossJoin(packed.select(F.col("block").alias("met")))  # of FEW blocks
        return bounds.meet_all(packed, search, done, _HITS), packed, every
    first = written(bounds.first_pairs(packed, mean))
    hits = written(bounds.meet(packed, first, search, done, _HITS))

    # An item with fewer results than are wanted has no least score, so its block meets all others.
    def reached(best: dict) -> pa.RecordBatch:
        nth = np.ascontiguousarray(best["score"][:, -1])
        least = nth.reshape(len(steps), -1).min(1)
        cols = {"block": [best["block"]], "floor": [nth.tobytes()]} | {f"least_{k}": [float(x)] for k, x in enumerate(least)}
        return pa.RecordBatch.from_pydict(cols, schema=pa.schema([("block", pa.int64()), ("floor", pa.binary()), *[(f"least_{k}", pa.float64()) for k in range(len(steps))]]))

    least = written(_told(hits, top_k, reached, "block long, floor binary, " + ", ".join(f"least_{k} double" for k in range(len(steps)))))
    more = written(bounds.further_pairs(packed, first, least.drop("floor").withColumnRenamed("block", "asking"), variants))
    further = bounds.meet(packed, more, search, done, _HITS, least.select("block", "floor"))
    return hits.unionByName(further), packed, first.unionByName(more)


def pairs_met(features: DataFrame, id_col: str, label: str, variants: dict[str, dict[str, float]], top_k: int) -> DataFrame:
    """blocks, pairs, met, skipped: of all ordered pairs of blocks how many ``leave_one_out`` worked on, and the share that it left out."""
    _, packed, met = _hits_of(features, id_col, label, variants, top_k)
    n = packed.agg(F.count("*").alias("blocks"))
    counted = n.crossJoin(met.agg(F.count("*").alias("met")))  # one row by one row
    return counted.select("blocks", (F.col("blocks") * F.col("blocks")).alias("pairs"), "met", F.round(1 - F.col("met") / (F.col("blocks") * F.col("blocks")), 4).alias("skipped"))


def query_metrics(hits: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """variant, query_id, query_label, p, ap over ranks up to ``k``, from rows of ``leave_one_out`` or ``ranks``. ``sizes``: label,
    relevant (others of the label, over 0).

    p divides by the results there are, at most ``k``; ap by the lesser of that and the relevant items there are.
    """
    if "rels" not in hits.columns:
        rels = F.transform(F.sort_array(F.collect_list(F.struct("rank", "rel"))), lambda x: x["rel"])
        hits = hits.groupBy("variant", "query_id", "query_label").agg(rels.alias("rels"))
    top = F.slice("rels", 1, k)
    begin = F.struct(F.lit(0).alias("n"), F.lit(0).alias("found"), F.lit(0.0).alias("gain"))

    def add(s: Column, rel: Column) -> Column:
        gain = F.when(rel == 1, (s["found"] + 1) / (s["n"] + 1)).otherwise(0.0)
        return F.struct((s["n"] + 1).alias("n"), (s["found"] + rel).alias("found"), (s["gain"] + gain).alias("gain"))

    each = hits.select("variant", "query_id", "query_label", F.aggregate(top, begin, add).alias("s")).filter("s.n > 0")
    each = each.join(sizes.withColumnRenamed("label", "query_label"), "query_label")
    return each.select("variant", "query_id", "query_label", (F.col("s.found") / F.col("s.n")).alias("p"), (F.col("s.gain") / F.least(F.col("s.n"), "relevant")).alias("ap"))


def class_sizes(items: DataFrame, label: str) -> DataFrame:
    """label, relevant: the others of each label; labels of one item can't be evaluated and are left out."""
    return items.groupBy(F.col(label).cast("string").alias("label")).agg((F.count("*") - 1).alias("relevant")).filter("relevant > 0")


def overall(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("variant").agg(F.avg("p").alias("precision"), F.avg("ap").alias("map"), F.count("*").alias("n_queries"))


def per_class(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("variant", "query_label").agg(F.avg("p").alias("precision"), F.avg("ap").alias("map"), F.count("*").alias("n_queries"))


def evaluation_run(metrics5: DataFrame, metrics10: DataFrame) -> DataFrame:
    """precision_at_5 and map_at_10 as they are stored, null without a query that can be evaluated."""
    a = metrics5.agg(F.avg("p").cast("decimal(5,4)").alias("precision_at_5"))
    return a.crossJoin(metrics10.agg(F.avg("ap").cast("decimal(5,4)").alias("map_at_10")))  # one row by one row


def _metrics_struct() -> Column:
    return F.struct(F.col("precision").alias("precision_at_k"), F.col("map").alias("map_at_k"), F.col("n_queries"))


def reports(metrics: DataFrame, variants: dict[str, dict[str, float]], top_k: int) -> DataFrame:
    """variant, report: method, weights, top_k, overall and per_class (a map by label) of each variant; labels are few beside items."""
    by_class = per_class(metrics).groupBy("variant").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("query_label"), _metrics_struct())))).alias("per_class"))
    both = overall(metrics).select("variant", _metrics_struct().alias("overall")).join(by_class, "variant")
    weights = F.lit(None).cast("map<string,double>")
    for v, w in variants.items():
        weights = F.when(F.col("variant") == v, as_map(w)).otherwise(weights)
    method = F.when(F.col("variant") == "base", "default").otherwise(F.col("variant"))
    return both.select("variant", F.struct(method.alias("method"), weights.alias("weights"), F.lit(top_k).alias("top_k"), "overall", "per_class").alias("report"))


def evaluated(features: DataFrame, id_col: str, label: str, method: str = "default", weights: dict | None = None, top_k: int = EVAL_TOP_K, run_id: int = 1, found: DataFrame | None = None) -> DataFrame:
    """One row as evaluation_runs keeps it: precision at 5 and MAP at 10 whatever ``top_k``; per_class as JSON for the
    ``default`` method, ablation as JSON for the ``ablation`` one, which takes the default weights.

    ``found``: what ``ranks`` gave for this method's variants (others are left out) up to ``top_k``, 10 at least, so that several methods share it."""
    if method not in ("default", "ablation"):
        raise ValueError("method is default or ablation")
    guard(features, label)
    started = F.lit(datetime.now(UTC)).cast("timestamp")
    variants = ablations() if method == "ablation" else {"base": normalise(weights)}
    hits = written(ranks(features, id_col, label, variants, max(top_k, 10))) if found is None else found.filter(F.col("variant").isin(*variants))
    sizes = class_sizes(features, label)
    base = hits.filter("variant = 'base'")
    numbers = evaluation_run(query_metrics(base, sizes, 5), query_metrics(base, sizes, 10))
    each = reports(query_metrics(hits, sizes, top_k), variants, top_k)
    if method == "default":
        made = each.agg(F.to_json(F.max_by("report.per_class", "variant")).alias("per_class"), F.lit(None).cast("string").alias("ablation"))
    else:
        rest = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("variant") != "base", F.struct("variant", F.to_json("report").alias("r"))))))
        made = each.agg(F.max_by(F.to_json("report"), F.col("variant") == "base").alias("base"), rest.alias("variants"))
        variant_map = F.transform_values("variants", lambda k, v: F.from_json(v, _REPORT))
        made = made.select(F.lit(None).cast("string").alias("per_class"), F.to_json(F.struct(F.lit(top_k).alias("top_k"), F.from_json("base", _REPORT).alias("base"), variant_map.alias("variants"))).alias("ablation"))
    return numbers.crossJoin(made).select(  # one row by one row
        F.lit(run_id).cast("long").alias("id"), F.lit(method).alias("method"), "precision_at_5", "map_at_10", "per_class", "ablation", started.alias("started_at"), F.current_timestamp().alias("finished_at")
    )


# The names and types in stored reports.
_METRICS = "struct<precision_at_k:double,map_at_k:double,n_queries:bigint>"
_REPORT = f"struct<method:string,weights:map<string,double>,top_k:int,overall:{_METRICS},per_class:map<string,{_METRICS}>>"
PER_CLASS, ABLATION = f"map<string,{_METRICS}>", f"struct<top_k:int,base:{_REPORT},variants:map<string,{_REPORT}>>"


def precision_at_k(rel: list[int], k: int) -> float:
    k = min(k, len(rel))
    return sum(rel[:k]) / k if k > 0 else 0.0


def average_precision_at_k(rel: list[int], total: int, k: int) -> float:
    k = min(k, len(rel))
    most = min(k, total)
    hits = np.cumsum(rel[:k])
    return float(sum(h / (i + 1) for i, (r, h) in enumerate(zip(rel[:k], hits, strict=True)) if r) / most) if most > 0 else 0.0


BASE = {"base": DEFAULT_WEIGHTS}
