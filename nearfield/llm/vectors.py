"""Embedding near-dedup: an epsilon grid order join over leading principal dimensions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import components, cut, union_find

#: Vectors and bytes in a block at most, leading dimensions that order them, dimensions of the boxes, and rows below
#: which a matrix product settles a pair.
BLOCK, BLOCK_BYTES, LEADING, BOXED, SMALL = 1024, 4 << 20, 4, 16, 128
#: Links that a task holds before it folds them into a forest.
HELD = 1 << 18
#: Widths of vectors whose axes are fitted, the most frequent ones; vectors of other widths are ordered by their first dimensions.
WIDTHS = 64
#: Blocks of a tile, which a task holds, and blocks that it meets in turn.
TILE, MET = 8, 64


def unit_vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, grp (label and width), digest and the unit vector as bytes of doubles; nulls in the last three where a vector links with nothing."""
    rows = df.select(F.col(key).alias("id"), F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("v"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"grp": [], "digest": [], "unit": []}
            for l, v in zip(batch.column("l").to_pylist(), batch.column("v").to_pylist(), strict=True):
                x = np.array(v, float) if l is not None and v and None not in v else np.zeros(0)
                peak = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if peak == 0.0:
                    for c in out.values():
                        c.append(None)
                    continue
                x = x / peak
                x = (x / np.sqrt(x @ x)) + 0.0  # no negative zeros
                out["grp"].append(f"{len(x)}:{l}")
                out["digest"].append(hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest())
                out["unit"].append(x.tobytes())
            kinds = {"grp": pa.string(), "digest": pa.string(), "unit": pa.binary()}
            yield pa.RecordBatch.from_pydict({"id": batch.column("id")} | {c: pa.array(v, kinds[c]) for c, v in out.items()})

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, grp string, digest string, unit binary")


def principal_axes(units: DataFrame) -> dict[int, np.ndarray]:
    """For each vector width its leading principal axes, as rows. Each task sends one sum for each pair of dimensions (the
    first 256 at most), added up by Spark; any orthonormal axes give right results, these prune best. A task's sums come
    from one matrix product a batch and width; the driver gets 33,000 numbers a width, for the WIDTHS widths of the most vectors."""
    widths = units.groupBy((F.length("unit") / 8).cast("long").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(WIDTHS)
    fitted = {r["d"] for r in widths.collect()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            units = batch.column("unit").to_pylist()
            for d in {len(u) // 8 for u in units} & fitted:
                x = np.frombuffer(b"".join(u for u in units if len(u) == 8 * d)).reshape(-1, d)[:, :256]
                x = np.hstack([x, np.ones((len(x), 1))])
                sums[d] = sums.get(d, 0.0) + x.T @ x
        for d, s in sums.items():
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_pydict({"d": np.full(len(i), d), "i": i, "j": j, "s": s[i, j]})

    axes = {}
    sums = units.select("unit").mapInArrow(run, "d long, i long, j long, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toPandas()
    for d, part in sums.groupby("d"):
        n = int(part["i"].max()) + 1
        m = np.zeros((n, n))
        m[part["i"], part["j"]] = part["s"]
        m = m + np.triu(m, 1).T
        mean = m[:-1, -1] / m[-1, -1]
        values, v = np.linalg.eigh(m[:-1, :-1] / m[-1, -1] - np.outer(mean, mean))
        axes[int(d)] = np.zeros((min(BOXED, n - 1), int(d)))
        axes[int(d)][:, : n - 1] = v[:, np.argsort(-values)[:BOXED]].T
    return axes


def axes_of(axes: dict[int, np.ndarray], width: int) -> np.ndarray:
    """The fitted axes of a width, else the first dimensions."""
    return axes[width] if width in axes else np.eye(min(BOXED, width), width)


def placed(units: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """Coordinates on the principal axes, and the length of what they leave out: of two vectors these lie no farther apart
    than the vectors themselves."""
    at = units @ axis.T
    return np.hstack([at, np.sqrt(np.maximum(0.0, 1.0 - (at * at).sum(1, keepdims=True)))])


def interval_links(a: np.ndarray, pa_: np.ndarray, b: np.ndarray, pb: np.ndarray, least: float, eps: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i in a, j in b; i < j if both are the ``same``) with cosine ``least`` or more, joining intervals recursively.

    Both are in grid order. An interval pair whose boxes lie more than ``eps`` apart on the principal dimensions
    is skipped: no two of its vectors can be nearer. Others are halved until they are small.
    """
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and a0 >= b1:
            continue
        x, y = pa_[a0:a1], pb[b0:b1]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if gap @ gap > eps * eps:
            continue
        if max(a1 - a0, b1 - b0) <= SMALL:
            i, j = np.nonzero(a[a0:a1] @ b[b0:b1].T >= least)
            i, j = i + a0, j + b0
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        am, bm = (a0 + a1) // 2 if a1 - a0 > SMALL else a1, (b0 + b1) // 2 if b1 - b0 > SMALL else b1
        stack += [(p, q, r, s) for p, q in ((a0, am), (am, a1)) if q > p for r, s in ((b0, bm), (bm, b1)) if s > r]


def linked_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """key, n_links, component_id and kept of each row: links join rows of one label whose cosine is ``least`` or more.

    A row links with nothing if its label or key is null, or its vector is null, empty, zero or holds a null or a
    number that is not finite; vectors of different widths do not link, and there may be any number of widths. Equal vectors count as one with a weight while
    pairs are sought, and each row of them links with the others. component_id is the smallest key that links reach;
    a row without links is its own component (null for a null key, and not kept).

    Vectors of a label are put in the order of grid cells of edge eps on the leading principal dimensions (eps: the
    distance at that cosine) and dealt into blocks of about a thousand, eight consecutive blocks to a tile. Each block is
    sent once to every tile that holds a block that may be near; a task holds a tile and joins up to 64 such blocks with
    it, interval by interval, so a hot label or a dense group spreads over tasks. A task gives for each vector the links
    counted and one spanning link, never all pairs. Repeated rows are links of each other; an empty table gives no rows;
    other columns of ``df`` do not come out, so their names may be anything.
    """
    rows = cut(unit_vectors(df, key, vector, label))
    sound = rows.filter("unit IS NOT NULL AND id IS NOT NULL")
    reps = cut(sound.groupBy("grp", "digest").agg(F.first("unit").alias("unit"), F.count("*").alias("weight"), F.min("id").alias("low")).withColumn("rep", F.monotonically_increasing_id()))
    axes = principal_axes(reps)
    eps = float(np.sqrt(max(0.0, 2 - 2 * least))) + 1e-6  # lengths that axes leave out are known to about 1e-8

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("unit").to_pylist()
            cells = [np.floor(axes_of(axes, len(u) // 8)[:LEADING] @ np.frombuffer(u) / eps).astype(int).tolist() for u in units]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "cell"])

    slim = reps.select("rep", "grp", "weight", "unit")
    order = ["grp", "cell", "rep"]
    ordered = slim.mapInArrow(place, "rep long, grp string, weight long, unit binary, cell array<int>").repartitionByRange(*order).sortWithinPartitions(*order)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        grp, nth, tile = None, 0, -1

        def block() -> pa.RecordBatch:
            nonlocal grp, nth, tile
            grp, nth = (held[0][0], 0) if held[0][0] != grp else (grp, nth + 1)
            tile += nth % TILE == 0
            return _block(held, axes, tile)

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("grp", "rep", "weight", "unit")), strict=True):
                if held and (held[0][0] != row[0] or len(held) >= min(BLOCK, max(1, BLOCK_BYTES // len(row[3])))):
                    yield block()
                    held = []
                held.append(row)
        if held:
            yield block()

    layout = "grp string, tile long, reps binary, weights binary, units binary, low array<double>, high array<double>"
    numbered = ordered.mapInArrow(deal, layout).withColumn("tile", F.shiftleft(F.spark_partition_id().cast("long"), 33) + F.col("tile"))
    blocks = cut(numbered.withColumn("block", F.monotonically_increasing_id()))
    # Which blocks may be near a tile is found on boxes alone, cell by cell of the first dimension; vectors come in later.
    cell = lambda x, c: F.floor(x[0] / eps) + c
    corner = lambda c, f: F.array(*[f(F.get(c, F.lit(i))) for i in range(1 + BOXED)])
    boxes = blocks.groupBy("grp", F.col("tile").alias("at")).agg(corner("low", F.min).alias("from"), corner("high", F.max).alias("to"))
    boxes = boxes.select("grp", "at", *[F.filter(c, lambda x: x.isNotNull()).alias(c) for c in ("from", "to")])
    a = blocks.select("grp", F.explode(F.sequence(cell(F.col("low"), -1), cell(F.col("high"), 1))).alias("c"), "block", "tile", "low", "high")
    b = boxes.select("grp", F.explode(F.sequence(cell(F.col("from"), 0), cell(F.col("to"), 0))).alias("c"), "at", "from", "to")
    # A pair of tiles meets at the one or the other in turn, so that the work of a long row of tiles is even.
    host = F.when((F.col("tile") + F.col("at")) % 2 == 1, F.least("tile", "at")).otherwise(F.greatest("tile", "at"))
    gaps = F.zip_with(F.zip_with("low", "to", lambda x, y: x - y), F.zip_with("from", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    apart = F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    near = a.join(b, ["grp", "c"]).filter((F.col("tile") != F.col("at")) & (F.col("at") == host) & (apart <= eps * eps)).select("at", "block").distinct()
    share = F.floor((F.row_number().over(Window.partitionBy("at").orderBy("block")) - 1) / MET).cast("int")
    met = cut(near.select("at", share.alias("share"), "block"))
    tiles = blocks.select(F.col("tile").alias("at"), F.lit(0).alias("share"), F.lit(True).alias("own"), "block")
    more = met.select("at", "share").distinct().join(blocks.select(F.col("tile").alias("at"), "block"), "at")
    tiles = tiles.union(more.filter("share > 0").select("at", "share", F.lit(True).alias("own"), "block"))
    sent = tiles.union(met.select("at", "share", F.lit(False).alias("own"), "block")).join(blocks.select("block", "reps", "weights", "units"), "block")
    dealt = sent.repartition("at", "share").sortWithinPartitions("at", "share", F.col("own").desc(), "block")

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if (row["at"], row["share"]) != now:
                    now, held = (row["at"], row["share"]), []
                ids = np.frombuffer(row["reps"], np.int64)
                units = np.frombuffer(row["units"]).reshape(len(ids), -1)
                new = (ids, np.frombuffer(row["weights"], np.int64), units, placed(units, axes_of(axes, units.shape[1])))
                if row["own"]:
                    held.append(new)
                    if row["share"] == 0:
                        for other in held:
                            yield from _joined(other, new, least, eps)
                else:
                    for other in held:
                        yield from _joined(other, new, least, eps)

    found = cut(dealt.mapInArrow(search, "rep long, n long, root long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    known = reps.select("rep", "grp", "digest", "weight", "low").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.withColumn("root", F.coalesce("root", "rep"))
    lows = known.groupBy("root").agg(F.min("low").alias("component_id"))
    named = cut(known.join(lows, "root").select("grp", "digest", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    alone = rows.filter("unit IS NULL OR id IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    linked = rows.filter("unit IS NOT NULL AND id IS NOT NULL").join(named, ["grp", "digest"]).select("id", "n_links", "component_id")
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _joined(x: tuple, y: tuple, least: float, eps: float) -> Iterator[pa.RecordBatch]:
    """rep, n, root of the vectors of two blocks (or of one) that have links there."""
    (ra, wa, ua, pa_), (rb, wb, ub, pb), same = x, y, x is y
    na, nb = np.zeros(len(ra), np.int64), np.zeros(len(rb), np.int64)
    root, links, held = np.arange(len(ra) + (0 if same else len(rb))), [], 0
    for i, j in interval_links(ua, pa_, ub, pb, least, eps, same):
        np.add.at(na, i, wb[j])
        np.add.at(na if same else nb, j, wa[i])
        links.append((i, j if same else j + len(ra)))
        held += len(i)
        if held >= HELD:
            root, links, held = _folded(root, links), [], 0
    root = _folded(root, links)
    ids, n = (ra, na) if same else (np.concatenate((ra, rb)), np.concatenate((na, nb)))
    some = n > 0
    if some.any():
        yield pa.RecordBatch.from_pydict({"rep": ids[some], "n": n[some], "root": ids[root[some]]})


def _folded(root: np.ndarray, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    a, b = zip((np.arange(len(root)), root), *links)
    return union_find(np.concatenate(a), np.concatenate(b), len(root))


def _block(held: list[tuple], axes: dict[int, np.ndarray], tile: int) -> pa.RecordBatch:
    units = np.frombuffer(b"".join(x[3] for x in held)).reshape(len(held), -1)
    at = placed(units, axes_of(axes, units.shape[1]))
    ints = lambda k: np.array([x[k] for x in held], np.int64).tobytes()
    row = {"grp": [held[0][0]], "tile": [tile], "reps": [ints(1)], "weights": [ints(2)], "units": [units.tobytes()], "low": [at.min(0).tolist()], "high": [at.max(0).tolist()]}
    kinds = (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()))
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row.values(), kinds, strict=True)], list(row))


def op7(df: DataFrame) -> DataFrame:
    return linked_vectors(df)


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.98),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN n USING (vec_id) JOIN c USING (vec_id)
"""
