"""Items as blocks of vectors, and what several operators work out for pairs of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Items and bytes of vectors in a block at most; bytes of blocks that are sent to every task at most.
BLOCK, BLOCK_BYTES, SENT_BYTES = 1024, 4 << 20, 32 << 20
#: Scores from matrix products may differ by this much from those worked out pair by pair.
SLACK = 1e-9
#: Pairs of items that are scored one by one at a time, and bytes of hits that a task gathers at most.
PAIRS, HELD_BYTES = 1 << 16, 384 << 20


def blocks(df: DataFrame, id_col: str, names: tuple[str, ...], label: Column | None = None, by: Column | None = None) -> DataFrame:
    """ids, labels, widths, vectors, by: rows of ``df`` (whole-number ids, one array for each name) packed where they lie.

    A block holds rows of one ``by`` only, so rows should be sorted by it. A null vector, or vectors of one name with
    different widths, are errors.
    """
    label, by = (F.lit(None) if x is None else x for x in (label, by))
    flat = df.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.coalesce(by.cast("long"), F.lit(0)).alias("by"), *[F.col(f).cast("array<double>").alias(f) for f in names])
    layout = pa.schema([("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("widths", pa.list_(pa.int32())), ("vectors", pa.binary()), ("by", pa.int64())])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [_matrix(batch.column(f), f) for f in names]
            rows, ids, key = np.hstack(found), batch.column("id").to_numpy().astype(np.int64), batch.column("by").to_numpy()
            step = max(1, min(BLOCK, BLOCK_BYTES // max(1, rows[0].nbytes)))
            edges = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
            for lo, hi in zip(edges, edges[1:]):
                for at in range(lo, hi, step):
                    to = min(at + step, hi)
                    row = {
                        "ids": ids[at:to].tobytes(), "labels": batch.column("label").slice(at, to - at).to_pylist(),
                        "widths": [x.shape[1] for x in found], "vectors": rows[at:to].tobytes(), "by": int(key[at]),
                    }
                    yield pa.RecordBatch.from_pylist([row], schema=layout)

    return flat.mapInArrow(pack, "ids binary, labels array<string>, widths array<int>, vectors binary, by long")


def _matrix(column: pa.Array, name: str) -> np.ndarray:
    widths = pc.list_value_length(column)
    if widths.null_count or pc.count_distinct(widths).as_py() > 1:
        raise ValueError(f"{name}: vectors are missing or differ in width")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def joined(packed: DataFrame) -> DataFrame:
    """ids, widths, vectors: small blocks that lie side by side as full ones."""
    layout, most = pa.schema([("ids", pa.binary()), ("widths", pa.list_(pa.int32())), ("vectors", pa.binary())]), 8 * BLOCK

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            if held and sum(len(r["ids"]) for r in held) + len(row["ids"]) > most:
                yield pa.RecordBatch.from_pylist([held[0] | {c: b"".join(r[c] for r in held) for c in ("ids", "vectors")}], schema=layout)
                held = []
            held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist([held[0] | {c: b"".join(r[c] for r in held) for c in ("ids", "vectors")}], schema=layout)

    return packed.select("ids", "widths", "vectors").mapInArrow(run, "ids binary, widths array<int>, vectors binary")


def asking(df: DataFrame) -> DataFrame:
    """Blocks as the asking side: q_ columns."""
    return df.select(*[F.col(c).alias(f"q_{c}") for c in df.columns])


def pairs(queries: DataFrame, corpus: DataFrame, id_col: str, names: tuple[str, ...]) -> DataFrame:
    """Blocks of ``queries`` (q_ columns) with every block of ``corpus``. Queries of checked size are broadcast, and the
    corpus then stays where it lies; more are dealt, and the blocks joined without it."""
    return crossed(queries, blocks(corpus, id_col, names), id_col, names)


def crossed(queries: DataFrame, packed: DataFrame, id_col: str, names: tuple[str, ...]) -> DataFrame:
    """The same with a corpus that lies in blocks."""
    size = queries.count() * bytes_of(queries, names)
    small = size <= SENT_BYTES
    q = asking(blocks(queries.coalesce(1) if small else queries.repartition(F.col(id_col)), id_col, names))
    return (F.broadcast(q) if small else q).crossJoin(packed)  # of blocks, for a stated set of queries


def bytes_of(df: DataFrame, names: tuple[str, ...]) -> int:
    """Bytes of a row's vectors and id in a block."""
    row = df.select(sum((F.size(f) for f in names), F.lit(1)).alias("n")).first()
    return 8 * row["n"] if row and row["n"] else 0


def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    return ids, np.frombuffer(row[f"{prefix}vectors"]).reshape(len(ids), -1)


def each_pair(rows: DataFrame, fn: Callable[[dict], pa.RecordBatch | None], schema: str) -> DataFrame:
    """What ``fn`` makes of each pair of blocks, one pair in memory at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                got = fn(batch.slice(i, 1).to_pylist()[0])
                if got is not None:
                    yield got

    return rows.mapInArrow(run, schema)


class Best:
    """The ``k`` best hits so far of each of ``n`` queries: score (-inf: none), id and ``extra`` numbers of each, best first.

    Blocks are met one after the other, so what is kept does not grow with them, and of a further block only those items
    are looked at whose score reaches the k-th one so far, and ``floor``, a score that each query's k-th best is known to reach.
    """

    def __init__(self, n: int, k: int, extra: int = 0, floor: np.ndarray | None = None):
        self.score, self.id, self.extra = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.zeros((n, k, extra))
        self.floor = np.full(n, -np.inf) if floor is None else floor

    @property
    def nbytes(self) -> int:
        return self.score.nbytes + self.id.nbytes + self.extra.nbytes

    def meet(self, approx: np.ndarray, ids: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray | None]], slack: float = SLACK) -> None:
        """Takes in a block: ``approx`` scores of each query (row) with each item, -inf is no hit; by exact score, then lower id.

        Equal vectors must score equally wherever they lie, which matrix products do not promise: what comes near the k-th
        score is scored again pair by pair by ``exact`` (scores and extra numbers of index pairs). ``approx`` may be off by ``slack``.
        """
        place = self.near(approx, slack)
        for at in range(0, len(place), PAIRS):
            i, j = np.divmod(place[at : at + PAIRS], approx.shape[1])
            score, extra = exact(i, j)
            self.take(i, score, ids[j], extra)

    def least(self, first: int, n: int) -> np.ndarray:
        """What a hit's score must reach, for ``n`` queries from ``first`` on; -inf if that is not known."""
        return np.maximum(self.score[first : first + n, -1], self.floor[first : first + n])

    def near(self, approx: np.ndarray, slack: float = SLACK, first: int = 0, times: float = 1.0) -> np.ndarray:
        """Places in ``approx`` (flat) of what may be a hit: its rows are the queries from ``first`` on, its numbers scores over ``times``."""
        k, least = self.score.shape[1], self.least(first, len(approx))
        short = np.flatnonzero(least == -np.inf)
        if len(short):
            least[short] = _reached(approx[short], k) * times
        bar = lambda: np.maximum((least - slack) / times, np.finfo(approx.dtype).min / 4).astype(approx.dtype)
        some = np.flatnonzero(np.fmax.reduce(approx, axis=1, initial=-np.inf) >= bar())
        mask = approx[some] >= bar()[some, None]
        if np.count_nonzero(mask) > 4 * k * len(some):  # far better items than all before
            least[some] = np.maximum(least[some], _reached(approx[some], k) * times)
            mask = approx[some] >= bar()[some, None]
        i, j = np.divmod(places(mask), approx.shape[1])
        return some[i] * approx.shape[1] + j

    def take(self, i: np.ndarray, score: np.ndarray, ids: np.ndarray, extra: np.ndarray | None = None) -> None:
        """Takes in items by exact scores with queries ``i``."""
        k, good = self.score.shape[1], score >= np.maximum(self.score[i, -1], self.floor[i])
        if not good.any():
            return
        i, score, ids, extra = i[good], score[good], ids[good], np.zeros((good.sum(), 0)) if extra is None else extra[good]
        order = np.lexsort((ids, -score, i))
        i, score, ids, extra = i[order], score[order], ids[order], extra[order]
        who, at = np.unique(i, return_inverse=True)
        # A new hit comes after the old ones that are better and the new ones before it; an old one goes down by the new ones that are better.
        old_score, old_id = self.score[i], self.id[i]
        before = ((old_score > score[:, None]) | ((old_score == score[:, None]) & (old_id <= ids[:, None]))).sum(1)
        down = np.bincount(at * (k + 1) + before, minlength=len(who) * (k + 1)).reshape(-1, k + 1).cumsum(1)
        to = np.minimum(before + np.arange(len(i)) - np.searchsorted(i, i), k)
        row, place = np.arange(len(who))[:, None], np.minimum(np.arange(k) + down[:, :k], k)
        for held, new in ((self.score, score), (self.id, ids), (self.extra, extra)):
            out = np.empty((len(who), k + 1, *held.shape[2:]), held.dtype)
            out[row, place], out[at, to] = held[who], new
            held[who] = out[:, :k]

    def hits(self) -> tuple[np.ndarray, np.ndarray]:
        """Query and place of each hit."""
        return np.nonzero(self.score > -np.inf)


def _reached(scores: np.ndarray, k: int) -> np.ndarray:
    """A score that ``k`` items of each row reach, and few more; -inf without as many. Items are taken by groups, as halves are laid over
    each other: the k-th best group is reached by k items."""
    if scores.shape[1] <= k:
        return np.full(len(scores), -np.inf)
    while (half := scores.shape[1] // 2) >= 8 * k:
        scores = np.fmax(scores[:, :half], scores[:, half : 2 * half])
    return np.partition(scores, -k, axis=1)[:, -k]


def places(mask: np.ndarray) -> np.ndarray:
    """Flat places of the few that are true, by words of eight first."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64) != 0)
    within = np.flatnonzero(flat.reshape(-1, 8)[words].ravel())
    return words[within >> 3] * 8 + (within & 7)


def gathered(rows: DataFrame, meet: Callable[[dict, dict], None], told: Callable[[dict], pa.RecordBatch], schema: str) -> DataFrame:
    """For each block of queries what it gathers from all blocks that it meets in a task: ``meet`` is called with what it has gathered
    (a dict of Best) and a pair of blocks, ``told`` with that and its q_ids when the task ends or holds ``HELD_BYTES``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, bytes], dict] = {}
        size = 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                key = row["q_ids"], row["q_vectors"]
                if key not in held:
                    if size > HELD_BYTES:
                        yield from (told({"q_ids": np.frombuffer(k[0], np.int64)} | h) for k, h in held.items())
                        held, size = {}, 0
                    held[key] = {}
                    meet(held[key], row)
                    size += sum(map(len, key)) + sum(b.nbytes for b in held[key].values())
                else:
                    meet(held[key], row)
        yield from (told({"q_ids": np.frombuffer(k[0], np.int64)} | h) for k, h in held.items())

    return rows.mapInArrow(run, schema)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of each row of ``a`` with the same row of ``b``, the same for equal rows wherever they lie."""
    return np.einsum("ij,ij->i", np.ascontiguousarray(a), np.ascontiguousarray(b))
