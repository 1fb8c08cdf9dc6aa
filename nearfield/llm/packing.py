"""Packing token pieces into fixed windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import base64
import heapq
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, map_text

_ENCODERS: dict[tuple, "Encoder"] = {}


def default_tokenizer() -> tuple[str, str]:
    """The vocabulary for tokenizers, and the same one as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of whole texts by a byte-level BPE file for tokenizers.

    Where the same vocabulary is also given as ranks, texts go through tiktoken, which is faster and gives the same
    ids; a text that may hold a special string still goes through tokenizers.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.marks = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids; null counts as empty."""
        text = text or ""
        if self.plain is None or any(m in text for m in self.marks):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def token_pieces(df: DataFrame, capacity: int = 2048, end: int = 1, text: str = "text", key: str = "doc_id", tokenizer: tuple | None = None, tail: int = 512) -> DataFrame:
    """One row for each piece of each row's tokens, ``end`` added: key, start, length, ids_crc32, doc_tokens.

    Pieces have ``capacity`` tokens; what is left at a document's end is cut into pieces of ``tail`` tokens, small
    enough for windows to come out nearly equal. A null text is an empty one (its only token is ``end``); rows that
    repeat give their pieces again, null keys as well; an empty table gives none. A very long text is encoded whole, as one
    array of ids. Only ``key`` and the new columns come out; ``key`` must not have the name of one of these.
    ``tokenizer``: a path for tokenizers, and one of the same vocabulary as ranks or None.
    """
    paths, last = tokenizer or default_tokenizer(), np.array([end], "<u4").tobytes()

    def fn(texts: list[str | None]) -> dict:
        encoder = _ENCODERS.get(paths) or _ENCODERS.setdefault(paths, Encoder(*paths))
        return {"pieces": [_pieces(encoder.ids(t) + last, capacity, tail) for t in texts]}

    piece = "start: bigint, length: bigint, ids_crc32: bigint, doc_tokens: bigint"
    rows = map_text(df, text, [key], fn, f"pieces array<struct<{piece}>>")
    return rows.select(key, F.explode("pieces").alias("p")).select(key, "p.*")


def _pieces(ids: bytes, capacity: int, tail: int) -> list[dict]:
    n = len(ids) // 4
    whole = n - n % capacity
    cuts = [*range(0, whole, capacity), *range(whole, n, tail), n]
    return [{"start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[4 * a : 4 * b]), "doc_tokens": n} for a, b in zip(cuts, cuts[1:])]


def difference(lengths: np.ndarray, windows: int) -> np.ndarray:
    """A window for each length, by multiway differencing: the two partial partitions with the largest spread merge,
    largest sums of the one with smallest sums of the other, until one partition is left."""
    n = len(lengths)
    kids: list[tuple[int, int]] = []  # of merged nodes; a node below n is an item, -1 is nothing
    heap = []
    for i, x in enumerate(lengths.tolist()):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[-1], nodes[-1] = x, i
        heap.append((-x, i, sums, nodes))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        _, _, s1, n1 = heapq.heappop(heap)
        _, _, s2, n2 = heapq.heappop(heap)
        sums, other = s1 + s2[::-1], n2[::-1]
        nodes = np.where(n1 < 0, other, n1)
        both = np.flatnonzero((n1 >= 0) & (other >= 0))
        if len(both):
            nodes[both] = n + len(kids) + np.arange(len(both))
            kids.extend(zip(n1[both].tolist(), other[both].tolist(), strict=True))
        order = np.argsort(sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        sums -= sums[0]
        turn += 1
        heapq.heappush(heap, (-int(sums[-1]), turn, sums, nodes))
    window = np.zeros(n, np.int64)
    for w, top in enumerate(heap[0][3].tolist() if heap else []):
        stack = [top] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = w
            else:
                stack.extend(kids[x - n])
    return window


def fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A window for each length such that none holds more than ``capacity``: differencing with the fewest windows that
    the total needs, then with more whenever one is over capacity."""
    window = np.zeros(len(lengths), np.int64)
    whole = np.flatnonzero(lengths >= capacity)
    window[whole] = np.arange(len(whole))
    rest = np.flatnonzero(lengths < capacity)
    if len(rest):
        windows = max(1, -(-int(lengths[rest].sum()) // capacity))
        while True:
            got = difference(lengths[rest], windows)
            if np.bincount(got, lengths[rest]).max() <= capacity:
                break
            windows += 1
        window[rest] = len(whole) + np.unique(got, return_inverse=True)[1]
    return window


def pack(pieces: DataFrame, capacity: int = 2048, length: str = "length", windows_a_group: int = 128) -> DataFrame:
    """``pieces`` with sequence_id and offset: every row in one sequence, sequences of ``capacity`` at most, offsets gapless.

    Rows are dealt by a hash of their number into groups of about ``windows_a_group`` windows, so groups stay of
    one size however large the input and however often rows repeat. Lengths must lie in 1 to ``capacity``; a null
    length is an error. An empty input gives no rows. Columns named sequence_id or offset give way to the new ones.
    """
    rows = cut(pieces.withColumn("__nf_row", F.monotonically_increasing_id()))
    total = rows.agg(F.sum(length)).first()[0] or 0
    groups = max(1, -(-int(total) // (capacity * windows_a_group)))
    dealt = rows.withColumn("__nf_group", F.pmod(F.xxhash64("__nf_row"), F.lit(groups)))
    shape = dealt.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).drop("__nf_row", "__nf_group").schema
    names = shape.fieldNames()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("__nf_row", ignore_index=True)
        sizes = group[length].to_numpy(np.int64)
        if (sizes < 1).any() or (sizes > capacity).any():
            raise ValueError(f"lengths must lie in 1 to {capacity}")
        window = fit(sizes, capacity)
        order = np.argsort(window, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate(([True], np.diff(window[order]) > 0))
        base = np.maximum.accumulate(np.where(first, ends - sizes[order], 0))
        offset = np.empty(len(sizes), np.int64)
        offset[order] = ends - sizes[order] - base
        group["sequence_id"] = group["__nf_group"].to_numpy(np.int64) * (1 << 24) + window
        group["offset"] = offset
        return group[names]

    return dealt.groupBy("__nf_group").applyInPandas(run, shape)


def windows_of(lengths: np.ndarray, capacity: int) -> Iterator[list[int]]:
    """Indices by window, for callers with an array at hand."""
    window = fit(lengths, capacity)
    for w in range(int(window.max()) + 1 if len(window) else 0):
        yield np.flatnonzero(window == w).tolist()


def op2(df: DataFrame, capacity: int = 2048) -> DataFrame:
    return pack(token_pieces(df, capacity), capacity)
