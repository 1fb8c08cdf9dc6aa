"""SimHash near-dedup: fingerprints, and their links by a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import components, cut, map_text, union_find

#: The 64 bits fall into blocks of 16; two fingerprints that differ in 2 bits agree on 2 of the 4 blocks.
BLOCKS = 4
AGREE = tuple(combinations(range(BLOCKS), 2))
#: Fingerprints of several groups that a task walks together, node pairs that it holds at a time, and fingerprints of a
#: group above which its node pairs are dealt over tasks.
TRIE_ROWS, TRIE_PAIRS, TRIE_GROUP = 300_000, 1_000_000, 100_000
#: Bits by which nodes lie deeper each time that a group is dealt anew.
STEP = 8


def fingerprints_of(texts: list[str | None], size: int = 3) -> np.ndarray:
    """The 64-bit fingerprint of each text over its shingles of ``size`` words; zero without words."""
    import xxhash

    digest = xxhash.xxh64_digest
    hashes, counts = [], []
    for text in texts:
        words = (text or "").encode().lower().split()  # bytes: only A-Z change, only \x20 and \x09-\x0D end a word
        if len(words) < size:
            hashes.append(digest(b" ".join(words), 42) if words else b"")
            counts.append(1 if words else 0)
            continue
        joined = b" ".join(words)
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes.append(b"".join([digest(joined[a : b - 1], 42) for a, b in zip(starts, ends[size - 1 :])]))
        counts.append(len(words) - size + 1)
    bits = np.unpackbits(np.frombuffer(b"".join(hashes), np.uint8)).reshape(-1, 64)
    counts = np.array(counts)
    out = np.zeros((len(texts), 64), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        out[some] = np.add.reduceat(bits, (np.cumsum(counts) - counts)[some], axis=0, dtype=np.int32)
    return np.packbits(2 * out > counts[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def simhash(df: DataFrame, text: str = "text", keep: list[str] | None = None, size: int = 3) -> DataFrame:
    """``keep`` and fp, the 64-bit fingerprint as a signed long. A null text has no words, like an empty one: zero."""
    return map_text(df, text, keep or ["doc_id"], lambda texts: {"fp": fingerprints_of(texts, size).view(np.int64)}, "fp long")


def trie_links(group: np.ndarray, side: np.ndarray, rest: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal ``group`` whose 32-bit ``rest`` differ in at most ``budget`` bits, as spanning (row, root) pairs.

    Rows must be distinct and in order of group, side and rest. A group is the leaves of one binary trie or, where it
    has rows of side 1, two nodes' leaves of which only pairs across count. Node pairs are walked together from
    there down: a pair's children pair up at no error where their bits agree and at one more where they don't; a pair
    beyond the budget is dropped with all below it. A pair of two leaves is settled by its remaining bits at once.
    Pairs wait on a stack, so memory stays bounded.
    """
    n = len(group)
    first = np.flatnonzero(np.diff(group, prepend=group[0] - 1 if n else 0))
    last = np.append(first[1:], n)
    middle = last - np.add.reduceat(side, first) if n else last
    two = middle < last
    alo, ahi, blo, bhi = first, np.where(two, middle, last), np.where(two, middle, first), last
    some = (ahi > alo) & (two | (last - first > 1))
    ones = {}
    root = np.arange(n)
    stack = [(31, *(x[some] for x in (alo, ahi, blo, bhi)), np.zeros(int(some.sum()), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, err = stack.pop()
        if len(alo) > TRIE_PAIRS:
            half = len(alo) // 2
            stack += [(bit, *(x[:half] for x in (alo, ahi, blo, bhi, err))), (bit, *(x[half:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        lone = (ahi - alo == 1) & (bhi - blo == 1)
        if lone.any():
            a, b = alo[lone], blo[lone]
            far = np.bitwise_count(rest[a] ^ rest[b])
            near = (a != b) & (far <= budget)
            root = _joined(root, a[near], b[near])
            alo, ahi, blo, bhi, err = (x[~lone] for x in (alo, ahi, blo, bhi, err))
        if bit < 0 or not len(alo):
            continue
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((rest >> np.uint32(bit)) & np.uint32(1), dtype=np.int64)))
        c = ones[bit]
        amid, bmid = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        same = (alo == blo) & (ahi == bhi)
        new = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1)]
        new.append(tuple(x[~same] for x in (amid, ahi, blo, bmid, err + 1)))
        parts = [np.concatenate(x) for x in zip(*new, strict=True)]
        live = (parts[0] < parts[1]) & (parts[2] < parts[3]) & (parts[4] <= budget)
        live &= ~((parts[0] == parts[2]) & (parts[1] - parts[0] == 1) & (parts[3] - parts[2] == 1))
        stack.append((bit - 1, *(x[live] for x in parts)))
    rows = np.flatnonzero(root != np.arange(n))
    return rows, root[rows]


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if not len(a):
        return root
    held = np.flatnonzero(root != np.arange(len(root)))
    return union_find(np.concatenate((a, held)), np.concatenate((b, root[held])), len(root))


def fingerprint_links(prints: DataFrame, budget: int = 2) -> DataFrame:
    """Spanning links (a, b) of the distinct fingerprints in ``prints`` (fp) that differ in at most ``budget`` (2) bits.

    Each fingerprint goes to six tries, by the two blocks of 16 bits that the tries of one pair of blocks share; the
    other 32 bits are walked. A trie of very many fingerprints is cut into its nodes 8 bits deeper, and each pair of nodes
    within the budget becomes a group of its own (37 at most for a node), again and again while groups are too large; so
    no task holds more than about ``TRIE_GROUP`` of them. Links inside a group leave as a spanning forest, so a dense
    group gives no more rows than it has members.
    """
    if budget > BLOCKS - 2:
        raise ValueError("with four blocks at most 2 bits may differ")
    block = lambda i: F.shiftrightunsigned("fp", 16 * (BLOCKS - 1 - i)).bitwiseAND(F.lit(0xFFFF))
    two = lambda i, j: F.shiftleft(block(i), 16).bitwiseOR(block(j))
    left = [tuple(k for k in range(BLOCKS) if k not in pair) for pair in AGREE]
    each = F.array(*[F.struct(F.lit(t << 32).bitwiseOR(two(*pair)).alias("key"), two(*left[t]).alias("rest")) for t, pair in enumerate(AGREE)])
    # a and b are the nodes' prefixes of ``rest``; side tells in which of the two a row lies.
    zero = F.lit(0).cast("long")
    groups = prints.select("fp", F.explode(each).alias("x")).select("fp", "x.*", zero.alias("a"), zero.alias("b"), F.lit(0).alias("side"))
    by, ready, depth = ["key", "a", "b"], [], 0
    while depth < 32:
        sizes = groups.groupBy(*by).count().filter(F.col("count") > TRIE_GROUP)
        large = cut(sizes.drop("count"))
        if large.isEmpty():
            break
        ready.append(groups.join(large, by, "left_anti").withColumn("depth", F.lit(depth)))
        depth += STEP
        groups = cut(_deeper(groups.join(large, by), depth, budget))
    ready.append(groups.withColumn("depth", F.lit(depth)))
    dealt = reduce(DataFrame.unionByName, ready).withColumn("group", F.xxhash64("depth", *by)).repartition("group").sortWithinPartitions("group", "depth", *by, "side")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in ("group", "depth", *by, "side", "rest", "fp")])
            rows += batch.num_rows
            if rows >= TRIE_ROWS:
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                to = int(np.searchsorted(cols[0], cols[0][-1]))  # the last group may go on
                if to:
                    yield _links([c[:to] for c in cols], budget)
                    cols = [c[to:] for c in cols]
                held, rows = [cols], len(cols[0])
        if rows:
            yield _links([np.concatenate(x) for x in zip(*held, strict=True)], budget)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _deeper(rows: DataFrame, depth: int, budget: int) -> DataFrame:
    """``rows`` of node pairs ``depth`` - STEP bits deep, dealt to the pairs of their children that the budget allows."""
    child = F.shiftrightunsigned("rest", 32 - depth)
    other = F.shiftleft(F.when(F.col("side") == 0, F.col("b")).otherwise(F.col("a")), STEP)
    masks = F.array(*[F.lit(m).cast("long") for m in range(1 << STEP) if m.bit_count() <= budget])
    # A child that agrees with this one in its last bits, and those that differ from it in some.
    near = rows.select("fp", "key", "rest", "side", child.alias("x"), F.explode(F.transform(masks, lambda m: other.bitwiseOR(child.bitwiseAND(F.lit((1 << STEP) - 1)).bitwiseXOR(m)))).alias("y"))
    near = near.filter(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= budget)
    side = F.when(F.col("x") == F.col("y"), 0).when(F.shiftrightunsigned("x", STEP) != F.shiftrightunsigned("y", STEP), F.col("side")).otherwise((F.col("x") > F.col("y")).cast("int"))
    out = near.withColumn("to", side)
    return out.select("fp", "key", "rest", F.when(F.col("to") == 0, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(F.col("to") == 0, F.col("y")).otherwise(F.col("x")).alias("b"), F.col("to").alias("side"))


def _links(cols: list[np.ndarray], budget: int) -> pa.RecordBatch:
    group, depth, key, a, b, side, rest, fp = cols
    order = np.lexsort((rest, side, b, a, key, depth, group))
    fresh = np.zeros(len(order), bool)
    for c in (group, depth, key, a, b):
        fresh[1:] |= c[order][1:] != c[order][:-1]
    rows, roots = trie_links(np.cumsum(fresh), side[order].astype(np.int64), rest[order].astype(np.uint32), budget)
    return pa.RecordBatch.from_pydict({"a": fp[order][rows], "b": fp[order][roots]})


def rooted(each: DataFrame, budget: int = 2) -> DataFrame:
    """``each`` (distinct fp and what else it has) with root: one of the fingerprints that links reach, the same for all of them."""
    roots = components(fingerprint_links(each.select("fp"), budget))
    return each.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def link(prints: DataFrame, key: str = "doc_id", budget: int = 2) -> DataFrame:
    """``prints`` (key, fp and what else it has) with component_id: the smallest key reachable over linked fingerprints.

    Equal fingerprints are linked. A null key never names a component unless all keys of one are null.
    """
    named = rooted(cut(prints.groupBy("fp").agg(F.min(key).alias("low"))), budget)
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    # Written, so that both sides of the last join are dealt anew and a fingerprint with very many rows can be split.
    return prints.join(cut(named.select("fp", "root").join(lows, "root").drop("root")), "fp")


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, budget: int = 2) -> DataFrame:
    """key, fp and component_id of every row: rows whose fingerprints differ in at most ``budget`` bits are linked.

    Null texts are empty ones; repeated rows are linked rows each; an empty table gives no rows. A very long text is
    hashed shingle by shingle in one task. Other columns do not come out, so their names may be anything.
    """
    return link(cut(simhash(df, text, [key], size)), key, budget)


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3, budget: int = 2) -> DataFrame:
    """One row of each component of ``df``: that of the smallest key (null last), then the smallest text hash.

    Of rows with the same key and text the one with the smallest hash over its columns stays. Texts are shuffled
    only for rows that stay; groups of any size are aggregated before they are shuffled. An empty table gives no rows. All
    columns stay; their names may be anything that does not begin with ``__nf_``.
    """
    tagged = df.withColumn("__nf_hash", F.xxhash64(text))
    prints = cut(simhash(tagged.select(F.col(key).alias("__nf_k"), "__nf_hash", F.col(text).alias("t")), "t", ["__nf_k", "__nf_hash"], size))
    first = F.min(F.struct(F.col("__nf_k").isNull().alias("none"), F.col("__nf_k").alias("k"), F.col("__nf_hash").alias("h")))
    each = cut(prints.groupBy("fp").agg(first.alias("low")))
    heads = rooted(each, budget).groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.k").alias("__nf_k"), F.col("low.h").alias("__nf_h"))
    kept = tagged.join(heads, F.col(key).eqNullSafe(F.col("__nf_k")) & (F.col("__nf_hash") == F.col("__nf_h")), "left_semi")
    plain = [F.col(c) for c, t in df.dtypes if "map<" not in t]
    row = F.min_by(F.struct(*[F.col(c) for c in df.columns]), F.xxhash64(*plain))
    return kept.groupBy(F.col(key).alias("__nf_k"), "__nf_hash").agg(row.alias("__nf_row")).select("__nf_row.*")


def op4(df: DataFrame) -> DataFrame:
    found = near_duplicates(df)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
