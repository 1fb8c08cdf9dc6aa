"""Benchmark decontamination: windows of normalised words of test items, looked for in whole training texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, map_text

#: Words of a window. Bytes of items that are sent to every task whole; of more, a bitmap of so many bits is.
WINDOW, SENT_BYTES, BITMAP_BITS = 10, 16 << 20, 1 << 28
#: Windows of one batch that are compared at a time.
HELD = 1 << 20
#: Odd multipliers of the words of a window.
_FACTORS = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(64)], np.uint64)

#: ASCII letters and digits and everything beyond ASCII make words; A-Z are lower-cased.
_PLAIN = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in bytes(range(256)).lower())
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text as UTF-8; none of a null one."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def mixed(words: np.ndarray) -> np.ndarray:
    """A hash of each row of numbers."""
    h = (words.astype(np.uint64) * _FACTORS[: words.shape[1]]).sum(1, dtype=np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Windows:
    """The windows of items (name, words): by length, their hashes in order with what they hold and who holds them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.names = sorted({n for n, w in items if w})
        at = {n: i for i, n in enumerate(self.names)}
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary))
        rows: dict[int, list[np.ndarray]] = {}
        for name, words in items:
            if words:
                ids = np.array([number(w) for w in words], np.int64)
                cut_ = np.lib.stride_tricks.sliding_window_view(ids, min(width, len(ids)))
                rows.setdefault(cut_.shape[1], []).append(np.column_stack([cut_, np.full(len(cut_), at[name])]))
        #: length -> hashes (sorted, distinct windows), the windows, where each one's owners begin, owners
        self.by_length = {}
        for n, parts in sorted(rows.items()):
            every = np.unique(np.vstack(parts), axis=0)
            new = np.append(True, (every[1:, :n] != every[:-1, :n]).any(1))
            begin, windows = np.append(np.flatnonzero(new), len(every)), every[new, :n]
            order = np.argsort(h := mixed(windows), kind="stable")
            self.by_length[n] = (h[order], windows[order], begin[:-1][order], begin[1:][order], every[:, n])

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """length, places and rows (of ``by_length``) of the windows in a text's word numbers (-1: in no item)."""
        strange = np.flatnonzero(ids < 0)
        edges = np.concatenate([[-1], strange, [len(ids)]])
        lo, room = edges[:-1] + 1, np.diff(edges) - 1
        for n, (hashes, windows, *_) in self.by_length.items():
            fit = room >= n
            if not fit.any():
                continue
            starts = np.concatenate([np.arange(a, a + r - n + 1) for a, r in zip(lo[fit], room[fit], strict=True)])
            for some in np.split(starts, range(HELD, len(starts), HELD)):
                own = ids[some[:, None] + np.arange(n)]
                h = mixed(own)
                row = np.searchsorted(hashes, h)
                while len(some):  # equal hashes lie side by side
                    live = (row < len(hashes)) & (hashes[np.minimum(row, len(hashes) - 1)] == h)
                    some, own, h, row = some[live], own[live], h[live], row[live]
                    same = (windows[row] == own).all(1)
                    if same.any():
                        yield n, some[same], row[same]
                    some, own, h, row = some[~same], own[~same], h[~same], row[~same] + 1


def _spans(text: str, hit: np.ndarray) -> list[dict]:
    """Code point spans from the first to the last word of each run of hit words."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text.translate(_LOWER))]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in edges.reshape(-1, 2)]


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start: int, end: int>>"


def _named(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).cast("string").alias("t"))


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, item: str = "item_id", item_text: str = "text", width: int = WINDOW, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """Columns ``keep`` of each row with n_words, n_hit, items (names in order, as strings) and spans (code points, end exclusive).

    Texts are compared by words: letters, digits and all beyond ASCII, A-Z lower-cased. ``width`` consecutive words of an
    item are a window; an item of fewer is one window; one without words, or null, has none. A word inside any occurrence
    of a window is hit; runs of hit words are a span. Items with one name are one item, null counts as an empty name.
    Null texts have no words. Repeated rows come out alike; an empty table, or no items, is no error. Only ``keep`` and
    the new columns come out, so others may have any name.

    Items of at most ``sent_bytes`` (measured) are sent to every task and a text is settled where it lies, without a
    shuffle. More are not sent: a bitmap of their windows' hashes is (32 MB, whatever their number), and the windows of
    texts that pass it are joined to the items' windows and compared word by word.
    """
    keep = keep or ["doc_id"]
    named = _named(benchmark, item, item_text)
    size = named.agg(F.sum(F.octet_length("t") + F.octet_length("item") + 16)).first()[0] or 0
    if size > sent_bytes:
        return _joined(df, named, text, keep, width)
    rows = [(r["item"], words_of(r["t"])) for r in named.collect()]  # of checked size
    sent = df.sparkSession.sparkContext.broadcast(Windows(rows, width))

    def fn(texts: list[str | None]) -> dict:
        w = sent.value
        out: dict[str, list] = {c: [] for c in ("n_words", "n_hit", "items", "spans")}
        for t in texts:
            words = words_of(t)
            ids = np.fromiter(map(w.vocabulary.get, words, repeat(-1)), np.int64, len(words))
            hit, owners = np.zeros(len(ids), bool), set()
            for n, places, found in w.hits(ids):
                _, _, begin, end, own = w.by_length[n]
                hit[(places[:, None] + np.arange(n)).ravel()] = True
                for r in np.unique(found):
                    owners.update(own[begin[r] : end[r]].tolist())
            for c, v in zip(out, (len(ids), int(hit.sum()), [w.names[i] for i in sorted(owners)], _spans(t, hit) if owners else []), strict=True):
                out[c].append(v)
        return out

    return map_text(df, text, keep, fn, FOUND)


def _number(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def _windows(words: list[bytes], n: int, memo: dict[bytes, int]) -> np.ndarray:
    """Hashes of the windows of ``n`` words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    for x in words:
        if x not in memo:
            memo[x] = _number(x)
    ids = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    return np.concatenate([mixed(part) for part in np.array_split(np.lib.stride_tricks.sliding_window_view(ids, n), 1 + len(ids) // HELD)])


def _joined(df: DataFrame, named: DataFrame, text: str, keep: list[str], width: int) -> DataFrame:
    spark = df.sparkSession
    layout = "item string, n int, h long, w string"

    def item_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in zip(batch.column("item").to_pylist(), batch.column("t").to_pylist(), strict=True):
                words, memo = words_of(t), {}
                n = min(width, len(words))
                h = _windows(words, n, memo) if n else np.zeros(0, np.uint64)
                for at in range(0, len(h), 4096):
                    some = range(at, min(at + 4096, len(h)))
                    yield pa.RecordBatch.from_pydict({"item": [name] * len(some), "n": pa.array([n] * len(some), pa.int32()), "h": h[at : at + 4096].view(np.int64), "w": [b" ".join(words[i : i + n]).decode("utf-8", "surrogatepass") for i in some]})

    items = cut(named.mapInArrow(item_windows, layout).distinct())
    lengths = sorted(r["n"] for r in items.select("n").distinct().collect())  # ``width`` at most
    place = F.pmod(F.col("h"), F.lit(BITMAP_BITS))
    words = items.groupBy(F.shiftright(place, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(h, 64) AS int))")).alias("bits"))
    bitmap = np.zeros(BITMAP_BITS // 64, np.int64)
    for part in words.toArrow().to_batches():  # BITMAP_BITS / 64 rows at most
        bitmap[part.column("at").to_numpy()] = part.column("bits").to_numpy()
    sent = spark.sparkContext.broadcast(bitmap)

    def passing(texts: list[str | None]) -> dict:
        memo: dict[bytes, int] = {}
        out: dict[str, list] = {"n_words": [], "c": []}
        for t in texts:
            ws, found = words_of(t), []
            for n in lengths:
                h = _windows(ws, n, memo)
                p = (h.view(np.int64) % BITMAP_BITS).astype(np.int64)
                for i in np.flatnonzero((sent.value[p >> 6] >> (p & 63)) & 1):
                    found.append({"n": n, "h": int(h[i : i + 1].view(np.int64)[0]), "at": int(i), "w": b" ".join(ws[i : i + n]).decode("utf-8", "surrogatepass")})
            out["n_words"].append(len(ws))
            out["c"].append(found)
            if len(memo) > HELD:
                memo.clear()
        return out

    # Rows of one text come out alike, so hits are kept for each text once; a text is known by two hashes.
    known = [F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))), F.xxhash64(F.lit("second"), F.coalesce(F.col(text).cast("string"), F.lit("")))]
    rows = df.select(*keep, F.col(text).cast("string").alias("__nf_t"), known[0].alias("__nf_a"), known[1].alias("__nf_b"))
    texts = rows.groupBy("__nf_a", "__nf_b").agg(F.first("__nf_t").alias("__nf_t"))
    got = cut(map_text(texts, "__nf_t", ["__nf_a", "__nf_b"], passing, "n_words long, c array<struct<n: int, h: long, at: int, w: string>>"))
    asked = got.select("__nf_a", "__nf_b", F.explode("c").alias("c")).select("__nf_a", "__nf_b", "c.*")
    met = asked.join(items, ["n", "h", "w"])  # a common window's rows are split by adaptive execution
    hits = met.groupBy("__nf_a", "__nf_b").agg(F.collect_set("item").alias("items"), F.collect_set(F.struct("at", "n")).alias("places"))
    both = rows.join(got.select("__nf_a", "__nf_b", "n_words"), ["__nf_a", "__nf_b"]).join(hits, ["__nf_a", "__nf_b"], "left")

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit, spans = [], []
            for t, n, places in zip(batch.column("__nf_t").to_pylist(), batch.column("n_words").to_pylist(), batch.column("places").to_pylist(), strict=True):
                hit = np.zeros(n, bool)
                for p in places or ():
                    hit[p["at"] : p["at"] + p["n"]] = True
                n_hit.append(int(hit.sum()))
                spans.append(_spans(t, hit) if places else [])
            cols = [batch.column(c) for c in keep] + [batch.column("n_words"), pa.array(n_hit, pa.int64()), batch.column("items"), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
            yield pa.RecordBatch.from_arrays(cols, names)

    names = [*keep, "n_words", "n_hit", "items", "spans"]
    shaped = both.select(*keep, "__nf_t", "n_words", F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items"), "places")
    fields = df.select(*keep).schema
    for f in spark.createDataFrame([], FOUND).schema:
        fields = fields.add(f)
    return shaped.mapInArrow(settle, fields)


def without_spans(text: str = "text", spans: str = "spans") -> Column:
    """The text without its spans; null stays null."""
    t = F.col(text)
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    begins = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(t)))
    return F.when(t.isNull(), t).otherwise(F.array_join(F.zip_with(ends, begins, lambda a, b: F.substring(t, a + 1, b - a)), ""))


def decontaminate(df: DataFrame, benchmark: DataFrame, remove: str = "spans", text: str = "text", **named) -> DataFrame:
    """``df`` without what ``find`` finds: ``remove`` is "spans" (hit words and what lies between them goes) or "documents".

    All columns stay; their names may be anything that does not begin with ``__nf_``.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    inner = df.withColumn("__nf_all", F.struct(*df.columns))
    found = find(inner.select("__nf_all", F.col(text).alias("__nf_text0")), benchmark, "__nf_text0", ["__nf_all"], **named)
    if remove == "documents":
        return found.filter("n_hit = 0").select("__nf_all.*")
    rest = found.select("__nf_all.*", F.col("spans").alias("__nf_spans"))
    return rest.withColumn(text, F.when(F.size("__nf_spans") > 0, without_spans(text, "__nf_spans")).otherwise(F.col(text))).drop("__nf_spans")


def op13(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    got = find(df, benchmark)
    return got.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p, w FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win FROM i),
s AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, (SELECT DISTINCT n FROM v) WHERE len(w) >= n),
h AS (SELECT doc_id, p, s.n, item FROM s JOIN v ON s.n = v.n AND array_to_string(list_slice(w, p, p + s.n - 1), ' ') = win),
c AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
