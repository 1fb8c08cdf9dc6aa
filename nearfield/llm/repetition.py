"""Quality rules on repetition inside a text: suffix arrays and longest common prefixes over words."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame

from nearfield.llm.common import map_text

#: What ends a word, and what counts as a symbol.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
_A_WORD = re.compile(r"[^\x20\x09-\x0D]")


def suffix_ranks(docs: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ranks of all suffixes of some documents' word numbers by their first 1, 2, 4, ... words.

    Documents never compare equal to each other, and the end of one sorts before any word. Prefixes double for the
    suffixes that share a rank; the others keep theirs. Returns the ranks of each doubling (one more entry than
    words; ties share the place of their first), and where each word's document ends.
    """
    sizes = np.array([len(d) for d in docs])
    words = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
    n = len(words)
    ends = np.repeat(np.cumsum(sizes), sizes)
    doc = np.repeat(np.arange(len(docs), dtype=np.int64), sizes)
    most = int(words.max()) + 1 if n else 1
    rank = np.full(n + 1, -1, np.int64)
    open_ = _rank(rank, np.arange(n), doc * most + words, np.zeros(n, np.int64))
    levels, width = [rank.astype(np.int32)], 1
    while len(open_):
        after = open_ + width
        key = np.where(after < ends[open_], rank[np.minimum(after, n)], -1)
        rank = rank.copy()
        open_ = _rank(rank, open_, key, rank[open_])
        levels.append(rank.astype(np.int32))
        width *= 2
    return levels, ends, doc


def _rank(rank: np.ndarray, at: np.ndarray, key: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Ranks positions ``at`` anew within each old rank ``base`` by ``key``; returns those that still share one."""
    order = np.argsort(base * (len(rank) + 1) + (key + 1), kind="stable") if base.any() else np.argsort(key, kind="stable")
    base, key = base[order], key[order]
    new = np.concatenate(([True], (base[1:] != base[:-1]) | (key[1:] != key[:-1])))[: len(order)]
    place = np.arange(len(order))
    group = np.concatenate(([True], base[1:] != base[:-1]))[: len(order)]
    start = np.maximum.accumulate(np.where(group, place, 0))
    first = np.maximum.accumulate(np.where(new, place, 0))
    rank[at[order]] = base + (first - start)
    count = np.bincount(np.cumsum(new) - 1)
    return np.sort(at[order][np.repeat(count > 1, count)])


def longest_repeats(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each word, the length of the longest run from it on that its document holds elsewhere too, and its document.

    That is the longer of its suffix's two common prefixes in suffix order: the deepest LCP interval around it.
    """
    levels, ends, doc = suffix_ranks(docs)
    n = len(doc)
    longest = np.zeros(n, np.int64)
    shared = np.flatnonzero(np.bincount(levels[0][:n], minlength=1)[levels[0][:n]] > 1)
    if not len(shared):
        return longest, doc
    order = shared[np.argsort(levels[-1][shared])]
    a, b = order[:-1].copy(), order[1:].copy()
    a0, b0, lcp = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    live = levels[0][a] == levels[0][b]
    a, b, at = a[live], b[live], np.flatnonzero(live)
    # All common prefixes at once: the widest doubling on which both still agree, then the narrower ones.
    for k in range(len(levels) - 1, -1, -1):
        same = (a < n) & (b < n)
        same &= (a + (1 << k) <= ends[np.minimum(a, n - 1)]) & (b + (1 << k) <= ends[np.minimum(b, n - 1)])
        same &= levels[k][a] == levels[k][b]
        same &= (doc[np.minimum(a, n - 1)] == doc[a0[at]]) & (doc[np.minimum(b, n - 1)] == doc[b0[at]])
        lcp[at[same]] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    np.maximum.at(longest, a0, lcp)
    np.maximum.at(longest, b0, lcp)
    return longest, doc


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """True for words inside a maximal repeat of ``least`` words or more: the union of the repeats' spans."""
    at = np.flatnonzero(longest >= least)
    before = np.where(at > 0, longest[at - 1], 0)
    at = at[before != longest[at] + 1]  # a run that goes on to the left lies inside a longer one
    edge = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def profile(texts: list[str | None], window: int, least: int) -> dict[str, np.ndarray]:
    """The measures of each text: word, symbol and line counts, repeated words, and the longest repeat in words."""
    numbers: dict[bytes, int] = {}
    docs, words = [], []
    for text in texts:
        found = (text or "").encode().split()  # bytes.split() takes exactly WHITE
        docs.append(np.array([numbers.setdefault(w, len(numbers)) for w in found], np.int64))
        words.append(len(found))
    longest, doc = longest_repeats(docs)
    ends = np.cumsum(words)
    starts = ends - words
    repeated = np.concatenate(([0], np.cumsum(covered(longest, window))))
    spanned = repeated if least == window else np.concatenate(([0], np.cumsum(covered(longest, least))))
    most = np.zeros(len(texts), np.int64)
    np.maximum.at(most, doc, longest)
    plain = [t or "" for t in texts]
    lines = [[x for x in t.split("\n") if _A_WORD.search(x)] for t in plain]
    return {
        "n_words": np.array(words, np.int64),
        "word_chars": np.array([len(t) - sum(map(t.count, WHITE)) for t in plain], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) for t in plain], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeated[ends] - repeated[starts],
        "n_covered_words": spanned[ends] - spanned[starts],
        "longest_repeat": most,
    }


def repetition_rules(
    df: DataFrame, text: str = "text", keep: list[str] | None = None, min_words: int = 10, window: int = 5,
    max_repeat_share: float = 0.2, least: int = 8, max_covered: float = 0.12, max_longest: int = 100,
) -> DataFrame:
    """Each row's measures, base_failed and kept.

    Repeats are maximal runs of words that a text holds twice or more. A text fails the base rules with fewer than
    ``min_words`` words or more than ``max_repeat_share`` of them in repeats of ``window`` words; it is kept if it
    passes them, repeats of ``least`` words cover at most ``max_covered`` of its words and none is longer than
    ``max_longest``. As every repeat of 8 words is one of 5, ``max_covered`` says something only below ``max_repeat_share``.
    A null or empty text has no words and fails. Rows are judged one by one, repeated ones alike; an empty table gives
    no rows. A very long text is one array of word numbers with a few numbers a word for each doubling that still has
    ties. Only ``keep`` and the new columns come out, so other columns may have any name.
    """

    def fn(texts: list[str | None]) -> dict:
        x = profile(texts, window, least)
        x["base_failed"] = (x["n_words"] < min_words) | (1000 * x["n_repeat_words"] > round(1000 * max_repeat_share) * x["n_words"])
        x["kept"] = ~x["base_failed"] & (1000 * x["n_covered_words"] <= round(1000 * max_covered) * x["n_words"]) & (x["longest_repeat"] <= max_longest)
        return x

    counts = ", ".join(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    return map_text(df, text, keep or ["doc_id"], fn, f"{counts}, base_failed boolean, kept boolean, n_covered_words long, longest_repeat long")


def op1(df: DataFrame) -> DataFrame:
    return repetition_rules(df).drop("n_covered_words", "longest_repeat")


def sql(window: int = 5, least: int = 8, longest: int = 100, percent: int = 12) -> str:
    """The rules for DuckDB: a repeat of k words is a window of k words that its text holds twice."""

    def twice(k: int) -> str:
        return f"""s{k} AS (SELECT doc_id, ws, unnest(range(1, len(ws) - {k} + 2)) AS i FROM w),
r{k} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, list_slice(ws, i, i + {k - 1})) AS c FROM s{k}) WHERE c > 1),
n{k} AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {k})) AS j FROM r{k}) GROUP BY 1)"""

    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
{twice(window)},
{twice(least)},
{twice(longest + 1)},
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(a.n, 0) AS BIGINT) AS n_repeat_words, coalesce(b.n, 0) AS n_covered, c.n IS NOT NULL AS long
  FROM w LEFT JOIN d USING (doc_id) LEFT JOIN n{window} a USING (doc_id) LEFT JOIN n{least} b USING (doc_id) LEFT JOIN n{longest + 1} c USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * n_covered <= {percent} * n_words AND NOT long AS kept FROM f
"""
