"""Token counts: rank-synchronous array merging over ragged numpy arrays."""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import BATCH_CHARS, map_text

NONE = np.iinfo(np.int32).max
#: Counts of pre-tokens that a worker remembers before it starts afresh.
REMEMBERED = 400_000
#: Symbols of a sequence that is merged in passes over all of them; longer ones are swept rank by rank.
SHORT = 64
_SPACES = re.compile(" +[^ ]*")
_MERGERS: dict[str, "PieceMerger"] = {}


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceMerger:
    """Merges of a BPE piece model with byte fallback, as sorted arrays of symbol pairs.

    Symbols are characters and pieces; a pair merges when its concatenation is a piece, lowest rank first and
    leftmost first among equals. Symbols 1 to 4 stand for characters in no piece, by their number of UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        if any(sp.is_unused(i) for i in ids) or sum(sp.is_byte(i) for i in ids) != 256:
            raise ValueError("a BPE model with byte fallback and no unused pieces is needed")
        pieces = {sp.id_to_piece(i): -sp.get_score(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that go on after a word are not handled")
        ranks = {s: r for r, s in enumerate(sorted(set(pieces.values())))}
        symbols = {s: i + 5 for i, s in enumerate(sorted({c for p in pieces for c in p} | pieces.keys()))}
        self.n = len(symbols) + 5
        self.cost = np.ones(self.n, np.int64)
        self.cost[:5] = (0, 1, 2, 3, 4)
        for s, i in symbols.items():
            if s not in pieces:
                self.cost[i] = len(s.encode())
        self.char = np.full(0x110000, 4, np.int32)
        self.char[:0x10000], self.char[:0x800], self.char[:0x80] = 3, 2, 1
        for s, i in symbols.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        pairs, near = {}, set()
        for p, score in pieces.items():
            near.update((self.char[ord(a)] * self.n + self.char[ord(b)]) for a, b in zip(p, p[1:]))
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a and b:
                    pairs[a * self.n + b] = (ranks[score], symbols[p])
        self.keys = np.array(sorted(pairs), np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()] + [NONE], np.int32)
        self.into = np.array([pairs[k][1] for k in self.keys.tolist()] + [0], np.int32)
        self.near = np.array(sorted(near), np.int64)
        self.seen: dict[str, int] = {}
        #: False where merging to this symbol may bring a pair of lower rank.
        self.calm = np.zeros(self.n, bool)
        self.calm = self._calm(list(pieces), {p: ranks[x] for p, x in pieces.items()}, symbols)
        self.blank = self._blank(pieces)

    def _calm(self, pieces: list[str], rank: dict[str, int], symbols: dict[str, int]) -> np.ndarray:
        """A merge can bring a pair of lower rank only if that pair makes a piece that its own text, alone, does not
        come to in order of rank: any other such text, once its ends are ends of symbols, has been merged by then."""
        uneven: set[int] = set()
        left = self.count(pieces, uneven)
        calm = np.ones(self.n, bool)
        for i in uneven | set(np.flatnonzero(left != 1).tolist()):
            p = pieces[i]
            for k in range(1, len(p)):
                for part, other in ((p[:k], p[k:]), (p[k:], p[:k])):
                    if other in symbols and rank.get(part, -1) >= rank[p]:
                        calm[symbols[part]] = False
        return calm

    def _blank(self, pieces: dict[str, float]) -> int:
        """The longest piece of marks alone, if a run of marks gives one such piece after the other from the left; else 0.

        That is so where such pieces share the last rank: the run's first marks then grow to that piece before
        any other pair of the run is due, nothing merges with it, and what follows is a run as before.
        """
        marks = [p for p in pieces if not p.strip("▁") and len(p) > 1]
        other = [p for p in pieces if p[:2] == "▁▁" and p.strip("▁")]
        if not marks or other or {pieces[p] for p in marks} != {max(pieces.values())}:
            return 0
        most = max(map(len, marks))
        got = self.count(["▁" * k for k in range(most, 2 * most + 1)])
        return most if got[0] == 1 and (got[1:-1] == self.count(["▁" * k for k in range(1, most)]) + 1).all() and got[-1] == 2 else 0

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        at[self.keys[at] != keys] = len(self.keys)
        return self.rank[at], self.into[at]

    def count(self, words: list[str], uneven: set[int] | None = None) -> np.ndarray:
        """Tokens of each pre-token (written with its leading space marks). ``uneven`` takes in the numbers of those in
        which a merge brought a pair of lower rank."""
        total = np.zeros(len(words), np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return total
        sym = self.char[points]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        # No merge ever crosses two characters that are neighbours in no piece: there a sequence of its own begins.
        keys = sym[:-1].astype(np.int64) * self.n + sym[1:]
        at = np.minimum(np.searchsorted(self.near, keys), len(self.near) - 1)
        joined = (self.near[at] == keys) & (word[1:] == word[:-1])
        starts = np.flatnonzero(np.concatenate(([True], ~joined)))
        owner, sizes = word[starts], np.diff(np.append(starts, len(sym)))
        long = np.repeat(sizes > SHORT, sizes)
        if long.any():
            self._sweep(sym[long], sizes[sizes > SHORT], owner[sizes > SHORT], total)
            sym, owner, sizes = sym[~long], owner[sizes <= SHORT], sizes[sizes <= SHORT]
        self._passes(sym, sizes, owner, total, uneven)
        return total

    def _taken(self, hit: np.ndarray, follows: np.ndarray, unit: np.ndarray, rank: np.ndarray, into: np.ndarray, beside: Callable) -> tuple[np.ndarray, np.ndarray]:
        """Which of the pairs ``hit`` (in order, each of the lowest rank of its sequence) merge at once, and which of those
        bring a pair of lower rank. Of overlapping pairs (``follows``) every second goes, from the left; in each
        sequence all go up to and with the first that brings a pair of lower rank, for that one is next.

        ``beside`` gives the symbols before and after some of the pairs, -1 for none.
        """
        place = np.arange(len(hit))
        take = (place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0
        bad = np.zeros(len(hit), bool)
        risky = np.flatnonzero(take & ~self.calm[into[hit]])
        if len(risky):
            first, (before, right) = into[hit[risky]], beside(hit[risky])
            # The pair before a run's second merge has become the first one's piece by then.
            left = np.where(follows[risky], into[hit[np.maximum(risky - 2, 0)]], before)
            worse = np.zeros(len(risky), bool)
            for some, x, y in ((left >= 0, left, first), (right >= 0, first, right)):
                worse[some] |= self.pair(x[some], y[some])[0] <= rank[hit[risky[some]]]
            bad[risky] = worse
            upto = np.cumsum(bad) - bad
            own = unit[hit]
            take &= upto == upto[np.searchsorted(own, own)]  # none since the sequence's first pair: units are in order
        return take, bad & take

    def _passes(self, sym: np.ndarray, sizes: np.ndarray, owner: np.ndarray, total: np.ndarray, uneven: set[int] | None) -> None:
        """Short sequences: each pass over the ragged arrays merges every sequence's pairs of lowest rank."""

        def beside(at: np.ndarray, sym: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            before, after = np.maximum(at - 1, 0), np.minimum(at + 2, len(sym) - 1)
            has = lambda to, far: (unit[to] == unit[at]) & far
            return np.where(has(before, at > 0), sym[before], -1), np.where(has(after, at + 2 < len(sym)), sym[after], -1)

        unit = np.repeat(np.arange(len(sizes)), sizes)
        rank, into = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            left = np.flatnonzero(unit[1:] == unit[:-1])
            rank[left], into[left] = self.pair(sym[left], sym[left + 1])
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(sym)))
            if (best == NONE).any():
                over = np.repeat(best == NONE, sizes)
                np.add.at(total, owner[unit[over]], self.cost[sym[over]])
                live = ~over
                sym, unit, rank, into = sym[live], unit[live], rank[live], into[live]
                sizes, best = sizes[best != NONE], best[best != NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, sizes))
            follows = np.concatenate(([False], hit[1:] == hit[:-1] + 1))
            take, bad = self._taken(hit, follows, unit, rank, into, lambda at: beside(at, sym, unit))  # noqa: B023
            if uneven is not None:
                uneven.update(owner[unit[hit[bad]]].tolist())
            hit = hit[take]
            sym[hit] = into[hit]
            live = np.ones(len(sym), bool)
            live[hit + 1] = False
            moved = hit - np.arange(len(hit))
            sym, unit, rank, into = sym[live], unit[live], rank[live], into[live]
            again = np.unique(np.concatenate((moved, moved[moved > 0] - 1)))
            rank[again] = NONE
            again = again[again + 1 < len(sym)]
            again = again[unit[again] == unit[again + 1]]
            rank[again], into[again] = self.pair(sym[again], sym[again + 1])

    def _sweep(self, sym: np.ndarray, sizes: np.ndarray, owner: np.ndarray, total: np.ndarray) -> None:
        """Long sequences: ranks are taken in order, each with all its pairs in all sequences at once, so a step costs
        what it merges and not the whole array. Sequences share no symbols, so each still merges its lowest rank first."""
        n = len(sym)
        unit = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - sizes] = -1, -1
        live = np.ones(n, bool)
        rank, into = np.full(n, NONE, np.int32), np.zeros(n, np.int32)
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def queue(at: np.ndarray) -> None:
            to = after[at]
            some = to >= 0
            rank[at[~some]] = NONE
            at = at[some]
            rank[at], into[at] = self.pair(sym[at], sym[to[some]])
            at = at[rank[at] != NONE]
            at = at[np.argsort(rank[at], kind="stable")]
            r = rank[at]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for part in np.split(at, cuts) if len(at) else ():
                k = int(rank[part[0]])
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(heap, k)
                waiting[k].append(part)

        queue(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            parts = waiting.pop(r)
            hit = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            hit = hit[live[hit] & (rank[hit] == r)]
            if not len(hit):
                continue
            mate = after[hit]
            follows = np.concatenate(([False], mate[:-1] == hit[1:]))
            past = after[mate]
            sides = lambda at: tuple(np.where(to >= 0, sym[to], -1) for to in (before[at], after[after[at]]))
            take, bad = self._taken(hit, follows, unit, rank, into, sides)
            if bad.any():
                waiting[r] = [hit[~take]]
                heapq.heappush(heap, r)
            hit, mate, past = hit[take], mate[take], past[take]
            sym[hit] = into[hit]
            live[mate] = False
            after[hit] = past
            before[past[past >= 0]] = hit[past >= 0]
            near = before[hit]
            queue(np.unique(np.concatenate((hit, near[near >= 0]))))
        np.add.at(total, owner[unit[live]], self.cost[sym[live]])

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text; null counts as empty."""
        docs = []
        for text in texts:
            text = (text or "").replace("▁", " ")
            spaced = text[:1] == " " or "  " in text
            docs.append([] if not text else [w[1:] for w in _SPACES.findall(" " + text)] if spaced else text.split(" "))
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        new = {w for d in docs for w in d if w not in self.seen}
        self.seen.update(zip(new, self._all(list(new)), strict=True))
        get = self.seen.__getitem__
        counts = [sum(map(get, d)) for d in docs]
        for w in new:
            if len(w) > SHORT:  # long words are not remembered
                del self.seen[w]
        return counts

    def _all(self, words: list[str]) -> list[int]:
        """Tokens of each word, about a million characters at a time; a long run of spaces is shortened by whole pieces."""
        out, held, chars = [], [], 0
        for w in words:
            more = 0
            if self.blank and w[:SHORT] == " " * SHORT:
                more = (len(w) - len(w.lstrip(" "))) // self.blank - 1
                w = w[more * self.blank :]
            held.append("▁" + w.replace(" ", "▁"))
            out.append(more)
            chars += len(w)
            if chars >= BATCH_CHARS or len(out) == len(words):
                at = len(out) - len(held)
                out[at:] = (np.array(out[at:]) + self.count(held)).tolist()
                held, chars = [], 0
        return out


def token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, model: str | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id unless given), n_bytes and n_tokens of each row's whole text.

    A null text counts as empty: no bytes, no tokens. Repeated rows are counted each, and so are null keys; an empty
    table gives no rows. Equal to what the sentencepiece library gives without begin and end tokens. A text or a word
    may be of any length: time grows with what merges. Columns of ``df`` other than ``keep`` do not come out, so their
    names may be anything.
    """
    path = model or default_model()

    def fn(texts: list[str | None]) -> dict:
        merger = _MERGERS.get(path) or _MERGERS.setdefault(path, PieceMerger(path))
        return {"n_bytes": [len((t or "").encode()) for t in texts], "n_tokens": merger.counts(texts)}

    return map_text(df, text, keep or ["doc_id"], fn, "n_bytes long, n_tokens long")


def op10(df: DataFrame, limit: int = 4096) -> DataFrame:
    return token_counts(df).withColumn("over_limit", F.col("n_tokens") > limit)
