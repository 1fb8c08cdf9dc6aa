"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, in_parts, map_text

FLOOR = 1e-8
REMEMBERED = 300_000
#: Characters of words that are worked on at a time.
CHARS = 200_000
#: Copies of a text that count in learning; more count as so many. Languages at most: a dense column each.
COPIES, MODEL_BYTES = 16, 128 << 20
_VOCABULARIES: dict[str, "Vocabulary"] = {}


def has_letter(text: str) -> bool:
    """Whether a character is a letter; digits, marks, fractions and numerals of any script are none."""
    return any(map(str.isalpha, text))


def chunks(words: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of ``words`` of about CHARS characters each."""
    at = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(words):
        yield at, len(words)


class Vocabulary:
    """A piece model's pieces as a trie in sorted arrays; matches of many words are found step by step together."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces = sorted({p.lower() for p in pieces})
        self.longest = max(map(len, pieces))
        self.size = len(pieces) + 1  # the last number stands for a character that is no piece
        chars = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        self.char = np.zeros(0x110000, np.int32)
        for c, i in chars.items():
            self.char[ord(c)] = i
        self.fan = len(chars) + 1
        nodes, step = {"": 0}, {}
        for p in pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    step[nodes[p[: k - 1]] * self.fan + chars[p[k - 1]]] = nodes[p[:k]]
        self.piece = np.full(len(nodes), -1, np.int32)
        for i, p in enumerate(pieces):
            self.piece[nodes[p]] = i
        self.keys = np.array(sorted(step), np.int64)
        self.to = np.array([step[k] for k in self.keys.tolist()], np.int32)

    def words(self, text: str) -> list[str]:
        """A text's words in lower case, each behind a mark; longer ones than CHARS in parts, cut where no piece crosses."""
        words = ["▁" + w for w in text.lower().split()]
        if max(map(len, words), default=0) <= CHARS:
            return words
        return [part for w in words for part in (self._cut(w) if len(w) > CHARS else [w])]

    def _cut(self, word: str) -> Iterator[str]:
        at, width = 0, CHARS
        while len(word) - at > width:
            parts = self.matches([word[at : at + width]]).parts
            safe = parts[parts <= width - self.longest]  # what crosses the window's end is not seen
            if safe[-1]:
                yield word[at : at + int(safe[-1])]
                at, width = at + int(safe[-1]), CHARS
            else:
                width *= 2
        yield word[at:]

    def logs(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word (behind a mark) under each column of ``p``."""
        out = np.zeros((len(words), p.shape[1]))
        for i, j in chunks(words):
            parts = [[("▁" + w)] if len(w) < CHARS else list(self._cut("▁" + w)) for w in words[i:j]]
            found = self.matches([x for xs in parts for x in xs]).logs(p)
            sizes = np.array(list(map(len, parts)))
            out[i:j] = np.add.reduceat(found, np.cumsum(sizes) - sizes, axis=0) if len(found) > j - i else found
        return out

    def matches(self, words: list[str]) -> "Matches":
        """Every piece at every place of the words; a place where not even its character is a piece gets the unknown piece."""
        sizes = np.array([len(w) for w in words])
        sym = self.char[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        ends = np.cumsum(sizes)
        stop = np.repeat(ends, sizes)
        state, at, start = np.zeros(len(sym), np.int64), np.arange(len(sym)), np.arange(len(sym))
        found = []
        single = np.zeros(len(sym), bool)
        length = 0
        while len(start):
            keys = state * self.fan + sym[at]
            i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            ok = (self.keys[i] == keys) & (sym[at] > 0)
            start, at, state = start[ok], at[ok] + 1, self.to[i[ok]].astype(np.int64)
            length += 1
            whole = self.piece[state] >= 0
            if length == 1:
                single[start[whole]] = True
            found.append((start[whole], np.full(whole.sum(), length), self.piece[state[whole]]))
            more = at < stop[start]
            start, at, state = start[more], at[more], state[more]
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), self.size - 1)))
        return Matches(sizes, *(np.concatenate(x) for x in zip(*found, strict=True)), self.longest)


class Matches:
    """The pieces of some words as edges between places, for sums over all segmentations.

    Where no piece crosses a place, every segmentation has a cut there: a part of its own begins, and a word's sum is
    the product of its parts'. Parts are walked together, one place a step. A part of n characters has n + 1 nodes;
    they are scaled block by block, so that a part of any length stays in range.
    """

    def __init__(self, sizes: np.ndarray, start: np.ndarray, length: np.ndarray, piece: np.ndarray, longest: int):
        n = int(sizes.sum())
        crossed = np.zeros(n + 1, np.int64)
        long = length > 1
        np.add.at(crossed, start[long] + 1, 1)
        np.add.at(crossed, start[long] + length[long], -1)
        fresh = np.cumsum(crossed)[:n] == 0
        fresh[np.cumsum(sizes) - sizes] = True
        part = np.cumsum(fresh) - 1
        self.parts = first = np.flatnonzero(fresh)  # the characters with which parts begin
        self.word = np.repeat(np.arange(len(sizes)), sizes)[first]
        size = np.diff(np.append(first, n))
        self.last = first + np.arange(len(first)) + size  # a part has a node more than characters
        self.first = self.last - size
        self.owner = np.repeat(np.arange(len(first)), size + 1)
        self.place = np.arange(n + len(first)) - self.first[self.owner]
        self.block = max(16, longest)
        a = start + part[start]
        order = np.lexsort((a + length, self.place[a + length]))
        self.a, self.b, self.piece = a[order], (a + length)[order], piece[order]

    def _walk(self, p: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        """Sums over the ways to each node (to a part's end from it, if ``back``) and the logs of their scales; ``p``: of each match."""
        order = np.lexsort((self.a, self.place[self.a]))[::-1] if back else slice(None)
        a, b = (self.b[order], self.a[order]) if back else (self.a, self.b)
        p = p[order]
        step = self.place[b]
        heads = np.flatnonzero(np.diff(b, prepend=-1))
        to, ends = b[heads], np.append(heads[1:], len(b))
        cuts = np.flatnonzero(np.diff(step[heads], prepend=-1))
        sums = np.zeros((len(self.owner), *p.shape[1:]))
        sums[self.last if back else self.first] = 1.0
        scale = np.zeros((len(self.first), *p.shape[1:]))
        scales = np.zeros_like(sums)
        done = -1
        for i, j in zip(cuts, np.append(cuts[1:], len(heads))):
            at = int(step[heads[i]])
            block = at // self.block if back else (at - 1) // self.block
            if block != done and done >= 0:
                self._rescale(sums, scales, scale, self.owner[to[i:j]], done, back)
            done = block
            lo, hi = heads[i], ends[j - 1]
            sums[to[i:j]] = np.add.reduceat(sums[a[lo:hi]] * p[lo:hi], heads[i:j] - lo, axis=0)
            scales[to[i:j]] = scale[self.owner[to[i:j]]]
        return sums, scales

    def _rescale(self, sums: np.ndarray, scales: np.ndarray, scale: np.ndarray, parts: np.ndarray, block: int, back: bool) -> None:
        """Divides the last block's nodes of ``parts``, that go on, by their largest sum."""
        places = np.arange(self.block) + block * self.block + (0 if back else 1)
        at = self.first[parts][:, None] + np.minimum(places, (self.last - self.first)[parts][:, None])
        most = sums[at].max(1)
        sums[at] /= most[:, None]
        scale[parts] += np.log(most)
        scales[at] = scale[parts][:, None]

    def logs(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word under each column of ``p`` (pieces x languages)."""
        sums, scales = self._walk(p[self.piece], False)
        each = np.log(sums[self.last]) + scales[self.last]
        return np.add.reduceat(each, np.flatnonzero(np.diff(self.word, prepend=-1)), axis=0)

    def shares(self, p: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each match's piece, word, and expected number in its word under the word's ``column`` of ``p``."""
        word = self.word[self.owner[self.a]]
        own = p[self.piece, column[word]]
        ahead, up = self._walk(own, False)
        behind, down = self._walk(own, True)
        end = self.last[self.owner[self.a]]
        return self.piece, word, ahead[self.a] * own * behind[self.b] / ahead[end] * np.exp(up[self.a] + down[self.b] - up[end])


def vocabulary(path: str) -> Vocabulary:
    return _VOCABULARIES.get(path) or _VOCABULARIES.setdefault(path, Vocabulary(path))


def held_out(key: str) -> Column:
    """True where crc32 of the key as text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, text: str, lang: str, model: str, per_language: int, rounds: int) -> tuple[list[str], np.ndarray]:
    """Languages in order, and piece probabilities (pieces x languages) by expectation maximisation.

    About ``per_language`` distinct texts of each language are used, all if there are no more, chosen by a hash of the
    text, which bounds the words counted; up to ``COPIES`` copies of one count. What reaches the driver is one number for each piece and language.
    """
    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    most = max(1, MODEL_BYTES // (8 * vocabulary(model).size))
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l", F.xxhash64("t").alias("h")).agg(F.lit(1)).groupBy("l").count().limit(most + 1).collect()}
    langs = sorted(sizes)
    if len(langs) > most:
        raise ValueError(f"more than {most} languages: is {lang} a language column?")
    if not langs:
        return [], np.zeros((0, 0))
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, per_language / sizes[k]))])
    part = F.pmod(F.xxhash64("t"), F.lit(10**12)) < F.element_at(share, F.col("l")) * 10**12

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_parts(batch, "t"):
                seen: dict[str, Counter] = {}
                for t, k, n in zip(*(piece.column(c).to_pylist() for c in ("t", "l", "n")), strict=True):
                    words = seen.setdefault(k, Counter())
                    for w, m in Counter(vocabulary(model).words(t)).items():
                        words[w] += m * n
                flat = [(k, w, n) for k, c in seen.items() for w, n in c.items()]
                yield pa.RecordBatch.from_pydict({"l": [x[0] for x in flat], "w": [x[1] for x in flat], "n": pa.array([x[2] for x in flat], pa.int64())})

    texts = rows.filter(part).groupBy("l", "t").agg(F.least(F.count("*"), F.lit(COPIES)).alias("n"))
    words = cut(texts.mapInArrow(count, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n")))
    number = {k: i for i, k in enumerate(langs)}
    size = vocabulary(model).size
    p = np.full((size, len(langs)), 1.0 / size)
    for _ in range(rounds):
        known = docs.sparkSession.sparkContext.broadcast(p)

        def expect(batches: Iterable[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            p = known.value
            total = np.zeros_like(p)
            for batch in batches:
                k = np.array([number[x] for x in batch.column("l").to_pylist()])
                n = batch.column("n").to_numpy().astype(float)
                w = batch.column("w").to_pylist()
                for i, j in chunks(w):
                    piece, owner, share = vocabulary(model).matches(w[i:j]).shares(p, k[i:j])
                    np.add.at(total, (piece, k[i:j][owner]), share * n[i:j][owner])
            piece, lang = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(piece, pa.int32()), "lang": pa.array(lang, pa.int32()), "n": total[piece, lang]})

        sums = words.mapInArrow(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum(F.round("n", 6).cast("decimal(38,6)")).cast("double").alias("n")).toPandas()
        total = np.zeros_like(p)
        total[sums["piece"], sums["lang"]] = sums["n"]
        p = np.maximum((total + 0.01) / (total + 0.01).sum(0), FLOOR)
        p /= p.sum(0)
        known.unpersist()
    return langs, p


def predict(docs: DataFrame, langs: list[str], p: np.ndarray, text: str, keep: list[str], model: str, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep``, lang_pred and score: the language under which the text is likeliest, and its share of all languages' likelihoods."""
    ctx = docs.sparkSession.sparkContext.broadcast(p)  # pieces x languages: fixed by the vocabulary, not by the rows
    memory: dict = {}

    def fn(texts: list[str | None]) -> dict:
        vocab = vocabulary(model)
        if not memory or len(memory["seen"]) > REMEMBERED or memory["chars"] > 16 * REMEMBERED:
            memory.update(seen={}, rows=np.zeros((0, len(langs))), chars=0)
        seen = memory["seen"]
        docs = [t.lower().split() if t and langs and has_letter(t) else [] for t in texts]
        new = list({w for d in docs for w in d if w not in seen})
        if new:
            got = vocab.logs(new, ctx.value)
            seen.update(zip(new, range(len(seen), len(seen) + len(new)), strict=True))
            memory["chars"] += sum(map(len, new))
            memory["rows"] = np.concatenate([memory["rows"], got])
        sizes = np.array([len(d) for d in docs])
        ids = np.fromiter((i for d in docs for i in map(seen.__getitem__, d)), np.int64, int(sizes.sum()))
        logs = np.zeros((len(docs), max(1, len(langs))))
        some = np.flatnonzero(sizes)
        if len(some):
            logs[some] = np.add.reduceat(memory["rows"][ids], (np.cumsum(sizes) - sizes)[some], axis=0)
        best = logs.argmax(1)
        share = 1.0 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
        und = sizes == 0
        return {names[0]: ["und" if u else langs[b] for u, b in zip(und.tolist(), best.tolist(), strict=True)], names[1]: np.where(und, 0.0, share)}

    return map_text(docs, text, keep, fn, f"{names[0]} string, {names[1]} double")


def identify(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", keep: list[str] | None = None,
    model: str | None = None, per_language: int = 2_000, rounds: int = 3, names: tuple[str, str] = ("lang_pred", "score"),
) -> DataFrame:
    """Each row's predicted language, learned from the rows that are not held out and have text and a language.

    ``per_language``: about so many distinct texts of each language are learned from, chosen by a hash (all if there
    are fewer). Piece probabilities come from ``rounds`` of expectation maximisation over all segmentations. A null text,
    or one without letters (as ``str.isalpha`` has them), is ``und`` with score 0, and so is every row where nothing can be
    learned; an empty table gives no rows. Texts and words may be of any length; a word is cut only where no piece crosses, so
    all its segmentations count. Equal likelihoods go to the first language in order; repeated rows get the same answer.
    ``names``: of the two new columns, which must not be among ``keep``; other columns may have any name. More than
    ``MODEL_BYTES`` (some 500 languages of 32,000 pieces) are an error: the driver holds a number for each piece and language.
    """
    from nearfield.llm.tokencount import default_model

    path = model or default_model()
    train = docs.filter(~held_out(key) & F.col(key).isNotNull())
    langs, p = learn(train, text, lang, path, per_language, rounds)
    keep = keep or [key]
    return predict(docs, langs, p, text, keep, path, names)


def op6(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
