import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from nearfield.llm import decontamination as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, width):
    """Every window of every item held against every place of every text."""
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = {}
    for name, t in items:
        w = split(t)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if name is None else str(name))
    out = []
    for key, t in docs:
        w, hit, names = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        out.append((key, len(w), len(hit), ",".join(sorted(names))))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(2)
    vocabulary = ["the", "a", "Water", "STONE", "état", "日本", "9", "x1", "ß", "İ"]
    some = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, some(rng.choice((10, 12, 25)))) for i in range(12)]
    items += [(12, None), (13, ""), (14, " ?! "), (15, "rare pair"), (16, "unique"), (None, "no name at all here"), (2, some(11)), items[0], (117, items[3][1])]
    docs = [(None, items[0][1]), (1, None), (2, ""), (3, " - ")]
    for i in range(60):
        parts = [some(rng.randint(0, 30)) for _ in range(3)] + [rng.choice(items)[1] or "" for _ in range(rng.randint(0, 2))]
        rng.shuffle(parts)
        docs.append((10 + i, rng.choice((" ", ", ", "\n", "_", "\x00")).join(parts)))
    docs += [docs[9], docs[9], (90, "a rare, PAIR of unique-ly" + "z" * 50_000), (91, some(40_000) + " " + items[1][1].upper().replace("É", "é") + " " + some(20_000))]
    d = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, items string, n_words int").repartition(3).cache()
    return docs, items, d, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("sent", [1 << 20, 0])
@pytest.mark.parametrize("width", [10, 3])
def test_windows_by_a_plain_version(tables, sent, width):
    docs, items, d, b = tables
    rows = dec.find(d, b, width=width, sent_bytes=sent).collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"])) for r in rows), key=str) == plain(docs, items, width)


def test_digest(tables):
    docs, items, d, b = tables
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in dec.op13(d, b).collect()), key=str)
    assert got == sorted(((k, n, h, len(x.split(",")) if x or h else 0, hashlib.sha256(x.encode()).hexdigest(), h > 0) for k, n, h, x in plain(docs, items, 10)), key=str)


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_spans_and_documents_go(spark, sent):
    b = spark.createDataFrame([(1, "one Two three"), (2, "é日 end")], "item_id long, text string")
    rows = [(1, "See: ONE, two - three! and é日 End.", 7), (2, "one two", 8), (3, None, 9), (4, "one two three", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, spans long")
    left = {r["doc_id"]: (r["text"], r["spans"]) for r in dec.decontaminate(d, b, sent_bytes=sent).collect()}
    assert left == {1: ("See: ! and .", 7), 2: ("one two", 8), 3: (None, 9), 4: ("", 1)}
    kept = dec.decontaminate(d, b, "documents", sent_bytes=sent)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    with pytest.raises(ValueError):
        dec.decontaminate(d, b, "words")


def test_empty_tables(tables):
    docs, _, d, b = tables
    assert dec.op13(d.limit(0), b).count() == 0
    none = dec.op13(d, b.limit(0))
    assert none.count() == len(docs) and none.filter("contaminated").count() == 0
    assert dec.find(d, b.limit(0), sent_bytes=-1).filter(F.size("items") > 0).count() == 0


def test_windows_of_equal_hashes_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(dec, "mixed", lambda w: (w.sum(1) % 2).astype(np.uint64))
    w = dec.Windows([("a", [b"x", b"y", b"z"]), ("b", [b"y", b"x"])], 2)
    found = [[w.vocabulary[c] for c in (b"x", b"y")], [w.vocabulary[c] for c in (b"z", b"y")]]
    got = [{tuple(w.by_length[n][1][r]) for n, _, rows in w.hits(np.array(x)) for r in rows} for x in found]
    assert got == [{tuple(found[0])}, set()]
