import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from nearfield.llm import merkle

KINDS = "doc_id long, text string, lang string, source string, n_chars long, g long, digest string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(key, source, lang, n, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (key, source, lang, n, text)))


def plain(rows, fan=2):
    """Every level kept as a list; a proof walks up beside its row."""

    def levels(digests):
        out = [digests]
        while len(out[-1]) > 1:
            out.append([h("".join(out[-1][i : i + fan])) for i in range(0, len(out[-1]), fan)])
        return out

    groups = {}
    for r in rows:
        key, text, lang, source, n = r[:5]
        own = leaf(key, source, lang, n, text)
        bad = key is not None and n is not None and zlib.crc32(str(key).encode()) % 7 == 0
        groups.setdefault(lang, []).append((key is not None, key or 0, own, leaf(key, source, lang, n + 1, text) if bad else own, key))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    over = levels([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, r in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            x, proof = r[3], ""
            for tree, i in ((trees[g], i), (over, at)):
                for level in tree[:-1]:
                    lo = i // fan * fan
                    before, after = "".join(level[lo:i]), "".join(level[i + 1 : lo + fan])
                    x, proof, i = h(before + x + after), proof + before + after, i // fan
            out.append((r[4], r[2], trees[g][-1][0], over[-1][0], h(proof), x, x == over[-1][0]))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    made = [(i, f"text {i} é\x00", ("en", "en", "de", "日本", "Z", "ä")[i % 6] if i % 11 else None, f"s{i % 3}" if i % 5 else None, i if i % 4 else None) for i in range(150)]
    made += [(200, None, "one", "s", 3), (201, "", "two", "", 0), (202, " ", "", None, -5), (203, "long " * 100_000, "en", "s", 9_223_372_036_854_775_807)]
    made += [made[1], made[1], made[1], (1, "other text", "en", "s1", 1), (None, "no key", "en", "s", 7), (None, None, None, None, None)]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], KINDS).repartition(5).cache()


@pytest.mark.parametrize("block", [256, 8])
def test_proofs_by_a_plain_version(docs, rows, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    want = plain(rows)
    assert rows_of(merkle.op11(docs)) == want and 0 < sum(not r[-1] for r in want) < len(want)


@pytest.mark.parametrize("sizes", [(1,), (6,), (1, 2, 3, 4, 5, 8, 9, 16, 17)])
def test_groups_of_each_size(spark, sizes, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = [(100 * n + i, f"t{i}", f"l{n}", "s", 1) for n in sizes for i in range(n)]
    assert rows_of(merkle.op11(spark.createDataFrame([(*r, 1, "x") for r in rows], KINDS))) == plain(rows)


def test_many_groups_that_are_not_sent(spark, rows, docs, monkeypatch):
    monkeypatch.setattr(merkle, "SENT_BYTES", -1)
    many = [(i, "x", f"lang{i % 40}", None, 5) for i in range(90)]
    assert rows_of(merkle.op11(spark.createDataFrame([(*r, 1, "x") for r in many], KINDS))) == plain(many)


@pytest.mark.parametrize("fan", [3])
def test_wider_runs(docs, rows, monkeypatch, fan):
    monkeypatch.setattr(merkle, "BLOCK", 9)
    made = merkle.manifest(docs, list(merkle.VALUES), fan=fan, keep={"doc_id": F.col("doc_id")})
    got = made.proofs().select("doc_id", "leaf", "subroot", "root", merkle.proof_hash(F.col("path")), merkle.fold(F.col("leaf"), F.col("path")))
    assert rows_of(got) == sorted(((*r[:5], r[3]) for r in plain(rows, fan)), key=str)
    nodes = made.nodes()
    assert nodes.count() == nodes.select("g", "level", "idx").distinct().count()
    assert nodes.filter("g = -1").agg(F.max_by("digest", "level")).first()[0] == plain(rows, fan)[0][3]


def test_empty_table(docs):
    assert merkle.op11(docs.limit(0)).count() == 0
    with pytest.raises(ValueError, match="names of new ones"):
        merkle.manifest(docs, ["text"], keep={"digest": F.col("digest")})
