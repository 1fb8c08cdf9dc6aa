"""Operators on whole texts against plain versions: long runs, odd characters, random strings."""

import hashlib
import math
import os
import random
import re
import string
import time
from collections import Counter

import numpy as np
import pytest

from nearfield.llm import langid, repetition, secret_scan, tokencount


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokencount.default_model())


def test_counts_of_long_runs(library):
    rng = random.Random(2)
    merger = tokencount.PieceMerger(tokencount.default_model())
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" " * 10**6, "z" * 10**6, "".join(rng.choices(letters, k=10**6)), "".join(rng.choices("ACGT", k=10**6)), "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(10**6))]
    texts += ["zzi" * 300_000, "=" * 10**6, "a " * 10**5 + " " * 999 + "end"]
    want = [len(x) for x in library.encode(texts)]
    for text, n in zip(texts, want, strict=True):
        began = time.time()
        assert merger.counts([text]) == [n]
        assert time.time() - began < 10


def test_counts_of_random_strings(library):
    rng = random.Random(3)
    merger = tokencount.PieceMerger(tokencount.default_model())
    parts = ["z", "zz", "zzi", "ss", "ha", "the", "ing", " ", "  ", "   ", "=", "--", "\n", "▁", "é", "日", "\x00", "<s>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 800))) for _ in range(600)]
    texts += [" " * n + w for n in range(0, 200, 7) for w in ("", "the", "=")]
    assert merger.counts(texts) == [len(x) for x in library.encode(texts)]


def bits(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def harmless(run):
    """Places of what is no secret in a run, by trying every place in turn."""
    alnum, upper, lower = set(string.ascii_letters + string.digits), string.ascii_uppercase, string.ascii_lowercase
    pieces = run.lstrip("/").split("/")
    if len(run) - len(run.lstrip("/")) <= 2 and len(pieces) >= 3 and all(1 <= len(x) <= 19 and set(x) <= set(lower + "_-" * bool(i)) for i, x in enumerate(pieces)):
        return set(range(len(run)))
    out, at = set(), 0
    while at < len(run):
        rest, n = run[at:], 0
        parts = rest[:36].split("-")
        if [len(x) for x in parts] == [8, 4, 4, 4, 12] and set("".join(parts)) <= set("0123456789abcdef"):
            n = 36
        for letters in (string.digits, lower, upper):
            if not n and rest.startswith(letters[:10]):
                n = len(os.path.commonprefix([rest, letters]))
        for word in ("example", "EXAMPLE", "placeholder", "PLACEHOLDER", "changeme", "lorem"):
            if not n and rest.startswith(word) and (at == 0 or run[at - 1] not in alnum):
                n = len(word)
        for word in ("EXAMPLEKEY", "EXAMPLE"):
            if not n and rest == word:
                n = len(word)
        out |= set(range(at, at + n))
        at += n or 1
    return out


def spoken(w):
    """Whether seven tenths of the letters lie in words that can be spoken."""
    at, total = 0, 0
    while at < len(w):
        end = at + 1
        if w[at].isupper() and w[end : end + 1].islower() or w[at].islower():
            while w[end : end + 1].islower():
                end += 1
        elif w[at].isupper():
            while w[end : end + 1].isupper():
                end += 1
        word = w[at:end].lower() if w[at].isalpha() else ""
        vowels = sum(c in "aeiouy" for c in word)
        if len(word) > 2 and 4 * vowels >= len(word) and all(set(word[i : i + 8]) & set("aeiouy") for i in range(len(word) - 7)):
            total += len(word)
        at = end
    return 10 * total >= 7 * sum(c.isalpha() for c in w)


def plain_secrets(text):
    """All spans: base ones by hand-written scans, windows with their entropy worked out anew at every place."""
    plus = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    base, at = [], 0
    while at < len(text):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[at : at + len(word)]) != word:
                continue
            i = at + len(word)
            i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
            while text[i : i + 1] == " ":
                i += 1
            if text[i : i + 1] not in (":", "=") or i >= len(text):
                continue
            i += 1
            while text[i : i + 1] == " ":
                i += 1
            i += text[i : i + 1] in ("'", '"') and text[i : i + 1] != ""
            end = i
            while end < len(text) and text[end] in plus:
                end += 1
            if end > i:
                if end - i >= 6:
                    base.append((at, 0, end))
                at = end - 1
                break
        at += 1
    upper, hexes = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), set("0123456789abcdef")
    at = 0
    while at < len(text):
        if text[at : at + 4] == "AKIA" and text[at + 4 : at + 5] in upper:
            end = at + 4
            while end < len(text) and text[end] in upper:
                end += 1
            if end - at >= 20:
                base.append((at, 1, end))
            at = end
        else:
            at += 1
    at = 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in hexes:
            end += 1
        if end - at >= 24:
            base.append((at, 2, end))
        at = max(end, at + 1)
    base.sort()
    taken = {i for a, _, b in base for i in range(a, b)}
    body = plus - {"."}
    hot, at = set(), 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] in body:
            end += 1
        if end - at >= 20:
            off = taken | {at + i for i in harmless(text[at:end])}
            for i in range(at, end - 19):
                w = text[i : i + 20]
                if off & set(range(i, i + 20)):
                    continue
                for chars, least in ((set("0123456789abcdefABCDEF"), 2.9), (body, 3.8)):
                    letters = any(c.isalpha() for c in w)
                    if set(w) <= chars and bits(w) >= least - 1e-9 and letters and (any(c.isdigit() for c in w) or not spoken(w)):
                        hot.add((i, i + 20))
        at = max(end, at + 1)
    merged = []
    for a, b in sorted(hot):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = b
        else:
            merged.append([a, b])
    return base, sorted(base + [(a, 3, b) for a, b in merged])


def test_secrets_brute_force(spark):
    rng = random.Random(8)
    mixed = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    make = (
        lambda: "".join(rng.choices(mixed, k=rng.randint(4, 50))), lambda: "".join(rng.choices("0123456789abcdef", k=rng.randint(10, 60))),
        lambda: "AKIA" + "".join(rng.choices("ABCDEFGH0123", k=rng.randint(3, 30))), lambda: rng.choice(("Password", "api_key", "SECRET", "token", "passwd", "apikey")) + rng.choice(("=", " : ", '": "', "'=", " ")),
        lambda: rng.choice((" ", "\n", "/", "=", "é", "😀", '"', ".")), lambda: rng.choice(("0123456789", "example", "plain words here", "123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa")),
    )
    texts = ["".join(rng.choice(make)() for _ in range(rng.randint(1, 9))) for _ in range(700)] + [None, "", "x" * 50_000, "qzxk" * 500 + "EXAMPLE", "example" + "".join(rng.choices(mixed, k=60))]
    rows = table(spark, [*texts, texts[0], texts[0]])
    for r in secret_scan.op5(rows).collect():
        text = (texts[r["doc_id"]] if r["doc_id"] < len(texts) else texts[0]) or ""
        base, spans = plain_secrets(text)
        write = lambda xs: ",".join(f"{('assign', 'access', 'hex', 'entropy')[k]}:{a}:{b}" for a, k, b in xs)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3)), text
        assert r["base_sha256"] == hashlib.sha256(write(base).encode()).hexdigest(), text
        assert r["spans"] == write(spans), text


def test_more_languages_than_the_model_may_hold(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "some text", f"l{i}") for i in range(12)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MODEL_BYTES", 8 * 40_000 * 3)
    with pytest.raises(ValueError, match="languages"):
        langid.op6(rows)


@pytest.mark.parametrize("kind", ["base64", "letters", "one letter", "paths", "many", "samples"])
def test_secrets_of_a_million_characters(kind):
    """One run of any kind takes seconds; these took hours while patterns looked for an end from every place."""
    rng, n = random.Random(4), 1_000_000
    text = {
        "base64": "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=n)), "letters": "".join(rng.choices(string.ascii_letters, k=n)), "one letter": "x" * n,
        "paths": "a/" * (n // 2), "many": "token=abcdefg qZtKvXwRbNpLsGdHcJmFyQx1 " * (n // 40), "samples": "qEXAMPLE" * (n // 8),
    }[kind]
    began = time.process_time()
    base, spans = secret_scan.scan(text, re.compile("|".join(f"(?:{a})" for a in secret_scan.ALLOW)))
    assert time.process_time() - began < 20
    assert (len(spans) > 0) == (kind in ("base64", "letters", "many")) and len(base) == (n // 40 if kind == "many" else 0)


def test_texts_without_letters_have_no_language(spark):
    none = ["½ ²", "①②③", "Ⅷ Ⅻ", "12 34 !!", "١٢٣", "́ ̂", "😀 😀", "", " \n"]
    some = ["ª", "я", "日", "x²", "º"]
    texts = ["the thing of other ones", "les choses de cette ville", *none, *some]
    rows = spark.createDataFrame([(i, t, ("en", "fr")[i % 2] if i < 40 else None) for i, t in enumerate(texts[:2] * 20 + texts[2:])], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.op6(rows).collect()}
    assert all((got[40 + i]["lang_pred"], got[40 + i]["score"]) == ("und", 0.0) for i in range(len(none)))
    assert all(got[40 + len(none) + i]["lang_pred"] in ("en", "fr") for i in range(len(some)))


def test_long_words_are_summed_whole():
    """Parts, scaled blocks and cuts of very long words give what one sum in logs over the whole word gives."""
    vocab, rng = langid.vocabulary(tokencount.default_model()), random.Random(4)
    p = np.random.default_rng(1).random((vocab.size, 2)) ** 8
    p /= p.sum(0)
    names = {}
    for chars in ("theaingorß日z½", "a", "=", "日本"):
        names["▁" + "".join(rng.choices(chars, k=700))] = None
    words = list(names)
    got = vocab.matches(words).logs(p)
    for w, logs in zip(words, got, strict=True):
        sums = np.full((len(w) + 1, 2), -np.inf)
        sums[0] = 0
        m = vocab.matches([w])
        inner = np.arange(len(m.owner)) - m.owner  # a node's character, parts meeting in one
        for a, b, x in sorted(zip(inner[m.a].tolist(), inner[m.b].tolist(), m.piece.tolist(), strict=True)):
            sums[b] = np.logaddexp(sums[b], sums[a] + np.log(p[x]))
        assert np.allclose(logs, sums[-1], rtol=1e-9)
    piece, word, share = vocab.matches(words).shares(p, np.array([0, 1, 0, 1]))
    assert np.isfinite(share).all() and share.min() >= 0 and share.max() <= 1 + 1e-9
    long = "▁" + "".join(rng.choices("theingor日本½z", k=langid.CHARS * 2))
    parts = vocab.words(long[1:])
    assert "".join(parts) == long and max(map(len, parts)) <= langid.CHARS
    assert np.allclose(sum(vocab.matches([x]).logs(p)[0] for x in parts), vocab.matches([long]).logs(p)[0])


def test_covered_share_rejects_what_the_base_rules_pass(spark):
    """16 of 100 words in repeats of 8: under a fifth, so the base rules pass, and over 12 percent."""
    passage, rest = " ".join(f"p{i}" for i in range(8)), [f"w{i}" for i in range(84)]
    texts = [" ".join([passage, *rest[:42], passage, *rest[42:]]), " ".join([passage, *rest]), " ".join([passage, *rest[:60], passage] + [f"v{i}" for i in range(80)])]
    got = {r["doc_id"]: (r["base_failed"], r["kept"], r["n_covered_words"]) for r in repetition.repetition_rules(table(spark, texts)).collect()}
    assert got == {0: (False, False, 16), 1: (False, True, 0), 2: (False, True, 16)}


def test_base_measures(spark):
    texts = ["a b\na b\n\n \n# $ a b", None, "x", "w " * 9, " ".join(f"u{i}" for i in range(10)), "r s t u v " * 4000]
    got = {r["doc_id"]: r for r in repetition.op1(table(spark, texts)).collect()}
    assert (got[0]["n_dup_lines"], got[0]["n_symbols"], got[0]["n_words"], got[0]["word_chars"]) == (1, 2, 8, 8)
    assert [got[i]["base_failed"] for i in range(6)] == [True, True, True, True, False, True] and got[4]["kept"]
    assert got[5]["n_repeat_words"] == got[5]["n_words"] == 20_000
