import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import pytest

from nearfield.llm import conversations as conv

KINDS = "conv_id long, turn long, role string, text string, cost string, audit long"
FILLED = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """Each conversation's rows after damage, in order; an id of which nothing is left stays."""
    out = {}
    for c, turn, role, text in rows:
        own = out.setdefault(c, [])
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        own.extend([(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest())
    return {c: sorted(own, key=order) for c, own in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = FILLED.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "fine" if last[0] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def best(rows, faults):
    """Least (cost, letters, lines) by memo, each place and state once; inserts at most twice in a row."""
    goes = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    @cache
    def go(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        if inserts < 2:
            for x in "ua":
                if (state, x) in goes:
                    found += [(c + 5, "I" + a, (f"{names[x]}:", *o)) for c, a, o in [go(i, x, inserts + 1)] if o is not None]
        if i < len(rows):
            _, role, text = rows[i]
            found += [(c + 2, "D" + a, o) for c, a, o in [go(i + 1, state, 0)] if o is not None]
            if faults[i] in ("fine", "truncated"):
                more = 5 * (faults[i] == "truncated")
                for letter, cost, x, new in [("K", 0, role[:1], role), *[("R", 1, x, names[x]) for x in "ua"]]:
                    if (state, x) in goes:
                        found += [(c + cost + more, letter + a, (f"{new}:{text}", *o)) for c, a, o in [go(i + 1, x, 0)] if o is not None]
        return min(found, default=(10**9, "", None))

    for i in range(len(rows), 0, -1):  # from behind, so that no call goes deep
        for state in ("", "s", "u", "a"):
            go(i, state, 0)
    return go(0, "", 0)


def every(rows, faults):
    """Least (cost, letters) of all ways there are: any edit of each row, up to three inserts in each gap."""
    gaps = [x for n in range(4) for x in itertools.product("ua", repeat=n)]
    found = []
    for edits in itertools.product(*[["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            roles, letters, cost = "".join(put[0]), "I" * len(put[0]), 5 * sum(map(len, put))
            for (_, role, _), fault, edit, more in zip(rows, faults, edits, put[1:], strict=True):
                letters += edit[0] + "I" * len(more)
                cost += {"D": 2, "K": 0, "R": 1}[edit[0]] + 5 * (fault == "truncated" and edit != "D")
                roles += {"D": "", "K": role[:1] or "-", "R": edit[1:]}[edit[0]] + "".join(more)
            if re.fullmatch("(s?(ua)+)?", roles):
                found.append((cost, letters))
    return min(found)


def plain(rows):
    out = []
    for c, own in damaged(rows).items():
        faults = faults_of(own)
        cost, audit, lines = best(tuple(own), tuple(faults))
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((c, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, longest, seed=3):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            rows.append((c, rng.choice((t, t, t, t + 3, None)), role, rng.choice((f"line {t % 4}.", "Why?", "no end", "", " \n\t", None, "same.", "é 日本!\x0c ", "ü\x85"))))
    return rows


def got(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], KINDS).repartition(3)
    return sorted((tuple(r) for r in conv.op12(df).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    out = made(120, 12)
    out += [(None, 1, "user", "no id."), (None, None, None, None), (900, None, "user", "q?"), (900, None, "assistant", "a."), (901, -(2**62), "user", "far."), (901, 2**62, "assistant", "far.")]
    return out + [out[0]] * 3 + [(902, t, "user" if t % 2 else "assistant", "long " * 20_000 + ".") for t in range(4)]


def test_repairs_by_a_plain_version(spark, rows):
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize(("most", "size", "sent"), [(1, 1 << 23, 1 << 20), (3, 1 << 23, 0), (5, 20, 1 << 20)])
def test_segments_by_a_plain_version(spark, rows, monkeypatch, most, size, sent):
    """Nearly all conversations are cut into segments, which must know what lies before and behind them."""
    monkeypatch.setattr(conv, "SEGMENT", most)
    monkeypatch.setattr(conv, "SEGMENT_BYTES", size)
    monkeypatch.setattr(conv, "SENT_BYTES", sent)
    assert got(spark, rows) == plain(rows)


def test_a_very_long_conversation(spark):
    rows = made(4, 5, seed=9) + [(77, t, *random.Random(t).choice((("user", "same."), ("assistant", f"a {t}."), ("user", f"u {t}?"), ("system", "cut"), ("assistant", "")))) for t in range(2_200)]
    assert got(spark, rows) == plain(rows)


def test_the_plain_version_finds_the_least_of_all_ways():
    rng = random.Random(1)
    roles, texts = ("user", "assistant", "system", "tool"), ("a.", "b?", "cut", " ")
    for _ in range(60):
        own = [(i, rng.choice(roles), rng.choice(texts)) for i in range(rng.randint(0, 2))]
        assert best(tuple(own), tuple(f := faults_of(own)))[:2] == every(own, f)


def test_turns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hi.", True), (1, 1, "assistant", "Yes.", True), (2, 0, "x", "y", False)], "conv_id long, turn long, role string, text string, present boolean")
    pieces = conv.repair(df)
    assert [(r["conv_id"], r["nth"], r["role"], r["text"]) for r in conv.turns(pieces).orderBy("conv_id", "nth").collect()] == [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    assert sorted((r["conv_id"], r["audit"]) for r in conv.report(pieces).collect()) == [(1, "RK"), (2, "")]
    assert conv.op12(spark.createDataFrame([], KINDS)).count() == 0
