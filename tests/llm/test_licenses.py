"""Licence scans against their SQL on notices in every form, and against a plain version."""

import random
import re
from collections import Counter

import duckdb
import pytest

from nearfield.llm import licenses, notices

PROSE = " ".join(f"w{i}" for i in range(90))


def texts():
    rng = random.Random(4)
    full = {k + str(i): t for i, (k, t) in enumerate(notices.PASSAGES + licenses.TEMPLATES)}
    out = [None, "", " \n ", "license", "the", PROSE, PROSE * 40]
    for t in full.values():
        words = t.split()
        wrapped = "\n".join("# " + " ".join(words[i : i + 9]) for i in range(0, len(words), 9))
        out += [t, f"{PROSE} {t} {PROSE}", f"{PROSE}\n{wrapped}\n{PROSE}"]
        near = [w if rng.random() > 0.06 else "altered" for w in words]
        out += [f"{PROSE}\n" + " ".join(near) + f"\n{PROSE}", t + "\n" + t, " ".join(words[: len(words) // 2]), t.upper().replace(" ", "   \t")]
    for _ in range(25):
        out.append("\n".join(rng.choice([*full.values(), PROSE, "short line"]) for _ in range(rng.randint(2, 4))))
    return out


def test_against_sql(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in licenses.op3(df).select("doc_id", "line_no", "license", "dice", "n_bigrams").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = Counter(con.execute(f"SELECT doc_id, line_no, license, dice, n_bigrams FROM ({licenses.sql()})").fetchall())
    assert got == want and len({k[0] for k in got}) > 150


def test_units_by_a_plain_version(spark):
    """Every line and whole text against every template, without bounds or signs."""
    rows = list(enumerate(texts()))
    again = rows + rows[7:12] + [(None, rows[7][1])]  # repeated rows, a null key
    df = spark.createDataFrame([(*r, "x", 1) for r in again], "doc_id long, text string, license string, line_no int")
    grams = lambda t: {(a, b) for w in [re.findall("[a-z0-9]+", t.lower())] for a, b in zip(w, w[1:])}
    sets = [(n, grams(t)) for n, t in licenses.TEMPLATES]
    want = Counter()
    for k, t in again:
        lines = (t or "").split("\n")
        for no, unit in [*enumerate(lines), *([(-1, t)] if len(lines) > 1 else [])]:
            g = grams(unit)
            scores = [(2 * len(g & b) / (len(g) + len(b)), -i) for i, (_, b) in enumerate(sets)]
            if g and max(scores)[0] >= 0.8:
                want[(k, no, sets[-max(scores)[1]][0], round(max(scores)[0], 6), len(g))] += 1
    assert Counter(tuple(r) for r in licenses.scan_licenses(df).collect()) == want


def test_long_texts(spark):
    mit = dict((len(t), t) for k, t in notices.PASSAGES if k == "MIT")
    text = f"{PROSE * 1000} {mit[max(mit)]} {PROSE * 1000}"
    got = [tuple(r)[:3] for r in licenses.op3(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()]
    assert got == [(1, 0, "MIT")]


@pytest.mark.parametrize("m", [4, 26, 39, 200])
def test_bounds(m):
    """No set outside the bounds reaches the least coefficient; one at the bounds may."""
    low = licenses.least_shared(m, 0.8)
    assert 2 * low / (low + m) >= 0.8 > 2 * (low - 1) / (low - 1 + m)
