"""License scans: Dice coefficient over word bigrams against licence templates, with DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, once
from nearfield.llm.notices import PASSAGES

# Notices by which texts state their licence.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def least_shared(m: int, least: float) -> int:
    """Bigrams of a template of ``m`` that any text with a Dice coefficient of ``least`` shares, and its least size."""
    return math.ceil(m * least / (2 - least) - 1e-9)


def likely_texts(df: DataFrame, text: str = "text", key: str = "doc_id", templates: tuple = TEMPLATES + PASSAGES, least: float = 0.8) -> DataFrame:
    """key, t, p, ts: the texts that may state a licence, their word bigrams, and the templates of which they hold enough.

    What reaches a Dice coefficient of ``least``, be it a line or a passage, shares at least m * least / (2 - least) of a
    template's m bigrams, and its text holds these too. All other texts are dropped here, before any line is looked at.
    """
    rows = [(i, name, len(template_words(t)), template_bigrams(t)) for i, (name, t) in enumerate(templates)]
    need = [least_shared(len(b), least) for *_, b in rows]
    known = _listed(sorted({x for *_, b in rows for x in b}))
    shown = [F.struct(F.lit(i).alias("at"), F.lit(name).alias("license"), F.lit(n).alias("n"), F.lit(k).alias("need"), _listed(b).alias("b")) for (i, name, n, b), k in zip(rows, need, strict=True)]
    sized = df.select(F.col(key), F.col(text).alias("t"), once(_words(F.coalesce(F.col(text), F.lit("")))).alias("w")).filter(F.size("w") > min(need))
    paired = sized.select(key, "t", once(_pairs(F.col("w"))).alias("p"))
    held = paired.select(key, "t", "p", once(F.array_intersect("p", known)).alias("s")).filter(F.size("s") >= min(need))
    likely = F.filter(F.array(*shown), lambda t: F.size(F.array_intersect(t["b"], F.col("s"))) >= t["need"])
    return held.select(key, "t", "p", once(likely).alias("ts")).filter(F.size("ts") > 0)


def scan_licenses(df: DataFrame, text: str = "text", key: str = "doc_id", templates: tuple = TEMPLATES, least: float = 0.8) -> DataFrame:
    """A row for each unit of a text that states a licence: key, line_no, license, dice, n_bigrams.

    Units are the lines and, with line_no -1, the whole text of several lines. A unit in lower case, with all but
    a-z and 0-9 as white space, is its set of word bigrams; it states the template of the highest Dice coefficient
    (then the first licence name) if that is ``least`` or more. Only sizes between m * least / (2 - least) and
    m * (2 - least) / least of a template's m can reach it, and a unit must share one of a few bigrams of
    each: other units are dropped before any comparison. A null or empty text states none; rows are scanned one by
    one, so repeated ones and null keys give the same rows each, and an empty table none. A very long text is one array of
    words. Equal coefficients go to the template that comes first. Only ``key`` and the new columns come out, so other
    columns may have any name. Nothing is joined or shuffled: the templates are literals of the plan.
    """
    return _units(likely_texts(df, text, key, templates, least), key, templates, least)


def _units(few: DataFrame, key: str, templates: tuple, least: float) -> DataFrame:
    sets = [(name, template_bigrams(t)) for name, t in templates]
    low = min(least_shared(len(b), least) for _, b in sets)
    high = max(math.floor(len(b) * (2 - least) / least + 1e-9) for _, b in sets)
    # A unit misses at most m - least_shared(m) of a template's bigrams, so it has one of any so many and one more.
    signs = sorted({x for _, b in sets for x in b[: len(b) - least_shared(len(b), least) + 1]})
    lines = F.split("t", "\n", -1)
    whole = F.when(F.size(lines) > 1, F.array(F.struct(F.lit(-1).alias("line_no"), F.col("t").alias("unit"))))
    each = F.transform(lines, lambda x, i: F.struct(i.alias("line_no"), x.alias("unit")))
    units = few.select(key, F.explode(F.concat(F.coalesce(whole, F.array().cast("array<struct<line_no:int,unit:string>>")), each)).alias("u"))
    sized = units.select(key, "u.line_no", once(_words(F.col("u.unit"))).alias("w")).filter(F.size("w") > low)
    grams = sized.select(key, "line_no", once(F.array_distinct(_pairs(F.col("w")))).alias("g")).filter(F.size("g").between(low, high))
    likely = grams.filter(F.arrays_overlap("g", _listed(signs)))
    best = F.array_max(F.array(*[_dice(F.col("g"), name, i, b, least) for i, (name, b) in enumerate(sets)]))
    found = likely.withColumn("best", best).filter("best.dice IS NOT NULL")
    names = F.array(*[F.lit(name) for name, _ in sets])
    return found.select(key, "line_no", F.get(names, -F.col("best.at")).alias("license"), F.round("best.dice", 6).alias("dice"), F.size("g").cast("long").alias("n_bigrams"))


def _listed(bigrams: list[str]) -> Column:
    """An array of bigrams, which hold a-z, 0-9 and a blank only, as one literal: built one by one they take seconds."""
    return F.expr("array({})".format(", ".join(f"'{x}'" for x in bigrams)))


def _words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(unit), "[^a-z0-9]+", " ")), " ")


def _pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of ``value``, computed once inside a higher-order function."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def scan_passages(
    df: DataFrame, text: str = "text", key: str = "doc_id", templates: tuple = TEMPLATES, passages: tuple = PASSAGES, least: float = 0.8
) -> DataFrame:
    """A row for each passage that states a licence across lines or within a longer one, as ``scan_licenses`` has it for units.

    The whole text is one run of words, line breaks as white space. Where one of a template's first bigrams occurs,
    as many words as the template has are compared with it. Of passages that overlap, the one of the highest Dice
    coefficient counts, then that of the longest template. line_no is the line of its first word, n_bigrams its own
    number. A passage goes without a row where a line it touches, or the whole text, is a unit that states the same
    licence. Only texts that hold enough bigrams of a template are looked into; nothing is joined or shuffled.
    """
    return _passages(likely_texts(df, text, key, templates + passages, least), key, templates, least)


def _passages(few: DataFrame, key: str, templates: tuple, least: float) -> DataFrame:
    def windows(t: Column) -> Column:
        size, signs = F.size(t["b"]), F.size(t["b"]) - t["need"] + 1

        def at(ids: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get(ids, i).between(1, signs))
            return F.filter(F.transform(starts, lambda i: one(ids, i)), lambda x: x["dice"] >= least)

        def one(ids: Column, i: Column) -> Column:
            own = F.size(F.array_distinct(F.slice("p", i + 1, t["n"] - 1)))
            shared = F.size(F.array_distinct(F.filter(F.slice(ids, i + 1, t["n"] - 1), lambda x: x > 0)))
            end = F.least(i + t["n"], F.size("p") + 1) - 1
            return _let(own, lambda n: F.struct((2.0 * shared / (n + size)).alias("dice"), size.alias("m"), i.alias("start"), end.alias("end"), n.alias("n"), t["license"].alias("license"), t["at"].alias("at")))

        return _let(F.transform("p", lambda x: F.array_position(t["b"], x)), at)

    found = few.select(key, "t", once(F.flatten(F.transform("ts", windows))).alias("x")).filter(F.size("x") > 0)
    order = F.array_sort(F.transform("x", lambda x: F.struct((-x["dice"]).alias("a"), (-x["m"]).alias("b"), x["start"].alias("start"), x["at"].alias("c"), x["end"].alias("end"), x["n"].alias("n"), x["license"].alias("license"), x["dice"].alias("dice"))))
    free = lambda got, x: ~F.exists(got, lambda y: (y["start"] <= x["end"]) & (x["start"] <= y["end"]))
    chosen = F.aggregate("o", F.filter("o", lambda x: F.lit(False)), lambda got, x: F.when(free(got, x), F.array_append(got, x)).otherwise(got))
    best = found.select(key, "t", once(order).alias("o")).select(key, "t", once(chosen).alias("x"))
    lines = best.select(key, "x", once(F.split("t", "\n", -1)).alias("ls"), "t")
    of_word = F.flatten(F.transform("ls", lambda x, i: F.array_repeat(i, F.size(F.filter(_words(x), lambda w: w != "")))))
    sets = [(name, template_bigrams(t)) for name, t in templates]
    names = F.array(*[F.lit(name) for name, _ in sets])

    def stated(unit: Column) -> Column:
        best = lambda g: F.get(names, -F.array_max(F.array(*[_dice(g, name, i, b, least) for i, (name, b) in enumerate(sets)])).cast("struct<dice:double,at:int>")["at"])
        return _let(F.array_distinct(_pairs(_words(unit))), best)

    told = lines.select(key, "x", once(of_word).alias("line"), once(F.transform("ls", stated)).alias("told"), once(stated(F.col("t"))).alias("all"))

    def is_new(x: Column) -> Column:
        first, last = F.get("line", x["start"]), F.get("line", x["end"])
        return ~F.coalesce(F.col("all") == x["license"], F.lit(False)) & ~F.exists(F.slice("told", first + 1, last - first + 1), lambda k: k.eqNullSafe(x["license"]))

    new = told.select(key, "line", F.explode(F.filter("x", is_new)).alias("x"))
    return new.select(key, F.get("line", F.col("x.start")).alias("line_no"), "x.license", F.round("x.dice", 6).alias("dice"), F.col("x.n").cast("long").alias("n_bigrams"))


def _dice(g: Column, name: str, at: int, bigrams: list[str], least: float) -> Column:
    m = len(bigrams)
    fits = F.size(g).between(least_shared(m, least), math.floor(m * (2 - least) / least + 1e-9))
    dice = 2.0 * F.size(F.array_intersect(g, _listed(bigrams))) / (F.size(g) + m)
    return F.when(fits, F.when(dice >= least, F.struct(dice.alias("dice"), F.lit(-at).alias("at"))))


def _rows(templates: tuple) -> str:
    one = "({}, '{}', {}, [{}])".format
    return ", ".join(one(i, n, len(template_words(t)), ", ".join(f"'{b}'" for b in template_bigrams(t))) for i, (n, t) in enumerate(templates))


def sql(templates: tuple = TEMPLATES, passages: tuple = PASSAGES, least: float = 0.8) -> str:
    """``scan_licenses`` and ``scan_passages`` for DuckDB: every unit against every template; then of each text that holds
    enough of a template's bigrams, the windows that begin with one of its first, taken one by one from the best on."""
    high = 2 - least
    return rf"""
WITH RECURSIVE t(tno, license, n, b) AS (VALUES {_rows(templates)}),
l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(range(0, len(ls))) AS line_no, unnest(ls) AS unit FROM l UNION ALL SELECT doc_id, -1, text FROM l WHERE len(ls) > 1),
w AS (SELECT doc_id, line_no, string_split(trim(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM u),
g AS (SELECT doc_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w),
d AS (SELECT doc_id, line_no, license, tno, len(g) AS n, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g, t WHERE len(g) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, tno) AS nth FROM d WHERE dice >= {least}),
stated AS (SELECT doc_id, line_no, license, dice, n FROM r WHERE nth = 1),
p(pno, license, n, b) AS (VALUES {_rows(templates + passages)}),
q AS (SELECT *, CAST(ceil(len(b) * {least} / {high} - 1e-9) AS INTEGER) AS need FROM p),
known AS (SELECT list_distinct(flatten(list(b))) AS ks, min(need) AS few FROM q),
tw AS (SELECT doc_id, ls, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM l WHERE text IS NOT NULL),
tp AS (SELECT doc_id, ls, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS p FROM tw),
ts AS (SELECT *, list_intersect(list_distinct(p), ks) AS s FROM tp, known WHERE len(list_intersect(list_distinct(p), ks)) >= few),
likely AS (SELECT doc_id, p, pno, license, n, b, need FROM ts, q WHERE len(list_intersect(s, b)) >= need),
start AS (SELECT *, unnest(range(0, len(p))) AS i FROM likely),
win AS (SELECT doc_id, pno, license, n, b, i, least(i + n, len(p) + 1) - 1 AS e, list_distinct(p[i + 1:i + n - 1]) AS own FROM start WHERE coalesce(list_position(b, p[i + 1]), 0) BETWEEN 1 AND len(b) - need + 1),
hit AS (SELECT doc_id, pno, license, len(b) AS m, i, e, len(own) AS own, 2.0::DOUBLE * len(list_intersect(own, b)) / (len(own) + len(b)) AS dice FROM win),
best AS (SELECT doc_id, list({{'license': license, 'i': i, 'e': e, 'own': own, 'dice': dice}} ORDER BY dice DESC, m DESC, i, pno) AS x FROM hit WHERE dice >= {least} GROUP BY doc_id),
pick(doc_id, x, one) AS (SELECT doc_id, x, NULL::STRUCT(license VARCHAR, i BIGINT, e BIGINT, own BIGINT, dice DOUBLE) FROM best
  UNION ALL SELECT doc_id, list_filter(x, lambda y: y.e < x[1].i OR y.i > x[1].e), x[1] FROM pick WHERE len(x) > 0),
lines AS (SELECT doc_id, flatten(list_transform(range(0, len(ls)), lambda k: repeat([k], len(list_filter(string_split(trim(regexp_replace(lower(ls[k + 1]), '[^a-z0-9]+', ' ', 'g')), ' '), lambda v: v <> ''))))) AS line FROM ts),
found AS (SELECT doc_id, one.license AS license, one.own AS own, one.dice AS dice, line[one.i + 1] AS a, line[one.e + 1] AS z FROM pick JOIN lines USING (doc_id) WHERE one IS NOT NULL)
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, license, round(dice, 6) AS dice, CAST(n AS BIGINT) AS n_bigrams FROM stated
UNION ALL SELECT doc_id, CAST(a AS INTEGER), license, round(dice, 6), CAST(own AS BIGINT) FROM found f
WHERE NOT EXISTS (SELECT 1 FROM stated k WHERE k.doc_id = f.doc_id AND k.license = f.license AND (k.line_no = -1 OR k.line_no BETWEEN f.a AND f.z))
"""


def op3(df: DataFrame) -> DataFrame:
    few = cut(likely_texts(df).select("doc_id", F.col("t").alias("text")))  # written once for both scans, a small part of the texts
    return _units(few.withColumnRenamed("text", "t"), "doc_id", TEMPLATES, 0.8).unionByName(scan_passages(few))
