"""Mixing sources to target weights: hierarchical budgets and seeded epochs, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import cut

#: Weights by value for each level of the tree, and the weight of any other value.
WEIGHTS = (({"web": 2, "books": 5, "code": 3}, 1), ({"en": 4, "de": 3, "fr": 2, "es": 1}, 1), ({}, 1))
#: Bytes of leaves that are sent to every task at most; more are joined by shuffling.
SENT_BYTES = 16 << 20


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: str) -> Column:
    """The domain of a source: by the remainder by 3 of the number it ends in, which is that of the sum of its digits, so
    that a number may have any number of digits. A source that ends in none, or null, is of the domain other."""
    number = F.coalesce(F.regexp_extract(source, r"([0-9]+)\z", 1), F.lit(""))
    digits = lambda others: F.length(F.translate(number, others, ""))
    remainder = (digits("0235689") + 2 * digits("0134679")) % 3
    return F.when(number == "", "other").otherwise(F.get(F.array(F.lit("web"), F.lit("books"), F.lit("code")), remainder))


def _weight(value: Column, weights: tuple) -> Column:
    listed, other = weights
    found = F.lit(other)
    for k, w in listed.items():
        found = F.when(value == k, w).otherwise(found)
    return found.cast("long")


def allot(leaves: DataFrame, path: list[str], weights: tuple, target: int) -> DataFrame:
    """``leaves`` (path, cap) with budget: whole tokens of ``target``, handed down the tree.

    Siblings share their parent's budget by weight; one that can't use its share keeps what its subtree holds, and
    the rest goes to its siblings by weight. What a whole family can't use has gone to its parent's siblings
    before, as a parent's own share ends at what its subtree holds. With siblings in order of cap / weight the common
    share a weight is the largest, over all places, of (budget - caps before) / (weights from here on). Shares are
    whole; what rounding down leaves goes token by token to the siblings that can use it, the largest fraction first.
    """
    level = leaves
    for c, w in zip(path, weights, strict=True):
        level = level.withColumn(f"__nf_w_{c}", _weight(F.col(c), w))
    dead = F.least(*[F.col(f"__nf_w_{c}") for c in path], F.lit(1)) <= 0 if len(path) > 1 else F.col(f"__nf_w_{path[0]}") <= 0
    level = level.withColumn("cap", F.when(dead, 0).otherwise(F.col("cap")))
    given = level.agg(F.least(F.coalesce(F.sum("cap"), F.lit(0)), F.lit(target)).cast("long").alias("__nf_b")).first()[0]
    parents = None
    for k, c in enumerate(path):
        above, here = path[:k], path[: k + 1]
        nodes = level.groupBy(*here).agg(F.sum("cap").cast("long").alias("cap"), F.max(f"__nf_w_{c}").alias("w"))
        nodes = nodes.withColumn("__nf_b", F.lit(given).cast("long")) if parents is None else nodes.join(parents, above)
        live = nodes.filter("w > 0")
        order = Window.partitionBy(*above).orderBy(F.col("cap") / F.col("w"), c)
        family = Window.partitionBy(*above)
        before = F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")
        onward = F.sum("w").over(family) - F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("w")
        shared = live.withColumn("__nf_s", (F.col("__nf_b") - before).cast("double") / onward)
        real = shared.withColumn("__nf_x", F.max("__nf_s").over(family) * F.col("w"))
        whole = real.withColumn("__nf_share", F.greatest(F.least(F.col("cap"), F.floor("__nf_x").cast("long")), F.lit(0).cast("long")))
        next_ = family.orderBy(F.col("__nf_share") >= F.col("cap"), (F.col("__nf_x") - F.col("__nf_share")).desc(), c)
        more = (F.row_number().over(next_) <= F.col("__nf_b") - F.sum("__nf_share").over(family)) & (F.col("__nf_share") < F.col("cap"))
        parents = whole.select(*here, (F.col("__nf_share") + more.cast("long")).alias("__nf_b"))
    return leaves.join(parents.withColumnRenamed("__nf_b", "budget"), path, "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long")))


def mix(
    df: DataFrame, path: dict[str, Column], weights: tuple = WEIGHTS, tokens: Column | None = None, key: str = "doc_id",
    share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 42, target: int | None = None,
) -> DataFrame:
    """The rows of ``df`` that make up the mixture, once for each epoch that takes them, with __nf_path columns, epoch and n_tokens.

    ``path`` names the tree's levels and their values, null counting as an empty name. ``target`` tokens (or the
    fraction ``share`` of all) are allotted to leaves. In each epoch a leaf's rows have a seeded order, by md5 of seed,
    epoch and key; whole epochs take all rows, at most ``epochs`` times, and the last one takes the longest prefix that
    fits what is left. Rows with equal keys are taken together or not at all; rows without tokens go with their
    place. ``tokens`` is the word count of ``text`` unless given. An empty table gives no rows; a very long text is one
    number here. Columns of ``df`` may have any name that does not begin with ``__nf_``.

    A leaf of any size spreads over 4096 ranges of the order: their sums find the range in which the prefix ends,
    and only that range's keys are put in order, rows of one key added up before.
    """
    levels = {f"__nf_path_{k}": F.coalesce(v.cast("string"), F.lit("")) for k, v in path.items()}
    names = list(levels)
    rows = df.withColumns(levels | {"__nf_n": tokens if tokens is not None else word_count("text")})
    slim = cut(rows.select(*names, "__nf_n", F.coalesce(F.col(key).cast("string"), F.lit("")).alias("__nf_id")))
    sums = cut(slim.groupBy(*names).agg(F.sum("__nf_n").cast("long").alias("have")))
    if target is None:
        target = int(sums.agg(F.coalesce(F.sum("have"), F.lit(0))).first()[0]) * share[0] // share[1]
    caps = sums.withColumn("cap", F.col("have") * epochs)
    budgets = allot(caps, names, weights, target).withColumn("whole", F.when(F.col("have") > 0, F.floor(F.col("budget") / F.greatest("have", F.lit(1)))).otherwise(0).cast("int"))
    budgets = cut(budgets.withColumn("left", F.col("budget") - F.col("whole") * F.col("have")).select(*names, "whole", "left"))
    size = budgets.agg(F.sum(F.lit(64) + sum((F.length(c) for c in names), F.lit(0)))).first()[0] or 0
    few = size <= SENT_BYTES
    near = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.col("__nf_id")))
    placed = slim.join(near(budgets.filter("left > 0")), names).withColumn("at", order).withColumn("range", F.substring("at", 1, 3))
    ranges = placed.groupBy(*names, "left", "range").agg(F.sum("__nf_n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy("range"))
    ranges = ranges.withColumn("upto", upto).filter("upto > left AND upto - n <= left").select(*names, "range", (F.col("upto") - F.col("n")).alias("before"))
    ranges = cut(ranges)
    inside = placed.join(near(ranges), [*names, "range"]).groupBy(*names, "left", "before", "range", "at").agg(F.sum("__nf_n").alias("__nf_n"))
    running = F.col("before") + F.sum("__nf_n").over(Window.partitionBy(*names).orderBy("at"))
    ends = inside.withColumn("run", running).groupBy(*names).agg(F.max(F.when(F.col("run") <= F.col("left"), F.col("at"))).alias("last"), F.min("range").alias("range"))
    limits = cut(budgets.join(ends, names, "left").select(*names, "whole", F.when(F.col("left") > 0, F.coalesce("last", "range")).alias("last")))
    here = rows.join(near(limits), names)
    at = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    times = F.col("whole") + F.when(at <= F.col("last"), 1).otherwise(0)
    taken = here.withColumn("__nf_times", times).filter("__nf_times > 0")
    return taken.withColumn("__nf_epoch", F.explode(F.sequence(F.lit(0), F.col("__nf_times") - 1))).select(*df.columns, *names, "__nf_epoch", "__nf_n")


def tree(source: str = "source", lang: str = "lang") -> dict[str, Column]:
    return {"domain": domain_of(source), "lang": F.col(lang), "source": F.col(source)}


def op9(df: DataFrame) -> DataFrame:
    got = mix(df.select("doc_id", "lang", "source", "text"), tree())
    return got.select("doc_id", F.col("__nf_path_domain").alias("domain"), F.col("__nf_path_lang").alias("lang"), F.col("__nf_path_source").alias("source"), F.col("__nf_epoch").alias("epoch"), F.col("__nf_n").alias("n_tokens"))


def sql(epochs: int = 2, seed: int = 42) -> str:
    def fill(name: str, keys: str, prev: str, weight: str, above: str) -> str:
        part = f"PARTITION BY {above}" if above else ""
        join = f"JOIN {prev} USING ({above})" if above else f"CROSS JOIN {prev}"
        return f"""{name}_n AS (SELECT {keys}, CAST(sum(cap) AS BIGINT) AS cap, {weight} AS w FROM leaf GROUP BY {keys}),
{name}_s AS (SELECT *, CAST(b - (sum(cap) OVER (o ROWS UNBOUNDED PRECEDING) - cap) AS DOUBLE) / (sum(w) OVER ({part}) - sum(w) OVER (o ROWS UNBOUNDED PRECEDING) + w) AS s
  FROM {name}_n {join} WINDOW o AS ({part} ORDER BY cap / w, {keys.split(", ")[-1]})),
{name}_x AS (SELECT *, max(s) OVER ({part}) * w AS x FROM {name}_s),
{name}_f AS (SELECT *, greatest(0, least(cap, CAST(floor(x) AS BIGINT))) AS f FROM {name}_x),
{name}_m AS (SELECT *, row_number() OVER ({part} ORDER BY f >= cap, x - f DESC, {keys.split(", ")[-1]}) AS nth, b - sum(f) OVER ({part}) AS more FROM {name}_f),
{name} AS (SELECT {keys}, CAST(f + CASE WHEN f < cap AND nth <= more THEN 1 ELSE 0 END AS BIGINT) AS b FROM {name}_m)"""

    case = lambda c, w: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in w[0].items()) + f" ELSE {w[1]} END" if w[0] else str(w[1])
    return rf"""
WITH num AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(regexp_extract(source, '([0-9]+)\z', 1), '') AS k,
  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n FROM documents),
d AS (SELECT doc_id, CASE WHEN k = '' THEN 'other' ELSE ['web', 'books', 'code'][(length(translate(k, '0235689', '')) + 2 * length(translate(k, '0134679', ''))) % 3 + 1] END AS domain, lang, source, n FROM num),
leaf AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS have, CAST(sum(n) AS BIGINT) * {epochs} AS cap FROM d GROUP BY ALL),
top AS (SELECT least(CAST(sum(have) AS BIGINT) // 2, CAST(sum(cap) AS BIGINT)) AS b FROM leaf),
{fill("b1", "domain", "top", case("domain", WEIGHTS[0]), "")},
{fill("b2", "domain, lang", "b1", case("lang", WEIGHTS[1]), "domain")},
{fill("b3", "domain, lang, source", "b2", case("source", WEIGHTS[2]), "domain, lang")},
plan AS (SELECT domain, lang, source, CASE WHEN have > 0 THEN b // have ELSE 0 END AS whole, CASE WHEN have > 0 THEN b % have ELSE 0 END AS rest FROM leaf JOIN b3 USING (domain, lang, source)),
e AS (SELECT d.*, whole, rest, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5('{seed}:' || whole || ':' || doc_id)) AS run FROM d JOIN plan USING (domain, lang, source)),
r AS (SELECT *, unnest(range(0, whole + CASE WHEN rest > 0 AND run <= rest THEN 1 ELSE 0 END)) AS epoch FROM e)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, n AS n_tokens FROM r
"""
