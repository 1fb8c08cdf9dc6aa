"""Merkle dataset manifest: a tree of digests over each group's rows and one over the groups; lookup proofs by coordinates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut
from nearfield.operators.shared import row_numbers

#: Leaves of a block at most. A block's nodes are made in one row, and a leaf asks for coordinates inside its block only.
BLOCK = 256
#: Bytes of groups that are sent to every task at most.
SENT_BYTES = 16 << 20


def field(value: Column) -> Column:
    """A value as its length in bytes, a colon and itself; null as -."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its proof (an array of before, after: the digests left and right of it, level by level) give."""
    return F.aggregate(path, leaf, lambda a, p: F.sha2(F.concat(p["before"], a, p["after"]), 256))


def proof_hash(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def _power(fan: int, exponent: Column) -> Column:
    return F.round(F.pow(F.lit(float(fan)), exponent)).cast("long")


def _height(n: Column, fan: int) -> Column:
    """Levels above ``n`` leaves: how many powers of ``fan`` lie below n."""
    powers = [fan**k for k in range(63) if fan**k < 1 << 62]
    return F.size(F.filter(F.array(*map(F.lit, powers)), lambda p: p < n))


@dataclass
class Tree:
    """nodes: g, level, idx, digest of all nodes; bands: for each band of levels g, n, h, idx of the nodes at its foot; tops: g, digest."""

    nodes: DataFrame
    bands: list[DataFrame]
    tops: DataFrame
    fan: int
    depth: int


def tree(feet: DataFrame, fan: int) -> Tree:
    """Trees over ``feet`` (g, n, h, idx, digest): leaves idx of n in group g, whose tree has h levels above them.

    Levels are made band by band: a block of consecutive nodes is one row, whose levels are arrays; its last node is a
    foot of the next band. A group of any size is many blocks, and a band leaves one node for each.
    """
    depth = max(k for k in range(1, 9) if fan**k <= max(BLOCK, fan))
    height = feet.agg(F.coalesce(F.max("h"), F.lit(0))).first()[0]
    nodes, bands = feet.select("g", F.lit(0).alias("level"), "idx", "digest"), []
    for base in range(0, height, depth):
        bands.append(feet.select("g", "n", "h", "idx"))
        rows = feet.groupBy("g", "n", "h", F.expr(f"idx div {fan**depth}").alias("block")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("d"))
        rows = rows.withColumn("d0", F.transform("d", lambda x: x["digest"]))
        for t in range(1, depth + 1):
            below = F.col(f"d{t - 1}")
            runs = F.transform(F.sequence(F.lit(0), F.expr(f"(size(d{t - 1}) - 1) div {fan}")), lambda i: F.sha2(F.array_join(F.slice(below, i * fan + 1, fan), ""), 256))  # noqa: B023
            rows = rows.withColumn(f"d{t}", F.when(F.col("h") >= base + t, runs))
        made = cut(rows.select("g", "n", "h", "block", *[f"d{t}" for t in range(depth + 1)]))
        levels = F.array(*[F.struct(F.lit(base + t).alias("level"), (F.col("block") * fan ** (depth - t)).alias("first"), F.col(f"d{t}").alias("d")) for t in range(1, depth + 1)])
        each = made.select("g", F.explode(F.filter(levels, lambda x: x["d"].isNotNull())).alias("x"))
        nodes = nodes.unionByName(each.select("g", "x.level", "x.first", F.posexplode("x.d").alias("nth", "digest")).select("g", "level", (F.col("first") + F.col("nth")).alias("idx"), "digest"))
        last = F.coalesce(*[F.col(f"d{t}") for t in range(depth, -1, -1)])
        feet = made.select("g", "n", "h", F.col("block").alias("idx"), F.element_at(last, 1).alias("digest"))
    return Tree(nodes, bands, feet.select("g", "digest"), fan, depth)


def lookups(made: Tree, above: DataFrame, payload: DataFrame) -> DataFrame:
    """g, idx, path, up, held of every leaf. ``above``: g, idx (0), path, up of the tops. ``payload``: g, n, h, idx, held.

    From the highest band down a foot explodes the coordinates (level, index) of the siblings that it needs in its band
    from its index and the leaves there are, looks them up in the node table, puts them in order and puts the path of
    its block's node behind. A node is asked for by at most ``BLOCK`` feet, also one near the root.
    """
    fan, depth = made.fan, made.depth
    for k in range(len(made.bands) - 1, -1, -1):
        base = k * depth
        feet = payload if k == 0 else made.bands[k].withColumn("held", F.lit(None).cast(payload.schema["held"].dataType))
        feet = feet.withColumn("block", F.expr(f"idx div {fan**depth}"))
        top = F.least(F.col("h"), F.lit(base + depth)) - 1
        levels = F.when(F.col("h") > base, F.sequence(F.lit(base), top))
        asked = feet.select("g", "n", "h", "block", "idx", F.explode(levels).alias("level"))
        own = F.floor(F.col("idx") / _power(fan, F.col("level") - base)).cast("long")
        there = F.floor((F.col("n") + _power(fan, F.col("level")) - 1) / _power(fan, F.col("level"))).cast("long")
        asked = asked.withColumns({"own": own, "there": there})
        first = F.col("own") - F.pmod("own", F.lit(fan))
        run = F.sequence(first, F.least(first + fan - 1, F.col("there") - 1))
        asked = asked.withColumn("sibling", F.explode(F.array_remove(run, F.col("own"))))
        wanted = asked.select("g", "level", F.col("sibling").alias("at"), "n", "h", "block", "idx", (F.col("sibling") < F.col("own")).alias("before"))
        got = wanted.join(made.nodes.select("g", "level", F.col("idx").alias("at"), "digest"), ["g", "level", "at"])
        none = F.lit(None).cast("struct<level:int,at:bigint,before:boolean,digest:string>")
        rows = got.select("g", "n", "h", "block", "idx", F.struct("level", "at", "before", "digest").alias("s"), F.lit(None).cast(payload.schema["held"].dataType).alias("held"))
        rows = rows.unionByName(feet.select("g", "n", "h", "block", "idx", none.alias("s"), "held")).repartition("g", "block")
        each = rows.groupBy("g", "block", "n", "h", "idx").agg(F.sort_array(F.collect_list("s")).alias("s"), F.first("held", True).alias("held"))
        side = lambda level, before: F.array_join(F.transform(F.filter("s", lambda x: (x["level"] == level) & (x["before"] == before)), lambda x: x["digest"]), "")
        own_path = F.coalesce(F.transform(levels, lambda level: F.struct(side(level, True).alias("before"), side(level, False).alias("after"))), F.array().cast("array<struct<before:string,after:string>>"))
        each = each.withColumn("own", own_path)
        higher = above.select("g", F.col("idx").alias("block"), "path", "up")
        above = each.join(higher, ["g", "block"]).select("g", "idx", F.concat("own", "path").alias("path"), "up", "held")
        above = above if k == 0 else cut(above)
    return above if made.bands else payload.select("g", "idx", "held").join(above.select("g", "path", "up"), "g").select("g", "idx", "path", "up", "held")


@dataclass
class Manifest:
    """leaves: g, n, h, idx, digest and the kept columns; groups: the group's value, g, n, subroot. ``over`` is the tree over groups."""

    leaves: DataFrame
    groups: DataFrame
    inner: Tree
    over: Tree
    kept: list[str]

    def nodes(self) -> DataFrame:
        """g, level, idx, digest of all nodes; g counts groups in order of their names from 0, the tree over groups has -1."""
        return self.inner.nodes.unionByName(self.over.nodes)

    def proofs(self) -> DataFrame:
        """The kept columns, leaf, path, subroot, root of every row."""
        tops = self.over.tops.select("g", F.lit(0).cast("long").alias("idx"), F.array().cast("array<struct<before:string,after:string>>").alias("path"), F.col("digest").alias("up"))
        groups = _over_feet(self.groups).withColumn("held", F.col("digest")).drop("digest")
        above = lookups(self.over, tops, groups).select(F.col("idx").alias("g"), F.lit(0).cast("long").alias("idx"), "path", F.struct(F.col("held").alias("subroot"), F.col("up").alias("root")).alias("up"))
        held = F.struct(*self.kept, F.col("digest").alias("leaf"))
        got = lookups(self.inner, cut(above), self.leaves.select("g", "n", "h", "idx", held.alias("held")))
        return got.select("held.*", "path", "up.subroot", "up.root")


def _over_feet(groups: DataFrame) -> DataFrame:
    return groups.select(F.lit(-1).cast("long").alias("g"), "all_n", "all_h", F.col("g").alias("idx"), F.col("subroot").alias("digest")).toDF("g", "n", "h", "idx", "digest")


def manifest(df: DataFrame, values: list[str], key: str = "doc_id", group: str = "lang", fan: int = 2, keep: dict[str, Column] | None = None) -> Manifest:
    """The trees over ``df``: leaves are digests of ``values``, in order of ``key`` within ``group``.

    A null is told from an empty value, and null groups are a group of their own, before all others; groups are ordered by
    their names' bytes. Rows of one key are ordered by their digests, null keys come first; repeated rows are leaves
    beside each other. Texts are hashed where they lie, whole, and never shuffled: only digests are, with ``keep`` (columns
    worked out from a row). An empty table has no nodes. Columns of ``df`` may have any name. A group of any
    size lies in sorted ranges and blocks.
    """
    keep = keep or {}
    if clash := {"g", "n", "h", "idx", "digest", "leaf", "path", "subroot", "root"} & set(keep):
        raise ValueError(f"kept columns {sorted(clash)} have the names of new ones")
    slim = cut(df.select(F.col(group).cast("string").alias("__nf_group"), F.col(key).alias("__nf_key"), leaf_hash([F.col(v) for v in values]).alias("digest"), *[c.alias(k) for k, c in keep.items()]))
    groups = slim.groupBy("__nf_group").agg(F.count("*").alias("n"))
    groups = cut(row_numbers(groups, [], ["__nf_group"], "g").select("__nf_group", (F.col("g") - 1).alias("g"), "n", _height(F.col("n"), fan).alias("h")))
    size = groups.agg(F.sum(F.coalesce(F.octet_length("__nf_group"), F.lit(0)) + 64)).first()[0] or 0
    named = groups.withColumnRenamed("__nf_group", "__nf_g")
    rows = slim.join(F.broadcast(named) if size <= SENT_BYTES else named, F.col("__nf_group").eqNullSafe(F.col("__nf_g"))).drop("__nf_group", "__nf_g")
    # Rows that are equal in all else differ in the last column, so that ranges can part them.
    leaves = row_numbers(rows.withColumn("__nf_tie", F.monotonically_increasing_id()), ["g"], ["__nf_key", "digest", "__nf_tie"], "idx")
    leaves = cut(leaves.select("g", "n", "h", (F.col("idx") - 1).alias("idx"), "digest", *keep))
    inner = tree(leaves.select("g", "n", "h", "idx", "digest"), fan)
    count = groups.count()
    every = groups.join(inner.tops.withColumnRenamed("digest", "subroot"), "g")
    every = cut(every.withColumns({"all_n": F.lit(count).cast("long"), "all_h": _height(F.lit(count), fan)}))
    return Manifest(leaves, every, inner, tree(_over_feet(every), fan), list(keep))


#: What a leaf is made of.
VALUES = ("doc_id", "source", "lang", "n_chars", "text")


def op11(df: DataFrame) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    one_more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(21,0)")
    other = F.when(tampered & F.col("n_chars").isNotNull(), leaf_hash([one_more if v == "n_chars" else F.col(v) for v in VALUES]))
    got = manifest(df, list(VALUES), keep={"doc_id": F.col("doc_id"), "other": other}).proofs()
    return got.select(
        "doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), fold(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


SQL = r"""
WITH RECURSIVE c AS (SELECT doc_id, coalesce(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 0) AS k, lang, source, n_chars, text FROM documents),
f AS (SELECT doc_id, lang, xor(k, 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS bad, n_chars,
  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a, coalesce(strlen(text) || ':' || text, '-') AS z FROM c),
l AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, sha256(a || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || z) AS leaf,
  CASE WHEN bad THEN sha256(a || strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) || z) END AS other FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l),
t AS (SELECT g, 0 AS level, i, n, leaf AS d FROM p
  UNION ALL SELECT g, level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, level, i // 2),
s AS (SELECT g, d AS subroot FROM t WHERE n = 1),
u AS (SELECT 0 AS level, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, subroot AS d FROM s
  UNION ALL SELECT level + 1, i // 2, (any_value(n) + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 2),
top AS (SELECT d AS root FROM u WHERE n = 1),
w AS (SELECT doc_id, g, i, i AS at, 0 AS level, n, leaf, coalesce(other, leaf) AS x, '' AS proof FROM p
  UNION ALL SELECT w.doc_id, w.g, w.i, w.at // 2, w.level + 1, (w.n + 1) // 2, w.leaf, sha256(CASE WHEN w.at % 2 = 1 THEN t.d || w.x ELSE w.x || coalesce(t.d, '') END), w.proof || coalesce(t.d, '')
  FROM w LEFT JOIN t ON t.g = w.g AND t.level = w.level AND t.i = xor(w.at, 1) WHERE w.n > 1),
v AS (SELECT doc_id, g, i, g - 1 AS at, 0 AS level, (SELECT count(*) FROM s) AS n, leaf, x, proof FROM w WHERE n = 1
  UNION ALL SELECT v.doc_id, v.g, v.i, v.at // 2, v.level + 1, (v.n + 1) // 2, v.leaf, sha256(CASE WHEN v.at % 2 = 1 THEN u.d || v.x ELSE v.x || coalesce(u.d, '') END), v.proof || coalesce(u.d, '')
  FROM v LEFT JOIN u ON u.level = v.level AND u.i = xor(v.at, 1) WHERE v.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, x AS folded_root, x = root AS verified FROM v JOIN s USING (g), top WHERE n = 1
"""
