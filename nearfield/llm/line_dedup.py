"""Line dedup over documents by overlapping windows of consecutive lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import cut, once


def _windows(rows: DataFrame, text: str, width: int) -> DataFrame:
    """__nf_key, __nf_hash, pos, h1, h2 of each window of ``width`` lines that holds a character other than white space."""
    lines = F.col("__nf_lines")
    window = lambda i: F.array_join(F.slice(lines, i + 1, width), "\n")
    places = F.when(F.size(lines) >= width, F.sequence(F.lit(0), F.size(lines) - width)).otherwise(F.array().cast("array<int>"))
    found = rows.select("__nf_key", "__nf_hash", once(F.split(F.col(text), "\n", -1)).alias("__nf_lines")).select("__nf_key", "__nf_hash", F.posexplode(F.transform(places, window)).alias("pos", "w"))
    filled = found.filter(F.col("w").rlike(r"[^\x20\x09-\x0D]"))
    return filled.select("__nf_key", "__nf_hash", "pos", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit("second"), "w").alias("h2"))


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 3, report: tuple[str, str] | None = ("n_lines", "n_removed")) -> DataFrame:
    """``df`` with the lines of every repeated window but its first taken out of ``text``.

    A window is ``width`` consecutive lines, compared exactly by 128 bits of hash; its occurrences are ordered by
    key (null first), text hash and place. The positions that later occurrences cover are merged and those lines go,
    so a later exact copy of a document with ``width`` lines or more becomes empty. Windows of white space alone do
    not count; texts of fewer lines, and null ones, stay as they are. Rows with the same key and text are one
    document repeated and come out alike. ``report`` names the columns for the lines before and the lines removed;
    columns of ``df`` that have these names give way to them. All other columns stay; their names may be anything that
    does not begin with ``__nf_``. An empty table gives no rows. A very long text is one array of lines, and one row for each
    of its windows, which carry hashes and not text.
    """
    rows = df.withColumns({"__nf_key": F.col(key), "__nf_hash": F.xxhash64(text)})
    windows = _windows(rows, text, width)
    place = F.struct("__nf_key", "__nf_hash", "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
    # Written, so that the join below deals both sides anew and adaptive execution can split a very common window.
    later = windows.join(cut(first.drop("last")), ["h1", "h2"]).filter(place > F.col("first"))
    covered = later.groupBy("__nf_key", "__nf_hash").agg(F.collect_set("pos").alias("__nf_pos"))
    covered = covered.select(F.col("__nf_key").alias("__nf_k"), F.col("__nf_hash").alias("__nf_h"), "__nf_pos")
    both = rows.join(covered, F.col("__nf_key").eqNullSafe(F.col("__nf_k")) & (F.col("__nf_hash") == F.col("__nf_h")), "left")
    both = both.withColumn("__nf_lines", once(F.split(F.col(text), "\n", -1)))
    lines = F.col("__nf_lines")
    gone = F.array_distinct(F.flatten(F.transform("__nf_pos", lambda p: F.sequence(p, p + width - 1))))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    new = F.when(F.col("__nf_pos").isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    out = {text: new}
    if report:
        out[report[0]] = F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long")
        out[report[1]] = F.when(F.col("__nf_pos").isNull(), 0).otherwise(F.size(gone)).cast("long")
    names = [c for c in df.columns if not report or c not in report] + list(report or ())
    return both.withColumns(out).select(*names)


def op8(df: DataFrame) -> DataFrame:
    return dedup_lines(df).select("doc_id", "text", "n_lines", "n_removed")


SQL = r"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(ls) - 2)) AS pos, ls FROM l WHERE len(ls) >= 3),
v AS (SELECT doc_id, pos, ls[pos + 1] || chr(10) || ls[pos + 2] || chr(10) || ls[pos + 3] AS win FROM w),
f AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS nth FROM v WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS i FROM f WHERE nth > 1),
n AS (SELECT doc_id, count(*) AS n_removed FROM c GROUP BY 1),
p AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, ls FROM l WHERE ls IS NOT NULL),
t AS (SELECT p.doc_id, string_agg(p.ls[p.i + 1], chr(10) ORDER BY p.i) AS text FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY 1)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(t.text, '') END AS text,
  CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN t USING (doc_id) LEFT JOIN n USING (doc_id)
"""
