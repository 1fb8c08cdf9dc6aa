"""Vector expressions on array columns, made of built-ins that Catalyst knows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 1e-12


def _col(v: Column | str) -> Column:
    return F.col(v) if isinstance(v, str) else v


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column | str) -> Column:
    """The unit vector; a vector of norm 1e-12 or less stays as it is."""
    v = _col(v)
    scaled = lambda n: F.when(n <= EPS, v).otherwise(F.transform(v, lambda x: x / n))
    return F.get(F.transform(F.array(norm(v)), scaled), F.lit(0))  # as a lambda's variable the norm is worked out once, not for each element


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity, 0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def clamp01(v: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(v)))


def to_doubles(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def slices(df: DataFrame, vector: str, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Unit vectors by name from 1-based inclusive ranges of one vector column."""
    wide = to_doubles(vector)
    return df.withColumns({f: l2_normalize(F.slice(wide, a, b - a + 1)) for f, (a, b) in bounds.items()})


def register(spark: SparkSession) -> None:
    """SQL functions cosine_sim(a, b), l2_normalize(v) and fuse(sims, weights) for the session; Catalyst inlines them."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION l2_normalize(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN get(transform(array(sqrt(aggregate(v, 0D, (s, x) -> s + x * x))), n -> CASE WHEN n <= 1e-12 THEN v ELSE transform(v, y -> y / n) END), 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN coalesce(try_divide(aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x), sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))), 0D)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fuse(sims MAP<STRING, DOUBLE>, weights MAP<STRING, DOUBLE>) RETURNS DOUBLE RETURN aggregate(map_entries(sims), 0D, (s, e) -> s + e.value * coalesce(element_at(weights, e.key), 0D))")
