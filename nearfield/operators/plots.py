"""The data behind plots of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.schema import EXTRACTOR_VERSION
from nearfield.operators.shared import exists

# Names of the colour moments' bars and of the texture grid's rows.
MOMENTS = ("H mean", "H std", "H skew", "S mean", "S std", "S skew", "V mean", "V std", "V skew")
TEXTURES = ("contrast", "dissimilarity", "homogeneity", "energy", "correlation")
BARS = ("hsv", "lbp", "hu", "cm")


def bars(features: DataFrame, id_col: str, feature: str) -> DataFrame:
    """id, feature, pos, label, value: a bar for each component; colour moments have names, others numbers."""
    if feature not in BARS:
        raise KeyError(feature)
    name = F.col("pos").cast("string")
    if feature == "cm":
        name = F.coalesce(F.get(F.array(*map(F.lit, MOMENTS)), F.col("pos")), name)
    return features.select(id_col, F.posexplode(feature).alias("pos", "value")).select(id_col, F.lit(feature).alias("feature"), "pos", name.alias("label"), "value")


def grid(features: DataFrame, id_col: str, feature: str = "glcm", columns: int = 8) -> DataFrame:
    """id, row, col, value of a heat map."""
    return features.select(id_col, F.posexplode(feature).alias("pos", "value")).select(
        id_col, F.floor(F.col("pos") / columns).cast("int").alias("row"), (F.col("pos") % columns).cast("int").alias("col"), "value"
    )


def subsample(features: DataFrame, id_col: str, feature: str = "hog", most: int = 256) -> DataFrame:
    """id, nth, pos, value of ``most`` evenly spaced components at most."""
    stride = F.greatest(F.lit(1), F.floor(F.size(feature) / most).cast("int"))
    rows = features.select(id_col, stride.alias("stride"), F.posexplode(feature).alias("pos", "value")).filter("pos % stride = 0")
    return rows.withColumn("nth", (F.col("pos") / F.col("stride")).cast("int")).filter(F.col("nth") < most).select(id_col, "nth", "pos", "value")


def kept(spark: SparkSession, root: str, features: DataFrame, id_col: str, feature: str, version: str = EXTRACTOR_VERSION) -> DataFrame:
    """The plot data of ``feature`` for the items of ``features``, kept below ``root`` by feature and version.

    Items whose data are there are read, not worked out again; only the others are added.
    """
    make = {"glcm": grid, "hog": subsample}.get(feature, lambda f, i: bars(f, i, feature))
    path = f"{root}/plots/{feature}_v{version}"
    stored = exists(spark, path)
    known = spark.read.parquet(path).select(id_col).distinct() if stored else None
    new = features.join(known, id_col, "left_anti") if stored else features
    make(new, id_col).write.mode("append").parquet(path)
    return spark.read.parquet(path).join(features.select(id_col), id_col, "left_semi")
