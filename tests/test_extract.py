"""Extraction over tables: how images are dealt, and equal images."""

import numpy as np
from pyspark.sql import functions as F

from nearfield.functions.kernels import hu_moments
from nearfield.operators import extract
from nearfield.plans import queries


def test_images_of_one_file_are_dealt_to_many_tasks(spark, tmp_path):
    spark.range(1, 41).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    for names in (("hsv", "cm"), ("lbp", "glcm")):
        found = queries._extracted(spark, str(tmp_path), names)
        assert found.rdd.getNumPartitions() > 1
        assert sorted(r["id"] for r in found.select("id").collect()) == list(range(1, 41))


def test_equal_images_are_worked_out_once(spark, tmp_path, monkeypatch):
    log = str(tmp_path / "log")

    def counted(img):
        with open(log, "a") as f:
            f.write("x")
        return hu_moments(img)

    monkeypatch.setitem(extract.EXTRACTORS, "hu", counted)
    images = [np.full((8, 8, 3), 40 * (i % 3), np.uint8) for i in range(30)]
    images += [images[1].reshape(4, 16, 3)]  # the same bytes in another shape
    rows = [(i, (x.shape[0], x.shape[1], bytearray(x.tobytes()))) for i, x in enumerate(images)]
    df = spark.createDataFrame(rows, "id long, image struct<height:int,width:int,data:binary>").coalesce(1)
    found = {r["id"]: r["hu"] for r in extract.extract(df, names=("hu",), prepared=True).collect()}
    assert len(open(log).read()) == 4 and sorted(found) == list(range(31))
    for i, x in enumerate(images):
        assert found[i] == hu_moments(x).tolist()
    monkeypatch.setattr(extract, "KEPT_BYTES", 300)  # room for one image: the others take its place
    again = {r["id"]: r["hu"] for r in extract.extract(df, names=("hu",), prepared=True).collect()}
    assert again == found and len(open(log).read()) == 4 + 31
