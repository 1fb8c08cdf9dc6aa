"""Kept tables: joins without a shuffle, versions that steps raise."""

import pytest
from pyspark.sql import functions as F

from nearfield.functions.schema import FEATURES, SCHEMA_VERSION, SEARCH_RUNS, SchemaError
from nearfield.operators import evaluate, kept, retrieval
from nearfield.operators.kept import Kept
from nearfield.operators.shared import claimed


def features(spark, n=60):
    return spark.range(n).select("id", *[F.array(F.lit(1.0), F.col("id").cast("double")).alias(f) for f in FEATURES])


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


@pytest.fixture
def unsent(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_kept_tables_join_without_a_shuffle(spark, tmp_path, unsent):
    f, items = features(spark), features(spark).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("string").alias("label"))
    a, b = (Kept(spark, str(tmp_path / n)).write(df, buckets=4) for n, df in (("f", f), ("i", items)))
    both, plain = evaluate.labelled(a.read(), b.read(), "id", "label"), evaluate.labelled(f, items, "id", "label")
    assert exchanges(both) == 0 < exchanges(plain)
    assert sorted(map(str, both.collect())) == sorted(map(str, plain.collect()))
    # Of a list of pairs only the list is dealt, once for each side.
    pairs = f.select(F.col("id").alias("left"), (59 - F.col("id")).alias("right"))
    met = retrieval.compare(a.read(), pairs)
    assert exchanges(met) == 2 < exchanges(retrieval.compare(f, pairs))
    assert sorted(map(str, met.select("left", "right", "fused").collect())) == sorted(map(str, retrieval.compare(f, pairs).select("left", "right", "fused").collect()))
    assert exchanges(a.read().groupBy("id").count()) == 0
    # Three tables: items with features and runs.
    runs = Kept(spark, str(tmp_path / "r")).write(f.select("id", (F.col("id") * 2).alias("n")).unionByName(f.select("id", F.lit(None).cast("long").alias("n"))), buckets=4)
    assert exchanges(kept.met(kept.met(a.read(), b.read()), runs.read(), how="left")) == 0


def test_another_session_reads_the_buckets(spark, tmp_path, unsent):
    f = features(spark).unionByName(features(spark, 5)).unionByName(features(spark, 1).withColumn("id", F.lit(None).cast("long")))
    Kept(spark, str(tmp_path / "it's")).write(f.withColumn("odd `name`, x", F.lit(1)).withColumn("version", F.lit("x")), buckets=3)
    table = Kept(spark, str(tmp_path / "it's"))
    spark.sql(f"DROP TABLE {table._name(SCHEMA_VERSION)}")  # the catalog of a session that knows nothing of it
    again = table.read()
    assert again.count() == 66 and again.filter("id IS NULL").count() == 1 and again.columns[-2:] == ["odd `name`, x", "version"]
    assert exchanges(again.groupBy("id").count()) == 0 and table.version() == SCHEMA_VERSION
    empty = Kept(spark, str(tmp_path / "empty")).write(f.limit(0), buckets=3)
    assert empty.read().count() == 0
    with pytest.raises(SchemaError):
        empty.write(f)


def test_an_old_table_is_raised_once(spark, tmp_path):
    old = spark.createDataFrame([(1, 5), (2, None)], "id long, elapsed_ms int")
    table = Kept(spark, str(tmp_path / "runs")).write(old, buckets=2, version=1)
    assert table.read().columns == ["id", "elapsed_ms"] and table.version() == 1
    new = table.raised("search_runs")
    want = spark.createDataFrame([], SEARCH_RUNS).schema
    assert [(f.name, f.dataType) for f in new.schema] == [(f.name, f.dataType) for f in want]
    assert sorted((r["id"], r["version"], r["elapsed_ms"]) for r in new.collect()) == [(1, 1, 5), (2, 1, None)]
    files = sorted(p.name for p in (tmp_path / "runs").rglob("*.parquet"))
    assert table.raised("search_runs").count() == 2 and sorted(p.name for p in (tmp_path / "runs").rglob("*.parquet")) == files  # not again
    assert table.version() == SCHEMA_VERSION and table.read(1).columns == ["id", "elapsed_ms"]


def test_steps_follow_each_other_and_broken_ones_leave_the_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(kept, "SCHEMA_VERSION", 4)
    taken = []

    def step(n, fails=False):
        def run(df):
            taken.append(n)
            bad = F.raise_error(F.lit("broken")).cast("int") if fails else F.lit(n)
            return df.withColumn(f"c{n}", bad)

        return run

    table = Kept(spark, str(tmp_path / "t")).write(spark.range(10), buckets=2, version=1)
    with pytest.raises(Exception, match="broken"):
        table.raised("t", {"t": {1: step(1), 2: step(2, fails=True), 3: step(3)}}, 4)
    assert table.versions() == [1, 2] and table.read().columns == ["id", "c1"]
    done = table.raised("t", {"t": {1: step(1), 2: step(2), 3: step(3)}}, 4)
    assert taken == [1, 2, 2, 3] and done.columns == ["id", "c1", "c2", "c3"] and done.count() == 10
    for steps, to in (({}, 5), ({"t": {}}, 5), ({}, 3)):
        with pytest.raises(SchemaError):
            table.raised("t", steps, to)
    claimed(spark, f"{table.path}/_raising-5")
    with pytest.raises(SchemaError, match="_raising-5"):
        table.raised("t", {"t": {4: step(4)}}, 5)


def test_unknown_versions_are_errors(spark, tmp_path):
    table = Kept(spark, str(tmp_path / "t"))
    with pytest.raises(SchemaError):
        table.read()
    with pytest.raises(SchemaError):
        table.raised("images")
    table.write(spark.range(3), buckets=2, version=SCHEMA_VERSION + 1)
    for call in (table.read, lambda: table.read(1), lambda: table.raised("images")):
        with pytest.raises(SchemaError):
            call()
