"""Timelines of streams: several micro-batches, restarts, state that expires, subscriptions."""

import time

from pyspark.sql import functions as F

from nearfield.streaming import live

KINDS = "stream_id string, s double, tie long, kind string, payload string"


class Feed:
    """A folder that grows by a file each micro-batch, and a sink that reads what there is, again from its checkpoint each time."""

    def __init__(self, spark, path, **named):
        self.spark, self.path, self.named = spark, path, named

    def put(self, rows):
        df = self.spark.createDataFrame(rows, KINDS).select("stream_id", F.timestamp_seconds("s").alias("ts"), "tie", "kind", "payload")
        df.coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        stream = self.spark.readStream.schema("stream_id string, ts timestamp, tie long, kind string, payload string").option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        self.sink = live.Live(f"{self.path}/sink", **self.named)
        self.sink.start(stream, availableNow=True).awaitTermination()
        return sorted(tuple(r) for r in self.sink.out(self.spark).select("stream_id", "seq", "kind", "at_ms").collect())


def test_numbers_go_on_over_batches_and_restarts(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.put([("a", 10.0, 2, "stage.done", "y"), ("a", 10.0, 1, "stage.start", "x"), ("b", 11.0, 3, "rank.done", None), ("b", 12.0, 4, "stage.start", None), (None, 1.0, 9, "stage.start", None)])
    first = [("a", 1, "stage.start", 0), ("a", 2, "stage.done", 0), ("b", 1, "rank.done", 0)]
    assert feed.run() == first
    assert feed.run() == first  # nothing has come
    feed.put([("b", 13.0, 5, "stage.start", None), ("a", 12.5, 6, "rank.tick", None), ("c", 13.0, 7, "error", "e"), ("c", 13.0, 8, "rank.done", None)])
    feed.put([("a", 75.5, 9, "rank.done", None), ("a", 75.5, 10, "rank.tick", None), ("d", 73.5, 10, "stage.start", None)])
    assert feed.run() == sorted([*first, ("a", 3, "rank.tick", 2500), ("a", 4, "rank.done", 65500), ("c", 1, "error", 0), ("d", 1, "stage.start", 0)])
    assert [tuple(r) for r in feed.sink.state(spark, "running").collect()] == [("d", 1, 73500, 2)]
    assert sorted(r["stream_id"] for r in feed.sink.state(spark, "ended").collect()) == ["a", "b", "c"]  # kept, as no time is set
    assert [r["seq"] for r in live.subscribe(spark, feed.sink.folder, "a")] == [1, 2, 3, 4]
    assert [r["kind"] for r in live.subscribe(spark, feed.sink.folder, "d", timeout=0.5)] == ["stage.start"]


def test_ended_streams_are_forgotten(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), retention_ms=3_000)
    feed.put([("a", 1.0, 1, "rank.done", None), ("b", 1.0, 2, "stage.start", None)])
    feed.put([("a", 2.0, 3, "stage.start", None)])
    assert feed.run() == [("a", 1, "rank.done", 0), ("b", 1, "stage.start", 0)]
    time.sleep(3.5)
    feed.put([("a", 90.0, 4, "stage.start", None), ("b", 3.0, 5, "rank.tick", None)])
    assert feed.run() == [("a", 1, "rank.done", 0), ("a", 1, "stage.start", 0), ("b", 1, "stage.start", 0), ("b", 2, "rank.tick", 2000)]
    assert feed.sink.state(spark, "ended").count() == 0 and feed.sink.state(spark, "running").count() == 2


def test_a_batch_that_runs_again_gives_the_same(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    for k in range(3):
        feed.put([("s", float(k * 100 + i), k * 100 + i, "rank.tick", str(i)) for i in range(20)])
    want = feed.run()
    batch = spark.createDataFrame([("s", 1.0, 1, "rank.done", None)], KINDS).select("stream_id", F.timestamp_seconds("s").alias("ts"), "tie", "kind", "payload")
    feed.sink.deal(batch, 1)  # it has been dealt
    assert feed.run() == want and [x[1] for x in want] == list(range(1, 61))
    rows, last = feed.sink.after(spark, "s")
    assert rows.count() == 60
    feed.put([("s", 999.0, 999, "rank.done", None), ("t", 1.0, 1, "error", None)])
    feed.run()
    new, now = feed.sink.after(spark, "s", last)
    assert [r["seq"] for r in new.collect()] == [61] and now > last and all("bucket=" in p for p in new.inputFiles())
    assert feed.sink.after(spark, "s", now) == (None, now)  # no news, no file
    assert [r["seq"] for r in live.subscribe(spark, feed.sink.folder, "s", after=last)] == [61]


def test_processing_goes_on_while_events_come(spark, tmp_path):
    feed = Feed(spark, str(tmp_path))
    feed.put([("s", 1.0, 1, "stage.start", None)])
    stream = spark.readStream.schema("stream_id string, ts timestamp, tie long, kind string, payload string").parquet(f"{feed.path}/in")
    running = live.Live(f"{feed.path}/sink", retention_ms=60_000).start(stream, processingTime="1 second")
    try:
        got = live.subscribe(spark, f"{feed.path}/sink", "s", timeout=120)
        assert next(got)["seq"] == 1
        feed.put([("s", 2.0, 2, "rank.tick", None), ("s", 3.0, 3, "error", "boom")])
        assert [(r["seq"], r["kind"], r["at_ms"]) for r in got] == [(2, "rank.tick", 1000), (3, "error", 2000)]
    finally:
        running.stop()


def test_offsets_by_a_plain_version():
    """Batches of a stream in any order of rows; the state's values as dictionaries."""

    class Value(dict):
        exists = property(lambda self: lambda: "v" in self)
        get = property(lambda self: lambda: self["v"])
        update = property(lambda self: lambda v: self.__setitem__("v", v))
        clear = property(lambda self: lambda: dict.clear(self))

    class Handle:
        def getValueState(self, *_):
            return Value()

    from pyspark.sql import Row

    made = live.Offsets(None)
    made.init(Handle())
    row = lambda b, n, end=None: Row(n=n, first_ms=100 * b, last_ms=100 * b + 50, end=end, batch=b)
    ask = lambda *rows: [tuple(r[c] for c in ("batch", "before", "start_ms", "upto")) for r in made.handleInputRows(("s",), iter(rows), None)]
    assert ask(row(2, 5), row(1, 3)) == [(1, 0, 100, 3), (2, 3, 100, 5)]
    assert ask(row(2, 5)) == []
    assert ask(row(4, 7, 2), row(3, 1), row(5, 9)) == [(3, 8, 100, 1), (4, 9, 100, 2)]
    assert ask(row(6, 1)) == []
