"""Event timelines as Structured Streaming: numbered and sealed as events arrive, with keyed state that expires; subscriptions."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from nearfield.operators.shared import children, exists, removed, row_numbers, written
from nearfield.streaming.events import TERMINAL, millis

#: Folders into which each micro-batch's events are dealt by their stream.
BUCKETS = 16
#: The state store that keeps state on disk and drops values that have expired.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

SUMS = "stream_id string, n long, first_ms long, last_ms long, end long, batch long"
OFFSETS = "stream_id string, batch long, before long, start_ms long, upto long"


class Offsets(StatefulProcessor):
    """For each stream and micro-batch of it: how many events lie before, when the stream began, how many of the batch's count.

    A running stream has a value (its events so far, its start, its last batch); one that has ended has another, which
    expires, so that the store holds no stream for longer. What comes for an ended one is left out, as is a batch that comes again.
    """

    def __init__(self, retention_ms: int | None):
        self.retention_ms = retention_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.running = handle.getValueState("running", "seq long, start_ms long, batch long")
        self.ended = handle.getValueState("ended", "done_ms long", self.retention_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        if self.ended.exists():
            return
        seq, start, last = self.running.get() if self.running.exists() else (0, None, -1)
        for r in sorted(rows, key=lambda r: r.batch):  # one for each batch
            if r.batch <= last:
                continue
            start = r.first_ms if start is None else start
            yield Row(stream_id=key[0], batch=r.batch, before=seq, start_ms=start, upto=r.n if r.end is None else r.end)
            seq, last = seq + r.n, r.batch
            if r.end is not None:
                self.ended.update((r.last_ms,))
                self.running.clear()
                return
        self.running.update((seq, start, last))

    def close(self) -> None:
        pass


@dataclass
class Running:
    """The two queries of a ``Live``: one deals events, the other numbers them."""

    spark: SparkSession
    live: Live
    dealing: StreamingQuery
    numbering: StreamingQuery | None
    trigger: dict

    def awaitTermination(self) -> None:
        self.dealing.awaitTermination()
        if self.numbering is None:  # what there was has been dealt
            self.numbering = self.live._number(self.spark, self.trigger)
        self.numbering.awaitTermination()

    def stop(self) -> None:
        for q in (self.dealing, self.numbering):
            if q is not None:
                q.stop()


@dataclass
class Live:
    """A stream of (stream_id, ts, tie, kind, payload), numbered and sealed as it arrives.

    ``folder``/out/batch=n gets stream_id, seq, kind, payload, at_ms. Within a micro-batch events are in order of ts and tie, over
    micro-batches in that of arrival. A sealed stream's later events are left out, as are events without a stream id.

    A first query deals each micro-batch: a stream's events get their places in it by sorted ranges, so that a long
    stream is no single task, and lie in ``folder``/dealt; ``folder``/sums gets one row for each stream. A second
    query reads these rows into keyed state on disk (``Offsets``), which knows how many events a stream had before, and joins what
    it says to the dealt events. State costs a row for each stream of a micro-batch, whatever streams there were before.

    ``retention_ms`` after it ended a stream is forgotten (by the clock, as state expires); its id must not come again.
    Without it ended streams are known for ever. Both queries go on where they stopped; a micro-batch that runs again
    after a failure gives the same rows.
    """

    folder: str
    terminal: tuple[str, ...] = TERMINAL
    retention_ms: int | None = None
    buckets: int = field(default=BUCKETS)

    def deal(self, events: DataFrame, batch: int) -> None:
        """Places a micro-batch's events; one that has been dealt is left as it is."""
        spark, sums = events.sparkSession, f"{self.folder}/sums/batch={batch}"
        if exists(spark, f"{sums}/_SUCCESS"):
            return
        place = F.struct("ts", "tie")
        known = events.filter("stream_id IS NOT NULL")
        ends = known.filter(F.col("kind").isin(*self.terminal)).groupBy("stream_id").agg(F.min(place).alias("end"))
        # An end counts with all that lies before it; what has the same place as the end is told from it by its number.
        upto = known.join(ends, "stream_id", "left").filter(F.col("end").isNull() | (place <= F.col("end"))).drop("end")
        rows = row_numbers(upto, ["stream_id"], ["ts", "tie"], "nth").select("stream_id", "nth", "kind", "payload", millis("ts").alias("ms"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/dealt/batch={batch}")
        dealt = spark.read.parquet(f"{self.folder}/dealt/batch={batch}")
        last = F.when(F.col("kind").isin(*self.terminal), F.col("nth"))
        each = dealt.groupBy("stream_id").agg(F.count("*").alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms"), F.min(last).alias("end"))
        each.write.mode("overwrite").parquet(sums)

    def number(self, offsets: DataFrame, batch: int) -> None:
        """Numbers the dealt events that ``offsets`` are of."""
        spark = offsets.sparkSession
        found = written(offsets)
        batches = sorted(r["batch"] for r in found.select("batch").distinct().collect())  # micro-batches since the last time
        dealt = [spark.read.parquet(f"{self.folder}/dealt/batch={b}").withColumn("batch", F.lit(b).cast("long")) for b in batches]
        if not dealt:
            return
        rows = dealt[0]
        for more in dealt[1:]:
            rows = rows.unionByName(more)
        rows = rows.join(found, ["stream_id", "batch"]).filter("nth <= upto")
        bucket = F.pmod(F.xxhash64("stream_id"), F.lit(self.buckets)).cast("int")
        made = rows.select("stream_id", (F.col("before") + F.col("nth")).alias("seq"), "kind", "payload", (F.col("ms") - F.col("start_ms")).alias("at_ms"), bucket.alias("bucket"))
        made.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/out/batch={batch}")
        for name in children(spark, f"{self.folder}/dealt"):  # those of earlier batches, which are done with
            if int(name.removeprefix("batch=")) < batches[0]:
                removed(spark, f"{self.folder}/dealt/{name}")

    def start(self, events: DataFrame, **trigger: object) -> Running:
        """Starts both queries; ``trigger`` as ``DataStreamWriter.trigger`` takes it."""
        spark = events.sparkSession
        dealing = events.writeStream.foreachBatch(self.deal).option("checkpointLocation", f"{self.folder}/offsets/deal").trigger(**trigger).start()
        if trigger.get("availableNow") or trigger.get("once"):
            return Running(spark, self, dealing, None, trigger)
        return Running(spark, self, dealing, self._number(spark, trigger), trigger)

    def _number(self, spark: SparkSession, trigger: dict) -> StreamingQuery:
        # State that may expire asks for micro-batches without data, which would never end when only what is there is read.
        mode = "None" if self.retention_ms is None else "ProcessingTime"
        needed = dict([STORE]) | ({"spark.sql.streaming.noDataMicroBatches.enabled": "false"} if "processingTime" not in trigger else {})
        before = {k: spark.conf.get(k, None) for k in needed}
        for k, v in needed.items():
            spark.conf.set(k, v)
        try:
            spark.createDataFrame([], SUMS).drop("batch").write.mode("ignore").parquet(f"{self.folder}/sums/batch=-1")  # so that there is a folder
            sums = spark.readStream.schema(SUMS).option("maxFilesPerTrigger", 10_000).parquet(f"{self.folder}/sums")
            offsets = sums.groupBy("stream_id").transformWithState(Offsets(self.retention_ms), OFFSETS, "Append", mode)
            return offsets.writeStream.foreachBatch(self.number).option("checkpointLocation", f"{self.folder}/offsets/number").trigger(**trigger).start()
        finally:
            for k, v in before.items():
                spark.conf.set(k, v) if v is not None else spark.conf.unset(k)

    def out(self, spark: SparkSession) -> DataFrame:
        return spark.read.option("recursiveFileLookup", False).parquet(f"{self.folder}/out").drop("batch", "bucket")

    def state(self, spark: SparkSession, name: str) -> DataFrame:
        """stream_id and the value of each stream that the state ``running`` or ``ended`` holds."""
        rows = spark.read.format("statestore").option("stateVarName", name).load(f"{self.folder}/offsets/number")
        value = F.col("value.value") if "value" in rows.schema["value"].dataType.fieldNames() else F.col("value")  # beside its expiry
        return rows.select("key.stream_id", value.alias("value")).select("stream_id", "value.*")

    def after(self, spark: SparkSession, stream_id: str, batch: int = -1) -> tuple[DataFrame | None, int]:
        """A stream's events in micro-batches after ``batch``, and the last one that there is. Without new ones no file is read;
        of those that there are only the folders of the stream's bucket are."""
        names = {int(x.removeprefix("batch=")) for x in children(spark, f"{self.folder}/out") if x.startswith("batch=")}
        new = sorted(b for b in names if b > batch and exists(spark, f"{self.folder}/out/batch={b}/_SUCCESS"))
        bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(stream_id)), F.lit(self.buckets)).alias("b")).first()["b"] if new else 0
        paths = [p for p in (f"{self.folder}/out/batch={b}/bucket={bucket}" for b in new) if exists(spark, p)]
        rows = spark.read.schema("stream_id string, seq long, kind string, payload string, at_ms long").parquet(*paths).filter(F.col("stream_id") == stream_id) if paths else None
        return rows, max(new, default=batch)


def subscribe(spark: SparkSession, folder: str, stream_id: str, terminal: tuple[str, ...] = TERMINAL, wait: float = 0.2, timeout: float = 60.0, after: int = -1) -> Iterator[Row]:
    """One stream's events from the sink of ``Live``: its history in order, then what arrives, up to its terminal event.

    ``after`` is the last micro-batch of the sink that is not wanted. Ends early after ``timeout`` seconds without anything new.
    Only this stream's rows reach the driver.
    """
    live, quiet = Live(folder), time.monotonic()
    while time.monotonic() - quiet < timeout:
        rows, after = live.after(spark, stream_id, after)
        for row in rows.orderBy("seq").toLocalIterator() if rows is not None else ():
            quiet = time.monotonic()
            yield row
            if row["kind"] in terminal:
                return
        time.sleep(wait)
