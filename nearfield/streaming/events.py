"""Event timelines over tables: numbered, sealed at a terminal event, checked. ``live`` does it as events arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.shared import row_numbers

# Kinds of events, and those that end a timeline.
KINDS = ("stage.start", "stage.done", "feature.start", "feature.done", "rank.tick", "rank.done", "error")
TERMINAL = ("rank.done", "error")
STAGES = ("extract", "load_corpus", "cosine", "rank")
RETENTION_MS = 60_000


def new_stream_id() -> Column:
    """A fresh id for each row: 32 hexadecimal digits."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def unknown_kinds(events: DataFrame, kind: str = "kind", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """kind, n of events of no known kind (null counts as none)."""
    return events.filter(~F.coalesce(F.col(kind).isin(*kinds), F.lit(False))).groupBy(F.col(kind).alias("kind")).agg(F.count("*").alias("n"))


def millis(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def numbered(events: DataFrame, stream: str, ts: str, tie: str) -> DataFrame:
    """``events`` with seq from 1 and at_ms since the stream's first event. A stream of any length spreads over sorted ranges."""
    first = events.groupBy(F.col(stream).alias("__nf_stream")).agg(F.min(millis(ts)).alias("__nf_first"))
    rows = row_numbers(events, [stream], [ts, tie]).join(first, F.col(stream).eqNullSafe(F.col("__nf_stream")))
    return rows.withColumn("at_ms", (millis(ts) - F.col("__nf_first")).cast("long")).drop("__nf_stream", "__nf_first")


def sealed(events: DataFrame, stream: str, kind: str = "kind", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Numbered events up to and with each stream's first terminal one."""
    ends = events.filter(F.col(kind).isin(*terminal)).groupBy(F.col(stream).alias("__nf_stream")).agg(F.min("seq").alias("__nf_end"))
    both = events.join(ends, F.col(stream).eqNullSafe(F.col("__nf_stream")), "left")
    return both.filter("__nf_end IS NULL OR seq <= __nf_end").drop("__nf_stream", "__nf_end")


def closed_with_error(events: DataFrame, stream: str, message: str, terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """An error event after the last one of each stream that has no terminal event yet."""
    last = events.groupBy(stream).agg(F.max("seq").alias("seq"), F.max("at_ms").alias("at_ms"), F.max(F.col("kind").isin(*terminal)).alias("done")).filter("NOT done")
    error = last.select(stream, (F.col("seq") + 1).alias("seq"), F.lit("error").alias("kind"), F.to_json(F.struct(F.lit(message).alias("message"))).alias("payload"), "at_ms")
    return events.unionByName(error, allowMissingColumns=True)


def retained(streams: DataFrame, now_ms: int, done_ms: str = "done_ms", most_ms: int = RETENTION_MS) -> DataFrame:
    """Streams of the registry that are not over, or have been over for no more than the retention time."""
    return streams.filter(F.col(done_ms).isNull() | (F.lit(now_ms) - F.col(done_ms) <= most_ms))


def order_check(events: DataFrame, stream: str, name: str, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """stream, complete, in_order, increasing: whether each stage is there, first seen in order, and seq has no gap."""
    firsts = [F.min(F.when(F.col(name) == s, F.col("seq"))).alias(f"s{i}") for i, s in enumerate(stages)]
    each = events.groupBy(stream).agg(*firsts, F.count("*").alias("n"), F.max("seq").alias("top"), F.count_distinct("seq").alias("d"))
    complete = F.lit(True)
    ordered = F.lit(True)
    for i in range(len(stages)):
        complete = complete & F.col(f"s{i}").isNotNull()
        if i:
            ordered = ordered & F.coalesce(F.col(f"s{i - 1}") < F.col(f"s{i}"), F.lit(False))
    return each.select(stream, complete.alias("complete"), ordered.alias("in_order"), ((F.col("n") == F.col("top")) & (F.col("d") == F.col("n"))).alias("increasing"))


def features_done(events: DataFrame, stream: str, feature: Column, features: list, done: Column | None = None) -> DataFrame:
    """stream, n_features, complete: whether each of ``features`` has an event (a ``done`` one, if given)."""
    named = F.when(feature.isin(*features) & (F.lit(True) if done is None else done), feature)
    each = events.groupBy(stream).agg(F.count_distinct(named).alias("n_features"))
    return each.withColumn("complete", F.col("n_features") == len(features))
