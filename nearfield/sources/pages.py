"""Rows served page by page over HTTP, and the images that they point to."""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterable, Iterator
from http.client import HTTPException
from urllib.error import HTTPError, URLError

import pyarrow as pa
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from nearfield.operators.shared import children, exists, new_folder
from nearfield.sources.ingest import cap

# Rows of a page, seconds before the next page after a failed one, and seconds that a request may take.
PAGE, WAIT, TIMEOUT = 100, 2.0, 30.0
#: Pages that are read side by side before it is seen whether more are needed; how often a stream asks for a page that nobody answers for.
WAVE, TRIES = 32, 3


def _get(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
        return answer.read()


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


def _page(url: str, page: Page, wait: float) -> Iterator[tuple]:
    """The rows of a page; one row that says so if it can't be read or is empty."""
    try:
        body = json.loads(_get(f"{url}{'&' if '?' in url else '?'}offset={page.offset}&length={page.length}"))
        rows = body.get("rows", [])
        if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
            raise ValueError("no rows")
    except (OSError, ValueError, AttributeError, HTTPException) as e:  # no answer, a broken one, or one of another shape
        time.sleep(wait)
        silent = isinstance(e, (URLError, ConnectionError, TimeoutError)) and not isinstance(e, HTTPError)
        yield page.offset, None, None, "silent" if silent else "failed"
        return
    if not rows:
        yield page.offset, None, None, "empty"
    for nth, entry in enumerate(rows):
        row = entry.get("row") or {}
        label = row.get("label")
        whole = isinstance(label, int) and not isinstance(label, bool)
        yield entry.get("row_idx", page.offset + nth), label if whole else None, (row.get("image") or {}).get("src"), "row"


class PagedReader(DataSourceReader):
    """A partition for each page, so pages are read side by side. One that can't be read gives a row that says so, and
    so does an empty one."""

    def __init__(self, options: dict):
        self.url, self.first, self.most = options["url"], int(options.get("first", 0)), int(options["max_rows"])
        self.wait = float(options.get("wait", WAIT))

    def partitions(self) -> list[Page]:
        return [Page(at, min(PAGE, self.most - at)) for at in range(self.first, self.most, PAGE)]

    def read(self, page: Page) -> Iterator[tuple]:
        return ((*row[:3], "failed" if row[3] == "silent" else row[3]) for row in _page(self.url, page, self.wait))


class PagedStream(DataSourceStreamReader):
    """``wave`` pages a micro-batch, up to ``max_rows``. A page that nobody answers for is asked ``tries`` times and ends the query then;
    one that is answered with an error or broken is told, as when read in one go. ``first`` is where the last planned
    micro-batch ended, if there was one."""

    def __init__(self, options: dict):
        self.url, self.at, self.most = options["url"], int(options.get("first", 0)), int(options["max_rows"])
        self.wait, self.tries, self.step = float(options.get("wait", WAIT)), int(options.get("tries", TRIES)), PAGE * int(options.get("wave", WAVE))

    def initialOffset(self) -> dict:
        return {"row": 0}

    def latestOffset(self) -> dict:
        self.at = max(self.at, min(self.most, self.at + self.step))
        return {"row": self.at}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return [Page(at, min(PAGE, end["row"] - at)) for at in range(start["row"], end["row"], PAGE)]

    def read(self, page: Page) -> Iterator[tuple]:
        for _ in range(self.tries):
            rows = list(_page(self.url, page, self.wait))  # PAGE rows
            if rows[0][3] != "silent":
                return iter(rows)
        raise ConnectionError(f"nobody answers for the page at {page.offset}")


class PagedRows(DataSource):
    """Format ``paged_rows``, also as a stream: options ``url`` and ``max_rows``."""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "row_idx bigint, label bigint, src string, state string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def read_pages(spark: SparkSession, url: str, max_rows: int, wait: float = WAIT, states: bool = False) -> DataFrame:
    """row_idx, label, src of the first ``max_rows`` rows. With ``states`` also a row for each page that failed or was empty
    (row_idx: its offset), told by state."""
    pages = _pages(spark, url, 0, max_rows, wait)
    return pages if states else pages.filter("state = 'row'").drop("state")


def _pages(spark: SparkSession, url: str, first: int, last: int, wait: float) -> DataFrame:
    spark.dataSource.register(PagedRows)
    return spark.read.format("paged_rows").option("url", url).option("first", first).option("max_rows", last).option("wait", wait).load()


def walked(spark: SparkSession, url: str, classes: list[str], per_class: int, max_rows: int, wait: float = WAIT, wave: int = WAVE) -> DataFrame:
    """row_idx, label, src of rows with a known label and a source, ``wave`` pages at a time, until every class has
    ``per_class`` of them, a page is empty, or ``max_rows`` are read. Waves lie in the shared folder."""
    folder, at = new_folder(spark, "pages"), 0
    while at < max_rows:
        rows = _pages(spark, url, at, min(max_rows, at + wave * PAGE), wait)
        _named(rows, classes).write.mode("append").parquet(folder)
        at += wave * PAGE
        have = spark.read.parquet(folder)
        counts = {r["label"]: r["count"] for r in have.filter("src <> '' AND label IS NOT NULL").groupBy("label").count().collect()}  # of the classes named
        if all(counts.get(c, 0) >= per_class for c in classes) or not have.filter("state = 'empty'").isEmpty():
            break
    return spark.read.schema("row_idx bigint, label string, src string, state string").parquet(folder).filter("state = 'row' AND src <> '' AND label IS NOT NULL").drop("state") if max_rows > 0 else spark.createDataFrame([], "row_idx bigint, label string, src string")


def _named(rows: DataFrame, classes: list[str]) -> DataFrame:
    return rows.withColumn("label", F.get(F.array(*map(F.lit, classes)), F.when(F.col("label").between(0, len(classes) - 1), F.col("label")).cast("int")))


class _Enough(Exception):
    """Ends a walk before a micro-batch that nobody needs; a later walk that wants more begins with it."""


def walked_on(spark: SparkSession, url: str, folder: str, classes: list[str], per_class: int, max_rows: int, wait: float = WAIT, wave: int = WAVE, tries: int = TRIES) -> DataFrame:
    """As ``walked``, as a stream whose offsets and rows lie in ``folder``: what was read before is not read again.

    A walk that was broken off, or whose server went away (an error here), goes on at the wave where it stopped; one that
    is asked for more rows of a class, or for more rows, goes on where the last one ended. A wave that runs again replaces what it
    wrote, and is read whole once it was planned, whatever ``max_rows`` is then. An empty page ends the walk until the next call. ``classes`` must stay the same for a folder. No rows at
    all are wanted with ``max_rows`` 0.
    """
    spark.dataSource.register(PagedRows)
    out, offsets, layout = f"{folder}/rows", f"{folder}/offsets", "row_idx bigint, label string, src string, state string, batch bigint"
    spark.createDataFrame([], layout).drop("batch").write.mode("ignore").parquet(f"{out}/batch=-1")  # so that there is a folder
    have = spark.read.schema(layout).parquet(out)
    good = "state = 'row' AND src <> '' AND label IS NOT NULL"
    counts = {(r["batch"], r["label"]): r["count"] for r in have.filter(good).groupBy("batch", "label").count().collect()}  # a row for each wave and class
    ended, enough = False, False

    def full() -> bool:
        return ended or all(sum(n for (_, c), n in counts.items() if c == name) >= per_class for name in classes)

    def put(rows: DataFrame, batch: int) -> None:
        nonlocal ended, enough
        if full():
            enough = True
            raise _Enough
        path = f"{out}/batch={batch}"
        _named(rows, classes).write.mode("overwrite").parquet(path)
        mine = spark.read.schema(layout).parquet(path)
        for key in [k for k in counts if k[0] == batch]:
            del counts[key]
        for r in mine.filter(f"{good} OR state = 'empty'").groupBy("label", "state").count().collect():  # of the classes named
            if r["state"] == "empty":
                ended = True
            else:
                counts[batch, r["label"]] = r["count"]

    if max_rows > 0 and not full():
        planned = [int(x) for x in children(spark, f"{offsets}/offsets") if x.isdigit()]
        first = json.loads(spark.read.text(f"{offsets}/offsets/{max(planned)}").tail(1)[0][0])["row"] if planned else 0
        rows = spark.readStream.format("paged_rows").option("url", url).option("first", first).option("max_rows", max_rows).option("wait", wait).option("wave", wave).option("tries", tries).load()
        query = rows.writeStream.foreachBatch(put).option("checkpointLocation", offsets).start()
        try:
            query.processAllAvailable()
        except StreamingQueryException:
            if not enough:
                raise
        finally:
            query.stop()
    return spark.read.schema(layout).parquet(out).filter(good).drop("state", "batch")


def fetched(rows: DataFrame, delay: float = 0.0) -> DataFrame:
    """``rows`` (row_idx, label, src) with content; null where it can't be fetched. A task waits ``delay`` seconds after each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                try:
                    got = _get(one.column("src")[0].as_py())
                except (OSError, ValueError, HTTPException):
                    got = None
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([got], pa.binary())], [*one.schema.names, "content"])
                time.sleep(delay)

    return rows.select("row_idx", "label", "src").mapInArrow(run, "row_idx long, label string, src string, content binary")


def fetch_subset(spark: SparkSession, url: str, out: str, classes: list[str], per_class: int, max_rows: int, delay: float = 0.0, wait: float = WAIT, walk: str | None = None) -> DataFrame:
    """Fetches up to ``per_class`` images of each class into Parquet at ``out``: label, n there now. Stops reading pages when
    it has enough, or at an empty one.

    Rows with unknown labels or no source are left out. Rows that ``out`` has are not fetched again, so a run that
    was broken off goes on; a row that can't be fetched is tried again by the next run. With a folder ``walk`` pages that
    it has are not read again either (``walked_on``).
    """
    rows = walked_on(spark, url, walk, classes, per_class, max_rows, wait) if walk else walked(spark, url, classes, per_class, max_rows, wait)
    todo = cap(rows, "label", "row_idx", per_class)
    if exists(spark, out):
        todo = todo.join(spark.read.parquet(out).select("row_idx"), "row_idx", "left_anti")
    fetched(todo, delay).filter("content IS NOT NULL AND length(content) > 0").drop("src").write.mode("append").parquet(out)
    return spark.read.parquet(out).groupBy("label").agg(F.count("*").alias("n"))
