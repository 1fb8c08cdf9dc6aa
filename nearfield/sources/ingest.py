"""Ingestion: scans, caps, validation, content-addressed dedupe, status counts, writes."""

from __future__ import annotations

import argparse
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.functions.schema import FEATURE_SETS, FEATURES, MAX_UPLOAD_BYTES
from nearfield.functions.storage import EXTENSIONS, content_hash, is_inside, safe_extension, slug, storage_path
from nearfield.operators.extract import extract
from nearfield.operators.shared import exists, row_numbers, written
from nearfield.sources.blobs import register


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, label, size_bytes, content of every file with a known extension under the root's visible folders; the
    first folder below the root is the label."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inner = F.regexp_extract("path", r"^.*?" + _quoted(root.rstrip("/").split("/")[-1]) + r"/([^/]+)/.+$", 1)
    known = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*EXTENSIONS)
    return files.filter(known).select("path", inner.alias("label"), F.col("length").alias("size_bytes"), "content").filter("label <> '' AND NOT startswith(label, '.')")


def _quoted(s: str) -> str:
    return "".join(c if c.isalnum() or c in "_" else f"\\{c}" for c in s)


def read_shards(spark: SparkSession, paths: list[str], classes: list[str], per_class: int | None = None, image: str = "image.bytes", label: str = "label") -> DataFrame:
    """row, label, content of labelled Parquet shards, read in the order of ``paths``.

    Labels are indices into ``classes``; others and empty payloads are left out. ``row`` counts all rows of all shards
    from 1, also those left out. Each class gives its first ``per_class`` rows; only the image and label columns are read.
    """
    rows = spark.read.parquet(*paths).select(F.col(image).cast("binary").alias("content"), F.col(label).alias("k"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("nth"))
    place = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # file paths come as encoded URLs
    places = [F.when(F.endswith(place, F.lit(_tail(p))) | F.contains(place, F.lit(_tail(p) + "/")), i) for i, p in enumerate(paths)]
    rows = rows.withColumn("shard", F.coalesce(*places, F.lit(len(paths))))
    # One row for each file; a path may be a folder of files, which count by name.
    files = rows.groupBy("shard", "path").agg(F.count("*").alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("shard", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = files.select("path", start.alias("start"))
    good = rows.filter(F.col("k").between(0, len(classes) - 1) & (F.length("content") > 0)).join(F.broadcast(files), "path")  # a row for each file
    named = good.select((F.col("start") + F.col("nth") + 1).alias("row"), F.get(F.array(*map(F.lit, classes)), F.col("k").cast("int")).alias("label"), "content")
    return cap(named, "label", "row", per_class) if per_class else named


def _tail(path: str) -> str:
    """A path without its scheme, as the end of a file's or the start of its folder's."""
    return "/" + re.sub("^[A-Za-z0-9]+:/*", "", path).strip("/").removeprefix("./")


def cap(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first ``most`` rows of each ``by`` in ``order``, before anything is decoded."""
    return df.withColumn("__nf_nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).filter(F.col("__nf_nth") <= most).drop("__nf_nth")


def reject_reason(content: Column, label: Column, decodes: Column | None = None, most: int = MAX_UPLOAD_BYTES) -> Column:
    """Why a row can't be taken in: empty, too_large, bad_label or undecodable; null for a good one."""
    n = F.coalesce(F.length(content), F.lit(0))
    why = F.when(n == 0, "empty").when(n > most, "too_large").when(label.isNull() | ~F.length(label).between(1, 64) | slug(label).isNull(), "bad_label")
    return why.when(~F.coalesce(decodes, F.lit(False)), "undecodable") if decodes is not None else why


def validated(df: DataFrame, content: str, label: str, most: int = MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The rows that can be taken in, and the others with their reason."""
    marked = df.withColumn("reason", reject_reason(F.col(content), F.col(label), most=most))
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def addressed(df: DataFrame, content: str, label: str, name: str) -> DataFrame:
    """``df`` with sha256 and storage_path."""
    sha = content_hash(F.col(content))
    return df.withColumn("sha256", sha).withColumn("storage_path", storage_path(F.col(label), F.col("sha256"), F.col(name)))


def first_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each ``key``, the first by ``order``: aggregated before the shuffle, so a key with very many rows is no load."""
    row = F.struct(*df.columns)
    return df.groupBy(F.col(key).alias("__nf_key")).agg(F.min_by(row, order).alias("r")).select("r.*")


def against_store(batch: DataFrame, store: DataFrame, key: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """The batch's rows that are new to the store, and those it has."""
    known = store.select(key)
    return batch.join(known, key, "left_anti"), batch.join(known, key, "left_semi")


def to_extract(batch: DataFrame, images: DataFrame, features: DataFrame, key: str = "sha256", id_col: str = "id", image_id: str = "image_id") -> DataFrame:
    """``batch`` with id (of the stored item, null for a new one) and state: new, lacking (stored without features) or done.

    New and lacking ones need extraction; a lacking one keeps its id.
    """
    stored = images.select(key, F.col(id_col).alias("id")).join(features.select(F.col(image_id).alias("id"), F.lit(True).alias("__nf_has")), "id", "left")
    state = F.when(F.col("id").isNull(), "new").when(F.col("__nf_has"), "done").otherwise("lacking")
    return batch.join(stored.groupBy(key).agg(F.min("id").alias("id"), F.max("__nf_has").alias("__nf_has")), key, "left").withColumn("state", state).drop("__nf_has")


def write_blobs(df: DataFrame, root: str, path: str = "storage_path", content: str = "content") -> DataFrame:
    """Writes each row's content below ``root`` at its path: path, written (false where a file of that size is there).

    A file is written beside its place and then moved, so a task that runs again or dies leaves no part of one. Paths
    that lead out of ``root`` are errors.
    """
    rows = df.select(F.when(is_inside(F.col(path)), F.col(path)).otherwise(F.raise_error(F.concat(F.lit("not a path inside: "), F.col(path)))).alias("path"), F.col(content).alias("content"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
        for batch in batches:
            done = []
            for at in range(batch.num_rows):
                name, data = batch.column("path")[at].as_py(), batch.column("content")[at].as_py() or b""
                target = f"{base}/{name}"
                there = fs.get_file_info(target)
                done.append(not (there.type == pafs.FileType.File and there.size == len(data)))
                if done[-1]:
                    fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    with fs.open_output_stream(part) as f:
                        f.write(data)
                    fs.move(part, target)
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "written": pa.array(done, pa.bool_())})

    return rows.mapInArrow(run, "path string, written boolean")


def statuses(df: DataFrame, key: str, order: str, reason: str) -> DataFrame:
    """``df`` with status: failed, inserted (first of its key) or deduped."""
    first = df.filter(F.col(reason).isNull()).groupBy(key).agg(F.min(order).alias("__nf_first"))
    both = df.join(first, key, "left")
    status = F.when(F.col(reason).isNotNull(), "failed").when(F.col(order) == F.col("__nf_first"), "inserted").otherwise("deduped")
    return both.withColumn("status", status).drop("__nf_first")


@dataclass
class Seeded:
    """What an ingest did: label, status, n as rows; totals as they were counted while rows passed; images whose features were made."""

    counts: DataFrame
    files_seen: int
    inserted: int
    deduped: int
    failed: int
    extracted: int

    @property
    def code(self) -> int:
        """0 if no file failed, else 1."""
        return int(self.failed > 0)


def seed(spark: SparkSession, root: str, out: str, per_class: int | None = None, dry_run: bool = False) -> DataFrame:
    """Takes a folder tree in: label, status, n. New images go to ``out`` as Parquet with ids that go on from the last one,
    unless it is a dry run."""
    return take_in(spark, root, out, per_class, dry_run).counts


def take_in(spark: SparkSession, root: str, out: str, per_class: int | None = None, dry_run: bool = False, features: str | None = None, blobs: str | None = None) -> Seeded:
    """Takes a folder tree in: files to ``blobs`` at their storage paths, images to ``out``, vectors to ``features``; what
    has no path given is left out. A tree that is not there is a FileNotFoundError.

    What is taken is decided on paths, hashes and sizes; bytes are read again for the new images only, and not shuffled
    as long as their list is small. One bad file fails alone. Files come first, then rows, then vectors, so that what
    a broken run leaves undone is done by the next: images without features get them whenever their files come again.
    A run that finds nothing new changes nothing. Totals are observed in the pass that writes the decisions.
    """
    if not exists(spark, root):
        raise FileNotFoundError(root)
    files = scan_tree(spark, root)
    if dry_run:
        files = cap(files.select("label", "path"), "label", "path", per_class) if per_class else files
        counts = files.groupBy("label").agg(F.count("*").alias("files_seen"), F.lit(0).cast("long").alias("inserted"))
        counts = spark.createDataFrame(counts.collect(), counts.schema)  # a row for each label
        return Seeded(counts, counts.agg(F.coalesce(F.sum("files_seen"), F.lit(0))).first()[0], 0, 0, 0, 0)
    slim = files.select("path", "label", "size_bytes", content_hash(F.col("content")).alias("sha256"), reject_reason(F.col("content"), F.col("label")).alias("reason"))
    slim = cap(slim, "label", "path", per_class) if per_class else slim
    decoded = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root)
    # The image source writes an origin as an encoded URL, binaryFile a path as it is.
    place = _place(F.url_decode(F.replace(F.col("image.origin"), F.lit("+"), F.lit("%2B"))))
    sizes = decoded.select(place.alias("place"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    rows = slim.withColumn("place", _place(F.col("path"))).join(sizes, "place", "left")
    rows = rows.withColumn("filename", F.regexp_extract("path", "([^/]+)$", 1)).withColumn("storage_path", storage_path(F.col("label"), F.col("sha256"), F.col("filename")))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(~F.coalesce(F.col("width") > 0, F.lit(False)), "undecodable")))
    rows, last = statuses(rows, "sha256", "path", "reason"), 0
    if exists(spark, out):
        store = spark.read.parquet(out)
        known = store.select("sha256").distinct().withColumn("__nf_known", F.lit(True))
        rows = rows.join(known, "sha256", "left").withColumn("status", F.when(F.col("__nf_known") & (F.col("status") == "inserted"), "deduped").otherwise(F.col("status"))).drop("__nf_known")
        last = store.agg(F.max("id")).first()[0] or 0
    seen = Observation()
    rows = written(rows.observe(seen, F.count("*").alias("files_seen"), *[F.count_if(F.col("status") == s).alias(s) for s in ("inserted", "deduped", "failed")]))
    counts = rows.groupBy("label", "status").agg(F.count("*").alias("n"))
    result = Seeded(spark.createDataFrame(counts.collect(), counts.schema), **seen.get, extracted=0)  # a row for each label and status
    if result.inserted:
        new = numbered(rows.filter("status = 'inserted'"), "path", last)
        if blobs:
            register(spark)
            new.join(files.select("path", "content"), "path").select("storage_path", "content").write.format("blobs").mode("append").save(blobs)
        new.select(
            "id", "sha256", "filename", "storage_path", F.col("label").alias("animal_type"), "width", "height", F.col("size_bytes").cast("int").alias("size_bytes"), F.lit("corpus").alias("role"), F.current_timestamp().alias("uploaded_at")
        ).write.mode("append").parquet(out)
    if features and exists(spark, out):
        have = spark.read.parquet(features) if exists(spark, features) else spark.createDataFrame([], FEATURE_SETS)
        first = rows.filter("status <> 'failed'").groupBy("sha256").agg(F.min("place").alias("place"))
        lacking = written(to_extract(first, spark.read.parquet(out), have).filter("state = 'lacking'").select("id", "place"))
        if not lacking.isEmpty():
            made, done = extract(decoded.withColumn("place", place).join(lacking, "place").select("id", "image")), Observation()
            made.withColumnRenamed("id", "image_id").observe(done, F.count("*").alias("n")).write.mode("append").parquet(features)
            result.extracted = done.get["n"]
    return result


def main(argv: list[str] | None = None) -> int:
    """``python -m nearfield.sources.ingest --source TREE --out TABLE``: 0, 1 if files failed, 2 if there is no such tree."""
    p = argparse.ArgumentParser(description="Take a tree of labelled images in.")
    for name in ("source", "out"):
        p.add_argument(f"--{name}", required=True)
    for name in ("features", "blobs"):
        p.add_argument(f"--{name}")
    p.add_argument("--max-per-class", type=int)
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    try:
        got = take_in(SparkSession.builder.getOrCreate(), a.source, a.out, a.max_per_class, a.dry_run, a.features, a.blobs)
    except FileNotFoundError as e:
        print(f"no such tree: {e}")
        return 2
    got.counts.show(10_000, False)
    return got.code


def _place(path: Column) -> Column:
    return F.regexp_replace(path, "^([A-Za-z0-9]+:)/+", "$1/")


def backfilled(rows: DataFrame, vectors: str = "vectors") -> DataFrame:
    """Feature columns filled from a JSON map of vectors where they are null."""
    found = F.from_json(vectors, "map<string,array<double>>")
    return rows.withColumns({f: F.coalesce(F.col(f).cast("array<double>") if f in rows.columns else F.lit(None).cast("array<double>"), F.element_at(found, f)) for f in FEATURES})


def numbered(df: DataFrame, order: str, start: int = 0) -> DataFrame:
    """Dense ids from ``start`` + 1 in ``order``, by sorted ranges: no single task sees all rows."""
    return row_numbers(df, [], [order], "id").withColumn("id", F.col("id") + start)


__all__ = ["EXTENSIONS", "addressed", "against_store", "backfilled", "cap", "first_of_each", "numbered", "read_shards", "reject_reason", "safe_extension", "scan_tree", "seed", "statuses", "take_in", "to_extract", "validated", "write_blobs"]

if __name__ == "__main__":
    raise SystemExit(main())
