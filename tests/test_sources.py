"""Folder trees and paged rows, taken in whole."""

import hashlib
import json
import struct
import threading
import zlib
from datetime import timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.schema import DIMS
from nearfield.operators import plots
from nearfield.operators.extract import extract, preprocess_stages
from nearfield.sources import blobs, ingest, pages
from nearfield.sources.blobs import BlobWriter, register


def png(shade: int, side: int = 16) -> bytes:
    y, x = np.mgrid[:side, :side]
    rgb = np.stack([x * shade, y * 7, x + y + shade], -1).astype(np.uint8)
    raw = b"".join(b"\0" + row.tobytes() for row in rgb)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "set"
    for label, shades in (("cat", (1, 2, 3)), ("dog", (4, 4)), (".hidden", (5,))):
        (root / label).mkdir(parents=True)
        for i, s in enumerate(shades):
            (root / label / f"img {i:03d}+.png").write_bytes(png(s))
    (root / "dog" / "img_009.png").write_bytes(b"no image")
    (root / "dog" / "notes.txt").write_text("skip")
    return str(root)


def counts(df):
    return {(r["label"], r["status"]): r["n"] for r in df.collect()}


def test_seed(spark, tree, tmp_path):
    out = str(tmp_path / "images")
    assert {r["label"]: (r["files_seen"], r["inserted"]) for r in ingest.seed(spark, tree, out, dry_run=True).collect()} == {"cat": (3, 0), "dog": (3, 0)}
    assert counts(ingest.seed(spark, tree, out, per_class=2)) == {("cat", "inserted"): 2, ("dog", "inserted"): 1, ("dog", "deduped"): 1}
    assert counts(ingest.seed(spark, tree, out)) == {("cat", "inserted"): 1, ("cat", "deduped"): 2, ("dog", "deduped"): 2, ("dog", "failed"): 1}
    stored = spark.read.parquet(out)
    assert stored.count() == 4 and stored.filter("width = 16 AND startswith(storage_path, 'originals/')").count() == 4


def test_files_rows_and_features_are_taken_in(spark, tree, tmp_path, capsys):
    out, features, files = (str(tmp_path / x) for x in ("images", "features", "blobs"))
    first = ingest.take_in(spark, tree, out, per_class=2)  # neither files nor features
    assert (first.files_seen, first.inserted, first.deduped, first.failed, first.extracted, first.code) == (4, 3, 1, 0, 0, 0)
    got = ingest.take_in(spark, tree, out, features=features, blobs=files)
    assert (got.files_seen, got.inserted, got.deduped, got.failed, got.extracted, got.code) == (6, 1, 4, 1, 4, 1)
    assert {s: sum(r["n"] for r in got.counts.collect() if r["status"] == s) for s in ("inserted", "deduped", "failed")} == {"inserted": 1, "deduped": 4, "failed": 1}
    images, vectors = spark.read.parquet(out), spark.read.parquet(features)
    assert sorted(r["id"] for r in images.collect()) == sorted(r["image_id"] for r in vectors.collect()) == [1, 2, 3, 4]
    assert all(len(vectors.first()[f]) == n for f, n in DIMS.items())
    new = images.filter("id = 4").first()
    assert hashlib.sha256((tmp_path / "blobs" / new["storage_path"]).read_bytes()).hexdigest() == new["sha256"]
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()}
    again = ingest.take_in(spark, tree, out, features=features, blobs=files)
    assert (again.inserted, again.deduped, again.failed, again.extracted) == (0, 5, 1, 0)
    assert {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*") if p.is_file()} == before
    assert ingest.main(["--source", tree, "--out", out, "--dry-run"]) == 0 and "files_seen" in capsys.readouterr().out
    assert ingest.main(["--source", tree, "--out", out]) == 1
    assert ingest.main(["--source", str(tmp_path / "none"), "--out", out]) == 2


def test_files_are_written_all_or_none(spark, tmp_path):
    register(spark)
    root = str(tmp_path / "tree")
    kind = "storage_path string, content binary, other int"
    rows = spark.createDataFrame([(f"originals/c{i % 3}/{i}.jpg", bytearray(f"data {i}".encode()), i) for i in range(40)] + [("originals/empty.bin", None, 40)], kind).repartition(4)
    files = lambda: {str(p.relative_to(root)): p.read_bytes() for p in (tmp_path / "tree").glob("[!.]*/**/*") if p.is_file()}
    with pytest.raises(Exception, match="stop"):
        rows.withColumn("content", F.when(F.col("other") == 33, F.raise_error(F.lit("stop"))).otherwise(F.col("content"))).write.format("blobs").mode("append").save(root)
    assert not files()
    for _ in range(2):
        rows.write.format("blobs").mode("append").save(root)
        assert files() == {f"originals/c{i % 3}/{i}.jpg": f"data {i}".encode() for i in range(40)} | {"originals/empty.bin": b""}
    for bad in ("../x", "/x", "a/../../x"):
        with pytest.raises(Exception, match="not a path inside"):
            spark.createDataFrame([(bad, bytearray(b"y"), 1)], kind).write.format("blobs").mode("append").save(root)
    with pytest.raises(Exception, match="append"):
        rows.write.format("blobs").mode("overwrite").save(root)
    named = rows.limit(1).selectExpr("'a/b.bin' AS place", "content AS data")
    named.write.format("blobs").mode("append").option("name", "place").option("content", "data").save(root)
    assert "a/b.bin" in files() and len(files()) == 42


def test_a_task_that_ran_twice_leaves_one_file(tmp_path, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(blobs, "STALE", timedelta(0))
    (tmp_path / ".staged-old").mkdir()  # of a job that was stopped
    writer = BlobWriter(str(tmp_path), 0, 1)
    batch = pa.RecordBatch.from_pydict({"p": ["a/x", "a/y"], "c": [b"1", b"2"]})
    messages = [writer.write(iter([batch])) for _ in range(2)]
    writer.commit([messages[1], None])
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["a/x", "a/y"] and not list(tmp_path.glob(".staged*"))


def test_stages_and_kept_plots(spark, tree, tmp_path):
    images = spark.read.format("image").load(f"{tree}/cat").selectExpr("crc32(image.origin) AS id", "image")
    panel = preprocess_stages(images).orderBy("id", "nth").collect()
    assert [r["stage"] for r in panel[:4]] == ["original", "resized", "blurred", "equalised"] and panel[0]["height"] == 16 and len(panel[3]["data"]) == 128 * 128 * 3
    found = extract(images).cache()
    assert all(len(found.first()[f]) == n for f, n in DIMS.items())
    one = found.orderBy("id").limit(1)
    for feature, n in (("cm", 9), ("glcm", 40), ("hog", 256)):
        assert plots.kept(spark, str(tmp_path), one, "id", feature).count() == n
        assert plots.kept(spark, str(tmp_path), found, "id", feature).count() == 3 * n
        assert plots.kept(spark, str(tmp_path), found, "id", feature).count() == 3 * n
    with pytest.raises(KeyError):
        plots.kept(spark, str(tmp_path), found, "id", "none")


def test_paged_rows(spark, tmp_path):
    broken, asked = {100}, []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            at = urlparse(self.path)
            asked.append(self.path)
            if at.path == "/rows":
                offset = int(parse_qs(at.query)["offset"][0])
                host = f"http://127.0.0.1:{self.server.server_port}"
                rows = [{"row_idx": i, "row": {"label": i % 4 if i % 4 < 3 else "x", "image": {"src": f"{host}/image/{i}"}}} for i in range(offset, min(offset + 100, 250))]
                body = json.dumps({"rows": rows}).encode()
                code = 500 if offset in broken else 200
            else:
                code, body = (404, b"") if at.path == "/image/4" else (200, at.path.encode())
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url, out = f"http://127.0.0.1:{server.server_port}/rows", str(tmp_path / "got")
        rows = pages.read_pages(spark, url, 400, wait=0)
        assert rows.count() == 150 and rows.filter("label IS NULL").count() == 37
        first = {r["label"]: r["n"] for r in pages.fetch_subset(spark, url, out, ["a", "b"], 30, 400, wait=0).collect()}
        assert first == {"a": 29, "b": 30}
        asked.clear()
        broken.clear()
        again = {r["label"]: r["n"] for r in pages.fetch_subset(spark, url, out, ["a", "b"], 40, 400, wait=0).collect()}
        assert again["b"] >= 40 and not any(x == "/image/1" for x in asked)
    finally:
        server.shutdown()


def test_broken_pages_are_told_and_end_nothing(spark):
    bodies = {0: json.dumps({"rows": [{"row_idx": 0, "row": {"label": 1, "image": {"src": "x"}}}]}).encode(), 100: b"<html>", 200: b"[1]", 300: b'{"rows": [', 400: b'{"rows": 3}', 500: b"{}"}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            body = bodies[int(parse_qs(urlparse(self.path).query)["offset"][0])]
            self.send_response(200)
            self.send_header("Content-Length", str(len(body) + (500 if body.endswith(b"[") else 0)))  # one breaks off
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/rows"
        assert {(r["row_idx"], r["state"]) for r in pages.read_pages(spark, url, 600, wait=0, states=True).collect()} == {(0, "row"), (100, "failed"), (200, "failed"), (300, "failed"), (400, "failed"), (500, "empty")}
        assert [tuple(r) for r in pages.read_pages(spark, url, 600, wait=0).collect()] == [(0, 1, "x")]
    finally:
        server.shutdown()
