"""Feature extraction over decoded images, one pass for all features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.kernels import EXTRACTORS, preprocess, stages
from nearfield.functions.schema import EXTRACTOR_VERSION


#: Bytes of images and of their vectors that a task keeps at most, so that equal images are worked out once.
KEPT_BYTES = 64 << 20


def decode(height: int, width: int, data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def extract(images: DataFrame, id_col: str = "id", image: str = "image", names: tuple[str, ...] = tuple(EXTRACTORS), prepared: bool = False) -> DataFrame:
    """id, extractor_ver and unit vectors (the six features unless ``names`` are given) of each image struct, as Spark's
    image source gives it; preprocessed first unless the images are ``prepared``.

    Images that a task has met before, byte for byte, take the vectors that it keeps (``KEPT_BYTES``) instead of new ones.
    """
    rows = images.select(F.col(id_col).cast("long").alias("id"), *[F.col(f"{image}.{c}").alias(c) for c in ("height", "width", "data")])
    kinds = pa.schema([("id", pa.int64()), ("extractor_ver", pa.string()), *[(f, pa.list_(pa.float32())) for f in names]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out: dict[str, list] = {c: [] for c in kinds.names}
                for r in batch.slice(at, 64).to_pylist():
                    key = (r["height"], r["width"], r["data"])
                    if key not in kept:
                        img = decode(*key)
                        img = img if prepared else preprocess(img)
                        found = [EXTRACTORS[f](img) for f in names]
                        size = len(r["data"]) + sum(v.nbytes for v in found)
                        if held + size > KEPT_BYTES:
                            kept, held = {}, 0
                        kept[key], held = found, held + size
                    out["id"].append(r["id"])
                    out["extractor_ver"].append(EXTRACTOR_VERSION)
                    for f, v in zip(names, kept[key], strict=True):
                        out[f].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return rows.mapInArrow(run, "id long, extractor_ver string, " + ", ".join(f"{f} array<float>" for f in names))


def preprocess_stages(images: DataFrame, id_col: str = "id", image: str = "image") -> DataFrame:
    """id, nth, stage, height, width, data: each image before and after every preprocessing step, for a panel of plots."""
    rows = images.select(F.col(id_col).cast("long").alias("id"), *[F.col(f"{image}.{c}").alias(c) for c in ("height", "width", "data")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                found = stages(decode(r["height"], r["width"], r["data"]))
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([r["id"]] * len(found), pa.int64()), "nth": pa.array(range(len(found)), pa.int32()), "stage": list(found),
                    "height": pa.array([x.shape[0] for x in found.values()], pa.int32()), "width": pa.array([x.shape[1] for x in found.values()], pa.int32()),
                    "data": pa.array([x.tobytes() for x in found.values()], pa.binary()),
                })

    return rows.mapInArrow(run, "id long, nth int, stage string, height int, width int, data binary")
