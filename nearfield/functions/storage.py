"""Content-addressed names: slugs, extensions, paths, media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that are kept, and media types by extension.
EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff")
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff"}
FALLBACK_TYPE = "application/octet-stream"


def slug(label: Column) -> Column:
    """Trimmed and lower case, other characters than letters, digits, _ and - as single _; null where nothing is left."""
    # The characters that stay.
    s = F.regexp_replace(F.lower(F.trim(label)), "[^a-zA-Z0-9_-]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s != "", s)


def safe_extension(name: Column) -> Column:
    found = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.when(found.isin(*EXTENSIONS), found).otherwise("bin")


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def storage_path(label: Column, sha: Column, name: Column) -> Column:
    """originals/{slug}/{sha}.{ext}; null without a slug."""
    return F.concat(F.lit("originals/"), slug(label), F.lit("/"), sha, F.lit("."), safe_extension(name))


def is_inside(path: Column) -> Column:
    """False for absolute paths and those with a .. segment."""
    return ~(path.startswith("/") | path.rlike(r"(^|/)\.\.(/|$)"))


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(table, ext), F.lit(FALLBACK_TYPE))
