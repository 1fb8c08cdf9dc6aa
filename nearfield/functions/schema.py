"""Fixed values of the data model, and the tables' schemas as DDL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Feature names in order, their widths and default weights.
FEATURES = ("hsv", "cm", "lbp", "glcm", "hog", "hu")
DIMS = {"hsv": 768, "cm": 9, "lbp": 18, "glcm": 40, "hog": 8100, "hu": 7}
DEFAULT_WEIGHTS = {"hsv": 0.20, "cm": 0.10, "lbp": 0.15, "glcm": 0.15, "hog": 0.25, "hu": 0.15}
EXTRACTOR_VERSION = "v1.1"
TOP_K, EVAL_TOP_K, MAX_TOP_K, CANDIDATE_K = 5, 10, 50, 50
MAX_UPLOAD_BYTES = 8 * 1024 * 1024
ROLES = ("corpus", "query")

IMAGES = (
    "id bigint, sha256 string, filename string, storage_path string, animal_type string, width int, height int, size_bytes int, role string, uploaded_at timestamp"
)
FEATURE_SETS = ("image_id bigint, extractor_ver string, " + ", ".join(f"{f} array<float>" for f in FEATURES))
SEARCH_RUNS = (
    "id bigint, version int, query_image_id bigint, weights map<string,double>, "
    "results array<struct<image_id:bigint,score:double,rank:int,per_feature:map<string,double>>>, "
    "pipeline_trace array<struct<name:string,elapsed_ms:int,detail:string>>, elapsed_ms int, created_at timestamp"
)
EVALUATION_RUNS = (
    "id bigint, method string, precision_at_5 decimal(5,4), map_at_10 decimal(5,4), per_class string, ablation string, started_at timestamp, finished_at timestamp"
)
EVENTS = ("stream_id string, seq bigint, kind string, payload string, at_ms bigint")


#: The version of the tables above, and the tables by name. A change of a table raises it.
SCHEMA_VERSION = 2
TABLES = {"images": IMAGES, "feature_sets": FEATURE_SETS, "search_runs": SEARCH_RUNS, "evaluation_runs": EVALUATION_RUNS, "events": EVENTS}


def conform(df: DataFrame, table: str) -> DataFrame:
    """``df`` with exactly the columns of ``table`` in its present version, in order and type.

    Columns that an older version lacked are null (``version`` of search_runs is 1); unknown ones are an error.
    """
    want = df.sparkSession.createDataFrame([], TABLES[table]).schema
    extra = set(df.columns) - set(want.fieldNames())
    if extra:
        raise SchemaError(f"{table} has no columns {sorted(extra)}")
    first = {("search_runs", "version"): F.lit(1)}
    column = lambda f: F.col(f.name) if f.name in df.columns else first.get((table, f.name), F.lit(None))
    return df.select(*[column(f).cast(f.dataType).alias(f.name) for f in want])


#: What leads from a version of a table to the next: version 2 numbered the runs' re-ranks, other tables stayed.
STEPS = {t: {1: (lambda df, t=t: conform(df, t))} for t in TABLES}


class SchemaError(ValueError):
    """Rows that do not fit a table."""


class EmptyCorpusError(ValueError):
    """There is nothing to search."""


class UnknownRunError(KeyError):
    """No run has this id."""


class NoStashError(ValueError):
    """The run has no sub-scores to rank anew."""


class EvaluationError(ValueError):
    """Too few items or labels to evaluate."""
