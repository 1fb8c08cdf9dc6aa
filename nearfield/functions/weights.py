"""Feature weights: parsing, normalising, leaving one out; for one run as a dict, for many as columns."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.schema import DEFAULT_WEIGHTS, FEATURES


def normalise(weights: dict | None) -> dict[str, float]:
    """All features' weights, summing to 1: unknown names go, missing and negative ones are 0, and a sum of 0 gives the
    defaults. A number that is not finite is an error."""
    known = {f: float((weights or {}).get(f, 0.0)) for f in FEATURES}
    if not all(map(math.isfinite, known.values())):
        raise ValueError("weights must be finite")
    known = {f: max(w, 0.0) for f, w in known.items()}
    total = sum(known.values())
    return {f: w / total for f, w in known.items()} if total > 0 else dict(DEFAULT_WEIGHTS)


def parse(raw: str | None) -> dict[str, float] | None:
    """Weights from JSON text; None for none. Anything but an object of numbers (or their strings) is an error."""
    if raw is None or not raw.strip():
        return None
    try:
        found = json.loads(raw)
        return {str(k): float(v) for k, v in found.items()}
    except (ValueError, AttributeError, TypeError) as e:
        raise ValueError("weights must be a JSON object of numbers") from e


def without(feature: str, weights: dict | None = None) -> dict[str, float]:
    return normalise({f: w for f, w in (weights or DEFAULT_WEIGHTS).items() if f != feature})


def ablations() -> dict[str, dict[str, float]]:
    return {"base": dict(DEFAULT_WEIGHTS)} | {f"minus_{f}": without(f) for f in FEATURES}


def normalised_columns(values: dict[str, Column]) -> dict[str, Column]:
    """The same for many runs at once: normalised weight columns from raw ones, null being 0 and NaN an error's null."""
    low = {f: F.greatest(F.coalesce(values[f], F.lit(0.0)) if f in values else F.lit(0.0), F.lit(0.0)) for f in FEATURES}
    total = sum((low[f] for f in FEATURES[1:]), low[FEATURES[0]])
    return {f: F.when(total > 0, low[f] / total).otherwise(F.lit(DEFAULT_WEIGHTS[f])) for f in FEATURES}


def parsed_columns(raw: Column) -> dict[str, Column]:
    """Raw weights from a JSON column; null where a key is missing or no number."""
    found = F.from_json(raw, "map<string,string>")
    return {f: F.element_at(found, f).try_cast("double") for f in FEATURES}


def is_valid(raw: Column) -> Column:
    """False for text that is no JSON object of numbers; null and blank text are valid."""
    found = F.from_json(raw, "map<string,string>")
    good = F.coalesce(F.forall(F.map_values(found), lambda v: v.try_cast("double").isNotNull()), F.lit(False))
    return F.when(raw.isNull() | (F.trim(raw) == ""), True).otherwise(F.try_parse_json(raw).isNotNull() & good)


def as_map(weights: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])


def frame(spark, variants: dict[str, dict[str, float]]) -> DataFrame:
    """variant, feature, weight: a handful of rows."""
    return spark.createDataFrame([(v, f, float(w)) for v, ws in variants.items() for f, w in ws.items()], "variant string, feature string, weight double")
