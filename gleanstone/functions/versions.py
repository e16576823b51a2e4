"""Version compatibility of pins with a user's version, computed once for each distinct pin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scoring import VERSION_PENALTY

LABELS = ("compatible", "newer_required", "older_targeted", "unknown")


def compatibility(user: str, pin: str | None) -> str:
    """How a pin (a plain version, or PEP 440 specifiers) stands to the user's version.

    A plain version means that version or later. Outside a specifier set, a user above every bound has moved past it
    (older_targeted), else needs to move up (newer_required); exclusions alone, an excluded version, and what
    is no PEP 440 (npm ranges) tell nothing (unknown).
    """
    from packaging.specifiers import InvalidSpecifier, SpecifierSet
    from packaging.version import InvalidVersion, Version

    def parsed(text: str) -> Version | None:
        try:
            return Version(text)
        except InvalidVersion:
            return None

    mine, pin = parsed(user), (pin or "").strip()
    if mine is None or not pin:
        return "unknown"
    if pin[0].isdigit():
        theirs = parsed(pin)
        return "unknown" if theirs is None else "compatible" if mine >= theirs else "newer_required"
    try:
        wanted = SpecifierSet(pin)
    except InvalidSpecifier:
        return "unknown"
    if mine in wanted:
        return "compatible"
    known = [(s.operator, v) for s in wanted if (v := parsed(s.version)) is not None]
    excluded = {v for op, v in known if op == "!="}
    bounds = [v for op, v in known if op != "!="]
    if mine in excluded or (excluded and not bounds):
        return "unknown"
    if bounds and mine >= max(bounds) and (">", mine) not in known:
        return "older_targeted"
    return "newer_required"


def with_compatibility(rows: DataFrame, user: str, pin: str = "pipeline_version_pin") -> DataFrame:
    """rows with compat and version_penalty; pins are few, so they are labelled apart and joined back."""

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(compat=[compatibility(user, p) for p in batch["_pin"]])

    pins = rows.select(F.col(pin).alias("_pin")).filter("_pin is not null").distinct().mapInPandas(label, "_pin string, compat string")
    out = rows.join(pins, F.col(pin) == F.col("_pin"), "left").drop("_pin").withColumn("compat", F.coalesce("compat", F.lit("unknown")))
    return out.withColumn("version_penalty", F.when(F.col("compat") == "newer_required", VERSION_PENALTY).otherwise(0.0))


def compatible_only(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("compat").isin("compatible", "older_targeted", "unknown"))
