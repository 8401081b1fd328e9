"""Checks of records, as data: the good ones and the bad ones with their reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad): bad rows carry `reasons`. Nulls in optional fields are fine; rules are tri-state safe."""
    d = F.col("record_date")
    iso, confidence, granularity = (F.coalesce(d[x], F.lit("")) for x in ("iso", "confidence", "granularity"))
    day = iso.try_cast("date")
    note, digest = F.col("kind") == "note", F.coalesce(F.col("note_type") == "digest", F.lit(False))
    w = F.col("note_window")
    rules = {
        "no ref": F.coalesce(F.trim("ref"), F.lit("")) == "",
        "unknown kind": ~F.coalesce(F.col("kind").isin("source", "note", "manuscript"), F.lit(False)),
        "no title": F.coalesce(F.trim("title"), F.lit("")) == "",
        "source ref": (F.col("kind") == "source") & ~F.col("ref").rlike(r"^SRC-\d{6,}$"),
        "unknown confidence": d.isNotNull() & ~confidence.isin("exact", "inferred", "unknown"),
        "unknown granularity": d.isNotNull() & ~granularity.isin("day", "month", "year"),
        "iso against confidence": d.isNotNull() & ((iso == "") != (confidence == "unknown")),
        "iso is no day": (iso != "") & day.isNull(),
        "exact date without a day": (confidence == "exact") & (granularity != "day"),
        "month not at its first": (granularity == "month") & (iso != "") & ~iso.endswith("-01"),
        "year not at its first": (granularity == "year") & (iso != "") & ~iso.endswith("-01-01"),
        "note field": ~note & (F.col("note_type").isNotNull() | w.isNotNull() | F.col("corpus_revision").isNotNull() | F.col("coverage_complete").isNotNull()),
        "digest field": note & ~digest & (F.col("corpus_revision").isNotNull() | F.col("coverage_complete").isNotNull()),
        "window reversed": w.isNotNull() & ~F.coalesce(w["day_from"] <= w["day_to"], F.lit(False)),
    }
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]))
    checked = records.withColumn("reasons", reasons)
    return checked.where(F.size("reasons") == 0).drop("reasons"), checked.where(F.size("reasons") > 0)
