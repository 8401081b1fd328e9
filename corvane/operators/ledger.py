"""Durable identities: unit ids, paragraph anchors, retirement, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unit_key(root_id: str = "root_id", path: str = "rel_path"):
    """NNN/relative path, from the persistent number of the root."""
    return F.concat(F.lpad(F.col(root_id).cast("string"), 3, "0"), F.lit("/"), F.col(path))


def register(known: DataFrame, paths: DataFrame) -> DataFrame:
    """(path_key, id) of paths not seen before: max + 1 in path order; ids of deleted units stay taken.

    Numbers are given per range partition and shifted by the counts before it, so that no single task
    sorts all new paths.
    """
    top = known.agg(F.coalesce(F.max(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")), F.lit(0)).alias("top"))
    new = paths.select("path_key").where("path_key IS NOT NULL").distinct().join(known, "path_key", "left_anti")
    new = new.repartitionByRange("path_key").sortWithinPartitions("path_key").withColumn("part", F.spark_partition_id())
    new = new.withColumn("n", F.row_number().over(Window.partitionBy("part").orderBy("path_key")))
    counts = new.groupBy("part").agg(F.count("*").alias("k"))
    before = counts.withColumn("before", F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    new = new.join(F.broadcast(before.select("part", "before")), "part").crossJoin(F.broadcast(top))  # a row per partition; one row
    return new.select("path_key", F.format_string("SRC-%06d", F.col("n") + F.col("before") + F.col("top")).alias("id"))


def align(anchors: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Old anchors (unit_id, p, text, pos) against new paragraphs (unit_id, idx, text).

    Equal texts pair up in document order, the k-th old with the k-th new; an unmatched anchor is retired,
    an unmatched paragraph gets the unit's next number, in document order. Gives (unit_id, p, idx, change).
    """
    nth = lambda order: F.row_number().over(Window.partitionBy("unit_id", "text").orderBy(order))
    old = anchors.select("unit_id", "text", "p", nth("pos").alias("nth"))
    new = paragraphs.select("unit_id", "text", "idx", nth("idx").alias("nth"))
    j = old.join(new, ["unit_id", "text", "nth"], "full_outer")
    j = j.withColumn("change", F.when(F.col("idx").isNull(), "retired").when(F.col("p").isNull(), "added").otherwise("kept"))
    top = anchors.groupBy("unit_id").agg(F.max("p").alias("top"))
    j = j.join(top, "unit_id", "left")
    fresh = F.row_number().over(Window.partitionBy("unit_id", "change").orderBy("idx"))
    return j.select("unit_id", F.when(F.col("change") == "added", F.coalesce("top", F.lit(0)) + fresh).otherwise(F.col("p")).alias("p"), "idx", "change")


def drift(aligned: DataFrame) -> DataFrame:
    """(unit_id, kept, retired, added, line) per unit."""
    d = aligned.groupBy("unit_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("kept", "retired", "added")])
    return d.withColumn("line", F.format_string("%s: %d kept, %d retired, %d added", "unit_id", "kept", "retired", "added"))


def live_anchors(anchors: DataFrame) -> DataFrame:
    """(unit_id, p, exact_text_hash, added_v, retired_v) once each; of repeated rows the latest recorded counts."""
    a = anchors.where("unit_id IS NOT NULL AND p IS NOT NULL")
    latest = F.max_by(F.struct("exact_text_hash", "added_v", "retired_v"), F.struct("recorded_at", "retired_v"))
    return a.groupBy("unit_id", "p").agg(latest.alias("s")).select("unit_id", "p", "s.*")


def retire_vanished(units: DataFrame, live: DataFrame, anchors: DataFrame) -> DataFrame:
    """(unit_id, p, retired_v): live anchors of units that are gone, retired by the unit's next version."""
    gone = units.where(~F.coalesce("deleted", F.lit(False))).join(live, "id", "left_anti").select(F.col("id").alias("unit_id"))
    own = live_anchors(anchors).join(gone, "unit_id", "left_semi")
    version = own.groupBy("unit_id").agg((F.greatest(F.max("added_v"), F.coalesce(F.max("retired_v"), F.lit(0))) + 1).alias("next"))
    return own.where("retired_v IS NULL").join(version, "unit_id").select("unit_id", "p", F.col("next").alias("retired_v"))


def sync_diff(old: DataFrame, new: DataFrame, key: str = "ref", value: str = "content_hash") -> DataFrame:
    """(key, change): inserted, deleted, changed or equal between two snapshots; nulls compare as values."""
    o = old.select(key, F.col(value).alias("o"), F.lit(1).alias("in_old"))
    n = new.select(key, F.col(value).alias("n"), F.lit(1).alias("in_new"))
    j = o.join(n, key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "inserted").when(F.col("in_new").isNull(), "deleted").when(F.col("o").eqNullSafe(F.col("n")), "equal").otherwise("changed")
    return j.select(key, change.alias("change"))


def next_revision(revision: int, changed_units: int) -> int:
    """The corpus revision moves by one for every changed unit."""
    return revision + changed_units
