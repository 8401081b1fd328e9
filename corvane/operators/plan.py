"""Coverage by digests and the budgeted reading plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import dates
from corvane.operators.records import BROWSE


def coverage(records: DataFrame, revision: str | None, from_: str | None, to: str | None) -> DataFrame:
    """(ref, day_from, day_to) of digests that count: complete, of the current revision, overlapping the range.

    Without a range nothing is covered. Null completeness is not complete.
    """
    d = records.where((F.col("kind") == "note") & (F.col("note_type") == "digest") & F.col("note_window.day_from").isNotNull())
    d = d.where(F.coalesce("coverage_complete", F.lit(False)) & F.col("corpus_revision").eqNullSafe(F.lit(revision)))
    low = dates.spec_bounds(from_)[0] if from_ else "0000-01-01"
    high = dates.spec_bounds(to)[1] if to else "9999-12-31"
    d = d.where(F.lit(bool(from_ or to)) & (F.col("note_window.day_from") <= high) & (F.col("note_window.day_to") >= low))
    return d.select("ref", "note_window.day_from", "note_window.day_to")


def plan_candidates(records: DataFrame, covered: DataFrame) -> DataFrame:
    """Records that a plan assigns: all but source records of an exact day inside a covered window.

    Windows are spread over their days first, so that the exclusion is an equi-join on the day.
    """
    days = covered.select(F.explode(F.sequence(F.col("day_from").cast("date"), F.col("day_to").cast("date"))).alias("d"))
    days = days.select(F.date_format("d", "yyyy-MM-dd").alias("iso")).distinct()
    exact = (F.col("kind") == "source") & (F.col("record_date.confidence") == "exact") & ~F.col("unknown")
    kept = records.where(exact).join(days, "iso", "left_anti")
    return kept.unionByName(records.where(~exact).select(kept.columns)) if kept.columns else kept


def chunk_plan(records: DataFrame, budget: int) -> DataFrame:
    """(chunk, ref, segment, segments, tokens): assignments under the budget, in plan order.

    A day's records go together unless they alone exceed the budget; then they are split by ref, and a
    record above the budget is read in segments. The fold needs the whole order, so it runs as one pass
    over (key, tokens) rows only, streamed in batches; what leads to them is distributed.
    """
    rows = records.select(*BROWSE, "tokens").repartitionByRange(1, *BROWSE).sortWithinPartitions(*BROWSE)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, filled, used = 0, 0, False
        day: str | None = None
        bucket: list[tuple[str, int]] = []

        def place() -> list[tuple]:
            nonlocal chunk, filled, used
            out: list[tuple] = []

            def flush() -> None:
                nonlocal chunk, filled, used
                if used:
                    chunk, filled, used = chunk + 1, 0, False

            total = sum(t for _, t in bucket)
            if used and filled + total > budget:
                flush()
            for ref, t in bucket:
                if total > budget:
                    if t > budget:
                        flush()
                        n = -(-t // budget)
                        for k in range(n):
                            out.append((chunk, ref, k + 1, n, max(0, min(budget, t - k * budget))))
                            chunk += 1
                        continue
                    if used and filled + t > budget:
                        flush()
                out.append((chunk, ref, 1, 1, t))
                filled, used = filled + t, True
            bucket.clear()
            return out

        for b in batches:
            out: list[tuple] = []
            for unknown, iso, ref, t in b.itertuples(index=False):
                key = "unknown" if unknown else iso
                if key != day and bucket:
                    out += place()
                day = key
                bucket.append((ref, int(t)))
            yield pd.DataFrame(out, columns=["chunk", "ref", "segment", "segments", "tokens"])
        yield pd.DataFrame(place(), columns=["chunk", "ref", "segment", "segments", "tokens"])

    return rows.mapInPandas(fold, "chunk bigint, ref string, segment int, segments int, tokens bigint")


def plan_slice(records: DataFrame, low: tuple, high: tuple) -> DataFrame:
    """Records whose plan key lies between two keys, both included."""
    key = F.struct(*BROWSE)
    return records.where((key >= F.struct(*[F.lit(v) for v in low])) & (key <= F.struct(*[F.lit(v) for v in high])))
