"""Verbatim reads: records, anchors, ranges, sections, pages, and checks of citations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import refs
from corvane.operators.ledger import live_anchors


def read_record(paragraphs: DataFrame, ref: str) -> DataFrame:
    """(label, idx, text) of a record, each paragraph with its citation label."""
    return paragraphs.where(F.col("ref") == ref).select(F.concat_ws(" ", "ref", F.concat(F.lit("p"), F.col("idx") + 1)).alias("label"), "idx", "text")


def anchor_order(anchors: DataFrame) -> DataFrame:
    """Live anchors with their place in the unit's order (by number; the tables keep no other order)."""
    live = live_anchors(anchors).where("retired_v IS NULL")
    return live.withColumn("pos", F.row_number().over(Window.partitionBy("unit_id").orderBy("p")))


def read_range(anchors: DataFrame, unit: str, first: int, last: int | None) -> DataFrame:
    """Live anchors from one to another in document order (to the end where last is null).

    A retired or unknown end, or an end before the start, gives no rows; check_citations() tells them apart.
    """
    o = anchor_order(anchors.where(F.col("unit_id") == unit))
    a = o.where(F.col("p") == first).agg(F.max("pos").alias("a"))
    b = o.agg(F.max("pos").alias("b")) if last is None else o.where(F.col("p") == last).agg(F.max("pos").alias("b"))
    return o.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).where("pos BETWEEN a AND b").select("unit_id", "p", "pos", "exact_text_hash")  # one row each


def read_retired(anchors: DataFrame) -> DataFrame:
    """(ref, unit_id, p, exact_text_hash, retired_v, pointer): retired anchors with the record to read instead."""
    r = live_anchors(anchors).where("retired_v IS NOT NULL")
    return r.select(F.concat_ws(" ", "unit_id", F.concat(F.lit("p"), "p")).alias("ref"), "unit_id", "p", "exact_text_hash", "retired_v", F.col("unit_id").alias("pointer"))


def check_citations(paragraphs: DataFrame, units: DataFrame, anchors: DataFrame) -> DataFrame:
    """(ref, idx, cited, verdict): source references in prose, ok, retired, missing or of an unknown record."""
    c = paragraphs.select("ref", "idx", F.explode(F.array_distinct(refs.find_refs(F.col("text")))).alias("cited"))
    c = c.withColumn("unit_id", F.regexp_extract("cited", r"^(SRC-\d+)", 1)).withColumn("p", F.regexp_extract("cited", r" p(\d+)", 1).try_cast("int"))
    u = units.select(F.col("id").alias("unit_id"), F.lit(True).alias("known")).distinct()
    a = live_anchors(anchors).select("unit_id", "p", F.lit(True).alias("there"), F.col("retired_v").isNotNull().alias("gone"))
    j = c.join(u, "unit_id", "left").join(a, ["unit_id", "p"], "left")
    verdict = F.when(F.col("known").isNull(), "unknown record").when(F.col("p").isNull(), "ok").when(F.col("there").isNull(), "missing").when(F.col("gone"), "retired").otherwise("ok")
    return j.select("ref", "idx", "cited", verdict.alias("verdict"))


def _joins_previous(c: str) -> bool:
    import unicodedata

    return bool(unicodedata.combining(c)) or c in "‍️︎" or c == "\n"


def safe_cut(text: str, room: int) -> int:
    """Characters of text whose UTF-8 fits into room, not parting a letter from its marks or CR from LF."""
    n = len(text.encode("utf-8")[: max(0, room)].decode("utf-8", errors="ignore"))
    if n >= len(text):
        return len(text)
    while n > 0 and (_joins_previous(text[n]) and (text[n] != "\n" or text[n - 1] == "\r")):
        n -= 1
    return n


def paginate(units: list[tuple[str, str]], budget: int) -> list[list[tuple[str, str, str]]]:
    """Pages of (label, text, separator) under a byte budget; their texts and separators join to the whole.

    A page ends between paragraphs; only a paragraph that fills more than a page is cut.
    """
    pages: list[list[tuple[str, str, str]]] = [[]]
    room = budget
    for k, (label, text) in enumerate(units):
        separator = "\n\n" if k < len(units) - 1 else ""
        first = True
        while True:
            name = label if first else f"{label} (continued)"
            cost = len(name.encode()) + 1 + len(text.encode()) + len(separator)
            if cost <= room:
                pages[-1].append((name, text, separator))
                room -= cost
                break
            if pages[-1]:
                pages.append([])
                room = budget
                continue
            cut = max(1, safe_cut(text, room - len(name.encode()) - 1))
            if cut >= len(text):
                pages[-1].append((name, text, separator))
                room = 0
                break
            pages[-1].append((name, text[:cut], ""))
            text, first = text[cut:], False
            pages.append([])
            room = budget
    return [p for p in pages if p]


def read_pages(records: DataFrame, budget: int = 7980 * 4 - 1000) -> DataFrame:
    """(ref, page, seq, label, text, separator): every record cut into pages; one record at a time per row."""
    r = records.select("ref", "paragraphs").where("ref IS NOT NULL AND paragraphs IS NOT NULL")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for ref, ps in b.itertuples(index=False):
                units = [(f"{ref} p{k + 1}", p) for k, p in enumerate(ps) if p is not None]
                rows += [(ref, n, s, *piece) for n, page in enumerate(paginate(units, budget)) for s, piece in enumerate(page)]
            yield pd.DataFrame(rows, columns=["ref", "page", "seq", "label", "text", "separator"])

    return r.mapInPandas(cut, "ref string, page int, seq int, label string, text string, separator string")
