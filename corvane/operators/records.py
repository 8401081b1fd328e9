"""Records and paragraphs: deliveries, periods, kinds, filters, browse order, histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import dates, text


def records_of(raw: DataFrame) -> DataFrame:
    """One row per ref, with period, token estimate and paragraph count. Null dates count as unknown.

    Rows delivered twice are equal but for ingested_at; the earliest time is kept. What derives from a text is
    computed before rows are brought together, and every column is an aggregate of its own, so that a query
    reads and shuffles only the columns it uses, and no text for a filter or a total.
    """
    derived = {
        "unknown": dates.unknown(),
        "iso": F.coalesce(F.when(~dates.unknown(), F.col("record_date.iso")), F.lit("")),
        "period_start": dates.period_start(),
        "period_end": dates.period_end(),
        "tokens": text.token_estimate("paragraphs"),
        "n_paragraphs": F.coalesce(F.size("paragraphs"), F.lit(0)),
    }
    r = raw.where(F.col("ref").isNotNull()).withColumns(derived)
    return r.groupBy("ref").agg(*[(F.min if c == "ingested_at" else F.first)(c).alias(c) for c in r.columns if c != "ref"])


def paragraphs_of(records: DataFrame) -> DataFrame:
    """(ref, idx, text): one row per paragraph; null paragraphs keep their index and are left out."""
    return records.select("ref", F.posexplode("paragraphs").alias("idx", "text")).where(F.col("text").isNotNull())


def eligible(records: DataFrame, from_: str | None = None, to: str | None = None, kind: str | None = None, refs: DataFrame | None = None) -> DataFrame:
    """Records that pass the range (by overlap; unknown dates always do), the kind and a set of refs."""
    r = records
    if from_ or to:
        r = r.where(dates.in_range(F.col("period_start"), F.col("period_end"), from_, to))
    if kind:
        r = r.where(F.col("kind") == kind)
    return r.join(refs, "ref", "left_semi") if refs is not None else r


#: Browse and plan order: dated records by day, then ref; undated ones last.
BROWSE = ("unknown", "iso", "ref")


def browse_page(records: DataFrame, after: tuple | None = None, size: int = 500) -> DataFrame:
    """The next page in browse order after a key; no offset is ever counted off."""
    r = records
    if after is not None:
        r = r.where(F.struct(*BROWSE) > F.struct(*[F.lit(v) for v in after]))
    return r.orderBy(*BROWSE).limit(size)


def by_month(records: DataFrame) -> DataFrame:
    """(month, records, tokens) of dated records; partial dates stand under their first month."""
    return records.where(~F.col("unknown")).groupBy(F.substring("iso", 1, 7).alias("month")).agg(F.count("*").alias("records"), F.sum("tokens").alias("tokens"))


def aliases_of(notes: DataFrame) -> DataFrame:
    """(ref, name): title, file stem and aliases of each note."""
    stem = F.regexp_extract("ref", r"([^/]*?)(?:\.[^./]*)?$", 1)
    names = F.array_union(F.array("title", stem), F.coalesce("aliases", F.array().cast("array<string>")))
    return notes.select("ref", F.explode(names).alias("name")).where(F.trim(F.col("name")) != "")


def names_for(notes: DataFrame, who: str) -> DataFrame:
    """(name): all names of every note that has the given one (case aside); the name itself where none has."""
    all_names = aliases_of(notes)
    hit = all_names.where(F.lower("name") == F.lower(F.lit(who))).select("ref").distinct()
    names = all_names.join(hit, "ref", "left_semi").select("name").distinct()
    alone = notes.sparkSession.range(1).select(F.lit(who).alias("name"))
    any_hit = names.agg(F.count("*").alias("n"))
    return names.unionByName(alone.crossJoin(F.broadcast(any_hit)).where("n = 0").select("name"))  # one row by one row


def heading_sections(paragraphs: DataFrame) -> DataFrame:
    """(ref, heading, occurrence, depth, start_idx, end_idx): each heading's section, to the next one as deep or less.

    The headings of one file are folded in order; a file's paragraphs are bounded by the file.
    """
    h = paragraphs.withColumn("depth", text.heading_depth("text")).where("depth > 0")
    h = h.withColumn("heading", F.trim(F.regexp_replace("text", r"^#+\s+|\n[\s\S]*$", "")))
    w = Window.partitionBy("ref").orderBy("idx").rowsBetween(1, Window.unboundedFollowing)
    later = F.collect_list(F.struct("idx", "depth")).over(w)
    nxt = F.try_element_at(F.filter(later, lambda x: x["depth"] <= F.col("depth")), F.lit(1))["idx"]
    last = paragraphs.groupBy("ref").agg(F.max("idx").alias("last"))
    h = h.withColumn("next", nxt).withColumn("occurrence", F.row_number().over(Window.partitionBy("ref", "heading").orderBy("idx")))
    return h.join(last, "ref").select("ref", "heading", "occurrence", "depth", F.col("idx").alias("start_idx"), F.coalesce(F.col("next") - 1, F.col("last")).alias("end_idx"))


def word_cap_warnings(notes: DataFrame, cap: int) -> DataFrame:
    """(ref, words): notes with more words than the cap."""
    words = F.aggregate(F.coalesce("paragraphs", F.array().cast("array<string>")), F.lit(0), lambda a, p: a + F.coalesce(text.word_count(p), F.lit(0)))
    return notes.select("ref", words.alias("words")).where(F.col("words") > cap)

