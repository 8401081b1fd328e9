"""All core queries by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import dates, refs
from corvane.functions import text as T
from corvane.operators import ledger as L
from corvane.operators import plan as P
from corvane.operators import read as E
from corvane.operators import records as R
from corvane.operators import search as S
from corvane.operators.timestamps import source_instants
from corvane.session import table
from corvane.sources.convert import converter_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; sql is its equivalent over the same tables."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return source_instants(table(spark, d, "records"), table(spark, d, "units"), table(spark, d, "roots"))


_R = """rec AS (
  SELECT ref, kind, note_type, record_date.confidence AS confidence, record_date.granularity AS granularity, record_date.text AS date_text, title, paragraphs, aliases, warnings,
    note_window.day_from AS day_from, note_window.day_to AS day_to, corpus_revision, coverage_complete,
    coalesce(record_date.confidence = 'unknown', true) OR coalesce(record_date.iso, '') = '' AS unknown,
    CASE WHEN coalesce(record_date.confidence = 'unknown', true) THEN '' ELSE coalesce(record_date.iso, '') END AS iso,
    coalesce(CAST(ceil(octet_length(encode(array_to_string(paragraphs, chr(10) || chr(10)))) / 4.0) AS BIGINT), 0) AS tokens,
    coalesce(len(paragraphs), 0) AS n_paragraphs
  FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY ingested_at) AS nth FROM records WHERE ref IS NOT NULL) WHERE nth = 1
), per AS (
  SELECT *, CASE WHEN unknown THEN NULL WHEN granularity = 'day' THEN iso WHEN granularity = 'month' THEN iso[1:7] || '-01' ELSE iso[1:4] || '-01-01' END AS period_start,
    CASE WHEN unknown THEN NULL WHEN granularity = 'day' THEN iso WHEN granularity = 'month' THEN strftime(last_day(CAST(iso[1:7] || '-01' AS DATE)), '%Y-%m-%d') ELSE iso[1:4] || '-12-31' END AS period_end
  FROM rec
)"""
_P = f"{_R}, para AS (SELECT ref, idx, text FROM (SELECT ref, unnest(paragraphs) AS text, generate_subscripts(paragraphs, 1) - 1 AS idx FROM rec) WHERE text IS NOT NULL)"
_FOLD = f"translate(regexp_replace(lower({{0}}), '\\p{{{{Mn}}}}', '', 'g'), '{T._ACCENTED}', '{T._BASE}')"
_TOKS = f"regexp_extract_all({_FOLD}, '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"
_LIVE = "live AS (SELECT unit_id, p, exact_text_hash, added_v, retired_v FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, p ORDER BY recorded_at DESC, retired_v DESC NULLS LAST) AS nth FROM anchors WHERE unit_id IS NOT NULL AND p IS NOT NULL) WHERE nth = 1)"
_WORDS = ("insurance", "schedule")
_PHRASE = ("lock", "keeper")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return R.records_of(table(spark, d, "records"))


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return R.paragraphs_of(_records(spark, d))


# -- sources and identities


@query("unit_keys", "SELECT id, lpad(CAST(root_id AS VARCHAR), 3, '0') || '/' || rel_path AS unit_key FROM units")
def unit_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "units").select("id", L.unit_key().alias("unit_key"))


@query("converter_dispatch", "SELECT id, CASE lower(regexp_extract(rel_path, '(\\.[^./]+)$', 1)) WHEN '.txt' THEN 'text@1' WHEN '.md' THEN 'text@1' WHEN '.eml' THEN 'eml@2' WHEN '.docx' THEN 'docx@1' WHEN '.pdf' THEN 'pdf@1' END AS converter FROM units")
def converter_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "units").select("id", converter_of(F.col("rel_path")).alias("converter"))


@query("conversion_cache", "SELECT u.id, u.sha256, c.conv_id IS NOT NULL AS cached FROM (SELECT id, sha256 FROM units) u LEFT JOIN (SELECT sha256, max(conv_id) AS conv_id FROM conversions WHERE converter = 'eml@2' GROUP BY sha256) c ON u.sha256 = c.sha256")
def conversion_cache(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversions").where("converter = 'eml@2'").groupBy("sha256").agg(F.max("conv_id").alias("conv_id"))
    return table(spark, d, "units").select("id", "sha256").join(c, "sha256", "left").select("id", "sha256", F.col("conv_id").isNotNull().alias("cached"))


@query("embed_misses", f"WITH {_P}, h AS (SELECT DISTINCT sha256(text) AS hash FROM para), c AS (SELECT DISTINCT sha256(p.text) AS hash FROM para p JOIN para_vectors v ON p.ref = v.ref AND p.idx = v.idx WHERE v.vector IS NOT NULL) SELECT hash FROM h WHERE hash NOT IN (SELECT hash FROM c)")
def embed_misses(spark: SparkSession, d: str) -> DataFrame:
    p = _paragraphs(spark, d).select("ref", "idx", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    have = p.join(table(spark, d, "para_vectors").where("vector IS NOT NULL").select("ref", "idx"), ["ref", "idx"], "left_semi").select("hash").distinct()
    return p.select("hash").distinct().join(have, "hash", "left_anti")


@query("register_ids", "WITH known AS (SELECT * FROM units WHERE root_id <> 2), top AS (SELECT max(CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT)) AS m FROM known), new AS (SELECT DISTINCT path_key FROM units WHERE path_key NOT IN (SELECT path_key FROM known)) SELECT path_key, 'SRC-' || lpad(CAST(m + row_number() OVER (ORDER BY path_key COLLATE C) AS VARCHAR), 6, '0') AS id FROM new, top".replace(" COLLATE C", ""))
def register_ids(spark: SparkSession, d: str) -> DataFrame:
    """Units of root 2 are taken as not yet registered."""
    u = table(spark, d, "units")
    return L.register(u.where("root_id <> 2").select("path_key", "id"), u)


_ALIGN = """, old AS (SELECT ref AS unit_id, text, idx + 1 AS p, row_number() OVER (PARTITION BY ref, text ORDER BY idx) AS nth FROM para),
new AS (SELECT ref AS unit_id, text, k - 1 AS idx, row_number() OVER (PARTITION BY ref, text ORDER BY k) AS nth FROM (
  SELECT ref, text, row_number() OVER (PARTITION BY ref ORDER BY idx DESC) AS k FROM (SELECT ref, idx, CASE WHEN idx % 5 = 3 THEN text || '!' ELSE text END AS text FROM para WHERE idx % 7 <> 2))),
j AS (SELECT coalesce(o.unit_id, n.unit_id) AS unit_id, o.p AS p0, n.idx, CASE WHEN n.idx IS NULL THEN 'retired' WHEN o.p IS NULL THEN 'added' ELSE 'kept' END AS change
  FROM old o FULL OUTER JOIN new n ON o.unit_id = n.unit_id AND o.text = n.text AND o.nth = n.nth),
top AS (SELECT unit_id, max(p) AS top FROM old GROUP BY unit_id),
al AS (SELECT j.unit_id, CASE WHEN change = 'added' THEN coalesce(top, 0) + row_number() OVER (PARTITION BY j.unit_id, change ORDER BY idx) ELSE p0 END AS p, idx, change FROM j LEFT JOIN top ON j.unit_id = top.unit_id)"""


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    """Every record against a version with paragraphs dropped, edited and reversed."""
    p = _paragraphs(spark, d)
    old = p.select(F.col("ref").alias("unit_id"), (F.col("idx") + 1).alias("p"), "text", F.col("idx").alias("pos"))
    new = p.where("idx % 7 <> 2").withColumn("text", F.when(F.col("idx") % 5 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    new = new.select(F.col("ref").alias("unit_id"), (F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("idx"))) - 1).alias("idx"), "text")
    return L.align(old, new)


@query("align_anchors", f"WITH {_P}{_ALIGN} SELECT unit_id, p, idx, change FROM al")
def align_anchors(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d)


@query("align_drift", f"WITH {_P}{_ALIGN}, g AS (SELECT unit_id, count(*) FILTER (change = 'kept') AS kept, count(*) FILTER (change = 'retired') AS retired, count(*) FILTER (change = 'added') AS added FROM al GROUP BY unit_id) SELECT *, unit_id || ': ' || kept || ' kept, ' || retired || ' retired, ' || added || ' added' AS line FROM g")
def align_drift(spark: SparkSession, d: str) -> DataFrame:
    return L.drift(_aligned(spark, d))


@query("retire_vanished", f"WITH {_LIVE}, gone AS (SELECT id FROM units WHERE NOT coalesce(deleted, false) AND root_id = 3), own AS (SELECT * FROM live WHERE unit_id IN (SELECT id FROM gone)), nx AS (SELECT unit_id, greatest(max(added_v), coalesce(max(retired_v), 0)) + 1 AS next FROM own GROUP BY unit_id) SELECT own.unit_id, p, next AS retired_v FROM own JOIN nx ON own.unit_id = nx.unit_id WHERE retired_v IS NULL")
def retire_vanished(spark: SparkSession, d: str) -> DataFrame:
    """Units of root 3 are taken as gone."""
    u = table(spark, d, "units")
    return L.retire_vanished(u, u.where("root_id <> 3").select("id"), table(spark, d, "anchors"))


_HASH = "sha256(coalesce(title, '') || chr(0) || coalesce(array_to_string(list_transform(paragraphs, lambda x: x || chr(0)), ''), ''))"


@query("content_hash", f"WITH {_R} SELECT ref, {_HASH} AS content_hash FROM rec")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d)
    parts = F.concat(F.array(F.coalesce("title", F.lit(""))), F.coalesce("paragraphs", F.array().cast("array<string>")))
    return r.select("ref", T.content_hash(parts).alias("content_hash"))


@query("sync_diff", f"WITH {_R}, h AS (SELECT ref, kind, {_HASH} AS hash, row_number() OVER (ORDER BY ref) AS k, length(ref) + n_paragraphs AS z FROM rec), o AS (SELECT * FROM h WHERE z % 5 <> 0), n AS (SELECT ref, CASE WHEN z % 3 = 0 THEN hash || 'x' ELSE hash END AS hash FROM h WHERE z % 7 <> 0) SELECT coalesce(o.ref, n.ref) AS ref, CASE WHEN o.ref IS NULL THEN 'inserted' WHEN n.ref IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'equal' ELSE 'changed' END AS change FROM o FULL OUTER JOIN n ON o.ref = n.ref")
def sync_diff(spark: SparkSession, d: str) -> DataFrame:
    """Two snapshots that differ by a rule on each record's length and paragraph count."""
    h = content_hash(spark, d).join(_records(spark, d).select("ref", (F.length("ref") + F.col("n_paragraphs")).alias("z")), "ref")
    new = h.where("z % 7 <> 0").withColumn("content_hash", F.when(F.col("z") % 3 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return L.sync_diff(h.where("z % 5 <> 0"), new)


@query("all_records", f"WITH {_R} SELECT kind, ref, title FROM rec WHERE kind = 'source' UNION ALL SELECT kind, ref, title FROM rec WHERE kind = 'note' UNION ALL SELECT kind, ref, title FROM rec WHERE kind = 'manuscript'")
def all_records(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).select("kind", "ref", "title")
    return r.where("kind = 'source'").unionByName(r.where("kind = 'note'")).unionByName(r.where("kind = 'manuscript'"))


# -- text


@query("tokenize", "SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(" + _TOKS.format("text") + ") AS token FROM documents) GROUP BY ALL")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    return S.tokenised(table(spark, d, "documents"), ["doc_id"]).select("doc_id", F.explode("toks").alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query("token_estimate", f"WITH {_R} SELECT ref, tokens FROM rec")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("ref", "tokens")


@query("paragraph_split", """WITH t AS (SELECT doc_id, string_split_regex(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)^(#{1,6}[^\\S\\n]+\\S[^\\n]*)$', chr(10) || chr(10) || '\\1' || chr(10) || chr(10), 'g'), '\\n\\s*\\n') AS parts FROM documents)
SELECT doc_id, len(ps) AS n_paragraphs, ps[1] AS first, ps[-1] AS last FROM (SELECT doc_id, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS ps FROM t)""")
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", T.split_paragraphs("text").alias("ps"))
    return p.select("doc_id", F.size("ps").alias("n_paragraphs"), F.try_element_at("ps", F.lit(1)).alias("first"), F.try_element_at("ps", F.lit(-1)).alias("last"))


@query("titles", f"WITH {_R}, f AS (SELECT ref, coalesce(list_filter(list_transform(paragraphs, lambda p: trim(regexp_replace(p, '\\s+', ' ', 'g'))), lambda p: p <> '')[1], '') AS t FROM rec), s AS (SELECT ref, CASE WHEN regexp_extract(t, '(?s)^(.*?[.!?][\"'')\\]’”]*)(?:\\s|$)', 1) <> '' THEN regexp_extract(t, '(?s)^(.*?[.!?][\"'')\\]’”]*)(?:\\s|$)', 1) ELSE t END AS t FROM f) SELECT ref, rtrim(CASE WHEN length(t) <= 120 THEN t WHEN regexp_extract(t, '(?s)^(.{{1,120}}) ', 1) <> '' THEN regexp_extract(t, '(?s)^(.{{1,120}}) ', 1) ELSE t[1:120] END) AS first_sentence FROM s")
def titles(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("ref", T.first_sentence("paragraphs").alias("first_sentence"))


@query("binary_guard", "SELECT doc_id, contains(text, chr(0)) OR length(regexp_replace(text, '[^\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) / greatest(length(text), 1) > 0.1 OR (length(text) >= 2000 AND (length(text) - length(regexp_replace(text, '\\s', '', 'g'))) / length(text) < 0.02) AS refused FROM documents")
def binary_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.looks_binary("text", F.array("text")).alias("refused"))


@query("word_cap", f"WITH {_R} SELECT ref, words FROM (SELECT ref, coalesce(CAST(list_sum(list_transform(paragraphs, lambda p: len(list_filter(string_split_regex(p, '\\s+'), lambda x: x <> '')))) AS INTEGER), 0) AS words FROM rec WHERE kind = 'note') WHERE words > 100")
def word_cap(spark: SparkSession, d: str) -> DataFrame:
    return R.word_cap_warnings(_records(spark, d).where("kind = 'note'"), 100)


@query("heading_sections", f"""WITH {_P}, h AS (SELECT ref, idx, length(regexp_extract(text, '^(#{{1,6}}) ', 1)) AS depth, trim(regexp_replace(text, '^#+\\s+|\\n[\\s\\S]*$', '', 'g')) AS heading FROM para),
last AS (SELECT ref, max(idx) AS last FROM para GROUP BY ref)
SELECT a.ref, a.heading, row_number() OVER (PARTITION BY a.ref, a.heading ORDER BY a.idx) AS occurrence, a.depth, a.idx AS start_idx, coalesce((SELECT min(b.idx) - 1 FROM h b WHERE b.ref = a.ref AND b.idx > a.idx AND b.depth > 0 AND b.depth <= a.depth), last) AS end_idx FROM h a JOIN last ON a.ref = last.ref WHERE a.depth > 0""")
def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return R.heading_sections(_paragraphs(spark, d))


@query("ref_extract", f"WITH {_P} SELECT ref, idx, unnest(regexp_extract_all(text, '\\bSRC-\\d{{6,}}(?: p\\d+(?:-\\d*)?)?')) AS cited FROM para")
def ref_extract(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).select("ref", "idx", F.explode(refs.find_refs(F.col("text"))).alias("cited"))


@query("citation_check", f"WITH {_P}, {_LIVE}, c AS (SELECT DISTINCT ref, idx, cited FROM (SELECT ref, idx, unnest(regexp_extract_all(text, '\\bSRC-\\d{{6,}}(?: p\\d+(?:-\\d*)?)?')) AS cited FROM para)), k AS (SELECT *, regexp_extract(cited, '^(SRC-\\d+)', 1) AS unit_id, TRY_CAST(regexp_extract(cited, ' p(\\d+)', 1) AS INTEGER) AS p FROM c) SELECT k.ref, k.idx, cited, CASE WHEN u.id IS NULL THEN 'unknown record' WHEN k.p IS NULL THEN 'ok' WHEN live.p IS NULL THEN 'missing' WHEN live.retired_v IS NOT NULL THEN 'retired' ELSE 'ok' END AS verdict FROM k LEFT JOIN units u ON k.unit_id = u.id LEFT JOIN live ON k.unit_id = live.unit_id AND k.p = live.p")
def citation_check(spark: SparkSession, d: str) -> DataFrame:
    return E.check_citations(_paragraphs(spark, d), table(spark, d, "units"), table(spark, d, "anchors"))


# -- dates


@query("period_bounds", f"WITH {_R} SELECT ref, period_start, period_end, coalesce(CAST(replace(period_start, '-', '') AS INTEGER), 0) AS first_int, coalesce(CAST(replace(period_end, '-', '') AS INTEGER), 99999999) AS last_int FROM per")
def period_bounds(spark: SparkSession, d: str) -> DataFrame:
    low, high = dates.UNKNOWN_PERIOD
    return _records(spark, d).select("ref", "period_start", "period_end", dates.as_int(F.col("period_start"), low).alias("first_int"), dates.as_int(F.col("period_end"), high).alias("last_int"))


_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


@query("date_shapes", f"""WITH o AS (SELECT o_orderkey AS k, {_DAY} AS iso FROM orders) SELECT k, CASE k % 5 WHEN 0 THEN 'iso' WHEN 1 THEN 'month_name' WHEN 2 THEN 'month_name' WHEN 3 THEN CASE WHEN CAST(iso[9:10] AS INTEGER) > 12 THEN 'numeric' ELSE 'ambiguous' END ELSE 'month_year' END AS shape,
CASE WHEN k % 5 = 4 THEN iso[1:7] || '-01' WHEN k % 5 = 3 AND CAST(iso[9:10] AS INTEGER) <= 12 THEN iso[1:4] || '-01-01' ELSE iso END AS iso FROM o""")
def date_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in five shapes, read back."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("log of "), F.date_format(day, "yyyy-MM-dd"))).when(k % 5 == 1, F.date_format(day, "d MMMM yyyy")).when(k % 5 == 2, F.date_format(day, "MMM d, yyyy")).when(k % 5 == 3, F.date_format(day, "d/M/yyyy"))
    ).otherwise(F.date_format(day, "MMMM yyyy"))
    o = table(spark, d, "orders").select(k.alias("k"), dates.date_shape(text).alias("s"))
    return o.select("k", "s.shape", "s.iso")


@query("date_first_line", f"WITH o AS (SELECT o_orderkey AS k, {_DAY} AS iso FROM orders) SELECT k, CASE WHEN k % 3 = 2 THEN NULL ELSE iso END AS iso, CASE k % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'exact' END AS confidence FROM o")
def date_first_line(spark: SparkSession, d: str) -> DataFrame:
    """Bodies with the date in the first line, after a label below it, or nowhere."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    body = F.when(k % 3 == 0, F.concat(F.lit("# "), F.date_format(day, "EEEE, d MMMM yyyy"), F.lit("\n\ntext"))).when(k % 3 == 1, F.concat(F.lit("Note\nDate: "), F.date_format(day, "yyyy-MM-dd"))).otherwise("no date\nnone here")
    o = table(spark, d, "orders").select(k.alias("k"), dates.first_line_date(body).alias("s"))
    return o.select("k", "s.iso", "s.confidence")


@query("date_path", r"""SELECT id, CASE WHEN y <> '' THEN y || '-01-01' END AS iso, CASE WHEN y <> '' THEN 'year' END AS granularity FROM (SELECT id, CASE WHEN regexp_extract(rel_path, '(?:^|/)((?:19|20)\d\d)/[^/]*$', 1) <> '' THEN regexp_extract(rel_path, '(?:^|/)((?:19|20)\d\d)/[^/]*$', 1) ELSE '' END AS y FROM units)""")
def date_path(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "units").select("id", dates.path_date(F.col("rel_path")).alias("s"))
    return u.select("id", "s.iso", "s.granularity")


@query("date_chain")
def date_chain(spark: SparkSession, d: str) -> DataFrame:
    """Each record dated by its first lines (five paragraphs with text hold them), else by its unit's path; notes never."""
    u = table(spark, d, "units").select(F.col("id").alias("ref"), "rel_path")
    r = _records(spark, d).select("ref", "kind", F.array_join(F.slice(F.filter("paragraphs", lambda p: F.trim(p) != ""), 1, 5), "\n").alias("body")).join(u, "ref", "left")
    s = dates.date_chain(F.col("kind"), dates.first_line_date(F.col("body")), dates.path_date(F.coalesce("rel_path", "ref")))
    return r.select("ref", s.alias("s")).select("ref", "s.iso", "s.confidence", "s.granularity", "s.text")


# -- filters, browse, statistics


@query("filter_kind", f"WITH {_R} SELECT ref, title FROM rec WHERE kind = 'manuscript'")
def filter_kind(spark: SparkSession, d: str) -> DataFrame:
    return R.eligible(_records(spark, d), kind="manuscript").select("ref", "title")


@query("filter_period", f"WITH {_R} SELECT ref, iso FROM per WHERE coalesce(period_start <= '2005-03-31' AND period_end >= '2003-01-01', true)")
def filter_period(spark: SparkSession, d: str) -> DataFrame:
    return R.eligible(_records(spark, d), "2003", "2005-03").select("ref", "iso")


@query("browse", f"WITH {_R} SELECT row_number() OVER (ORDER BY unknown, iso, ref) AS place, ref, iso FROM rec ORDER BY place LIMIT 500")
def browse(spark: SparkSession, d: str) -> DataFrame:
    page = R.browse_page(_records(spark, d))
    return S.ranked(page, list(R.BROWSE), "place").select("place", "ref", "iso")


@query("page_hits", f"WITH {_R} SELECT row_number() OVER (ORDER BY unknown, iso, ref) AS place, ref, iso FROM (SELECT * FROM rec WHERE unknown OR iso > '2004-01-01' OR (iso = '2004-01-01' AND ref > 'SRC-000100') ORDER BY unknown, iso, ref LIMIT 100) ORDER BY place")
def page_hits(spark: SparkSession, d: str) -> DataFrame:
    page = R.browse_page(_records(spark, d), (False, "2004-01-01", "SRC-000100"), 100)
    return S.ranked(page, list(R.BROWSE), "place").select("place", "ref", "iso")


@query("by_month", f"WITH {_R} SELECT iso[1:7] AS month, count(*) AS records, CAST(sum(tokens) AS BIGINT) AS tokens FROM rec WHERE NOT unknown GROUP BY 1")
def by_month(spark: SparkSession, d: str) -> DataFrame:
    return R.by_month(_records(spark, d))


@query("paragraph_counts", f"WITH {_P} SELECT ref, count(*) AS paragraphs FROM para GROUP BY ref")
def paragraph_counts(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).groupBy("ref").agg(F.count("*").alias("paragraphs"))


_ALIAS = "al AS (SELECT ref, unnest(list_distinct([title, regexp_extract(ref, '([^/]*?)(?:\\.[^./]*)?$', 1)] || coalesce(aliases, []))) AS name FROM entity_notes), wanted AS (SELECT DISTINCT name FROM al WHERE trim(name) <> '' AND ref IN (SELECT ref FROM al WHERE lower(name) = lower('gniephund')))"


@query("who_expand", f"WITH {_ALIAS} SELECT name FROM wanted")
def who_expand(spark: SparkSession, d: str) -> DataFrame:
    return R.names_for(table(spark, d, "entity_notes"), "gniephund")


@query("who_filter", f"WITH {_P}, {_ALIAS}, t AS (SELECT ref, ' ' || array_to_string({_TOKS.format('text')}, ' ') || ' ' AS s FROM para UNION ALL SELECT ref, ' ' || array_to_string({_TOKS.format('title')}, ' ') || ' ' FROM rec) SELECT DISTINCT t.ref FROM t, (SELECT ' ' || array_to_string({_TOKS.format('name')}, ' ') || ' ' AS s FROM wanted) w WHERE contains(t.s, w.s)")
def who_filter(spark: SparkSession, d: str) -> DataFrame:
    """Records that name a person by any of their names, in title or paragraphs."""
    phrases = [[w for p in T.query_phrases(r["name"]) for w in p] for r in who_expand(spark, d).collect()]  # the names of one person
    r = _records(spark, d)
    texts = _paragraphs(spark, d).select("ref", "text").unionByName(r.select("ref", F.col("title").alias("text")))
    return S.any_phrase(texts, ["ref"], phrases)


# -- search


_DT = "SELECT doc_id, " + _TOKS.format("text") + " AS toks FROM documents"
_DS = "SELECT doc_id, ' ' || array_to_string(toks, ' ') || ' ' AS s, len(toks) AS n, toks FROM (" + _DT + ")"


@query("lexical_and", f"SELECT doc_id FROM ({_DT}) WHERE list_contains(toks, '{_WORDS[0]}') AND list_contains(toks, '{_WORDS[1]}')")
def lexical_and(spark: SparkSession, d: str) -> DataFrame:
    return S.matches(table(spark, d, "documents"), ["doc_id"], [[w] for w in _WORDS]).select("doc_id")


@query("lexical_phrase", f"SELECT doc_id FROM ({_DS}) WHERE contains(s, ' {' '.join(_PHRASE)} ')")
def lexical_phrase(spark: SparkSession, d: str) -> DataFrame:
    return S.matches(table(spark, d, "documents"), ["doc_id"], T.query_phrases(f'"{" ".join(_PHRASE)}"')).select("doc_id")


@query("lexical_filtered", f"SELECT doc_id FROM ({_DT}) WHERE list_contains(toks, '{_WORDS[0]}') AND doc_id IN (SELECT doc_id FROM documents WHERE source = 'mail')")
def lexical_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return S.matches(docs, ["doc_id"], [[_WORDS[0]]]).select("doc_id").join(docs.where("source = 'mail'").select("doc_id"), "doc_id", "left_semi")


def _bm25_sql(inner: str, key: str, words: tuple[str, ...]) -> str:
    """Scores over `inner`, which gives the key, toks and n (their number)."""
    tf = ", ".join(f"len(list_filter(toks, lambda x: x = '{w}')) AS tf{k}" for k, w in enumerate(words))
    n = ", ".join(f"count(*) FILTER (tf{k} > 0) AS n{k}" for k in range(len(words)))
    parts = " + ".join(
        f"(CASE WHEN ln((big - n{k} + 0.5) / (n{k} + 0.5)) <= 0 THEN 1e-6 ELSE ln((big - n{k} + 0.5) / (n{k} + 0.5)) END) * tf{k} * 2.2 / (tf{k} + 1.2 * (0.25 + 0.75 * n / avg_n))" for k in range(len(words))
    )
    return f"SELECT {key}, -({parts}) AS score FROM (SELECT {key}, n, {tf} FROM ({inner})) t, (SELECT count(*) AS big, avg(n) AS avg_n, {n} FROM (SELECT {key}, n, {tf} FROM ({inner})))  s WHERE " + " AND ".join(f"tf{k} > 0" for k in range(len(words)))


@query("bm25_rank", f"SELECT doc_id, round(score, 9) AS score FROM ({_bm25_sql(_DS, 'doc_id', _WORDS)})")
def bm25_rank(spark: SparkSession, d: str) -> DataFrame:
    hits = S.bm25(table(spark, d, "documents"), ["doc_id"], [[w] for w in _WORDS])
    return hits.select("doc_id", F.round("score", 9).alias("score"))


_KNN = "SELECT v.vec_id, sqrt(list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance, v.label FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _query_vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query("knn_topk", f"SELECT vec_id, round(distance, 6) AS distance FROM ({_KNN}) ORDER BY distance, vec_id LIMIT 200")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    k = S.knn(table(spark, d, "embeddings"), ["vec_id"], _query_vector(spark, d))
    return k.select("vec_id", F.round("distance", 6).alias("distance"))


@query("knn_filtered", f"SELECT vec_id, round(distance, 6) AS distance FROM ({_KNN}) WHERE label = 3 ORDER BY distance, vec_id LIMIT 20")
def knn_filtered(spark: SparkSession, d: str) -> DataFrame:
    k = S.knn(table(spark, d, "embeddings").where("label = 3"), ["vec_id"], _query_vector(spark, d), 20)
    return k.select("vec_id", F.round("distance", 6).alias("distance"))


_EV = f"lex AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score, doc_id) AS lex_rank FROM ({_bm25_sql(_DS, 'doc_id', _WORDS)})), sem AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) AS sem_rank FROM (SELECT * FROM ({_KNN}) ORDER BY distance, vec_id LIMIT 200)), fused AS (SELECT coalesce(lex.id, sem.id) AS id, lex_rank, sem_rank, coalesce(1.0 / (60 + lex_rank), 0) + coalesce(1.0 / (60 + sem_rank), 0) AS score FROM lex FULL OUTER JOIN sem ON lex.id = sem.id)"


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lex = S.bm25(table(spark, d, "documents"), ["doc_id"], [[w] for w in _WORDS]).withColumnRenamed("doc_id", "id")
    sem = S.knn(table(spark, d, "embeddings"), ["vec_id"], _query_vector(spark, d)).withColumnRenamed("vec_id", "id")
    return S.ranked(lex, ["score", "id"], "lex_rank").select("id", "lex_rank"), S.ranked(sem, ["distance", "id"], "sem_rank").select("id", "sem_rank")


@query("evidence_union", f"WITH {_EV} SELECT id FROM lex UNION SELECT id FROM sem")
def evidence_union(spark: SparkSession, d: str) -> DataFrame:
    lex, sem = _evidence(spark, d)
    return lex.select("id").union(sem.select("id")).distinct()


@query("rrf_fusion", f"WITH {_EV} SELECT id, lex_rank, sem_rank, round(score, 9) AS score FROM fused")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    lex, sem = _evidence(spark, d)
    return S.fuse(lex, sem, ["id"]).select("id", "lex_rank", "sem_rank", F.round("score", 9).alias("score"))


_PT = f"SELECT ref, idx, toks, len(toks) AS n FROM (SELECT ref, idx, {_TOKS.format('text')} AS toks FROM para)"
_VD = "SELECT v.ref, v.idx, v.vec_id, sqrt(list_sum(list_transform(list_zip(CAST(v.vector AS DOUBLE[]), CAST(q.vector AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS distance FROM para_vectors v, (SELECT vector FROM para_vectors WHERE vec_id = (SELECT min(vec_id) FROM para_vectors WHERE vector IS NOT NULL)) q WHERE v.vector IS NOT NULL"
_HY = f"elig AS (SELECT ref FROM per WHERE kind = 'source' AND coalesce(period_end >= '2001-01-01' AND period_start <= '2009-12-31', true)), lex AS (SELECT ref, idx, row_number() OVER (ORDER BY score, ref, idx) AS lex_rank FROM ({_bm25_sql(_PT, 'ref, idx', _WORDS)}) WHERE ref IN (SELECT ref FROM elig)), sem AS (SELECT ref, idx, row_number() OVER (ORDER BY distance, ref, idx) AS sem_rank FROM (SELECT * FROM (SELECT ref, idx, min(distance) AS distance FROM ({_VD}) GROUP BY ref, idx) WHERE ref IN (SELECT ref FROM elig) ORDER BY distance, ref, idx LIMIT 200)), fused AS (SELECT coalesce(lex.ref, sem.ref) AS ref, coalesce(lex.idx, sem.idx) AS idx, lex_rank, coalesce(1.0 / (60 + lex_rank), 0) + coalesce(1.0 / (60 + sem_rank), 0) AS score FROM lex FULL OUTER JOIN sem ON lex.ref = sem.ref AND lex.idx = sem.idx), roll AS (SELECT ref, arg_max(idx, score - idx * 1e-12) AS best_idx, count(*) AS matches, count(lex_rank) AS lexical_matches, max(score) AS score FROM fused GROUP BY ref)"


def _hybrid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _records(spark, d)
    v = table(spark, d, "para_vectors").where("vector IS NOT NULL")
    q = list(v.agg(F.min_by("vector", "vec_id")).first()[0])
    near = v.select("ref", "idx", F.col("vector").alias("embedding")).dropDuplicates(["ref", "idx"])
    return r, S.hybrid(R.paragraphs_of(r), near, R.eligible(r, "2001", "2009", "source"), [[w] for w in _WORDS], q)


@query("best_paragraph", f"WITH {_P}, {_HY} SELECT ref, best_idx, matches, lexical_matches FROM roll")
def best_paragraph(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d)[1].select("ref", "best_idx", "matches", "lexical_matches")


@query("hybrid_search", f"WITH {_P}, {_HY} SELECT row_number() OVER (ORDER BY round(roll.score, 12) DESC, roll.ref) AS place, roll.ref || ' p' || (best_idx + 1) AS citation, rec.title, matches FROM roll JOIN rec ON roll.ref = rec.ref ORDER BY place LIMIT 100")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The hundred best hits of a query, with their citations."""
    r, hits = _hybrid(spark, d)
    top = hits.withColumn("s", -F.round("score", 12)).orderBy("s", "ref").limit(100).join(r.select("ref", "title"), "ref")
    citation = F.concat_ws(" ", "ref", F.concat(F.lit("p"), F.col("best_idx") + 1))
    return S.ranked(top, ["s", "ref"], "place").select("place", citation.alias("citation"), "title", "matches")


@query("search_header", f"WITH {_P}, {_HY} SELECT count(*) AS records, count(*) FILTER (lexical_matches > 0) AS lexical_records, CAST(sum(matches) AS BIGINT) AS paragraphs, CAST(sum(lexical_matches) AS BIGINT) AS lexical_paragraphs, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) FILTER (unknown) AS undated, count(*) FILTER (confidence = 'inferred') AS inferred FROM roll JOIN rec ON roll.ref = rec.ref")
def search_header(spark: SparkSession, d: str) -> DataFrame:
    return S.header(*_hybrid(spark, d))


_AROUND = _TOKS.format("w")


@query("snippets", f"""WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS words, {_TOKS.format("text")} AS toks FROM documents),
h AS (SELECT doc_id, text, words, coalesce(list_position(list_transform(words, lambda w: list_has_any({_AROUND}, ['{_WORDS[0]}', '{_WORDS[1]}'])), true), 0) AS spot
  FROM t WHERE list_contains(toks, '{_WORDS[0]}') AND list_contains(toks, '{_WORDS[1]}')),
c AS (SELECT *, greatest(spot - 8, 1) AS first FROM h)
SELECT doc_id, CASE WHEN spot = 0 THEN text[1:200] ELSE (CASE WHEN first > 1 THEN '...' ELSE '' END) || array_to_string(list_slice(words, first, first + 31), ' ') || (CASE WHEN first + 32 <= len(words) THEN '...' ELSE '' END) END AS snippet FROM c""")
def snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    phrases = [[w] for w in _WORDS]
    hits = S.matches(docs, ["doc_id"], phrases).select("doc_id")
    return docs.join(hits, "doc_id").select("doc_id", S.snippet(F.col("text"), phrases).alias("snippet"))


@query("hit_lines", f"WITH {_R} SELECT ref, rpad(ref, 16, ' ') || ' ' || CASE WHEN unknown THEN 'undated' WHEN confidence = 'exact' THEN iso ELSE (CASE granularity WHEN 'day' THEN iso WHEN 'month' THEN iso[1:7] ELSE iso[1:4] END) || (CASE WHEN coalesce(date_text, '') <> '' THEN ' (' || date_text || ')' ELSE '' END) END || '  ' || coalesce(title, '') AS line FROM rec WHERE kind = 'source'")
def hit_lines(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).where("kind = 'source'")
    return r.select("ref", F.concat(F.rpad("ref", 16, " "), F.lit(" "), dates.display_date(), F.lit("  "), F.coalesce("title", F.lit(""))).alias("line"))


# -- coverage and plans


_COV = "cov AS (SELECT ref, day_from, day_to FROM rec WHERE kind = 'note' AND note_type = 'digest' AND day_from IS NOT NULL AND coalesce(coverage_complete, false) AND corpus_revision IS NOT DISTINCT FROM (SELECT corpus_revision FROM rec WHERE kind = 'note' AND note_type = 'digest' AND corpus_revision IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AND day_from <= '2012-12-31' AND day_to >= '1998-01-01')"
_CAND = f"WITH {_R}, {_COV}, cand AS (SELECT * FROM rec r WHERE NOT (kind = 'source' AND coalesce(confidence, '') = 'exact' AND NOT unknown AND EXISTS (SELECT 1 FROM cov WHERE r.iso BETWEEN cov.day_from AND cov.day_to)))"


def _covered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The revision that most digests carry stands for the current one."""
    r = _records(spark, d)
    n = r.where("kind = 'note' AND note_type = 'digest' AND corpus_revision IS NOT NULL").groupBy("corpus_revision").count()
    top = n.orderBy(F.desc("count"), "corpus_revision").first()
    return r, P.coverage(r, top["corpus_revision"] if top else None, "1998", "2012")


@query("coverage", f"WITH {_R}, {_COV} SELECT ref, day_from, day_to FROM cov")
def coverage(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, d)[1]


@query("plan_candidates", f"{_CAND} SELECT ref, iso, tokens FROM cand")
def plan_candidates(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_candidates(*_covered(spark, d)).select("ref", "iso", "tokens")


_FOLD_PLAN = """, o AS (SELECT row_number() OVER (ORDER BY unknown, iso, ref) AS i, ref, tokens AS t, CASE WHEN unknown THEN 'unknown' ELSE iso END AS day FROM cand),
b AS (SELECT i, ref, t, CAST(sum(t) OVER (PARTITION BY day) AS BIGINT) AS total, row_number() OVER (PARTITION BY day ORDER BY i) = 1 AS head FROM o),
f AS (SELECT CAST(0 AS BIGINT) AS i, CAST('' AS VARCHAR) AS ref, CAST(0 AS BIGINT) AS t, CAST(0 AS BIGINT) AS spot, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS filled, false AS used
UNION ALL SELECT i, ref, t, spot, n, CASE WHEN large THEN spot + n ELSE spot END, CASE WHEN large THEN 0 WHEN spot > c1 THEN t ELSE f1 + t END, NOT large FROM (
  SELECT *, CASE WHEN large THEN c1 + CAST(u1 AS BIGINT) WHEN total > 8000 AND u1 AND f1 + t > 8000 THEN c1 + 1 ELSE c1 END AS spot, CASE WHEN large THEN CAST(ceil(t / 8000.0) AS BIGINT) ELSE 1 END AS n FROM (
    SELECT b.i, b.ref, b.t, total, total > 8000 AND b.t > 8000 AS large, chunk + CAST(closed AS BIGINT) AS c1, CASE WHEN closed THEN 0 ELSE filled END AS f1, used AND NOT closed AS u1
    FROM (SELECT b.*, f.chunk, f.filled, f.used, b.head AND f.used AND f.filled + b.total > 8000 AS closed FROM f JOIN b ON b.i = f.i + 1) b)))
SELECT spot + k - 1 AS chunk, ref, CAST(k AS INTEGER) AS segment, CAST(n AS INTEGER) AS segments, CAST(greatest(0, least(8000, t - (k - 1) * 8000)) AS BIGINT) AS tokens
FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM f WHERE i > 0)"""


@query("chunk_plan", _CAND.replace("WITH ", "WITH RECURSIVE ", 1) + _FOLD_PLAN)
def chunk_plan(spark: SparkSession, d: str) -> DataFrame:
    return P.chunk_plan(P.plan_candidates(*_covered(spark, d)), 8000)


@query("assignment_slice", f"{_CAND} SELECT ref, iso FROM cand WHERE NOT unknown AND (iso > '2003-05-01' OR (iso = '2003-05-01' AND ref >= 'SRC-000200')) AND (iso < '2006-01-01' OR (iso = '2006-01-01' AND ref <= 'SRC-000300'))")
def assignment_slice(spark: SparkSession, d: str) -> DataFrame:
    return P.plan_slice(P.plan_candidates(*_covered(spark, d)), (False, "2003-05-01", "SRC-000200"), (False, "2006-01-01", "SRC-000300")).select("ref", "iso")


# -- reads


@query("read_record", f"WITH {_P} SELECT ref || ' p' || (idx + 1) AS label, idx, text FROM para WHERE ref = (SELECT min(ref) FROM rec WHERE kind = 'source')")
def read_record(spark: SparkSession, d: str) -> DataFrame:
    ref = _records(spark, d).where("kind = 'source'").agg(F.min("ref")).first()[0]
    return E.read_record(_paragraphs(spark, d), ref)


@query("read_anchor", f"WITH {_LIVE} SELECT unit_id, p, exact_text_hash FROM live WHERE unit_id = 'SRC-000001' AND p = 3 AND retired_v IS NULL")
def read_anchor(spark: SparkSession, d: str) -> DataFrame:
    return E.anchor_order(table(spark, d, "anchors").where("unit_id = 'SRC-000001'")).where("p = 3").select("unit_id", "p", "exact_text_hash")


@query("read_range", f"WITH {_LIVE}, o AS (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY p) AS pos FROM live WHERE unit_id = 'SRC-000001' AND retired_v IS NULL) SELECT unit_id, p, pos, exact_text_hash FROM o WHERE pos >= (SELECT pos FROM o WHERE p = (SELECT min(p) FROM o WHERE p > 4)) AND pos <= (SELECT max(pos) FROM o)")
def read_range(spark: SparkSession, d: str) -> DataFrame:
    """A tail: from the first live anchor above 4 to the end."""
    a = table(spark, d, "anchors")
    first = E.anchor_order(a.where("unit_id = 'SRC-000001'")).where("p > 4").agg(F.min("p")).first()[0]
    return E.read_range(a, "SRC-000001", first if first is not None else 1, None)


@query("read_retired", f"WITH {_LIVE} SELECT unit_id || ' p' || p AS ref, unit_id, p, exact_text_hash, retired_v, unit_id AS pointer FROM live WHERE retired_v IS NOT NULL")
def read_retired(spark: SparkSession, d: str) -> DataFrame:
    return E.read_retired(table(spark, d, "anchors"))


@query("read_pages")
def read_pages(spark: SparkSession, d: str) -> DataFrame:
    return E.read_pages(_records(spark, d))
