"""Queries of the training-text problems (p2 to p10), with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.leakage import find_leaks
from corvane.llm.lookalike import canonical_documents, same_looking_pairs
from corvane.llm.mail import new_lines, new_text
from corvane.llm.mojibake import garbled_slots, repaired_slots
from corvane.llm.names import attribute_names
from corvane.llm.neardup import near_duplicate_classes, near_duplicate_pairs
from corvane.llm.neighbours import neighbour_pairs, neighbour_sample
from corvane.llm.packing import pack_documents
from corvane.llm.splitting import oversized, split_items
from corvane.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _source_records(spark: SparkSession, d: str) -> DataFrame:
    """Source records once each; rows delivered twice differ only in ingested_at."""
    return table(spark, d, "records").where(F.col("kind") == "source")


@query("p2_found", """WITH r AS (SELECT DISTINCT ref, paragraphs FROM records WHERE kind = 'source' AND ref IS NOT NULL AND paragraphs IS NOT NULL),
t AS (SELECT ref, list_filter(string_split_regex(lower(array_to_string(paragraphs, ' ')), '[ \\t\\n]+'), lambda w: w <> '') AS w FROM r),
s AS (SELECT DISTINCT ref, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT ref, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
n AS (SELECT ref, count(*) AS c FROM s GROUP BY ref),
b AS (SELECT x.ref AS ref_lo, y.ref AS ref_hi, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.ref < y.ref GROUP BY x.ref, y.ref)
SELECT ref_lo, ref_hi FROM b JOIN n lo ON lo.ref = ref_lo JOIN n hi ON hi.ref = ref_hi WHERE k >= 0.6 * (lo.c + hi.c - k)""")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    r = _source_records(spark, d).select("ref", "paragraphs")
    return near_duplicate_pairs(r, threshold=0.6, width=3)


@query("p2_classes")
def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each source record's class of equal texts and the number of classes linked to it (5 words, 0.8)."""
    return near_duplicate_classes(_source_records(spark, d).select("ref", "paragraphs"))


_NEAR = """WITH v AS (SELECT DISTINCT vec_id, CAST(vector AS DOUBLE[]) AS x FROM para_vectors WHERE vector IS NOT NULL),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS l FROM v WHERE list_dot_product(x, x) > 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.x, b.x) / (a.l * b.l) AS c FROM n a JOIN n b ON a.vec_id <> b.vec_id),
k AS (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS nth FROM s) WHERE nth <= 5)"""


@query("p3_found", f"{_NEAR} SELECT DISTINCT least(a, b) AS vec_lo, greatest(a, b) AS vec_hi FROM k")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbour_pairs(table(spark, d, "para_vectors"), k=5)


@query("p3_neighbours")
def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five neighbours of every vector whose id is divisible by 20, against all vectors."""
    return neighbour_sample(table(spark, d, "para_vectors"), k=5, every=20)


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return new_lines(table(spark, d, "conversions"))


@query("p4_texts")
def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every mail reduced to the text that its sender wrote."""
    return new_text(table(spark, d, "conversions"))


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    return oversized(table(spark, d, "records"), table(spark, d, "units"), table(spark, d, "project_configs"))


@query("p5_found", """WITH r AS (SELECT DISTINCT ref, paragraphs FROM records WHERE kind = 'source' AND ref IS NOT NULL),
s AS (SELECT ref, ceil(octet_length(encode(array_to_string(paragraphs, chr(10) || chr(10)))) / 4.0) AS size FROM r),
c AS (SELECT DISTINCT project_id, unnest(root_ids) AS root, chunk_tokens FROM project_configs)
SELECT DISTINCT project_id, ref FROM s JOIN units ON units.id = ref JOIN c ON c.root = root_id WHERE size > chunk_tokens""")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_items(_oversized(spark, d), with_text=False).where("piece > 0").select("project_id", "ref").distinct()


@query("p5_pieces")
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized source record of each project."""
    return split_items(_oversized(spark, d))


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled_slots(table(spark, d, "records"), table(spark, d, "units"))


@query("p6_repaired")
def p6_repaired(spark: SparkSession, d: str) -> DataFrame:
    """Every affected title and paragraph with its text restored where it can be."""
    return repaired_slots(table(spark, d, "records"), table(spark, d, "units"))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    a = attribute_names(table(spark, d, "name_mentions"), table(spark, d, "entity_notes"))
    return a.select("mention_id", "entity_ref").distinct()


@query("p8_containers")
def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of each document (or piece of one) at the chunk size of project 3."""
    size = table(spark, d, "project_configs").where("project_id = 3").select("chunk_tokens").first()[0]
    return pack_documents(table(spark, d, "documents"), size)


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    f = find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), n_words=12)
    return f.select("doc_id", "item_id").distinct()


@query("p9_passages")
def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage in common, and those in whose windows of 12 words at least 9 agree in place."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), n_words=12, near=0.67)


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return same_looking_pairs(table(spark, d, "documents"))


@query("p10_canonical")
def p10_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every document's canonical form, case folded."""
    return canonical_documents(table(spark, d, "documents"))
