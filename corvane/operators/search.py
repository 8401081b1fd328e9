"""Full-text, vector and fused search.

Postings are built only for the terms of a query: the scan tokenises each text once and keeps the
positions of query terms, so that nothing but matching rows is shuffled. Corpus statistics (documents,
average length, documents per phrase) are taken over all rows before any filter is applied.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.let import bind, let

K1, B = 1.2, 0.75
RRF = 60


def tokenised(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Key columns and `toks`, computed once per row."""
    return let(docs, toks=T.tokens(text)).select(*key, "toks")


def padded(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Key columns, `len` and `padded`: the tokens, each between two blanks of its own, in one string."""
    t = let(docs, toks=T.tokens(text))
    return let(t, padded=F.concat(F.lit(" "), F.array_join("toks", "  "), F.lit(" ")), len=F.size("toks")).select(*key, "len", "padded")


def _needle(phrase: list[str]) -> str:
    return " " + "  ".join(phrase) + " "


def _holds(phrase: list[str]) -> Column:
    return F.contains("padded", F.lit(_needle(phrase))) if phrase else F.lit(False)


def _frequency(phrase: list[str]) -> Column:
    """How often a phrase occurs; occurrences may overlap. Texts without it are told apart by a plain search."""
    return F.when(_holds(phrase), F.regexp_count("padded", F.lit(f"(?={_needle(phrase)})"))).otherwise(0) if phrase else F.lit(0)


def matches(docs: DataFrame, key: list[str], phrases: list[list[str]], text: str = "text") -> DataFrame:
    """Key and tf0, tf1, ... of texts that hold every phrase; none where a phrase has no token."""
    t = padded(docs, key, text)
    t = t.where(reduce(lambda a, b: a & b, [_holds(p) for p in phrases], F.lit(bool(phrases))))
    return t.select(*key, *[_frequency(p).alias(f"tf{k}") for k, p in enumerate(phrases)])


def any_phrase(docs: DataFrame, key: list[str], phrases: list[list[str]], text: str = "text") -> DataFrame:
    """Keys of texts that hold at least one phrase; phrases without a token are left out."""
    t = padded(docs, key, text)
    return t.where(reduce(lambda a, b: a | b, [_holds(p) for p in phrases], F.lit(False))).select(*key).distinct()


def bm25(docs: DataFrame, key: list[str], phrases: list[list[str]], text: str = "text") -> DataFrame:
    """Key and score (lower is better) of texts that hold every phrase.

    idf = ln((N - n + 0.5) / (n + 0.5)), at least 1e-6; n and tf count phrases; statistics over all texts.
    """
    if not phrases or any(not p for p in phrases):
        return matches(docs, key, phrases, text).select(*key, F.lit(0.0).alias("score"))
    t = padded(docs, key, text)
    t = let(t, **{f"tf{k}": _frequency(p) for k, p in enumerate(phrases)}).drop("padded")
    stats = t.agg(
        F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"n{k}") for k in range(len(phrases))]
    )
    hit = t.where(reduce(lambda a, b: a & b, [F.col(f"tf{k}") > 0 for k in range(len(phrases))]))
    hit = hit.crossJoin(F.broadcast(stats))  # one row
    length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("len") / F.col("avg_len"))
    parts = []
    for k in range(len(phrases)):
        n, tf = F.col(f"n{k}"), F.col(f"tf{k}")
        idf = F.log((F.col("n_docs") - n + 0.5) / (n + 0.5))
        parts.append(F.when(idf <= 0, 1e-6).otherwise(idf) * tf * (K1 + 1) / (tf + length))
    return hit.select(*key, (-reduce(lambda a, b: a + b, parts)).alias("score"))


def l2(vector: Column, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(x)) for x in query])
    return F.sqrt(F.aggregate(F.zip_with(vector, q, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, v: a + v))


def knn(vectors: DataFrame, key: list[str], query: list[float], k: int = 200, vector: str = "embedding") -> DataFrame:
    """Key and distance of the k nearest rows that have a vector of the query's length; ties by key.

    Filters belong before this call: a row that is filtered out takes no place. Each task keeps k rows.
    """
    v = vectors.where(F.col(vector).isNotNull() & (F.size(vector) == len(query)))
    return v.select(*key, l2(F.col(vector), query).alias("distance")).orderBy("distance", *key).limit(k)


def ranked(hits: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Rank from 1 in a total order of already filtered hits (one task: hits, never the corpus)."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def fuse(lexical: DataFrame, semantic: DataFrame, key: list[str]) -> DataFrame:
    """Reciprocal rank fusion of (key, lex_rank) and (key, sem_rank): key, both ranks and score."""
    j = lexical.join(semantic, key, "full_outer")
    part = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    return j.select(*key, "lex_rank", "sem_rank", (part("lex_rank") + part("sem_rank")).alias("score"))


def by_record(fused: DataFrame) -> DataFrame:
    """(ref, best_idx, matches, lexical_matches, score): paragraphs rolled up to records, the best one lowest in idx."""
    best = F.max_by("idx", F.struct("score", -F.col("idx")))
    return fused.groupBy("ref").agg(best.alias("best_idx"), F.count("*").alias("matches"), F.count("lex_rank").alias("lexical_matches"), F.max("score").alias("score"))


def hybrid(paragraphs: DataFrame, vectors: DataFrame, eligible: DataFrame, phrases: list[list[str]], query_vector: list[float], k: int = 200) -> DataFrame:
    """Fused records for a query over (ref, idx, text) and (ref, idx, embedding), among eligible refs."""
    refs = eligible.select("ref")
    lex = bm25(paragraphs, ["ref", "idx"], phrases).join(refs, "ref", "left_semi")
    lex = ranked(lex, ["score", "ref", "idx"], "lex_rank").select("ref", "idx", "lex_rank")
    sem = knn(vectors.join(refs, "ref", "left_semi"), ["ref", "idx"], query_vector, k)
    sem = ranked(sem, ["distance", "ref", "idx"], "sem_rank").select("ref", "idx", "sem_rank")
    return by_record(fuse(lex, sem, ["ref", "idx"]))


def header(records: DataFrame, hits: DataFrame) -> DataFrame:
    """One row of exact totals over the records hit."""
    return totals(records.join(hits, "ref"))


def totals(found: DataFrame) -> DataFrame:
    """One row of exact totals over records with their matches and lexical_matches."""
    return found.agg(
        F.count("*").alias("records"),
        F.count_if(F.col("lexical_matches") > 0).alias("lexical_records"),
        F.coalesce(F.sum("matches"), F.lit(0)).alias("paragraphs"),
        F.coalesce(F.sum("lexical_matches"), F.lit(0)).alias("lexical_paragraphs"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count_if("unknown").alias("undated"),
        F.count_if(F.col("record_date.confidence") == "inferred").alias("inferred"),
    )


def snippet(text: Column, phrases: list[list[str]], width: int = 32) -> Column:
    """Words around the first query term, with ellipses; the first 200 characters where no term occurs."""
    terms = F.array(*[F.lit(w) for p in phrases for w in p]) if any(phrases) else F.array().cast("array<string>")

    def around(words: Column) -> Column:
        hits = F.transform(words, lambda w: F.arrays_overlap(T.tokens(w), terms))
        return bind(F.array_position(hits, F.lit(True)), lambda at: cut(words, at))

    def cut(words: Column, at: Column) -> Column:
        start = F.greatest(at.cast("int") - width // 4, F.lit(1))
        pre, post = F.when(start > 1, "...").otherwise(""), F.when(start + width <= F.size(words), "...").otherwise("")
        part = F.array_join(F.slice(words, start, F.lit(width)), " ")
        return F.when(F.coalesce(at, F.lit(0)) == 0, F.substring(text, 1, 200)).otherwise(F.concat(pre, part, post))

    return bind(F.filter(F.split(text, r"\s+"), lambda w: w != ""), around)


def embedded(paragraphs: DataFrame, known: DataFrame | None, embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """(ref, idx, text_hash, embedding) of (ref, idx, text); equal texts and those known by (text_hash, embedding) are embedded once.

    embed makes vectors of a list of texts; it must give as many vectors as texts, all of one length.
    """
    p = paragraphs.select("ref", "idx", "text", F.sha2("text", 256).alias("text_hash"))
    fresh = p.select("text_hash", "text").dropDuplicates(["text_hash"])
    if known is not None:
        fresh = fresh.join(known, "text_hash", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), batch):
                part = b.iloc[start : start + batch]
                vectors = embed(part["text"].tolist())
                if len(vectors) != len(part) or len({len(v) for v in vectors}) > 1:
                    raise ValueError("the embedder must give one vector of one length for each text")
                yield pd.DataFrame({"text_hash": part["text_hash"].values, "embedding": vectors})

    vectors = fresh.mapInPandas(run, "text_hash string, embedding array<float>")
    if known is not None:
        vectors = vectors.unionByName(known.select("text_hash", "embedding"))
    return p.drop("text").join(vectors, "text_hash").select("ref", "idx", "text_hash", "embedding")


def hashing_embedder(text: str, dim: int = 96) -> list[float]:
    """A deterministic unit vector of a text's words, where no model is at hand."""
    import zlib

    v = [0.0] * dim
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        v[h % dim] += 1.0 if h & (1 << 20) else -1.0
    n = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / n for x in v]
