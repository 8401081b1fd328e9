"""Near-duplicate records with small edits (problem 2).

Method: a multi-index Hamming join. A record's signature is a b-bit vector (b = 2**61) with one set bit
per distinct run of `width` words, kept as the sorted list of set bits; the Hamming distance of two
signatures is the number of runs that only one of them has. For a similarity (intersection over union)
of at least t and n set bits, at most e = n - ceil(t * n) of the bits may be missing in the partner.
By the pigeonhole principle, of any e + 1 disjoint chunks of the bits one arrives without error. Chunks
are allotted by cost: every bit is a chunk of its own, the e + 1 rarest bits get the error allowance 0
and are indexed, all others are skipped (allowance -1). Both sides use one global order of the bits, so
a pair under the threshold shares an indexed chunk for certain. No pair is lost, at any size. The smaller
of two records may miss only n - ceil(2t / (1 + t) * n) bits and is indexed by fewer chunks; the places of
a shared chunk in both orders bound the overlap that can follow.

Candidates travel with a second, dense signature of 384 bits, one bit of each of 384 minwise hashes, and the
join itself drops pairs whose dense distance is too large: at similarity t a bit differs with probability
(1 - t) / 2, whatever the size of the records, and the distance exceeds its mean by 6.5 deviations with a
probability below 1e-10. What is left is checked exactly.

Why the dense signature is not the one that is cut into chunks: at a similarity of 0.6 a fifth of its bits differ
(128 bits: 26 of 128 where unrelated records differ in 64), so the pigeonhole needs chunks of 4 bits or
hundreds of thousands of enumerated errors per chunk, and either way meets nearly every pair.

Scale: records with one and the same signature collapse to one class before the join, so a group of
copies, however large, is indexed once. Bit frequencies come from all records as a histogram of fixed
size (2**20 counters), the only thing that is broadcast. Chunks that many classes share are joined by
Spark's skew-splitting sort-merge join.

Defined results: null paragraphs count as missing; records with fewer than `width` words have no runs
and no partner; rows delivered twice count once; similarity is symmetric and groups are not closed over
chains.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage, spread

_GAP = re.compile(r"[ \t\n]+")
_WORDS = 6  # 64-bit words of a dense signature
_COUNTERS = 1 << 20
_MASK = np.uint64((1 << 61) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def signatures(paragraph_lists, width: int) -> list[np.ndarray]:
    """Sorted set bits of each record, computed over a whole batch at once."""
    split = [
        [w for w in _GAP.split(" ".join(p for p in ps if p is not None).lower()) if w] if ps is not None else []
        for ps in paragraph_lists
    ]
    lengths = np.array([len(s) for s in split], dtype=np.int64)
    flat = [w for s in split for w in s]
    if not flat:
        return [np.empty(0, dtype=np.int64) for _ in split]
    codes, kinds = pd.factorize(np.array(flat, dtype=object))
    code = pd.util.hash_array(np.asarray(kinds, dtype=object), categorize=False)[codes]
    h = np.zeros(max(0, len(code) - width + 1), dtype=np.uint64)
    for k in range(width):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + code[k : len(code) - width + 1 + k] + np.uint64(k + 1))
    h = (h & _MASK).astype(np.int64)
    out, at = [], 0
    for n in lengths:
        out.append(np.unique(h[at : at + n - width + 1]) if n >= width else np.empty(0, dtype=np.int64))
        at += n
    return out


_RANDOM = np.random.default_rng(20240229)
_MULTIPLY = _RANDOM.integers(0, 1 << 32, 64 * _WORDS, dtype=np.uint32) | np.uint32(1)
_ADD = _RANDOM.integers(0, 1 << 32, 64 * _WORDS, dtype=np.uint32)


def _dense(bits: np.ndarray) -> np.ndarray:
    """One bit of each of 64 * _WORDS minwise hashes of the set bits."""
    h = _mix(bits.astype(np.uint64))
    h = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(64 * _WORDS, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(h), 512):
        part = h[start : start + 512, None] * _MULTIPLY + _ADD
        np.minimum(least, part.min(axis=0), out=least)
    one = (least * np.uint32(0x9E3779B1)) >> np.uint32(31)
    return np.packbits(one.astype(np.uint8)).view(">u8").astype(np.int64)


def signature_table(records: DataFrame, width: int, key: str = "ref", paragraphs: str = "paragraphs") -> DataFrame:
    """(ref, hash, n, bits): the signature of each record and a hash of the whole signature."""
    r = records.select(F.col(key).alias("ref"), F.col(paragraphs).alias("ps")).where("ref IS NOT NULL AND ps IS NOT NULL")

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1000):  # the words of so many records are held at once
                b = batch.iloc[start : start + 1000]
                bits = signatures(b["ps"].values, width)
                name = [hashlib.blake2b(x.tobytes(), digest_size=16).hexdigest() for x in bits]
                yield pd.DataFrame({"ref": b["ref"].values, "hash": name, "n": [len(x) for x in bits], "bits": bits}).query("n > 0")

    return spread(r).mapInPandas(sign, "ref string, hash string, n int, bits array<bigint>")


def bit_frequencies(classes: DataFrame) -> np.ndarray:
    """How often bits occur, in a histogram of fixed size over all classes (bits are hashed to its counters)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_COUNTERS, dtype=np.int64)
        for b in batches:
            for start in range(0, len(b), 4000):
                total += np.bincount(np.concatenate(b["bits"].values[start : start + 4000]) % _COUNTERS, minlength=_COUNTERS)
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"counter": at.astype(np.int32), "n": total[at]})

    h = classes.select("bits").mapInPandas(count, "counter int, n bigint").groupBy("counter").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_COUNTERS, dtype=np.int64)
    out[h["counter"].values] = h["n"].values
    return out


_NAMES = [f"s{k}" for k in range(_WORDS)]


def with_dense(classes: DataFrame) -> DataFrame:
    """The classes with their dense signatures in columns s0, s1, ..."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                d = np.stack([_dense(np.asarray(x)) for x in b["bits"].values])
                yield b.assign(**{name: d[:, k] for k, name in enumerate(_NAMES)})

    return classes.mapInPandas(add, ", ".join([f"{n} {t}" for n, t in classes.dtypes] + [f"{x} bigint" for x in _NAMES]))


def hamming_join(classes: DataFrame, threshold: float) -> DataFrame:
    """(class_a, class_b, similarity), class_a < class_b: all pairs at the threshold or above.

    classes has class_id (bigint), n, bits and the dense signatures of with_dense().
    """
    spark = classes.sparkSession
    freq = spark.sparkContext.broadcast(bit_frequencies(classes))
    names = _NAMES

    def chunks(batches: Iterator[pd.DataFrame], share: float) -> Iterator[pd.DataFrame]:
        f = freq.value
        for batch in batches:
            for start in range(0, len(batch), 1000):
                b = batch.iloc[start : start + 1000]
                all_bits = [np.asarray(x) for x in b["bits"].values]
                rare = []
                for bits in all_bits:
                    allowed = len(bits) - int(np.ceil(share * len(bits) - 1e-9))
                    rare.append(bits[np.lexsort((bits, f[bits % _COUNTERS]))[: allowed + 1]])
                times = [len(r) for r in rare]
                out = {"chunk": np.concatenate(rare), "id": np.repeat(b["class_id"].values, times), "n": np.repeat(b["n"].values, times)}
                out["rank"] = np.concatenate([np.arange(t, dtype=np.int32) for t in times])
                yield pd.DataFrame(out | {name: np.repeat(b[name].values, times) for name in names})

    schema = "chunk bigint, id bigint, n int, rank int, " + ", ".join(f"{x} bigint" for x in names)
    # the smaller of the two may miss fewer bits than the larger, and needs fewer chunks
    rows = classes.select("class_id", "n", "bits", *names)
    a = rows.mapInPandas(lambda x: chunks(x, 2 * threshold / (1 + threshold)), schema).alias("a")
    b = rows.mapInPandas(lambda x: chunks(x, threshold), schema).alias("b")
    na, nb = F.col("a.n"), F.col("b.n")
    smaller = (na < nb) | ((na == nb) & (F.col("a.id") < F.col("b.id")))
    need = F.ceil(F.lit(threshold / (1 + threshold)) * (na + nb) - 1e-9)
    places, differ = 64 * _WORDS, (1 - threshold) / 2
    limit = int(places * differ + 6.5 * math.sqrt(places * differ * (1 - differ)))
    distance = sum((F.bit_count(F.col(f"a.{x}").bitwiseXOR(F.col(f"b.{x}"))) for x in names), F.lit(0))
    pairs = (
        a.join(b, (F.col("a.chunk") == F.col("b.chunk")) & smaller & (na >= nb * threshold))
        .where((F.col("a.rank") <= na - need) & (F.col("b.rank") <= nb - need) & (distance <= limit))
        .select(F.least("a.id", "b.id").alias("class_a"), F.greatest("a.id", "b.id").alias("class_b"))
        .distinct()
    )
    bits = classes.select("class_id", "n", "bits")
    pairs = pairs.join(bits.select(F.col("class_id").alias("class_a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "class_a")
    pairs = pairs.join(bits.select(F.col("class_id").alias("class_b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "class_b")
    both = F.size(F.array_intersect("ba", "bb"))
    pairs = pairs.select("class_a", "class_b", (both / (F.col("na") + F.col("nb") - both)).alias("similarity"))
    return pairs.where(F.col("similarity") >= threshold - 1e-12)


def _classes(records: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """(ref, class_id) and (class_id, n, bits); class ids are numbers given once and written down."""
    s = cut_lineage(signature_table(records, width))
    classes = s.groupBy("hash").agg(F.first("n").alias("n"), F.first("bits").alias("bits"))
    classes = cut_lineage(with_dense(classes.select(F.monotonically_increasing_id().alias("class_id"), "hash", "n", "bits")))
    members = s.select("ref", "hash").distinct().join(classes.select("hash", "class_id"), "hash")
    return members.select("ref", "class_id"), classes.drop("hash")


def near_duplicate_pairs(records: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(ref_lo, ref_hi): all pairs of different records at the threshold or above, copies included."""
    members, classes = _classes(records, width)
    links = hamming_join(classes, threshold).select("class_a", "class_b")
    own = members.groupBy("class_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    a = members.select(F.col("class_id").alias("class_a"), F.col("ref").alias("ra"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("ref").alias("rb"))
    pairs = links.unionByName(own).join(a, "class_a").join(b, "class_b")
    pairs = pairs.where((F.col("class_a") != F.col("class_b")) | (F.col("ra") < F.col("rb"))).where("ra <> rb")
    return pairs.select(F.least("ra", "rb").alias("ref_lo"), F.greatest("ra", "rb").alias("ref_hi")).distinct()


def near_duplicate_classes(records: DataFrame, threshold: float = 0.8, width: int = 5) -> DataFrame:
    """(ref, class_id, n_links): each record's class of equal signatures and that class's number of linked classes."""
    members, classes = _classes(records, width)
    links = hamming_join(classes, threshold)
    ends = links.select(F.col("class_a").alias("class_id")).unionAll(links.select(F.col("class_b").alias("class_id")))
    n = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    return members.join(n, "class_id", "left").select("ref", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
