"""Cutting oversized items at natural boundaries (problem 5).

Method: lexical cohesion. A text is taken as a row of sentences. At every gap between two sentences the
words of the block before and of the block after are compared (cosine of hashed counts, from running
sums, so that the cost does not depend on the block size); valleys of this similarity mark changes of
topic. A valley's depth is how far the similarity climbs on either side; an end of paragraph adds a
bonus. Each piece ends at the deepest valley of its size window, the part of the text where it is
between `fill` of the limit (the overlap, if that is more) and the limit. Where the window holds no gap, the last blank in it is
taken, and where it holds no blank, the last character that fits. The next piece starts so far back
that it shares exactly `overlap` tokens with this one.

Sizes: tokens are the UTF-8 bytes of the paragraphs joined by two line breaks, divided by 4, rounded up.

Defined results: items within the limit, empty ones and null ones have no rows; null paragraphs count
as missing; no character is ever cut; an overlap of the limit or more is lowered to one less than half
the limit; limits below 2 tokens, or null, have no rows; the pieces without their overlaps, joined, are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SENTENCE = re.compile(r"\n\s*\n|(?<=[.!?…;])[\"”’')\]]*\s+|(?<=[。！？])|\n")
_WORD = re.compile(r"[぀-鿿가-힯]|[^\W_]+")
_PLACES = 256


def _gaps(text: str) -> tuple[list[int], list[int]]:
    """Character positions where a sentence may begin, and for each whether a paragraph ended there."""
    at, ends = [], []
    for m in _SENTENCE.finditer(text):
        if 0 < m.end() < len(text):
            at.append(m.end())
            ends.append(2 if m.group().count("\n") > 1 else int("\n" in m.group()))
    return at, ends


def valleys(text: str, block: int = 4, bonus: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Gaps (character positions) and how good each is as a cut."""
    at, ends = _gaps(text)
    if not at:
        return np.empty(0, dtype=np.int64), np.empty(0)
    edge = [0, *at, len(text)]
    rows, cols = [], []
    for k in range(len(edge) - 1):
        words = _WORD.findall(text[edge[k] : edge[k + 1]].lower())
        rows += [k] * len(words)
        cols += words
    n = len(edge) - 1
    total = np.zeros((n + 1, _PLACES), dtype=np.float32)
    if cols:
        codes, kinds = pd.factorize(np.array(cols, dtype=object))
        place = (pd.util.hash_array(np.asarray(kinds, dtype=object), categorize=False) % _PLACES).astype(np.int64)
        np.add.at(total, (np.array(rows) + 1, place[codes]), 1)
    run = np.cumsum(total, axis=0)
    gap = np.arange(1, n)
    before = run[gap] - run[np.maximum(gap - block, 0)]
    after = run[np.minimum(gap + block, n)] - run[gap]
    norm = np.linalg.norm(before, axis=1) * np.linalg.norm(after, axis=1)
    alike = (before * after).sum(axis=1) / np.where(norm == 0, 1, norm)
    # height of the nearest peaks: the highest similarity within a block on either side
    reach = np.lib.stride_tricks.sliding_window_view(np.pad(alike, block, constant_values=0), block + 1)
    left, right = reach[: len(alike)].max(axis=1), reach[block : block + len(alike)].max(axis=1)
    return np.array(at), (left - alike) + (right - alike) + bonus * np.array(ends)


def pieces(text: str, limit: int, overlap: int, fill: float = 0.5) -> list[tuple[int, int, int, str]]:
    """(start, end, new_from, cut) in characters; [start, new_from) is shared with the piece before."""
    most = 4 * limit
    overlap = min(overlap, (limit - 1) // 2) if overlap >= limit else overlap
    size = np.concatenate([[0], np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in text])]) if not text.isascii() else np.arange(len(text) + 1)
    gap, worth = valleys(text)
    out, start, new = [], 0, 0
    while True:
        end = int(np.searchsorted(size, size[start] + most, side="right")) - 1
        if end >= len(text):
            out.append((start, len(text), new, "end"))
            return out
        least = max(new + 1, int(np.searchsorted(size, size[start] + max(fill * most, 4 * overlap))))
        a, b = np.searchsorted(gap, least), np.searchsorted(gap, end, side="right")
        if a < b:
            cut, kind = int(gap[a + int(np.argmax(worth[a:b]))]), "valley"
        else:
            blank = next((k for k in range(end, least - 1, -1) if text[k - 1].isspace()), 0)
            cut, kind = (blank, "blank") if blank else (max(end, new + 1), "character")
        out.append((start, cut, new, kind))
        back = int(np.searchsorted(size, size[cut] - 4 * overlap)) if overlap else cut
        start, new = min(max(back, start), cut), cut


def oversized(records: DataFrame, units: DataFrame, configs: DataFrame) -> DataFrame:
    """(project_id, ref, paragraphs, chunk_tokens, overlap_tokens): source records too large for a project of their root.

    The size is a column expression over the scan, so that only oversized records are shuffled.
    """
    joined = F.array_join(F.col("paragraphs"), "\n\n")
    size = F.ceil(F.octet_length(joined) / 4)
    r = records.where((F.col("kind") == "source") & F.col("ref").isNotNull()).select("ref", "paragraphs", size.alias("size"))
    c = configs.select("project_id", F.explode("root_ids").alias("root"), "chunk_tokens", "overlap_tokens").distinct()
    c = c.where(F.col("chunk_tokens") >= 2)
    u = units.select(F.col("id").alias("ref"), F.col("root_id").alias("root")).distinct()
    least = c.agg(F.min("chunk_tokens")).first()[0]
    r = r.where(F.col("size") > F.lit(least)).join(u, "ref")
    j = r.join(c, "root").where(F.col("size") > F.col("chunk_tokens"))
    return j.select("project_id", "ref", "paragraphs", "chunk_tokens", F.coalesce("overlap_tokens", F.lit(0)).alias("overlap_tokens")).dropDuplicates(["project_id", "ref"])


def split_items(items: DataFrame, fill: float = 0.5, with_text: bool = True) -> DataFrame:
    """(project_id, ref, piece, char_from, char_to, new_from, cut, text): the pieces of oversized()'s rows."""
    schema = "project_id int, ref string, piece int, char_from int, char_to int, new_from int, cut string, text string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                text = "\n\n".join(p for p in r.paragraphs if p is not None)
                for k, (s, e, new, cut) in enumerate(pieces(text, r.chunk_tokens, r.overlap_tokens, fill)):
                    rows.append((r.project_id, r.ref, k, s, e, new, cut, text[s:e] if with_text else None))
            yield pd.DataFrame(rows, columns=["project_id", "ref", "piece", "char_from", "char_to", "new_from", "cut", "text"])

    return items.mapInPandas(run, schema)
