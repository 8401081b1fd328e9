"""Evaluation texts inside training text (problem 9).

Method: a positional inverted index over the training tokens, sharded by document. Each shard (an Arrow
batch of documents) stores, for the terms of the test material, the positions at which they stand. For
every window of the test items the rarest of its terms is looked up, its list is shifted by the term's
offset in the window, and the shifted list is intersected with those of the window's other terms, next
rarest first. What remains are exact phrases; runs are then stretched as far as both texts agree. Hits
that agree in most words around an anchor, but in no run of the full length, are proximity matches.

Sharding by document needs no shuffle: only the test material is sent out. It is sent in blocks of a
checked size (block_bytes), so larger test sets take more passes, not more memory.

Defined results: null and empty texts match nothing; items or documents of fewer than n_words words
match nothing; repeated rows give one row; every item that a document holds is reported.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.lookalike import canonical
from corvane.session import spread

_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Runs of letters and digits of the canonical, case-folded text."""
    return _WORD.findall(canonical(text, fold=True)) if text else []


class _Items:
    """Test items as term numbers, laid end to end with gaps that match nothing."""

    def __init__(self, items: list[tuple[int, str]], n_words: int):
        self.terms: dict[str, int] = {}
        flat, owner, place = [], [], []
        for item, text in items:
            w = words(text)
            if len(w) < n_words:
                continue
            flat += [self.terms.setdefault(x, len(self.terms)) for x in w] + [-1] * n_words
            owner += [item] * (len(w) + n_words)
            place += [*range(len(w)), *[-1] * n_words]
        lead = [-1] * n_words
        self.flat = np.array(lead + flat, dtype=np.int32)
        self.owner = np.array(lead + owner, dtype=np.int64)
        self.place = np.array(lead + place, dtype=np.int32)
        ok = self.place >= 0
        whole = np.convolve(ok, np.ones(n_words, dtype=int), "valid") == n_words
        self.starts = np.nonzero(whole)[0]


def _shard_matches(texts: list[str], items: _Items, n_words: int, near: float) -> list[tuple]:
    """(document's place in the shard, item, kind, document word, item word, words) of one shard."""
    flat, owner, place = [np.full(n_words, -2, dtype=np.int32)], [np.full(n_words, -1)], [np.full(n_words, -1)]
    get = items.terms.get
    for k, t in enumerate(texts):
        w = words(t)
        if len(w) < n_words:
            continue
        ids = np.fromiter((get(x, -2) for x in w), dtype=np.int32, count=len(w))
        flat += [ids, np.full(n_words, -2, dtype=np.int32)]
        owner += [np.full(len(w) + n_words, k)]
        place += [np.arange(len(w)), np.full(n_words, -1)]
    if len(flat) == 1 or not len(items.starts):
        return []
    tokens, owner, place = np.concatenate(flat), np.concatenate(owner), np.concatenate(place)
    # the postings: positions by term, and where each term's list begins
    held = np.nonzero(tokens >= 0)[0]
    order = held[np.argsort(tokens[held], kind="stable")]
    count = np.bincount(tokens[held], minlength=len(items.terms))
    begin = np.concatenate([[0], np.cumsum(count)])
    # each window's terms, rarest first; a window with a term that the shard lacks can't be here
    grid = items.starts[:, None] + np.arange(n_words)
    freq = count[items.flat[grid]]
    possible = freq.min(axis=1) > 0
    passages = _near_passages(tokens, owner, place, order, begin, count, grid, freq, items, n_words, near) if near else []
    grid, freq = grid[possible], freq[possible]
    anchors = np.unique(grid[np.arange(len(grid)), freq.argmin(axis=1)]) if len(grid) else []
    reach = np.arange(-(n_words - 1), n_words)
    out: dict[tuple, tuple] = {}
    for a in anchors:
        term = items.flat[a]
        at = order[begin[term] : begin[term + 1]]  # shifted by the anchor's offset: at - a aligns both texts
        if not len(at):
            continue
        want = items.flat[a + reach]
        # the next rarest terms around the anchor first
        real = np.nonzero((want >= 0) & (reach != 0))[0]
        if len(real):
            second = real[np.argsort(count[want[real]], kind="stable")]
            # a run has n_words - 1 of them; one more than can disagree is tested
            tested = len(real) - (n_words - 1) + 1
            hits = np.zeros(len(at), dtype=np.int32)
            for r in second[:tested]:
                hits += tokens[at + reach[r]] == want[r]
            at = at[hits > 0]
        same = (tokens[at[:, None] + reach] == want) & (want >= 0)
        mid = n_words - 1
        right = np.cumprod(same[:, mid:], axis=1).sum(axis=1)
        left = np.cumprod(same[:, mid::-1], axis=1).sum(axis=1)
        for i in np.nonzero(left + right - 1 >= n_words)[0]:
            p, q = int(at[i]) - int(left[i]) + 1, int(a) - int(left[i]) + 1
            while tokens[p - 1] >= 0 and tokens[p - 1] == items.flat[q - 1]:
                p, q = p - 1, q - 1
            n = 0
            while p + n < len(tokens) and q + n < len(items.flat) and tokens[p + n] >= 0 and tokens[p + n] == items.flat[q + n]:
                n += 1
            key = (int(owner[p]), int(items.owner[q]), "exact", int(place[p]), int(items.place[q]))
            out[key] = (*key, n)
    return [*out.values(), *passages]


def _near_passages(tokens, owner, place, order, begin, count, grid, freq, items: _Items, n_words: int, near: float) -> list[tuple]:
    """The near rows of one shard; grid and freq hold the places and counts of each window's terms."""
    need = min(n_words, max(1, math.ceil(near * n_words - 1e-9)))
    spare = n_words - need
    kept = (freq > 0).sum(axis=1) >= need  # terms that the shard lacks can't agree
    grid, freq = grid[kept], freq[kept]
    if not len(grid):
        return []
    rarest = np.argsort(freq, axis=1, kind="stable")[:, : spare + 1]
    anchors = np.unique(np.take_along_axis(grid, rarest, axis=1))
    hits = count[items.flat[anchors]]
    reach = np.arange(-(n_words - 1), n_words)
    whole = np.zeros(len(items.flat) + n_words, dtype=bool)
    whole[items.starts] = True
    ends = np.cumsum(hits)
    size = len(items.flat) + len(tokens)
    windows = []
    lo = 0
    while lo < len(anchors):  # anchors by blocks of bounded postings; one term's list is the least
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 100_000, "right")))
        a = np.repeat(anchors[lo:hi], hits[lo:hi])
        first = np.repeat(begin[items.flat[anchors[lo:hi]]], hits[lo:hi])
        at = order[first + np.arange(len(a)) - np.repeat(ends[lo:hi] - hits[lo:hi] - (ends[lo - 1] if lo else 0), hits[lo:hi])]
        lo = hi
        want = items.flat[a[:, None] + reach]
        same = (tokens[at[:, None] + reach] == want) & (want >= 0)
        enough = same.sum(axis=1) >= need
        a, at, same = a[enough], at[enough], same[enough]
        sums = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1, dtype=np.int32)
        good = (sums[:, n_words:] - sums[:, :-n_words] >= need) & whole[a[:, None] + reach[:n_words]]
        row, col = np.nonzero(good)
        # an alignment is the difference of both places, a window its first item place
        windows.append((at[row] - a[row] + len(items.flat)) * size + a[row] + reach[col])
    found = np.unique(np.concatenate(windows))
    if not len(found):
        return []
    shift, start = found // size - len(items.flat), found % size
    new = np.nonzero(np.diff(found, prepend=found[0] - 2 * size) > n_words)[0]
    out = []
    for x, y in zip(new, [*new[1:], len(found)]):
        q = np.arange(start[x], start[y - 1] + n_words)
        p = q + shift[x]
        inside = (p >= 0) & (p < len(tokens))
        q, p = q[inside], p[inside]
        agree = np.nonzero((tokens[p] == items.flat[q]) & (tokens[p] >= 0))[0]
        n = len(agree)
        if agree[-1] - agree[0] + 1 == n >= n_words:
            continue  # nothing but an exact run
        p, q = p[agree[0]], q[agree[0]]
        out.append((int(owner[p]), int(items.owner[q]), "near", int(place[p]), int(items.place[q]), n))
    return out


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    n_words: int = 12,
    near: float = 0.0,
    doc_id: str = "doc_id",
    text: str = "text",
    block_bytes: int = 32_000_000,
    shard_docs: int = 2000,
) -> DataFrame:
    """(doc_id, item_id, kind, doc_word, item_word, n_words): passages of items in documents.

    kind "exact": a maximal run of at least n_words words in common. kind "near" (only if near > 0): a
    maximal row of windows of n_words item words, overlapping or touching, in each of which at least
    near * n_words words agree in place; from its first to its last word that agrees, with the number of
    those that agree. Where it is nothing but an exact run it has no row of its own.
    The items are sent out in blocks of block_bytes of text; each block is one pass over the documents.
    """
    i = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("t")).where(F.col("t").isNotNull()).distinct()
    total = i.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    d = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    d = spread(d)
    schema = "doc_id bigint, item_id bigint, kind string, doc_word int, item_word int, n_words int"
    found = None
    for b in range(blocks):
        own = i if blocks == 1 else i.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        index = _Items([(r[0], r[1]) for r in own.collect()], n_words)
        sent = documents.sparkSession.sparkContext.broadcast(index)

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for s in range(0, len(batch), shard_docs):
                    ids = batch["doc_id"].values[s : s + shard_docs]
                    rows = _shard_matches(batch["t"].values[s : s + shard_docs], sent.value, n_words, near)
                    if rows:
                        f = pd.DataFrame(rows, columns=["doc_id", "item_id", "kind", "doc_word", "item_word", "n_words"])
                        f["doc_id"] = ids[f["doc_id"].values]
                        yield f

        part = d.mapInPandas(scan, schema)
        found = part if found is None else found.unionByName(part)
    return found.distinct()
