"""Filling containers of fixed capacity with whole documents (problem 8).

Method: space-filling-curve order. A document's hashed word vector is projected to three dimensions (each
word adds +1 or -1 to each, by bits of its hash), brought to the unit cube by the normal law and numbered
along a Hilbert curve. Documents are range-sorted by that key and packed along the curve, so that a
container holds neighbours: documents of like language and words. Within a stretch of `window` documents
the largest goes first, each into the fullest container that still takes it; containers that are not
full stay open for the next stretch. Sizes are tokens of a public tokenizer whose file is a parameter.

A document above the capacity, and only such a one, is split: whole containers of its tokens, and a rest
that is packed like a document. Range partitions are cut by (key, doc_id), so that a group of copies
(with one key) spreads over partitions like any others; each partition leaves at most a few containers
part-filled, and the number of partitions follows the tokens, not the cores.

Defined results: every row of the input has a container; null and empty texts have no tokens and take
no room; repeated rows are placed each; ties in the key fall to the smaller doc_id.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which the public byte-level vocabulary cuts text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = re.compile(r"[^\W_]+")


@cache
def tokenizer(path: str):
    """The public tokenizer of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points with coordinates below 2**bits."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the turns, from the coarsest cells to the finest
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros(points.shape[0], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(texts: list[str], bits: int = 10) -> np.ndarray:
    """Hilbert keys of the texts' hashed word vectors."""
    words = [_WORD.findall(t.lower()) for t in texts]
    flat = [w for ws in words for w in ws]
    sums = np.zeros((len(texts), 3))
    if flat:
        codes, kinds = pd.factorize(np.array(flat, dtype=object))
        h = pd.util.hash_array(np.asarray(kinds, dtype=object), categorize=False)
        signs = np.stack([((h >> np.uint64(7 * k + 3)) & np.uint64(1)).astype(np.float64) * 2 - 1 for k in range(3)], axis=1)
        np.add.at(sums, np.repeat(np.arange(len(texts)), [len(ws) for ws in words]), signs[codes])
    z = sums / np.sqrt(np.maximum([[len(ws)] for ws in words], 1))
    unit = 1 / (1 + np.exp(-1.702 * z / 2))  # the normal law, by its logistic approximation; repeated words widen it
    return hilbert(np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


class _Open:
    """Open containers by the room they have left."""

    def __init__(self, capacity: int, keep: int):
        self.capacity, self.keep, self.next = capacity, keep, 0
        self.room: list[tuple[int, int]] = []

    def put(self, size: int) -> int:
        k = bisect.bisect_left(self.room, (size, -1))
        if k == len(self.room):
            room, name = self.capacity, self.next
            self.next += 1
        else:
            room, name = self.room.pop(k)
        bisect.insort(self.room, (room - size, name))
        return name

    def close(self) -> None:
        """Only the emptiest containers stay open for the next stretch."""
        self.room = self.room[-self.keep :]


def pack_documents(
    documents: DataFrame,
    capacity: int,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer_file: str = TOKENIZER,
    window: int = 4096,
    keep_open: int = 256,
    partition_tokens: int = 20_000_000,
) -> DataFrame:
    """(doc_id, piece, token_from, token_to, n_tokens, container): where each document, or piece of one, lies."""
    d = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(tokenizer_file).encode_ordinary
        for b in batches:
            sizes = [len(encode(t)) for t in b["t"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "size": sizes, "key": curve_keys(list(b["t"]))})

    sized = cut_lineage(spread(d).mapInPandas(measure, "doc_id bigint, size bigint, key bigint"))
    total = sized.agg(F.sum("size")).first()[0] or 0
    ranged = sized.repartitionByRange(max(1, round(total / partition_tokens)), "key", "doc_id").sortWithinPartitions("key", "doc_id")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 40
        bins = _Open(capacity, keep_open)
        rows: list[tuple] = []

        def flush() -> pd.DataFrame:
            out = []
            for doc, size in rows:
                full = size // capacity if size > capacity else 0
                for p in range(full):
                    out.append((doc, p, p * capacity, (p + 1) * capacity, capacity, base + bins.next))
                    bins.next += 1
                if size > full * capacity or not size:
                    out.append((doc, full, full * capacity, size, size - full * capacity, -1))
            frame = pd.DataFrame(out, columns=["doc_id", "piece", "token_from", "token_to", "n_tokens", "container"])
            loose = np.nonzero(frame["container"].values == -1)[0]
            sizes, placed = frame["n_tokens"].values, frame["container"].values.copy()
            for k in loose[np.argsort(-sizes[loose], kind="stable")]:
                placed[k] = base + bins.put(int(sizes[k]))
            bins.close()
            frame["container"] = placed
            rows.clear()
            return frame

        for b in batches:
            for s in range(0, len(b), window):
                part = b.iloc[s : s + window]
                rows.extend(zip(part["doc_id"].tolist(), part["size"].tolist()))
                if len(rows) >= window:
                    yield flush()
        if rows:
            yield flush()

    return ranged.mapInPandas(pack, "doc_id bigint, piece int, token_from bigint, token_to bigint, n_tokens bigint, container bigint")
