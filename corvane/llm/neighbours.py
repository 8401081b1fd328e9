"""The k most similar vectors for every vector (problem 3).

Method: vectors are scaled to unit length, so that the order by cosine is the order by distance, and
projected by a few 2-stable (Gaussian) directions. The projections are indexed by a kd-tree. A query
visits leaves by growing projected distance and verifies the neighbours it meets with their true
distance; it stops when the chi-square test holds: for a point at true distance r the squared projected
distance over r*r follows a chi-square law with m degrees of freedom, so once the next leaf lies farther
than d_k * sqrt(chi2_inv(p, m)), where d_k is the k-th best true distance so far, a nearer point is left
unseen with probability below 1 - p each.

Distribution: the upper part of the tree is built on the driver from a bounded sample (sample_rows) and
only names cells, each with its box; all vectors are indexed. They are written to the shared folder cell by
cell, and no vector is sent to another: a task holds a block of at most slice_rows queries of neighbouring
cells and streams the cells past it, its own first, then by growing distance of their boxes. So d_k is small
when the far cells come; a cell that lies beyond every query's stopping radius is not read. What is in
memory is one block, one batch of a cell and one product of theirs, however many cells there are and however
many rows a cell got. Within a batch the tree goes on down to leaves. Equal vectors are answered once: they
collapse to one class before the search.

Defined results: null vectors, vectors of zero length or with other dimensions than most or with values
that are no numbers take no part; equal vectors are each other's neighbours at similarity 1 (of more than k
equal ones, those with the smallest ids); ties at the last place fall to the smaller id; fewer than k
other vectors give fewer neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut_lineage, shared_path, spread


def chi2_inv(p: float, m: int) -> float:
    """The value that a chi-square variable of m degrees of freedom stays below with probability p."""

    def cdf(x: float) -> float:
        a, x = m / 2, x / 2
        term = total = 1 / a
        for k in range(1, 1000):
            term *= x / (a + k)
            total += term
            if term < total * 1e-12:
                break
        return total * math.exp(-x + a * math.log(x) - math.lgamma(a))

    lo, hi = 1e-9, 10.0 * m + 100
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


#: Queries that go through a batch's leaves together, and rows of a cell that are read at once.
STEP, BATCH = 2048, 20_480


class Tree:
    """A kd-tree over points: widest dimension, median cut, leaves of at most `leaf` points."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.leaves: list[tuple[int, int]] = []
        lows, highs = [], []
        stack = [(0, len(points))]
        while stack:
            a, b = stack.pop()
            own = points[self.order[a:b]]
            low, high = own.min(axis=0), own.max(axis=0)
            if b - a <= leaf or (high == low).all():
                self.leaves.append((a, b))
                lows.append(low)
                highs.append(high)
                continue
            d, mid = int(np.argmax(high - low)), (b - a) // 2
            part = np.argpartition(own[:, d], mid)
            self.order[a:b] = self.order[a:b][part]
            stack += [(a, a + mid), (a + mid, b)]
        self.low, self.high = np.array(lows), np.array(highs)

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distance from each query to each leaf's box."""
        out = np.zeros((len(queries), len(self.low)), dtype=np.float32)
        for d in range(queries.shape[1]):
            q = queries[:, d : d + 1]
            gap = np.maximum(np.maximum(self.low[:, d] - q, q - self.high[:, d]), 0)
            out += gap * gap
        return out


def search(points, ids, projected, queries, query_projected, query_ids, rows, best_d, best_i, k: int, limit: float, leaf: int):
    """Lower best_d (squared, ascending) and best_i of the queries named by rows by the points; in place.

    Leaves are visited in order of their distance from some neighbouring queries together; each of them
    skips a leaf by its own stopping test. All visitors of a leaf are verified by one matrix product.
    """
    tree = Tree(projected, leaf)
    points, ids = points[tree.order], ids[tree.order]
    for start in range(0, len(rows), STEP):
        part = rows[start : start + STEP]
        box = tree.distances(query_projected[part])
        for which in np.argsort(box.mean(axis=0), kind="stable"):
            go = part[box[:, which] <= best_d[part, k - 1] * limit]  # the chi-square stopping test
            if not len(go):
                continue
            a, b = tree.leaves[which]
            cosine = queries[go] @ points[a:b].T
            better = cosine.max(axis=1) >= 1 - best_d[go, k - 1] / 2 - 1e-6
            if not better.any():
                continue
            go, near = go[better], np.maximum(2 - 2 * cosine[better], 0)
            near[query_ids[go][:, None] == ids[a:b]] = np.inf
            if b - a > k:
                take = np.argpartition(near, k - 1, axis=1)[:, :k]
                near, name = np.take_along_axis(near, take, axis=1), ids[a:b][take]
            else:
                name = np.broadcast_to(ids[a:b], near.shape)
            all_d, all_i = np.concatenate([best_d[go], near], axis=1), np.concatenate([best_i[go], name], axis=1)
            first = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best_d[go], best_i[go] = np.take_along_axis(all_d, first, axis=1), np.take_along_axis(all_i, first, axis=1)


class _Cells:
    """The upper tree: cells named by cuts, found by descending; boxes are unbounded at the rim."""

    def __init__(self, sample: np.ndarray, n_cells: int):
        self.cuts: list[tuple[int, float, int, int]] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        m = sample.shape[1]
        self.root = self._grow(sample, n_cells, np.full(m, -np.inf), np.full(m, np.inf))
        self.low, self.high = (np.array([b[k] for b in self.boxes]) for k in (0, 1))

    def _grow(self, own: np.ndarray, n: int, low: np.ndarray, high: np.ndarray) -> int:
        """Number of the node: cells are -1, -2, ...; cuts 0, 1, ..."""
        if n <= 1 or len(own) < 2 or (own.max(axis=0) == own.min(axis=0)).all():
            self.boxes.append((low, high))
            return -len(self.boxes)
        d = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        cut = float(np.median(own[:, d]))
        below = own[:, d] <= cut
        me = len(self.cuts)
        self.cuts.append((d, cut, 0, 0))
        lower_high, upper_low = high.copy(), low.copy()
        lower_high[d] = upper_low[d] = cut
        left = self._grow(own[below], n // 2, low, lower_high)
        right = self._grow(own[~below], n - n // 2, upper_low, high)
        self.cuts[me] = (d, cut, left, right)
        return me

    def find(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), dtype=np.int32)
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -node - 1
            elif len(rows):
                d, cut, left, right = self.cuts[node]
                below = points[rows, d] <= cut
                stack += [(left, rows[below]), (right, rows[~below])]
        return out

    def reach(self, cell: int, points: np.ndarray) -> np.ndarray:
        """Squared distance from each point to the cell's box."""
        gap = np.maximum(np.maximum(self.low[cell] - points, points - self.high[cell]), 0)
        return (gap * gap).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors kept as the bytes of their floats."""
    if not len(column):
        return np.zeros((0, 0), dtype=np.float32)
    _, offsets, data = column.cast(pa.binary()).buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.float32, offset=at[0], count=(at[-1] - at[0]) // 4).reshape(len(column), -1)


def _bytes(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, dtype=np.float32)
    at = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at), pa.py_buffer(x)])


def _read(folder: str, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, asked) of a cell, some rows at once; the order is the same each time."""
    files, path = fs.FileSystem.from_uri(folder)
    for f in sorted(x.path for x in files.get_file_info(fs.FileSelector(f"{path}/cell={cell}")) if x.path.endswith(".parquet")):
        with files.open_input_file(f) as opened:
            for b in pq.ParquetFile(opened, buffer_size=1 << 20).iter_batches(BATCH, columns=["id", "v", "asked"]):
                yield b["id"].to_numpy(), _matrix(b["v"]), b["asked"].to_numpy(zero_copy_only=False)


def _blocks(asked: dict[int, int], most: int) -> list[tuple[int, int, int, int]]:
    """(first cell, last cell, part, parts): at most so many queries each, of one cell or several neighbouring ones."""
    out: list[tuple[int, int, int, int]] = []
    held = 0
    for cell, n in sorted(asked.items()):
        if n > most:
            parts = -(-n // most)
            out += [(cell, cell, part, parts) for part in range(parts)]
            held = most
        elif n and out and held + n <= most:
            out[-1] = (out[-1][0], cell, 0, 1)
            held += n
        elif n:
            out.append((cell, cell, 0, 1))
            held = n
    return out


def nearest(
    vectors: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "vector",
    m: int = 8,
    p: float = 0.995,
    cell_rows: int = 20_000,
    sample_rows: int = 50_000,
    leaf: int = 768,
    slice_rows: int = 60_000,
    seed: int = 7,
    every: int = 1,
) -> DataFrame:
    """(vec_id, neighbour_id, similarity): the k most similar other vectors of each; see the module.

    every > 1 asks only for vectors whose id is divisible by it; all vectors are indexed and searched.
    """
    spark = vectors.sparkSession
    limit = chi2_inv(p, m)
    v = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    v = v.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0))
    dims = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if dims is None:
        return spark.createDataFrame([], "vec_id bigint, neighbour_id bigint, similarity double")
    dim = dims["n"]
    directions = np.random.default_rng(seed).standard_normal((dim, m)).astype(np.float32)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 4096):
                own = b.slice(start, 4096)
                x = own["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(own.num_rows, dim)
                x /= np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([own["id"], _bytes(x.astype(np.float32) + 0)], ["id", "v"])  # no -0.0, which has other bytes

    v = spread(v.where(F.size("v") == dim)).mapInArrow(unit, "id bigint, v binary")
    v = v.select("id", F.struct(F.xxhash64("v").alias("a"), F.hash("v").alias("b"), F.substring("v", 1, 4).alias("c")).alias("same"), "v")
    v = cut_lineage(v)
    # equal vectors become one point, named by its smallest id; its up to k + 1 smallest members answer for all
    points = cut_lineage(v.groupBy("same").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    total = points.count()
    if total == 0:
        return spark.createDataFrame([], "vec_id bigint, neighbour_id bigint, similarity double")
    some = v.where(F.pmod(F.xxhash64("same", F.lit(seed)), F.lit(total)) < sample_rows)
    sample = some.groupBy("v").agg(F.min("id").alias("id")).limit(2 * sample_rows).toArrow().sort_by("id")
    x = np.frombuffer(b"".join(sample["v"].to_pylist()), dtype=np.float32).reshape(-1, dim)
    cells = _Cells(x @ directions, max(1, round(total / cell_rows)))
    n_cells = len(cells.low)
    tree = spark.sparkContext.broadcast((cells, directions))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, a = tree.value
        for b in batches:
            if b.num_rows:
                ids, x = b["id"].to_numpy(), _matrix(b["v"])
                order = np.argsort(ids, kind="stable")
                # copies in a batch become one row here, so that no cell is flooded by those of one vector
                _, first, same = np.unique(x.view(np.dtype((np.void, x.shape[1] * 4))).ravel()[order], return_index=True, return_inverse=True)
                wanted = np.bincount(same, weights=ids[order] % every == 0) > 0
                ids, x = ids[order[first]], x[order[first]]
                yield pa.RecordBatch.from_arrays([pa.array(ids), _bytes(x), pa.array(wanted), pa.array(c.find(x @ a))], ["id", "v", "asked", "cell"])

    folder = shared_path(spark)
    placed = v.select("id", "v").mapInArrow(place, "id bigint, v binary, asked boolean, cell int").repartition("cell")
    placed = placed.groupBy("cell", "v").agg(F.min("id").alias("id"), F.max("asked").alias("asked"))  # equal vectors have one cell: no second shuffle
    placed.write.partitionBy("cell").parquet(folder)
    count = spark.read.schema("asked boolean, cell int").parquet(folder).groupBy("cell").agg(F.count_if("asked").alias("asked"), F.count("*").alias("held"))
    count = {r["cell"]: (r["asked"], r["held"]) for r in count.collect()}  # one row per cell
    asked = {c: n for c, (n, _) in count.items()}
    blocks = _blocks(asked, max(1, min(slice_rows, -(-sum(asked.values()) // (4 * spark.sparkContext.defaultParallelism)))))

    def answer(block: tuple[int, int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a block's queries, squared distances and ids of their neighbours."""
        c, a = tree.value
        first, last, part, parts = block
        own = [x for x in range(first, last + 1) if x in count]
        q, q_ids, seen = [], [], 0
        for cell in own:
            for ids, x, wanted in _read(folder, cell):
                mine = np.flatnonzero(wanted)
                mine = mine[(np.arange(seen, seen + len(mine)) % parts) == part]
                seen += int(wanted.sum())
                q.append(x[mine])
                q_ids.append(ids[mine])
        q, q_ids = np.concatenate(q), np.concatenate(q_ids)
        q_at = q @ a
        order = Tree(q_at, STEP // 4).order  # neighbours stand together
        q, q_ids, q_at = q[order], q_ids[order], q_at[order]
        best_d, best_i = np.full((len(q), k), 4.1, np.float32), np.full((len(q), k), -1, np.int64)
        few = q_at[:: max(1, len(q) // 256)]
        far = {cell: (cell not in own, float(c.reach(cell, few).mean())) for cell in count}
        for cell in sorted(count, key=lambda x: (far[x], x)):
            reach = c.reach(cell, q_at)
            if not (reach <= best_d[:, k - 1] * limit).any():
                continue
            for ids, x, _ in _read(folder, cell):
                rows = np.flatnonzero(reach <= best_d[:, k - 1] * limit)
                if len(rows):
                    search(x, ids, x @ a, q, q_at, q_ids, rows, best_d, best_i, k, limit, leaf)
        return q_ids, best_d, best_i

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number in b["id"].to_pylist():
                ids, d, i = answer(blocks[number])
                for start in range(0, len(ids), BATCH):
                    part = slice(start, start + BATCH)
                    there = i[part] >= 0
                    columns = np.repeat(ids[part], k)[there.ravel()], i[part][there], 1 - d[part][there].astype(np.float64) / 2
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "n", "s"])

    near = cut_lineage(spark.range(0, len(blocks), 1, max(1, len(blocks))).mapInArrow(answers, "id bigint, n bigint, s double"))
    out = _expand(v.select("id", "same"), points, near, k)
    return out.where(F.col("vec_id") % every == 0) if every > 1 else out


def _expand(members: DataFrame, points: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Neighbours of every vector from the neighbours of the points: copies first, then the points' copies.

    Of each group of equal vectors at most k + 1 members can be anyone's neighbours, so only those are sent.
    """
    if points.where("copies > 1").limit(1).count() == 0:
        return near.select(F.col("id").alias("vec_id"), F.col("n").alias("neighbour_id"), F.col("s").alias("similarity"))
    plain = points.where("copies = 1").select("id")
    several = points.where("copies > 1").select("same", F.col("id").alias("point"))
    own = members.join(several, "same").select("id", "point").distinct()
    # a limit on ranks is applied before the shuffle too: a class of a third of all rows is never in one place
    ranked = own.withColumn("nth", F.row_number().over(Window.partitionBy("point").orderBy("id"))).where(F.col("nth") <= k + 1)
    lead = cut_lineage(ranked.groupBy("point").agg(F.array_sort(F.collect_list("id")).alias("lead")))
    target = near.join(lead.withColumnRenamed("point", "n"), "n", "left")
    target = target.select("id", F.explode(F.coalesce("lead", F.array("n"))).alias("n"), "s")
    single = target.join(plain, "id", "left_semi").select(F.col("id").alias("vec_id"), "n", "s")
    twins = own.join(lead, "point").select(F.col("id").alias("vec_id"), "point", "lead")
    # more than k equal ones: the smallest of the others are the answer, and nothing else is looked at
    full = twins.where(F.size("lead") > k).select("vec_id", F.explode(F.slice(F.filter("lead", lambda x: x != F.col("vec_id")), 1, k)).alias("n"), F.lit(1.0).alias("s"))
    twins = twins.where(F.size("lead") <= k)
    others = twins.select("vec_id", "point").join(target.withColumnRenamed("id", "point"), "point").select("vec_id", "n", "s")
    twins = twins.select("vec_id", F.explode("lead").alias("n"), F.lit(1.0).alias("s")).where("vec_id <> n")
    rows = single.unionByName(others).unionByName(twins)
    top = rows.groupBy("vec_id").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("s")).alias("d"), "n"))), 1, k).alias("x"))
    top = top.select("vec_id", F.explode("x").alias("x")).select("vec_id", F.col("x.n").alias("n"), (-F.col("x.d")).alias("s"))
    return top.unionByName(full).select("vec_id", F.col("n").alias("neighbour_id"), F.col("s").alias("similarity"))


def neighbour_pairs(vectors: DataFrame, k: int = 5, **how) -> DataFrame:
    """(vec_lo, vec_hi): pairs in which one vector is among the k most similar to the other."""
    n = nearest(vectors, k, **how)
    return n.select(F.least("vec_id", "neighbour_id").alias("vec_lo"), F.greatest("vec_id", "neighbour_id").alias("vec_hi")).distinct()


def neighbour_sample(vectors: DataFrame, k: int = 5, every: int = 20, **how) -> DataFrame:
    """Neighbours of the stated query set, every row whose id is divisible by `every`, against all rows."""
    return nearest(vectors, k, every=every, **how)
