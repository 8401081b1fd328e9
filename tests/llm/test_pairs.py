"""Near-duplicates, neighbours, leaks and look-alikes against brute force, and odd input."""

import itertools
import os
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from corvane import session
from corvane.llm import leakage, lookalike, neardup, neighbours, queries

DATA = os.environ.get("CORVANE_TESTDATA", "/root/testdata/sf0.001")
need_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shingles(paragraphs, width):
    words = [w for w in re.split(r"[ \t\n]+", " ".join(p for p in paragraphs if p is not None).lower()) if w]
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute_pairs(rows, threshold, width):
    sets = {r: shingles(p, width) for r, p in rows if p is not None}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@need_data
def test_near_duplicates_of_the_tables(spark):
    r = spark.read.parquet(f"{DATA}/records.parquet").where("kind = 'source'").select("ref", "paragraphs")
    rows = {x["ref"]: x["paragraphs"] for x in r.collect()}.items()
    got = {tuple(x) for x in neardup.near_duplicate_pairs(r, 0.6, 3).collect()}
    assert got == brute_pairs(rows, 0.6, 3)


def test_near_duplicates_at_the_threshold_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for g in range(6):
        base = list(rng.choice(words, 60))
        for e in range(5):
            text = list(base)
            for at in rng.choice(60, 2 * e, replace=False):
                text[at] = f"edit{g}{e}{at}"
            rows.append((f"r{g}{e}", [" ".join(text[:30]), None, " ".join(text[30:])], "x"))
    rows += [("null", None, "x"), ("none", [], "x"), ("short", ["one two"], "x"), ("blank", ["", None], "x"), ("copy1", ["a b c d"], "x"), ("copy2", ["A  b\tc\nd"], "x"), ("copy2", ["A  b\tc\nd"], "x")]
    df = spark.createDataFrame(rows, "ref string, paragraphs array<string>, class_id string")
    got = {tuple(x) for x in neardup.near_duplicate_pairs(df, 0.6, 3).collect()}
    assert got == brute_pairs([(r, p) for r, p, _ in rows], 0.6, 3)
    assert ("copy1", "copy2") in got
    classes = {x["ref"]: x for x in neardup.near_duplicate_classes(df, 0.6, 3).collect()}
    assert classes["copy1"]["class_id"] == classes["copy2"]["class_id"]
    links = neardup.near_duplicate_pairs(df.limit(0), 0.6, 3)
    assert links.count() == 0


def exact_neighbours(ids, x, k):
    s = x @ x.T
    np.fill_diagonal(s, -9)
    return {(min(ids[a], ids[b]), max(ids[a], ids[b])) for a in range(len(ids)) for b in np.argsort(-s[a], kind="stable")[:k]}


@need_data
@pytest.mark.parametrize("cell_rows", [20_000, 12])
def test_neighbours_of_the_tables(spark, cell_rows):
    v = spark.read.parquet(f"{DATA}/para_vectors.parquet")
    rows = [(r["vec_id"], np.array(r["vector"])) for r in v.collect() if r["vector"] is not None and any(r["vector"])]
    x = np.stack([a / np.linalg.norm(a) for _, a in rows])
    want = exact_neighbours([i for i, _ in rows], x, 5)
    got = {tuple(r) for r in neighbours.neighbour_pairs(v, 5, cell_rows=cell_rows, slice_rows=40, leaf=8).collect()}
    assert len(got & want) >= 0.97 * len(want)
    assert len(got) <= 1.03 * len(want)


def test_neighbours_of_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(y) for y in rng.standard_normal(8)], "v") for i in range(60)]
    rows += [(100 + i, [1.0] * 8, "v") for i in range(9)]
    rows += [(200, None, "v"), (201, [0.0] * 8, "v"), (202, [1.0, 2.0], "v"), (203, [float("nan")] * 8, "v"), (204, [1e30] * 8, "v"), (205, [], "v"), (7, rows[7][1], "v")]
    df = spark.createDataFrame(rows, "vec_id bigint, vector array<float>, id string")
    n = neighbours.nearest(df, 5).collect()
    by = {}
    for r in n:
        by.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    assert not {200, 201, 202, 203, 205} & set(by)
    assert all(len(set(b)) == 5 and i not in b for i, b in by.items())
    assert set(by[104]) <= {100, 101, 102, 103, 105, 106, 107, 108, 204}
    assert neighbours.nearest(df.limit(0), 5).count() == 0


def test_neighbours_of_copies_in_many_cells_are_those_of_brute_force_and_no_vector_is_kept_per_cell(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 16)).astype(np.float32)
    times = [1] * 1480 + [2, 3, 4, 5, 6, 7, 8, 90] * 2 + [1] * 4
    x = np.repeat(base, times, axis=0)
    x = x[rng.permutation(len(x))]
    ids = np.arange(len(x)) * 3 + 1
    unit = (x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)).astype(np.float64)
    near = (unit @ unit.T).round(12)
    np.fill_diagonal(near, -9)
    want = {(int(ids[a]), int(ids[b])) for a in range(len(x)) for b in np.lexsort((ids, -near[a]))[:5]}
    df = spark.createDataFrame([(int(i), y.tolist()) for i, y in zip(ids, x, strict=True)], "vec_id bigint, vector array<float>").repartition(4)
    folder = session._shared_folder(spark).removeprefix("file://")
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}
    before = files()
    got = [(r["vec_id"], r["neighbour_id"]) for r in neighbours.nearest(df, 5, cell_rows=15, slice_rows=200, leaf=4).collect()]
    assert len(got) == len(set(got)) == 5 * len(x)
    assert len(set(got) & want) >= 0.997 * len(want)
    copied = {int(i) for i, c in zip(ids, (near > 1 - 1e-9).sum(axis=1), strict=True) if c >= 5}
    assert copied and {p for p in got if p[0] in copied} == {p for p in want if p[0] in copied}
    kept = [pq.ParquetFile(f) for f in files() - before]
    assert sum(f.metadata.num_rows for f in kept if "v" in f.schema_arrow.names) <= 2 * len(x)  # 100 cells, but no copy for each
    some = [(r["vec_id"], r["neighbour_id"]) for r in neighbours.nearest(df, 5, cell_rows=15, slice_rows=200, leaf=4, every=20).collect()]
    assert sorted(some) == sorted(p for p in got if p[0] % 20 == 0)


def test_blocks_of_queries_are_bounded_and_cover_each_cell():
    blocks = neighbours._blocks({0: 5, 1: 0, 2: 4, 3: 25, 4: 1, 6: 10}, 10)
    assert blocks == [(0, 2, 0, 1), (3, 3, 0, 3), (3, 3, 1, 3), (3, 3, 2, 3), (4, 4, 0, 1), (6, 6, 0, 1)]


def test_chi_square_and_hilbert_free_tree():
    assert abs(neighbours.chi2_inv(0.95, 8) - 15.507) < 1e-2
    points = np.random.default_rng(0).standard_normal((500, 4))
    tree = neighbours.Tree(points, 16)
    assert sorted(tree.order) == list(range(500))
    box = tree.distances(points[:20].astype(np.float32))
    for q in range(20):
        for leaf, (a, b) in enumerate(tree.leaves):
            assert ((points[tree.order[a:b]] - points[q]) ** 2).sum(axis=1).min() >= box[q, leaf] - 1e-4


@need_data
def test_leaks_of_the_tables(spark):
    docs, items = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "eval_items"))
    inverted = {}
    for r in items.collect():
        w = leakage.words(r["text"])
        for k in range(len(w) - 11):
            inverted.setdefault(tuple(w[k : k + 12]), set()).add(r["item_id"])
    want = set()
    for r in docs.collect():
        w = leakage.words(r["text"])
        for k in range(len(w) - 11):
            want |= {(r["doc_id"], i) for i in inverted.get(tuple(w[k : k + 12]), ())}
    for how in ({}, {"block_bytes": 20_000, "shard_docs": 30}):
        got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items, **how).collect()}
        assert got == want
    assert want


def test_leaks_of_odd_texts(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [
        (1, item.upper().replace(" ", ", "), "x"), (2, "one two three", "x"), (3, None, "x"), (4, "", "x"), (5, "pad " * 50_000 + item, "x"),
        (6, item.replace("o", "о").replace("e", "e​"), "x"), (7, item.replace("seven", "changed"), "x"), (1, item.upper().replace(" ", ", "), "x"),
        (8, "one two three four five six\n\n> seven eight nine ten eleven twelve", "x"), (9, "ｏｎｅ two three four five six seven eight nine ten eleven twelve", "x"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame([(10, item), (11, item), (12, "short"), (13, None)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(d, i).collect()}
    assert got == {(k, n) for k in (1, 5, 6, 8, 9) for n in (10, 11)}
    near = leakage.find_leaks(d, i, near=0.7).where("kind = 'near'").select("doc_id").distinct().collect()
    assert [r[0] for r in near] == [7]
    assert leakage.find_leaks(d.limit(0), i).count() == 0 and leakage.find_leaks(d, i.limit(0)).count() == 0


def brute_near(docs, items, n, need):
    """All near rows: every alignment of every document and item, window by window."""
    rows = set()
    for (k, d), (i, t) in itertools.product(enumerate(docs), enumerate(items)):
        for shift in range(-len(t) + 1, len(d)):
            agree = [0 <= q + shift < len(d) and d[q + shift] == t[q] for q in range(len(t))]
            starts = [q for q in range(len(t) - n + 1) if sum(agree[q : q + n]) >= need]
            cuts = [x for x, q in enumerate(starts) if not x or q - starts[x - 1] > n] + [len(starts)]
            for x, y in itertools.pairwise(cuts):
                same = [q for q in range(starts[x], starts[y - 1] + n) if agree[q]]
                if not same[-1] - same[0] + 1 == len(same) >= n:
                    rows.add((k, i, same[0] + shift, same[0], len(same)))
    return rows


def test_near_leaks_are_all_found_whatever_shares_the_shard(spark):
    rng = np.random.default_rng(3)
    draw = lambda size: [f"w{x}" for x in (rng.pareto(0.7, size) * 5).astype(int) % 400]
    items = [draw(30) for _ in range(12)]
    docs = [draw(60) for _ in range(60)]
    for k in range(40):  # passages with a few words changed, some at the edge of the text
        a, size = int(rng.integers(0, 8)), int(rng.integers(11, 22))
        cut = list(items[k % 12][a : a + size])
        for x in rng.choice(size, int(rng.integers(0, 5)), replace=False):
            cut[x] = f"w{rng.integers(0, 400)}"
        docs[k] = [*docs[k][: int(rng.integers(0, 20))], *cut, *docs[k][40 : int(rng.integers(40, 60))]]
    docs = [x for x in docs if len(x) >= 12]
    want = brute_near(docs, items, 12, 9)
    d = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(docs)], "doc_id bigint, text string")
    i = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    assert len(want) > 20
    for shard in (1, 7, 2000):
        got = leakage.find_leaks(d, i, near=0.67, shard_docs=shard).where("kind = 'near'").drop("kind").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_leak_of_just_n_words_beside_rarer_ones():
    item = [f"w{k}" for k in range(31)]
    index = leakage._Items([(5, " ".join(item))], 12)
    assert leakage._shard_matches([" ".join(item[11:23])], index, 12, 0.0) == [(0, 5, "exact", 0, 11, 12)]


def test_near_leak_whose_rarest_word_was_edited(spark):
    item = [f"w{k}" for k in range(23)]
    edited = " ".join([*item[:11], "changed", *item[12:]])
    d = spark.createDataFrame([(1, edited), (2, "pad " * 12 + "w11"), *[(k, " ".join(item[:11] + item[12:])) for k in (3, 4)]], "doc_id bigint, text string").coalesce(1)
    i = spark.createDataFrame([(5, " ".join(item))], "item_id bigint, text string")
    assert [tuple(r) for r in leakage.find_leaks(d, i, near=0.67).where("doc_id = 1").collect()] == [(1, 5, "near", 0, 0, 22)]


def test_lookalikes(spark):
    same = ["Lock keeper’s file", "Ｌｏｃｋ keeper’s file", "Lock keeper’s file", "Lo​ck keep­er’s file", "Lосk keeреr’s filе", "Lock keeper’s ﬁle", "𝗟𝗼𝗰𝗸 keeper’s file"]
    other = ["lock keeper’s file", "Lock keeper’s\nfile", "Löck keeper’s file", "Lock keeper's file", "Lock keeper’s  file"]
    accents = ["café", "café", "caf‍é"]
    assert len({lookalike.canonical(t) for t in same}) == 1
    assert not {lookalike.canonical(t) for t in other} & {lookalike.canonical(same[0])}
    assert len({lookalike.canonical(t) for t in accents}) == 1
    assert lookalike.canonical("Straße", fold=True) == "strasse"
    texts = same + other + accents + [same[0], None, None, "", "​"]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    got = {tuple(r) for r in lookalike.same_looking_pairs(d).collect()}
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if None not in (texts[a], texts[b]) and texts[a] != texts[b] and lookalike.canonical(texts[a]) == lookalike.canonical(texts[b])}
    assert got == want
    forms = {r["doc_id"]: r["canonical"] for r in lookalike.canonical_documents(d).collect()}
    assert forms[0] == "lock keeper’s file" and forms[len(texts) - 3] is None
    assert lookalike.same_looking_pairs(d.limit(0)).count() == 0


@need_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df, sql = queries.QUERIES[name](spark, DATA), con.sql(queries.SQL[name])
    want = [tuple(r[sql.columns.index(c)] for c in df.columns) for r in sql.fetchall()]
    assert sorted(tuple(r) for r in df.collect()) == sorted(want)
