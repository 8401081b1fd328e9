"""Mail, splitting, garbled text, names and packing: round trips, planted cases and odd input."""

import collections
import os

import numpy as np
import pytest

from corvane.llm import mail, mojibake, names, packing, queries, splitting

DATA = os.environ.get("CORVANE_TESTDATA", "/root/testdata/sf0.001")
need_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TOKENIZER = pytest.mark.skipif(not os.path.exists(packing.TOKENIZER), reason="no tokenizer file")


# -- splitting


@pytest.mark.parametrize("text", ["", "a", "word " * 2000, "x" * 5000, "äöü€" * 900, "Ein Satz. " * 300 + "\n\n" + "第7班の記録。" * 300, "One. Two! Three?\n\n" * 400])
@pytest.mark.parametrize("limit,overlap", [(50, 0), (50, 10), (300, 299), (7, 30), (2, 0)])
def test_pieces_join_to_the_text(text, limit, overlap):
    cut = splitting.pieces(text, limit, overlap)
    assert "".join(text[new:end] for _, end, new, _ in cut) == text
    assert all(-(-len(text[s:e].encode()) // 4) <= limit for s, e, _, _ in cut)
    for _, (s, _, new, _) in zip(cut, cut[1:]):
        if overlap < limit:
            assert -(-len(text[s:new].encode()) // 4) == overlap


def test_cuts_fall_between_topics():
    a, b = "The tide gauge reads the tide at the gauge. ", "Bread and cheese make a meal of bread. "
    text = a * 12 + b * 12
    (s, e, _, kind), *_ = splitting.pieces(text, 190, 0)
    assert kind == "valley" and e == len(a) * 12


@need_data
def test_oversized_records_of_the_tables(spark):
    got = {tuple(r) for r in queries.QUERIES["p5_found"](spark, DATA).collect()}
    roots = {r["id"]: r["root_id"] for r in spark.read.parquet(f"{DATA}/units.parquet").collect()}
    want = set()
    configs = spark.read.parquet(f"{DATA}/project_configs.parquet").collect()
    for r in spark.read.parquet(f"{DATA}/records.parquet").where("kind = 'source'").collect():
        size = -(-len("\n\n".join(r["paragraphs"]).encode()) // 4)
        want |= {(c["project_id"], r["ref"]) for c in configs if roots.get(r["ref"]) in c["root_ids"] and size > c["chunk_tokens"]}
    assert got == want


def test_splitting_odd_rows(spark):
    r = spark.createDataFrame([("A", "source", ["x " * 400, None]), ("A", "source", ["x " * 400, None]), ("B", "source", None), ("C", "source", []), (None, "source", ["y" * 900]), ("D", "note", ["z " * 400])], "ref string, kind string, paragraphs array<string>")
    u = spark.createDataFrame([("A", 1), ("B", 1), ("C", 1), ("D", 1)], "id string, root_id int")
    c = spark.createDataFrame([(1, [1, 1], 50, None), (2, None, 50, 0), (3, [1], None, 0), (4, [1], 100, 10)], "project_id int, root_ids array<int>, chunk_tokens int, overlap_tokens int")
    p = splitting.split_items(splitting.oversized(r, u, c)).collect()
    assert {(x["project_id"], x["ref"]) for x in p} == {(1, "A"), (4, "A")}
    assert splitting.split_items(splitting.oversized(r.limit(0), u, c)).count() == 0


# -- garbled text


def garble(text, true, read):
    return "".join(text.encode(true).decode(read, errors="ignore") if read != "cp1252" else "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in text.encode(true)))


@pytest.mark.parametrize("word,true,read", [("café", "utf-8", "cp1252"), ("“gauge", "utf-8", "mac_roman"), ("Größe", "utf-8", "cp850"), ("старой", "koi8_r", "cp1251"), ("Таблица", "cp1251", "cp1252"), ("Πίνακας", "cp1253", "cp1252"), ("pilot’s", "cp1252", "mac_roman"), ("潮汐表", "shift_jis", "cp1252")])
def test_chains_are_undone(word, true, read):
    assert word in [form for _, form, _ in mojibake.candidates(garble(word, true, read))]


def test_double_and_clean_words():
    assert "café" in [f for _, f, _ in mojibake.candidates(garble(garble("café", "utf-8", "cp1252"), "utf-8", "cp1252"))]
    assert mojibake.candidates("plain") == [] and mojibake.candidates("") == []


def test_garbled_slots_are_found_and_restored(spark):
    clean = ["Le café est fermé à la jetée", "Der Schlüssel für die Brücke liegt in der größten Hütte", "Смотритель шлюза проверил якорную цепь", "the pilot’s “gauge” is at the keeper’s café"]
    rows = [(f"S{k}", "source", clean[k % 4], [clean[(k + 1) % 4], clean[(k + 2) % 4]]) for k in range(60)]
    rows.append(("G1", "source", garble(clean[0], "utf-8", "cp1252"), [clean[1], garble(clean[1], "utf-8", "cp850")]))
    rows.append(("G2", "source", clean[0], [garble(clean[2], "koi8_r", "cp1251"), "lost caf" + mojibake.LOST, None, ""]))
    rows.append(("G2", "source", clean[0], [garble(clean[2], "koi8_r", "cp1251"), "lost caf" + mojibake.LOST, None, ""]))
    rows.append(("N", "note", garble(clean[0], "utf-8", "cp1252"), None))
    rows.append(("Z", "source", None, None))
    r = spark.createDataFrame(rows, "ref string, kind string, title string, paragraphs array<string>")
    u = spark.createDataFrame([("S1", 1), ("G1", 2), ("G2", None)], "id string, root_id int")
    assert {tuple(x) for x in mojibake.garbled_slots(r, u).collect()} == {("G1", -1), ("G1", 1), ("G2", 0), ("G2", 1)}
    mended = {(x["ref"], x["slot"]): x for x in mojibake.repaired_slots(r, u).collect()}
    assert mended["G1", -1]["repaired"] == clean[0] and mended["G1", 1]["repaired"] == clean[1] and mended["G2", 0]["repaired"] == clean[2]
    assert mended["G2", 1]["n_lost"] == 1 and mended["G2", 1]["repaired"] == "lost caf" + mojibake.LOST
    assert mojibake.garbled_slots(r.limit(0), u.limit(0)).count() == 0


# -- names


def test_names_find_their_entity(spark):
    entities = [
        ("p1", "person", "Geneviève Niephund", ["Gen Niephund", None, ""]), ("p2", "person", "Quentin Niephund", None), ("p3", "person", "Björn Klörnarro", []),
        ("o1", "organisation", "Knirthale Marine Dredging Association", None), ("o2", "organisation", "Golbale Royal Shipping Limited", None), ("x", "person", None, None), ("y", "person", "", []),
    ]
    typed = {
        "Niephund, G.": "p1", "gniephund": "p1", "genevieve.niephund": "p1", "NIEPHUND Geneviève": "p1", "Geneiève Niephund": "p1", "Capt. G. Niephund": "p1", "Gen Niefund": "p1",
        "Geneviève W. Niephund": "p1", "Q. Niephund": "p2", "Bjoern Kloernarro": "p3", "K1örnarro, B.": "p3", "KMDA": "o1", "K.M.D.A.": "o1", "The Knirthale Mar. Dredg. Assoc.": "o1",
        "Marine Dredging Association (Knirthale)": "o1", "Shipping Golbale": "o2", "Golbaale Royal Shipping": "o2", "GOLBALE ROYAL SHIPPING LIMITED": "o2",
        "Patricia Niephund": None, "Somebody Else": None, "": None, " ": None, "...": None, "n" * 5000: None, "Golbale Tidal Insurance": None,
    }
    m = spark.createDataFrame([(k, "r", 0, t) for k, t in enumerate(typed)] + [(0, "r", 0, next(iter(typed))), (99, "r", 0, None)], "mention_id bigint, ref string, idx int, name_text string")
    e = spark.createDataFrame(entities, "ref string, note_type string, title string, aliases array<string>")
    for how in ({}, {"block_entities": 3}):
        got = {r["mention_id"]: r["entity_ref"] for r in names.attribute_names(m, e, **how).collect()}
        assert {t: got.get(k) for k, t in enumerate(typed)} == typed
    assert names.attribute_names(m, e.limit(0)).count() == 0 and names.attribute_names(m.limit(0), e).count() == 0


def test_errors_in_aliases_and_frequent_spellings(spark):
    entities = [("o1", "organisation", "Knirthale Marine Dredging Association", ["Tidewater Salvage Works", None]), ("p1", "person", "Margaret Ostrander", ["Greta Lindqvist"]), ("p2", "person", "Samuel Vrobel", None)]
    typed = [("Samuel Vrobel", "p2", 30), ("Samuel Vroble", "p2", 12), ("Tidewatr Salvage Works", "o1", 1), ("Lindqvst, Greta", "p1", 1), ("Tidewater Salvage Works", "o1", 40), ("Greta Lindqvist", "p1", 20)]
    typed += [("Samuel Vroxble", "p2", 1), ("Somebody Lindqvist", None, 3), ("Lindqvist", "p1", 2), ("Old Salvage Works", None, 2)]
    rows = [(name, ref) for name, ref, n in typed for _ in range(n)]
    m = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(rows)], "mention_id bigint, name_text string")
    e = spark.createDataFrame(entities, "ref string, note_type string, title string, aliases array<string>")
    for how in ({}, {"block_entities": 1}):
        got = {r["mention_id"]: r["entity_ref"] for r in names.attribute_names(m, e, **how).collect()}
        assert {name: got.get(k) for k, (name, _) in enumerate(rows)} == {name: ref for name, ref, _ in typed}


# -- packing


@TOKENIZER
def test_packing_is_valid_and_tight(spark):
    rng = np.random.default_rng(5)
    words = ["lock", "keeper", "tide", "gauge", "barge", "toll"]
    rows = [(k, " ".join(rng.choice(words, int(n))), "x") for k, n in enumerate(rng.integers(1, 60, 400))]
    rows += [(1000, "lock " * 999, "x"), (1001, None, "x"), (1002, "", "x"), (5, rows[5][1], "x")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, container string")
    p = packing.pack_documents(d, 100, partition_tokens=4000, window=64).toPandas()
    use = p.groupby("container")["n_tokens"].sum()
    assert use.max() <= 100
    assert collections.Counter(p["doc_id"]) == collections.Counter({**{k: 1 for k, *_ in rows}, 5: 2, 1000: len(p[p.doc_id == 1000])})
    big = p[p.doc_id == 1000].sort_values("piece")
    assert list(big["token_to"])[:-1] == list(big["token_from"])[1:] and big["n_tokens"].sum() == len(packing.tokenizer(packing.TOKENIZER).encode_ordinary("lock " * 999))
    assert len(use) <= 1.05 * -(-p["n_tokens"].sum() // 100) + 3
    assert packing.pack_documents(d.limit(0), 100).count() == 0


def test_hilbert_visits_every_cell_once_by_steps_of_one():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3), axis=-1).reshape(-1, 3)
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


# -- mail

HEAD = "From: Thaelvenko, Frederick\nTo: Someone Else\nDate: Mon, 10 May 2004 11:53:33 -0500\nSubject: RE: Tolls"


def own(n):
    words = "pump house sealed claim upstream lock ledger tally desk barge toll winch gauge crane rope quay mast sluice".split()
    return "The " + " ".join(np.random.default_rng(n).choice(words, 20)) + "."


def mails(rep):
    o = lambda n: own(1000 * rep + n)
    first = (1, [HEAD.replace("10 May", "8 May").replace("Thaelvenko, Frederick", "Toskane, William"), "Hello all,", o(1), "Kind regards,\nWilliam Toskane"], [(1, 0), (2, 0)])
    quoted = (2, [HEAD, f"On 8 May 2004, William Toskane wrote:\n> Hello all,\n>\n> {o(1)}", o(2), "-- \nFrederick Thaelvenko\nTel. +00 441 9462"], [(2, 0)])
    forward = (3, [HEAD, "Bonjour,", o(3), "-----Original Message----- From: A Sent: Friday To: B Subject: C", "Hello all,", o(30)], [(1, 0), (2, 0)])
    unmarked = (4, [HEAD, o(4), "Von unterwegs gesendet", "Hello all,", o(1)], [(1, 0)])
    indent = (5, [HEAD, o(5) + "\nA second line of it.", "William Toskane wrote on 8 May:", "    " + o(1)], [(1, 0), (1, 1)])
    lines = ["Regards the toll sheet: see entry 12.", "> 300 tons is too much for Lock 4, whatever the table says.", "-- two lighters, not three, for the coal tip", "As Katherine wrote: hold the gate, so we held it."]
    decoys = (6, [HEAD, *lines], [(1, 0), (2, 0), (3, 0), (4, 0)])
    notice = (7, [HEAD, o(7), "_______________________________________________\ntarn-desk mailing list\nTo leave, write to tarn-desk-leave@quays.invalid"], [(1, 0)])
    return [first, quoted, forward, unmarked, indent, decoys, notice]


def test_only_new_lines_remain(spark):
    rows, want = [], set()
    for rep in range(12):  # enough of each for the trees to learn from
        for conv, ps, new in mails(rep):
            k = 100 * rep + conv
            rows.append((k, "eml@2", ps, {"thread_conversation_id": f"t{rep}"}))
            want |= {(k, *n) for n in new} if conv != 6 or rep == 0 else set()
    # the decoys stand in one mail each, else the later ones would repeat the earlier
    rows = [r for r in rows if r[0] % 100 != 6 or r[0] < 100]
    rows += [(9001, "eml@2", None, None), (9002, "text@1", [HEAD, "Hello"], None), (9003, "eml@1", [HEAD], None), (9004, "eml@1", [], {}), (9005, "eml@1", [None, "", "  \n "], None), (1, *rows[0][1:])]
    c = spark.createDataFrame(rows, "conv_id bigint, converter string, paragraphs array<string>, metadata map<string,string>")
    got = {tuple(r) for r in mail.new_lines(c).collect()}
    assert got == want
    text = {r["conv_id"]: r["text"] for r in mail.new_text(c).collect()}
    assert text[7] == own(7) and not text[9003]
    assert mail.new_lines(c.limit(0)).count() == 0


def test_trees_learn_an_interaction():
    x = np.random.default_rng(0).random((4000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = mail.Trees(rounds=40).fit(x[:3000], y[:3000])
    assert ((model.predict(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


@need_data
@pytest.mark.parametrize("name", [n for n in sorted(queries.QUERIES) if not n.endswith("_found")])
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_garbled_in_one_source_and_clean_in_another(spark):
    russian = "работа слово дело время человек жизнь вопрос сторона страна случай голова ребенок система часть смотритель проверил якорную шлюза погода корабль пристань"
    russian += " капитан матрос журнал письмо берег волна ветер палуба дерево улица музыка история книга работник учитель студент"
    words = russian.split()
    line = lambda k: " а ".join(words[(k + j) % len(words)] for j in range(4))
    rows = [(f"F{k}", "source", None, ["il est à la maison, déjà cet été à midi"]) for k in range(300)]
    rows += [(f"R{k}", "source", None, [line(k)]) for k in range(600)]
    rows += [(f"G{k}", "source", None, [line(5 * k).encode("cp1251").decode("cp1252")]) for k in range(3)]
    r = spark.createDataFrame(rows, "ref string, kind string, title string, paragraphs array<string>")
    u = spark.createDataFrame([(x[0], "FRG".index(x[0][0])) for x in rows], "id string, root_id int")
    got = {x["ref"]: x["repaired"] for x in mojibake.repaired_slots(r, u).collect()}
    assert got == {f"G{k}": line(5 * k) for k in range(3)}


def test_a_garbled_spelling_is_found_however_often_it_occurs(spark):
    text = "le relevé était signé à la jetée, le café fermé"
    rows = [(f"C{k}", "source", "Dépôt", [text, "numéro contesté, écluse réparée, câble brûlé"]) for k in range(120)]
    rows += [(f"G{k}", "source", "Dépôt", [garble(text, "utf-8", "cp1252"), "une clé, un procès-verbal et un " + garble("câble brûlé", "utf-8", "cp1252")]) for k in range(60)]
    r = spark.createDataFrame(rows, "ref string, kind string, title string, paragraphs array<string>")
    u = spark.createDataFrame([(x[0], 1) for x in rows], "id string, root_id int")
    assert {tuple(x) for x in mojibake.garbled_slots(r, u).collect()} == {(f"G{k}", p) for k in range(60) for p in (0, 1)}


def test_garbled_with_long_texts_and_clashing_columns(spark):
    clean = "Der Schlüssel für die Brücke liegt in der größten Hütte"
    rows = [(f"S{k}", "source", clean, [clean, None, ""], "x", 1, "w", 7) for k in range(40)]
    rows += [("L", "source", None, [(clean + " ") * 4000 + garble(clean, "utf-8", "cp1252")], "x", 1, "w", 7), ("T", "source", garble(clean, "utf-8", "cp850"), None, "x", 1, "w", 7), (None, "source", clean, [clean], None, None, None, None)]
    rows += [("T", None, garble(clean, "utf-8", "cp850"), None, None, None, None, None)]
    r = spark.createDataFrame(rows, "ref string, kind string, title string, paragraphs array<string>, h string, slot int, word string, m int")
    u = spark.createDataFrame([("S1", 1, "a"), ("S1", 2, "b"), (None, 3, "c"), ("T", None, None)], "id string, root_id int, source string")
    assert {tuple(x) for x in mojibake.garbled_slots(r, u).collect()} == {("L", 0), ("T", -1)}
    got = {(x["ref"], x["slot"]): x["repaired"] for x in mojibake.repaired_slots(r, u).collect()}
    assert got == {("L", 0): (clean + " ") * 4000 + clean, ("T", -1): clean}


def test_names_with_ties_and_clashing_columns(spark):
    m = spark.createDataFrame([(1, "Ada Stone", "r", 1.0, 3), (2, "J. Reed", "r", 1.0, 3), (2, "J. Reed", "r", 1.0, 3), (None, "Ada Stone", None, None, None), (3, "word " * 20_000, "r", 1.0, 3)], "mention_id bigint, name_text string, ref string, cost double, n int")
    e = spark.createDataFrame([("a", "person", "Ada Stone", None, 1), ("j1", "person", "Jane Reed", [""], 1), ("j2", "person", "John Reed", [None], 1), ("a", "person", "Ada Stone", None, 1)], "ref string, note_type string, title string, aliases array<string>, posterior int")
    got = {x["mention_id"]: x["entity_ref"] for x in names.attribute_names(m, e).collect()}
    assert got.get(1) == "a" and 3 not in got and set(got) <= {1, 2}


def test_words_beyond_ascii_and_their_places():
    text = "(café), 7班の記録12 plain “x” ‚\\ £5.20 l’été."
    found = mojibake.words_of(text)
    assert [w for _, w in found] == ["café", "班の記録", "“x”", "‚\\", "£", "l’été"]
    assert all(text[at : at + len(w)] == w for at, w in found)


def test_mails_without_a_date_have_no_ancestors(spark):
    rows = [(k, 0, 0, [0], "t", "a", time, [1, 2, 3], [1.0], 9) for k, time in ((1, None), (2, 100), (3, 200))]
    b = spark.createDataFrame(rows, "conv_id bigint, block int, para_idx int, lines array<int>, thread string, sender string, time bigint, shingles array<bigint>, x array<float>, hash bigint")
    assert {r["conv_id"]: r["blocks"][0]["x"][1] for r in mail._featured(b).collect()} == {1: 0.0, 2: 0.0, 3: 1.0}
