"""The two verbs over a stored corpus: search and read; snapshots, cursors, budgets.

A snapshot is a folder of tables, written whole and then named by a pointer file, so that readers always
see one consistent state and a failed write leaves the last one in place. Queries pin a snapshot; nothing
is refreshed while one runs. What a scope holds is found once; its further pages are read from stored lists by number.
"""

from __future__ import annotations

import base64
import json
import math
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import dates, refs
from corvane.functions import text as T
from corvane.operators import ledger, plan, read, records, search
from corvane.session import cut_lineage

HITS, BROWSE_HITS, ROWS = 100, 500, 500
SOURCE = r"^SRC-\d{6,}$"  # records whose paragraphs are cited by number
ANCHORS = "unit_id string, p int, idx int, text string, live string, added string, retired string"
SCOPES = 32  # scopes whose evidence is kept for further pages
LISTS = ("hits", "months", "covered", "chunks")  # the lists of a reply; each is paged by an offset of its own


@dataclass(frozen=True)
class ProjectConfig:
    """Settings of a project; from_dict() refuses unknown keys and wrong types."""

    corpus: tuple[str, ...] = ()
    manuscript: str | None = None
    chunk_tokens: int = 80_000
    reply_tokens: int = 7_980

    @classmethod
    def from_dict(cls, data: dict) -> "ProjectConfig":
        unknown = sorted(set(data) - {"corpus", "manuscript", "chunk_tokens", "reply_tokens"})
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        c = cls(tuple(dict.fromkeys(data.get("corpus", ()))), data.get("manuscript"), data.get("chunk_tokens", 80_000), data.get("reply_tokens", 7_980))
        if any(not isinstance(x, str) for x in c.corpus) or not isinstance(c.manuscript, str | None):
            raise ValueError("corpus is a list of paths, manuscript a path")
        if isinstance(c.chunk_tokens, bool) or not isinstance(c.chunk_tokens, int) or c.chunk_tokens <= 0:
            raise ValueError("chunk_tokens is a positive number")
        if not 2000 <= c.reply_tokens <= 8000:
            raise ValueError("reply_tokens lies between 2000 and 8000")
        return c


def encode_cursor(payload: dict) -> str:
    raw = json.dumps(payload, separators=(",", ":"), sort_keys=True).encode()
    return base64.urlsafe_b64encode(raw).decode().rstrip("=")


def decode_cursor(cursor: str) -> dict:
    try:
        out = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
    except ValueError:
        raise ValueError("not a cursor") from None
    if not isinstance(out, dict) or "rev" not in out:
        raise ValueError("not a cursor")
    return out


@dataclass
class Reply:
    header: dict
    hits: list[dict]
    months: list[dict] = field(default_factory=list)
    covered: list[dict] = field(default_factory=list)
    chunks: list[dict] = field(default_factory=list)
    continuation: str | None = None

    def text(self) -> str:
        lines = [f"{k.ljust(16)} {v}" for k, v in self.header.items()]
        lines += [f"{m['month'].ljust(16)} {m['records']} records, {m['tokens']} tokens" for m in self.months]
        lines += [f"{'covered'.ljust(16)} {c['ref']} {c['day_from']} to {c['day_to']}" for c in self.covered]
        lines += [f"{'chunk'.ljust(16)} {c['chunk']}: {c['records']} records, {c['tokens']} tokens" for c in self.chunks]
        lines += [f"{h['citation'].ljust(16)} {h['date']}  {h['title']}  ({h['matches']})" for h in self.hits]
        return "\n".join([*lines, *([f"{'continue'.ljust(16)} {self.continuation}"] if self.continuation else [])])

    def tokens(self) -> int:
        return math.ceil(len(self.text().encode()) / 4)


@dataclass
class ReadReply:
    ref: str
    pieces: list[tuple[str, str, str]]
    warnings: list[str] = field(default_factory=list)
    continuation: str | None = None

    def payload(self) -> str:
        """The page's share of the stored text."""
        return "".join(t + s for _, t, s in self.pieces)

    def text(self) -> str:
        lines = [f"{'warning'.ljust(16)} {w}" for w in self.warnings] + [f"{label.ljust(16)} {t}" for label, t, _ in self.pieces]
        return "\n".join([*lines, *([f"{'continue'.ljust(16)} {self.continuation}"] if self.continuation else [])])


class Found:
    """What a scope holds: its totals, and lists that are read by page.

    The first rows of a list come from a top-k; only when a later page is asked for is the list sorted, numbered
    and written to the shared folder, once, and pages are then read by number.
    """

    def __init__(self, header: dict, lists: dict[str, tuple[DataFrame, list[str], list]]):
        self.header, self._lists = header, lists
        self._first: dict[str, tuple[int, list[dict]]] = {}  # rows asked for, and those there were
        self._numbered: dict[str, DataFrame] = {}

    def page(self, name: str, start: int, count: int) -> list[dict]:
        rows, order, show = self._lists[name]
        if start == 0:
            if self._first.get(name, (0, []))[0] < count:
                self._first[name] = count, [x.asDict() for x in rows.orderBy(*[_sorted(k) for k in order]).select(*show).limit(count).collect()]
            return self._first[name][1][:count]
        if name not in self._numbered:
            self._numbered[name] = cut_lineage(numbered(rows, order, show))
        n = F.col("row_number")
        return [x.asDict() for x in self._numbered[name].where((n >= start) & (n < start + count)).orderBy(n).drop("row_number").collect()]


def _sorted(key: str):
    return F.desc(key[1:]) if key.startswith("-") else F.asc(key)


def numbered(rows: DataFrame, order: list[str], show: list) -> DataFrame:
    """The shown columns of the rows with row_number from 0 in a total order (-key: descending), counted by range partitions."""
    order_by = [_sorted(k) for k in order]
    parts = rows.repartitionByRange(*order_by).sortWithinPartitions(*order_by).select(*show)
    parts = cut_lineage(parts.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id() % (1 << 33)}))
    before = parts.groupBy("part").agg(F.count("*").alias("k"))
    before = before.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))  # a row per partition
    return parts.join(F.broadcast(before), "part").withColumn("row_number", F.col("at") + F.col("before")).drop("part", "at", "before")


class Corpus:
    """A stored corpus below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._found: dict[tuple, Found] = {}  # the evidence of the last scopes, which pages share

    def _files(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def commit(self, raw_records: DataFrame, vectors: DataFrame | None = None, revision: str = "0", more: dict[str, DataFrame] | None = None, embed=None) -> str:
        """Write a snapshot and point to it; returns its name. Paragraphs keep their numbers from the one before.

        more has further tables of the snapshot by name. embed makes vectors of a list of texts; those of texts
        that the snapshot before holds are taken from there.
        """
        name, before = self.new_name(), self._latest()
        base = f"{self.folder}/{name}"
        for extra, rows in (more or {}).items():
            rows.write.parquet(f"{base}/{extra}")
        r = records.records_of(raw_records)
        r.write.parquet(f"{base}/records")
        p = records.paragraphs_of(self.spark.read.parquet(f"{base}/records"))
        p.repartition("ref").sortWithinPartitions("ref", "idx").write.parquet(f"{base}/paragraphs")
        self._align(before, name).repartition("unit_id").sortWithinPartitions("unit_id", "p").write.parquet(f"{base}/anchors")
        if embed is not None:
            fs, kept = self._files(f"{self.folder}/{before}/vectors")
            known = self.table("vectors", before).select("text_hash", "embedding").dropDuplicates(["text_hash"]) if before and fs.exists(kept) else None
            vectors = search.embedded(self.table("paragraphs", name), known, embed)
        if vectors is not None:
            vectors.write.parquet(f"{base}/vectors")
        self.spark.createDataFrame([(name, revision)], "name string, revision string").coalesce(1).write.json(f"{base}/pointer")
        fs, target = self._files(f"{self.folder}/CURRENT-{name}")
        fs.create(target, False).close()  # the name of an empty file is the pointer; the newest one counts
        return name

    def _latest(self) -> str | None:
        fs, at = self._files(self.folder)
        listed = fs.listStatus(at) if fs.exists(at) else []
        named = [(s.getModificationTime(), s.getPath().getName()) for s in listed if s.getPath().getName().startswith("CURRENT-")]
        return max(named)[1].removeprefix("CURRENT-") if named else None

    @staticmethod
    def new_name() -> str:
        return uuid.uuid4().hex

    def current(self) -> str:
        name = self._latest()
        if name is None:
            raise LookupError("no snapshot was committed")
        return name

    def anchors(self, snapshot: str | None = None) -> DataFrame:
        """(unit_id, p, idx, text, added, retired): every number that a source record's paragraphs ever had.

        A live one has its place in the snapshot, a retired one its text and the snapshot that retired it.
        """
        snapshot = snapshot or self.current()
        try:
            return self.table("anchors", snapshot)
        except Exception as e:  # written before anchors were: paragraphs were cited by position
            if "PATH_NOT_FOUND" not in str(e):
                raise
        p = self.table("paragraphs", snapshot).where(F.col("ref").rlike(SOURCE))
        return p.select(F.col("ref").alias("unit_id"), (F.col("idx") + 1).alias("p"), "idx", F.lit(None).cast("string").alias("text"), F.lit(snapshot).alias("added"), F.lit(None).cast("string").alias("retired"))

    def _align(self, before: str | None, name: str) -> DataFrame:
        """The anchors of a new snapshot, whose paragraphs are written, from those of the one before."""
        new = self.table("paragraphs", name).where(F.col("ref").rlike(SOURCE)).withColumnRenamed("ref", "unit_id")
        if before is None:
            old = self.spark.createDataFrame([], ANCHORS)
        else:
            was = self.table("paragraphs", before).select(F.col("ref").alias("unit_id"), "idx", F.col("text").alias("live"))
            old = self.anchors(before).join(was, ["unit_id", "idx"], "left").select("unit_id", "p", "idx", "text", "live", "added", "retired")
        # retired numbers go along without a text: they match nothing and stay taken
        j = ledger.align(old.select("unit_id", "p", F.col("live").alias("text"), F.col("idx").alias("pos")), new)
        j = j.join(old.drop("idx"), ["unit_id", "p"], "left")
        gone = F.col("change") == "retired"
        return j.select(
            "unit_id", F.col("p").cast("int").alias("p"), "idx", F.when(gone, F.coalesce("text", "live")).alias("text"),
            F.coalesce("added", F.lit(name)).alias("added"), F.when(gone, F.coalesce("retired", F.lit(name))).alias("retired"),
        )

    def table(self, name: str, snapshot: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{snapshot or self.current()}/{name}")

    def revision(self, snapshot: str) -> str:
        return self.spark.read.json(f"{self.folder}/{snapshot}/pointer").first()["revision"]

    def search(self, query: str = "", from_: str | None = None, to: str | None = None, who: str | None = None, kind: str | None = None, cursor: str | None = None, config: ProjectConfig = ProjectConfig()) -> Reply:
        """Ranked hits of a query, or all records in browse order, with exact totals and a reading plan.

        The reply continues while any of its lists has rows left; a plan keeps the chunk size of its first page.
        """
        at: dict[str, int | None] = dict.fromkeys(LISTS, 0)  # rows of each list shown before; None where it has ended
        chunk_tokens = config.chunk_tokens
        if cursor is not None:
            if query or from_ or to or who or kind:
                raise ValueError("a cursor stands alone")
            c = decode_cursor(cursor)
            if not isinstance(c.get("at"), dict) or set(c["at"]) != set(LISTS):
                raise ValueError("not a cursor")
            query, from_, to, who, kind, at, chunk_tokens = c["query"], c["from"], c["to"], c["who"], c["kind"], c["at"], c["chunk_tokens"]
            snapshot = self.current()
            if c["rev"] != snapshot:
                raise ValueError(f"the corpus changed since this cursor was made; search again: {query!r} {from_ or ''}..{to or ''}")
        snapshot = self.current()
        scope_key = (snapshot, query, from_, to, who, kind, chunk_tokens)
        caps = {**dict.fromkeys(LISTS, ROWS), "hits": HITS if T.query_phrases(query) else BROWSE_HITS}
        found = self._found.get(scope_key)
        if found is None:
            found = self._find(*scope_key)
            if len(self._found) >= SCOPES:
                self._found.pop(next(iter(self._found)))
            self._found[scope_key] = found
        # one row beyond the cap tells whether a list goes on
        rows = {k: found.page(k, at[k], caps[k] + 1) if at[k] is not None else [] for k in LISTS}
        reply = Reply(dict(found.header), **{k: rows[k][: caps[k]] for k in LISTS})
        scope = {"t": "search", "rev": snapshot, "query": query, "from": from_, "to": to, "who": who, "kind": kind, "chunk_tokens": chunk_tokens}
        shown = {k: getattr(reply, k) for k in LISTS}

        def settle() -> None:
            after = {k: at[k] + len(shown[k]) if len(shown[k]) < len(rows[k]) else None for k in LISTS}
            reply.continuation = encode_cursor({**scope, "at": after}) if any(v is not None for v in after.values()) else None

        settle()
        while reply.tokens() > config.reply_tokens:
            longest = max(shown.values(), key=len)
            if not longest:
                break
            longest.pop()
            settle()
        if reply.continuation and not any(shown.values()):
            raise ValueError("not one row fits into the reply budget; narrow the scope")
        return reply

    def _find(self, snapshot: str, query: str, from_: str | None, to: str | None, who: str | None, kind: str | None, chunk_tokens: int) -> "Found":
        """The evidence of a scope: totals, and the four lists in their orders."""
        r, p = self.table("records", snapshot), self.table("paragraphs", snapshot)
        named = None
        if who:
            names = [n["name"] for n in records.names_for(r.where("kind = 'note'"), who).collect()]  # one entity's names
            texts = p.select("ref", "text").unionByName(r.select("ref", F.col("title").alias("text")))
            named = search.any_phrase(texts, ["ref"], [[w for q in T.query_phrases(n) for w in q] for n in names])
        ok = records.eligible(r, from_, to, kind, named)
        phrases = T.query_phrases(query)
        if phrases:
            lex = search.bm25(p, ["ref", "idx"], phrases).join(ok.select("ref"), "ref", "left_semi")
            lex = search.ranked(lex, ["score", "ref", "idx"], "lex_rank").select("ref", "idx", "lex_rank")
            try:
                vectors = self.table("vectors", snapshot)
                sem = search.knn(vectors.join(ok.select("ref"), "ref", "left_semi"), ["ref", "idx"], search.hashing_embedder(query))
                sem = search.ranked(sem, ["distance", "ref", "idx"], "sem_rank").select("ref", "idx", "sem_rank")
            except Exception as e:  # a corpus without vectors
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                sem = lex.limit(0).withColumnRenamed("lex_rank", "sem_rank")
            hits = cut_lineage(search.by_record(search.fuse(lex, sem, ["ref", "idx"])))
            whole = r.join(hits, "ref")
        else:
            nothing = {"best_idx": F.lit(None).cast("int"), "matches": F.lit(1).cast("bigint"), "lexical_matches": F.lit(0).cast("bigint"), "score": F.lit(0.0)}
            whole = ok.withColumns(nothing)
        cov = plan.coverage(r, self.revision(snapshot), from_, to)
        todo = plan.chunk_plan(plan.plan_candidates(whole.drop("best_idx", "matches", "lexical_matches", "score"), cov), chunk_tokens)
        chunks = todo.groupBy("chunk").agg(F.countDistinct("ref").alias("records"), F.sum("tokens").alias("tokens"))
        order = ["-score", "ref"] if phrases else list(records.BROWSE)
        citation = F.when(F.col("p").isNull(), F.col("ref")).otherwise(F.concat_ws(" ", "ref", F.concat(F.lit("p"), "p")))
        numbers = self.anchors(snapshot).where("retired IS NULL").select(F.col("unit_id").alias("ref"), F.col("idx").alias("best_idx"), "p")
        cited = whole.join(numbers, ["ref", "best_idx"], "left") if phrases else whole.withColumn("p", F.lit(None).cast("int"))
        show = [citation.alias("citation"), dates.display_date().alias("date"), T.cap_at_word(F.coalesce("title", F.lit(""))).alias("title"), "matches"]
        header = search.totals(whole).first().asDict()
        lists = {"hits": (cited, order, show), "months": (records.by_month(whole), ["month"], ["*"]), "covered": (cov, ["day_from", "ref"], ["*"]), "chunks": (chunks, ["chunk"], ["*"])}
        return Found(header, lists)

    def read(self, ref: str, page: int = 0, config: ProjectConfig = ProjectConfig()) -> tuple[str, int]:
        """(text of the page, number of pages) of a record or file, or of paragraphs of a record by their numbers.

        A range goes from one live number to another in document order. A retired number gives the text that it
        named, between a line that says so and one that names the record to read instead.
        """
        pages = self._pages(ref, self.current(), config)
        return "".join(t + s for _, t, s in pages[page]), len(pages)

    def read_reply(self, ref: str | None = None, cursor: str | None = None, config: ProjectConfig = ProjectConfig()) -> ReadReply:
        """A page with its labels, the warnings of a note or manuscript, and a cursor while anything is left.

        The texts and separators of all pages join to the stored text. Warnings take up to a quarter of a
        reply; what does not fit comes with the next ones.
        """
        if (ref is None) == (cursor is None):
            raise ValueError("give a reference or a cursor")
        page, told, snapshot = 0, 0, self.current()
        if cursor is not None:
            c = decode_cursor(cursor)
            if c.get("t") != "read":
                raise ValueError("not a cursor of a read")
            if c["rev"] != snapshot:
                raise ValueError(f"the corpus changed since this cursor was made; read again: {c['ref']}")
            ref, page, told = c["ref"], c["page"], c["told"]
        room = config.reply_tokens * 4 - 1000
        warnings = self._warnings(ref, snapshot)
        if warnings:
            room -= config.reply_tokens
        pages = self._pages(ref, snapshot, config, room)
        reply, left = ReadReply(ref, pages[page] if page < len(pages) else []), config.reply_tokens
        for w in warnings[told:]:
            left -= len(w.encode()) + 1
            if left < 0 and reply.warnings:
                break
            reply.warnings.append(w)
        after = {"page": min(page + 1, len(pages)), "told": told + len(reply.warnings)}
        if after["page"] < len(pages) or after["told"] < len(warnings):
            reply.continuation = encode_cursor({"t": "read", "rev": snapshot, "ref": ref, **after})
        return reply

    def _warnings(self, ref: str, snapshot: str) -> list[str]:
        """The stored warnings of a note or manuscript, and what its citations of source records miss."""
        r = refs.parse(ref)
        if r.id:
            return []
        stored = self.table("records", snapshot).where(F.col("ref") == r.render()).select("warnings").first()
        texts = self.table("paragraphs", snapshot).where(F.col("ref") == r.render()).orderBy("idx").select(refs.find_refs(F.col("text")).alias("r"))
        cited = list(dict.fromkeys(x for row in texts.collect() for x in row["r"]))  # one record's
        out = list(stored["warnings"] or []) if stored else []
        if cited:
            parsed = [refs.parse(x) for x in cited]
            ids = sorted({x.id for x in parsed})
            known = {(x["unit_id"], x["p"]): x["retired"] for x in self.anchors(snapshot).where(F.col("unit_id").isin(ids)).select("unit_id", "p", "retired").collect()}
            units = {u for u, _ in known}
            for x in parsed:
                if x.id not in units:
                    out.append(f"{x.render()}: no such record")
                for n in (x.anchor, x.end):
                    if x.id in units and n is not None:
                        if (x.id, n) not in known:
                            out.append(f"{x.render()}: {x.id} never had p{n}")
                        elif known[x.id, n]:
                            out.append(f"{x.render()}: p{n} is retired")
        return out

    def _pages(self, ref: str, snapshot: str, config: ProjectConfig, room: int | None = None) -> list[list[tuple[str, str, str]]]:
        """The pages of a reference as (label, text, separator)."""
        room = room or config.reply_tokens * 4 - 1000
        r = refs.parse(ref)
        p = self.table("paragraphs", snapshot).where(F.col("ref") == (r.id or r.render()))
        number: dict[int, int] = {}
        if r.id:
            known = self.anchors(snapshot).where(F.col("unit_id") == r.id)
            own = {x["p"]: x for x in known.drop("text").collect()}  # one record
            number = {x["idx"]: n for n, x in own.items() if x["retired"] is None}
        if r.shape in ("anchor", "range", "tail"):
            for n in (r.anchor, r.end):
                if n is not None and n not in own:
                    raise LookupError(f"nothing to read at {ref}: {r.id} never had p{n}")
            if r.shape == "anchor" and own[r.anchor]["retired"]:
                text = known.where(F.col("p") == r.anchor).first()["text"]
                text = f"{r.render()} - retired by snapshot {own[r.anchor]['retired']}; the text it cited:\n{text}\nThe record's current text is {r.id}."
                return read.paginate([(r.render(), text)], room)
            for n in (r.anchor, r.end):
                if n is not None and own[n]["retired"]:
                    raise LookupError(f"{ref}: p{n} is retired; read {r.id} p{n} for the text it named")
            first = own[r.anchor]["idx"]
            last = {"anchor": first, "range": own[r.end]["idx"] if r.end is not None else None, "tail": max(number)}[r.shape]
            if last < first:
                raise ValueError(f"the range is reversed: {ref}")
            p = p.where(F.col("idx").between(first, last))
        units = [(f"{x['ref']} p{number[x['idx']]}" if x["idx"] in number else x["ref"], x["text"]) for x in p.orderBy("idx").collect()]  # one record
        if not units:
            raise LookupError(f"nothing to read at {ref}")
        return read.paginate(units, room)
