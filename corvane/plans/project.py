"""A project: folders of files kept as a stored corpus, brought up to date by comparison.

refresh() reads every file's bytes once for a hash; only contents that no converter of the current version has
seen are converted, each once; a corpus in which no file changed is left as it is. Unit ids are given in path
order and never reused, a path that comes back has its old id again, and the corpus revision moves by one for each
source file that changed. Everything is written into one snapshot, which counts only once it is whole: a scan or
a conversion that fails leaves the last snapshot in place and retires nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import ledger
from corvane.plans.engine import Corpus
from corvane.session import cut_lineage, ship_package
from corvane.sources import convert, notes
from corvane.sources.notes import RECORD

UNITS = "id string, root_id int, path_key string, rel_path string, sha256 string, converter string, deleted boolean"
SCAN = "area string, root_id int, rel_path string, path_key string, sha256 string, converter string"
CACHE = "sha256 string, converter string, paragraphs array<string>, title string, metadata map<string,string>, reason string"
SENT_ROWS = 200_000  # a list of paths is sent to all tasks only below this many rows


@dataclass(frozen=True)
class Refresh:
    """What a refresh did; changed counts source files that are new, changed, back or gone."""

    snapshot: str
    revision: int
    records: int
    skipped: int
    changed: int


class Project:
    """Source folders, and maybe one of notes and one of manuscripts, below storage that all executors share."""

    def __init__(self, spark: SparkSession, folder: str, sources: list[str], notes: str | None = None, manuscript: str | None = None, embed: Callable[[list[str]], list[list[float]]] | None = None):
        ship_package(spark)
        self.spark, self.folder, self.embed = spark, folder.rstrip("/"), embed
        self.corpus = Corpus(spark, f"{self.folder}/corpus")
        self.sources = list(dict.fromkeys(map(self._whole, sources)))  # the same folder twice is read once
        self.notes, self.manuscript = (self._whole(x) if x else None for x in (notes, manuscript))

    def _whole(self, folder: str) -> str:
        """A folder's name with its file system, in one spelling."""
        fs, path = self.corpus._files(folder.rstrip("/") or "/")
        return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString()

    def _there(self, folder: str) -> None:
        fs, path = self.corpus._files(folder)
        if not fs.exists(path) or not fs.getFileStatus(path).isDirectory():
            raise OSError(f"folder is unavailable or not a directory: {folder}")

    def _last(self, name: str, schema: str) -> DataFrame:
        """A table of the last snapshot, empty before the first."""
        snapshot = self.corpus._latest()
        return self.corpus.table(name, snapshot) if snapshot else self.spark.createDataFrame([], schema)

    def _roots(self) -> dict[str, int]:
        """Numbers of the source folders: the last ones stay, new ones follow in the order given. A row per folder."""
        known = {r["root_path"]: r["root_id"] for r in self._last("roots", "root_id int, root_path string").collect()}
        for s in self.sources:
            known.setdefault(s, max(known.values(), default=0) + 1)
        return known

    def _files(self, roots: dict[str, int]) -> DataFrame:
        """(area, root_id, rel_path, path_key, sha256, converter, content) of all files of the project."""
        parts = [convert.scan_files(self.spark, s, roots[s]).withColumn("area", F.lit("source")) for s in self.sources]
        for area, folder in (("note", self.notes), ("manuscript", self.manuscript)):
            if folder:
                parts.append(convert.scan_files(self.spark, folder, 0).where(F.lower("rel_path").endswith(".md")).withColumn("area", F.lit(area)))
        files = parts[0]
        for p in parts[1:]:
            files = files.unionByName(p)
        return files

    def _cache(self) -> DataFrame:
        """Conversions so far: folders that were written whole."""
        fs, at = self.corpus._files(f"{self.folder}/conversions/*/_SUCCESS")
        done = [str(s.getPath().getParent()) for s in fs.globStatus(at) or []]
        return self.spark.read.schema(CACHE).parquet(*done) if done else self.spark.createDataFrame([], CACHE)

    def _convert(self, files: DataFrame, scan: DataFrame) -> DataFrame:
        """Convert what the cache lacks, each content once, and give the whole cache.

        Contents are never shuffled: the files to convert, or those to leave, are told by a list of paths.
        """
        known = self._cache().select("sha256", "converter")
        first = scan.where("area = 'source' AND converter IS NOT NULL").groupBy("sha256", "converter").agg(F.min("path_key").alias("path_key"))
        todo = cut_lineage(first.join(known, ["sha256", "converter"], "left_anti").select("path_key"))
        n, every = todo.count(), scan.count()
        if n:
            few, how = (todo, "left_semi") if 2 * n <= every else (scan.where("area = 'source'").select("path_key").join(todo, "path_key", "left_anti"), "left_anti")
            few = F.broadcast(few) if min(n, every - n) <= SENT_ROWS else few
            new = files.where("area = 'source' AND converter IS NOT NULL").join(few, "path_key", how)
            new = new.select("sha256", "converter", convert.convert("converter", "content").alias("c")).select("sha256", "converter", "c.*")
            new.write.parquet(f"{self.folder}/conversions/{n}-{self.corpus.new_name()}")
        current = list(convert.CONVERTERS.values())
        return self._cache().where(F.col("converter").isin(current))

    def refresh(self) -> Refresh:
        """Bring the corpus up to date with the files; every folder must be there."""
        for folder in [*self.sources, *(x for x in (self.notes, self.manuscript) if x)]:
            self._there(folder)
        opened = self.spark.conf.get("spark.sql.files.openCostInBytes")
        self.spark.conf.set("spark.sql.files.openCostInBytes", str(256 * 1024))  # many small files a task
        try:
            return self._refresh()
        finally:
            self.spark.conf.set("spark.sql.files.openCostInBytes", opened)

    def _refresh(self) -> Refresh:
        last, roots = self.corpus._latest(), self._roots()
        files = self._files(roots)
        scan = cut_lineage(files.drop("content"))
        before = self._last("scan", SCAN)
        same = ["area", "path_key", "sha256", "converter"]
        state = ledger.sync_diff(*[x.select(F.concat_ws(" ", "area", "path_key").alias("ref"), F.concat_ws(" ", *same[2:]).alias("content_hash")) for x in (before, scan)])
        if last and not state.where("change <> 'equal'").limit(1).count():
            return self.report(last, changed=0)
        cache = self._convert(files, scan)
        good = F.coalesce(F.size("paragraphs"), F.lit(0)) > 0
        source = scan.where("area = 'source'")
        status = source.join(cache.select("sha256", "converter", good.alias("good"), "reason"), ["sha256", "converter"], "left")
        skips = status.where(~F.coalesce("good", F.lit(False))).select("path_key", F.when(F.col("converter").isNull(), "no converter for its suffix").otherwise(F.coalesce("reason", F.lit("no text"))).alias("reason"))
        known = self._last("units", UNITS)
        live = status.where("good").select("root_id", "path_key", "rel_path", "sha256", "converter")
        ids = known.select("path_key", "id").unionByName(ledger.register(known.select("path_key", "id"), live))
        live = live.join(ids, "path_key").withColumn("deleted", F.lit(False))
        gone = known.join(live.select("path_key"), "path_key", "left_anti").withColumn("deleted", F.lit(True))
        units = cut_lineage(live.unionByName(gone))
        was = known.select("id", F.struct("sha256", "converter", "deleted").alias("was"))
        changed = units.join(was, "id", "left").where(~F.col("was").eqNullSafe(F.struct("sha256", "converter", "deleted"))).count()
        revision = ledger.next_revision(int(self.corpus.revision(last)) if last else 0, changed)
        records = self._records(units.where("NOT deleted"), cache, files)
        kept = self.spark.createDataFrame([(n, s) for s, n in roots.items()], "root_id int, root_path string")
        name = self.corpus.commit(records, revision=str(revision), more={"scan": scan, "units": units, "skips": skips, "roots": kept}, embed=self.embed)
        return self.report(name, changed)

    def _records(self, units: DataFrame, cache: DataFrame, files: DataFrame) -> DataFrame:
        """Records of all areas; a source without a title has its id as one."""
        s = units.select("id", "rel_path", "sha256", "converter").join(cache, ["sha256", "converter"])
        when = convert.source_date(F.col("converter"), F.col("paragraphs"), F.col("metadata"), F.col("rel_path"))
        title = F.when(F.trim(F.coalesce("title", F.lit(""))) != "", F.col("title")).otherwise(F.col("id"))
        out = s.select(F.col("id").alias("ref"), F.lit("source").alias("kind"), when.alias("record_date"), title.alias("title"), "paragraphs")
        if self.manuscript:
            out = out.unionByName(notes.read_manuscripts(files.where("area = 'manuscript'")))
        if self.notes:
            out = out.unionByName(notes.read_notes(files.where("area = 'note'")), allowMissingColumns=True)
        absent = {c: t for c, t in (x.strip().split(" ", 1) for x in _fields(RECORD)) if c not in out.columns}
        return out.withColumns({c: F.lit(None).cast(t) for c, t in absent.items()}).withColumn("ingested_at", F.lit(None).cast("timestamp_ntz"))

    def report(self, snapshot: str | None = None, changed: int = 0) -> Refresh:
        snapshot = snapshot or self.corpus.current()
        return Refresh(snapshot, int(self.corpus.revision(snapshot)), self.corpus.table("records", snapshot).count(), self.corpus.table("skips", snapshot).count(), changed)

    def skips(self) -> DataFrame:
        """(path_key, reason): files of the last snapshot that gave no record."""
        return self.corpus.table("skips")

    def drift(self) -> DataFrame:
        """(unit_id, kept, retired, added, line): what the last snapshot did to the numbers of each unit's paragraphs."""
        now = self.corpus.current()
        change = F.when(F.col("retired") == now, "retired").when(F.col("retired").isNull() & (F.col("added") == now), "added").when(F.col("retired").isNull(), "kept")
        return ledger.drift(self.corpus.anchors(now).withColumn("change", change).where(change.isNotNull()))


def _fields(schema: str) -> list[str]:
    """The fields of a schema text, parted at commas outside of brackets."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:k])
            start = k + 1
    return [*out, schema[start:]]
