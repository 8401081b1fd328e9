"""Notes (Markdown with frontmatter) and manuscripts as records.

A note is never refused: a field that does not hold what it should is cleared and a warning kept. The
frontmatter is the small part of YAML that four fields need: scalars, lists in either form, one nested
mapping. Both readers are Arrow-batched over binary scans; manuscripts get one record a file and one a
heading of depth 1 or 2.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import dates
from corvane.functions import text as T
from corvane.sources.convert import decode, paragraphs_of

FIELDS = ("aliases", "window", "corpus_revision", "coverage_complete")
_FENCE = re.compile(r"\A---[ \t]*\r?\n(.*?)^---[ \t]*(?:\r?\n|\Z)", re.DOTALL | re.MULTILINE)
RECORD = (
    "ref string, kind string, note_type string, record_date struct<iso:string,confidence:string,granularity:string,text:string>, title string, "
    "paragraphs array<string>, aliases array<string>, note_window struct<day_from:string,day_to:string>, corpus_revision string, coverage_complete boolean, warnings array<string>"
)


def _scalar(text: str):
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in text[1:-1].split(",") if x.strip()]
    if text.startswith("{") and text.endswith("}"):
        return {k.strip(): _scalar(v) for k, _, v in (x.partition(":") for x in text[1:-1].split(",") if x.strip())}
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if re.fullmatch(r"-?\d+", text):
        return int(text)
    return None if text in ("", "~", "null") else text


def frontmatter(block: str) -> dict:
    """Fields of a frontmatter block; ValueError where a line is none of the forms understood."""
    out: dict = {}
    key = None
    for line in block.split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if m := re.match(r"([\w-]+)\s*:(?:\s+(.*))?$", line.rstrip()):
            key = m[1]
            out[key] = _scalar(m[2] or "")
        elif (m := re.match(r"\s*-\s+(.*)$", line)) and key is not None and out[key] in (None, [], *([out[key]] if isinstance(out[key], list) else [])):
            out[key] = [*(out[key] or []), _scalar(m[1])]
        elif (m := re.match(r"\s+([\w-]+)\s*:\s*(.*)$", line)) and key is not None and (out[key] is None or isinstance(out[key], dict)):
            out[key] = {**(out[key] or {}), m[1]: _scalar(m[2])}
        else:
            raise ValueError(line)
    return out


def _day(value) -> str | None:
    try:
        return date.fromisoformat(value).isoformat() if isinstance(value, str) and len(value) == 10 else None
    except ValueError:
        return None


def note_fields(relative: str, raw: bytes, cap: int = 2000) -> dict:
    """One note's record as a dict."""
    ref, folder = f"notes/{relative}", relative.split("/")[0] if "/" in relative else None
    text, warnings, data = decode(raw), [], {}
    if m := _FENCE.match(text):
        text = text[m.end() :]
        try:
            data = frontmatter(m[1])
        except ValueError:
            warnings.append(f"{ref}: frontmatter is not understood; ignored")
    for key in [k for k in data if k not in FIELDS]:
        warnings.append(f"{ref}: unknown field {key}; ignored")
    values = {k: data[k] for k in FIELDS if k in data}
    if folder != "digest":
        for key in ("corpus_revision", "coverage_complete"):
            if values.pop(key, None) is not None:
                warnings.append(f"{ref}: {key} belongs to digests; cleared")

    def keep(key: str, ok: bool, what: str):
        if key in values and not ok:
            warnings.append(f"{ref}: {key} is not {what}; cleared")
            del values[key]

    a, w = values.get("aliases"), values.get("window")
    keep("aliases", isinstance(a, list) and all(isinstance(x, str) for x in a), "a list of names")
    window = (_day(w.get("from")), _day(w.get("to"))) if isinstance(w, dict) and set(w) == {"from", "to"} else (None, None)
    keep("window", None not in window and window[0] <= window[1], "a valid pair of days")
    revision = values.get("corpus_revision")
    keep("corpus_revision", isinstance(revision, str) and revision != "", "a text")
    keep("coverage_complete", isinstance(values.get("coverage_complete"), bool), "true or false")
    if "coverage_complete" in values and "corpus_revision" not in values:
        warnings.append(f"{ref}: coverage_complete stands without corpus_revision; cleared")
        del values["coverage_complete"]
    if relative == "project.md" and (n := len(text.split())) > cap:
        warnings.append(f"{ref}: {n} words, over the cap of {cap}")
    ps = paragraphs_of(text)
    title = next((m[1].strip() for p in ps if (m := re.match(r"#\s+(.+)", p))), relative.rsplit("/", 1)[-1].rsplit(".", 1)[0])
    return {
        "ref": ref, "kind": "note", "note_type": folder, "record_date": ("", "unknown", "day", ""), "title": title, "paragraphs": ps,
        "aliases": values.get("aliases", []), "note_window": window if "window" in values else None, "corpus_revision": values.get("corpus_revision"),
        "coverage_complete": values.get("coverage_complete"), "warnings": warnings,
    }


def read_notes(files: DataFrame) -> DataFrame:
    """Records of note files (rel_path, content); files that are no Markdown are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([note_fields(p, bytes(c)) for p, c in zip(b["rel_path"], b["content"])], columns=[c.split()[0] for c in _COLUMNS])

    return files.where(F.lower("rel_path").endswith(".md")).select("rel_path", "content").mapInPandas(run, RECORD)


_COLUMNS = ["ref", "kind", "note_type", "record_date", "title", "paragraphs", "aliases", "note_window", "corpus_revision", "coverage_complete", "warnings"]


def read_manuscripts(files: DataFrame) -> DataFrame:
    """(ref, kind, record_date, title, paragraphs): a record a file and a record a section of depth 1 or 2."""
    f = files.where(F.lower("rel_path").endswith(".md")).select(F.concat(F.lit("manuscript/"), "rel_path").alias("path"), F.col("content").cast("string").alias("body"))
    f = f.select("path", T.split_paragraphs("body").alias("ps"), dates.date_chain(F.lit("manuscript"), dates.first_line_date(F.col("body")), dates.path_date(F.col("path"))).alias("record_date"))
    depth = F.transform("ps", lambda p: T.heading_depth(p))
    f = f.withColumn("depth", depth)
    heading = lambda p: F.trim(F.regexp_replace(p, r"^#+\s+|\n[\s\S]*$", ""))
    first = F.try_element_at(F.filter("ps", lambda p: T.heading_depth(p) > 0), F.lit(1))
    whole = f.select(F.col("path").alias("ref"), F.lit("manuscript").alias("kind"), "record_date", F.coalesce(heading(first), T.first_sentence("ps"), "path").alias("title"), F.col("ps").alias("paragraphs"))
    s = f.select("path", "record_date", "ps", "depth", F.posexplode("depth").alias("at", "d")).where("d BETWEEN 1 AND 2")
    later = F.filter(F.sequence(F.lit(1), F.size("ps")), lambda i: (i > F.col("at") + 1) & (F.element_at("depth", i) > 0) & (F.element_at("depth", i) <= F.col("d")))
    end = F.coalesce(F.try_element_at(later, F.lit(1)), F.size("ps") + 1)
    s = s.select("path", "record_date", "at", heading(F.element_at("ps", F.col("at") + 1)).alias("heading"), F.slice("ps", F.col("at") + 1, end - F.col("at") - 1).alias("paragraphs"))
    from pyspark.sql import Window

    s = s.withColumn("n", F.row_number().over(Window.partitionBy("path", "heading").orderBy("at")))
    ref = F.concat("path", F.lit(" # "), "heading", F.when(F.col("n") > 1, F.concat(F.lit(" ("), "n", F.lit(")"))).otherwise(""))
    return whole.unionByName(s.select(ref.alias("ref"), F.lit("manuscript").alias("kind"), "record_date", F.col("heading").alias("title"), "paragraphs"))
