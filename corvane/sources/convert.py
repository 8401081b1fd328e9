"""Converters from raw files to paragraphs: text, Markdown, mail, DOCX; PDF where a reader is installed.

A file becomes struct(paragraphs, title, metadata, reason): paragraphs, or the reason why it has none.
Conversion runs in Arrow batches over binary scans; the table of converters names a version, so that a
cache by (sha256, converter) knows what is stale.
"""

from __future__ import annotations

import email
import io
import re
import zipfile
import zlib
from datetime import date, datetime, timezone
from email.errors import HeaderParseError
from email.header import decode_header
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from corvane.functions import dates

CONVERTERS = {".txt": "text@1", ".md": "text@1", ".eml": "eml@2", ".docx": "docx@1", ".pdf": "pdf@1"}
RESULT = StructType(
    [
        StructField("paragraphs", ArrayType(StringType())),
        StructField("title", StringType()),
        StructField("metadata", MapType(StringType(), StringType())),
        StructField("reason", StringType()),
    ]
)

# A line without a colon that a mail server wrote among the headers; the producer's footer between
# rules of asterisks; the line before a forwarded mail.
_STRAY = re.compile(rb"^Microsoft Mail Internet Headers Version [\d.]+\r?\n", re.MULTILINE)
FOOTER = "EDRM Enron Email Data Set has been produced "
_FENCE = re.compile(r"\*{5,}[ \t]*")
_FORWARDED = re.compile(r"-+\s*Original Message\s*-+", re.IGNORECASE)


def converter_of(path: Column) -> Column:
    """The versioned converter of a path's suffix, null where there is none."""
    table = F.create_map(*[F.lit(x) for pair in CONVERTERS.items() for x in pair])
    return table[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))]


def decode(raw: bytes) -> str:
    """UTF-8, else Windows-1252 with replacements."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("cp1252", errors="replace")


def paragraphs_of(text: str) -> list[str]:
    text = re.sub(r"(?m)^(#{1,6}[^\S\n]+\S[^\n]*)$", r"\n\n\1\n\n", text.replace("\r\n", "\n"))
    return [p for p in (x.strip() for x in re.split(r"\n\s*\n", text)) if p]


def _refuse(text: str, paragraphs: list[str]) -> str | None:
    control = sum(1 for c in text if (c < " " and c not in "\n\t\r") or c == "\x7f")
    if "\0" in text or control > 0.1 * max(1, len(text)):
        return "binary content"
    if any(len(p) >= 2000 and sum(c.isspace() for c in p) < 0.02 * len(p) for p in paragraphs):
        return "no words"
    return None


def first_sentence(paragraphs: list[str], cap: int = 120) -> str:
    """The first sentence of the first paragraph with text, cut at a blank where it is too long."""
    text = next((t for p in paragraphs if (t := " ".join(p.split()))), "")
    found = re.match(r"""(.*?[.!?]["')\]’”]*)(?:\s|$)""", text)
    text = found[1] if found else text
    return text if len(text) <= cap else (text[: cap + 1].rpartition(" ")[0] or text[:cap])


def _text(raw: bytes) -> tuple:
    text = decode(raw)
    ps = paragraphs_of(text)
    reason = _refuse(text, ps) or (None if ps else "empty")
    heading = next((p.lstrip("#").strip() for p in ps if re.match(r"#{1,6}\s+\S", p)), None)
    return (None if reason else ps), heading or first_sentence(ps) or None, {}, reason


def thread_metadata(index: str) -> dict[str, str]:
    """Thread ids of a base64 Thread-Index: 22 bytes name the conversation, 5 more each reply."""
    import base64
    import binascii

    try:
        raw = base64.b64decode(index, validate=False)
    except (binascii.Error, ValueError):
        return {}
    if len(raw) < 22:
        return {}
    out = {"thread_index": raw.hex(), "thread_conversation_id": raw[:22].hex()}
    if len(raw) >= 27:
        out["thread_parent_index"] = raw[:-5].hex()
    return out


def _headers(message: email.message.Message, name: str) -> list[str]:
    """All values of a header, unfolded; raw bytes beyond ASCII are decoded as text files are."""
    values = [decode(v.encode("utf-8", "surrogateescape")) for k, v in message.raw_items() if k.lower() == name]
    return [re.sub(r"\r?\n(?=[ \t])", "", v) for v in values]


def _words(value: str) -> str:
    """A header value with its encoded words decoded, all else as written."""
    try:
        parts = decode_header(value)
    except (HeaderParseError, ValueError):
        return value
    out = []
    for chunk, charset in parts:
        if isinstance(chunk, bytes):
            try:
                chunk = chunk.decode(charset) if charset else decode(chunk)
            except (LookupError, UnicodeDecodeError):
                chunk = decode(chunk)
        out.append(chunk)
    return "".join(out)


def own_text(body: str) -> str:
    """A mail body without the producer's footer, lines marked as quoted, and what follows a forwarded header."""
    lines, kept, k = body.split("\n"), [], 0
    while k < len(lines):
        fenced = _FENCE.fullmatch(lines[k]) and k + 1 < len(lines) and lines[k + 1].startswith(FOOTER)
        end = next((j for j in range(k + 2, len(lines)) if _FENCE.fullmatch(lines[j])), None) if fenced else None
        if end is None:
            kept.append(lines[k])
        else:
            kept.append("")
            k = end
        k += 1
    forwarded = lambda j: _FORWARDED.fullmatch(kept[j].strip()) or (re.match(r"From:\s", kept[j]) and j + 1 < len(kept) and re.match(r"Sent:\s", kept[j + 1]))
    cut = next((j for j in range(len(kept)) if forwarded(j)), len(kept))
    return "\n".join(x for x in kept[:cut] if not x.startswith(">"))


def _moment(text: str) -> datetime | None:
    try:
        return parsedate_to_datetime(text)
    except (TypeError, ValueError):
        return None


def mail_date(message: email.message.Message) -> dict[str, str]:
    """The day of the Date header as the sender's clock had it, else of the earliest Received header."""
    for text in _headers(message, "date")[:1]:
        if sent := _moment(text):
            return {"date_iso": sent.date().isoformat(), "date_confidence": "exact", "date_text": text.strip()}
    tails = [text.rpartition(";")[2].strip() or text.strip() for text in _headers(message, "received")]
    known = [(m if m.tzinfo else m.replace(tzinfo=timezone.utc), m, text) for text in tails if (m := _moment(text))]
    if not known:
        return {}
    _, first, text = min(known, key=lambda x: x[0])
    return {"date_iso": first.date().isoformat(), "date_confidence": "inferred", "date_text": f"Received {text}"}


def _mail(raw: bytes) -> tuple:
    m = email.message_from_bytes(_STRAY.sub(b"", raw, count=1))
    value = {k: next((_words(v) for v in _headers(m, k.lower())), None) for k in ("From", "To", "Cc", "Date", "Subject")}
    head = "\n".join(f"{k}: {v or ''}" for k, v in value.items() if v is not None or k in ("From", "To", "Subject"))
    part = next((p for p in m.walk() if p.get_content_type() == "text/plain" and not (m.is_multipart() and p.get_filename() is not None)), None)
    ps = [head]
    if part is not None:
        payload = part.get_payload(decode=True) or b""
        try:
            body = payload.decode(part.get_content_charset() or "latin-1")
        except (LookupError, UnicodeDecodeError):
            body = payload.decode("latin-1")
        ps += [p for p in (x.strip() for x in re.split(r"\n[ \t]*\n+", own_text(body.replace("\r\n", "\n")))) if p]
    reason = _refuse("\n\n".join(ps), ps)
    title = (value["Subject"] or "").strip() or first_sentence(ps[1:])
    return (None if reason else ps), title or None, {**thread_metadata((m["Thread-Index"] or "").strip()), **mail_date(m)}, reason


def _docx(raw: bytes) -> tuple:
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml"))
            core = ElementTree.fromstring(z.read("docProps/core.xml")) if "docProps/core.xml" in z.namelist() else None
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None, None, {}, "unreadable docx"
    ps, heading = [], None
    for p in body.iter(f"{w}p"):
        if text := "".join(x.text or "" for x in p.iter(f"{w}t")).strip():
            ps.append(text)
            style = p.find(f"{w}pPr/{w}pStyle")
            if heading is None and style is not None and (style.get(f"{w}val") or "").lower().startswith(("heading", "title")):
                heading = text
    created = core.findtext("{http://purl.org/dc/terms/}created") if core is not None else None
    reason = _refuse("\n\n".join(ps), ps) or (None if ps else "empty")
    return (None if reason else ps), heading or first_sentence(ps) or None, _created("docx created", created), reason


def _created(label: str, text: str | None) -> dict[str, str]:
    """The day that a document's properties name (2013-11-04T21:15:03Z or 20131104...), if it is one."""
    found = re.match(r"(\d{4})(-?)(\d{2})\2(\d{2})", (text or "").strip())
    try:
        day = date(int(found[1]), int(found[3]), int(found[4])).isoformat() if found else None
    except ValueError:
        day = None
    return {"created_iso": day, "created_text": f"{label} {day}"} if day else {}


def pdf_created(raw: bytes) -> dict[str, str]:
    """The creation day of a PDF that has a text layer; a scan's properties date the scan, not the document."""
    makers = b" ".join(m[1] for m in re.finditer(rb"/(?:Creator|Producer)\s*\(([^)]*)\)", raw)).lower()
    shown = False
    for m in re.finditer(rb"\bstream\r?\n(.*?)\r?\nendstream", raw, re.DOTALL):
        try:
            body = zlib.decompressobj().decompress(m[1])
        except zlib.error:
            body = m[1]
        shown = shown or re.search(rb"\bT[jJ]\b", body) is not None
    if b"scan" in makers or not shown:
        return {}
    for label, pattern in (("pdf CreationDate", rb"/CreationDate\s*\(D:([^)]*)\)"), ("pdf XMP CreateDate", rb"<xmp:CreateDate>([^<]*)</xmp:CreateDate>")):
        if (m := re.search(pattern, raw)) and (found := _created(label, m[1].decode("latin-1"))):
            return found
    return {}


def _pdf(raw: bytes) -> tuple:
    try:
        import pypdf
    except ImportError:
        return None, None, pdf_created(raw), "no PDF reader installed"
    try:
        pages = [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(raw)).pages]
    except Exception:  # a damaged file must not end the job
        return None, None, {}, "unreadable pdf"
    ps = [q for p in pages for q in paragraphs_of(p)]
    return (ps or None), first_sentence(ps) or None, pdf_created(raw), None if ps else "no text layer"


_BY_SUFFIX = {"text@1": _text, "eml@2": _mail, "docx@1": _docx, "pdf@1": _pdf}


def convert_one(converter: str | None, raw: bytes) -> tuple:
    f = _BY_SUFFIX.get(converter or "")
    return f(raw) if f else (None, None, {}, "no converter")


@F.pandas_udf(RESULT)
def convert(converter: pd.Series, content: pd.Series) -> pd.DataFrame:
    rows = [convert_one(c, bytes(b) if b is not None else b"") for c, b in zip(converter, content)]
    return pd.DataFrame(rows, columns=["paragraphs", "title", "metadata", "reason"])


def source_date(converter: Column, paragraphs: Column, metadata: Column, path: Column) -> Column:
    """The date of a source file: mail headers, else its first lines, else its path, else its properties."""
    mailed = F.when(metadata["date_iso"].isNotNull(), dates.date_of(metadata["date_iso"], metadata["date_confidence"], metadata["date_text"]))
    written = F.when(~converter.startswith("eml"), dates.first_line_date(F.array_join(paragraphs, "\n")))
    made = F.when(metadata["created_iso"].isNotNull(), dates.date_of(metadata["created_iso"], F.lit("inferred"), metadata["created_text"]))
    return dates.date_chain(F.lit("source"), mailed, written, dates.path_date(path), made)


def scan_files(spark, root: str, root_id: int = 1) -> DataFrame:
    """Files below a root as (root_id, rel_path, path_key, sha256, converter, content); dot files and cache/ are left out."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = re.sub(r"^file:/*", "/", root.rstrip("/"))
    rel = F.regexp_replace("path", r"^file:/*", "/")
    rel = F.substring(rel, F.lit(len(plain) + 2), F.length(rel))
    f = f.select(F.lit(root_id).alias("root_id"), rel.alias("rel_path"), F.sha2("content", 256).alias("sha256"), "content")
    f = f.where(~F.col("rel_path").rlike(r"(^|/)\.|(^|/)cache/"))
    return f.withColumn("path_key", F.concat(F.lpad(F.col("root_id").cast("string"), 3, "0"), F.lit("/"), "rel_path")).withColumn("converter", converter_of(F.col("rel_path")))


def convert_files(files: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """(path_key, sha256, converter, paragraphs, title, metadata, reason); what the cache holds is not converted again."""
    f = files.where(F.col("converter").isNotNull())
    once = f.select("sha256", "converter", "content").dropDuplicates(["sha256", "converter"])
    if cache is not None:
        once = once.join(cache.select("sha256", "converter"), ["sha256", "converter"], "left_anti")
    done = once.select("sha256", "converter", convert("converter", "content").alias("c")).select("sha256", "converter", "c.*")
    if cache is not None:
        done = done.unionByName(cache.select(done.columns))
    return f.select("path_key", "sha256", "converter").join(done, ["sha256", "converter"])
