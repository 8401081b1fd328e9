"""One form for texts that look the same (problem 10).

Method: compatibility composition (NFKC), removal of default-ignorable characters, blanks mapped to a
plain space, look-alike letters of other scripts mapped to the letter they resemble, optional full case
folding. The mapping is applied once per distinct value of a batch, in an Arrow UDF; all else is
JVM-side. The order matters: characters are dropped before composition, so that an invisible character
between a letter and its accent does not keep them apart.

Defined results: null stays null; the empty text stays empty; a text of invisible characters becomes
empty; case, accents, digits and line breaks are kept (fold=False).
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.session import cut_lineage, spread

# Letters of other scripts, each followed by the Latin letter that it resembles.
RESEMBLE = (
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ѵv ӏl ԍG ґr кk "
    "АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ІI ЈJ ЅS ԚQ ԜW ѴV ҮY ӀI ԌG "
    "αa οo νv ρp ιi υu κk χx γy τt ωw ϲc ϳj ɑa ɡg ıi ʟL ɩi ᴏo "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ϴO ͿJ "
    "օo սu հh ցg ոn զq ԼL ՍU ՕO ѐè ёë ЁË їï ЇÏ ϊï "
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎥI ᎫJ ᏦK ᏞL ᎷM ᏢP ᎡR ᏚS ᎢT ᏙV ᎳW ᏃZ"
)
# Code points of characters that show nothing (the default-ignorable ones).
INVISIBLE = (
    "00AD 034F 061C 115F-1160 17B4-17B5 180B-180F 200B-200F 202A-202E 2060-206F 3164 FE00-FE0F FEFF FFA0 "
    "FFF0-FFF8 1BCA0-1BCA3 1D173-1D17A E0000-E0FFF"
)
# Code points of blanks; line breaks are no blanks.
BLANKS = "0009 00A0 1680 2000-200A 202F 205F 2800 3000"


def _points(ranges: str) -> list[int]:
    out = []
    for r in ranges.split():
        a, _, b = r.partition("-")
        out += range(int(a, 16), int(b or a, 16) + 1)
    return out


_TABLE = {ord(p[0]): p[1] for p in RESEMBLE.split()}
_FIRST = dict.fromkeys(_points(INVISIBLE)) | dict.fromkeys(_points(BLANKS), " ")


@cache
def _changing() -> re.Pattern:
    """Characters that may not stay as they are: those with another form, and marks that join to others."""

    def may(c: str) -> bool:
        return unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or _full(c) != c

    points = [k for k in (*range(0xD800), *range(0xE000, 0x10000)) if may(chr(k))]
    ranges, start = [], points[0]
    for a, b in zip(points, [*points[1:], -1]):
        if b != a + 1:
            ranges.append(f"{re.escape(chr(start))}-{re.escape(chr(a))}")
            start = b
    # any character beyond the basic plane counts: a class within it is one table look-up
    return re.compile("[" + "".join(ranges) + "]|[^\\x00-\\uffff]")


def canonical(text: str, fold: bool = False) -> str:
    """The one form of a text; see the module."""
    if text.isascii():
        text = text.replace("\t", " ")
        return text.casefold() if fold else text
    if _changing().search(text):
        text = _full(text)
    return unicodedata.normalize("NFKC", text.casefold()) if fold else text


def _full(text: str) -> str:
    text = unicodedata.normalize("NFKC", text.translate(_FIRST))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_TABLE))


def _udf(fold: bool):
    @F.pandas_udf(StringType())
    def to_form(texts: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        out = []
        for t in texts:
            if t is not None and t not in known:
                known[t] = canonical(t, fold)
            out.append(None if t is None else known[t])
        return pd.Series(out, dtype=object)

    return to_form


def canonical_text(text: str | Column, fold: bool = False) -> Column:
    """Column form of canonical(); plain ASCII texts never leave the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    plain = F.translate(c, "\t", " ")
    plain = F.lower(plain) if fold else plain
    return F.when(c.rlike(r"^\p{ASCII}*$"), plain).otherwise(_udf(fold)(F.when(~c.rlike(r"^\p{ASCII}*$"), c)))


def same_looking_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_lo, doc_hi): documents with one canonical form but different characters.

    Documents travel as two 128-bit fingerprints (form, text), never as texts. Pairs are formed between
    the distinct texts of one form first, then members are attached, so that equal copies are neither
    compared nor paired with each other.
    """
    print_of = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 32)
    d = spread(documents.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("id"), F.col(text).alias("t")))
    d = d.select("id", print_of(canonical_text("t")).alias("form"), print_of(F.col("t")).alias("print"))
    d = cut_lineage(d.distinct())  # ids and fingerprints only; the forms are made once
    forms = d.select("form", "print").distinct()
    several = forms.groupBy("form").agg(F.count("*").alias("n")).where("n > 1").select("form")
    d = d.join(several, "form", "left_semi")
    a = d.select("form", F.col("id").alias("ia"), F.col("print").alias("pa"))
    b = d.select("form", F.col("id").alias("ib"), F.col("print").alias("pb"))
    pairs = a.join(b, "form").where((F.col("pa") < F.col("pb")) & (F.col("ia") != F.col("ib")))
    return pairs.select(F.least("ia", "ib").alias("doc_lo"), F.greatest("ia", "ib").alias("doc_hi")).distinct()


def canonical_documents(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: bool = True) -> DataFrame:
    """(doc_id, form_id, canonical): every document in its one form, for comparisons of any kind."""
    c = documents.select(F.col(doc_id).alias("doc_id"), canonical_text(F.col(text), fold).alias("canonical"))
    return c.select("doc_id", F.substring(F.sha2(F.col("canonical").cast("binary"), 256), 1, 32).alias("form_id"), "canonical")
