"""Text functions as column expressions: tokens, estimates, paragraphs, titles, hashes, guards."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin lower-case letters and their base letters, by rule: those with a canonical decomposition.
_ACCENTED = "".join(chr(c) for c in range(0xC0, 0x250) if chr(c).islower() and unicodedata.decomposition(chr(c)) and unicodedata.decomposition(chr(c))[0] != "<")
_BASE = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold(c: str | Column) -> Column:
    """Lower case, Latin accents and combining marks removed."""
    return F.translate(F.regexp_replace(F.lower(col(c)), r"\p{Mn}", ""), _ACCENTED, _BASE)


def tokens(c: str | Column) -> Column:
    """Runs of letters and digits of the folded text; null text has none."""
    return F.coalesce(F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0)), F.array().cast("array<string>"))


def fold_word(word: str) -> str:
    """fold() for one word of a query, on the driver."""
    t = "".join(c for c in word.lower() if unicodedata.category(c) != "Mn")
    return t.translate(str.maketrans(_ACCENTED, _BASE))


def query_phrases(query: str) -> list[list[str]]:
    """A query's phrases as token lists: bare terms, quoted runs (an open quote runs to the end); all must match.

    A phrase without any token makes a query that matches nothing; a query of blanks and quotes only is
    empty and means browsing.
    """
    import re

    out, rest = [], query
    while rest := rest.lstrip():
        if rest[0] == '"':
            run, _, rest = rest[1:].partition('"')
        else:
            cut = next((k for k, c in enumerate(rest) if c.isspace() or c == '"'), len(rest))
            run, rest = rest[:cut], rest[cut:]
        if run.strip():
            out.append(re.findall(r"[^\W_]+", fold_word(run)))
    return out


def token_estimate(paragraphs: str | Column) -> Column:
    """UTF-8 bytes of the paragraphs joined by a blank line, over 4, rounded up; null has 0."""
    return F.coalesce(F.ceil(F.octet_length(F.array_join(col(paragraphs), "\n\n")) / 4), F.lit(0)).cast("bigint")


def split_paragraphs(c: str | Column) -> Column:
    """Blank lines part paragraphs, a heading line is one of its own; line ends inside are kept."""
    t = F.regexp_replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), r"(?mdU)^(#{1,6}[^\S\n]+\S[^\n]*)$", "\n\n$1\n\n")
    parts = F.transform(F.split(t, r"(?U)\n\s*\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda x: x != "")


def cap_at_word(c: Column, cap: int = 120) -> Column:
    """At most cap characters, cut at a blank where there is one."""
    cut = F.regexp_extract(c, rf"(?s)^(.{{1,{cap}}}) ", 1)
    return F.when(F.length(c) <= cap, c).when(cut != "", cut).otherwise(F.substring(c, 1, cap))


def first_sentence(paragraphs: str | Column, cap: int = 120) -> Column:
    """The first sentence of the first paragraph with text, its closing quotes included; empty where none has."""
    flat = F.filter(F.transform(col(paragraphs), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " "))), lambda p: p != "")
    text = F.coalesce(F.try_element_at(flat, F.lit(1)), F.lit(""))
    sentence = F.regexp_extract(text, r"""(?s)^(.*?[.!?]["')\]’”]*)(?:\s|$)""", 1)
    return F.rtrim(cap_at_word(F.when(sentence != "", sentence).otherwise(text), cap))


def heading_depth(c: str | Column) -> Column:
    """Number of # before a heading, 0 for other text."""
    return F.length(F.regexp_extract(col(c), r"^(#{1,6}) ", 1))


def content_hash(parts: Column) -> Column:
    """SHA-256 over the parts, a NUL after every one."""
    return F.sha2(F.concat(F.array_join(parts, "\0"), F.when(F.size(parts) > 0, F.lit("\0")).otherwise("")).cast("binary"), 256)


def looks_binary(text: str | Column, paragraphs: Column | None = None) -> Column:
    """Text that is no text: a NUL, over a tenth control characters, or a long paragraph almost without blanks."""
    t = col(text)
    paragraphs = split_paragraphs(t) if paragraphs is None else paragraphs
    control = F.length(F.regexp_replace(t, r"[^\x01-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))
    blanks = lambda p: F.length(p) - F.length(F.regexp_replace(p, r"(?U)\s", ""))
    dense = F.exists(paragraphs, lambda p: (F.length(p) >= 2000) & (blanks(p) / F.length(p) < 0.02))
    return F.coalesce(F.contains(t, F.lit("\0")) | (control / F.greatest(F.length(t), F.lit(1)) > 0.1) | dense, F.lit(False))


def word_count(c: str | Column) -> Column:
    t = F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
