"""References to records, paragraphs and places in files: parse, render, find in prose."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A source reference in prose: the record, and maybe p7, p7-12 or p7-.
IN_PROSE = r"\bSRC-\d{6,}(?: p\d+(?:-\d*)?)?"
_SOURCE = re.compile(r"(SRC-\d{6,})(?: p(\d+)(-(\d*))?)?")


@dataclass(frozen=True)
class Reference:
    """shape: record, anchor, range, tail, path or section."""

    shape: str
    id: str | None = None
    anchor: int | None = None
    end: int | None = None
    path: str | None = None
    heading: str | None = None
    occurrence: int = 1

    def render(self) -> str:
        if self.path is not None:
            if self.heading is None:
                return self.path
            return f"{self.path} # {self.heading}" + (f" ({self.occurrence})" if self.occurrence > 1 else "")
        tail = {"record": "", "anchor": f" p{self.anchor}", "range": f" p{self.anchor}-{self.end}", "tail": f" p{self.anchor}-"}
        return f"{self.id}{tail[self.shape]}"


def parse(text: str) -> Reference:
    """The reference that a text is; ValueError for anything else, absolute and climbing paths included."""
    text = text.strip()
    if m := _SOURCE.fullmatch(text):
        unit, p, dash, end = m.groups()
        if p is None:
            return Reference("record", unit)
        if dash is None:
            return Reference("anchor", unit, int(p))
        return Reference("range", unit, int(p), int(end)) if end else Reference("tail", unit, int(p))
    path, mark, heading = text.partition(" # ")
    bad = not path or path.startswith(("/", "~")) or "\\" in path or re.match(r"[A-Za-z]:", path) or ".." in path.split("/")
    if bad or not path.endswith(".md"):
        raise ValueError(f"not a reference: {text!r}")
    if not mark:
        return Reference("path", path=path)
    m = re.fullmatch(r"(.+?)(?: \((\d+)\))?", heading.strip())
    if not m:
        raise ValueError(f"not a reference: {text!r}")
    return Reference("section", path=path, heading=m[1], occurrence=int(m[2] or 1))


def find_refs(c: Column) -> Column:
    """All source references of a text, in order."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(IN_PROSE), F.lit(0)), F.array().cast("array<string>"))
