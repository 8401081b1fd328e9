"""Dates as column expressions: periods of records, range specs, date shapes in prose and paths."""

from __future__ import annotations

import re
from calendar import monthrange

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.let import bind

# English month names and their short forms.
MONTH_NAMES = ["january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug", "september sept sep", "october oct", "november nov", "december dec"]
UNKNOWN_PERIOD = (0, 99_999_999)
_NAMES = sorted((n for names in MONTH_NAMES for n in names.split()), key=len, reverse=True)
_MONTH = "(" + "|".join(_NAMES) + ")"


def spec_bounds(spec: str) -> tuple[str, str]:
    """First and last day of YYYY, YYYY-MM or YYYY-MM-DD; other texts raise ValueError."""
    if re.fullmatch(r"\d{4}", spec):
        return f"{spec}-01-01", f"{spec}-12-31"
    if m := re.fullmatch(r"(\d{4})-(0[1-9]|1[0-2])", spec):
        return f"{spec}-01", f"{spec}-{monthrange(int(m[1]), int(m[2]))[1]:02d}"
    if re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", spec):
        return spec, spec
    raise ValueError(f"not a year, month or day: {spec!r}")


def unknown(date: str = "record_date") -> Column:
    return F.coalesce(F.col(f"{date}.confidence") == "unknown", F.lit(True)) | (F.coalesce(F.col(f"{date}.iso"), F.lit("")) == "")


def period_start(date: str = "record_date") -> Column:
    iso, g = F.col(f"{date}.iso"), F.col(f"{date}.granularity")
    value = F.when(g == "day", iso).when(g == "month", F.concat(F.substring(iso, 1, 7), F.lit("-01"))).otherwise(F.concat(F.substring(iso, 1, 4), F.lit("-01-01")))
    return F.when(~unknown(date), value)


def period_end(date: str = "record_date") -> Column:
    iso, g = F.col(f"{date}.iso"), F.col(f"{date}.granularity")
    month = F.date_format(F.last_day(F.concat(F.substring(iso, 1, 7), F.lit("-01")).try_cast("date")), "yyyy-MM-dd")
    value = F.when(g == "day", iso).when(g == "month", month).otherwise(F.concat(F.substring(iso, 1, 4), F.lit("-12-31")))
    return F.when(~unknown(date), value)


def as_int(day: Column, otherwise: int) -> Column:
    """YYYYMMDD of an ISO day; null days are an open end."""
    return F.coalesce(F.regexp_replace(day, "-", "").try_cast("int"), F.lit(otherwise))


def in_range(start: Column, end: Column, from_: str | None, to: str | None) -> Column:
    """Whether a period (null: unknown, always passes) overlaps a range of specs."""
    low = spec_bounds(from_)[0] if from_ else "0000-01-01"
    high = spec_bounds(to)[1] if to else "9999-12-31"
    return F.coalesce((start <= high) & (end >= low), F.lit(True))


def _month_number(name: Column) -> Column:
    pairs = [F.lit(x) for k, names in enumerate(MONTH_NAMES, 1) for n in names.split() for x in (n, k)]
    return F.create_map(*pairs)[F.lower(name)]


def _iso(y: Column, m: Column, d: Column) -> Column:
    """ISO day of a valid date from 1900 to 2100, else null."""
    text = F.format_string("%04d-%02d-%02d", y, m, d)
    return F.when(y.between(1900, 2100) & text.try_cast("date").isNotNull(), text)


def _year(text: Column) -> Column:
    n = text.try_cast("int")
    return F.when(F.length(text) == 4, n).when(n <= 68, n + 2000).otherwise(n + 1900)


def _part(c: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


def date_shape(c: Column) -> Column:
    """The date in a text as struct(shape, iso, at_start, whole, digits), null where there is none.

    In this order: ISO; day month year or month day year; numeric a/b/year ("ambiguous" where both could be
    the month, then 1 January stands for the year); month and year.
    """
    return bind(c, _shape)


def _shape(c: Column) -> Column:
    iso_p = r"(?<!\d)(\d{4})-(\d{2})-(\d{2})(?!\d)"
    dmy_p = rf"(?i)(?<!\d)(\d{{1,2}})(?:st|nd|rd|th)?[\s,]+{_MONTH}\.?,?\s+(\d{{4}}|\d{{2}})(?!\d)"
    mdy_p = rf"(?i)(?<!\d){_MONTH}\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}|\d{{2}})(?!\d)"
    num_p = r"(?<!\d)(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?!\d)"
    my_p = rf"(?i)(?<!\d){_MONTH}\.?[\s,]+(\d{{4}})(?!\d)"

    def shape(name: str, iso: Column, pattern: str, digits: Column) -> Column:
        core = F.regexp_replace(c, r"[ \t.,;:]+$", "")
        whole = F.regexp_replace(F.regexp_extract(c, pattern, 0), r"[ \t.,;:]+$", "") == core
        there = lambda i: F.when(i.isNotNull(), F.struct(F.lit(name).alias("shape"), i.alias("iso"), whole.alias("whole"), digits.alias("digits")))
        return F.when(c.rlike(pattern), bind(iso, there))

    four = F.lit(4)
    iso = _iso(_part(c, iso_p, 1).cast("int"), _part(c, iso_p, 2).cast("int"), _part(c, iso_p, 3).cast("int"))
    dmy = _iso(_year(_part(c, dmy_p, 3)), _month_number(_part(c, dmy_p, 2)), _part(c, dmy_p, 1).cast("int"))
    # only where no "day month year" stands, whatever its value, is "month day year" looked for
    mdy = F.when(~c.rlike(dmy_p), _iso(_year(_part(c, mdy_p, 3)), _month_number(_part(c, mdy_p, 1)), _part(c, mdy_p, 2).cast("int")))
    a, b, y = (_part(c, num_p, k).cast("int") for k in (1, 2, 3))
    both = (a <= 12) & (b <= 12)
    numeric = F.when(~both, F.when(a > 12, _iso(y, b, a)).otherwise(_iso(y, a, b)))
    vague = F.when(both, F.format_string("%04d-01-01", y))
    month_year = F.when(c.rlike(my_p), F.format_string("%04d-%02d-01", _part(c, my_p, 2).cast("int"), _month_number(_part(c, my_p, 1))))
    return F.coalesce(
        shape("iso", iso, iso_p, four),
        shape("month_name", dmy, dmy_p, F.length(_part(c, dmy_p, 3))),
        shape("month_name", mdy, mdy_p, F.length(_part(c, mdy_p, 3))),
        shape("ambiguous", vague, num_p, four),
        shape("numeric", numeric, num_p, four),
        shape("month_year", month_year, my_p, four),
    )


def _date(iso: Column, confidence: Column, granularity: Column, text: Column) -> Column:
    return F.struct(iso.alias("iso"), confidence.alias("confidence"), granularity.alias("granularity"), text.alias("text"))


def date_of(iso: Column, confidence: Column, text: Column) -> Column:
    """A day from outside as a date."""
    return _date(iso, confidence, F.lit("day"), text)


def _from_shape(shape: Column, exact, text) -> Column:
    return bind(shape, lambda s: _dated(s, exact(s), text(s)))


def _dated(s: Column, exact: Column, text: Column) -> Column:
    year = F.concat(F.substring(s["iso"], 1, 4), F.lit(" (numeric date, day/month ambiguous)"))
    inferred = F.lit("inferred")
    return (
        F.when(s["shape"] == "ambiguous", _date(s["iso"], inferred, F.lit("year"), year))
        .when(s["shape"] == "month_year", _date(s["iso"], inferred, F.lit("month"), text))
        .when(s.isNotNull(), _date(s["iso"], F.when(exact, "exact").otherwise("inferred"), F.lit("day"), text))
    )


def first_line_date(body: Column) -> Column:
    """The date of a body's first line, or of "Date:" and "Written:" lines among the next four."""
    week = r"(?i)^(?:mon(?:day)?|tue(?:sday)?|wed(?:nesday)?|thu(?:rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\.?,?\s+"

    def hit(line: Column) -> Column:
        return bind(F.regexp_replace(F.trim(line), r"^#+\s*", ""), lambda text: bind(F.regexp_replace(text, week, ""), lambda bare: read(text, bare)))

    def read(text: Column, bare: Column) -> Column:
        s = F.when(F.length(bare) <= 45, date_shape(bare))
        return F.when(bare.rlike(r"\d{2}"), _from_shape(s, lambda s: s["whole"] & (s["digits"] == 4), lambda s: text))

    def search(lines: Column) -> Column:
        labels = F.filter(F.transform(F.slice(lines, 2, 4), lambda x: F.regexp_extract(F.trim(x), r"(?i)^(?:date|written)\s*:\s*(.+)$", 1)), lambda x: x != "")
        found = F.filter(F.transform(F.concat(F.slice(lines, 1, 1), labels), hit), lambda x: x.isNotNull())
        return F.when(F.size(lines) > 0, F.try_element_at(found, F.lit(1)))

    return bind(F.filter(F.split(body, r"\R"), lambda x: F.trim(x) != ""), search)


def path_date(path: Column) -> Column:
    """The date of a file name, else of the nearest folders (a month folder takes the year above it)."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    label = lambda s: F.concat(F.when(s["shape"] == "month_year", F.substring(s["iso"], 1, 7)).otherwise(s["iso"]), F.lit(" (filename)"))
    by_name = _from_shape(date_shape(stem), lambda s: s["shape"] == "iso", label)
    folders = F.reverse(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))))
    start = F.struct(F.lit(None).cast("int").alias("month"), F.lit(None).cast("string").alias("year"))
    year_of = lambda x: F.when(x.rlike(r"^\d{4}$") & x.try_cast("int").between(1900, 2100), x)

    def step(acc: Column, x: Column) -> Column:
        month = F.when(acc["month"].isNull() & acc["year"].isNull(), _month_number(F.trim(x)))
        return F.struct(
            F.coalesce(acc["month"], month).alias("month"),
            F.when(acc["year"].isNotNull(), acc["year"]).otherwise(F.when(month.isNull(), year_of(x))).alias("year"),
        )

    def dated(f: Column) -> Column:
        month = F.format_string("%s-%02d", f["year"], f["month"])
        year = F.when(f["year"].isNotNull(), _date(F.concat(f["year"], F.lit("-01-01")), F.lit("inferred"), F.lit("year"), F.concat(f["year"], F.lit(" (folder)"))))
        return F.when(f["year"].isNotNull() & f["month"].isNotNull(), _date(F.concat(month, F.lit("-01")), F.lit("inferred"), F.lit("month"), F.concat(month, F.lit(" (folder)")))).otherwise(year)

    return F.coalesce(by_name, bind(F.aggregate(folders, start, step), dated))


def date_chain(kind: Column, *found: Column) -> Column:
    """The first date that a strategy found; notes are never dated; unknown where none did."""
    none = _date(F.lit(""), F.lit("unknown"), F.lit("day"), F.lit(""))
    return F.when(kind == "note", none).otherwise(F.coalesce(*found, none))


def display_date(date: str = "record_date") -> Column:
    """Exact days as they are, inferred periods at their granularity with their wording, else "undated"."""
    iso, g, text = F.col(f"{date}.iso"), F.col(f"{date}.granularity"), F.coalesce(F.col(f"{date}.text"), F.lit(""))
    period = F.when(g == "day", iso).when(g == "month", F.substring(iso, 1, 7)).otherwise(F.substring(iso, 1, 4))
    return (
        F.when(unknown(date), "undated").when(F.col(f"{date}.confidence") == "exact", iso).when(text != "", F.concat(period, F.lit(" ("), text, F.lit(")"))).otherwise(period)
    )


