"""Timestamps of mixed format, precision and zone, brought to one UTC second.

Method: an ordered cascade of anchored patterns. Each pattern rewrites a text that it matches whole to
one canonical record "order|a|b|c|hour|minute|second|half|zone"; the first match wins. Fields are then
checked strictly (calendar, clock), the zone is taken from the text or else from a lookup of the
source's default zone, and local times are resolved by an explicit policy. Everything is column
expressions: no Python runs per row, and the only join is the zone lookup.

Defined results: null, empty, undated or unparsable text, text without a time of day, impossible
dates or times, ambiguous numeric day/month, unknown or null default zone (for texts without zone),
local times that were skipped or passed twice (policy "reject") all give null.
"""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.let import let

# Month names by number, in English, German, French, Spanish, Portuguese and Italian.
MONTHS = {
    1: "january jan januar jänner janvier enero janeiro gennaio",
    2: "february feb februar février fevrier febrero fevereiro febbraio",
    3: "march mar märz maerz mars marzo março marco mär",
    4: "april apr avril abril aprile",
    5: "may mai mayo maio maggio",
    6: "june jun juni juin junio junho giugno",
    7: "july jul juli juillet julio julho luglio",
    8: "august aug août aout agosto",
    9: "september sep sept septembre septiembre setembro settembre",
    10: "october oct oktober okt octobre octubre outubro ottobre",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez décembre decembre diciembre dezembro dicembre",
}
# Zone names that may stand in a text, in hours east of UTC.
ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "cst": -6, "cdt": -5, "est": -5, "edt": -4, "mst": -7, "mdt": -6,
    "pst": -8, "pdt": -7, "cet": 1, "cest": 2,
}

_MON = r"(\p{L}+)\.?"
_HMS = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)?"
_ZONE = r"((?:gmt|utc)?\s?[+-]\d{1,2}(?::?\d{2})?|[a-z]{1,4})"
_BRACKET = r"(?:\s*\([^()]*\))?"
_HALF = r"(?:([ap])\.?m\.?)"

#: (pattern, canonical record); a record is "order|x|y|z|hour|minute|second|half|zone". order tells what
#: x, y and z are: ymd, dmy, or num for a numeric date whose day and month must be told apart.
CASCADE = [
    # 2001-09-27T17:01:00.654Z, 2010-02-03 18:57:56.986889-0800, 2000-08-18 15:20 GMT+3:30, without zone too
    (rf"(\d{{4}})-(\d{{2}})-(\d{{2}})(?:t|\s+){_HMS}\s*{_ZONE}?{_BRACKET}", "ymd|$1|$2|$3|$4|$5|$6||$7"),
    # 2001/09/27 17:01
    (rf"(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?:t|,?\s+){_HMS}\s*{_ZONE}?{_BRACKET}", "ymd|$1|$2|$3|$4|$5|$6||$7"),
    # 20000811T022825Z, 20080120-041650
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})[t\s_-]?(\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,]\d+)?\s*{_ZONE}?{_BRACKET}", "ymd|$1|$2|$3|$4|$5|$6||$7"),
    # Sat, 27 Feb 2010 18:57:26 +0930 (CST), 12 October 1999, 6:12 pm CDT, 1 de mayo de 2007, 09:23, 17-Dec-03 09:01
    (rf"(\d{{1,2}})(?:st|nd|rd|th|er|º)?[\s.-]*(?:de\s+)?{_MON}[\s-]*(?:de\s+)?(\d{{4}}|\d{{2}}),?\s+{_HMS}\s*{_HALF}?\s*{_ZONE}?{_BRACKET}", "dmy|$1|$2|$3|$4|$5|$6|$7|$8"),
    # 25. August 2006, 19.00 Uhr; 16 March 2008, 7.09 pm EDT; 24 août 2000 à 21h05
    (rf"(\d{{1,2}})(?:st|nd|rd|th|er|º)?[\s.-]*(?:de\s+)?{_MON}\s*(?:de\s+)?(\d{{4}}),?\s+(?:à\s+|um\s+)?(\d{{1,2}})[.h](\d{{2}})\s*{_HALF}?(?:\s*uhr)?\s*{_ZONE}?{_BRACKET}", "dmy|$1|$2|$3|$4|$5||$6|$7"),
    # Thursday, August 24, 2000 7:44 PM; Dec 13, 2003 1:50 PM GMT
    (rf"{_MON}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}),?\s+(?:at\s+)?{_HMS}\s*{_HALF}?\s*{_ZONE}?{_BRACKET}", "dmy|$2|$1|$3|$4|$5|$6|$7|$8"),
    # Mon Feb 26 05:47:25 UTC 2001, Tue Jan 24 19:08:34 2006
    (rf"{_MON}\s+(\d{{1,2}})\s+{_HMS}\s+(?:{_ZONE}\s+)?(\d{{4}})", "dmy|$2|$1|$7|$3|$4|$5||$6"),
    # 0844Z 04 APR 00
    (rf"(\d{{2}})(\d{{2}})(z)\s+(\d{{1,2}})\s+{_MON}\s+(\d{{4}}|\d{{2}})", "dmy|$4|$5|$6|$1|$2|||$3"),
    # Written: 7:23am on 14 June 1999
    (rf"{_HMS}\s*{_HALF}?\s*(?!on\b){_ZONE}?,?\s+(?:on\s+)?(\d{{1,2}})(?:st|nd|rd|th)?\s+{_MON},?\s+(\d{{4}})", "dmy|$6|$7|$8|$1|$2|$3|$4|$5"),
    # 08/27/2000 06:45, 18-08-2003 14:51, 22.09.2000 03:59
    (rf"(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}}),?\s+{_HMS}\s*{_HALF}?\s*{_ZONE}?{_BRACKET}", "num|$1|$3|$4|$5|$6|$7|$8|$9"),
]


def _days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers (no session time zone takes part)."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(yy / 400)
    yoe = yy - era * 400
    doy = F.floor((F.lit(153) * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return (era * 146097 + doe - 719468).cast("long")


def _month_length(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def zone_offset(instant: Column, zone: Column) -> Column:
    """Seconds east of UTC in an IANA zone at an instant given in seconds since 1970 UTC."""
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(instant), zone)) - instant


def local_to_utc(df: DataFrame, local: str, zone: str, out: str, policy: str = "reject") -> DataFrame:
    """Add column `out`: the UTC second of a local wall-clock reading (seconds since 1970 as if it were UTC).

    The offsets in force a day before and a day after give at most two candidate instants; those that
    read back as the same wall clock are solutions. None: the clocks skipped it. Two: it passed twice.
    policy: "reject" (null for both), "earlier" or "later" (of two; for skipped times the instant by the
    offset before or after the change).
    """
    wall, z = F.col(local), F.col(zone)
    a, b, ok_a, ok_b = (f"__lu_{n}" for n in ("a", "b", "ok_a", "ok_b"))
    df = let(df, **{a: wall - zone_offset(wall - 86400, z), b: wall - zone_offset(wall + 86400, z)})
    before, after = F.col(a), F.col(b)
    df = let(df, **{ok_a: before + zone_offset(before, z) == wall, ok_b: after + zone_offset(after, z) == wall})
    first, second = F.col(ok_a), F.col(ok_b)
    if policy == "reject":
        value = F.when(first & (~second | (before == after)), before).when(second & ~first, after)
    elif policy == "earlier":
        value = F.when(first, before).when(second, after).otherwise(before)
    elif policy == "later":
        value = F.when(second, after).when(first, before).otherwise(after)
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return let(df, **{out: value}).drop(a, b, ok_a, ok_b)


def known_zones(df: DataFrame, zone: str) -> DataFrame:
    """Null out zone names that are not in the IANA list (for a small lookup table, before it is joined)."""
    return df.withColumn(zone, F.when(F.col(zone).isin(*sorted(zoneinfo.available_timezones())), F.col(zone)))


def normalise_timestamps(
    df: DataFrame, text: str, default_zone: str | None = None, out: str = "utc_second", policy: str = "reject"
) -> DataFrame:
    """Add column `out` (bigint): the UTC second that column `text` means, or null.

    default_zone names the column with the IANA zone for texts that state none. See the module for the
    cases that give null. Other columns pass through (one named like `out` is
    replaced); working columns carry a private prefix.
    """
    p = "__ts_"
    raw = F.trim(F.regexp_replace(F.lower(F.col(text)), r"[\s\u00a0\u2007\u202f]+", " "))
    raw = F.regexp_replace(raw, r"^(?:date|written|sent|dated)\s*:\s*", "")
    days = "mon|tue|tues|wed|thu|thur|thurs|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    raw = F.regexp_replace(raw, rf"^(?:{days})[.,]*\s+", "")
    raw = F.regexp_replace(raw, r"\s*uhr$", "")
    df = let(df, **{p + "t": raw})
    t = F.col(p + "t")
    hit = F.coalesce(*[F.when(t.rlike(f"^(?:{pat})$"), F.regexp_replace(t, f"^(?:{pat})$", rep)) for pat, rep in CASCADE])
    df = let(df, **{p + "f": F.when(~t.rlike(r"^\d{1,13}$"), F.split(hit, r"\|"))})
    part = [F.col(p + "f")[i] for i in range(9)]
    names = F.create_map(*[F.lit(x) for n, ws in MONTHS.items() for w in ws.split() for x in (w, n)])
    hours = F.create_map(*[F.lit(x) for n, h in ZONES.items() for x in (n, h * 3600)])
    order = part[0]
    a, b, c = (part[i].try_cast("int") for i in (1, 2, 3))
    month_first = (a <= 12) & (b > 12)
    one_reading = month_first | ((a > 12) & (b <= 12)) | (a == b)
    year = F.when(order == "ymd", a).otherwise(c)
    short = F.when(order == "ymd", F.length(part[1])).otherwise(F.length(part[3])) == 2
    month = F.when(order == "dmy", names[part[2]]).when(order == "ymd", b).when(one_reading, F.when(month_first, a).otherwise(b))
    day = F.when(order == "ymd", c).when(order == "dmy", a).when(one_reading, F.when(month_first, b).otherwise(a))
    df = let(
        df,
        **{
            p + "y": F.when(short, F.when(year <= 68, year + 2000).otherwise(year + 1900)).otherwise(year),
            p + "m": month,
            p + "d": day,
            p + "h": part[4].try_cast("int"),
            p + "n": part[5].try_cast("int"),
            p + "s": F.coalesce(part[6].try_cast("int"), F.lit(0)),
            p + "half": part[7],
            p + "zone": F.regexp_replace(part[8], r"\s", ""),
        },
    )
    y, m, d, h, n, s = (F.col(p + x) for x in "ymdhns")
    half, zone = F.col(p + "half"), F.col(p + "zone")
    noon = half != ""
    hour = F.when(noon, h % 12 + F.when(half == "p", 12).otherwise(0)).otherwise(h)
    clock = F.when(noon, h.between(1, 12)).otherwise(h.between(0, 23)) & n.between(0, 59) & s.between(0, 59)
    date = y.between(1000, 9999) & m.between(1, 12) & (d >= 1) & (d <= _month_length(y, m))
    local = F.when(date & clock, _days_from_civil(y, m, d) * 86400 + hour * 3600 + n * 60 + s)
    sign = F.when(F.regexp_extract(zone, r"([+-])", 1) == "-", -1).otherwise(1)
    oh = F.regexp_extract(zone, r"[+-](\d{1,2}?)(?::?(\d{2}))?$", 1).try_cast("int")
    om = F.coalesce(F.regexp_extract(zone, r"[+-](\d{1,2}?)(?::?(\d{2}))?$", 2).try_cast("int"), F.lit(0))
    numeric = zone.rlike(r"^(?:gmt|utc)?[+-]\d")
    offset = F.when(numeric & (oh <= 15) & (om <= 59), sign * (oh * 3600 + om * 60)).when(~numeric, hours[zone])
    df = let(df, **{p + "l": local, p + "o": offset})
    digits = F.when(t.rlike(r"^\d{9,13}$"), t.cast("long"))
    stamp = F.when(F.length(t) <= 10, digits).otherwise(F.floor(digits / 1000))
    local = F.col(p + "l")
    own = F.when(zone != "", local - F.col(p + "o"))
    if default_zone:
        df = let(df, **{p + "w": F.when(zone == "", local), p + "z": F.col(default_zone)})
        df = local_to_utc(df, p + "w", p + "z", p + "u", policy)
        own = F.coalesce(own, F.col(p + "u"))
    df = let(df, **{p + "out": F.coalesce(stamp, own).cast("bigint")})
    keep = [c for c in df.columns if not c.startswith(p)]
    return df.select(*[F.col(f"`{c}`") for c in keep if c != out], F.col(p + "out").alias(out))


def source_instants(records: DataFrame, units: DataFrame, roots: DataFrame) -> DataFrame:
    """(ref, utc_second): one row per source record whose date text fixes one instant.

    Rows delivered twice collapse. Records whose unit or root is missing keep only zoned texts.
    """
    r = records.where(F.col("kind") == "source").select("ref", F.col("record_date.text").alias("text"))
    r = r.where(F.col("text").rlike(r"\d"))
    zones = known_zones(roots.select(F.col("root_id").alias("rid"), "zone").dropDuplicates(["rid"]), "zone")
    u = units.select(F.col("id").alias("uid"), F.col("root_id").alias("rid")).dropDuplicates(["uid"])
    u = u.join(zones, "rid", "left").select("uid", "zone")
    r = r.distinct().join(u, r["ref"] == u["uid"], "left").select("ref", "text", "zone")
    return (
        normalise_timestamps(r, "text", "zone")
        .where(F.col("utc_second").isNotNull())
        .select("ref", "utc_second")
        .distinct()
    )

