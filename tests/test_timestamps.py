"""Timestamps against the standard library's zones, and the defined results of odd input."""

import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from corvane.operators.timestamps import local_to_utc, normalise_timestamps, source_instants


def seconds(*a, h=0.0):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() - h * 3600)


CASES = [
    ("2001-09-27T17:01:00.654Z", "Europe/Berlin", seconds(2001, 9, 27, 17, 1)),
    ("2000-08-18 15:20 GMT+3:30", None, seconds(2000, 8, 18, 15, 20, h=3.5)),
    ("2010-02-25 08:12 UTC+11", None, seconds(2010, 2, 25, 8, 12, h=11)),
    ("Thu, 8 Jul 2010 18:31:17 -0500 (EST)", None, seconds(2010, 7, 8, 18, 31, 17, h=-5)),
    ("0844Z 04 APR 00", None, seconds(2000, 4, 4, 8, 44)),
    ("17-Dec-69 09:01", "UTC", seconds(1969, 12, 17, 9, 1)),
    ("16 March 2008, 7.09 pm EDT", None, seconds(2008, 3, 16, 19, 9, h=-4)),
    ("12 December 2012, 12.05 am CET", None, seconds(2012, 12, 12, 0, 5, h=1)),
    ("24 août 2000 à 21h05", "Europe/Berlin", seconds(2000, 8, 24, 21, 5, h=2)),
    ("25. März 2003, 23.58 Uhr", "Asia/Kolkata", seconds(2003, 3, 25, 23, 58, h=5.5)),
    ("31 de octubre de 2005, 01:30", "UTC", seconds(2005, 10, 31, 1, 30)),
    ("Written: 7:23am on 14 June 1999", "America/Chicago", seconds(1999, 6, 14, 7, 23, h=-5)),
    ("1032084000644", None, 1032084000),
    ("906330556", None, 906330556),
    ("08/27/2000 06:45", "UTC", seconds(2000, 8, 27, 6, 45)),
    ("05/05/2000 06:45", "UTC", seconds(2000, 5, 5, 6, 45)),
    # no case
    ("08/07/2011 17:36", "UTC", None),
    ("2000-03-26 02:30", "Europe/Berlin", None),
    ("2000-10-29 02:30", "Europe/Berlin", None),
    ("2000-10-29 02:30", None, None),
    ("2000-10-29 02:30", "Nowhere/Town", None),
    ("2001-02-30 10:00", "UTC", None),
    ("2001-02-03 25:00", "UTC", None),
    ("3 May 2001 13:00 PM", "UTC", None),
    ("March 2001", "UTC", None),
    ("2002-12-23", "UTC", None),
    ("at high water", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
    ("x" * 100_000, "UTC", None),
]


def test_cases(spark):
    from corvane.operators.timestamps import known_zones

    df = spark.createDataFrame([(i, t, z, "clash") for i, (t, z, _) in enumerate(CASES)], "i int, t string, z string, utc_second string")
    got = {r["i"]: r["utc_second"] for r in normalise_timestamps(known_zones(df, "z"), "t", "z").collect()}
    assert {i: got[i] for i in range(len(CASES))} == {i: want for i, (_, _, want) in enumerate(CASES)}


@pytest.mark.parametrize("zone", ["Europe/Berlin", "America/New_York", "Australia/Sydney", "Asia/Kolkata"])
def test_every_half_hour_of_a_year(spark, zone):
    z = zoneinfo.ZoneInfo(zone)
    start = int(dt.datetime(2003, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    df = spark.range(0, 366 * 48).select((F.lit(start) + F.col("id") * 1800).alias("wall"), F.lit(zone).alias("z"))
    for wall, got in local_to_utc(df, "wall", "z", "u").select("wall", "u").collect():
        naive = dt.datetime.fromtimestamp(wall, dt.timezone.utc).replace(tzinfo=None)
        fits = set()
        for fold in (0, 1):
            u = naive.replace(tzinfo=z, fold=fold).astimezone(dt.timezone.utc)
            if u.astimezone(z).replace(tzinfo=None) == naive:
                fits.add(int(u.timestamp()))
        assert got == (fits.pop() if len(fits) == 1 else None)


def test_policies_and_bad_policy(spark):
    df = spark.createDataFrame([(seconds(2000, 10, 29, 2, 30), "Europe/Berlin")], "w bigint, z string")
    assert local_to_utc(df, "w", "z", "u", "earlier").first()["u"] == seconds(2000, 10, 29, 0, 30)
    assert local_to_utc(df, "w", "z", "u", "later").first()["u"] == seconds(2000, 10, 29, 1, 30)
    with pytest.raises(ValueError):
        local_to_utc(df, "w", "z", "u", "none")


def test_records_delivered_twice_and_empty_tables(spark):
    r = spark.createDataFrame([("S1", "source", ("2000-01-01 10:00",)), ("S1", "source", ("2000-01-01 10:00",)), ("S2", "note", ("2000-01-01 10:00Z",)), ("S3", "source", ("2000-01-01 10:00Z",)), ("S4", "source", None)], "ref string, kind string, record_date struct<text:string>")
    u = spark.createDataFrame([("S1", 1)], "id string, root_id int")
    z = spark.createDataFrame([(1, "UTC")], "root_id int, zone string")
    assert sorted(map(tuple, source_instants(r, u, z).collect())) == [("S1", seconds(2000, 1, 1, 10)), ("S3", seconds(2000, 1, 1, 10))]
    assert source_instants(r.limit(0), u.limit(0), z.limit(0)).count() == 0
