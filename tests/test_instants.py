import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.instants import dictionary, normalise

NY, DE, SYD, UTC = "America/New_York", "Europe/Berlin", "Australia/Sydney", "UTC"
STAMPS = [
    ("2024-09-29T19:50:44Z", NY, "MDY", "2024-09-29T19:50:44Z"),
    ("2025-10-19T05:14:52+09:00", NY, "MDY", "2025-10-18T20:14:52Z"),
    ("2024-05-21 16:39:26.804639+0100", NY, "MDY", "2024-05-21T15:39:26Z"),
    ("20250422181230", UTC, "MDY", "2025-04-22T18:12:30Z"),
    ("1734961731", NY, "MDY", "2024-12-23T13:48:51Z"),
    ("1760208121805", NY, "MDY", "2025-10-11T18:42:01Z"),
    ("2025/01/03 20.32.50", DE, "DMY", "2025-01-03T19:32:50Z"),
    ("5/7/24 15:37", UTC, "DMY", "2024-07-05T15:37:00Z"),
    ("5/7/24 15:37", UTC, "MDY", "2024-05-07T15:37:00Z"),
    ("20-Dec-2025 12:05 PM", UTC, "MDY", "2025-12-20T12:05:00Z"),
    ("20-Dec-2025 12:05 AM", UTC, "MDY", "2025-12-20T00:05:00Z"),
    ("Fri, 07 Nov 2025 05:30:55 PST", DE, "DMY", "2025-11-07T13:30:55Z"),
    ("Tue, 11 Jun 2024 23:50:52 +05:30", DE, "DMY", "2024-06-11T18:20:52Z"),
    ("2024-04-18 12:32:07 UTC", NY, "MDY", "2024-04-18T12:32:07Z"),
    ("2024-11-03 01:30:00", NY, "MDY", "2024-11-03T05:30:00Z"),  # occurs twice: the first
    ("2024-03-10 02:30:00", NY, "MDY", "2024-03-10T07:30:00Z"),  # skipped: the offset before
    ("2024-04-07 02:30:00", SYD, "DMY", "2024-04-06T15:30:00Z"),
    ("45658", UTC, "MDY", "2025-01-01T00:00:00Z"),
    ("2025-02-30 10:15:00", UTC, "DMY", None),
    ("13/32/2025 09:00", UTC, "MDY", None),
    ("0000-00-00 00:00:00", UTC, "MDY", None),
    ("2025-01-01 24:00:00", UTC, "MDY", None),
    ("2025-01-01 13:00 PM", UTC, "MDY", None),
    ("2025-01-01 10:00:00 QQQ", UTC, "MDY", None),
    ("pending", UTC, "MDY", None),
    ("", UTC, "MDY", None),
    (None, UTC, "MDY", None),
    ("2025-01-01 10:00:00", None, None, None),  # no zone known
    ("9" * 5000, UTC, "MDY", None),
]
DATES = [("04/11/2024", "DMY", "2024-11-04"), ("04/11/2024", "MDY", "2024-04-11"), ("31/31/2025", "DMY", None), ("23-DEC-2025", "MDY", "2025-12-23"), ("Jan 3, 2025", "MDY", "2025-01-03"), ("20241221", "MDY", "2024-12-21"), ("10.14.2024", "MDY", "2024-10-14"), ("45756", "MDY", "2025-04-09"), ("2025/3/31", "DMY", "2025-03-31"), ("2025-08-16T01:29:00+11:00", "DMY", "2025-08-16"), ("  2025-07-12 ", "DMY", "2025-07-12"), ("27/8/25", "DMY", "2025-08-27"), ("2024-02-30", "DMY", None), ("TBD", "DMY", None)]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_readings(spark, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        data = [("stamp", *s[:3], s[3]) for s in STAMPS] + [("date", d[0], NY, d[1], d[2]) for d in DATES]
        values = spark.createDataFrame(data * 2, "kind string, raw string, zone string, date_order string, want string").withColumn("_g", F.lit("clash"))
        rows = normalise(values).collect()
        assert len(rows) == 2 * len(data)
        assert [(r.raw, r.norm) for r in rows if r.norm != r.want] == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_kept_dictionary_grows(spark, tmp_path):
    schema = "kind string, raw string, zone string, date_order string"
    kept = f"file://{tmp_path}/kept"
    dictionary(spark.createDataFrame([("date", "1/2/24", None, "MDY")] * 3, schema), kept)
    again = dictionary(spark.createDataFrame([("date", "1/2/24", None, "MDY"), ("date", "1/2/24", None, "DMY"), ("date", None, None, "DMY")], schema), kept)
    assert sorted((r.date_order, r.norm) for r in again.collect()) == [("DMY", "2024-02-01"), ("MDY", "2024-01-02")]


def test_empty(spark):
    assert normalise(spark.createDataFrame([], "kind string, raw string, zone string, date_order string")).collect() == []
