"""Stamps and dates in mixed layouts and time zones, brought to one UTC instant or one ISO day.

The distinct raw texts, with what their reading depends on (the zone and the day-month order of the source), form a
dictionary. It is parsed once, written to the shared folder and joined back to the rows. A kept dictionary is extended
by the texts it doesn't hold yet. All parsing is done by built-in expressions; the session's time zone plays no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import stored, strip

#: Abbreviations of zones and their offsets.
ZONES = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00", "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00",
    "IST": "+05:30", "SGT": "+08:00", "HKT": "+08:00", "AWST": "+08:00", "JST": "+09:00", "KST": "+09:00", "ACST": "+09:30", "ACDT": "+10:30", "AEST": "+10:00", "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00",
    "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00",
}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\.?"
DATE = rf"(?:(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})|(\d{{1,2}})([-/.])(\d{{1,2}})\6(\d{{4}}|\d{{2}})|(\d{{1,2}})[- ]({MONTH})[- ,]\s*(\d{{4}}|\d{{2}})|({MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}}|\d{{2}})|(\d{{4}})(\d{{2}})(\d{{2}})(?=$|\d{{6}}|t))"
TIME = r"(?:(?:\s*t\s*|[\s,]+|(?<=\d{8}))(\d{1,2})[:.]?(\d{2})(?:[:.]?(\d{2})(?:[.,]\d+)?)?\s*([ap]\.?m\.?)?\s*(z|[-+]\d{2}(?::?\d{2})?|(?:utc|gmt)[-+]\d{1,2}(?::?\d{2})?|[a-z]{2,5})?)?"
STAMP = rf"^(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?{DATE}{TIME}$"


GROUPS = 22


def _split(s: Column) -> Column:
    """The groups of STAMP, matched once; null where ``s`` doesn't match."""
    groups = F.regexp_replace(s, STAMP, "\u0001" + "\u0001".join(f"${i}" for i in range(1, GROUPS + 1)))
    return F.when(groups.startswith("\u0001"), F.split(groups, "\u0001"))


def _read(texts: DataFrame) -> DataFrame:
    """``texts`` with norm. Each step is a projection of its own: what several steps use is worked out once, in small code."""
    first = lambda *gs: F.coalesce(*[F.when(g != "", g) for g in (F.get("_g", F.lit(i)) for i in gs)])
    dmy = F.upper(F.coalesce("date_order", F.lit("MDY"))) == "DMY"
    df = texts.withColumn("_s", F.lower(strip(F.col("raw")))).withColumn("_g", _split(F.col("_s")))
    df = df.withColumns({
        "_year": first(1, 8, 11, 14, 15),
        "_month": F.coalesce(F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(first(10, 12), 1, 3)).cast("string"), first(3, 16), F.when(dmy, first(7)).otherwise(first(5))),
        "_day": F.coalesce(first(4, 9, 13, 17), F.when(dmy, first(5)).otherwise(first(7))),
        "_hour": first(18).try_cast("int"),
        "_half": F.substring(first(21), 1, 1),
        "_rest": F.coalesce(first(19).try_cast("int"), F.lit(0)) * 60 + F.coalesce(first(20).try_cast("int"), F.lit(0)),
        "_fits": (F.coalesce(first(19).try_cast("int"), F.lit(0)) < 60) & (F.coalesce(first(20).try_cast("int"), F.lit(0)) < 60),
        "_zone": F.coalesce(F.regexp_replace(first(22), r"^(?:utc|gmt)(?=[-+])", ""), F.lit("")),
        "_digits": F.length(F.regexp_extract("_s", r"^(\d+)(?:\.\d+)?$", 1)),
        "_value": F.col("_s").try_cast("decimal(30,9)"),
    })
    df = df.withColumns({
        "_date": F.concat_ws("-", F.when(F.length("_year") == 2, F.concat(F.lit("20"), F.col("_year"))).otherwise(F.coalesce("_year", F.lit("x"))), F.lpad("_month", 2, "0"), F.lpad("_day", 2, "0")).try_cast("date"),
        "_hour": F.when(F.col("_hour").isNull(), 0).when(F.col("_half").isNull(), F.when(F.col("_hour") < 24, F.col("_hour"))).when(F.col("_hour").between(1, 12), F.col("_hour") % 12 + F.when(F.col("_half") == "p", 12).otherwise(0)),
        "_offset": F.when(F.col("_zone").rlike(r"^[-+]"), F.col("_zone")).otherwise(F.element_at(F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k.lower(), v)]), F.col("_zone"))),
        # A bare number is an epoch count by its length, or a spreadsheet day number, which is local.
        "_epoch": F.floor(F.when(F.col("_digits").between(9, 10), F.col("_value")).when(F.col("_digits").between(12, 13), F.col("_value") / 1000).when(F.col("_digits").between(15, 16), F.col("_value") / 1_000_000).when(F.col("_digits").between(18, 19), F.col("_value") / 1_000_000_000)).cast("long"),
        "_serial": F.when(F.col("_digits") == 5, F.round((F.col("_value") - 25569) * 86400)).cast("long"),
    })
    df = df.withColumns({
        "_local": F.coalesce(F.when(F.col("_fits"), F.unix_date("_date").cast("long") * 86400 + F.col("_hour") * 3600 + F.col("_rest")), "_serial"),
        "_shift": F.when(F.col("_offset").startswith("-"), -1).otherwise(1) * (F.regexp_extract("_offset", r"^[-+](\d{1,2})", 1).try_cast("int") * 3600 + F.coalesce(F.regexp_extract("_offset", r"^[-+]\d{1,2}:?(\d{2})$", 1).try_cast("int"), F.lit(0)) * 60),
    })
    # A time that occurs twice is the first, a skipped one has the offset before the change: the rules of to_utc_timestamp.
    by_zone = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds("_local"), F.col("zone")))
    df = df.withColumn("_utc", F.when(F.col("_zone") != "", F.col("_local") - F.col("_shift")).when(F.col("_local").isNotNull(), by_zone).otherwise(F.col("_epoch")))
    day = F.when((F.col("_zone") == "") | F.col("_offset").isNotNull(), F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.coalesce("_local", "_epoch") / 86400).cast("int")).cast("string"))
    return df.withColumn("norm", F.when(F.col("kind") == "stamp", _iso(F.col("_utc"))).otherwise(day))


def _iso(sec: Column) -> Column:
    days, rest = F.floor(sec / 86400).cast("int"), F.pmod(sec, F.lit(86400))
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.date_add(F.lit("1970-01-01").cast("date"), days).cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(F.pmod(rest, F.lit(3600)) / 60)), F.lit(":"), two(F.pmod(rest, F.lit(60))), F.lit("Z"))


TARGET = {"stamp": r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$", "date": r"^\d{4}-\d{2}-\d{2}$"}


def dictionary(values: DataFrame, kept: str | None = None) -> DataFrame:
    """(kind, raw, zone, date_order, norm) of each distinct text of ``values`` (kind ``stamp`` or ``date``, raw, zone, date_order).

    With ``kept``, a folder, only texts that it doesn't hold yet are parsed, and they are appended to it. Two writers may add
    the same text; it is read once.
    """
    spark = values.sparkSession
    keys = ["kind", "raw", "zone", "date_order"]
    distinct = values.where("raw is not null").select(*keys).distinct()
    if kept:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(kept)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            old = spark.read.parquet(kept)
            o = old.select(*[F.col(k).alias(f"old_{k}") for k in keys])
            distinct = distinct.join(o, [distinct[k].eqNullSafe(o[f"old_{k}"]) for k in keys], "left_anti")
    parsed = _read(distinct).select(*keys, "norm")
    if not kept:
        return stored(parsed, "stamps")
    parsed.write.mode("append").parquet(kept)
    return spark.read.parquet(kept).dropDuplicates(keys)


def normalise(values: DataFrame, kept: str | None = None) -> DataFrame:
    """``values`` (kind, raw, zone, date_order and any other columns) with ``norm``, null where ``raw`` can't be read.

    Null, empty, unreadable and impossible texts have a null norm; rows are neither dropped nor multiplied. A date is read
    without its source's zone, so that equal texts of one order are parsed once. A hot text is split by the engine's skew
    join, as the dictionary has each text once.
    """
    v = values.withColumn("zone", F.when(F.col("kind") == "stamp", F.col("zone")))
    known = dictionary(v, kept).select(*[F.col(k).alias(f"_d_{k}") for k in ("kind", "raw", "zone", "date_order")], F.col("norm"))
    on = (v["kind"] == known["_d_kind"]) & (v["raw"] == known["_d_raw"]) & (F.coalesce(v["zone"], F.lit("")) == F.coalesce(known["_d_zone"], F.lit(""))) & (F.coalesce(v["date_order"], F.lit("")) == F.coalesce(known["_d_date_order"], F.lit("")))
    return v.join(known, on, "left").drop("_d_kind", "_d_raw", "_d_zone", "_d_date_order")


def read_times(rows: DataFrame, column: str, systems: DataFrame, kind: str = "date", name: str = "day") -> DataFrame:
    """``rows`` (source, ...) with ``name``: the day, or the UTC instant of a ``stamp``, of the texts in ``column``; null where unreadable.

    ``systems`` (source, tz_name, date_order) has a row a source and is broadcast.
    """
    order = systems.groupBy(F.col("source").alias("_source")).agg(F.first("tz_name").alias("zone"), F.first("date_order").alias("date_order"))
    joined = rows.join(F.broadcast(order), F.col("source") == F.col("_source"), "left").drop("_source")
    done = normalise(joined.withColumns({"kind": F.lit(kind), "raw": F.col(column)}))
    value = F.col("norm").try_cast("date") if kind == "date" else F.regexp_replace("norm", "Z", "").try_cast("timestamp_ntz")
    return done.withColumn(name, value).drop("zone", "date_order", "kind", "raw", "norm")
