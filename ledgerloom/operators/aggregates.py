"""Aggregations of ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def entry_headers(lines: DataFrame) -> DataFrame:
    """One row per journal entry from its lines: totals, first non-blank attributes by line number, sorted account names."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.trim(c) != ""), F.struct("line_no", "line_id")))
    debit, credit = F.coalesce("debit", F.lit(0)), F.coalesce("credit", F.lit(0))
    out = lines.groupBy("entry_id").agg(
        F.count("*").alias("lines"), F.sum(debit).cast("decimal(38,2)").alias("debit"), F.sum(credit).cast("decimal(38,2)").alias("credit"), first("description").alias("description"), first("posted_by").alias("posted_by"), first("approved_by").alias("approved_by"),
        F.array_join(F.sort_array(F.collect_set("account_name")), " | ").alias("account_names"),
    )
    return out.withColumn("amount", F.greatest("debit", "credit"))


def leading_digits(rows: DataFrame, amount: str, least: int = 10) -> DataFrame:
    """(digit, n, share, expected): first significant digits of amounts of at least ``least`` against the logarithmic law."""
    a = F.abs(amount)
    seen = rows.where(a >= least).select(F.regexp_extract(a.cast("string"), "[1-9]", 0).cast("int").alias("digit")).groupBy("digit").agg(F.count("*").alias("n"))
    return seen.select("digit", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6).alias("share"), F.round(F.log10(1 + 1 / F.col("digit")), 6).alias("expected"))


def most_frequent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, n, total, confidence): the commonest value of each key, the lesser one of equals; null values don't count."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    best = n.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), value)).alias("_best"), F.sum("n").alias("total"))
    return best.select(key, f"_best.{value}", "_best.n", "total").withColumn("confidence", F.bround(F.col("n") * 100 / F.col("total"), 1))


def exception_rates(rows: DataFrame, key: str, flag: Column, least: int = 5, rate: int = 40) -> DataFrame:
    """(key, n, exceptions, rate, high): share of flagged rows by key, in percent; high from ``rate`` and ``least`` rows on."""
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(flag.cast("long")).alias("exceptions"))
    return out.withColumn("rate", F.bround(F.col("exceptions") * 100 / F.col("n"), 1)).withColumn("high", (F.col("n") >= least) & (F.col("exceptions") * 100 >= F.col("n") * rate))
