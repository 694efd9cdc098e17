"""Ordered computations: balances, spans, gaps, streaks and schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(group: str | list[str], *order: str) -> Window:
    return Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def balance_breaks(rows: DataFrame, group: str, order: str, amount: str, printed: str, opening: Column | None = None) -> DataFrame:
    """(columns, expected, difference): rows whose printed balance isn't the last printed one plus what was booked since.

    After every printed balance the walk goes on from it, so that one wrong balance makes one break.
    """
    before = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.withColumn("_segment", F.count(printed).over(before)).withColumn("_last", F.coalesce(F.last(printed, True).over(before), opening if opening is not None else F.lit(0)))
    since = F.sum(F.coalesce(amount, F.lit(0))).over(running([group, "_segment"], order))
    out = cut.withColumn("expected", F.col("_last") + since).withColumn("difference", F.col(printed) - F.col("expected"))
    return out.where("difference != 0").drop("_segment", "_last")


def sequence_gaps(rows: DataFrame, column: str) -> DataFrame:
    """(prefix, after, before, missing): gaps in the numbers behind each prefix of a document number."""
    number = rows.select(F.regexp_extract(column, r"^(.*?)(\d+)$", 1).alias("prefix"), F.regexp_extract(column, r"^(.*?)(\d+)$", 2).try_cast("long").alias("after")).where("after is not null").distinct()
    following = number.withColumn("before", F.lead("after").over(Window.partitionBy("prefix").orderBy("after")))
    return following.where("before > after + 1").withColumn("missing", F.col("before") - F.col("after") - 1)


def consumption(rows: DataFrame, keys: list[str], order: list[str], quantity: str, limit: str) -> DataFrame:
    """``rows`` with ``used``, the quantity drawn so far, and ``over``, whether it passes the limit."""
    return rows.withColumn("used", F.sum(quantity).over(running(keys, *order))).withColumn("over", F.coalesce(F.col("used") > F.col(limit), F.lit(False)))


def monetary_hits(rows: DataFrame, row_id: str, value: str, interval: object, start: object, part: int = 200_000) -> DataFrame:
    """(row_id, value, basis, hits): systematic selection of monetary units from a start; items of an interval or more are all in.

    The line of units runs through the smaller items by id. Its running sum is taken within ranges of ids on top of the sums
    of the ranges before, so that it needs no single task.
    """
    base = rows.where(F.col(value) > 0).select(row_id, value)
    top = base.where(F.col(value) >= F.lit(interval)).select(row_id, value, F.lit("top").alias("basis"), F.lit(1).cast("long").alias("hits"))
    low = base.where(F.col(value) < F.lit(interval))
    bounds = low.agg(F.min(row_id), F.max(row_id), F.count("*")).first()
    lo, hi = bounds[0] or 0, bounds[1] or 0
    width = max(1, -(-(hi - lo + 1) * part // max(1, bounds[2])))  # ``part`` rows in the mean
    ranged = low.withColumn("_r", F.floor((F.col(row_id) - lo) / width))
    sums = ranged.groupBy("_r").agg(F.sum(value).alias("_s"))
    offset = sums.select("_r", F.coalesce(F.sum("_s").over(Window.partitionBy(F.lit(1)).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))  # a row for each range
    line = ranged.join(offset, "_r").withColumn("_end", F.col("_o") + F.sum(value).over(running("_r", row_id)))
    reached = lambda c: F.floor((c - F.lit(start)) / F.lit(interval)) + 1
    upto, before = F.greatest(F.lit(0), reached(F.col("_end"))), F.greatest(F.lit(0), reached(F.col("_end") - F.col(value)))
    before = F.when(F.col("_end") == F.col(value), F.lit(0)).otherwise(before)  # a start of zero falls on the first item
    return top.unionByName(line.select(row_id, value, F.lit("hit").alias("basis"), (upto - before).cast("long").alias("hits")).where("hits > 0"))


def streaks(rows: DataFrame, key: str, period: str) -> DataFrame:
    """(key, period, streak): how many consecutive whole-numbered periods up to this one the key appears in."""
    one = rows.select(key, period).distinct().where(F.col(period).isNotNull())
    w = Window.partitionBy(key).orderBy(period)
    return one.withColumn("_run", F.col(period) - F.row_number().over(w)).withColumn("streak", F.row_number().over(Window.partitionBy(key, "_run").orderBy(period)).cast("int")).drop("_run")


def annuity_schedule(payment: Column, rate: Column, periods: Column) -> Column:
    """Array of (period, interest, principal, balance) of level payments in arrears, in cents; the last period clears the balance.

    All in decimals, rounded half up: the present value from discount factors of twelve places, interest period by period.
    The recurrence isn't a window, so it is folded through a sequence.
    """
    cents = lambda c: F.round(c, 2).cast("decimal(18,2)")
    factor, growth = F.lit(1).cast("decimal(38,24)"), (1 + rate).cast("decimal(10,8)")
    one = F.struct(factor.alias("factor"), F.lit(0).cast("decimal(30,12)").alias("sum"))

    def discount(acc: Column, _: Column) -> Column:
        f = (acc["factor"] / growth).cast("decimal(38,24)")
        return F.struct(f.alias("factor"), (acc["sum"] + f.cast("decimal(30,12)")).cast("decimal(30,12)").alias("sum"))

    present = cents((payment.cast("decimal(18,2)") * F.aggregate(F.sequence(F.lit(1), periods), one, discount, lambda acc: acc["sum"]).cast("decimal(18,12)")).cast("decimal(38,12)"))
    seed = F.struct(F.array().cast("array<struct<period:int,interest:decimal(18,2),principal:decimal(18,2),balance:decimal(18,2)>>").alias("rows"), present.alias("balance"))

    def step(acc: Column, k: Column) -> Column:
        last = k == periods
        interest = F.when(last, cents(payment - acc["balance"])).otherwise(cents(acc["balance"] * rate))
        principal = F.when(last, acc["balance"]).otherwise(cents(payment - interest))
        balance = cents(acc["balance"] - principal)
        row = F.struct(k.cast("int").alias("period"), interest.alias("interest"), principal.alias("principal"), balance.alias("balance"))
        return F.struct(F.concat(acc["rows"], F.array(row)).alias("rows"), balance.alias("balance"))

    return F.aggregate(F.sequence(F.lit(1), periods), seed, step, lambda acc: acc["rows"])


def level_charge(value: Column, periods: Column) -> Column:
    """One period's part of ``value``, half up to the cent; null without periods."""
    return F.when(periods > 0, F.round(value / periods, 2).cast("decimal(18,2)"))
