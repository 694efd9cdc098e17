"""Reproducible audit samples: the draws are the generator's of the contract, made from counts, never from rows."""

from __future__ import annotations

import math
import random
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.windows import monetary_hits
from ledgerloom.runtime import stored

#: Rows of one range, within which positions are counted.
RANGE = 200_000


def sampling_interval(tolerable: Decimal, expected: Decimal, expansion: Decimal, risk: float) -> Decimal:
    """(tolerable - expected * expansion) / -ln(risk)."""
    return (tolerable - expected * expansion) / Decimal(str(-math.log(risk)))


def monetary_sample(rows: DataFrame, row_id: str, value: str, interval: Decimal, seed: int) -> DataFrame:
    start = Decimal(str(random.Random(seed).random())) * interval
    return monetary_hits(rows, row_id, value, interval.quantize(Decimal("0.000001")), start.quantize(Decimal("0.000001")))


def positions(rows: DataFrame, order: list[Column], group: list[str] | None = None) -> DataFrame:
    """``rows`` with ``position``, 0-based in the order: ranges are sorted each for itself and offset by the ranges before."""
    group = group or []
    ranged = stored(rows.repartitionByRange(max(1, rows.count() // RANGE + 1), *[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))), "ranges")
    sizes = ranged.groupBy("_part", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))  # a row for each range
    return ranged.join(offsets, ["_part", *group]).withColumn("position", (F.col("_o") + F.col("_at") - 1).cast("long")).drop("_part", "_at", "_o")


def random_sample(rows: DataFrame, row_id: str, n: int, seed: int) -> DataFrame:
    """The rows at the positions, by id, that the generator draws; all of them if there are no more than ``n``."""
    total = rows.count()
    if n >= total:
        return rows
    drawn = rows.sparkSession.createDataFrame([(i,) for i in sorted(random.Random(seed).sample(range(total), n))], "position long")
    return positions(rows, [F.col(row_id)]).join(F.broadcast(drawn), "position", "left_semi").drop("position")


def stratified_sample(rows: DataFrame, row_id: str, value: str, bounds: list[Decimal], sizes: list[int], seed: int) -> DataFrame:
    """``rows`` drawn with ``stratum``: strata by descending bounds, the values of one in descending order, one generator for all."""
    stratum = F.lit(len(bounds) + 1)
    for i, b in reversed(list(enumerate(bounds, 1))):
        stratum = F.when(F.col(value) >= F.lit(b), i).otherwise(stratum)
    ranked = positions(rows.where(F.col(value) > 0).withColumn("stratum", stratum), [F.col(value).desc(), F.col(row_id)], ["stratum"])
    counts = {r.stratum: r.n for r in ranked.groupBy("stratum").agg(F.count("*").alias("n")).collect()}  # a row for each stratum
    rng, drawn = random.Random(seed), []
    for i in range(1, len(bounds) + 2):
        have, want = counts.get(i, 0), sizes[i - 1] if i <= len(sizes) else 0
        drawn += [(i, p) for p in (range(have) if want >= have else sorted(rng.sample(range(have), want)))]
    return ranked.join(F.broadcast(rows.sparkSession.createDataFrame(drawn, "stratum int, position long")), ["stratum", "position"], "left_semi").drop("position")


def project(sample: DataFrame, book: str, audited: str, interval: Decimal) -> DataFrame:
    """``sample`` with ``projected``: the tainting of an item times the interval; items of an interval or more at their difference."""
    diff = F.col(book) - F.col(audited)
    return sample.withColumn("projected", F.when(F.col(book) >= F.lit(interval), diff).otherwise(diff / F.col(book) * F.lit(interval)).cast("decimal(18,2)"))
