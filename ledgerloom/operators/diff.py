"""Differences between two copies of a table, field by field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import canonical_number
from ledgerloom.runtime import strip

LONG = 64


def text_content(c: Column) -> Column:
    """Text without outer blanks; null equals an empty text."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def value_content(c: Column) -> Column:
    """As :func:`text_content`, but a number compares as a number whatever its layout. Zero is not blank."""
    text = text_content(c)
    return F.coalesce(F.concat(F.lit("\u0000n"), canonical_number(text, trailing_minus=False)), text)


def exact_content(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def signed_cells(a: DataFrame, b: DataFrame, key: Column, fields: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """Both sides as (key, field, content, in_a, in_b) rows, equal cells already counted together.

    The field ``""`` stands for the row itself. Contents of over 64 characters are carried as their SHA-256 digest.
    """

    def cells(df: DataFrame, sign: int) -> DataFrame:
        # One projection for the contents and one for the digests, so that each stays small enough to be compiled.
        flat = df.select(key.alias("key"), *[content(F.col(f"`{name}`")).alias(f"c{i}") for i, (name, content) in enumerate(fields.items())])
        short = lambda c: F.when(F.length(c) > LONG, F.concat(F.lit("\u0000h"), F.sha2(c, 256))).otherwise(F.col(c))
        rows = [F.struct(F.lit("").alias("field"), F.lit("").alias("content"))] + [F.struct(F.lit(name).alias("field"), short(f"c{i}").alias("content")) for i, name in enumerate(fields)]
        return flat.select("key", F.explode(F.array(*rows)).alias("cell")).select("key", "cell.field", "cell.content", F.lit(sign).alias("sign"))

    counts = cells(a, 1).unionAll(cells(b, -1)).groupBy("key", "field", "content")
    return counts.agg(F.sum((F.col("sign") > 0).cast("long")).alias("in_a"), F.sum((F.col("sign") < 0).cast("long")).alias("in_b"))


def diff_copies(a: DataFrame, b: DataFrame, key: Column, fields: dict[str, Callable[[Column], Column]], multiplicity: bool = False) -> DataFrame:
    """Keys in one copy only, and fields whose contents differ: (key, diff, cells_a, cells_b).

    Unpivots both sides to key-field-content rows, unions them with signed counts and groups to find what is not cancelled.
    ``diff`` is ``only_a``, ``only_b`` or a column name; ``cells_a`` and ``cells_b`` count the differing rows of either side.
    Rows repeated exactly count once, so a copy with repeats equals one without; with ``multiplicity``, a key in both that has
    more rows in one is a ``count``, with its rows of either side. Where a key has several rows of different
    content, a field differs if the sets of contents differ. A null key is a key of its own, returned as an empty text. Empty
    tables give rows for the other side only; columns that are not named are ignored, whatever they are called. A hot key costs
    nothing extra: equal cells are counted before the shuffle and each key is reduced to flags.
    """
    cells = signed_cells(a, b, F.coalesce(key, F.lit("")), fields)
    open_a, open_b = (F.col("in_a") > 0) & (F.col("in_b") == 0), (F.col("in_b") > 0) & (F.col("in_a") == 0)
    by_field = cells.groupBy("key", "field").agg(
        F.sum(F.when(open_a, F.col("in_a")).otherwise(0)).alias("cells_a"),
        F.sum(F.when(open_b, F.col("in_b")).otherwise(0)).alias("cells_b"),
        F.sum("in_a").alias("n_a"),
        F.sum("in_b").alias("n_b"),
    )
    whole = F.col("field") == ""
    one_sided = (F.col("n_a") == 0) | (F.col("n_b") == 0)
    diff = F.when(whole & (F.col("n_b") == 0), F.lit("only_a")).when(whole & (F.col("n_a") == 0), F.lit("only_b")).when(~whole & ~one_sided & ((F.col("cells_a") > 0) | (F.col("cells_b") > 0)), F.col("field"))
    if multiplicity:
        uneven = whole & ~one_sided & (F.col("n_a") != F.col("n_b"))
        diff = F.when(uneven, F.lit("count")).otherwise(diff)
        by_field = by_field.withColumns({f"cells_{x}": F.when(uneven, F.col(f"n_{x}")).otherwise(F.col(f"cells_{x}")) for x in "ab"})
    return by_field.withColumn("diff", diff).where("diff is not null").select("key", "diff", "cells_a", "cells_b")


FILING_FIELDS = {"form": text_content, "line": text_content, "description": text_content, "value": value_content, "is_carryforward": exact_content}


def filing_key(c: Column) -> Column:
    return F.upper(strip(c))


def diff_filings(a: DataFrame, b: DataFrame) -> DataFrame:
    return diff_copies(a, b, filing_key(F.col("field_id")), FILING_FIELDS)
