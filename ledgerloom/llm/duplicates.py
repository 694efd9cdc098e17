"""Records that are equal but for formatting: canonical bytes, recursive radix partitioning, tries with terminal counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.money import canonical_number
from ledgerloom.operators.joins import checked_broadcast
from ledgerloom.runtime import forget, stored

#: Distinct canonical texts of one bucket.
BUCKET = 50_000
ROUNDS = 40


def text_form(c: Column) -> Column:
    """Letters and digits in lower case; null is an empty text."""
    return F.coalesce(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}]", ""), F.lit(""))


def number_form(c: Column) -> Column:
    s = c.cast("string")
    return F.coalesce(F.when(s.contains("."), F.regexp_replace(s, r"\.?0+$", "")).otherwise(s), F.lit(""))


def amount_form(c: Column) -> Column:
    """A typed amount as its number, sign kept, whatever its layout; null where it is none."""
    return canonical_number(F.regexp_replace(F.regexp_replace(c, r"^\s*\$\s*\(", "("), r"\s+", ""))


def canonical(df: DataFrame, row_id: str, texts: list[str], numbers: list[str], amount: str | None) -> DataFrame:
    """(row_id, canon): the forms of all fields, sorted, so that values standing in each other's column make no difference.

    Where the amount's column holds no number, the amount is looked for in the text columns: the first that has a currency
    sign, thousands commas or decimals. All else is compared as text. Each form is a projection of its own, worked out once;
    texts are read as amounts only in the few rows whose amount is none.
    """
    none = F.lit(None).cast("string")
    flat = df.select(
        F.col(row_id).alias("row_id"), F.array(*[F.col(f"`{c}`").cast("string") for c in texts]).alias("t") if texts else F.array().cast("array<string>").alias("t"),
        F.array(*[number_form(F.col(f"`{c}`")) for c in numbers]).alias("n") if numbers else F.array().cast("array<string>").alias("n"), (F.col(f"`{amount}`") if amount else none).alias("amount"),
    )
    flat = flat.withColumn("value", amount_form(F.col("amount")))
    looks = lambda t: F.when(t.rlike(r"[$(]|\.\d{2}\s*\)?-?\s*$|,\d{3}"), amount_form(t))
    flat = flat.withColumn("strays", F.when(F.col("value").isNull(), F.transform("t", looks)))
    flat = flat.withColumn("stray", F.array_position(F.transform("strays", lambda x: x.isNotNull()), F.lit(True)).cast("int"))
    form = lambda t, i: F.when(i + 1 == F.col("stray"), F.get("strays", i)).otherwise(text_form(t))
    fields = F.concat(F.transform("t", form), F.col("n"), F.array(F.coalesce("value", text_form(F.col("amount")))))
    return flat.select("row_id", F.array_join(F.reverse(F.array_sort(fields)), "\u001f").alias("canon"))


class Trie:
    """Path-compressed trie over the characters of canonical texts; each terminal counts its copies and keeps the least id."""

    def __init__(self) -> None:
        self.root: list = ["", {}, 0, None]

    def add(self, text: str, n: int, least: int) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                node[1][text[at]] = [text[at:], {}, n, least]
                return
            label = child[0]
            if text.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = 1
            while k < len(label) and at + k < len(text) and label[k] == text[at + k]:
                k += 1
            upper = [label[:k], {label[k]: child}, 0, None]
            child[0] = label[k:]
            node[1][text[at]] = upper
            node, at = upper, at + k
        node[2] += n
        node[3] = least if node[3] is None else min(node[3], least)

    def terminals(self) -> Iterator[tuple[str, int, int]]:
        stack = [("", self.root)]
        while stack:
            prefix, (label, children, n, least) = stack.pop()
            here = prefix + label
            if n:
                yield here, n, least
            stack.extend((here, c) for c in children.values())


COUNTED = "canon string, n long, least long"


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One trie for each bucket of this partition, whose rows come bucket by bucket; its terminals when the bucket ends."""
    at, trie = None, Trie()
    for f in frames:
        out = []
        for b, c, n, least in zip(f["bucket"], f["canon"], f["n"], f["least"], strict=True):
            if b != at:
                out.extend(trie.terminals())
                at, trie = b, Trie()
            trie.add(c, n, least)
        yield pd.DataFrame(out, columns=["canon", "n", "least"])
    yield pd.DataFrame(list(trie.terminals()), columns=["canon", "n", "least"])


def radix_buckets(keys: DataFrame, bucket_size: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """``keys`` (canon, ...) with ``bucket``, a prefix of canon; and (bucket, rows) of all buckets.

    Begins with one bucket. Each round counts the buckets and splits those beyond ``bucket_size`` by the characters that
    follow their longest common prefix, found from their least and greatest text: one character in the first round and twice
    as many in each further one, so that the rounds are few however deep the texts agree. A bucket whose texts are all equal
    can't be split and needn't be: equal texts were combined before. The splits are a table like any other, broadcast only
    where it is small; only the buckets on their way through the rounds are written again.
    """
    done, sizes_done, steps = [], [], []
    left = stored(keys.withColumn("bucket", F.lit("")), "keys")
    for turn in range(ROUNDS):
        sizes = left.groupBy("bucket").agg(F.count("*").alias("rows"), F.min("canon").alias("lo"), F.max("canon").alias("hi"))
        sizes = stored(sizes.withColumn("large", (F.col("rows") > bucket_size) & (F.col("lo") != F.col("hi"))), "sizes")
        if sizes.where("large").isEmpty():
            buckets, counts = left, sizes.select("bucket", "rows")
            for k, n in zip(done, sizes_done, strict=True):
                buckets, counts = buckets.unionAll(k), counts.unionAll(n)
            buckets._steps = [left, sizes, *done, *steps]
            return buckets, counts
        steps.append(sizes)
        letters = lambda c: F.split(c, "")
        agree = F.array_position(F.zip_with(letters("lo"), letters("hi"), lambda x, y: x.eqNullSafe(y)), F.lit(False))
        splits = checked_broadcast(sizes.where("large").select(F.col("bucket").alias("old"), (F.when(agree > 0, agree).otherwise(F.least(F.length("lo"), F.length("hi")) + 1) + (2**turn - 1)).cast("int").alias("upto")))
        marked = left.join(splits, left["bucket"] == splits["old"], "left")
        again = stored(marked.where("upto is not null").withColumn("bucket", F.expr("substring(canon, 1, upto)")).drop("old", "upto"), "keys")
        done.append(stored(marked.where("upto is null").drop("old", "upto"), "keys"))
        sizes_done.append(sizes.where("not large").select("bucket", "rows"))
        forget(left)
        left = again
    raise RuntimeError("the buckets didn't shrink")


def collapse(df: DataFrame, row_id: str, texts: list[str], numbers: list[str], amount: str | None, bucket_size: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(first_row_id, copies, digest) of each distinct record, and (row_id, digest) of each row.

    Records are equal when the forms of their fields are, as a multiset. Equal texts are counted by each task before any row
    is sent, so that a third of all rows being copies of one record sends one row a task. Null and empty fields are equal; a
    row of nothing but nulls equals another such row; very long fields are compared whole; row ids are unique. An empty table
    gives no rows; columns not named are ignored.
    """
    rows = stored(canonical(df, row_id, texts, numbers, amount), "canonical")
    combined = rows.groupBy("canon").agg(F.count("*").alias("n"), F.min(F.col("row_id").cast("long")).alias("least"))
    keys, sizes = radix_buckets(combined, bucket_size)
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    parts = max(1, -(-2 * total // bucket_size))
    records = keys.select("bucket", "canon", "n", "least").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(_count, COUNTED)
    records = stored(records.select(F.col("least").alias("first_row_id"), F.col("n").alias("copies"), F.sha2("canon", 256).alias("digest")), "records")
    forget(*keys._steps)
    digests = rows.select("row_id", F.sha2("canon", 256).alias("digest"))
    digests._stored_at = rows._stored_at
    return records, digests


def copies(df: DataFrame, row_id: str, texts: list[str], numbers: list[str], amount: str | None, bucket_size: int = BUCKET) -> DataFrame:
    """(first_row_id, copy_row_id) of every copy beyond the first. Only records that have copies are joined to the rows."""
    records, rows = collapse(df, row_id, texts, numbers, amount, bucket_size)
    repeated = records.where("copies > 1").select("digest", "first_row_id")
    out = stored(rows.join(repeated, "digest").where("row_id != first_row_id").select("first_row_id", F.col("row_id").alias("copy_row_id")), "copies")
    forget(records, rows)
    return out
