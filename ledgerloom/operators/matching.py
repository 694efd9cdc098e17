"""Order-dependent matching of two ledgers: cascades, subset sums and allocation.

Exact passes are joins. What they leave open is cut into the smallest groups whose items can affect one another: items of one
account and amount whose days follow each other within the window, then of one account and amount, then of one account whose
days follow each other within the window. Each group is matched in the order of ids, as if the whole account were.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.joins import rank_pairs
from ledgerloom.runtime import forget, stored


def subset_sum(amounts: list[int], target: int, most: int = 6) -> tuple[int, ...] | None:
    """Places of the first of the smallest subsets of two to ``most`` amounts that add to the target, in the list's order."""
    for size in range(2, min(most, len(amounts)) + 1):
        for chosen in combinations(range(len(amounts)), size):
            if sum(amounts[i] for i in chosen) == target:
                return chosen
    return None


Row = tuple[int, int, int, frozenset]  # id, cents, day, tokens


def nearest(bank: list[Row], book: list[Row], days: int) -> list[tuple[int, int, str]]:
    """Each bank item takes the open book item of its amount of the nearest day within ``days``, the first by id of equal ones."""
    by_day: dict[tuple[int, int], deque[int]] = {}
    for r in book:
        by_day.setdefault((r[1], r[2]), deque()).append(r[0])
    out = []
    for i, cents, day, _ in bank:
        for off in range(days + 1):
            open_ = [q for q in (by_day.get((cents, day - off)), by_day.get((cents, day + off)) if off else None) if q]
            if open_:
                out.append((i, min(open_, key=lambda q: q[0]).popleft(), "nearest_date"))
                break
    return out


def by_tokens(bank: list[Row], book: list[Row], least: float) -> list[tuple[int, int, str]]:
    """Items of one amount: each bank item takes the open book item that shares most of the shorter one's words, the first of equal ones."""
    left, out = dict.fromkeys(r[0] for r in book), []
    for i, cents, _, words in bank:
        scored = [(len(words & r[3]) / min(len(words), len(r[3])), -k, r[0]) for k, r in enumerate(book) if r[1] == cents and r[0] in left and r[3] and words]
        if scored and max(scored)[0] >= least:
            left.pop(max(scored)[2])
            out.append((i, max(scored)[2], "tokens"))
    return out


def by_subsets(bank: list[Row], book: list[Row], days: int, cap: int) -> list[tuple[int, int, str]]:
    """One bank item for several book items, then one book item for several bank items, of one sign, within ``days``."""
    left, right, out = dict.fromkeys(r[0] for r in bank), dict.fromkeys(r[0] for r in book), []

    def side(ones: list[Row], many: list[Row], open_ones: dict, open_many: dict, rule: str, turned: bool) -> None:
        by_day: dict[int, list[Row]] = {}
        for r in many:
            by_day.setdefault(r[2], []).append(r)
        for i, cents, day, _ in ones:
            if i in open_ones:
                pool = [r for d in range(day - days, day + days + 1) for r in by_day.get(d, ()) if r[0] in open_many and (r[1] > 0) == (cents > 0) and abs(r[1]) <= abs(cents)]
                pool = sorted(pool, key=lambda r: (-abs(r[1]), r[0]))[:cap]
                if chosen := subset_sum([r[1] for r in pool], cents):
                    open_ones.pop(i)
                    for k in chosen:
                        open_many.pop(pool[k][0])
                        out.append((pool[k][0], i, rule) if turned else (i, pool[k][0], rule))

    side(bank, book, left, right, "many_to_one", False)
    side(book, bank, right, left, "one_to_many", True)
    return out


def residual_matches(bank: list[Row], book: list[Row], days: int, least: float, cap: int) -> list[tuple[int, int, str]]:
    """(bank, book, rule) of one account's rows in id order: nearest date, then tokens, then subsets either way."""
    out: list[tuple[int, int, str]] = []
    for step in (lambda x, y: nearest(x, y, days), lambda x, y: by_tokens(x, y, least), lambda x, y: by_subsets(x, y, days, cap)):
        used = {r[0] for r in out}, {r[1] for r in out}
        out += step([r for r in bank if r[0] not in used[0]], [r for r in book if r[0] not in used[1]])
    return out


def _in_groups(rows: DataFrame, keys: list[str], match: Callable[[list[Row], list[Row]], list[tuple[int, int, str]]]) -> DataFrame:
    """(bank_id, book_id, rule) of ``match`` on each group of ``rows`` (keys, bank, id, cents, day, tokens) that has both sides.

    A task goes through its groups one after another and holds one at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sides = None, ([], [])
        columns = ["bank_id", "book_id", "rule"]
        for f in frames:
            out = []
            for *key, bank, i, cents, day, words in zip(*[f[c].tolist() for c in [*keys, "bank", "id", "cents", "day", "tokens"]], strict=True):
                if key != at:
                    out += match(*sides) if all(sides) else []
                    at, sides = key, ([], [])
                sides[0 if bank else 1].append((i, cents, day, frozenset(words if words is not None else ())))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(match(*sides) if all(sides) else [], columns=columns)

    both = Window.partitionBy(*keys)
    some = rows.withColumn("_b", F.max("bank").over(both) & ~F.min("bank").over(both)).where("_b").drop("_b")
    return some.repartition(*keys).sortWithinPartitions(*keys, "id").select(*dict.fromkeys([*keys, "bank", "id", "cents", "day", "tokens"])).mapInPandas(run, "bank_id long, book_id long, rule string")


def _near(rows: DataFrame, keys: list[str], days: int) -> DataFrame:
    """``rows`` with ``run``: the number of the run of days, each within ``days`` of the one before, that a row belongs to."""
    w = Window.partitionBy(*keys).orderBy("day")
    starts = rows.withColumn("_s", F.when(F.col("day") - F.lag("day").over(w) <= days, 0).otherwise(1))
    return starts.withColumn("run", F.sum("_s").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))).drop("_s")


def match_ledgers(bank: DataFrame, book: DataFrame, days: int = 5, least: float = 0.6, cap: int = 14) -> DataFrame:
    """(bank_id, book_id, rule) of two tables of account, id, date, amount, check_no and tokens.

    Check number and amount, then amount and date, are joins of the n-th rows by id. The rest of each account is matched by
    nearest date within ``days``, by tokens, and by subsets of two to six of the ``cap`` largest items on either side of one
    item, always in the order of ids. The outcome is that of each account as a whole: only items that can't affect one another
    are taken apart. An account without a gap of over ``days`` in its open items is one group of the last pass. Rows without
    account, date or amount, and of amount zero, stay open.
    """
    side = lambda df: df.where("account is not null and date is not null and amount != 0").select("account", "id", "date", F.col("amount").cast("decimal(18,2)").alias("amount"), "check_no", "tokens")
    a, b = stored(side(bank), "bank"), stored(side(book), "book")
    found = []
    for rule, keys in (("check_amount", ["account", "check_no", "amount"]), ("amount_date", ["account", "amount", "date"])):
        hit = stored(rank_pairs(a.withColumnRenamed("id", "bank_id"), b.withColumnRenamed("id", "book_id"), keys, "bank_id", "book_id").withColumn("rule", F.lit(rule)), "pairs")
        found.append(hit)
        a = a.join(hit.select(F.col("bank_id").alias("id")), "id", "left_anti")
        b = b.join(hit.select(F.col("book_id").alias("id")), "id", "left_anti")
    flat = lambda df, of: df.select("account", F.lit(of).alias("bank"), "id", (F.col("amount") * 100).cast("long").alias("cents"), F.unix_date("date").alias("day"), "tokens")
    rest = stored(flat(a, True).unionAll(flat(b, False)), "open")
    steps = (
        (lambda df: _near(df, ["account", "cents"], days), ["account", "cents", "run"], lambda x, y: nearest(x, y, days)),
        (lambda df: df, ["account", "cents"], lambda x, y: by_tokens(x, y, least)),
        (lambda df: _near(df, ["account"], days), ["account", "run"], lambda x, y: by_subsets(x, y, days, cap)),
    )
    for cut, keys, match in steps:
        hit = stored(_in_groups(cut(rest), keys, match), "pairs")
        found.append(hit)
        taken = hit.select(F.col("bank_id").alias("id"), F.lit(True).alias("bank")).unionAll(hit.select(F.col("book_id").alias("id"), F.lit(False).alias("bank"))).distinct()
        rest = rest.join(taken, ["id", "bank"], "left_anti")
    out = stored(reduce(DataFrame.unionAll, found), "matched")
    forget(*found)
    return out


def allocate(deposits: DataFrame, invoices: DataFrame) -> DataFrame:
    """(deposit_id, invoice_id, applied): deposits of a customer applied to its oldest open invoices, both in order, until either is used up.

    Both sides' running totals mark one line; between two marks that follow each other lies one deposit and one invoice, those
    whose marks come next. Amounts of zero and less take no part. One sort by customer, from the last mark back, and running
    frames do it; no deposit meets all invoices.
    """

    def marks(df: DataFrame, i: str, amount: str) -> DataFrame:
        w = Window.partitionBy("customer").orderBy("date", i).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.where(F.col("customer").isNotNull() & (F.col(amount) > 0)).select("customer", F.sum(amount).over(w).alias("mark"), F.col(i).alias(i))

    line = marks(deposits, "deposit_id", "amount").unionByName(marks(invoices, "invoice_id", "open"), allowMissingColumns=True)
    back = Window.partitionBy("customer").orderBy(F.col("mark").desc(), F.col("deposit_id").desc_nulls_last(), F.col("invoice_id").desc_nulls_last())
    upto = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = line.select(F.last("deposit_id", True).over(upto).alias("deposit_id"), F.last("invoice_id", True).over(upto).alias("invoice_id"), (F.col("mark") - F.coalesce(F.lead("mark").over(back), F.lit(0))).alias("applied"))
    return parts.where("applied > 0 and deposit_id is not null and invoice_id is not null")
