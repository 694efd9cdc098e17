"""Row predicates shared by the tests of ledgers."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The moduli that make an amount round.
ROUND = (10_000_000, 1_000_000, 500_000, 100_000, 50_000, 25_000, 10_000, 5_000, 1_000)


def round_modulus(amount: Column, moduli: tuple[int, ...] = ROUND, least: int = 1000, significance: int = 20) -> Column:
    """Largest modulus that divides an amount and is a fair part of it (a twentieth); null where it isn't round."""
    a = F.abs(amount)
    out = None
    for m in moduli:
        hit = (a >= max(m, least)) & (a <= m * significance) & (F.pmod(a, F.lit(Decimal(m))) == 0)
        out = F.when(hit, m) if out is None else out.when(hit, m)
    return out


def just_below(amount: Column, thresholds: list[Decimal], band: Decimal = Decimal("0.05")) -> Column:
    """First threshold that an amount stays below by no more than the band; null where there is none."""
    levels = F.array(*[F.lit(t) for t in thresholds])
    return F.get(F.filter(levels, lambda t: (amount >= t - t * F.lit(band)) & (amount < t)), F.lit(0))


def beyond(value: Column, base: Column, amount: Decimal, percent: Decimal, floor: Decimal | None = None) -> Column:
    """Dual materiality: the amount is reached, or the percentage of ``base`` is and the larger side reaches the floor."""
    delta, size = F.abs(value - base), F.greatest(F.abs(value), F.abs(base))
    share = (base != 0) & (delta * 100 >= F.abs(base) * F.lit(percent))
    return F.coalesce((delta >= F.lit(amount)) | (share & (size >= F.lit(floor) if floor is not None else F.lit(True))), F.lit(False))


def close(a: Column, b: Column, floor: Decimal = Decimal("0.00"), percent: Decimal = Decimal("0")) -> Column:
    """Equality within the larger of a floor and a percentage of the larger side."""
    return F.abs(a - b) <= F.greatest(F.lit(floor), F.greatest(F.abs(a), F.abs(b)) * F.lit(percent) / 100)


def wrong_sign(net: Column, kind: Column, debit_kinds: tuple[str, ...], contra: Column) -> Column:
    """Whether a balance stands on the other side than its account's kind has it; contra accounts are turned round."""
    return F.coalesce((net != 0) & ((net > 0) != (kind.isin(*debit_kinds) != contra)), F.lit(False))


def calendar_flags(posted: Column, effective: Column, opens: int = 7, closes: int = 19, lag: int = 5) -> dict[str, Column]:
    """Weekend, after hours and late posting; null stamps raise nothing."""
    no = F.lit(False)
    return {"weekend": F.coalesce(F.weekday(posted) >= 5, no), "after_hours": F.coalesce((F.hour(posted) < opens) | (F.hour(posted) >= closes), no), "late": F.coalesce(F.datediff(posted, effective) > lag, no)}


def scoped_limit(rows: DataFrame, limits: DataFrame, scope: list[str], limit: str) -> DataFrame:
    """``rows`` with the ``limit`` of the most specific scope: all columns given, then the first ones, then the rest, then none.

    ``limits`` has the scope's columns, null where they say nothing, and the limit; texts compare without case. It is a policy
    of few rows: each combination of given columns is one equi-join with its least limit.
    """
    out, found = rows, []
    for k in sorted(range(2 ** len(scope)), key=lambda k: (-k.bit_count(), [not k >> i & 1 for i in range(len(scope))])):
        given = [c for i, c in enumerate(scope) if k >> i & 1]
        some = limits.where(" and ".join(f"`{c}` is {'not ' if c in given else ''}null" for c in scope))
        name = f"_limit{k}"
        found.append(F.col(name))
        if not given:
            out = out.withColumn(name, some.agg(F.min(limit)).scalar())
            continue
        keys = [F.lower(F.trim(c)).alias(f"_k{i}") for i, c in enumerate(given)]
        side = some.groupBy(*keys).agg(F.min(limit).alias(name))
        on = [F.lower(F.trim(out[c])) == F.col(f"_k{i}") for i, c in enumerate(given)]
        out = out.join(side, on, "left").drop(*[f"_k{i}" for i in range(len(given))])
    return out.withColumn(limit, F.coalesce(*found)).drop(*[f"_limit{k}" for k in range(2 ** len(scope))])
