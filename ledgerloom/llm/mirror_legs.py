"""Matching the two legs of one transfer, each booked by one side without a common number: a cascade of joins.

Every rule joins the sets of alike legs still open on fewer or coarser attributes than the one before, pairs legs of sets in
the order of the pairs' ranks until it has no further pair, and takes them out of the pool. Equal attributes are equi-joins; where a rule
allows a span of days or of amounts, the join is on the span's or the amount step's number.

A leg that cites the other side's document is a labelled case. Each rule is tried on its labelled cases with the citations held
out: the candidate it would then take is right or wrong by the citation. The share of right ones, smoothed towards that of all
rules, is the confidence of the rule's pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import forget, stored

DAYS = 14
#: Largest difference of amounts: a share of the amount (charges deducted on the way) or a flat sum.
RATE, FLAT = 0.01, 60.0
#: Ranges of ids of one set of alike legs that is numbered in parts.
SALTS = 64
#: Rows of one set from which on it is numbered in parts.
HOT = 100_000
#: Candidates of one pair of entities up to which one task takes them in order.
CROWD = 1_000_000

#: Words of transfer descriptions by the kind of charge.
KINDS = {
    "royalty": "royalty|licence|brand",
    "cash": "sweep|pool|pooling|treasury|balance",
    "goods": "goods|material|shipment|stock|transferred",
    "insurance": "insurance|premium|ins",
    "freight": "freight|haulage",
    "management": "mgmt|mgt|management|head|office",
    "audit": "audit",
    "it": "hosting|system|it services|it cost",
    "tooling": "tooling|tool|tools",
    "staff": "payroll|seconded|secondee|staff",
    "research": "research|development|r&d",
    "interest": "interest|loan",
}
#: Words that name neither a kind nor a site.
OTHER = "fee|ip|charge|zero|cash|share|rebill|recharge|sale|set|sold|transfer|contribution|cost|costs|allocation|services|group|raw|accrual|on|ic|intgrp|int|split|pass|through|cross|of|fees|ext|interco|settlement|see|attached|site|re|ref|yr|our|your"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_MONTH = r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)(?:uary|ruary|ch|il|e|y|ust|tember|ober|ember)?\b"


def describe(legs: DataFrame) -> DataFrame:
    """What the description says: kind, month, cited number and site words (first five letters, sorted, so that swapped letters make no difference)."""
    text = F.lower(F.coalesce("description", F.lit("")))
    cited = F.regexp_extract(text, r"(?:\bref?\s+|\()(\d{5,})(?!\d)", 1)
    month = F.coalesce(
        F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), F.regexp_extract(text, _MONTH, 1)).cast("int"), F.lit(0)),
        F.regexp_extract(text, r"\bp(\d\d)\b", 1).try_cast("int"),
        F.regexp_extract(text, r"\b(\d\d)/\d{4}\b", 1).try_cast("int"),
    )
    # All words of kinds in one search; of several kinds the first of the list counts.
    place = F.create_map(*[F.lit(x) for i, words in enumerate(KINDS.values()) for w in words.split("|") for x in (w, i)])
    said = F.regexp_extract_all(text, F.lit(rf"(?<![a-z])({'|'.join(KINDS.values())})(?![a-z])"), 1)
    kind = F.get(F.array(*map(F.lit, KINDS)), F.array_min(F.transform(said, lambda w: F.element_at(place, w))))
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, _MONTH, " "), r"r&d", " "), r"[^a-z]+", " ")), " ")
    known = "|".join([*KINDS.values(), OTHER]).split("|")
    sites = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*known))
    letters = lambda w: F.array_join(F.array_sort(F.split(F.substring(w, 1, 5), "")), "")
    return legs.withColumns({"cited": F.when(cited != "", cited), "month": month, "kind": kind, "sites": F.array_sort(F.array_distinct(F.transform(sites, letters)))})


def _legs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The legs with all that the rules look at, and the table they are read from."""
    amount = F.col("amount").cast("decimal(38,2)")
    # The scale of amounts on which the tolerance is one step at every size.
    size = F.abs(amount).cast("double")
    step = F.when(size <= FLAT / RATE, size / FLAT).otherwise(1 / RATE + F.log(F.greatest(size, F.lit(1.0)) / (FLAT / RATE)) / F.log(F.lit(1 + RATE)))
    legs = df.where(amount.isNotNull() & (amount != 0) & F.col("entity").isNotNull() & F.col("counterparty").isNotNull() & F.col("date").isNotNull()).select(
        "leg_id", F.when(amount > 0, F.struct("entity", "counterparty")).otherwise(F.struct(F.col("counterparty").alias("entity"), F.col("entity").alias("counterparty"))).alias("pair"),
        (amount > 0).alias("debit"), F.abs(amount).alias("amount"), F.col("date").cast("date").alias("date"), F.col("description").alias("description"),
        F.when(F.col("doc_id").isNotNull(), F.regexp_extract("doc_id", r"(\d+)$", 1)).alias("number"), F.floor(step).cast("long").alias("step"), F.array_join(F.array_sort(F.split(F.abs(amount).cast("string"), "")), "").alias("digits"),
    )
    legs = described = stored(describe(legs).drop("description"), "described")
    # A number that some leg of the other side cites makes its leg unlike others.
    calls = legs.where("cited is not null").select("pair", (~F.col("debit")).alias("debit"), F.col("cited").alias("number"), F.col("cited").alias("called")).distinct()
    # So does one of the same digits, which may be a slip, and one where others have none.
    sorted_digits = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    slips = calls.select("pair", "debit", sorted_digits("called").alias("slip")).distinct()
    legs = legs.join(calls, ["pair", "debit", "number"], "left").withColumn("_sorted", sorted_digits("number")).withColumn("unnumbered", F.col("number").isNull())
    return legs.join(slips.withColumn("_sorted", F.col("slip")), ["pair", "debit", "_sorted"], "left").drop("_sorted"), described


@dataclass(frozen=True)
class Rule:
    name: str
    amount: str  # equal, near (within the tolerance) or digits (the same digits in another order)
    days: int
    needs: str  # cited, site, kind or none: what has to agree beyond that nothing contradicts


CASCADE = (
    Rule("amount_date_site", "equal", 0, "site"),
    Rule("amount_site", "equal", DAYS, "site"),
    Rule("amount_date", "equal", 0, "none"),
    Rule("amount_window", "equal", DAYS, "none"),
    Rule("near_site", "near", DAYS, "site"),
    Rule("near_kind", "near", DAYS, "kind"),
    Rule("near_amount", "near", DAYS, "none"),
    Rule("swapped_site", "digits", DAYS, "site"),
    Rule("swapped_kind", "digits", DAYS, "kind"),
    Rule("cited", "near", DAYS, "cited"),
    Rule("amount_window_again", "equal", DAYS, "none"),
    Rule("near_site_again", "near", DAYS, "site"),
)


def _numbered(legs: DataFrame) -> DataFrame:
    """Legs with ``alike``, equal for legs that are the same to every rule, and ``nth``, their number by id among those.

    A set of over HOT such legs is cut into ranges of ids, which are numbered each for itself and offset by the ranges before.
    """
    keys = ["pair", "debit", "amount", "date", "kind", "sites", "month", "cited", "called", "slip", "unnumbered"]
    digest = stored(legs.withColumn("alike", F.md5(F.to_json(F.struct(*keys)))), "alike")
    # At most one set for each HOT rows.
    hot = stored(digest.groupBy("alike").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("alike"), "hot")
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("leg_id"))
    cold = digest.join(F.broadcast(hot), "alike", "left_anti").withColumn("nth", nth("alike").cast("long"))
    cuts = digest.join(F.broadcast(hot), "alike").groupBy("alike").agg(F.percentile_approx("leg_id", [i / SALTS for i in range(1, SALTS)]).alias("cuts"))
    salted = digest.join(F.broadcast(cuts), "alike").withColumn("salt", F.size(F.filter("cuts", lambda c: c < F.col("leg_id")))).drop("cuts")
    sizes = salted.groupBy("alike", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("alike").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("alike", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # SALTS rows for each hot set
    ranked = salted.withColumn("nth", nth("alike", "salt")).join(F.broadcast(offsets), ["alike", "salt"])
    numbered = stored(cold.unionByName(ranked.withColumn("nth", F.col("nth") + F.col("offset")).drop("salt", "offset")), "legs")
    forget(digest, hot)
    return numbered


def _sets(legs: DataFrame) -> DataFrame:
    """One row for each set of alike legs: its least id, what its legs have in common, how many they are and how many are taken."""
    common = [c for c in legs.columns if c not in ("leg_id", "nth", "alike", "number")]
    return legs.groupBy("alike").agg(F.min("leg_id").alias("set"), F.count("*").alias("n"), F.lit(0).cast("long").alias("used"), F.min_by("number", "leg_id").alias("number"), *[F.first(c).alias(c) for c in common])


def _candidates(pool: DataFrame, rule: Rule) -> DataFrame:
    a = pool.where("debit").select(*[F.col(c).alias(f"a_{c}") for c in pool.columns])
    b = pool.where("not debit").select(*[F.col(c).alias(f"b_{c}") for c in pool.columns])
    on = [F.col("a_pair") == F.col("b_pair")]
    around = lambda c: F.explode(F.array(c - 1, c, c + 1))
    if rule.days == 0:
        on.append(F.col("a_date") == F.col("b_date"))
    else:
        week = lambda c: F.floor(F.unix_date(c) / (rule.days + 1)).cast("long")
        a, b = a.withColumn("a_span", around(week(F.col("a_date")))), b.withColumn("b_span", week(F.col("b_date")))
        on.append(F.col("a_span") == F.col("b_span"))
    if rule.amount != "near":
        same = "amount" if rule.amount == "equal" else "digits"
        on.append(F.col(f"a_{same}") == F.col(f"b_{same}"))
    else:
        a, b = a.withColumn("a_near", around(F.col("a_step"))), b.withColumn("b_near", F.col("b_step"))
        on.append(F.col("a_near") == F.col("b_near"))
    off = F.abs(F.datediff("a_date", "b_date"))
    gap = F.abs(F.col("a_amount") - F.col("b_amount")).cast("double")
    allowed = F.lit(True) if rule.amount != "near" else gap <= F.greatest(F.lit(FLAT), F.least("a_amount", "b_amount").cast("double") * RATE)
    site = F.arrays_overlap("a_sites", "b_sites")
    kind = F.col("a_kind") == F.col("b_kind")
    differ = lambda x: F.coalesce(F.col(f"a_{x}") != F.col(f"b_{x}"), F.lit(False))
    cites = F.coalesce(F.col("a_cited") == F.col("b_number"), F.lit(False)) | F.coalesce(F.col("b_cited") == F.col("a_number"), F.lit(False))
    digits = lambda c: F.array_sort(F.split(c, ""))
    # Another number; one of the same digits is taken for a slip.
    other = lambda x, y: F.coalesce(digits(F.col(f"{x}_cited")) != digits(F.col(f"{y}_number")), F.lit(False))
    wrong = other("a", "b") | other("b", "a")
    against = differ("month") | differ("kind")
    needed = {"site": site, "kind": kind, "cited": cites, "none": F.lit(True)}[rule.needs]
    pairs = a.join(b, on).where((off <= rule.days) & allowed & needed & (F.lit(rule.needs == "cited") | ~against))
    agree = F.coalesce(site.cast("int"), F.lit(0)) * 2 + F.coalesce(kind.cast("int"), F.lit(0)) + F.coalesce((F.col("a_month") == F.col("b_month")).cast("int"), F.lit(0))
    ranks = [F.round(gap * 100).cast("long").alias("gap"), (-agree - cites.cast("int") * 8).alias("against"), (-agree).alias("blind"), off.alias("off"), F.least("a_set", "b_set").alias("lo"), F.greatest("a_set", "b_set").alias("hi")]
    room = [x for side in ("a", "b") for x in (F.col(f"{side}_used").alias(f"{side}_used"), (F.col(f"{side}_n") - F.col(f"{side}_used")).alias(f"{side}_open"))]
    return pairs.select(F.col("a_set").alias("a"), F.col("b_set").alias("b"), F.xxhash64("a_pair").alias("of"), *ranks, *room, cites.alias("cites"), wrong.alias("wrong"))


def _survey(pairs: DataFrame) -> tuple[int, int, int]:
    """(most, right, wrong): candidates of the pair of entities that has most, and what a rule takes first for each labelled set if nothing is said about citations."""
    first = pairs.groupBy("of", "a").agg(F.count("*").alias("n"), F.min_by(F.struct("cites", "wrong"), F.struct("gap", "blind", "off", "lo", "hi")).alias("x"))
    of = first.groupBy("of").agg(F.sum("n").alias("n"), F.count_if("x.cites").alias("right"), F.count_if("x.wrong").alias("wrong"))
    return tuple(x or 0 for x in of.agg(F.max("n"), F.sum("right"), F.sum("wrong")).first())


_SHARE = "a long, b long, a_used long, b_used long, k long"


def _in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The best pair of sets first, as the rows are sorted: as many legs as both have open are paired."""
    done: dict[int, int] = {}
    columns = ["a", "b", "a_used", "b_used", "a_open", "b_open"]
    for f in frames:
        out = []
        for a, b, a_used, b_used, a_open, b_open in zip(*[f[c].tolist() for c in columns], strict=True):
            x, y = done.get(a, 0), done.get(b, 0)
            k = min(a_open - x, b_open - y)
            if k > 0:
                done[a], done[b] = x + k, y + k
                out.append((a, b, a_used + x, b_used + y, k))
        yield pd.DataFrame(out, columns=["a", "b", "a_used", "b_used", "k"])


def _shares(pairs: DataFrame, most: int) -> DataFrame:
    """(a, b, a_used, b_used, k): pairs of sets by rank until none is left of which both have open legs; k legs of each, after those used.

    To take the best pair first, and to take all that are each other's best and repeat, comes to the same. The latter is done
    while one pair of entities has over CROWD candidates (``most`` at first); what remains is taken in order.
    """
    rank = F.struct("gap", "against", "off", "lo", "hi")
    pairs, rounds = pairs.where("not wrong"), []
    while most > CROWD:
        best = lambda x, y: pairs.groupBy(x).agg(F.min_by(y, rank).alias(y))  # noqa: B023, E731
        k = F.least("a_open", "b_open")
        chosen = stored(pairs.join(best("a", "b"), ["a", "b"]).join(best("b", "a"), ["a", "b"]).select("a", "b", "a_used", "b_used", k.alias("k")), "shares")
        rounds.append(chosen)
        left = pairs
        for x in ("a", "b"):
            left = left.join(chosen.select(x, F.col("k").alias("_k")), x, "left").withColumns({f"{x}_used": F.col(f"{x}_used") + F.coalesce("_k", F.lit(0)), f"{x}_open": F.col(f"{x}_open") - F.coalesce("_k", F.lit(0))}).drop("_k")
        rest = stored(left.where("a_open > 0 and b_open > 0"), "candidates")
        forget(pairs)
        pairs, most = rest, _survey(rest)[0]
    shares = pairs.repartition("of").sortWithinPartitions("gap", "against", "off", "lo", "hi").mapInPandas(_in_order, _SHARE)
    for r in rounds:
        shares = shares.unionAll(r)
    return shares


def match_legs(df: DataFrame, cascade: tuple[Rule, ...] = CASCADE) -> DataFrame:
    """(leg_id_a, leg_id_b, rule, confidence): each pair of legs that records one transfer; every leg in at most one pair.

    ``df`` has leg_id, entity, counterparty, doc_id, date, description and amount. A pair has opposite signs, the entities
    swapped, dates within two weeks and amounts that are equal or within the tolerance; a month or kind of charge that both
    name differently speaks against it, and so does a citation of another document. Legs without entity, counterparty, date
    or amount, and those of amount zero, are in no pair; null documents and descriptions say nothing. Ties go to the
    set of alike legs with the smaller ids, equal legs are paired one by one in the order of their ids. An empty table gives no rows; other columns are ignored.
    """
    legs, described = _legs(df)
    legs = _numbered(legs)
    forget(described)
    sets = stored(_sets(legs), "sets")
    pool, found, trials = sets, [], []
    for turn, rule in enumerate(cascade):
        pairs = stored(_candidates(pool, rule), "candidates")
        most, right, wrong = _survey(pairs)
        trials.append((rule.name, right, wrong))
        if not most:
            forget(pairs)
            continue
        found.append(stored(_shares(pairs, most).withColumn("rule", F.lit(rule.name)), "shares"))
        forget(pairs)
        if turn < len(cascade) - 1:
            taken = found[-1].select(F.explode(F.array("a", "b")).alias("set"), "k").groupBy("set").agg(F.sum("k").alias("_k"))
            rest = stored(pool.join(taken, "set", "left").withColumn("used", F.col("used") + F.coalesce("_k", F.lit(0))).drop("_k").where("used < n"), "pool")
            if pool is not sets:
                forget(pool)
            pool = rest
    # Each share by its first side's legs, the n-th of which meets the n-th of the other side's.
    members = legs.join(sets.select("alike", "set"), "alike").select("set", "nth", "leg_id")
    shared = reduce(DataFrame.unionAll, found) if found else df.sparkSession.createDataFrame([], _SHARE + ", rule string")
    one = shared.join(members, (F.col("a") == F.col("set")) & (F.col("nth") > F.col("a_used")) & (F.col("nth") <= F.col("a_used") + F.col("k")))
    one = one.select("b", (F.col("b_used") + F.col("nth") - F.col("a_used")).alias("b_nth"), "rule", F.col("leg_id").alias("one"))
    both = one.join(members, (F.col("b") == F.col("set")) & (F.col("b_nth") == F.col("nth")))
    sure = df.sparkSession.createDataFrame(precision(trials), "rule string, confidence double")
    out = both.join(F.broadcast(sure), "rule").select(F.least("one", "leg_id").alias("leg_id_a"), F.greatest("one", "leg_id").alias("leg_id_b"), "rule", "confidence")
    out = stored(out, "pairs")
    forget(legs, sets, *found)
    return out


def precision(trials: list[tuple[str, int, int]]) -> list[tuple[str, float]]:
    """(rule, confidence) of (rule, right, wrong) in the order of the cascade: the share of right cases, one right of two added.

    A rule asks for less than those before it, so it isn't given more confidence: rules that would be are taken together with
    the rule before, cases and all. A rule without cases thus never ranks above one that was tried.
    """
    pools: list[list] = []
    share = lambda p: (p[1] + 1) / (p[1] + p[2] + 2)
    for rule, right, wrong in trials:
        pools.append([[rule], right, wrong])
        while len(pools) > 1 and share(pools[-1]) > share(pools[-2]):
            rules, r, w = pools.pop()
            pools[-1] = [pools[-1][0] + rules, pools[-1][1] + r, pools[-1][2] + w]
    return [(rule, round(share(p), 4)) for p in pools for rule in p[0]]
