"""Joins of reconciliations, composed of equi-joins, windows and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import stored


def compare_copies(current: DataFrame, prior: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Full outer comparison: keys, current, prior, delta, percent of the prior amount, and what became of the key.

    Presence is recorded before blanks become zero. A side's rows are summed by key first, so repeated keys count in full.
    """
    c = current.groupBy(*keys).agg(F.sum(value).alias("current"), F.lit(True).alias("in_current"))
    p = prior.groupBy(*keys).agg(F.sum(value).alias("prior"), F.lit(True).alias("in_prior"))
    both = c.join(p, keys, "full_outer")
    state = F.when(F.col("in_prior").isNull(), "NEW").when(F.col("in_current").isNull(), "DISAPPEARED")
    both = both.withColumns({"current": F.coalesce("current", F.lit(0)), "prior": F.coalesce("prior", F.lit(0))}).withColumn("delta", F.col("current") - F.col("prior"))
    state = state.when(F.col("delta") == 0, "UNCHANGED").when(F.sign("current") * F.sign("prior") < 0, "SIGN FLIP").when(F.abs("current") > F.abs("prior"), "EXPANSION").otherwise("CONTRACTION")
    percent = F.bround(F.when(F.col("prior") != 0, F.col("delta") * 100 / F.abs("prior")), 2)
    return both.select(*keys, "current", "prior", "delta", percent.alias("percent"), state.alias("state"))


def priority_join(left: DataFrame, left_id: str, candidates: list[tuple[DataFrame, list[str], bool]], columns: list[str]) -> DataFrame:
    """Each left row with ``columns`` of the first candidate that has its keys, and ``rank``, the candidate's number.

    A candidate is (table, keys, unique): ``unique`` takes only keys with one row in the table; other keys give their least
    row. One left join a candidate, whose side has each key once, so that no row is multiplied. Null keys match nothing.
    """
    out, found = left.select(left_id, *dict.fromkeys(k for _, keys, _ in candidates for k in keys)), []
    for rank, (table, keys, unique) in enumerate(candidates, 1):
        picked = table.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*columns)).alias(f"_row{rank}"))
        if unique:
            picked = picked.where("_n = 1")
        out = out.join(picked.drop("_n"), keys, "left")
        found.append((rank, F.col(f"_row{rank}")))
    first = F.coalesce(*[row for _, row in found])
    rank = F.coalesce(*[F.when(row.isNotNull(), rank) for rank, row in found])
    return out.select(left_id, *[first[c].alias(c) for c in columns], rank.cast("int").alias("rank"))


def exactly_one_range(rows: DataFrame, row_id: str, value: Column, ranges: list[tuple[str, object, object]]) -> DataFrame:
    """(row_id, range, matches): the only range [low, high] that holds the value, null where none or several do."""
    hits = F.filter(F.array(*[F.struct(F.lit(n).alias("name"), (F.coalesce(value >= F.lit(lo), F.lit(lo is None)) & F.coalesce(value <= F.lit(hi), F.lit(hi is None)) & value.isNotNull()).alias("hit")) for n, lo, hi in ranges]), lambda r: r["hit"])
    return rows.select(row_id, F.when(F.size(hits) == 1, hits[0]["name"]).alias("range"), F.size(hits).alias("matches"))


def tier_split(rows: DataFrame, group: str, order: list[str], amount: str, tiers: list[tuple[object, object, object]]) -> DataFrame:
    """Each row's span of the group's running amount cut by tiers [low, high): (columns, start, tier, portion, rate); tiers count from 1."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = rows.withColumn("_end", F.sum(amount).over(w)).withColumn("start", F.col("_end") - F.col(amount))
    table = F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(lo).alias("low"), F.lit(hi).alias("high"), F.lit(rate).alias("rate")) for i, (lo, hi, rate) in enumerate(tiers, 1)])
    cut = spans.withColumn("_t", F.explode(table)).withColumn("portion", F.least("_end", F.coalesce("_t.high", "_end")) - F.greatest("start", "_t.low"))
    return cut.where("portion > 0").select(*rows.columns, "start", "_t.tier", "portion", "_t.rate")


def band_pairs(rows: DataFrame, row_id: str, keys: list[str], day: str, window: int) -> DataFrame:
    """(a, b, gap): pairs of rows with equal keys whose days are 0 to ``window`` apart, the smaller id first.

    Days fall in buckets of the window's width, so rows meet only those of their own and the next bucket, each pair once.
    Where many rows share a key and day, :func:`band_links` says the same without listing pairs. Row ids are unique.
    """
    base = rows.where(F.col(day).isNotNull()).select(row_id, *keys, F.col(day).alias("_d"), F.floor(F.unix_date(day) / (window + 1)).alias("_b"))
    a = base.withColumn("_b", F.explode(F.array("_b", F.col("_b") + 1))).select(F.col(row_id).alias("_x"), F.col("_d").alias("_dx"), "_b", *keys)
    pairs = a.join(base, [*keys, "_b"]).withColumn("gap", F.datediff("_d", "_dx"))
    # Rows of one bucket meet in both orders, those of neighbouring ones in the order of days.
    pairs = pairs.where((F.col("gap") > 0) & (F.col("gap") <= window) | (F.col("gap") == 0) & (F.col("_x") < F.col(row_id)))
    return pairs.select(F.least("_x", row_id).alias("a"), F.greatest("_x", row_id).alias("b"), "gap")


def band_links(rows: DataFrame, row_id: str, keys: list[str], day: str, window: int) -> DataFrame:
    """(row_id, links, before): how many other rows of equal keys lie within ``window`` days, and the last of those before.

    One row for each row with a link, however many rows share a key: a sort and two window frames, no pairs. Rows of one day
    follow each other by id. Rows without a day have no links.
    """
    base = rows.where(F.col(day).isNotNull()).select(row_id, *keys, F.unix_date(day).alias("_d"))
    near = Window.partitionBy(*keys).orderBy("_d").rangeBetween(-window, window)
    order = Window.partitionBy(*keys).orderBy("_d", row_id)
    before = F.when(F.col("_d") - F.lag("_d").over(order) <= window, F.lag(row_id).over(order))
    return base.dropna(subset=keys).select(row_id, (F.count("*").over(near) - 1).alias("links"), before.alias("before")).where("links > 0")


def rank_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, right_id): greedy one-to-one pairs on equal keys: the n-th row of either side by id. No key multiplies rows."""
    rank = lambda df, i: df.dropna(subset=keys).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(i))).select(i, *keys, "_n")
    return rank(left, left_id).join(rank(right, right_id), [*keys, "_n"]).select(left_id, right_id)


def two_cycles(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, forth, back): unordered pairs in which each stands to the other, with the number of rows either way."""
    n = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    return n.agg(F.sum((F.col(a) < F.col(b)).cast("long")).alias("forth"), F.sum((F.col(a) > F.col(b)).cast("long")).alias("back")).where("forth > 0 and back > 0").select(F.col("x").alias(a), F.col("y").alias(b), "forth", "back")


def containing(documents: DataFrame, doc_id: str, text: str, terms: list[tuple[str, int, str]]) -> DataFrame:
    """(request, doc_id, term): the first term of each request that a document's text holds. ``terms`` is a short list of (request, place, term)."""
    hits = F.array(*[F.struct(F.lit(r).alias("request"), F.lit(p).alias("place"), F.lit(t).alias("term"), F.contains(F.lower(text), F.lit(t.lower())).alias("hit")) for r, p, t in terms])
    found = documents.select(doc_id, F.explode(F.filter(hits, lambda h: h["hit"])).alias("h"))
    return found.groupBy("h.request", doc_id).agg(F.min_by("h.term", "h.place").alias("term"))


def overlap(a: Column, b: Column) -> Column:
    """Share of the smaller of two token sets that both have; null where one is empty."""
    return F.try_divide(F.size(F.array_intersect(a, b)), F.least(F.size(a), F.size(b)))


def checked_broadcast(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is; it is written once for the count."""
    kept = stored(df, "side")
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept


def one_range_of(rows: DataFrame, row_id: str, value: str, ranges: DataFrame) -> DataFrame:
    """(row_id, range, matches): as :func:`exactly_one_range` for a table ``ranges`` (name, low, high), null bounds open.

    The table of ranges is a policy of few rows; only where it is one is it broadcast.
    """
    hit = (F.col(value) >= F.coalesce("low", F.col(value))) & (F.col(value) <= F.coalesce("high", F.col(value)))
    found = rows.select(row_id, value).join(checked_broadcast(ranges.select("name", "low", "high"), 10_000), hit, "left")
    return found.groupBy(row_id).agg(F.when(F.count("name") == 1, F.min("name")).alias("range"), F.count("name").alias("matches"))


def gaps_and_overlaps(tiers: DataFrame) -> DataFrame:
    """(after, before, kind): places where one tier (low, high) doesn't begin where the one before ends; an open end is the last."""
    w = Window.partitionBy(F.lit(1)).orderBy("low")  # a policy of few rows
    t = tiers.select("low", F.lag("high").over(w).alias("before"), F.row_number().over(w).alias("n"))
    kind = F.when(F.col("before").isNull() | (F.col("before") > F.col("low")), "overlap").when(F.col("before") < F.col("low"), "gap")
    return t.where("n > 1").select(F.col("before").alias("after"), F.col("low").alias("before"), kind.alias("kind")).where("kind is not null")


def terms_in(documents: DataFrame, doc_id: str, text: str, terms: DataFrame) -> DataFrame:
    """(request, doc_id, term): as :func:`containing` for a table ``terms`` (request, place, term) of whole words, however many.

    Terms meet texts by their first word, so that neither side is listed against all of the other.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    asked = terms.select("request", "place", "term", words(F.col("term")).alias("_w")).where(F.size("_w") > 0).select("request", "place", "term", spaced(F.col("_w")).alias("_t"), F.col("_w")[0].alias("_first"))
    texts = documents.select(doc_id, words(F.col(text)).alias("_w")).select(doc_id, spaced(F.col("_w")).alias("_text"), F.explode(F.array_distinct("_w")).alias("_first"))
    hits = texts.join(asked, "_first").where(F.contains("_text", "_t"))
    return hits.groupBy("request", doc_id).agg(F.min_by("term", "place").alias("term"))
