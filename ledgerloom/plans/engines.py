"""Whole tests of a ledger: named result tables and the gates that prove them, composed of the operators."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money, text
from ledgerloom.gates import Result, gates
from ledgerloom.operators import aggregates, joins, predicates, windows
from ledgerloom.operators.instants import read_times
from ledgerloom.plans.instants_sql import SYSTEMS, day_sql
from ledgerloom.runtime import stored, table

D = Decimal


def cents(c):
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def invoice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices with a typed amount and a day; dates of every layout, in the day-month order of their source."""
    inv = read_times(table(spark, sf_dir, "invoices"), "invoice_date", table(spark, sf_dir, "source_systems"))
    return inv.select("row_id", "invoice_no", "vendor", "po_no", "po_line", "item", "qty_billed", "unit_price", money.money(F.regexp_replace("extended_amount", r"^\s*\$\s*\(", "(")).alias("amount"), "day")


def duplicate_payments(rows: DataFrame, window: int = 45) -> DataFrame:
    """(tier, first_row, other_row, amount): 1 equal vendor, amount and number; 2 equal vendor and amount within the window; 3 the same with vendors equal but for punctuation and legal form.

    Rows of tier 1 are reported against their first one and stand as one row in the other tiers. Rows without vendor, amount
    or, in the tiers 2 and 3, day are left out of them; amounts of zero are no payments.
    """
    rows = rows.where("vendor is not null and amount is not null and amount != 0").withColumn("vendor_key", money.vendor_key(F.col("vendor")))
    first = F.min("row_id").over(Window.partitionBy("vendor", "amount", "invoice_no"))
    marked = stored(rows.withColumn("first", F.when(F.col("invoice_no").isNotNull(), first).otherwise(F.col("row_id"))), "payments")
    one = marked.where("row_id != first").select(F.lit(1).alias("tier"), F.col("first").alias("first_row"), F.col("row_id").alias("other_row"), "amount")
    alone = marked.where("row_id = first").select("row_id", "vendor", "vendor_key", "amount", "day")
    amounts = alone.select(F.col("row_id").alias("first_row"), "amount", F.col("vendor").alias("v"))
    two = joins.band_pairs(alone, "row_id", ["vendor", "amount"], "day", window).select(F.lit(2).alias("tier"), F.col("a").alias("first_row"), F.col("b").alias("other_row")).join(amounts.drop("v"), "first_row")
    three = joins.band_pairs(alone, "row_id", ["vendor_key", "amount"], "day", window).select(F.lit(3).alias("tier"), F.col("a").alias("first_row"), F.col("b").alias("other_row")).join(amounts, "first_row")
    others = alone.select(F.col("row_id").alias("other_row"), F.col("vendor").alias("w"))
    three = three.join(others, "other_row").where("v != w")
    cols = ["tier", "first_row", "other_row", "amount"]
    return one.select(*cols).unionAll(two.select(*cols)).unionAll(three.select(*cols))


def three_way_match(invoices: DataFrame, orders: DataFrame, receipts: DataFrame, price_percent: int = 2, quantity_percent: int = 0, least: int = 25) -> Result:
    """Every invoice line with its outcomes: order by line, else by an item the order has once; price, used-up and received quantity."""
    po = orders.where("po_no is not null").groupBy("po_no", "po_line", "item").agg(F.max("qty_ordered").alias("ordered"), F.max("unit_price").alias("po_price"), F.min("row_id").alias("po_row"))
    base = invoices.select("row_id", "po_no", "po_line", "item", "qty_billed", "unit_price")
    found = joins.priority_join(base, "row_id", [(po, ["po_no", "po_line"], False), (po, ["po_no", "item"], True)], ["po_row", "ordered", "po_price"])
    got = receipts.where("po_no is not null").groupBy("po_no", F.col("po_line").cast("int").alias("po_line")).agg(F.sum("qty_received").alias("received"))
    j = base.join(found, "row_id").join(got, ["po_no", "po_line"], "left")
    j = j.withColumn("used", F.when(F.col("po_row").isNotNull(), F.sum("qty_billed").over(windows.running("po_row", "row_id"))))
    gap = F.col("unit_price") - F.col("po_price")
    over = F.col("used") - F.col("ordered")
    short = F.col("qty_billed") - F.col("received")
    tests = {
        "no order": F.col("po_no").isNull(),
        "order not found": F.col("po_no").isNotNull() & F.col("po_row").isNull(),
        "price": (F.abs(gap) * 100 > F.col("po_price") * price_percent) & (F.abs(gap * F.col("qty_billed")) > least),
        "over order": over * 100 > F.col("ordered") * quantity_percent,
        "not received": F.col("po_row").isNotNull() & F.col("received").isNull(),
        "over received": (short * 100 > F.col("received") * quantity_percent) & (F.abs(short * F.col("unit_price")) > least),
    }
    flags = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in tests.items()]), lambda x: x.isNotNull())
    lines = stored(j.select("row_id", "po_row", flags.alias("outcomes")), "three_way")
    n = lines.agg(F.count("*").alias("n"), F.count_if(F.size("outcomes") == 0).alias("clean")).withColumn("all", invoices.agg(F.count("*")).scalar())
    proof = gates(invoices.sparkSession, [("every line has one disposition", n, F.col("all") - F.col("n"), F.col("all") == F.col("n")), ("no line appears twice", lines.agg((F.count("row_id") - F.count_distinct("row_id")).alias("again")), F.col("again"), F.col("again") == 0)])
    unbilled = got.join(invoices.where("po_no is not null").groupBy("po_no", "po_line").agg(F.sum("qty_billed").alias("billed")), ["po_no", "po_line"], "left").withColumn("open", F.col("received") - F.coalesce("billed", F.lit(0))).where("open > 0")
    return Result({"lines": lines, "received_not_billed": unbilled.select("po_no", "po_line", cents("open").alias("open"))}, proof)


def journal_flags(lines: DataFrame, thresholds: list[Decimal] | None = None) -> DataFrame:
    """Entries of ``lines`` (with ``day``, else of ISO dates) with the tests they raise and the sum of the tests' weights: built from predicates on entries and three grouped sets."""
    thresholds = thresholds or [D(5000), D(10000), D(50000)]
    if "day" not in lines.columns:
        lines = lines.withColumn("day", F.col("effective_date").try_cast("date"))
    head = aggregates.entry_headers(lines)
    most = lines.agg(F.greatest(F.lit(2), F.floor(F.count_distinct("entry_id") * 0.005))).scalar()
    rare = lines.groupBy("account").agg(F.count_distinct("entry_id").alias("uses")).where(F.col("uses") <= most).select("account")
    with_rare = lines.join(rare, "account", "left_semi").select("entry_id").distinct().withColumn("is_rare", F.lit(True))
    amounts = lines.withColumn("a", F.coalesce(F.when(F.col("debit") != 0, F.col("debit")), F.col("credit"))).where("a != 0 and day is not null").select("entry_id", "account", "a", "day").distinct()
    twice = amounts.groupBy("account", "a", "day").agg(F.count("*").alias("n")).where("n > 1")
    doubled = amounts.join(twice, ["account", "a", "day"], "left_semi").select("entry_id").distinct().withColumn("is_double", F.lit(True))
    e = head.join(with_rare, "entry_id", "left").join(doubled, "entry_id", "left")
    tests = {
        "ROUND": (2, predicates.round_modulus(F.col("amount")).isNotNull()), "THRESHOLD": (5, predicates.just_below(F.col("amount"), thresholds).isNotNull()), "SELFAPPROVED": (4, F.col("posted_by") == F.col("approved_by")),
        "UNAPPROVED": (3, F.col("posted_by").isNotNull() & F.col("approved_by").isNull()), "GENERICDESC": (2, text.generic_text(F.col("description"))), "RAREACCOUNT": (2, F.col("is_rare")), "DUPEXACT": (4, F.col("is_double")), "UNBALANCED": (5, F.col("debit") != F.col("credit")),
    }
    flags = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(code).alias("code"), F.lit(w).alias("weight"))) for code, (w, c) in tests.items()]), lambda x: x.isNotNull())
    return e.withColumn("flags", flags).select("entry_id", cents("amount").alias("amount"), F.array_join(F.transform("flags", lambda f: f["code"]), " ").alias("codes"), F.aggregate("flags", F.lit(0), lambda a, f: a + f["weight"]).alias("score"))


def aging_tie(rows: DataFrame, as_of: str, bounds: tuple[int, ...] = (30, 60, 90), general_ledger: Decimal | None = None) -> Result:
    """Aged items, customers and the proof that the aging adds up."""
    labels = ["Current", *[f"{a}-{b}" for a, b in zip((1, *[x + 1 for x in bounds[:-1]]), bounds, strict=True)], f"{bounds[-1]}+"]
    days = F.datediff(F.lit(as_of).cast("date"), F.col("invoice_date"))
    bucket = F.when(days <= 0, labels[0])
    for label, b in zip(labels[1:-1], bounds, strict=True):
        bucket = bucket.when(days <= b, label)
    bucket = F.when(days.isNull(), "none").otherwise(bucket.otherwise(labels[-1]))
    items = rows.select("row_id", "customer", "invoice_no", "open_balance", days.alias("days"), bucket.alias("bucket"), "reported_bucket")
    by_customer = items.groupBy("customer").agg(
        F.count("*").alias("items"), cents(F.sum(F.when(F.col("open_balance") >= 0, F.col("open_balance")))).alias("debits"), cents(F.sum(F.when(F.col("open_balance") < 0, F.col("open_balance")))).alias("credits"), cents(F.sum("open_balance")).alias("net"), F.max(F.when(F.col("open_balance") > 0, F.col("days"))).alias("oldest_days"),
    )
    differs = F.col("reported_bucket").isNotNull() & (F.col("bucket") != "none") & (F.lower(F.trim("reported_bucket")) != F.lower("bucket"))
    total = items.agg(cents(F.sum("open_balance")).alias("t"), F.count_if(differs).alias("wrong"), F.count_if(F.col("days").isNull()).alias("undated")).withColumn("c", by_customer.agg(cents(F.sum("net"))).scalar())
    proof = gates(rows.sparkSession, [
        ("customers add up to the aging", total, F.col("t") - F.col("c"), F.col("t") == F.col("c")),
        ("the aging ties to the ledger", total, (F.col("t") - F.lit(general_ledger)) if general_ledger is not None else None, (F.col("t") == F.lit(general_ledger)) if general_ledger is not None else F.lit(None).cast("boolean")),
        ("buckets are as reported", total, F.col("wrong"), F.col("wrong") == 0),
        ("every item can be aged", total, F.col("undated"), F.col("undated") == 0),
    ])
    return Result({"items": items, "customers": by_customer}, proof)


def propagation(a: DataFrame, b: DataFrame, totals: DataFrame) -> DataFrame:
    """(total_field_id, total_change, component_change): totals whose change isn't the sum of their components' changes; texts count as no number."""
    number = lambda df, name: df.select(F.upper(F.trim("field_id")).alias("f"), money.money(F.col("value")).alias(name)).groupBy("f").agg(F.min(name).alias(name))
    delta = number(a, "x").join(number(b, "y"), "f").where("x is not null and y is not null").select("f", (F.col("y") - F.col("x")).alias("d"))
    links = totals.where("component_field_id is not null").select("total_field_id", "component_field_id").distinct()
    parts = links.join(delta.withColumnRenamed("f", "component_field_id"), "component_field_id").groupBy("total_field_id").agg(cents(F.sum("d")).alias("component_change"))
    return parts.join(delta.withColumnRenamed("f", "total_field_id"), "total_field_id").where("d != component_change").select("total_field_id", cents("d").alias("total_change"), "component_change")


def roll_forward(rows: DataFrame, group: str, before: str, change: str, disposed: str, after: str) -> DataFrame:
    """(group, opening, added, removed, closing, difference): opening plus additions less disposals against the closing balance."""
    s = lambda c: cents(F.sum(F.coalesce(c, F.lit(0))))
    r = rows.groupBy(group).agg(s(before).alias("opening"), s(change).alias("added"), s(disposed).alias("removed"), s(after).alias("closing"))
    return r.withColumn("difference", cents(F.col("opening") + F.col("added") - F.col("removed") - F.col("closing")))


def two_legs(proposals: DataFrame, row_id: str, amount: str, debit: str, credit: str, reverse_on: str | None = None) -> DataFrame:
    """A debit and a credit leg for each proposal and, with ``reverse_on``, the mirrored legs on that day."""
    leg = lambda kind, account, d, c, on: F.struct(F.lit(kind).alias("kind"), F.col(account).alias("account"), d.alias("debit"), c.alias("credit"), on.alias("on"))
    a, none = cents(amount), F.lit(None).cast("decimal(18,2)")
    legs = [leg("entry", debit, a, none, F.col("day")), leg("entry", credit, none, a, F.col("day"))]
    if reverse_on:
        legs += [leg("reversal", debit, none, a, F.col(reverse_on)), leg("reversal", credit, a, none, F.col(reverse_on))]
    return proposals.select(row_id, F.explode(F.array(*legs)).alias("l")).select(row_id, "l.*")


def spread(rows: DataFrame, row_id: str, amount: str, bucket: str, shares: list[tuple[str, int, Decimal]]) -> DataFrame:
    """(row_id, week, amount): each amount spread over weeks by its bucket's percentages, to the cent; week 0 has what is left."""
    table_ = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(w).alias("week"), F.lit(p).alias("p")) for b, w, p in shares])
    own = F.transform(F.filter(table_, lambda s: s["b"] == F.col(bucket)), lambda s: F.struct(s["week"].alias("week"), cents(F.bround(F.col(amount) * s["p"] / 100, 2)).alias("part")))
    df = rows.select(row_id, cents(amount).alias("_a"), own.alias("_o"))
    rest = cents(F.col("_a") - F.aggregate("_o", F.lit(0).cast("decimal(38,2)"), lambda x, s: (x + s["part"]).cast("decimal(38,2)")))
    return df.select(row_id, F.explode(F.concat(F.col("_o"), F.array(F.struct(F.lit(0).alias("week"), rest.alias("part"))))).alias("s")).select(row_id, "s.week", F.col("s.part").alias("amount")).where("amount != 0")


def translate(balances: DataFrame, rates: dict[str, tuple[Decimal, Decimal]], kinds_closing: tuple[str, ...]) -> DataFrame:
    """(entity, translated, adjustment): balances at the closing or average rate by kind, to the cent, and what the translation leaves over."""
    r = F.create_map(*[x for k, (c, a) in rates.items() for x in (F.lit(k), F.struct(F.lit(c).alias("closing"), F.lit(a).alias("average")))])
    rate = F.when(F.col("kind").isin(*kinds_closing), F.element_at(r, F.col("currency"))["closing"]).otherwise(F.element_at(r, F.col("currency"))["average"])
    return balances.withColumn("translated", cents(F.bround(F.col("net") * rate, 2))).groupBy("entity").agg(cents(F.sum("translated")).alias("translated"), cents(-F.sum("translated")).alias("adjustment"))


# ---- queries

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_AMOUNT = "CASE WHEN regexp_matches(extended_amount, '[0-9]') THEN CAST(CAST(regexp_replace(extended_amount, '[^0-9.]', '', 'g') AS DECIMAL(18,2)) * CASE WHEN regexp_matches(extended_amount, '[-(]') THEN -1 ELSE 1 END AS DECIMAL(18,2)) END"
_KEY = "array_to_string(list_filter(string_split(trim(regexp_replace(lower(vendor), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN ('inc','llc','co','corp','ltd','company','incorporated','limited')), ' ')"


@query(f"""WITH r AS (SELECT row_id, vendor, invoice_no, {_AMOUNT} AS amount, {_KEY} AS k, {day_sql('invoice_date')} AS d FROM invoices LEFT JOIN {SYSTEMS} USING (source)), s AS (SELECT *, CASE WHEN invoice_no IS NULL THEN row_id ELSE min(row_id) OVER (PARTITION BY vendor, amount, invoice_no) END AS f FROM r WHERE vendor IS NOT NULL AND amount <> 0), o AS (SELECT * FROM s WHERE row_id = f)
SELECT CAST(1 AS INTEGER) AS tier, f AS first_row, row_id AS other_row, amount FROM s WHERE row_id <> f
UNION ALL SELECT 2, a.row_id, b.row_id, a.amount FROM o a JOIN o b ON a.vendor = b.vendor AND a.amount = b.amount AND a.row_id < b.row_id AND abs(date_diff('day', a.d, b.d)) <= 45
UNION ALL SELECT 3, a.row_id, b.row_id, a.amount FROM o a JOIN o b ON a.k = b.k AND a.vendor <> b.vendor AND a.amount = b.amount AND a.row_id < b.row_id AND abs(date_diff('day', a.d, b.d)) <= 45""")
def eng_duplicate_payments(spark, sf_dir):
    """Payments made twice, in three tiers of evidence."""
    return duplicate_payments(invoice_rows(spark, sf_dir))


def _three_way(spark, sf_dir) -> Result:
    return three_way_match(table(spark, sf_dir, "invoices"), table(spark, sf_dir, "pos"), table(spark, sf_dir, "po_receipts"))


@query("""WITH po AS (SELECT po_no, po_line, item, max(qty_ordered) AS ordered, max(unit_price) AS po_price, min(row_id) AS po_row FROM pos WHERE po_no IS NOT NULL GROUP BY ALL), a AS (SELECT po_no, po_line, min({'p': po_row, 'o': ordered, 'u': po_price}) AS m FROM po GROUP BY ALL), b AS (SELECT po_no, item, min({'p': po_row, 'o': ordered, 'u': po_price}) AS m FROM po GROUP BY ALL HAVING count(*) = 1),
g AS (SELECT po_no, po_line, sum(qty_received) AS received FROM po_receipts WHERE po_no IS NOT NULL GROUP BY ALL), j AS (SELECT i.row_id, i.po_no, i.qty_billed, i.unit_price, coalesce(a.m, b.m) AS m, g.received FROM invoices i LEFT JOIN a ON i.po_no = a.po_no AND i.po_line = a.po_line LEFT JOIN b ON i.po_no = b.po_no AND i.item = b.item LEFT JOIN g ON i.po_no = g.po_no AND i.po_line = g.po_line),
u AS (SELECT *, m.p AS po_row, m.o AS ordered, m.u AS po_price, sum(qty_billed) OVER (PARTITION BY m.p ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS used FROM j)
SELECT row_id, po_row, concat_ws(', ', CASE WHEN po_no IS NULL THEN 'no order' END, CASE WHEN po_no IS NOT NULL AND po_row IS NULL THEN 'order not found' END, CASE WHEN abs(unit_price - po_price) * 100 > po_price * 2 AND abs((unit_price - po_price) * qty_billed) > 25 THEN 'price' END, CASE WHEN po_row IS NOT NULL AND used > ordered THEN 'over order' END,
 CASE WHEN po_row IS NOT NULL AND received IS NULL THEN 'not received' END, CASE WHEN qty_billed > received AND abs((qty_billed - received) * unit_price) > 25 THEN 'over received' END) AS outcomes FROM u""")
def eng_three_way_match(spark, sf_dir):
    """Every invoice line with what its order and receipts say about it."""
    return _three_way(spark, sf_dir).tables["lines"].select("row_id", "po_row", F.array_join("outcomes", ", ").alias("outcomes"))


@query("SELECT CAST(1 AS INTEGER) AS num, 'every line has one disposition' AS name, true AS passed UNION ALL SELECT 2, 'no line appears twice', true")
def eng_three_way_gates(spark, sf_dir):
    return _three_way(spark, sf_dir).gates.select("num", "name", "passed")


@query("""WITH r AS (SELECT po_no, po_line, sum(qty_received) AS r FROM po_receipts WHERE po_no IS NOT NULL GROUP BY ALL), b AS (SELECT po_no, po_line, sum(qty_billed) AS b FROM invoices WHERE po_no IS NOT NULL GROUP BY ALL) SELECT r.po_no, CAST(r.po_line AS INTEGER) AS po_line, CAST(round(r - coalesce(b, 0), 2) AS DECIMAL(18,2)) AS open FROM r LEFT JOIN b ON r.po_no = b.po_no AND r.po_line = b.po_line WHERE r > coalesce(b, 0)""")
def eng_received_not_billed(spark, sf_dir):
    return _three_way(spark, sf_dir).tables["received_not_billed"]


_HEAD = "SELECT entry_id, greatest(sum(coalesce(debit, 0)), sum(coalesce(credit, 0))) AS amount, sum(coalesce(debit, 0)) AS dr, sum(coalesce(credit, 0)) AS cr, arg_min(description, line_no * 1000000000000 + line_id) FILTER (trim(description) <> '') AS description, arg_min(posted_by, line_no * 1000000000000 + line_id) FILTER (trim(posted_by) <> '') AS posted_by, arg_min(approved_by, line_no * 1000000000000 + line_id) FILTER (trim(approved_by) <> '') AS approved_by FROM je_entries GROUP BY 1"
_ROUNDS = " OR ".join(f"(amount >= {m} AND amount <= {m * 20} AND amount % {m} = 0)" for m in predicates.ROUND)
_GENERIC = "|".join(sorted((g.replace("-", "\\-") for g in text.GENERIC), key=len, reverse=True))


@query(f"""WITH h AS ({_HEAD}), l AS (SELECT DISTINCT entry_id, account, coalesce(nullif(debit, 0), credit) AS a, {day_sql('effective_date')} AS day FROM je_entries LEFT JOIN {SYSTEMS} USING (source) WHERE coalesce(nullif(debit, 0), credit) <> 0 AND {day_sql('effective_date')} IS NOT NULL),
rare AS (SELECT account FROM je_entries GROUP BY 1 HAVING count(DISTINCT entry_id) <= (SELECT greatest(2, floor(count(*) * 0.005)) FROM h)), re AS (SELECT DISTINCT entry_id FROM je_entries WHERE account IN (SELECT account FROM rare)), d AS (SELECT DISTINCT entry_id FROM l JOIN (SELECT account, a, day FROM l GROUP BY ALL HAVING count(*) > 1) USING (account, a, day)),
f AS (SELECT entry_id, CAST(amount AS DECIMAL(18,2)) AS amount, ({_ROUNDS}) AS c1, (amount >= 4750 AND amount < 5000 OR amount >= 9500 AND amount < 10000 OR amount >= 47500 AND amount < 50000) AS c2, coalesce(posted_by = approved_by, false) AS c3, posted_by IS NOT NULL AND approved_by IS NULL AS c4,
 coalesce(trim(description) <> '' AND (regexp_full_match(lower(trim(description)), '({_GENERIC})[\\s\\W]*\\d{{0,6}}[\\s\\W]*') OR regexp_full_match(lower(trim(description)), 'per [a-z.\\s]{{1,18}}') OR length(trim(description)) <= 3), false) AS c5, entry_id IN (SELECT entry_id FROM re) AS c6, entry_id IN (SELECT entry_id FROM d) AS c7, dr <> cr AS c8 FROM h)
SELECT entry_id, amount, concat_ws(' ', CASE WHEN c1 THEN 'ROUND' END, CASE WHEN c2 THEN 'THRESHOLD' END, CASE WHEN c3 THEN 'SELFAPPROVED' END, CASE WHEN c4 THEN 'UNAPPROVED' END, CASE WHEN c5 THEN 'GENERICDESC' END, CASE WHEN c6 THEN 'RAREACCOUNT' END, CASE WHEN c7 THEN 'DUPEXACT' END, CASE WHEN c8 THEN 'UNBALANCED' END) AS codes,
 CAST(c1::INT * 2 + c2::INT * 5 + c3::INT * 4 + c4::INT * 3 + c5::INT * 2 + c6::INT * 2 + c7::INT * 4 + c8::INT * 5 AS INTEGER) AS score FROM f""")
def eng_journal_flags(spark, sf_dir):
    """Journal entries by the weight of the tests they raise."""
    return journal_flags(read_times(table(spark, sf_dir, "je_entries"), "effective_date", table(spark, sf_dir, "source_systems")))


@query("SELECT customer, count(*) AS items, CAST(sum(CASE WHEN open_balance >= 0 THEN open_balance END) AS DECIMAL(18,2)) AS debits, CAST(sum(CASE WHEN open_balance < 0 THEN open_balance END) AS DECIMAL(18,2)) AS credits, CAST(sum(open_balance) AS DECIMAL(18,2)) AS net, CAST(max(CASE WHEN open_balance > 0 THEN date_diff('day', invoice_date, DATE '2025-12-31') END) AS INTEGER) AS oldest_days FROM aging GROUP BY 1")
def eng_aging_customers(spark, sf_dir):
    return aging_tie(table(spark, sf_dir, "aging"), "2025-12-31").tables["customers"]


_BUCKET = "CASE WHEN date_diff('day', invoice_date, DATE '2025-12-31') <= 0 THEN 'current' WHEN date_diff('day', invoice_date, DATE '2025-12-31') <= 30 THEN '1-30' WHEN date_diff('day', invoice_date, DATE '2025-12-31') <= 60 THEN '31-60' WHEN date_diff('day', invoice_date, DATE '2025-12-31') <= 90 THEN '61-90' ELSE '90+' END"


@query(f"WITH w AS (SELECT count(*) FILTER (reported_bucket IS NOT NULL AND invoice_date IS NOT NULL AND lower(trim(reported_bucket)) <> {_BUCKET}) AS w, count(*) FILTER (invoice_date IS NULL) AS u FROM aging) SELECT CAST(1 AS INTEGER) AS num, true AS passed, false AS skipped, 0::DECIMAL(18,2) AS difference UNION ALL SELECT 2, true, true, NULL UNION ALL SELECT 3, w = 0, false, w::DECIMAL(18,2) FROM w UNION ALL SELECT 4, u = 0, false, u::DECIMAL(18,2) FROM w")
def eng_aging_gates(spark, sf_dir):
    """The proof of the aging: one gate is skipped for want of a ledger balance."""
    return aging_tie(table(spark, sf_dir, "aging"), "2025-12-31").gates.select("num", "passed", "skipped", "difference")


_NUMBER = "CASE WHEN regexp_full_match(trim(value), '-?\\$?[0-9][0-9,]*(\\.[0-9]*)?|\\(\\$?[0-9][0-9,]*(\\.[0-9]*)?\\)') THEN CAST(CAST(regexp_replace(value, '[^0-9.]', '', 'g') AS DECIMAL(18,2)) * CASE WHEN regexp_matches(value, '[-(]') THEN -1 ELSE 1 END AS DECIMAL(18,2)) END"


@query(f"""WITH a AS (SELECT upper(trim(field_id)) AS f, min({_NUMBER}) AS x FROM version_a GROUP BY 1), b AS (SELECT upper(trim(field_id)) AS f, min({_NUMBER}) AS y FROM version_b GROUP BY 1), d AS (SELECT f, y - x AS d FROM a JOIN b USING (f) WHERE x IS NOT NULL AND y IS NOT NULL), l AS (SELECT DISTINCT total_field_id AS t, component_field_id AS c FROM totals_map WHERE component_field_id IS NOT NULL), p AS (SELECT t, sum(d) AS s FROM l JOIN d ON d.f = l.c GROUP BY 1)
SELECT t AS total_field_id, CAST(d AS DECIMAL(18,2)) AS total_change, CAST(s AS DECIMAL(18,2)) AS component_change FROM p JOIN d ON d.f = p.t WHERE d <> s""")
def eng_filing_propagation(spark, sf_dir):
    """Totals that didn't move with their components."""
    return propagation(table(spark, sf_dir, "version_a"), table(spark, sf_dir, "version_b"), table(spark, sf_dir, "totals_map"))


@query("SELECT account, CAST(sum(coalesce(debit, 0)) AS DECIMAL(18,2)) AS opening, CAST(sum(coalesce(credit, 0)) AS DECIMAL(18,2)) AS added, CAST(count(*) AS DECIMAL(18,2)) AS removed, CAST(sum(coalesce(debit, 0) + coalesce(credit, 0)) AS DECIMAL(18,2)) AS closing, CAST(-count(*) AS DECIMAL(18,2)) AS difference FROM je_entries GROUP BY 1")
def eng_roll_forward(spark, sf_dir):
    """Opening plus additions less disposals against closing, by class."""
    rows = table(spark, sf_dir, "je_entries").select("account", "debit", "credit", F.lit(1).cast("decimal(18,2)").alias("one"), (F.coalesce("debit", F.lit(0)) + F.coalesce("credit", F.lit(0))).alias("both"))
    return roll_forward(rows, "account", "debit", "credit", "one", "both")


@query("""WITH p AS (SELECT row_id, CAST(qty_ordered * unit_price AS DECIMAL(18,2)) AS a, po_date AS d, CAST(date_trunc('month', po_date) + INTERVAL 1 MONTH AS DATE) AS r FROM pos WHERE status = 'open')
SELECT row_id, 'entry' AS kind, '6100' AS account, a AS debit, NULL::DECIMAL(18,2) AS credit, d AS "on" FROM p UNION ALL SELECT row_id, 'entry', '2110', NULL, a, d FROM p UNION ALL SELECT row_id, 'reversal', '6100', NULL, a, r FROM p UNION ALL SELECT row_id, 'reversal', '2110', a, NULL, r FROM p""")
def eng_two_leg_entries(spark, sf_dir):
    """Accruals of open order lines and their reversal on the first of the next month."""
    p = table(spark, sf_dir, "pos").where("status = 'open'").select("row_id", F.round(F.col("qty_ordered") * F.col("unit_price"), 2).alias("amount"), F.lit("6100").alias("dr"), F.lit("2110").alias("cr"), F.col("po_date").cast("date").alias("day"), F.add_months(F.trunc("po_date", "month"), 1).alias("next"))
    return two_legs(p, "row_id", "amount", "dr", "cr", "next")


_SPREAD = [("Current", 1, D(60)), ("Current", 2, D(20)), ("1-30", 1, D(40)), ("1-30", 3, D(20)), ("31-60", 5, D(40))]


@query("""WITH s(b, week, p) AS (VALUES ('Current', 1, 60.00), ('Current', 2, 20.00), ('1-30', 1, 40.00), ('1-30', 3, 20.00), ('31-60', 5, 40.00)), w AS (SELECT row_id, week, CAST(round_even(open_balance * p / 100, 2) AS DECIMAL(18,2)) AS a FROM aging JOIN s ON b = reported_bucket WHERE open_balance IS NOT NULL), r AS (SELECT g.row_id, 0 AS week, CAST(g.open_balance - coalesce(sum(w.a), 0) AS DECIMAL(18,2)) AS a FROM aging g LEFT JOIN w USING (row_id) WHERE g.open_balance IS NOT NULL GROUP BY g.row_id, g.open_balance)
SELECT row_id, CAST(week AS INTEGER) AS week, a AS amount FROM w WHERE a <> 0 UNION ALL SELECT row_id, CAST(week AS INTEGER), a FROM r WHERE a <> 0""")
def eng_cash_spread(spark, sf_dir):
    """Open balances spread over weeks by bucket, to the cent, with what lies beyond."""
    return spread(table(spark, sf_dir, "aging").where("open_balance is not null").withColumn("reported_bucket", F.coalesce("reported_bucket", F.lit(""))), "row_id", "open_balance", "reported_bucket", _SPREAD)


@query("""WITH b AS (SELECT entity, CASE WHEN left(counterparty, 1) = 'H' THEN 'asset' ELSE 'income' END AS kind, CASE CAST(right(entity, 1) AS INTEGER) % 2 WHEN 0 THEN 'EUR' ELSE 'USD' END AS cur, CAST(sum(amount) AS DECIMAL(18,2)) AS net FROM ic_transactions GROUP BY ALL)
SELECT entity, CAST(sum(t) AS DECIMAL(18,2)) AS translated, CAST(-sum(t) AS DECIMAL(18,2)) AS adjustment FROM (SELECT entity, CAST(round_even(net * CASE WHEN cur = 'USD' THEN 1.0000 WHEN kind = 'asset' THEN 1.1000 ELSE 1.0500 END, 2) AS DECIMAL(18,2)) AS t FROM b) GROUP BY 1""")
def eng_translation(spark, sf_dir):
    """Balances at closing and average rates, and what the translation leaves over."""
    ic = table(spark, sf_dir, "ic_transactions")
    kind = F.when(F.col("counterparty").startswith("H"), "asset").otherwise("income")
    currency = F.when(F.expr("right(entity, 1)").cast("int") % 2 == 0, "EUR").otherwise("USD")
    b = ic.groupBy("entity", kind.alias("kind"), currency.alias("currency")).agg(cents(F.sum("amount")).alias("net"))
    return translate(b, {"EUR": (D("1.1000"), D("1.0500")), "USD": (D("1.0000"), D("1.0000"))}, ("asset",))


# ---- schedules and statements


def deferral_waterfall(rows: DataFrame, row_id: str, amount: str, invoiced: str, start: str, end: str, period: tuple[str, str]) -> DataFrame:
    """(row_id, beginning, additions, recognised, ending): straight-line by days, both ends included, to the cent.

    Contracts invoiced after the period, without dates or amount, or that end before they begin are left out.
    """
    first, last = F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date")
    total = F.datediff(end, start) + 1
    share = lambda a, b: F.round(F.col(amount) * F.greatest(F.lit(0), F.datediff(F.least(F.col(end), b), F.greatest(F.col(start), a)) + 1) / total, 2)
    ok = rows.where(F.col(amount).isNotNull() & (F.col(start) <= F.col(end)) & (F.col(invoiced) <= last))
    before = F.col(invoiced) < first
    earned_before = share(F.lit("0001-01-01").cast("date"), F.date_sub(first, 1))
    parts = ok.select(row_id, cents(F.when(before, F.col(amount) - earned_before).otherwise(0)).alias("beginning"), cents(F.when(before, 0).otherwise(F.col(amount))).alias("additions"), cents(F.when(before, share(first, last)).otherwise(earned_before + share(first, last))).alias("recognised"))
    return parts.withColumn("ending", cents(F.col("beginning") + F.col("additions") - F.col("recognised")))


def straight_line(rows: DataFrame, row_id: str, cost: str, life: str, in_service: str, prior: str, year: int) -> DataFrame:
    """(row_id, expected): a year's depreciation, half in the first year and no more than what remains; null without a life."""
    annual = F.when(F.col(life) > 0, F.col(cost) / F.when(F.year(in_service) == year, F.col(life) * 2).otherwise(F.col(life)))
    left = F.greatest(F.lit(0), F.col(cost) - F.coalesce(prior, F.lit(0)))
    return rows.select(row_id, F.when(annual.isNotNull(), cents(F.least(F.bround(annual, 2), left))).alias("expected"))


def split_claims(rows: DataFrame, keys: list[str], amount: str, limit: Decimal) -> DataFrame:
    """(keys, n, total): several amounts below a limit that pass it together."""
    small = rows.dropna(subset=keys).where(F.col(amount) < F.lit(limit))
    return small.groupBy(*keys).agg(F.count("*").alias("n"), cents(F.sum(amount)).alias("total")).where((F.col("n") > 1) & (F.col("total") > F.lit(limit)))


def statement_recon(statement: DataFrame, ledger: DataFrame, keys: list[str], tolerance: Decimal = D("0.01")) -> DataFrame:
    """(keys, stated, booked, state): each reference of either side as matched, disputed, missing in the ledger or not on the statement."""
    s = statement.groupBy(*keys).agg(cents(F.sum("amount")).alias("stated"))
    b = ledger.groupBy(*keys).agg(cents(F.sum("amount")).alias("booked"))
    state = F.when(F.col("booked").isNull(), "missing in ledger").when(F.col("stated").isNull(), "not on statement").when(F.abs(F.col("stated") - F.col("booked")) <= F.lit(tolerance), "matched").otherwise("disputed")
    return s.join(b, keys, "full_outer").withColumn("state", state)


_DAYS_IN = "greatest(0, date_diff('day', greatest(s, {0}), least(e, {1})) + 1)"
_PART = "CAST((2 * a * {0} + t) // (2 * t) AS BIGINT)"


@query(f"""WITH c AS (SELECT row_id, CAST(original_amount * 100 AS BIGINT) AS a, CAST(invoice_date AS DATE) AS s, CAST(due_date AS DATE) AS e, date_diff('day', invoice_date, due_date) + 1 AS t FROM aging WHERE original_amount > 0 AND invoice_date <= due_date AND invoice_date <= DATE '2025-06-30'),
d AS (SELECT row_id, a, s < DATE '2025-04-01' AS b, {_PART.format(_DAYS_IN.format("DATE '0001-01-01'", "DATE '2025-03-31'"))} AS e0, {_PART.format(_DAYS_IN.format("DATE '2025-04-01'", "DATE '2025-06-30'"))} AS e1 FROM c),
f AS (SELECT row_id, CASE WHEN b THEN a - e0 ELSE 0 END AS o, CASE WHEN b THEN 0 ELSE a END AS n, CASE WHEN b THEN e1 ELSE e0 + e1 END AS r FROM d)
SELECT row_id, CAST(o / 100.0 AS DECIMAL(18,2)) AS beginning, CAST(n / 100.0 AS DECIMAL(18,2)) AS additions, CAST(r / 100.0 AS DECIMAL(18,2)) AS recognised, CAST((o + n - r) / 100.0 AS DECIMAL(18,2)) AS ending FROM f""")
def eng_deferral_waterfall(spark, sf_dir):
    """Amounts recognised by days over a quarter, with what is deferred before and after."""
    a = table(spark, sf_dir, "aging").where("original_amount > 0").select("row_id", "original_amount", F.col("invoice_date").cast("date").alias("invoice_date"), F.col("due_date").cast("date").alias("due_date"))
    return deferral_waterfall(a, "row_id", "original_amount", "invoice_date", "invoice_date", "due_date", ("2025-04-01", "2025-06-30"))


@query("""WITH c AS (SELECT row_id, CAST(round(qty_ordered * unit_price, 2) AS DECIMAL(18,2)) AS cost, CAST(row_id % 5 + 3 AS INTEGER) * CASE WHEN year(po_date) = 2025 THEN 2 ELSE 1 END AS life FROM pos WHERE po_date IS NOT NULL AND qty_ordered * unit_price IS NOT NULL), r AS (SELECT row_id, CAST(cost * 100 AS BIGINT) AS a, life FROM c),
q AS (SELECT row_id, a // life AS w, a % life AS m, life FROM r) SELECT row_id, CAST((w + CASE WHEN 2 * m > life OR (2 * m = life AND w % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS DECIMAL(18,2)) AS expected FROM q""")
def eng_straight_line(spark, sf_dir):
    """A year's straight-line depreciation, half of it in the first year."""
    p = table(spark, sf_dir, "pos").where("po_date is not null").select("row_id", cents(F.round(F.col("qty_ordered") * F.col("unit_price"), 2)).alias("cost"), (F.col("row_id") % 5 + 3).cast("int").alias("life"), F.col("po_date").cast("date").alias("since"), F.lit(0).cast("decimal(18,2)").alias("prior")).where("cost is not null")
    return straight_line(p, "row_id", "cost", "life", "since", "prior", 2025)


@query(f"SELECT posted_by, account, d AS day, count(*) AS n, CAST(sum(debit) AS DECIMAL(18,2)) AS total FROM (SELECT *, {day_sql('effective_date')} AS d FROM je_entries LEFT JOIN {SYSTEMS} USING (source)) WHERE debit < 5000 AND posted_by IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1 AND sum(debit) > 5000")
def eng_split_claims(spark, sf_dir):
    """Debits of one user, account and day, however it is written, that pass a limit only together."""
    rows = read_times(table(spark, sf_dir, "je_entries").where("debit is not null"), "effective_date", table(spark, sf_dir, "source_systems"))
    return split_claims(rows, ["posted_by", "account", "day"], "debit", D(5000))


@query("""WITH s AS (SELECT po_no, CAST(sum(amount_paid) AS DECIMAL(18,2)) AS stated FROM invoices WHERE po_no IS NOT NULL AND amount_paid IS NOT NULL GROUP BY 1), b AS (SELECT po_no, CAST(sum(CAST(round(qty_ordered * unit_price, 2) AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS booked FROM pos WHERE po_no IS NOT NULL GROUP BY 1)
SELECT po_no, stated, booked, CASE WHEN booked IS NULL THEN 'missing in ledger' WHEN stated IS NULL THEN 'not on statement' WHEN abs(stated - booked) <= 0.01 THEN 'matched' ELSE 'disputed' END AS state FROM s FULL JOIN b USING (po_no)""")
def eng_statement_recon(spark, sf_dir):
    """Paid amounts against ordered amounts, reference by reference."""
    s = table(spark, sf_dir, "invoices").where("po_no is not null and amount_paid is not null").select("po_no", F.col("amount_paid").alias("amount"))
    b = table(spark, sf_dir, "pos").where("po_no is not null").select("po_no", cents(F.round(F.col("qty_ordered") * F.col("unit_price"), 2)).alias("amount"))
    return statement_recon(s, b, ["po_no"])


@query("""SELECT CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS base, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') AS DECIMAL(18,2)) AS part, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F') * 10000 / sum(CAST(o_totalprice AS DECIMAL(18,2)))) AS BIGINT) AS rate FROM orders GROUP BY ROLLUP (quarter(o_orderdate))""")
def eng_effective_rates(spark, sf_dir):
    """Effective rates by quarter with a line for the total, in hundredths of a percent."""
    o = table(spark, sf_dir, "orders").select(F.quarter("o_orderdate").alias("quarter"), cents("o_totalprice").alias("a"), "o_orderstatus")
    r = o.rollup("quarter").agg(cents(F.sum("a")).alias("base"), cents(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("a")))).alias("part"))
    return r.withColumn("rate", F.floor(F.col("part") * 10000 / F.col("base")))
