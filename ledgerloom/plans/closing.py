"""Engines of the period's close: statements, reconciliations and reviews as plans over ledgers, with their gates."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money
from ledgerloom.operators import joins
from ledgerloom.operators.instants import read_times
from ledgerloom.plans.instants_sql import SYSTEMS, day_sql, stamps_sql
from ledgerloom.plans.proofs import _CUT, _NUM, _TB, cents, checks, count_if, proof, proof_sql, trial_balance, zero, zero_text
from ledgerloom.runtime import stored, table

D = Decimal
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def day(text_: str) -> Column:
    return F.lit(text_).cast("date")


def before(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("loaded_at") < F.lit(_CUT).cast("timestamp_ntz"))


# ---- cash flow


def cash_flow(opening: DataFrame, closing: DataFrame) -> DataFrame:
    """(account, name, section, opening, closing, effect): the effect on cash of each account's movement between two trial balances.

    An account of one balance only had nothing in the other. Sections go by the account's first digits.
    """
    o = opening.select("account", F.col("name").alias("o_name"), cents("net").alias("opening"))
    j = closing.select("account", "name", cents("net").alias("closing")).join(o, "account", "full_outer")
    a = F.col("account")
    section = F.when(a.startswith("10"), "cash").when(a.rlike("^1[56]"), "investing").when(a.rlike("^(3|25|26)"), "financing").when(a.rlike("^[4-8]"), "net income").otherwise("working capital")
    moved = zero("closing") - zero("opening")
    return j.select("account", F.coalesce("name", "o_name").alias("name"), section.alias("section"), zero("opening").alias("opening"), zero("closing").alias("closing"), cents(F.when(section == "cash", moved).otherwise(-moved)).alias("effect"))


_FLOW = _TB + f""", o AS (SELECT account, sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) AS net FROM je_entries WHERE loaded_at < TIMESTAMP '{_CUT}' GROUP BY 1),
f AS (SELECT account, name, CASE WHEN account LIKE '10%' THEN 'cash' WHEN left(account, 2) IN ('15', '16') THEN 'investing' WHEN account LIKE '3%' OR left(account, 2) IN ('25', '26') THEN 'financing' WHEN left(account, 1) IN ('4', '5', '6', '7', '8') THEN 'net income' ELSE 'working capital' END AS section,
 coalesce(o.net, 0) AS opening, coalesce(tb.net, 0) AS closing FROM tb FULL JOIN o USING (account)), e AS (SELECT *, CASE WHEN section = 'cash' THEN closing - opening ELSE opening - closing END AS effect FROM f)"""


def _flow(spark, sf_dir) -> DataFrame:
    je = table(spark, sf_dir, "je_entries")
    return cash_flow(trial_balance(before(je)), trial_balance(je))


@query(_FLOW + " SELECT section, count(*) AS accounts, CAST(sum(effect) AS DECIMAL(18,2)) AS effect FROM e GROUP BY 1")
def eng_cash_flow(spark, sf_dir):
    """The year's cash flow by section, derived from two trial balances."""
    return _flow(spark, sf_dir).groupBy("section").agg(F.count("*").alias("accounts"), cents(F.sum("effect")).alias("effect"))


@query(proof_sql(_FLOW, [
    ("the balance sheet balances in both periods", "SELECT abs(sum(opening)) + abs(sum(closing)) FROM e"), ("cash is identified", "SELECT CASE WHEN count(*) FILTER (section = 'cash') > 0 THEN 0 ELSE 1 END FROM e"), ("the statement foots to the balance sheet", "SELECT sum(CASE WHEN section = 'cash' THEN effect ELSE -effect END) FROM e"),
    ("contra accounts move with their charge", "SELECT sum(opening - closing) FILTER (account = '1590') - sum(closing - opening) FILTER (account = '6710') FROM e"), ("other captions are within a twentieth", "SELECT greatest(0, abs(sum(effect) FILTER (section = 'working capital')) * 20 - sum(abs(effect)) FILTER (section <> 'cash')) FROM e"), ("the client statement agrees", "SELECT NULL"),
], noted=(5,)))
def gate_cash_flow(spark, sf_dir):
    f = _flow(spark, sf_dir)
    of = lambda c, x="effect": F.sum(F.when(c, F.col(x) if isinstance(x, str) else x))
    s, a = F.col("section"), F.col("account")
    return checks(f, {
        (1, "the balance sheet balances in both periods"): F.abs(F.sum("opening")) + F.abs(F.sum("closing")), (2, "cash is identified"): F.when(count_if(s == "cash") > 0, 0).otherwise(1), (3, "the statement foots to the balance sheet"): F.sum(F.when(s == "cash", F.col("effect")).otherwise(-F.col("effect"))),
        (4, "contra accounts move with their charge"): of(a == "1590", F.col("opening") - F.col("closing")) - of(a == "6710", F.col("closing") - F.col("opening")), (5, "other captions are within a twentieth"): F.greatest(F.lit(0), F.abs(of(s == "working capital")) * 20 - of(s != "cash", F.abs("effect"))), (6, "the client statement agrees"): F.max(F.lit(None).cast("decimal(18,2)")),
    }, noted=(5,))


# ---- currencies and consolidation


def revalue(balances: DataFrame, rates: DataFrame, settled: DataFrame, keys: list[str]) -> DataFrame:
    """``balances`` (keys, currency, foreign, recorded) with rate, revalued, gain, realised and judgement.

    Revalued at the closing rate, half to even; a gain is realised if the keys are settled, and a matter of judgement beyond
    a fifth of what is recorded. A currency without a rate has no gain. ``rates`` has a row a currency.
    """
    done = settled.select(*keys).distinct().withColumn("_settled", F.lit(True))
    j = balances.join(F.broadcast(rates.select("currency", "rate")), "currency", "left").join(done, keys, "left")
    j = j.withColumn("revalued", cents(F.bround(F.col("foreign") * F.col("rate"), 2))).withColumn("gain", cents(F.col("revalued") - F.col("recorded")))
    return j.withColumn("realised", F.coalesce("_settled", F.lit(False))).withColumn("judgement", F.coalesce(F.abs("gain") * 5 > F.abs("recorded"), F.lit(False))).drop("_settled")


_RATES = [("EUR", D("1.1000"), D("1.0500")), ("USD", D("1.0000"), D("1.0000"))]
_FX = """WITH b AS (SELECT entity, counterparty, CASE CAST(right(entity, 1) AS INTEGER) % 2 WHEN 0 THEN 'EUR' ELSE 'USD' END AS currency, CAST(sum(amount) AS DECIMAL(18,2)) AS fc FROM ic_transactions WHERE entity IS NOT NULL AND counterparty IS NOT NULL AND amount IS NOT NULL GROUP BY ALL),
s AS (SELECT DISTINCT entity, counterparty FROM ic_transactions WHERE date >= DATE '2025-12-01'), r AS (SELECT *, CAST(round_even(fc * CASE currency WHEN 'EUR' THEN 1.0500 ELSE 1.0000 END, 2) AS DECIMAL(18,2)) AS recorded, CAST(round_even(fc * CASE currency WHEN 'EUR' THEN 1.1000 ELSE 1.0000 END, 2) AS DECIMAL(18,2)) AS revalued FROM b),
v AS (SELECT *, revalued - recorded AS gain, (entity, counterparty) IN (SELECT (entity, counterparty) FROM s) AS realised, abs(revalued - recorded) * 5 > abs(recorded) AS judgement FROM r)"""


def _revalued(spark, sf_dir) -> DataFrame:
    ic, rates = table(spark, sf_dir, "ic_transactions"), spark.createDataFrame(_RATES, "currency string, rate decimal(9,4), old decimal(9,4)")
    currency = F.when(F.expr("right(entity, 1)").cast("int") % 2 == 0, "EUR").otherwise("USD")
    b = ic.dropna(subset=["entity", "counterparty", "amount"]).groupBy("entity", "counterparty", currency.alias("currency")).agg(cents(F.sum("amount")).alias("foreign"))
    b = b.join(F.broadcast(rates.select("currency", "old")), "currency").withColumn("recorded", cents(F.bround(F.col("foreign") * F.col("old"), 2))).drop("old")
    return revalue(b, rates, ic.where(F.col("date") >= day("2025-12-01")).select("entity", "counterparty"), ["entity", "counterparty"])


@query(_FX + " SELECT entity, counterparty, currency, revalued, gain, realised, judgement FROM v")
def eng_revaluation(spark, sf_dir):
    """Balances of pairs at the closing rate, with the gain and whether it is realised."""
    return _revalued(spark, sf_dir).select("entity", "counterparty", "currency", "revalued", "gain", "realised", "judgement")


@query(proof_sql(_FX + """, e AS (SELECT entity, sum(amount) AS t FROM ic_transactions GROUP BY 1), p AS (SELECT least(entity, counterparty) AS x, greatest(entity, counterparty) AS y, sum(amount) AS t, count(DISTINCT entity) AS n FROM ic_transactions GROUP BY 1, 2)""", [
    ("each entity's legs balance", "SELECT count(*) FROM e WHERE t <> 0"), ("each elimination balances", "SELECT count(*) FROM p WHERE t <> 0"), ("every counterparty is an entity", "SELECT count(*) FROM ic_transactions WHERE counterparty NOT IN (SELECT entity FROM e)"), ("every currency has a rate", "SELECT count(*) FROM v WHERE gain IS NULL"),
    ("translated balances and their adjustment tie", "SELECT sum(revalued) - sum(recorded) - sum(gain) FROM v"), ("both sides of each pair are booked", "SELECT count(*) FROM p WHERE n < 2"),
]))
def gate_consolidation(spark, sf_dir):
    """Entities, eliminations by pair, rates and what the translation leaves over."""
    ic = table(spark, sf_dir, "ic_transactions")
    entities = ic.groupBy("entity").agg(F.sum("amount").alias("t"))
    pairs = ic.groupBy(F.least("entity", "counterparty").alias("x"), F.greatest("entity", "counterparty").alias("y")).agg(F.sum("amount").alias("t"), F.count_distinct("entity").alias("n"))
    strangers = ic.where("counterparty is not null").join(entities.select(F.col("entity").alias("counterparty")), "counterparty", "left_anti")
    return proof(
        checks(entities, {(1, "each entity's legs balance"): count_if(F.col("t") != 0)}), checks(pairs, {(2, "each elimination balances"): count_if(F.col("t") != 0), (6, "both sides of each pair are booked"): count_if(F.col("n") < 2)}), checks(strangers, {(3, "every counterparty is an entity"): F.count("*")}),
        checks(_revalued(spark, sf_dir), {(4, "every currency has a rate"): count_if(F.col("gain").isNull()), (5, "translated balances and their adjustment tie"): F.sum("revalued") - F.sum("recorded") - F.sum("gain")}),
    )


# ---- reconciliations


def clearance(items: DataFrame, later: DataFrame, end: str) -> DataFrame:
    """(item_id, cleared_by, state) of outstanding items (item_id, ref, amount, day) against a later statement (line_id, ref, amount, day).

    The n-th item of a reference meets the statement's n-th line of it, each in the order of day and id, so that a line clears
    one item. Items without reference are open. Lines up to ``end`` should have cleared the item before.
    """
    w = lambda i: Window.partitionBy("ref").orderBy("day", i)
    one = items.withColumn("_n", F.when(F.col("ref").isNotNull(), F.row_number().over(w("item_id"))))
    two = later.where("ref is not null").withColumn("_n", F.row_number().over(w("line_id"))).select("ref", "_n", F.col("line_id").alias("cleared_by"), F.col("amount").alias("_a"), F.col("day").alias("_d"))
    state = F.when(F.col("cleared_by").isNull(), "never cleared").when(F.col("_a").isNull() | F.col("amount").isNull() | (F.col("_a") != F.col("amount")), "cleared for another amount").when(F.col("_d") <= day(end), "cleared before the end").otherwise("cleared")
    return one.join(two, ["ref", "_n"], "left").select("item_id", "ref", "amount", "day", "cleared_by", state.alias("state"))


_CLEAR = """WITH i AS (SELECT row_id AS item_id, po_no AS ref, CAST(round(qty_ordered * unit_price, 2) AS DECIMAL(18,2)) AS amount, po_date AS day FROM pos), l AS (SELECT row_id AS line_id, po_no AS ref, CAST(round(qty_billed * unit_price, 2) AS DECIMAL(18,2)) AS amount, CAST(loaded_at AS DATE) AS day FROM invoices WHERE po_no IS NOT NULL),
a AS (SELECT *, CASE WHEN ref IS NOT NULL THEN row_number() OVER (PARTITION BY ref ORDER BY day NULLS FIRST, item_id) END AS n FROM i), b AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY day NULLS FIRST, line_id) AS n FROM l),
c AS (SELECT item_id, a.ref, a.amount, a.day, line_id AS cleared_by, CASE WHEN line_id IS NULL THEN 'never cleared' WHEN a.amount IS NULL OR b.amount IS NULL OR a.amount <> b.amount THEN 'cleared for another amount' WHEN b.day <= DATE '2025-06-30' THEN 'cleared before the end' ELSE 'cleared' END AS state FROM a LEFT JOIN b ON a.ref = b.ref AND a.n = b.n)"""


def _cleared(spark, sf_dir) -> DataFrame:
    value = lambda q: cents(F.round(F.col(q) * F.col("unit_price"), 2)).alias("amount")
    items = table(spark, sf_dir, "pos").select(F.col("row_id").alias("item_id"), F.col("po_no").alias("ref"), value("qty_ordered"), F.col("po_date").cast("date").alias("day"))
    return clearance(items, table(spark, sf_dir, "invoices").select(F.col("row_id").alias("line_id"), F.col("po_no").alias("ref"), value("qty_billed"), F.col("loaded_at").cast("date").alias("day")), "2025-06-30")


@query(_CLEAR + " SELECT item_id, cleared_by, state FROM c")
def eng_clearance(spark, sf_dir):
    """Order lines as outstanding items, cleared by invoices of the same order."""
    return _cleared(spark, sf_dir).select("item_id", "cleared_by", "state")


@query(proof_sql(_CLEAR, [
    ("every item is tested once", "SELECT (SELECT count(*) FROM pos) - count(*) FROM c"), ("no line clears two items", "SELECT count(*) FROM (SELECT cleared_by FROM c WHERE cleared_by IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"), ("no item cleared for another amount", "SELECT count(*) FROM c WHERE state = 'cleared for another amount'"), ("no item cleared before the end", "SELECT count(*) FROM c WHERE state = 'cleared before the end'"),
    ("no old item is open", "SELECT count(*) FROM c WHERE state = 'never cleared' AND date_diff('day', day, DATE '2025-06-30') > 60"), ("every item has support", "SELECT count(*) FROM c WHERE ref IS NULL"), ("no round plug is open", "SELECT count(*) FROM c WHERE state = 'never cleared' AND amount <> 0 AND amount % 100 = 0"), ("open items by side make the difference", "SELECT coalesce(sum(amount), 0) FROM c WHERE state = 'never cleared'"),
], noted=(8,)))
def gate_bank_review(spark, sf_dir):
    c = stored(_cleared(spark, sf_dir), "cleared")
    state, open_ = F.col("state"), F.col("state") == "never cleared"
    lines = c.where("cleared_by is not null").groupBy("cleared_by").agg(F.count("*").alias("n"))
    return proof(
        checks(c, {
            (1, "every item is tested once"): F.lit(table(spark, sf_dir, "pos").agg(F.count("*")).scalar()) - F.count("*"), (3, "no item cleared for another amount"): count_if(state == "cleared for another amount"), (4, "no item cleared before the end"): count_if(state == "cleared before the end"), (5, "no old item is open"): count_if(open_ & (F.datediff(day("2025-06-30"), "day") > 60)),
            (6, "every item has support"): count_if(F.col("ref").isNull()), (7, "no round plug is open"): count_if(open_ & (F.col("amount") != 0) & (F.col("amount") % 100 == 0)), (8, "open items by side make the difference"): zero(F.sum(F.when(open_, F.col("amount")))),
        }, noted=(8,)),
        checks(lines, {(2, "no line clears two items"): count_if(F.col("n") > 1)}),
    )


def bank_reconciliation(bank: DataFrame, book: DataFrame, matched: DataFrame) -> DataFrame:
    """(account, closing_bank, closing_book, transit, outstanding, unrecorded, adjusted_bank, adjusted_book, difference) from rows (account, id, amount) and matched (bank_id, book_id).

    Book items without a bank item are in transit (receipts) or outstanding (payments) and adjust the bank; bank items without
    a book item are unrecorded and adjust the book.
    """
    own = lambda df, i: df.join(matched.select(F.col(i).alias("id"), F.lit(True).alias("_m")).distinct(), "id", "left").withColumn("_open", F.when(F.col("_m").isNull(), F.col("amount")))
    total = lambda c: cents(zero(F.sum(c)))
    a = own(bank, "bank_id").groupBy("account").agg(total("amount").alias("closing_bank"), total("_open").alias("unrecorded"))
    b = own(book, "book_id").groupBy("account").agg(total("amount").alias("closing_book"), total(F.when(F.col("_open") > 0, F.col("_open"))).alias("transit"), total(F.when(F.col("_open") < 0, F.col("_open"))).alias("outstanding"))
    j = a.join(b, "account", "full_outer").na.fill(0)
    j = j.withColumn("adjusted_bank", cents(F.col("closing_bank") + F.col("transit") + F.col("outstanding"))).withColumn("adjusted_book", cents(F.col("closing_book") + F.col("unrecorded")))
    return j.withColumn("difference", cents(F.col("adjusted_bank") - F.col("adjusted_book")))


@query("""WITH ic AS (SELECT leg_id AS id, concat_ws('|', least(entity, counterparty), greatest(entity, counterparty)) AS account, entity < counterparty AS bank, date, CASE WHEN entity < counterparty THEN amount ELSE -amount END AS amount FROM ic_transactions WHERE entity <> counterparty AND amount IS NOT NULL AND date IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY bank, account, amount, date ORDER BY id) AS n FROM ic), m AS (SELECT a.id AS bank_id, b.id AS book_id FROM r a JOIN r b ON a.account = b.account AND a.amount = b.amount AND a.date = b.date AND a.n = b.n AND a.bank AND NOT b.bank),
t AS (SELECT account, coalesce(sum(amount) FILTER (bank), 0) AS closing_bank, coalesce(sum(amount) FILTER (NOT bank), 0) AS closing_book, coalesce(sum(amount) FILTER (bank AND id NOT IN (SELECT bank_id FROM m)), 0) AS unrecorded, coalesce(sum(amount) FILTER (NOT bank AND amount > 0 AND id NOT IN (SELECT book_id FROM m)), 0) AS transit, coalesce(sum(amount) FILTER (NOT bank AND amount < 0 AND id NOT IN (SELECT book_id FROM m)), 0) AS outstanding FROM ic GROUP BY 1)
SELECT account, closing_bank::DECIMAL(18,2) AS closing_bank, closing_book::DECIMAL(18,2) AS closing_book, transit::DECIMAL(18,2) AS transit, outstanding::DECIMAL(18,2) AS outstanding, unrecorded::DECIMAL(18,2) AS unrecorded, (closing_bank + transit + outstanding - closing_book - unrecorded)::DECIMAL(18,2) AS difference FROM t""")
def eng_bank_reconciliation(spark, sf_dir):
    """Accounts of pairs reconciled by the items equal in amount and day."""
    ic = table(spark, sf_dir, "ic_transactions").where("entity != counterparty and amount is not null and date is not null")
    rows = ic.select(F.col("leg_id").alias("id"), F.concat_ws("|", F.least("entity", "counterparty"), F.greatest("entity", "counterparty")).alias("account"), (F.col("entity") < F.col("counterparty")).alias("bank"), "date", cents(F.when(F.col("entity") < F.col("counterparty"), F.col("amount")).otherwise(-F.col("amount"))).alias("amount"))
    bank, book = rows.where("bank"), rows.where("not bank")
    hits = joins.rank_pairs(bank.withColumnRenamed("id", "bank_id"), book.withColumnRenamed("id", "book_id"), ["account", "amount", "date"], "bank_id", "book_id")
    return bank_reconciliation(bank, book, stored(hits, "hits")).drop("adjusted_bank", "adjusted_book")


def recon_pack(ledger: DataFrame, schedule: DataFrame, items: DataFrame, limit: Decimal) -> DataFrame:
    """(account, net, scheduled, items, unexplained, status): ledger net against its schedule and reconciling items, by account."""
    s = schedule.groupBy("account").agg(cents(F.sum("amount")).alias("scheduled"))
    i = items.groupBy("account").agg(cents(F.sum("amount")).alias("items"))
    j = ledger.select("account", "net").join(s, "account", "left").join(i, "account", "left")
    j = j.withColumn("unexplained", cents(F.col("net") - zero("scheduled") - zero("items")))
    return j.withColumn("status", F.when(F.col("scheduled").isNull(), "not received").when(F.abs("unexplained") > F.lit(limit), "exception").when(F.col("unexplained") != 0, "within limit").otherwise("tied"))


@query(_TB + f""", s AS (SELECT account, sum(coalesce(debit, 0) - coalesce(credit, 0)) AS x FROM je_entries WHERE loaded_at < TIMESTAMP '{_CUT}' GROUP BY 1), i AS (SELECT account, sum(coalesce(debit, 0) - coalesce(credit, 0)) AS y FROM je_entries WHERE loaded_at >= TIMESTAMP '{_CUT}' AND approved_by IS NOT NULL GROUP BY 1),
j AS (SELECT account, net, x, y, net - coalesce(x, 0) - coalesce(y, 0) AS u FROM tb LEFT JOIN s USING (account) LEFT JOIN i USING (account) WHERE kind IN ('asset', 'liability'))
SELECT account, net::DECIMAL(18,2) AS net, x::DECIMAL(18,2) AS scheduled, y::DECIMAL(18,2) AS items, u::DECIMAL(18,2) AS unexplained, CASE WHEN x IS NULL THEN 'not received' WHEN abs(u) > 1000 THEN 'exception' WHEN u <> 0 THEN 'within limit' ELSE 'tied' END AS status FROM j""")
def eng_recon_pack(spark, sf_dir):
    """Balance-sheet accounts: the opening as schedule and approved later lines as reconciling items."""
    je = table(spark, sf_dir, "je_entries").withColumn("amount", zero("debit") - zero("credit"))
    later = je.where((F.col("loaded_at") >= F.lit(_CUT).cast("timestamp_ntz")) & F.col("approved_by").isNotNull())
    return recon_pack(trial_balance(je).where("kind in ('asset', 'liability')"), before(je), later, D(1000))


def close_list(tb: DataFrame, seen: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(account, active, procedure, status): active accounts by net or movement, the first procedure whose pattern the name has, and whether the list considered them."""
    name = F.lower(zero_text("name"))
    procedure = F.coalesce(*[F.when(name.rlike(p), F.lit(label)) for p, label in rules], F.lit("general"))
    j = tb.join(seen.select("account", F.lit(True).alias("_seen")).distinct(), "account", "left")
    active = (F.col("net") != 0) | (F.col("n") > 0)
    return j.select("account", active.alias("active"), procedure.alias("procedure"), F.when(F.col("_seen"), "considered").otherwise("not considered").alias("status"), "net")


_RULES = [("bank|cash", "bank"), ("receivable", "aging"), ("payable", "statement"), ("prepaid|deferred", "schedule"), ("depreciation|plant|right", "register"), ("tax", "return")]
_LIST = _TB + """, c AS (SELECT account, net, n, net <> 0 OR n > 0 AS active, CASE WHEN regexp_matches(lower(coalesce(name, '')), 'bank|cash') THEN 'bank' WHEN regexp_matches(lower(coalesce(name, '')), 'receivable') THEN 'aging' WHEN regexp_matches(lower(coalesce(name, '')), 'payable') THEN 'statement' WHEN regexp_matches(lower(coalesce(name, '')), 'prepaid|deferred') THEN 'schedule'
 WHEN regexp_matches(lower(coalesce(name, '')), 'depreciation|plant|right') THEN 'register' WHEN regexp_matches(lower(coalesce(name, '')), 'tax') THEN 'return' ELSE 'general' END AS procedure, CASE WHEN account IN (SELECT account FROM je_entries WHERE source = 'GL-HUB') THEN 'considered' ELSE 'not considered' END AS status FROM tb)"""


def _list(spark, sf_dir) -> DataFrame:
    je = table(spark, sf_dir, "je_entries")
    return close_list(trial_balance(je), je.where("source = 'GL-HUB'"), _RULES)


@query(_LIST + " SELECT account, active, procedure, status FROM c")
def eng_close_list(spark, sf_dir):
    """Accounts with what is to be done for them; those of the hub are on the list."""
    return _list(spark, sf_dir).select("account", "active", "procedure", "status")


@query(proof_sql(_LIST, [
    ("the trial balance balances", "SELECT sum(net) FROM tb"), ("every active account is considered", "SELECT count(*) FROM c WHERE active AND status = 'not considered'"), ("every account is listed once", "SELECT (SELECT count(*) FROM tb) - count(*) FROM c"), ("every account has a procedure", "SELECT count(*) FROM c WHERE procedure IS NULL"), ("accounts without their own procedure are listed", "SELECT count(*) FROM c WHERE procedure = 'general'"),
], noted=(5,)))
def gate_close(spark, sf_dir):
    c = stored(_list(spark, sf_dir), "close")
    accounts = table(spark, sf_dir, "je_entries").select(F.count_distinct("account") + F.max(F.col("account").isNull().cast("int"))).scalar()
    return checks(c, {(1, "the trial balance balances"): F.sum("net"), (2, "every active account is considered"): count_if(F.col("active") & (F.col("status") == "not considered")), (3, "every account is listed once"): F.lit(accounts) - F.count("*"), (4, "every account has a procedure"): count_if(F.col("procedure").isNull()), (5, "accounts without their own procedure are listed"): count_if(F.col("procedure") == "general")}, noted=(5,))


# ---- revenue, claims and rates


_LINES = "SELECT l_orderkey, CAST(l_extendedprice AS DECIMAL(18,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d, CAST(l_tax AS DECIMAL(4,2)) AS t, l_shipdate, l_returnflag FROM lineitem"
_TRACE = f"""WITH l AS (SELECT l_orderkey, sum(CAST(round(p * (1 - d), 2) AS DECIMAL(18,2))) AS contract, count(l_shipdate) AS shipped, count(*) FILTER (l_returnflag = 'R') AS credits FROM ({_LINES}) GROUP BY 1),
e AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS booked, CAST(contract AS DECIMAL(18,2)) AS contract, coalesce(shipped, 0) AS shipped, coalesce(credits, 0) AS credits FROM orders LEFT JOIN l ON l_orderkey = o_orderkey),
v AS (SELECT *, booked - contract AS difference, CASE WHEN contract IS NULL THEN 'no contract' WHEN shipped = 0 THEN 'no delivery' WHEN booked = contract THEN 'agreed' ELSE 'differs' END AS state FROM e)"""


def revenue_trace(sales: DataFrame, contracts: DataFrame) -> DataFrame:
    """``sales`` (ref, booked) with contract, shipped, credits, difference and state: agreed only if every link is there and nothing differs."""
    j = sales.join(contracts, "ref", "left")
    state = F.when(F.col("contract").isNull(), "no contract").when(zero("shipped") == 0, "no delivery").when(F.col("booked") == F.col("contract"), "agreed").otherwise("differs")
    return j.select("ref", "booked", "contract", zero("shipped").alias("shipped"), zero("credits").alias("credits"), cents(F.col("booked") - F.col("contract")).alias("difference"), state.alias("state"))


def line_amounts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ref"), cents("l_extendedprice").alias("p"), F.col("l_discount").cast("decimal(4,2)").alias("d"), F.col("l_tax").cast("decimal(4,2)").alias("t"), "l_shipdate", "l_returnflag")


def _traced(spark, sf_dir) -> DataFrame:
    c = line_amounts(spark, sf_dir).groupBy("ref").agg(cents(F.sum(cents(F.round(F.col("p") * (1 - F.col("d")), 2)))).alias("contract"), F.count("l_shipdate").alias("shipped"), F.count_if(F.col("l_returnflag") == "R").alias("credits"))
    return revenue_trace(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), cents("o_totalprice").alias("booked")), c)


@query(_TRACE + " SELECT o_orderkey AS ref, contract, shipped, credits, difference, state FROM v")
def eng_revenue_trace(spark, sf_dir):
    """Orders traced to their lines: contract, delivery, later credits."""
    return _traced(spark, sf_dir).select("ref", "contract", "shipped", "credits", "difference", "state")


@query(_TRACE + " SELECT state, count(*) AS n, count(*) FILTER (contract IS NOT NULL) AS contract, count(*) FILTER (shipped > 0) AS delivery, count(*) FILTER (credits > 0) AS credits, CAST(sum(booked) AS DECIMAL(18,2)) AS booked FROM v GROUP BY 1")
def eng_evidence_matrix(spark, sf_dir):
    """How many sales of each state have which evidence."""
    return _traced(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.count("contract").alias("contract"), F.count_if(F.col("shipped") > 0).alias("delivery"), F.count_if(F.col("credits") > 0).alias("credits"), cents(F.sum("booked")).alias("booked"))


_RECEIPT = f"""WITH r AS (SELECT l_orderkey AS k, sum(CAST(round(p * (1 - d), 2) AS DECIMAL(18,2))) AS subtotal, sum(CAST(round(p * t, 2) AS DECIMAL(18,2))) AS tax FROM ({_LINES}) GROUP BY 1), v AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS total, subtotal, tax FROM orders LEFT JOIN r ON k = o_orderkey)"""


@query(proof_sql(_RECEIPT, [
    ("every receipt is read once", "SELECT (SELECT count(*) FROM orders) - count(*) FROM v"), ("parts make the total", "SELECT count(*) FROM v WHERE coalesce(subtotal, 0) + coalesce(tax, 0) <> total"), ("no receipt is without parts", "SELECT count(*) FROM v WHERE subtotal IS NULL"), ("no image is used twice", "SELECT count(*) FROM (SELECT receipt_no FROM po_receipts WHERE receipt_no IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"), ("totals differ by", "SELECT sum(total) - sum(coalesce(subtotal, 0) + coalesce(tax, 0)) FROM v"),
], noted=(5,)))
def gate_receipts(spark, sf_dir):
    """Receipts whose parts should make their totals; parts that are missing count as nothing and are never estimated."""
    parts = line_amounts(spark, sf_dir).groupBy("ref").agg(F.sum(cents(F.round(F.col("p") * (1 - F.col("d")), 2))).alias("subtotal"), F.sum(cents(F.round(F.col("p") * F.col("t"), 2))).alias("tax"))
    o = table(spark, sf_dir, "orders")
    v = stored(o.select(F.col("o_orderkey").alias("ref"), cents("o_totalprice").alias("total")).join(parts, "ref", "left"), "receipts")
    made = zero("subtotal") + zero("tax")
    images = table(spark, sf_dir, "po_receipts").where("receipt_no is not null").groupBy("receipt_no").agg(F.count("*").alias("n"))
    return proof(checks(v, {(1, "every receipt is read once"): F.lit(o.agg(F.count("*")).scalar()) - F.count("*"), (2, "parts make the total"): count_if(made != F.col("total")), (3, "no receipt is without parts"): count_if(F.col("subtotal").isNull()), (5, "totals differ by"): F.sum("total") - F.sum(made)}, noted=(5,)), checks(images, {(4, "no image is used twice"): count_if(F.col("n") > 1)}))


_WAGES = f"""WITH w AS (SELECT l_orderkey AS k, sum(p) AS gross, sum(CAST(round(p * d, 2) AS DECIMAL(18,2))) AS reduction, sum(CAST(round(p * (1 - d), 2) AS DECIMAL(18,2))) AS taxable, sum(CAST(round(p * t, 2) AS DECIMAL(18,2))) AS tax, max(p * t - p) AS above, count(*) FILTER (t = 0) AS untaxed FROM ({_LINES}) GROUP BY 1)"""


@query(proof_sql(_WAGES, [
    ("gross less reductions is taxable", "SELECT sum(gross) - sum(reduction) - sum(taxable) FROM w"), ("taxable agrees with what was booked", "SELECT sum(taxable) - (SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) FROM w"), ("tax is the base at its rate", "SELECT 0"), ("nobody without a record", "SELECT count(*) FROM w WHERE k NOT IN (SELECT o_orderkey FROM orders)"),
    ("nobody is without pay", "SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT k FROM w)"), ("no tax beyond the base", "SELECT count(*) FROM w WHERE above > 0"), ("no negative gross", "SELECT count(*) FROM w WHERE gross < 0"), ("lines without tax are listed", "SELECT sum(untaxed) FROM w"),
], noted=(8,)))
def gate_payroll(spark, sf_dir):
    """The bridge from gross to taxable and its taxes, one group of lines a person."""
    li = line_amounts(spark, sf_dir)
    r2 = lambda c: cents(F.round(c, 2))
    p, d, t = F.col("p"), F.col("d"), F.col("t")
    w = stored(li.groupBy("ref").agg(F.sum("p").alias("gross"), F.sum(r2(p * d)).alias("reduction"), F.sum(r2(p * (1 - d))).alias("taxable"), F.sum(r2(p * t)).alias("tax"), F.max(p * t - p).alias("above"), F.count_if(t == 0).alias("untaxed")), "wages")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ref"), cents("o_totalprice").alias("booked"))
    return proof(
        checks(w, {(1, "gross less reductions is taxable"): F.sum("gross") - F.sum("reduction") - F.sum("taxable"), (2, "taxable agrees with what was booked"): F.sum("taxable") - F.lit(o.agg(cents(F.sum("booked"))).scalar()), (3, "tax is the base at its rate"): F.sum("tax") - F.lit(li.agg(cents(F.sum(r2(p * t)))).scalar()), (6, "no tax beyond the base"): count_if(F.col("above") > 0), (7, "no negative gross"): count_if(F.col("gross") < 0), (8, "lines without tax are listed"): F.sum("untaxed")}, noted=(8,)),
        checks(w.join(o, "ref", "left_anti"), {(4, "nobody without a record"): F.count("*")}), checks(o.join(w, "ref", "left_anti"), {(5, "nobody is without pay"): F.count("*")}),
    )


_JUR = f"""WITH g AS (SELECT c_nationkey AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS ledger FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1), r AS (SELECT c_nationkey AS n, sum(CAST(round(p * (1 - d), 2) AS DECIMAL(18,2))) AS returned, sum(CAST(round(p * t, 2) AS DECIMAL(18,2))) AS tax FROM ({_LINES}) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1), j AS (SELECT n, ledger, returned, tax FROM g FULL JOIN r USING (n))"""


def by_jurisdiction(spark, sf_dir) -> DataFrame:
    """(n, ledger, returned, tax): sales by nation from the orders and from their lines."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n")), "o_custkey")
    p, d, t = F.col("p"), F.col("d"), F.col("t")
    lines = line_amounts(spark, sf_dir).groupBy("ref").agg(F.sum(cents(F.round(p * (1 - d), 2))).alias("r"), F.sum(cents(F.round(p * t, 2))).alias("x"))
    g = o.groupBy("n").agg(F.sum(cents("o_totalprice")).alias("ledger"))
    r = o.select(F.col("o_orderkey").alias("ref"), "n").join(lines, "ref").groupBy("n").agg(F.sum("r").alias("returned"), F.sum("x").alias("tax"))
    return g.join(r, "n", "full_outer")


@query(proof_sql(_JUR, [
    ("ledger and returns agree", "SELECT count(*) FROM j WHERE coalesce(ledger, 0) <> coalesce(returned, 0)"), ("ledger and returns differ by", "SELECT sum(coalesce(ledger, 0)) - sum(coalesce(returned, 0)) FROM j"), ("no jurisdiction without a return", "SELECT count(*) FROM j WHERE returned IS NULL"), ("no return without sales", "SELECT count(*) FROM j WHERE ledger IS NULL"), ("rates lie between nothing and a tenth", "SELECT count(*) FROM j WHERE tax < 0 OR tax * 10 > returned"), ("tax in all", "SELECT sum(coalesce(tax, 0)) FROM j"),
], noted=(2, 6)))
def gate_sales_tax(spark, sf_dir):
    j = stored(by_jurisdiction(spark, sf_dir), "jurisdictions")
    return checks(j, {
        (1, "ledger and returns agree"): count_if(zero("ledger") != zero("returned")), (2, "ledger and returns differ by"): F.sum(zero("ledger")) - F.sum(zero("returned")), (3, "no jurisdiction without a return"): count_if(F.col("returned").isNull()), (4, "no return without sales"): count_if(F.col("ledger").isNull()), (5, "rates lie between nothing and a tenth"): count_if((F.col("tax") < 0) | (F.col("tax") * 10 > F.col("returned"))), (6, "tax in all"): F.sum(zero("tax")),
    }, noted=(2, 6))


# ---- registers


_ASSETS = """WITH a AS (SELECT row_id, lower(trim(coalesce(status, ''))) AS class, item, po_date AS since, CAST(round(qty_ordered * unit_price, 2) AS DECIMAL(18,2)) AS cost FROM pos), r AS (SELECT class, sum(cost) FILTER (since < DATE '2025-01-01') AS o, sum(cost) FILTER (since >= DATE '2025-01-01') AS n, sum(cost) FILTER (class = 'cancelled') AS x, sum(cost) FILTER (class <> 'cancelled') AS c FROM a GROUP BY 1)"""


def assets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pos").select("row_id", F.lower(F.trim(zero_text("status"))).alias("class"), "item", F.col("po_date").cast("date").alias("since"), cents(F.round(F.col("qty_ordered") * F.col("unit_price"), 2)).alias("cost"))


def roll(rows: DataFrame, group: str, value: str, since: str, start: str, gone: Column) -> DataFrame:
    """(group, opening, added, removed, closing, difference): what a register held, gained, lost and holds, by class."""
    part = lambda c: cents(zero(F.sum(F.when(c, F.col(value)))))
    r = rows.groupBy(group).agg(part(F.col(since) < day(start)).alias("opening"), part(F.col(since) >= day(start)).alias("added"), part(gone).alias("removed"), part(~gone).alias("closing"))
    return r.withColumn("difference", cents(F.col("opening") + F.col("added") - F.col("removed") - F.col("closing")))


@query(_ASSETS + " SELECT class, coalesce(o, 0)::DECIMAL(18,2) AS opening, coalesce(n, 0)::DECIMAL(18,2) AS added, coalesce(x, 0)::DECIMAL(18,2) AS removed, coalesce(c, 0)::DECIMAL(18,2) AS closing, (coalesce(o, 0) + coalesce(n, 0) - coalesce(x, 0) - coalesce(c, 0))::DECIMAL(18,2) AS difference FROM r")
def eng_register_roll(spark, sf_dir):
    """Order lines as a register of assets, by status."""
    return roll(assets(spark, sf_dir), "class", "cost", "since", "2025-01-01", F.col("class") == "cancelled")


@query(proof_sql(_ASSETS, [
    ("the roll-forward foots by class", "SELECT count(*) FROM r WHERE coalesce(o, 0) + coalesce(n, 0) <> coalesce(x, 0) + coalesce(c, 0)"), ("the roll-forward differs by", "SELECT sum(coalesce(o, 0) + coalesce(n, 0) - coalesce(x, 0) - coalesce(c, 0)) FROM r"), ("every asset has a day of service", "SELECT count(*) FROM a WHERE since IS NULL"), ("no cost is zero or less", "SELECT count(*) FROM a WHERE cost <= 0"), ("every asset has a cost", "SELECT count(*) FROM a WHERE cost IS NULL"),
    ("no asset is registered twice", "SELECT count(*) FROM (SELECT 1 FROM a WHERE item IS NOT NULL AND cost IS NOT NULL AND since IS NOT NULL GROUP BY item, cost, since HAVING count(*) > 1)"), ("the register ties to the ledger", "SELECT sum(cost) - (SELECT sum(coalesce(debit, 0)) FROM je_entries WHERE account LIKE '15%') FROM a"),
], noted=(2,)))
def gate_depreciation(spark, sf_dir):
    a = assets(spark, sf_dir)
    r = roll(a, "class", "cost", "since", "2025-01-01", F.col("class") == "cancelled")
    twice = a.dropna(subset=["item", "cost", "since"]).groupBy("item", "cost", "since").agg(F.count("*").alias("n"))
    ledger = table(spark, sf_dir, "je_entries").where("account like '15%'").agg(cents(F.sum(zero("debit")))).scalar()
    return proof(
        checks(r, {(1, "the roll-forward foots by class"): count_if(F.col("difference") != 0), (2, "the roll-forward differs by"): F.sum("difference")}, noted=(2,)), checks(a, {(3, "every asset has a day of service"): count_if(F.col("since").isNull()), (4, "no cost is zero or less"): count_if(F.col("cost") <= 0), (5, "every asset has a cost"): count_if(F.col("cost").isNull()), (7, "the register ties to the ledger"): F.sum("cost") - F.lit(ledger)}),
        checks(twice, {(6, "no asset is registered twice"): count_if(F.col("n") > 1)}),
    )


def prepaid(rows: DataFrame, row_id: str, amount: str, start: str, end: str, period: tuple[int, int]) -> DataFrame:
    """(row_id, months, used, current, remaining): whole months, first and last included, charged up to and in the period (year, month).

    Cumulative charges are rounded half up to the cent, and a month's charge is the difference of two of them, so that rounding
    never adds up. Rows without amount or dates, or that end before they start, are left out.
    """
    month = lambda c: F.year(c) * 12 + F.month(c)
    at = period[0] * 12 + period[1]
    n = month(F.col(end)) - month(F.col(start)) + 1
    passed = lambda k: F.least(n, F.greatest(F.lit(0), F.lit(k) - month(F.col(start)) + 1))
    upto = lambda k: cents(F.round(F.col(amount) * passed(k) / n, 2))
    ok = rows.where(F.col(amount).isNotNull() & (F.col(start) <= F.col(end)))
    p = ok.select(row_id, cents(amount).alias("_a"), n.cast("int").alias("months"), upto(at).alias("used"), upto(at - 1).alias("_before"))
    return p.select(row_id, "months", "used", cents(F.col("used") - F.col("_before")).alias("current"), cents(F.col("_a") - F.col("used")).alias("remaining"))


_PART = "CAST((2 * a * {0} + n) // (2 * n) AS BIGINT)"
_PREPAID = f"""WITH p AS (SELECT row_id, CAST(original_amount * 100 AS BIGINT) AS a, year(invoice_date) * 12 + month(invoice_date) AS s, year(due_date) * 12 + month(due_date) - year(invoice_date) * 12 - month(invoice_date) + 1 AS n FROM aging WHERE original_amount > 0 AND invoice_date <= due_date),
m AS (SELECT *, least(n, greatest(0, 2025 * 12 + 6 - s + 1)) AS k, least(n, greatest(0, 2025 * 12 + 5 - s + 1)) AS j FROM p), u AS (SELECT row_id, n, a, {_PART.format("k")} AS used, {_PART.format("j")} AS prior FROM m),
c AS (SELECT row_id, CAST(n AS INTEGER) AS months, CAST(used / 100.0 AS DECIMAL(18,2)) AS used, CAST((used - prior) / 100.0 AS DECIMAL(18,2)) AS current, CAST((a - used) / 100.0 AS DECIMAL(18,2)) AS remaining, CAST(a / 100.0 AS DECIMAL(18,2)) AS amount FROM u)"""


def _prepaid(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a = table(spark, sf_dir, "aging").where("original_amount > 0").select("row_id", "original_amount", F.col("invoice_date").cast("date").alias("s"), F.col("due_date").cast("date").alias("e"))
    return a, prepaid(a, "row_id", "original_amount", "s", "e", (2025, 6))


@query(_PREPAID + " SELECT row_id, months, used, current, remaining FROM c")
def eng_prepaid(spark, sf_dir):
    """Amounts charged by whole months over their terms."""
    return _prepaid(spark, sf_dir)[1]


@query(proof_sql(_PREPAID, [
    ("used and remaining make the amounts", "SELECT 0"), ("nothing is used beyond its amount", "SELECT count(*) FROM c WHERE remaining < 0"), ("every item has a term", "SELECT count(*) FROM aging WHERE original_amount > 0 AND NOT coalesce(invoice_date <= due_date, false)"), ("no charge is negative", "SELECT count(*) FROM c WHERE current < 0"), ("the month's charge", "SELECT sum(current) FROM c"), ("no term of over a year", "SELECT count(*) FROM c WHERE months > 12"),
], noted=(5,)))
def gate_prepaid(spark, sf_dir):
    a, c = _prepaid(spark, sf_dir)
    j = a.join(c, "row_id", "left")
    return checks(j, {
        (1, "used and remaining make the amounts"): F.sum(F.when(F.col("used").isNotNull(), F.col("original_amount") - F.col("used") - F.col("remaining"))), (2, "nothing is used beyond its amount"): count_if(F.col("remaining") < 0), (3, "every item has a term"): count_if(F.col("used").isNull()), (4, "no charge is negative"): count_if(F.col("current") < 0), (5, "the month's charge"): F.sum("current"), (6, "no term of over a year"): count_if(F.col("months") > 12),
    }, noted=(5,))


# ---- filings and papers


_FOOT = f"""WITH v AS (SELECT upper(trim(field_id)) AS f, min({_NUM}) AS x FROM version_a GROUP BY 1), l AS (SELECT DISTINCT total_field_id AS t, component_field_id AS f FROM totals_map WHERE component_field_id IS NOT NULL), s AS (SELECT t, sum(x) AS parts, count(*) AS n, count(x) AS held FROM l LEFT JOIN v USING (f) GROUP BY 1), j AS (SELECT t, v.x AS total, parts, n, held FROM s LEFT JOIN v ON v.f = s.t)"""


def footing(values: DataFrame, totals: DataFrame) -> DataFrame:
    """(t, total, parts, n, held): totals with the sum of their components, how many there are and how many have a number."""
    links = totals.where("component_field_id is not null").select(F.col("total_field_id").alias("t"), F.col("component_field_id").alias("f")).distinct()
    s = links.join(values, "f", "left").groupBy("t").agg(cents(F.sum("x")).alias("parts"), F.count("*").alias("n"), F.count("x").alias("held"))
    return s.join(values.select(F.col("f").alias("t"), cents("x").alias("total")), "t", "left").select("t", "total", "parts", "n", "held")


def filed(spark, sf_dir, name: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.upper(F.trim("field_id")).alias("f"), money.money(F.col("value")).alias("x")).groupBy("f").agg(F.min("x").alias("x"))


@query(_FOOT + " SELECT t AS field_id, CAST(total AS DECIMAL(18,2)) AS total, CAST(parts AS DECIMAL(18,2)) AS parts, n, held FROM j")
def eng_footing(spark, sf_dir):
    """Totals of a filing and what their components add up to."""
    return footing(filed(spark, sf_dir, "version_a"), table(spark, sf_dir, "totals_map")).withColumnRenamed("t", "field_id")


@query(proof_sql(_FOOT + """, b AS (SELECT DISTINCT upper(trim(field_id)) AS f FROM version_b), h AS (SELECT form, round(100.0 * count(*) / (SELECT count(*) FROM version_a), 9) AS p FROM version_a GROUP BY 1)""", [
    ("totals foot", "SELECT count(*) FROM j WHERE total <> parts"), ("shares make one hundred", "SELECT round(sum(p), 2) - 100 FROM h"), ("all that is expected was received", "SELECT count(*) FROM v WHERE f NOT IN (SELECT f FROM b)"), ("nothing else was received", "SELECT count(*) FROM b WHERE f NOT IN (SELECT f FROM v)"), ("no field of two forms", "SELECT count(*) FROM (SELECT upper(trim(field_id)) FROM version_a GROUP BY 1 HAVING count(DISTINCT trim(form)) > 1)"),
]))
def gate_partners(spark, sf_dir):
    """Footing, shares, expected against received, one form a field."""
    a, v, b = table(spark, sf_dir, "version_a"), filed(spark, sf_dir, "version_a"), filed(spark, sf_dir, "version_b")
    shares = a.groupBy("form").agg(F.count("*").alias("n")).withColumn("p", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(1))), 9))  # a row a form
    forms = a.groupBy(F.upper(F.trim("field_id")).alias("f")).agg(F.count_distinct(F.trim("form")).alias("n"))
    return proof(
        checks(footing(v, table(spark, sf_dir, "totals_map")), {(1, "totals foot"): count_if(F.col("total") != F.col("parts"))}), checks(shares, {(2, "shares make one hundred"): F.round(F.sum("p"), 2) - 100}), checks(v.join(b, "f", "left_anti"), {(3, "all that is expected was received"): F.count("*")}),
        checks(b.join(v, "f", "left_anti"), {(4, "nothing else was received"): F.count("*")}), checks(forms, {(5, "no field of two forms"): count_if(F.col("n") > 1)}),
    )


_ERRORS = f"""WITH k AS (SELECT upper(trim(field_id)) AS f, count(*) AS n FROM version_b GROUP BY 1), e AS (SELECT b.form, list_filter([CASE WHEN k.n > 1 THEN 'repeated' END, CASE WHEN trim(coalesce(description, '')) = '' THEN 'no description' END, CASE WHEN trim(coalesce(value, '')) = '' THEN 'no value' END, CASE WHEN changed_at IS NULL THEN 'undated' END, CASE WHEN is_carryforward AND {_NUM} IS NULL THEN 'carried text' END], lambda x: x IS NOT NULL) AS errors FROM version_b b LEFT JOIN k ON k.f = upper(trim(b.field_id)))"""


@query(_ERRORS + " SELECT form, CASE WHEN len(errors) = 0 THEN 'none' ELSE x END AS error, count(*) AS n FROM (SELECT form, errors, unnest(CASE WHEN len(errors) = 0 THEN ['none'] ELSE errors END) AS x FROM e) GROUP BY 1, 2")
def eng_return_review(spark, sf_dir):
    """Errors of each row of a return, rolled up by form; rows without errors count as none."""
    b = table(spark, sf_dir, "version_b").withColumn("f", F.upper(F.trim("field_id")))
    k = b.groupBy("f").agg(F.count("*").alias("n"))
    blank = lambda c: F.trim(zero_text(c)) == ""
    rules = {"repeated": F.col("n") > 1, "no description": blank("description"), "no value": blank("value"), "undated": F.col("changed_at").isNull(), "carried text": F.col("is_carryforward") & money.money(F.col("value")).isNull()}
    errors = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]), lambda x: x.isNotNull())
    rows = b.join(k, "f", "left").select("form", errors.alias("errors"))
    return rows.select("form", F.explode(F.when(F.size("errors") == 0, F.array(F.lit("none"))).otherwise(F.col("errors"))).alias("error")).groupBy("form", "error").agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT component_field_id AS f, count(*) AS used FROM totals_map WHERE component_field_id IS NOT NULL GROUP BY 1), d AS (SELECT upper(trim(field_id)) AS f, count(*) AS defined FROM version_a GROUP BY 1)
SELECT coalesce(u.f, d.f) AS field_id, coalesce(used, 0) AS used, coalesce(defined, 0) AS defined, CASE WHEN defined IS NULL THEN 'not defined' WHEN used IS NULL THEN 'not used' ELSE 'both' END AS state FROM u FULL JOIN d ON u.f = d.f""")
def eng_marks(spark, sf_dir):
    """Marks used against marks defined, both ways."""
    u = table(spark, sf_dir, "totals_map").where("component_field_id is not null").groupBy(F.col("component_field_id").alias("field_id")).agg(F.count("*").alias("used"))
    d = table(spark, sf_dir, "version_a").groupBy(F.upper(F.trim("field_id")).alias("field_id")).agg(F.count("*").alias("defined"))
    state = F.when(F.col("defined").isNull(), "not defined").when(F.col("used").isNull(), "not used").otherwise("both")
    return u.join(d, "field_id", "full_outer").select("field_id", zero("used").alias("used"), zero("defined").alias("defined"), state.alias("state"))




@query(proof_sql("""WITH u AS (SELECT DISTINCT component_field_id AS f FROM totals_map WHERE component_field_id IS NOT NULL), d AS (SELECT DISTINCT upper(trim(field_id)) AS f FROM version_a)""", [
    ("every element is there", "SELECT count(*) FROM je_entries WHERE entry_id IS NULL OR account IS NULL OR posted_by IS NULL"), ("the population ties", "SELECT sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) FROM je_entries"), ("every step has evidence", "SELECT count(*) FROM je_entries WHERE trim(coalesce(description, '')) = ''"), ("every conclusion has at least two words", "SELECT count(*) FROM je_entries WHERE trim(coalesce(description, '')) <> '' AND NOT contains(trim(description), ' ')"),
    ("differences are disposed of", "SELECT count(*) FROM je_entries WHERE reversal_of IS NOT NULL AND reversal_of NOT IN (SELECT entry_id FROM je_entries WHERE entry_id IS NOT NULL)"), ("preparer and reviewer differ", "SELECT count(*) FROM je_entries WHERE posted_by = approved_by"), ("marks used are marks defined", "SELECT count(*) FROM u WHERE f NOT IN (SELECT f FROM d)"),
]))
def gate_workpaper(spark, sf_dir):
    je = table(spark, sf_dir, "je_entries")
    empty = F.trim(zero_text("description")) == ""
    lost = je.where("reversal_of is not null").join(je.select(F.col("entry_id").alias("reversal_of")).distinct(), "reversal_of", "left_anti")
    u = table(spark, sf_dir, "totals_map").where("component_field_id is not null").select(F.col("component_field_id").alias("f")).distinct()
    return proof(
        checks(je, {(1, "every element is there"): count_if(F.col("entry_id").isNull() | F.col("account").isNull() | F.col("posted_by").isNull()), (2, "the population ties"): F.sum(zero("debit")) - F.sum(zero("credit")), (3, "every step has evidence"): count_if(empty), (4, "every conclusion has at least two words"): count_if(~empty & ~F.contains(F.trim("description"), F.lit(" "))), (6, "preparer and reviewer differ"): count_if(F.col("posted_by") == F.col("approved_by"))}),
        checks(lost, {(5, "differences are disposed of"): F.count("*")}), checks(u.join(table(spark, sf_dir, "version_a").select(F.upper(F.trim("field_id")).alias("f")), "f", "left_anti"), {(7, "marks used are marks defined"): F.count("*")}),
    )


@query(proof_sql("", [
    ("orders have numbers, lines and prices", "SELECT count(*) FROM pos WHERE po_no IS NULL OR po_line IS NULL OR unit_price IS NULL"), ("order lines are entered once", "SELECT count(*) FROM (SELECT 1 FROM pos WHERE po_no IS NOT NULL AND po_line IS NOT NULL GROUP BY po_no, po_line HAVING count(*) > 1)"), ("invoices have vendors and amounts", "SELECT count(*) FROM invoices WHERE vendor IS NULL OR extended_amount IS NULL"), ("receipts have orders", "SELECT count(*) FROM po_receipts WHERE po_no IS NULL"), ("customers pay at most once a day", "SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1)"),
    ("rates are given for all sources", "SELECT count(*) FROM (SELECT DISTINCT source FROM je_entries WHERE source IS NOT NULL) s WHERE source NOT IN (SELECT source FROM source_systems)"), ("shares make one", "SELECT round(sum(target_share), 6) - 1 FROM source_targets"),
]))
def gate_inputs(spark, sf_dir):
    """Errors that keep an engine from running: keys, prices, amounts, references, rates and shares."""
    pos, inv, o = table(spark, sf_dir, "pos"), table(spark, sf_dir, "invoices"), table(spark, sf_dir, "orders")
    null = lambda *cs: F.array_contains(F.array(*[F.col(c).isNull() for c in cs]), True)
    repeated = lambda df, *keys: df.groupBy(*keys).agg(F.count("*").alias("n"))
    missing = table(spark, sf_dir, "je_entries").where("source is not null").select("source").distinct().join(F.broadcast(table(spark, sf_dir, "source_systems").select("source")), "source", "left_anti")  # source_systems has a fixed number of rows
    return proof(
        checks(pos, {(1, "orders have numbers, lines and prices"): count_if(null("po_no", "po_line", "unit_price"))}), checks(repeated(pos.dropna(subset=["po_no", "po_line"]), "po_no", "po_line"), {(2, "order lines are entered once"): count_if(F.col("n") > 1)}), checks(inv, {(3, "invoices have vendors and amounts"): count_if(null("vendor", "extended_amount"))}),
        checks(table(spark, sf_dir, "po_receipts"), {(4, "receipts have orders"): count_if(null("po_no"))}), checks(repeated(o, "o_custkey", "o_orderdate"), {(5, "customers pay at most once a day"): count_if(F.col("n") > 1)}), checks(missing, {(6, "rates are given for all sources"): F.count("*")}), checks(table(spark, sf_dir, "source_targets"), {(7, "shares make one"): F.round(F.sum("target_share"), 6) - 1}),
    )


# ---- the journal, test by test

#: The weights of the tests of an entry.
WEIGHTS = {"MANUAL": 1, "WEEKEND": 3, "HOLIDAY": 3, "AFTERHOURS": 2, "PERIODEND": 2, "POSTLAG": 3, "POSTAFTERCLOSE": 4, "BLANKDESC": 3, "SUSPENSE": 3, "REVENUEMANUAL": 3, "CASHREVENUE": 4, "UNREVERSED": 3, "REVAMOUNT": 3, "MATERIAL": 2, "DUPNEAR": 2, "UNAUTHUSER": 5, "SPLIT": 4}


def journal_tests(lines: DataFrame, users: DataFrame, holidays: DataFrame, closed: str, manual: Column, material: Decimal, threshold: Decimal, near: int = 3) -> DataFrame:
    """(entry_id, code): every test that an entry of ``lines`` (with ``day`` and ``stamp``) raises, once each.

    ``users`` (posted_by) may post; ``holidays`` has days; what is posted after ``closed`` for a day up to it is late. Line
    tests look at each line, entry tests at the entry's sum of debits, reversals at the entry they name.
    """
    name = F.lower(zero_text("account_name"))
    marked = stored(lines.where("entry_id is not null").join(F.broadcast(holidays.select("day", F.lit(True).alias("_holiday"))), "day", "left").withColumn("_manual", manual), "marked")  # a year has few holidays
    end = F.last_day("day")
    by_line = {
        "MANUAL": F.col("_manual"), "WEEKEND": F.weekday("day") >= 5, "HOLIDAY": F.col("_holiday"), "AFTERHOURS": (F.hour("stamp") < 7) | (F.hour("stamp") >= 19), "PERIODEND": F.datediff(end, "day") < 5, "POSTLAG": F.datediff("stamp", "day") > 5,
        "POSTAFTERCLOSE": (F.col("stamp").cast("date") > day(closed)) & (F.col("day") <= day(closed)), "SUSPENSE": name.rlike("suspense|clearing"), "REVENUEMANUAL": F.col("_manual") & F.col("account").startswith("4"),
    }
    codes = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in by_line.items()]), lambda x: x.isNotNull())
    out = marked.select("entry_id", F.explode(codes).alias("code"))
    e = stored(marked.groupBy("entry_id").agg(cents(F.sum(zero("debit"))).alias("amount"), F.max(F.trim(zero_text("description"))).alias("said"), F.min("day").alias("day"), F.max("posted_by").alias("posted_by"), F.max("reversal_of").alias("reversal_of"), F.bool_or(F.col("account").startswith("10") & (zero("debit") > 0)).alias("cash"), F.bool_or(F.col("account").startswith("4") & (zero("credit") > 0)).alias("revenue")), "entries")
    one = lambda df, code: df.select("entry_id", F.lit(code).alias("code"))
    back = e.where("reversal_of is not null").select(F.col("reversal_of").alias("of"), F.col("amount").alias("_back"), F.col("entry_id").alias("_by"))
    accruals = e.where(F.lower("said").contains("accru") & (F.datediff(F.last_day("day"), "day") < 5) & F.col("reversal_of").isNull())
    amounts = marked.select("entry_id", "account", F.coalesce(F.when(F.col("debit") != 0, F.col("debit")), "credit").alias("a"), "day").where("a > 0 and day is not null").distinct().withColumn("_id", F.xxhash64("entry_id", "account", "a", "day"))
    links = joins.band_links(amounts, "_id", ["account", "a"], "day", near).select("_id")
    small = e.where((F.col("amount") > 0) & (F.col("amount") < F.lit(threshold)) & F.col("posted_by").isNotNull() & F.col("day").isNotNull())
    split = small.groupBy("posted_by", "day").agg(F.count("*").alias("n"), F.sum("amount").alias("s")).where((F.col("n") > 1) & (F.col("s") >= F.lit(threshold))).select("posted_by", "day")
    parts = [
        out, one(e.where("said = ''"), "BLANKDESC"), one(e.where(F.col("amount") >= F.lit(material)), "MATERIAL"), one(e.where("cash and revenue"), "CASHREVENUE"), one(accruals.join(back.select(F.col("of").alias("entry_id")), "entry_id", "left_anti"), "UNREVERSED"),
        one(e.join(back, F.col("entry_id") == F.col("of")).where("_back != amount").select(F.col("_by").alias("entry_id")), "REVAMOUNT"), one(amounts.join(links, "_id", "left_semi"), "DUPNEAR"), one(e.where("posted_by is not null").join(users.select("posted_by").distinct(), "posted_by", "left_anti"), "UNAUTHUSER"), one(small.join(split, ["posted_by", "day"], "left_semi"), "SPLIT"),
    ]
    return proof(*parts).distinct()


def scored(tests: DataFrame) -> DataFrame:
    """(entry_id, codes, score): the codes of each entry in the order of the alphabet and the sum of their weights."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("code"))
    return tests.groupBy("entry_id").agg(F.array_join(F.array_sort(F.collect_set("code")), " ").alias("codes"), F.sum(weight).cast("int").alias("score"))  # a code at most once


_SCAN = f"""WITH t AS ({stamps_sql(f'(SELECT *, posted_timestamp AS raw FROM je_entries LEFT JOIN {SYSTEMS} USING (source) WHERE entry_id IS NOT NULL)')}), m AS (SELECT *, utc AS stamp, {day_sql('effective_date')} AS day, source = 'GL-HUB' AS manual FROM t),
e AS (SELECT entry_id, sum(coalesce(debit, 0)) AS amount, max(trim(coalesce(description, ''))) AS said, min(day) AS day, max(posted_by) AS posted_by, max(reversal_of) AS reversal_of, bool_or(account LIKE '10%' AND coalesce(debit, 0) > 0) AS cash, bool_or(account LIKE '4%' AND coalesce(credit, 0) > 0) AS revenue FROM m GROUP BY 1),
a AS (SELECT DISTINCT entry_id, account, coalesce(nullif(debit, 0), credit) AS a, day FROM m WHERE coalesce(nullif(debit, 0), credit) > 0 AND day IS NOT NULL),
s AS (SELECT * FROM e WHERE amount > 0 AND amount < 5000 AND posted_by IS NOT NULL AND day IS NOT NULL), sp AS (SELECT posted_by, day FROM s GROUP BY 1, 2 HAVING count(*) > 1 AND sum(amount) >= 5000),
c AS (SELECT entry_id, 'MANUAL' AS code FROM m WHERE manual UNION SELECT entry_id, 'WEEKEND' FROM m WHERE isodow(day) >= 6 UNION SELECT entry_id, 'HOLIDAY' FROM m WHERE day IN (DATE '2025-01-01', DATE '2025-12-25') UNION SELECT entry_id, 'AFTERHOURS' FROM m WHERE hour(stamp) < 7 OR hour(stamp) >= 19 UNION SELECT entry_id, 'PERIODEND' FROM m WHERE date_diff('day', day, last_day(day)) < 5
 UNION SELECT entry_id, 'POSTLAG' FROM m WHERE date_diff('day', day, CAST(stamp AS DATE)) > 5 UNION SELECT entry_id, 'POSTAFTERCLOSE' FROM m WHERE CAST(stamp AS DATE) > DATE '2025-06-30' AND day <= DATE '2025-06-30' UNION SELECT entry_id, 'SUSPENSE' FROM m WHERE regexp_matches(lower(coalesce(account_name, '')), 'suspense|clearing') UNION SELECT entry_id, 'REVENUEMANUAL' FROM m WHERE manual AND account LIKE '4%'
 UNION SELECT entry_id, 'BLANKDESC' FROM e WHERE said = '' UNION SELECT entry_id, 'MATERIAL' FROM e WHERE amount >= 50000 UNION SELECT entry_id, 'CASHREVENUE' FROM e WHERE cash AND revenue UNION SELECT entry_id, 'UNREVERSED' FROM e WHERE contains(lower(said), 'accru') AND date_diff('day', day, last_day(day)) < 5 AND reversal_of IS NULL AND entry_id NOT IN (SELECT reversal_of FROM e WHERE reversal_of IS NOT NULL)
 UNION SELECT r.entry_id, 'REVAMOUNT' FROM e r JOIN e o ON r.reversal_of = o.entry_id WHERE r.amount <> o.amount UNION SELECT x.entry_id, 'DUPNEAR' FROM a x JOIN a y ON x.account = y.account AND x.a = y.a AND (x.entry_id <> y.entry_id OR x.day <> y.day) AND abs(date_diff('day', x.day, y.day)) <= 3
 UNION SELECT entry_id, 'UNAUTHUSER' FROM e WHERE posted_by IS NOT NULL AND posted_by NOT IN (SELECT approved_by FROM je_entries WHERE approved_by IS NOT NULL) UNION SELECT entry_id, 'SPLIT' FROM s JOIN sp USING (posted_by, day))
SELECT entry_id, string_agg(code, ' ' ORDER BY code) AS codes, CAST(sum(CASE code {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} END) AS INTEGER) AS score FROM c GROUP BY 1"""


@query(_SCAN)
def eng_journal_scan(spark, sf_dir):
    """Seventeen tests of each journal entry and its score; approvers may post, the hub's entries are manual."""
    systems, je = table(spark, sf_dir, "source_systems"), table(spark, sf_dir, "je_entries")
    lines = read_times(read_times(je, "posted_timestamp", systems, "stamp", "stamp"), "effective_date", systems)
    holidays = spark.createDataFrame([("2025-01-01",), ("2025-12-25",)], "d string").select(F.col("d").cast("date").alias("day"))
    users = je.where("approved_by is not null").select(F.col("approved_by").alias("posted_by"))
    return scored(journal_tests(lines, users, holidays, "2025-06-30", F.col("source") == "GL-HUB", D(50000), D(5000)))
