"""Queries of the ledger operators over the test tables, each beside the SQL of the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.operators import aggregates, joins, predicates, windows
from ledgerloom.operators.formula import formula
from ledgerloom.operators.instants import read_times
from ledgerloom.operators.matching import allocate, match_ledgers
from ledgerloom.operators.sampling import monetary_sample, random_sample, sampling_interval, stratified_sample
from ledgerloom.plans.instants_sql import SYSTEMS, day_sql, stamps_sql
from ledgerloom.runtime import shared_dir, table
from ledgerloom.sources import tables as sources
from ledgerloom.streaming import events as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
D = Decimal


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def cents(c):
    return F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", cents("o_totalprice").alias("amount"), F.col("o_orderdate").cast("date").alias("day"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "je_entries")


# ---- sources


@query("SELECT po_no, po_line, count(*) AS n FROM pos GROUP BY ALL HAVING count(*) > 1")
def src_repeated_keys(spark, sf_dir):
    """Purchase order lines entered under more than one row."""
    return sources.keyed(table(spark, sf_dir, "pos"), ["po_no", "po_line"])[1]


@query("SELECT count(*) AS n, CAST(sum(unit_price) AS DECIMAL(18,2)) AS price FROM pos WHERE (po_no, po_line) IN (SELECT (po_no, po_line) FROM pos GROUP BY po_no, po_line HAVING count(*) = 1)")
def src_unique_keys(spark, sf_dir):
    return sources.keyed(table(spark, sf_dir, "pos").where("po_no is not null and po_line is not null"), ["po_no", "po_line"])[0].agg(F.count("*").alias("n"), F.sum("unit_price").cast("decimal(18,2)").alias("price"))


@query("SELECT min(CASE WHEN r_name = 'AFRICA' THEN r_regionkey END) AS AFRICA, min(CASE WHEN r_name = 'ASIA' THEN r_regionkey END) AS ASIA, min(CASE WHEN r_name = 'NOWHERE' THEN r_regionkey END) AS NOWHERE FROM region")
def src_header_row(spark, sf_dir):
    """Name-value rows as one record."""
    return sources.header(table(spark, sf_dir, "region"), "r_name", "r_regionkey", ["AFRICA", "ASIA", "NOWHERE"])


MEASURES = {"payable": ("payable", "accrued"), "receivable": ("receivable",), "payroll": ("payroll", "employer"), "cash": ("cash", "bank"), "revenue": ("revenue", "sales")}


def _measure_sql() -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(account_name), '{'|'.join(w)}') THEN '{k}'" for k, w in MEASURES.items()) + " END"


@query(f"SELECT {_measure_sql()} AS measure, count(*) AS n, CAST(sum(coalesce(debit, 0) - coalesce(credit, 0)) AS DECIMAL(18,2)) AS total FROM je_entries GROUP BY 1")
def src_keyword_totals(spark, sf_dir):
    """Ledger totals by the first keyword of the account's name."""
    return sources.keyword_totals(lines(spark, sf_dir), text.first_rule(F.col("account_name"), MEASURES), F.coalesce("debit", F.lit(0)) - F.coalesce("credit", F.lit(0)))


@query("SELECT field_id, form, line FROM version_a ORDER BY field_id, form, line LIMIT 1")
def src_first_record(spark, sf_dir):
    return sources.first_record(table(spark, sf_dir, "version_a").select("field_id", "form", "line"), "field_id", "form", "line")


@query("SELECT doc_id, substr(sha256(concat_ws(chr(31), text, lang)), 1, 16) AS hash FROM documents")
def src_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sources.content_hash("text", "lang").alias("hash"))


@query("SELECT doc_id, length(trim(coalesce(text, ''))) < 60 AS scanned FROM documents")
def src_scanned_pages(spark, sf_dir):
    """Pages whose extracted text is too short to be more than a scan."""
    return table(spark, sf_dir, "documents").select("doc_id", (F.length(F.trim(F.coalesce("text", F.lit("")))) < 60).alias("scanned"))


@query("SELECT 'RGN' || lpad(CAST(row_number() OVER (ORDER BY r_name) AS VARCHAR), 4, '0') AS id, r_name FROM region")
def fn_surrogate_keys(spark, sf_dir):
    return table(spark, sf_dir, "region").select(sources.surrogate("RGN", 4, "r_name").alias("id"), "r_name")


# ---- typed parsing and scalar functions

_M = "regexp_replace({0}, '[^0-9.]', '', 'g')"


@query(f"SELECT row_id, CASE WHEN trim(extended_amount) IN ('', '-', '--') OR lower(trim(extended_amount)) = 'n/a' THEN NULL ELSE CAST({_M.format('extended_amount')} AS DECIMAL(18,2)) * CASE WHEN extended_amount LIKE '%-%' OR extended_amount LIKE '%(%' THEN -1 ELSE 1 END END::DECIMAL(18,2) AS amount FROM invoices")
def fn_money(spark, sf_dir):
    """Typed amounts as decimals."""
    spaced = F.regexp_replace("extended_amount", r"^\s*\$\s*\(", "(")
    return table(spark, sf_dir, "invoices").select("row_id", money.money(spaced).alias("amount"))


_S = "split_part(trim(receipt_date), ' ', 1)"


@query(f"""SELECT row_id, CASE WHEN regexp_full_match({_S}, '\\d{{4}}[-/]\\d{{1,2}}[-/]\\d{{1,2}}') THEN try_cast(try_strptime(replace({_S}, '/', '-'), '%Y-%m-%d') AS DATE)
 WHEN regexp_full_match({_S}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN CAST(try_strptime({_S}, '%m/%d/%Y') AS DATE) WHEN regexp_full_match({_S}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{2}}') THEN CAST(try_strptime({_S}, '%m/%d/%y') AS DATE)
 WHEN regexp_full_match({_S}, '\\d{{1,2}}-[A-Za-z]{{3}}-\\d{{4}}') THEN CAST(try_strptime({_S}, '%d-%b-%Y') AS DATE) END AS day FROM po_receipts""")
def fn_tolerant_dates(spark, sf_dir):
    return table(spark, sf_dir, "po_receipts").select("row_id", dates.tolerant_date(F.col("receipt_date")).alias("day"))


@query("SELECT row_id, lower(trim(regexp_replace(vendor, '\\s+', ' ', 'g'))) AS key, regexp_replace(lower(vendor), '[^\\p{L}\\p{N}]', '', 'g') AS alnum, array_to_string(list_filter(string_split(trim(regexp_replace(lower(vendor), '[^a-z0-9]+', ' ', 'g')), ' ') , lambda w: w NOT IN ('inc','llc','co','corp','ltd','company','incorporated','limited')), ' ') AS vendor_key FROM invoices")
def fn_text_keys(spark, sf_dir):
    v = F.col("vendor")
    return table(spark, sf_dir, "invoices").select("row_id", money.key(v).alias("key"), money.alnum_key(v).alias("alnum"), money.vendor_key(v).alias("vendor_key"))


@query("SELECT line_id, CASE WHEN debit IS NOT NULL AND debit <> 0 AND credit IS NOT NULL AND credit <> 0 THEN 'both' WHEN coalesce(debit, 0) = 0 AND coalesce(credit, 0) = 0 THEN 'neither' ELSE 'one' END AS sides, CAST(coalesce(debit, 0) - coalesce(credit, 0) AS DECIMAL(18,2)) AS net FROM je_entries")
def fn_exclusive_sides(spark, sf_dir):
    """Whether one of debit and credit is filled, and the net amount."""
    d, c = F.coalesce("debit", F.lit(0)), F.coalesce("credit", F.lit(0))
    return lines(spark, sf_dir).select("line_id", F.when((d != 0) & (c != 0), "both").when((d == 0) & (c == 0), "neither").otherwise("one").alias("sides"), cents(d - c).alias("net"))


@query("SELECT row_id, CAST(round_even(CAST(coalesce(amount_paid, qty_billed * unit_price) AS DECIMAL(38,12)), 2) AS DECIMAL(18,2)) AS paid FROM invoices")
def fn_default_extension(spark, sf_dir):
    """An amount that is blank is quantity times price, rounded half to even."""
    return table(spark, sf_dir, "invoices").select("row_id", cents(F.bround(F.coalesce("amount_paid", F.col("qty_billed") * F.col("unit_price")), 2)).alias("paid"))


@query("SELECT source, count(*) FILTER (regexp_matches(text, '\\b\\d{3}-\\d{2}-\\d{4}\\b')) AS leaking, count(*) AS n FROM documents GROUP BY 1")
def fn_identity_numbers(spark, sf_dir):
    """Documents with text of the shape of a social security number."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.coalesce(F.col("text").rlike(text.SSN), F.lit(False))).alias("leaking"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH AS DATE) AS next_start,
 CAST((1998 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) AS INTEGER) AS months, CAST((1998 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) - CASE WHEN day(o_orderdate) > 15 THEN 1 ELSE 0 END AS INTEGER) AS elapsed,
 CAST(greatest(0, date_diff('day', greatest(CAST(o_orderdate AS DATE), DATE '1997-01-01'), least(CAST(o_orderdate AS DATE) + 90, DATE '1997-12-31')) + 1) AS INTEGER) AS overlap, CAST(CASE WHEN o_orderdate < DATE '1997-01-01' THEN 1 WHEN date_diff('day', DATE '1997-01-01', CAST(o_orderdate AS DATE)) < 91 THEN date_diff('day', DATE '1997-01-01', CAST(o_orderdate AS DATE)) // 7 + 1 END AS INTEGER) AS week FROM orders""")
def fn_date_arithmetic(spark, sf_dir):
    day = lambda s: F.lit(s).cast("date")
    d = F.col("day")
    return orders(spark, sf_dir).select("o_orderkey", dates.month_start(d).alias("month_start"), dates.next_month_start(d).alias("next_start"), dates.month_difference(d, day("1998-06-15")).alias("months"), dates.months_elapsed(d, day("1998-06-15")).alias("elapsed"), dates.overlap_days(d, F.date_add(d, 90), day("1997-01-01"), day("1997-12-31")).alias("overlap"), dates.week_index(d, day("1997-01-01"), 13).alias("week"))


@query("SELECT o_orderkey, unnest(generate_series(CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(least(day(o_orderdate), 28) - 1 AS INTEGER), TIMESTAMP '2001-12-31', INTERVAL 1 MONTH))::DATE AS due FROM orders")
def fn_recurrences(spark, sf_dir):
    """Monthly recurrences up to a horizon, one row each."""
    return orders(spark, sf_dir).select("o_orderkey", F.explode(dates.recurrences(F.col("day"), F.lit("2001-12-31").cast("date"), "monthly")).alias("due"))


@query("SELECT c_custkey, 'Dear ' || c_name || ', you owe ' || CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '.' AS letter FROM customer WHERE c_acctbal > 0")
def fn_template(spark, sf_dir):
    letter, complete = text.render("Dear {name}, you owe {balance}.", {"name": F.col("c_name"), "balance": cents("c_acctbal")})
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").where(complete).select("c_custkey", letter.alias("letter"))


@query("SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM lineitem GROUP BY 1")
def fn_list_in_a_cell(spark, sf_dir):
    """Delimited numbers in one cell, parsed and added up."""
    cells = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat_ws("; ", F.collect_list(cents("l_quantity").cast("string"))).alias("cell"))
    return cells.select("l_orderkey", cents(text.parsed_sum(F.col("cell"))).alias("total"))


@query("SELECT c_custkey, CAST(round_even(CAST((CAST(c_acctbal AS DECIMAL(18,2)) - 100) * 2 / 3 AS DECIMAL(38,10)), 2) AS DECIMAL(18,2)) AS ratio FROM customer")
def fn_formula(spark, sf_dir):
    """A formula over named components, parsed into an expression."""
    value = formula("(balance - 100) * 2 / 3", {"balance": cents("c_acctbal")})
    return table(spark, sf_dir, "customer").select("c_custkey", cents(F.bround(value.cast("decimal(38,10)"), 2)).alias("ratio"))


# ---- predicates

_ROUND = "CASE " + " ".join(f"WHEN amount >= {m} AND amount <= {m * 20} AND amount % {m} = 0 THEN {m}" for m in predicates.ROUND) + " END"


@query(f"SELECT line_id, CAST({_ROUND} AS INTEGER) AS modulus FROM (SELECT line_id, coalesce(debit, credit) AS amount FROM je_entries) WHERE {_ROUND} IS NOT NULL")
def flt_round_amounts(spark, sf_dir):
    amount = F.coalesce("debit", "credit")
    return lines(spark, sf_dir).select("line_id", predicates.round_modulus(amount).alias("modulus")).where("modulus is not null")


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 95000 AND o_totalprice < 100000 THEN 100000 WHEN o_totalprice >= 237500 AND o_totalprice < 250000 THEN 250000 END::DECIMAL(18,2) AS threshold FROM orders WHERE o_totalprice >= 95000 AND o_totalprice < 100000 OR o_totalprice >= 237500 AND o_totalprice < 250000")
def flt_just_below(spark, sf_dir):
    """Amounts that stay just below a threshold."""
    return orders(spark, sf_dir).select("o_orderkey", cents(predicates.just_below(F.col("amount"), [D(100000), D(250000)])).alias("threshold")).where("threshold is not null")




_TIMES = f"WITH t AS ({stamps_sql(f'(SELECT line_id, effective_date, posted_timestamp AS raw, tz, o FROM je_entries LEFT JOIN {SYSTEMS} USING (source))')}), d AS (SELECT line_id, utc, {day_sql('effective_date')} AS d FROM t)"


@query(f"{_TIMES} SELECT line_id, coalesce(isodow(utc) >= 6, false) AS weekend, coalesce(hour(utc) < 7 OR hour(utc) >= 19, false) AS after_hours, coalesce(date_diff('day', d, CAST(utc AS DATE)) > 5, false) AS late FROM d")
def flt_posting_times(spark, sf_dir):
    """Weekend, after-hours and late postings, by UTC instants and days read from every layout."""
    systems = table(spark, sf_dir, "source_systems")
    rows = read_times(read_times(lines(spark, sf_dir), "posted_timestamp", systems, "stamp", "stamp"), "effective_date", systems)
    return rows.select("line_id", *[f.alias(n) for n, f in predicates.calendar_flags(F.col("stamp"), F.col("day")).items()])


_GEN = "|".join(sorted((g.replace("-", "\\-") for g in text.GENERIC), key=len, reverse=True))


@query(f"SELECT line_id, coalesce(trim(description) <> '' AND (regexp_full_match(lower(trim(description)), '({_GEN})[\\s\\W]*\\d{{0,6}}[\\s\\W]*') OR regexp_full_match(lower(trim(description)), 'per [a-z.\\s]{{1,18}}') OR length(trim(description)) <= 3), false) AS generic FROM je_entries")
def flt_generic_text(spark, sf_dir):
    return lines(spark, sf_dir).select("line_id", text.generic_text(F.col("description")).alias("generic"))


@query("SELECT row_id, due_date < invoice_date AS due_before_invoice, invoice_date > DATE '2025-12-15' AS after_close, open_balance > original_amount AS over_open FROM aging WHERE due_date < invoice_date OR invoice_date > DATE '2025-12-15' OR open_balance > original_amount")
def flt_sanity(spark, sf_dir):
    """Dates and balances that contradict each other."""
    a = table(spark, sf_dir, "aging").select("row_id", (F.col("due_date") < F.col("invoice_date")).alias("due_before_invoice"), (F.col("invoice_date") > F.lit("2025-12-15").cast("date")).alias("after_close"), (F.col("open_balance") > F.col("original_amount")).alias("over_open"))
    return a.where("due_before_invoice or after_close or over_open")


_SIGN = "CASE WHEN left(account, 1) IN ('1', '5', '6', '7') THEN 'debit' ELSE 'credit' END"


@query(f"SELECT account, CAST(net AS DECIMAL(18,2)) AS net FROM (SELECT account, {_SIGN} AS kind, sum(coalesce(debit, 0) - coalesce(credit, 0)) AS net FROM je_entries GROUP BY 1, 2) WHERE net <> 0 AND (net > 0) <> ((kind = 'debit') <> (account LIKE '%90'))")
def flt_wrong_sign(spark, sf_dir):
    """Accounts whose balance stands on the unusual side; numbers ending in 90 are contra accounts."""
    kind = F.when(F.substring("account", 1, 1).isin("1", "5", "6", "7"), "debit").otherwise("credit")
    net = lines(spark, sf_dir).groupBy("account", kind.alias("kind")).agg(cents(F.sum(F.coalesce("debit", F.lit(0)) - F.coalesce("credit", F.lit(0)))).alias("net"))
    return net.where(predicates.wrong_sign(F.col("net"), F.col("kind"), ("debit",), F.col("account").like("%90"))).select("account", "net")


@query("SELECT source, CAST(count(description) * 10000 // count(*) AS INTEGER) AS described, CAST(count(approved_by) * 10000 // count(*) AS INTEGER) AS approved FROM je_entries GROUP BY 1")
def flt_coverage(spark, sf_dir):
    """Share of filled fields by source, in hundredths of a percent, which decides what tests apply."""
    share = lambda c: F.floor(F.count(c) * 10000 / F.count("*")).cast("int")
    return lines(spark, sf_dir).groupBy("source").agg(share("description").alias("described"), share("approved_by").alias("approved"))


# ---- joins

_YEARS = "SELECT o_custkey AS customer, CAST(sum(CASE WHEN year(o_orderdate) = 1997 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DECIMAL(38,2)) AS c, CAST(sum(CASE WHEN year(o_orderdate) = 1996 THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DECIMAL(38,2)) AS p FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1"


@query(f"""SELECT customer, CAST(coalesce(c, 0) AS DECIMAL(18,2)) AS "current", CAST(coalesce(p, 0) AS DECIMAL(18,2)) AS prior, CAST(coalesce(c, 0) - coalesce(p, 0) AS DECIMAL(18,2)) AS delta,
 CASE WHEN p IS NULL THEN 'NEW' WHEN c IS NULL THEN 'DISAPPEARED' WHEN c = p THEN 'UNCHANGED' WHEN sign(c) * sign(p) < 0 THEN 'SIGN FLIP' WHEN abs(c) > abs(p) THEN 'EXPANSION' ELSE 'CONTRACTION' END AS state,
 abs(coalesce(c, 0) - coalesce(p, 0)) >= 250000 OR (coalesce(p, 0) <> 0 AND abs(coalesce(c, 0) - coalesce(p, 0)) * 100 >= abs(p) * 20 AND greatest(abs(coalesce(c, 0)), abs(p)) >= 300000) AS material FROM ({_YEARS})""")
def join_full_outer(spark, sf_dir):
    """Two periods compared key by key, with dual materiality."""
    o = orders(spark, sf_dir).withColumnRenamed("o_custkey", "customer")
    both = joins.compare_copies(o.where("year(day) = 1997"), o.where("year(day) = 1996"), ["customer"], "amount")
    return both.select("customer", cents("current").alias("current"), cents("prior").alias("prior"), cents("delta").alias("delta"), "state", predicates.beyond(F.col("current"), F.col("prior"), D(250000), D(20), D(300000)).alias("material"))


@query("SELECT DISTINCT po_no FROM invoices i WHERE po_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pos p WHERE p.po_no = i.po_no)")
def join_anti(spark, sf_dir):
    """Order numbers of invoices that no order has."""
    return table(spark, sf_dir, "invoices").where("po_no is not null").select("po_no").distinct().join(table(spark, sf_dir, "pos").select("po_no"), "po_no", "left_anti")


@query("SELECT row_id FROM pos p WHERE EXISTS (SELECT 1 FROM po_receipts r WHERE r.po_no = p.po_no AND r.po_line = p.po_line)")
def join_semi(spark, sf_dir):
    """Order lines that something was received on."""
    return table(spark, sf_dir, "pos").join(table(spark, sf_dir, "po_receipts").select("po_no", "po_line"), ["po_no", "po_line"], "left_semi").select("row_id")


@query("""WITH a AS (SELECT po_no, po_line, min(row_id) AS po_row FROM pos GROUP BY ALL), b AS (SELECT po_no, item, min(row_id) AS po_row FROM pos GROUP BY ALL HAVING count(*) = 1)
SELECT i.row_id, coalesce(a.po_row, b.po_row) AS po_row, CAST(CASE WHEN a.po_row IS NOT NULL THEN 1 WHEN b.po_row IS NOT NULL THEN 2 END AS INTEGER) AS rank FROM invoices i LEFT JOIN a ON i.po_no = a.po_no AND i.po_line = a.po_line LEFT JOIN b ON i.po_no = b.po_no AND i.item = b.item""")
def join_priority(spark, sf_dir):
    """Invoice lines to order lines: by line, else by an item the order has once."""
    pos = table(spark, sf_dir, "pos").select(F.col("row_id").alias("po_row"), "po_no", "po_line", "item")
    inv = table(spark, sf_dir, "invoices").select("row_id", "po_no", "po_line", "item")
    return joins.priority_join(inv, "row_id", [(pos, ["po_no", "po_line"], False), (pos, ["po_no", "item"], True)], ["po_row"])


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice > 60000 AND o_totalprice < 400000 THEN 'mid' WHEN o_totalprice > 450000 THEN 'high' END AS range, CAST(CASE WHEN o_totalprice BETWEEN 50000 AND 60000 THEN 2 WHEN o_totalprice BETWEEN 400000 AND 450000 THEN 2 ELSE 1 END AS INTEGER) AS matches FROM orders")
def join_one_range(spark, sf_dir):
    """The one range that holds a value; overlaps give none."""
    return joins.exactly_one_range(orders(spark, sf_dir), "o_orderkey", F.col("amount"), [("low", None, D(60000)), ("mid", D(50000), D(450000)), ("high", D(400000), None)])


@query("""WITH s AS (SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DECIMAL(18,2)) AS e, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders), t(tier, lo, hi) AS (VALUES (1, 0, 500000), (2, 500000, 1000000), (3, 1000000, 999999999))
SELECT o_orderkey, CAST(tier AS INTEGER) AS tier, CAST(least(e, hi) - greatest(e - a, lo) AS DECIMAL(18,2)) AS portion FROM s, t WHERE least(e, hi) > greatest(e - a, lo)""")
def join_tier_split(spark, sf_dir):
    """Running amounts of a customer cut by tiers."""
    cut = joins.tier_split(orders(spark, sf_dir), "o_custkey", ["day", "o_orderkey"], "amount", [(D(0), D(500000), D("0.05")), (D(500000), D(1000000), D("0.07")), (D(1000000), None, D("0.09"))])
    return cut.select("o_orderkey", "tier", cents("portion").alias("portion"))


_L = f"SELECT line_id, account, coalesce(debit, credit) AS amount, {day_sql('effective_date')} AS d FROM je_entries LEFT JOIN {SYSTEMS} USING (source) WHERE coalesce(debit, credit) > 0"


def dated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal lines with ``day``, read from every layout of their date."""
    return read_times(lines(spark, sf_dir), "effective_date", table(spark, sf_dir, "source_systems"))


@query(f"WITH l AS ({_L}) SELECT least(a.line_id, b.line_id) AS a, greatest(a.line_id, b.line_id) AS b, CAST(abs(date_diff('day', a.d, b.d)) AS INTEGER) AS gap FROM l a JOIN l b ON a.account = b.account AND a.amount = b.amount AND a.line_id < b.line_id AND abs(date_diff('day', a.d, b.d)) <= 7")
def join_date_band(spark, sf_dir):
    """Lines of one account and amount within a week of each other."""
    rows = dated_lines(spark, sf_dir).select("line_id", "account", F.coalesce("debit", "credit").alias("amount"), "day").where("amount > 0")
    return joins.band_pairs(rows, "line_id", ["account", "amount"], "day", 7)


@query(f"WITH l AS ({_L}), p AS (SELECT a.line_id, count(*) AS links FROM l a JOIN l b ON a.account = b.account AND a.amount = b.amount AND a.line_id <> b.line_id AND abs(date_diff('day', a.d, b.d)) <= 7 GROUP BY 1) SELECT * FROM p")
def join_date_links(spark, sf_dir):
    """Each line with the number of lines of its account and amount within a week."""
    rows = dated_lines(spark, sf_dir).select("line_id", "account", F.coalesce("debit", "credit").alias("amount"), "day").where("amount > 0")
    return joins.band_links(rows, "line_id", ["account", "amount"], "day", 7).select("line_id", "links")


_LEG = "SELECT leg_id, entity AS e, counterparty AS c, \"date\" AS d, amount, row_number() OVER (PARTITION BY entity, counterparty, \"date\", amount ORDER BY leg_id) AS n FROM ic_transactions"


@query(f"WITH l AS ({_LEG}) SELECT a.leg_id AS debit_leg, b.leg_id AS credit_leg FROM l a JOIN l b ON a.amount > 0 AND a.e = b.c AND a.c = b.e AND a.d = b.d AND a.amount = -b.amount AND a.n = b.n")
def join_rank_pairs(spark, sf_dir):
    """Legs of equal date and amount paired one by one."""
    ic = table(spark, sf_dir, "ic_transactions")
    a = ic.where("amount > 0").select(F.col("leg_id").alias("debit_leg"), "entity", "counterparty", "date", "amount")
    b = ic.where("amount < 0").select(F.col("leg_id").alias("credit_leg"), F.col("counterparty").alias("entity"), F.col("entity").alias("counterparty"), "date", (-F.col("amount")).cast("decimal(18,2)").alias("amount"))
    return joins.rank_pairs(a, b, ["entity", "counterparty", "date", "amount"], "debit_leg", "credit_leg")


@query("""WITH t AS (SELECT leg_id, entity, counterparty, amount, list_distinct(list_filter(string_split(regexp_replace(lower(coalesce(description, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 2 AND NOT regexp_full_match(w, '\\d+') AND w NOT IN (""" + ",".join(f"'{w}'" for w in money.STOP_WORDS) + """))) AS w FROM ic_transactions)
SELECT a.leg_id AS a, b.leg_id AS b, CAST(len(list_intersect(a.w, b.w)) * 100 // least(len(a.w), len(b.w)) AS INTEGER) AS score FROM t a JOIN t b ON a.amount > 0 AND a.entity = b.counterparty AND a.counterparty = b.entity AND a.amount = -b.amount WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) * 10 >= 6 * least(len(a.w), len(b.w))""")
def join_token_overlap(spark, sf_dir):
    """Legs of opposite amounts whose descriptions share most words."""
    ic = table(spark, sf_dir, "ic_transactions").select("leg_id", "entity", "counterparty", "amount", money.tokens(F.col("description")).alias("w"))
    b = ic.select(F.col("leg_id").alias("b"), F.col("counterparty").alias("entity"), F.col("entity").alias("counterparty"), (-F.col("amount")).cast("decimal(18,2)").alias("amount"), F.col("w").alias("v"))
    both = ic.where("amount > 0 and size(w) > 0").join(b.where("size(v) > 0"), ["entity", "counterparty", "amount"])
    score = F.size(F.array_intersect("w", "v")) * 100 / F.least(F.size("w"), F.size("v"))
    return both.where(joins.overlap(F.col("w"), F.col("v")) >= 0.6).select(F.col("leg_id").alias("a"), "b", F.floor(score).cast("int").alias("score"))


@query("""WITH c AS (SELECT leg_id, entity, counterparty, regexp_extract(lower(description), '(\\bref?\\s+|\\()(\\d{5})(\\D|$)', 2) AS cited FROM ic_transactions)
SELECT c.leg_id, d.leg_id AS cited_leg FROM c JOIN ic_transactions d ON c.cited <> '' AND d.entity = c.counterparty AND d.counterparty = c.entity AND regexp_extract(d.doc_id, '(\\d+)$', 1) = c.cited""")
def join_embedded_reference(spark, sf_dir):
    """Document numbers inside free text, joined as whole tokens."""
    ic = table(spark, sf_dir, "ic_transactions")
    c = ic.select("leg_id", "entity", "counterparty", F.regexp_extract(F.lower("description"), r"(\bref?\s+|\()(\d{5})(\D|$)", 2).alias("number")).where("number != ''")
    d = ic.select(F.col("leg_id").alias("cited_leg"), F.col("counterparty").alias("entity"), F.col("entity").alias("counterparty"), F.regexp_extract("doc_id", r"(\d+)$", 1).alias("number"))
    return c.join(d, ["entity", "counterparty", "number"]).select("leg_id", "cited_leg")


REQUESTS = [("leases", 0, "lease"), ("leases", 1, "depot"), ("deposits", 0, "deposit"), ("rates", 0, "interest on the"), ("none", 0, "no such phrase anywhere")]


@query("SELECT request, doc_id, min_by(term, place) AS term FROM documents, (VALUES " + ",".join(f"('{r}', {p}, '{t}')" for r, p, t in REQUESTS) + ") r(request, place, term) WHERE contains(lower(text), term) GROUP BY 1, 2")
def join_containment(spark, sf_dir):
    """Requested terms found in documents, the first of each request."""
    return joins.containing(table(spark, sf_dir, "documents"), "doc_id", "text", REQUESTS)


@query("SELECT least(posted_by, approved_by) AS posted_by, greatest(posted_by, approved_by) AS approved_by, count(*) FILTER (posted_by < approved_by) AS forth, count(*) FILTER (posted_by > approved_by) AS back FROM je_entries WHERE posted_by <> approved_by GROUP BY 1, 2 HAVING count(*) FILTER (posted_by < approved_by) > 0 AND count(*) FILTER (posted_by > approved_by) > 0")
def join_two_cycles(spark, sf_dir):
    """Users who approve each other."""
    return joins.two_cycles(lines(spark, sf_dir), "posted_by", "approved_by")


@query("SELECT least(entity, counterparty) AS a, greatest(entity, counterparty) AS b, CAST(sum(amount) AS DECIMAL(18,2)) AS net, count(*) AS n FROM ic_transactions GROUP BY 1, 2")
def join_unordered_pairs(spark, sf_dir):
    return table(spark, sf_dir, "ic_transactions").groupBy(F.least("entity", "counterparty").alias("a"), F.greatest("entity", "counterparty").alias("b")).agg(cents(F.sum("amount")).alias("net"), F.count("*").alias("n"))


@query("""WITH i AS (SELECT po_no, CAST(sum(qty_billed) AS DECIMAL(18,2)) AS billed FROM invoices WHERE po_no IS NOT NULL GROUP BY 1), o AS (SELECT po_no, CAST(sum(qty_ordered) AS DECIMAL(18,2)) AS ordered FROM pos WHERE po_no IS NOT NULL GROUP BY 1), r AS (SELECT po_no, CAST(sum(qty_received) AS DECIMAL(18,2)) AS received FROM po_receipts WHERE po_no IS NOT NULL GROUP BY 1)
SELECT po_no, coalesce(billed, 0) AS billed, coalesce(ordered, 0) AS ordered, coalesce(received, 0) AS received FROM i FULL JOIN o USING (po_no) FULL JOIN r USING (po_no)""")
def join_three_way(spark, sf_dir):
    """Billed, ordered and received quantities by order."""
    total = lambda t, c, name: table(spark, sf_dir, t).where("po_no is not null").groupBy("po_no").agg(cents(F.sum(c)).alias(name))
    j = total("invoices", "qty_billed", "billed").join(total("pos", "qty_ordered", "ordered"), "po_no", "full_outer").join(total("po_receipts", "qty_received", "received"), "po_no", "full_outer")
    return j.select("po_no", *[cents(F.coalesce(c, F.lit(0))).alias(c) for c in ("billed", "ordered", "received")])


@query()
def match_cascade(spark, sf_dir):
    """Legs of one side against the other's as bank and book: exact passes, then nearest date, tokens and subsets."""
    ic = table(spark, sf_dir, "ic_transactions").select(F.col("leg_id").alias("id"), "entity", "counterparty", "date", "amount", F.lit(None).cast("string").alias("check_no"), money.tokens(F.col("description")).alias("tokens"))
    bank = ic.where("entity < counterparty").withColumn("account", F.concat_ws("|", "entity", "counterparty"))
    book = ic.where("entity > counterparty").withColumn("account", F.concat_ws("|", "counterparty", "entity")).withColumn("amount", -F.col("amount"))
    return match_ledgers(bank, book)


@query("""WITH d AS (SELECT o_custkey AS c, o_orderkey AS deposit_id, CAST(o_totalprice AS DECIMAL(18,2)) AS a, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DECIMAL(18,2)) AS e FROM orders WHERE o_orderstatus = 'F'), i AS (SELECT o_custkey AS c, o_orderkey AS invoice_id, CAST(o_totalprice AS DECIMAL(18,2)) AS a, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DECIMAL(18,2)) AS e FROM orders WHERE o_orderstatus <> 'F')
SELECT deposit_id, invoice_id, CAST(least(d.e, i.e) - greatest(d.e - d.a, i.e - i.a) AS DECIMAL(18,2)) AS applied FROM d JOIN i USING (c) WHERE least(d.e, i.e) > greatest(d.e - d.a, i.e - i.a)""")
def match_allocation(spark, sf_dir):
    """Deposits applied to a customer's oldest invoices."""
    o = orders(spark, sf_dir)
    d = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("deposit_id"), "amount", F.col("day").alias("date"))
    i = o.where("o_orderstatus != 'F'").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("invoice_id"), F.col("amount").alias("open"), F.col("day").alias("date"))
    return allocate(d, i).select("deposit_id", "invoice_id", cents("applied").alias("applied"))


# ---- aggregations


@query("SELECT count(*) AS n, CAST(sum(coalesce(debit, 0)) AS DECIMAL(18,2)) AS debit, CAST(sum(coalesce(credit, 0)) AS DECIMAL(18,2)) AS credit, count(*) FILTER (debit IS NULL AND credit IS NULL) AS empty FROM je_entries")
def agg_control_totals(spark, sf_dir):
    return lines(spark, sf_dir).agg(F.count("*").alias("n"), cents(F.sum(F.coalesce("debit", F.lit(0)))).alias("debit"), cents(F.sum(F.coalesce("credit", F.lit(0)))).alias("credit"), F.count_if(F.col("debit").isNull() & F.col("credit").isNull()).alias("empty"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS quantity, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS price, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2")
def agg_group_sums(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(cents(F.sum(cents("l_quantity"))).alias("quantity"), cents(F.sum(cents("l_extendedprice"))).alias("price"), F.count("*").alias("n"))


@query("SELECT account, CAST(sum(debit) FILTER (debit > 0) AS DECIMAL(18,2)) AS debits, CAST(sum(credit) FILTER (credit > 0) AS DECIMAL(18,2)) AS credits, count(*) FILTER (coalesce(debit, credit) < 0) AS negatives FROM je_entries GROUP BY 1")
def agg_conditional(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("account").agg(cents(F.sum(F.when(F.col("debit") > 0, F.col("debit")))).alias("debits"), cents(F.sum(F.when(F.col("credit") > 0, F.col("credit")))).alias("credits"), F.count_if(F.coalesce("debit", "credit") < 0).alias("negatives"))


BUCKETS = ("Current", "1-30", "31-60", "61-90", "90+")
_DAYS = "date_diff('day', invoice_date, DATE '2025-12-31')"
_BUCKET = f"CASE WHEN {_DAYS} <= 0 THEN 'Current' WHEN {_DAYS} <= 30 THEN '1-30' WHEN {_DAYS} <= 60 THEN '31-60' WHEN {_DAYS} <= 90 THEN '61-90' ELSE '90+' END"


def bucketed(spark, sf_dir):
    age = F.datediff(F.lit("2025-12-31").cast("date"), F.col("invoice_date"))
    return table(spark, sf_dir, "aging").where("invoice_date is not null").withColumn("bucket", F.when(age <= 0, "Current").when(age <= 30, "1-30").when(age <= 60, "31-60").when(age <= 90, "61-90").otherwise("90+"))


@query(f"SELECT customer, {', '.join(f'CAST(sum(CASE WHEN b = {chr(39)}{b}{chr(39)} THEN open_balance END) AS DECIMAL(18,2)) AS {chr(34)}{b}{chr(34)}' for b in BUCKETS)} FROM (SELECT *, {_BUCKET} AS b FROM aging WHERE invoice_date IS NOT NULL) GROUP BY 1")
def agg_aging_pivot(spark, sf_dir):
    """Open balances of each customer by age."""
    p = bucketed(spark, sf_dir).groupBy("customer").pivot("bucket", list(BUCKETS)).agg(F.sum("open_balance"))
    return p.select("customer", *[cents(F.col(f"`{b}`")).alias(b) for b in BUCKETS])


@query(f"SELECT row_id, b AS bucket, reported_bucket FROM (SELECT *, {_BUCKET} AS b FROM aging WHERE invoice_date IS NOT NULL) WHERE lower(b) <> lower(coalesce(reported_bucket, ''))")
def agg_aging_mismatch(spark, sf_dir):
    """Rows aged into another bucket than reported."""
    return bucketed(spark, sf_dir).where(F.lower("bucket") != F.lower(F.coalesce("reported_bucket", F.lit("")))).select("row_id", "bucket", "reported_bucket")


@query("""SELECT entry_id, count(*) AS lines, CAST(sum(coalesce(debit, 0)) AS DECIMAL(18,2)) AS debit, CAST(sum(coalesce(credit, 0)) AS DECIMAL(18,2)) AS credit, CAST(greatest(sum(coalesce(debit, 0)), sum(coalesce(credit, 0))) AS DECIMAL(18,2)) AS amount,
 arg_min(description, line_no * 1000000000000 + line_id) FILTER (trim(description) <> '') AS description, coalesce(array_to_string(list_sort(list_distinct(list(account_name))), ' | '), '') AS account_names FROM je_entries GROUP BY 1""")
def agg_entry_headers(spark, sf_dir):
    """Journal entries from their lines."""
    h = aggregates.entry_headers(lines(spark, sf_dir))
    return h.select("entry_id", "lines", cents("debit").alias("debit"), cents("credit").alias("credit"), cents("amount").alias("amount"), "description", "account_names")


@query("SELECT account, count(DISTINCT entry_id) AS entries, count(DISTINCT posted_by) AS users FROM je_entries GROUP BY 1")
def agg_distinct(spark, sf_dir):
    return lines(spark, sf_dir).groupBy("account").agg(F.count_distinct("entry_id").alias("entries"), F.count_distinct("posted_by").alias("users"))


@query("""WITH n AS (SELECT vendor, requester, count(*) AS n FROM invoices WHERE requester IS NOT NULL GROUP BY 1, 2) SELECT vendor, arg_min(requester, (-n, requester)) AS requester, max(n) AS n, CAST(sum(n) AS BIGINT) AS total FROM n GROUP BY 1""")
def agg_most_frequent(spark, sf_dir):
    """The usual requester of each vendor."""
    return aggregates.most_frequent(table(spark, sf_dir, "invoices"), "vendor", "requester").select("vendor", "requester", "n", "total")


@query("""WITH m AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS a FROM orders GROUP BY ALL)
SELECT o_custkey, CAST(round_even(CAST(sum(a) / count(*) AS DECIMAL(38,6)), 2) AS DECIMAL(18,2)) AS average, count(*) AS periods FROM m WHERE m < 1998 * 12 + 6 GROUP BY 1 HAVING count(*) >= 3""")
def agg_trailing_average(spark, sf_dir):
    """Average of all prior months of a customer, from three months on."""
    m = orders(spark, sf_dir).groupBy("o_custkey", (F.year("day") * 12 + F.month("day")).alias("m")).agg(cents(F.sum("amount")).alias("a"))
    return m.where(F.col("m") < 1998 * 12 + 6).groupBy("o_custkey").agg(cents(F.bround((F.sum("a") / F.count("*")).cast("decimal(38,6)"), 2)).alias("average"), F.count("*").alias("periods")).where("periods >= 3")


@query("SELECT l_returnflag, round(avg(l_tax / (1 - l_discount)), 6) AS mean_rate, round(sum(l_tax) / sum(1 - l_discount), 6) AS total_rate FROM lineitem GROUP BY 1")
def agg_mean_of_ratios(spark, sf_dir):
    """Mean of ratios beside the ratio of sums."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.col("l_tax") / (1 - F.col("l_discount"))), 6).alias("mean_rate"), F.round(F.sum("l_tax") / F.sum(1 - F.col("l_discount")), 6).alias("total_rate"))


@query("SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total, CAST(grouping(o_orderstatus) * 2 + grouping(year(o_orderdate)) AS BIGINT) AS level FROM orders GROUP BY ROLLUP (o_orderstatus, year(o_orderdate))")
def agg_rollup(spark, sf_dir):
    """Subtotals and a grand total."""
    return orders(spark, sf_dir).withColumn("year", F.year("day")).rollup("o_orderstatus", "year").agg(cents(F.sum("amount")).alias("total"), F.grouping_id().alias("level"))


@query("WITH d AS (SELECT CAST(regexp_extract(CAST(amount AS VARCHAR), '[1-9]') AS INTEGER) AS digit, count(*) AS n FROM (SELECT coalesce(debit, credit) AS amount FROM je_entries) WHERE abs(amount) >= 10 GROUP BY 1) SELECT digit, n, round(n / (SELECT sum(n) FROM d), 6) AS share, round(log10(1 + 1 / digit), 6) AS expected FROM d")
def agg_leading_digits(spark, sf_dir):
    """First digits against the logarithmic law."""
    return aggregates.leading_digits(lines(spark, sf_dir).withColumn("amount", F.coalesce("debit", "credit")), "amount")


@query("SELECT posted_by, count(*) AS n, CAST(count(*) FILTER (approved_by IS NULL) AS BIGINT) AS exceptions, count(*) >= 5 AND count(*) FILTER (approved_by IS NULL) * 100 >= count(*) * 40 AS high FROM je_entries GROUP BY 1")
def agg_exception_rates(spark, sf_dir):
    """Unapproved lines by user."""
    return aggregates.exception_rates(lines(spark, sf_dir), "posted_by", F.col("approved_by").isNull()).select("posted_by", "n", "exceptions", "high")


@query("SELECT customer, max(open_balance) FILTER (original_amount > open_balance AND open_balance > 0) AS largest_part_paid, min(due_date) AS first_due, CAST(sum(terms_days) AS BIGINT) AS terms, count(terms_days) AS with_terms FROM aging GROUP BY 1")
def agg_null_skipping(spark, sf_dir):
    """Extremes and sums that skip nulls, and a maximum under a condition."""
    return table(spark, sf_dir, "aging").groupBy("customer").agg(F.max(F.when((F.col("original_amount") > F.col("open_balance")) & (F.col("open_balance") > 0), F.col("open_balance"))).alias("largest_part_paid"), F.min("due_date").alias("first_due"), F.sum("terms_days").cast("long").alias("terms"), F.count("terms_days").alias("with_terms"))


# ---- windows

_PRINTED = "SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS DECIMAL(18,2)) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END END AS printed FROM orders"


@query(f"""WITH p AS ({_PRINTED}), s AS (SELECT *, count(printed) OVER w AS seg, coalesce(last_value(printed IGNORE NULLS) OVER w, 0) AS lastp FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT *, lastp + sum(amount) OVER (PARTITION BY o_custkey, seg ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS expected FROM s) SELECT o_orderkey, CAST(expected AS DECIMAL(18,2)) AS expected, CAST(printed - expected AS DECIMAL(18,2)) AS difference FROM e WHERE printed <> expected""")
def win_balance_breaks(spark, sf_dir):
    """Breaks of a printed running balance, going on from each printed one."""
    true = F.sum("amount").over(windows.running("o_custkey", "o_orderkey"))
    p = orders(spark, sf_dir).withColumn("printed", F.when(F.col("o_orderkey") % 7 != 0, cents(true + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0))))
    return windows.balance_breaks(p, "o_custkey", "o_orderkey", "amount", "printed").select("o_orderkey", cents("expected").alias("expected"), cents("difference").alias("difference"))


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w AS DECIMAL(18,2)) AS finish, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER w - CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS start FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)")
def win_running_spans(spark, sf_dir):
    """Running balances and the span of each row."""
    total = F.sum("amount").over(windows.running("o_custkey", "day", "o_orderkey"))
    return orders(spark, sf_dir).select("o_orderkey", cents(total).alias("finish"), cents(total - F.col("amount")).alias("start"))


@query("""WITH r AS (SELECT entity, year("date") * 12 + month("date") AS m, CAST(sum(abs(amount)) AS DECIMAL(18,2)) AS v FROM ic_transactions GROUP BY ALL), l AS (SELECT *, lag(v) OVER (PARTITION BY entity ORDER BY m) AS was FROM r) SELECT entity, CAST(m AS INTEGER) AS m, v, was FROM l WHERE was IS NOT NULL AND v > 2 * was""")
def win_drift(spark, sf_dir):
    """Months in which an entity's volume more than doubles."""
    r = table(spark, sf_dir, "ic_transactions").groupBy("entity", (F.year("date") * 12 + F.month("date")).alias("m")).agg(cents(F.sum(F.abs("amount"))).alias("v"))
    return r.withColumn("was", F.lag("v").over(Window.partitionBy("entity").orderBy("m"))).where("was is not null and v > 2 * was")


@query("""WITH n AS (SELECT DISTINCT regexp_extract(doc_id, '^(.*?)(\\d+)$', 1) AS prefix, CAST(regexp_extract(doc_id, '^(.*?)(\\d+)$', 2) AS BIGINT) AS a FROM ic_transactions WHERE doc_id IS NOT NULL), g AS (SELECT prefix, a, lead(a) OVER (PARTITION BY prefix ORDER BY a) AS b FROM n) SELECT prefix, a AS "after", b AS "before", b - a - 1 AS missing FROM g WHERE b > a + 1""")
def win_sequence_gaps(spark, sf_dir):
    """Gaps in document numbers."""
    return windows.sequence_gaps(table(spark, sf_dir, "ic_transactions"), "doc_id")


@query("""WITH p AS (SELECT po_no, po_line, max(qty_ordered) AS lim FROM pos GROUP BY ALL) SELECT row_id, CAST(sum(qty_billed) OVER (PARTITION BY po_no, po_line ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS used, coalesce(sum(qty_billed) OVER (PARTITION BY po_no, po_line ORDER BY row_id ROWS UNBOUNDED PRECEDING) > lim, false) AS over FROM invoices JOIN p USING (po_no, po_line)""")
def win_consumption(spark, sf_dir):
    """Ordered quantities used up invoice by invoice."""
    p = table(spark, sf_dir, "pos").groupBy("po_no", "po_line").agg(F.max("qty_ordered").alias("lim"))
    j = table(spark, sf_dir, "invoices").join(p, ["po_no", "po_line"])
    return windows.consumption(j, ["po_no", "po_line"], ["row_id"], "qty_billed", "lim").select("row_id", cents("used").alias("used"), "over")


@query("WITH n AS (SELECT account, posted_by, count(*) AS n FROM je_entries GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY n DESC, posted_by) AS rank, CAST(sum(n) OVER (PARTITION BY account) AS BIGINT) AS total FROM n) SELECT account, posted_by, n, CAST(rank AS INTEGER) AS rank, total FROM r WHERE rank <= 3")
def win_top_share(spark, sf_dir):
    """The three busiest users of each account with the account's total."""
    n = lines(spark, sf_dir).groupBy("account", "posted_by").agg(F.count("*").alias("n"))
    r = n.withColumn("rank", F.row_number().over(Window.partitionBy("account").orderBy(F.desc("n"), "posted_by"))).withColumn("total", F.sum("n").over(Window.partitionBy("account")))
    return r.where("rank <= 3")


@query("""WITH m AS (SELECT DISTINCT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) AS m FROM orders), r AS (SELECT *, m - row_number() OVER (PARTITION BY o_custkey ORDER BY m) AS run FROM m) SELECT o_custkey, CAST(m AS INTEGER) AS m, CAST(row_number() OVER (PARTITION BY o_custkey, run ORDER BY m) AS INTEGER) AS streak FROM r""")
def win_streaks(spark, sf_dir):
    """Consecutive months with an order."""
    return windows.streaks(orders(spark, sf_dir).withColumn("m", F.year("day") * 12 + F.month("day")), "o_custkey", "m")


@query("""WITH s AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS t FROM orders GROUP BY ALL), b AS (SELECT o_custkey, y, CAST(sum(t) OVER (PARTITION BY o_custkey ORDER BY y) AS DECIMAL(18,2)) AS closing, t FROM s) SELECT o_custkey, CAST(y AS INTEGER) AS y, closing, CAST(lead(closing - t) OVER (PARTITION BY o_custkey ORDER BY y) AS DECIMAL(18,2)) AS next_opening FROM b""")
def win_continuity(spark, sf_dir):
    """The closing balance of a year beside the next one's opening balance."""
    s = orders(spark, sf_dir).groupBy("o_custkey", F.year("day").alias("y")).agg(cents(F.sum("amount")).alias("t")).withColumn("closing", cents(F.sum("t").over(windows.running("o_custkey", "y"))))
    return s.select("o_custkey", "y", "closing", cents(F.lead(F.col("closing") - F.col("t")).over(Window.partitionBy("o_custkey").orderBy("y"))).alias("next_opening"))


_ANNUITY = """WITH RECURSIVE c AS (SELECT c_custkey AS k, CAST(c_acctbal AS DECIMAL(18,2)) AS pay, CAST(c_custkey % 10 + 3 AS INTEGER) AS n FROM customer WHERE c_acctbal > 100),
f(i, v) AS (SELECT 0, CAST(1 AS DECIMAL(38,24)) UNION ALL SELECT i + 1, CAST(CAST(v AS DECIMAL(38,24)) / 1.005 AS DECIMAL(38,24)) FROM f WHERE i < 12), s AS (SELECT k, pay, n, CAST(round(CAST(pay * (SELECT sum(CAST(v AS DECIMAL(30,12))) FROM f WHERE i BETWEEN 1 AND n) AS DECIMAL(38,12)), 2) AS DECIMAL(18,2)) AS pv FROM c),
w(k, pay, n, period, interest, principal, balance) AS (SELECT k, pay, n, 0, CAST(0 AS DECIMAL(18,2)), CAST(0 AS DECIMAL(18,2)), pv FROM s
 UNION ALL SELECT k, pay, n, period + 1, CAST(CASE WHEN period + 1 = n THEN pay - balance ELSE round(balance * 0.005, 2) END AS DECIMAL(18,2)), CAST(CASE WHEN period + 1 = n THEN balance ELSE pay - round(balance * 0.005, 2) END AS DECIMAL(18,2)), CAST(CASE WHEN period + 1 = n THEN 0 ELSE balance - (pay - round(balance * 0.005, 2)) END AS DECIMAL(18,2)) FROM w WHERE period < n)"""


@query(_ANNUITY + " SELECT k AS c_custkey, CAST(period AS INTEGER) AS period, interest, principal, balance FROM w WHERE period > 0")
def win_annuity(spark, sf_dir):
    """Amortisation of a level payment over a customer's terms, a row for each period."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 100").select("c_custkey", cents("c_acctbal").alias("payment"), (F.pmod("c_custkey", F.lit(10)) + 3).cast("int").alias("n"))
    return c.select("c_custkey", F.explode(windows.annuity_schedule(F.col("payment"), F.lit(D("0.005")), F.col("n"))).alias("r")).select("c_custkey", "r.*")


@query("SELECT c_custkey, CAST((sum(CAST(c_acctbal AS DECIMAL(18,2))) OVER (PARTITION BY c_custkey)) AS DECIMAL(18,2)) AS asset, CAST(((2 * CAST(CAST(c_acctbal AS DECIMAL(18,2)) * 100 AS BIGINT) + c_custkey % 10 + 3) // (2 * (c_custkey % 10 + 3))) / 100.0 AS DECIMAL(18,2)) AS charge FROM customer WHERE c_acctbal > 100")
def win_right_of_use(spark, sf_dir):
    """The level charge of an asset over its terms, in cents."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 100").select("c_custkey", cents("c_acctbal").alias("asset"), (F.pmod("c_custkey", F.lit(10)) + 3).cast("int").alias("n"))
    return c.select("c_custkey", "asset", windows.level_charge(F.col("asset"), F.col("n")).alias("charge"))


# ---- sorts, limits and sets


@query("SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS amount FROM orders ORDER BY amount DESC, o_orderkey LIMIT 10")
def sort_top(spark, sf_dir):
    """The ten largest orders."""
    return orders(spark, sf_dir).select("o_orderkey", "amount").orderBy(F.desc("amount"), "o_orderkey").limit(10)


@query("SELECT o_custkey, list_transform(list_sort(list({'a': CAST(o_totalprice AS DECIMAL(18,2)), 'k': o_orderkey}))[1:8], lambda x: x.k) AS keys FROM orders GROUP BY 1")
def sort_capped_lists(spark, sf_dir):
    """The eight smallest open items of each customer."""
    ranked = orders(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("o_custkey").orderBy("amount", "o_orderkey"))).where("n <= 8")
    return ranked.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "o_orderkey"))), lambda x: x["o_orderkey"]).alias("keys"))  # eight at most



@query("SELECT row_id, vendor AS party, 'vendor' AS kind, NULL::DECIMAL(18,2) AS open FROM pos UNION ALL SELECT row_id, customer, 'customer', open_balance FROM aging")
def set_union(spark, sf_dir):
    """Tables of different columns as one."""
    a = table(spark, sf_dir, "pos").select("row_id", F.col("vendor").alias("party"), F.lit("vendor").alias("kind"))
    return a.unionByName(table(spark, sf_dir, "aging").select("row_id", F.col("customer").alias("party"), F.lit("customer").alias("kind"), F.col("open_balance").alias("open")), allowMissingColumns=True)


@query("SELECT 'both' AS side, count(*) AS n FROM (SELECT upper(trim(field_id)) FROM version_a INTERSECT SELECT upper(trim(field_id)) FROM version_b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT upper(trim(field_id)) FROM version_a EXCEPT SELECT upper(trim(field_id)) FROM version_b) UNION ALL SELECT 'only_b', count(*) FROM (SELECT upper(trim(field_id)) FROM version_b EXCEPT SELECT upper(trim(field_id)) FROM version_a)")
def set_keys(spark, sf_dir):
    """Keys both copies have, and those of one only."""
    a, b = (table(spark, sf_dir, t).select(F.upper(F.trim("field_id")).alias("k")) for t in ("version_a", "version_b"))
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(a.intersect(b), "both").unionAll(count(a.subtract(b), "only_a")).unionAll(count(b.subtract(a), "only_b"))


@query("SELECT po_no, po_line, min(row_id) AS row_id FROM pos GROUP BY ALL")
def set_first_of_each_key(spark, sf_dir):
    """The first row of each order line."""
    return table(spark, sf_dir, "pos").groupBy("po_no", "po_line").agg(F.min("row_id").alias("row_id"))


@query()
def agg_approximate(spark, sf_dir):
    """Approximate distinct counts and quantiles."""
    return lines(spark, sf_dir).groupBy("account").agg(F.approx_count_distinct("entry_id").alias("entries"), F.approx_percentile(F.coalesce("debit", "credit"), 0.5).alias("median"))


@query("SELECT count(*) AS missing FROM (SELECT po_no, po_line, item FROM pos EXCEPT ALL SELECT po_no, po_line, item FROM po_receipts)")
def set_multiset(spark, sf_dir):
    """Rows of one table that another lacks, counted as a multiset."""
    cols = ["po_no", "po_line", "item"]
    receipts = table(spark, sf_dir, "po_receipts").select("po_no", F.col("po_line").cast("int").alias("po_line"), "item")
    return table(spark, sf_dir, "pos").select(*cols).exceptAll(receipts).agg(F.count("*").alias("missing"))


# ---- samples


def _mus_sql() -> str:
    import random as r

    interval = sampling_interval(D(5_000_000), D(500_000), D("1.6"), 0.05).quantize(D("0.000001"))
    start = (D(str(r.Random(42).random())) * sampling_interval(D(5_000_000), D(500_000), D("1.6"), 0.05)).quantize(D("0.000001"))
    v = "CAST(o_totalprice AS DECIMAL(38,6))"
    return f"""WITH l AS (SELECT o_orderkey, {v} AS v, sum({v}) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS e FROM orders WHERE o_totalprice > 0 AND o_totalprice < {interval}),
 h AS (SELECT o_orderkey, v, greatest(0, CAST(floor(CAST(e - {start} AS DOUBLE) / {interval}) AS BIGINT) + 1) - CASE WHEN e = v THEN 0 ELSE greatest(0, CAST(floor(CAST(e - v - {start} AS DOUBLE) / {interval}) AS BIGINT) + 1) END AS hits FROM l)
 SELECT o_orderkey, CAST(v AS DECIMAL(18,2)) AS amount, 'hit' AS basis, CAST(hits AS BIGINT) AS hits FROM h WHERE hits > 0 UNION ALL SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)), 'top', 1 FROM orders WHERE o_totalprice >= {interval}"""


@query(_mus_sql())
def sample_monetary_units(spark, sf_dir):
    """Monetary units at a fixed interval from a seeded start."""
    interval = sampling_interval(D(5_000_000), D(500_000), D("1.6"), 0.05)
    return monetary_sample(orders(spark, sf_dir), "o_orderkey", "amount", interval, 42).select("o_orderkey", cents("amount").alias("amount"), "basis", "hits")


@query()
def sample_attributes(spark, sf_dir):
    """A seeded random sample of 60 orders."""
    return random_sample(orders(spark, sf_dir), "o_orderkey", 60, 7).select("o_orderkey", "amount")


@query()
def sample_strata(spark, sf_dir):
    """A seeded sample by descending strata of value."""
    return stratified_sample(orders(spark, sf_dir), "o_orderkey", "amount", [D(400000), D(200000)], [40, 30, 20], 7).select("o_orderkey", "amount", "stratum")


@query("SELECT CASE WHEN o_totalprice < 100000 THEN 'a' WHEN o_totalprice < 300000 THEN 'b' ELSE 'c' END AS band, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM orders GROUP BY 1")
def sample_bands(spark, sf_dir):
    band = F.when(F.col("amount") < 100000, "a").when(F.col("amount") < 300000, "b").otherwise("c")
    return orders(spark, sf_dir).groupBy(band.alias("band")).agg(F.count("*").alias("n"), cents(F.sum("amount")).alias("total"))


# ---- streams


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _places(spark: SparkSession) -> tuple[str, str]:
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    return f"{folder}/checkpoint", f"{folder}/out"


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    """Hourly counts of a stream of events, run over what is there."""
    stream = streams.windowed(event_stream(spark, sf_dir).withColumn("value", cents("value")), "ts", "event_type", "value")
    return streams.latest(spark, stream, *_places(spark)).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", cents("total").alias("total"))


@query("WITH s AS (SELECT to_timestamp(floor(epoch(ts) / 1800) * 1800 - k * 1800)::TIMESTAMP AS start, user_id FROM events, (VALUES (0), (1)) t(k)) SELECT start, user_id, count(*) AS n FROM s GROUP BY 1, 2")
def stream_sliding(spark, sf_dir):
    """Counts by user in windows of an hour that begin every half hour."""
    stream = streams.windowed(event_stream(spark, sf_dir).withColumn("value", cents("value")), "ts", "user_id", "value", "1 hour", "30 minutes")
    return streams.latest(spark, stream, *_places(spark)).select(F.col("start").cast("timestamp_ntz").alias("start"), "user_id", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS brk FROM events), s AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, sess")
def stream_sessions(spark, sf_dir):
    """Sessions of users, which break after half an hour."""
    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return streams.sessions(rows, "ts", "user_id").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
