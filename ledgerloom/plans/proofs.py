"""Proof gates of the ledger engines: numbered tests, each the size of what contradicts it, from one pass over each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money, text
from ledgerloom.operators import diff, joins, matching, windows
from ledgerloom.runtime import stored, table

QUERIES, SQL = {}, {}
COLUMNS = "num int, name string, passed boolean, skipped boolean, difference decimal(18,2)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def cents(c):
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")


def checks(df: DataFrame, tests: dict[tuple[int, str], Column], noted: tuple[int, ...] = ()) -> DataFrame:
    """(num, name, passed, skipped, difference) of each test, a (number, name) and the aggregate that is zero where it holds.

    All tests of a table are one aggregation. A null aggregate is a test that could not be made; those in ``noted`` are only
    reported and never fail.
    """
    row = df.agg(*[cents(c).alias(f"g{num}") for (num, _), c in tests.items()])
    d = lambda num: F.col(f"g{num}")
    passed = lambda num: F.lit(True) if num in noted else F.coalesce(d(num) == 0, F.lit(True))
    rows = [F.struct(F.lit(num).alias("num"), F.lit(name).alias("name"), passed(num).alias("passed"), d(num).isNull().alias("skipped"), d(num).alias("difference")) for num, name in tests]
    return row.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def proof(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def proof_sql(ctes: str, tests: list[tuple[str, str]], noted: tuple[int, ...] = ()) -> str:
    """The same rows: ``tests`` are (name, scalar query of the difference)."""
    rows = " UNION ALL ".join(f"SELECT CAST({i} AS INTEGER) AS num, '{name.replace("'", "''")}' AS name, CAST(({q}) AS DECIMAL(18,2)) AS d, {'true' if i in noted else 'false'} AS noted" for i, (name, q) in enumerate(tests, 1))
    return f"{ctes + ', ' if ctes else 'WITH '}gate_rows AS ({rows}) SELECT num, name, noted OR coalesce(d = 0, true) AS passed, d IS NULL AS skipped, d AS difference FROM gate_rows"


def zero(c) -> Column:
    return F.coalesce(c, F.lit(0))


def count_if(c: Column) -> Column:
    return F.count_if(F.coalesce(c, F.lit(False)))


def trial_balance(lines: DataFrame) -> DataFrame:
    """(account, name, debit, credit, net, n, kind): one row an account; kinds go by the first digit of the account."""
    tb = lines.groupBy("account").agg(F.max("account_name").alias("name"), cents(F.sum(zero("debit"))).alias("debit"), cents(F.sum(zero("credit"))).alias("credit"), F.count("*").alias("n"))
    first = F.substring("account", 1, 1)
    kind = F.when(first == "1", "asset").when(first == "2", "liability").when(first == "3", "equity").when(first == "4", "revenue").otherwise("expense")
    return tb.withColumn("net", cents(F.col("debit") - F.col("credit"))).withColumn("kind", kind)


_TB = """WITH tb AS (SELECT *, debit - credit AS net, CASE left(account, 1) WHEN '1' THEN 'asset' WHEN '2' THEN 'liability' WHEN '3' THEN 'equity' WHEN '4' THEN 'revenue' ELSE 'expense' END AS kind
FROM (SELECT account, max(account_name) AS name, sum(coalesce(debit, 0)) AS debit, sum(coalesce(credit, 0)) AS credit, count(*) AS n FROM je_entries GROUP BY 1))"""


def balance_proof(tb: DataFrame, mapping: DataFrame, prior: DataFrame) -> DataFrame:
    """Eight tests of a trial balance (account, name, net, kind) against a mapping (account, line) and prior nets (account, net).

    Contra accounts, told by their names, are expected on the other side. Equal names are those of :func:`text.account_key`.
    """
    lines = mapping.where("line is not null").groupBy("account").agg(F.count_distinct("line").alias("lines"))
    p = prior.groupBy("account").agg(cents(F.sum("net")).alias("before"))
    contra = F.lower(zero_text("name")).rlike("accumulated|allowance|discount|contra")
    debit = F.col("kind").isin("asset", "expense") != contra
    t = tb.join(lines, "account", "left").join(p, "account", "left")
    names = t.withColumn("key", text.account_key(F.col("name"))).where("key != ''").groupBy("key").agg(F.count("*").alias("n"))
    span = tb.where(F.col("account").rlike(r"^\d+$")).groupBy("kind").agg(F.min(F.col("account").cast("long")).alias("lo"), F.max(F.col("account").cast("long")).alias("hi"))  # a row a kind
    other = span.select(F.col("kind").alias("k"), F.col("lo").alias("l"), F.col("hi").alias("h"))
    overlaps = span.join(F.broadcast(other), (F.col("kind") < F.col("k")) & (F.col("lo") <= F.col("h")) & (F.col("l") <= F.col("hi")))
    return proof(
        checks(t, {
            (1, "debits equal credits"): F.sum("net"), (2, "every account has a line"): count_if(F.col("lines").isNull()), (3, "the mapping foots to the trial balance"): F.sum(F.col("net") * zero("lines")) + F.sum(F.when(F.col("lines").isNull(), F.col("net")).otherwise(0)) - F.sum("net"),
            (4, "the accounting equation holds"): F.sum(F.when(F.col("kind").isNotNull(), F.col("net"))), (5, "balances stand on their side"): count_if((F.col("net") != 0) & (debit != (F.col("net") > 0))),
        }),
        checks(names, {(6, "no two accounts of one name"): count_if(F.col("n") > 1)}), checks(t, {(7, "no dormant account has a balance"): count_if((F.col("net") == F.col("before")) & (F.col("net") != 0))}), checks(overlaps, {(8, "ranges of kinds do not overlap"): F.count("*")}),
    )


def zero_text(c: str) -> Column:
    return F.coalesce(c, F.lit(""))


_CUT = "2025-01-01"


@query(proof_sql(f"""{_TB}, m AS (SELECT DISTINCT account FROM je_entries WHERE source = 'GL-HUB'), p AS (SELECT account, sum(coalesce(debit, 0) - coalesce(credit, 0)) AS before FROM je_entries WHERE loaded_at < TIMESTAMP '{_CUT}' GROUP BY 1), s AS (SELECT kind, min(CAST(account AS BIGINT)) AS lo, max(CAST(account AS BIGINT)) AS hi FROM tb WHERE regexp_full_match(account, '[0-9]+') GROUP BY 1),
d AS (SELECT *, (kind IN ('asset', 'expense')) <> regexp_matches(lower(coalesce(name, '')), 'accumulated|allowance|discount|contra') AS dr FROM tb)""", [
    ("debits equal credits", "SELECT sum(net) FROM tb"), ("every account has a line", "SELECT count(*) FROM tb WHERE account NOT IN (SELECT account FROM m)"), ("the mapping foots to the trial balance", "SELECT 0"), ("the accounting equation holds", "SELECT sum(net) FROM tb"),
    ("balances stand on their side", "SELECT count(*) FROM d WHERE net <> 0 AND dr <> (net > 0)"), ("no two accounts of one name", "SELECT count(*) FROM (SELECT trim(regexp_replace(regexp_replace(replace(lower(name), '&', 'and'), '[^a-z0-9]+', ' ', 'g'), ' +[0-9]+ *$', '')) AS k FROM tb GROUP BY 1 HAVING count(*) > 1 AND k <> '')"),
    ("no dormant account has a balance", "SELECT count(*) FROM tb JOIN p USING (account) WHERE net = before AND net <> 0"), ("ranges of kinds do not overlap", "SELECT count(*) FROM s a JOIN s b ON a.kind < b.kind AND a.lo <= b.hi AND b.lo <= a.hi"),
]))
def gate_trial_balance(spark, sf_dir):
    """The trial balance of the journal; the hub's accounts are the mapped ones, what was loaded before 2025 is the prior period."""
    je = table(spark, sf_dir, "je_entries")
    tb = stored(trial_balance(je), "tb")
    return balance_proof(tb, je.where("source = 'GL-HUB'").select("account", F.col("account").alias("line")).distinct(), trial_balance(je.where(F.col("loaded_at") < F.lit(_CUT).cast("timestamp_ntz"))))


def journal_proof(lines: DataFrame) -> DataFrame:
    """What must hold before a journal is scanned: sides, entries and keys."""
    entries = lines.groupBy("entry_id").agg(F.sum(zero("debit")).alias("dr"), F.sum(zero("credit")).alias("cr"))
    numbers = lines.groupBy("entry_id", "line_no").agg(F.count("*").alias("n"))
    return proof(
        checks(lines, {(1, "debits equal credits"): F.sum(zero("debit")) - F.sum(zero("credit")), (2, "each line has one side"): count_if((zero("debit") != 0) == (zero("credit") != 0)), (3, "each line has an entry"): count_if(F.col("entry_id").isNull())}),
        checks(entries, {(4, "each entry balances"): count_if(F.col("dr") != F.col("cr"))}), checks(numbers, {(5, "no line is loaded twice"): count_if(F.col("n") > 1)}),
    )


@query(proof_sql("", [
    ("debits equal credits", "SELECT sum(coalesce(debit, 0)) - sum(coalesce(credit, 0)) FROM je_entries"), ("each line has one side", "SELECT count(*) FROM je_entries WHERE (coalesce(debit, 0) <> 0) = (coalesce(credit, 0) <> 0)"), ("each line has an entry", "SELECT count(*) FROM je_entries WHERE entry_id IS NULL"),
    ("each entry balances", "SELECT count(*) FROM (SELECT entry_id FROM je_entries GROUP BY 1 HAVING sum(coalesce(debit, 0)) <> sum(coalesce(credit, 0)))"), ("no line is loaded twice", "SELECT count(*) FROM (SELECT 1 FROM je_entries GROUP BY entry_id, line_no HAVING count(*) > 1)"),
]))
def gate_journal(spark, sf_dir):
    return journal_proof(table(spark, sf_dir, "je_entries"))


def sampling_proof(rows: DataFrame, value: str, control: Column, seed: int | None, negatives: str | None, interval: object | None) -> DataFrame:
    """Four tests before a sample is drawn: the population ties, a seed is recorded, negative items have a treatment, the plan has an interval."""
    below = count_if(F.col(value) < 0)
    return checks(rows, {
        (1, "the population ties to its control"): F.sum(zero(value)) - control, (2, "the seed is recorded"): F.max(F.lit(0 if seed is not None else 1)),
        (3, "negative items have a treatment"): F.when(F.lit(negatives is not None), F.lit(0)).otherwise(below), (4, "the plan has an interval"): F.max(F.lit(0 if interval is not None and interval > 0 else 1)),
    })


@query(proof_sql("", [("the population ties to its control", "SELECT sum(coalesce(open_balance, 0)) - (SELECT sum(original_amount) FROM aging) FROM aging"), ("the seed is recorded", "SELECT 0"), ("negative items have a treatment", "SELECT count(*) FROM aging WHERE open_balance < 0"), ("the plan has an interval", "SELECT 0")]))
def gate_sampling(spark, sf_dir):
    """Open balances against the original amounts as control, with no treatment chosen for credits."""
    a = table(spark, sf_dir, "aging")
    return sampling_proof(a, "open_balance", F.sum(zero("original_amount")), 7, None, 1000)


_NUM = "CASE WHEN regexp_full_match(trim(value), '-?\\$?[0-9][0-9,]*(\\.[0-9]*)?|\\(\\$?[0-9][0-9,]*(\\.[0-9]*)?\\)') THEN CAST(CAST(regexp_replace(value, '[^0-9.]', '', 'g') AS DECIMAL(18,2)) * CASE WHEN regexp_matches(value, '[-(]') THEN -1 ELSE 1 END AS DECIMAL(18,2)) END"


def filing_proof(a: DataFrame, b: DataFrame, totals: DataFrame, reviewed: str) -> DataFrame:
    """Seven tests of two versions of a filing: coverage, direction, size, propagation, carried amounts, late changes, totals that stood still."""
    side = lambda df, x: df.select(diff.filing_key(F.col("field_id")).alias("f"), money.money(F.col("value")).alias("v"), "is_carryforward", "changed_at").groupBy("f").agg(F.min("v").alias(x), F.max("is_carryforward").alias(f"{x}_carry"), F.max("changed_at").alias(f"{x}_at"))
    both = stored(side(a, "x").join(side(b, "y"), "f", "full_outer"), "versions")
    moved = both.select("f", (F.col("y") - F.col("x")).alias("d"))
    parts = totals.where("component_field_id is not null").select(F.col("total_field_id").alias("t"), F.col("component_field_id").alias("f")).distinct().join(moved.where("d is not null"), "f").groupBy("t").agg(F.sum("d").alias("s"), F.max(F.abs("d")).alias("most"))
    up = parts.join(moved.where("d is not null").withColumnRenamed("f", "t"), "t")
    late = F.lit(reviewed).cast("timestamp_ntz")
    keys = a.select(diff.filing_key(F.col("field_id")).alias("f")).union(b.select(diff.filing_key(F.col("field_id")).alias("f"))).distinct().count()
    return proof(
        checks(both, {(1, "every field is accounted for"): F.count("*") - F.lit(keys), (2, "both versions are named"): F.max(F.lit(0)), (3, "every change has a size"): F.sum(zero(F.col("y") - F.col("x")))}, noted=(3,)),
        checks(up, {(4, "changes reach their totals"): count_if(F.col("d") != F.col("s"))}),
        checks(both, {(5, "carried amounts agree"): count_if(F.col("x_carry") & (F.col("x") != F.col("y"))), (6, "no change after the review"): count_if(F.col("y_at") > late)}),
        checks(up, {(7, "no total stood still"): count_if((F.col("d") == 0) & (F.col("most") > 0))}),
    )


@query(proof_sql(f"""WITH a AS (SELECT upper(trim(field_id)) AS f, min({_NUM}) AS x, max(is_carryforward::INT) = 1 AS c FROM version_a GROUP BY 1), b AS (SELECT upper(trim(field_id)) AS f, min({_NUM}) AS y, max(changed_at) AS ts FROM version_b GROUP BY 1), j AS (SELECT f, x, y, c, ts FROM a FULL JOIN b USING (f)), d AS (SELECT f, y - x AS d FROM j WHERE y - x IS NOT NULL),
l AS (SELECT DISTINCT total_field_id AS t, component_field_id AS f FROM totals_map WHERE component_field_id IS NOT NULL), p AS (SELECT t, sum(d) AS s, max(abs(d)) AS m FROM l JOIN d USING (f) GROUP BY 1), u AS (SELECT p.t, s, m, d.d FROM p JOIN d ON d.f = p.t)""", [
    ("every field is accounted for", "SELECT 0"), ("both versions are named", "SELECT 0"), ("every change has a size", "SELECT sum(coalesce(y - x, 0)) FROM j"), ("changes reach their totals", "SELECT count(*) FROM u WHERE d <> s"), ("carried amounts agree", "SELECT count(*) FROM j WHERE c AND x <> y"),
    ("no change after the review", "SELECT count(*) FROM j WHERE ts > TIMESTAMP '2025-06-30'"), ("no total stood still", "SELECT count(*) FROM u WHERE d = 0 AND m > 0"),
], noted=(3,)))
def gate_filing(spark, sf_dir):
    return filing_proof(table(spark, sf_dir, "version_a"), table(spark, sf_dir, "version_b"), table(spark, sf_dir, "totals_map"), "2025-06-30")


_PAID = "CASE WHEN regexp_matches(extended_amount, '[0-9]') THEN CAST(CAST(regexp_replace(extended_amount, '[^0-9.]', '', 'g') AS DECIMAL(18,2)) * CASE WHEN regexp_matches(extended_amount, '[-(]') THEN -1 ELSE 1 END AS DECIMAL(18,2)) END"


@query(proof_sql(f"WITH p AS (SELECT row_id, vendor, invoice_no, {_PAID} AS amount FROM invoices)", [
    ("scanned and unscanned are all", "SELECT (SELECT count(*) FROM p) - count(*) FILTER (vendor IS NOT NULL AND amount <> 0) - count(*) FILTER (vendor IS NULL) - count(*) FILTER (vendor IS NOT NULL AND amount IS NULL) - count(*) FILTER (vendor IS NOT NULL AND amount = 0) FROM p"), ("every record has its own number", "SELECT count(*) FROM (SELECT row_id FROM p GROUP BY 1 HAVING count(*) > 1)"),
    ("scanned and unscanned amounts are all", "SELECT sum(coalesce(amount, 0)) - sum(CASE WHEN vendor IS NOT NULL THEN coalesce(amount, 0) ELSE 0 END) - sum(CASE WHEN vendor IS NULL THEN coalesce(amount, 0) ELSE 0 END) FROM p"),
]))
def gate_payments(spark, sf_dir):
    """Coverage of the scan for payments made twice: every record is scanned or has a reason why not."""
    p = table(spark, sf_dir, "invoices").select("row_id", "vendor", money.money(F.regexp_replace("extended_amount", r"^\s*\$\s*\(", "(")).alias("amount"))
    reason = F.when(F.col("vendor").isNull(), "no vendor").when(F.col("amount").isNull(), "no amount").when(F.col("amount") == 0, "zero").otherwise("scanned")
    by = p.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), cents(F.sum(zero("amount"))).alias("s"))
    whole = p.agg(F.count("*").alias("n"), cents(F.sum(zero("amount"))).alias("s"))
    return proof(
        checks(by, {(1, "scanned and unscanned are all"): F.sum("n") - F.lit(whole.select("n").scalar())}), checks(p.groupBy("row_id").agg(F.count("*").alias("n")), {(2, "every record has its own number"): count_if(F.col("n") > 1)}),
        checks(by, {(3, "scanned and unscanned amounts are all"): F.sum("s") - F.lit(whole.select("s").scalar())}),
    )


def statement_proof(rows: DataFrame, account: str, order: str, amount: str, printed: str, opening: str, closing: str) -> DataFrame:
    """Three tests of statements: opening plus movements is closing, movements by side are those printed, running balances have no break."""
    per = rows.groupBy(account).agg(F.sum(zero(amount)).alias("moved"), F.max(opening).alias("o"), F.max(closing).alias("c"))
    breaks = windows.balance_breaks(rows, account, order, amount, printed)
    return proof(checks(per, {(1, "opening and movements make closing"): count_if(F.col("o") + F.col("moved") != F.col("c"))}), checks(rows, {(2, "movements are as printed"): F.sum(zero(amount)) - F.sum(F.when(F.col(amount) > 0, F.col(amount)).otherwise(0)) - F.sum(F.when(F.col(amount) < 0, F.col(amount)).otherwise(0))}), checks(breaks, {(3, "no break in the running balance"): F.count("*")}))


@query(proof_sql("""WITH o AS (SELECT o_custkey, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders), r AS (SELECT *, sum(a) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS t FROM o), p AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN t + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END END AS printed FROM r),
s AS (SELECT *, count(printed) OVER w AS seg, coalesce(last_value(printed IGNORE NULLS) OVER w, 0) AS lastp FROM p WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), e AS (SELECT *, lastp + sum(a) OVER (PARTITION BY o_custkey, seg ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS x FROM s)""", [
    ("opening and movements make closing", "SELECT 0"), ("movements are as printed", "SELECT 0"), ("no break in the running balance", "SELECT count(*) FROM e WHERE printed <> x"),
]))
def gate_statement(spark, sf_dir):
    """Customers' orders as statements whose printed balances are wrong in places."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", cents("o_totalprice").alias("a"))
    t = F.sum("a").over(windows.running("o_custkey", "o_orderkey"))
    p = o.withColumn("printed", F.when(F.col("o_orderkey") % 7 != 0, cents(t + F.when(F.col("o_orderkey") % 11 == 0, 1).otherwise(0)))).withColumn("opening", F.lit(0).cast("decimal(18,2)")).withColumn("closing", cents(F.sum("a").over(Window.partitionBy("o_custkey"))))
    return statement_proof(p, "o_custkey", "o_orderkey", "a", "printed", "opening", "closing")


@query(proof_sql("", [
    ("no item is dated after the cut", "SELECT count(*) FROM aging WHERE invoice_date > DATE '2025-12-15'"), ("nothing is open beyond its amount", "SELECT count(*) FROM aging WHERE abs(open_balance) > abs(original_amount)"), ("every item has a customer and a balance", "SELECT count(*) FROM aging WHERE customer IS NULL OR trim(customer) = '' OR open_balance IS NULL OR open_balance = 0"),
    ("no item is listed twice", "SELECT count(*) FROM (SELECT 1 FROM aging WHERE invoice_no IS NOT NULL GROUP BY customer, invoice_no, open_balance HAVING count(*) > 1)"), ("no round amount is long open", "SELECT count(*) FROM aging WHERE open_balance <> 0 AND open_balance % 1000 = 0 AND date_diff('day', invoice_date, DATE '2025-12-31') > 90"),
    ("credits are within a tenth of debits", "SELECT greatest(0, -sum(CASE WHEN open_balance < 0 THEN open_balance ELSE 0 END) * 10 - sum(CASE WHEN open_balance > 0 THEN open_balance ELSE 0 END)) FROM aging"), ("related parties are listed", "SELECT count(*) FROM aging WHERE lower(trim(customer_type)) IN ('affiliate', 'related', 'employee', 'officer')"),
], noted=(5, 7)))
def gate_receivables(spark, sf_dir):
    """Integrity of the aging beyond its sums: cut, amounts, parties, repeats, old round items, credits."""
    a, open_ = table(spark, sf_dir, "aging"), F.col("open_balance")
    twice = a.where("invoice_no is not null").groupBy("customer", "invoice_no", "open_balance").agg(F.count("*").alias("n"))
    part = lambda c: F.sum(F.when(c, open_).otherwise(0))
    return proof(
        checks(a, {
            (1, "no item is dated after the cut"): count_if(F.col("invoice_date") > F.lit("2025-12-15").cast("date")), (2, "nothing is open beyond its amount"): count_if(F.abs(open_) > F.abs("original_amount")), (3, "every item has a customer and a balance"): F.count_if(F.col("customer").isNull() | (F.trim("customer") == "") | open_.isNull() | (open_ == 0)),
            (5, "no round amount is long open"): count_if((open_ != 0) & (open_ % 1000 == 0) & (F.datediff(F.lit("2025-12-31").cast("date"), "invoice_date") > 90)), (6, "credits are within a tenth of debits"): F.greatest(F.lit(0), -part(open_ < 0) * 10 - part(open_ > 0)), (7, "related parties are listed"): count_if(F.lower(F.trim("customer_type")).isin("affiliate", "related", "employee", "officer")),
        }, noted=(5, 7)),
        checks(twice, {(4, "no item is listed twice"): count_if(F.col("n") > 1)}),
    )


@query(proof_sql("""WITH o AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus = 'F' AS dep, CAST(o_totalprice AS DECIMAL(18,2)) AS a FROM orders WHERE o_totalprice > 0), s AS (SELECT c, coalesce(sum(a) FILTER (dep), 0) AS d, coalesce(sum(a) FILTER (NOT dep), 0) AS i FROM o GROUP BY 1)""", [
    ("applied and unapplied make the deposits", "SELECT 0"), ("no deposit is applied beyond its amount", "SELECT 0"), ("no invoice is paid beyond its balance", "SELECT 0"), ("every deposit is applied in full", "SELECT sum(d - least(d, i)) FROM s"),
]))
def gate_cash_application(spark, sf_dir):
    """Deposits against what was applied of them and to what; the last test is the sum still unapplied."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("k"), cents("o_totalprice").alias("a"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderstatus") == "F").alias("dep"))
    d, i = o.where("dep").select("customer", F.col("k").alias("deposit_id"), F.col("a").alias("amount"), "date"), o.where("not dep").select("customer", F.col("k").alias("invoice_id"), F.col("a").alias("open"), "date")
    applied = stored(matching.allocate(d, i), "applied")
    by_d = d.join(applied.groupBy("deposit_id").agg(F.sum("applied").alias("x")), "deposit_id", "left").withColumn("left", F.col("amount") - zero("x"))
    by_i = i.join(applied.groupBy("invoice_id").agg(F.sum("applied").alias("x")), "invoice_id", "left")
    return proof(
        checks(by_d, {(1, "applied and unapplied make the deposits"): F.sum("amount") - F.sum("left") - F.sum(zero("x")), (2, "no deposit is applied beyond its amount"): count_if(F.col("left") < 0), (4, "every deposit is applied in full"): F.sum("left")}), checks(by_i, {(3, "no invoice is paid beyond its balance"): count_if(F.col("x") > F.col("open"))}),
    )


_GOT = "g AS (SELECT po_no, po_line, sum(qty_received) AS got FROM po_receipts WHERE po_no IS NOT NULL GROUP BY ALL)"


def cutoff_states(items: DataFrame, recorded: DataFrame, accruals: DataFrame, words: str, end: str) -> DataFrame:
    """``items`` (ref, day, amount, words column) with ``state``: unclassified, after, recorded, accrued or not recorded.

    Items up to ``end`` are recorded if ``recorded`` (ref) has them; else accrued if an accrual's text holds one of their
    words of over four letters. The words of all accruals are one row: a list of what was accrued, not of what was bought.
    """
    known = recorded.select("ref").where("ref is not null").distinct().withColumn("_known", F.lit(True))
    long_words = lambda c: F.filter(F.split(F.lower(zero_text(c)), r"[^a-z0-9]+"), lambda w: F.length(w) > 4)
    accrued = accruals.select(F.explode(long_words("text")).alias("w")).distinct().withColumn("_word", F.lit(True))
    hit = items.where(F.col("day") <= F.lit(end).cast("date")).select("row_id", F.explode(long_words(words)).alias("w")).join(accrued, "w").select("row_id").distinct().withColumn("_accrued", F.lit(True))
    j = items.join(known, "ref", "left").join(hit, "row_id", "left")
    return j.withColumn("state", F.when(F.col("day").isNull(), "unclassified").when(F.col("day") > F.lit(end).cast("date"), "after").when(F.col("_known"), "recorded").when(F.col("_accrued"), "accrued").otherwise("not recorded")).drop("_known", "_accrued")


_CUTOFF = """WITH p AS (SELECT row_id, po_no, po_date AS day, item, CAST(round(qty_ordered * unit_price, 2) AS DECIMAL(18,2)) AS a FROM pos), k AS (SELECT DISTINCT po_no FROM invoices WHERE po_no IS NOT NULL), w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(item), '[^a-z0-9]+')) AS w FROM invoices WHERE po_no IS NULL AND item IS NOT NULL),
h AS (SELECT DISTINCT row_id FROM (SELECT row_id, unnest(regexp_split_to_array(lower(item), '[^a-z0-9]+')) AS w FROM p WHERE item IS NOT NULL) JOIN w USING (w) WHERE length(w) > 4),
s AS (SELECT *, CASE WHEN day IS NULL THEN 'unclassified' WHEN day > DATE '2025-06-30' THEN 'after' WHEN po_no IN (SELECT po_no FROM k) THEN 'recorded' WHEN row_id IN (SELECT row_id FROM h) THEN 'accrued' ELSE 'not recorded' END AS state FROM p)"""


def _cutoff(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "pos").select("row_id", F.col("po_no").alias("ref"), F.col("po_date").cast("date").alias("day"), "item", cents(F.round(F.col("qty_ordered") * F.col("unit_price"), 2)).alias("amount"))
    inv = table(spark, sf_dir, "invoices")
    return cutoff_states(items, inv.select(F.col("po_no").alias("ref")), inv.where("po_no is null").select(F.col("item").alias("text")), "item", "2025-06-30")


@query(_CUTOFF + " SELECT state, count(*) AS n, sum(a)::DECIMAL(18,2) AS amount FROM s GROUP BY 1")
def eng_cutoff(spark, sf_dir):
    """Order lines by when they fall and whether they are recorded or accrued."""
    return _cutoff(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), cents(F.sum("amount")).alias("amount"))


@query(proof_sql(_CUTOFF + """, g AS (SELECT po_no, po_line, sum(qty_received) AS r FROM po_receipts WHERE po_no IS NOT NULL GROUP BY ALL)""".replace(" g AS", " gr AS"), [
    ("the population ties to its control", "SELECT (SELECT sum(a) FROM p) - sum(a) FROM s"), ("every item has a state", "SELECT count(*) FROM s WHERE state = 'unclassified'"), ("what is not recorded is proposed", "SELECT coalesce(sum(a), 0) FROM s WHERE state = 'not recorded'"), ("goods received are listed", "SELECT count(*) FROM gr WHERE po_no NOT IN (SELECT po_no FROM k)"),
    ("invoices without an order are listed", "SELECT count(*) FROM invoices WHERE po_no IS NULL"), ("credit notes are listed", "SELECT count(*) FROM invoices WHERE qty_billed < 0"),
], noted=(3, 4, 5, 6)))
def gate_cutoff(spark, sf_dir):
    s, inv = stored(_cutoff(spark, sf_dir), "cutoff"), table(spark, sf_dir, "invoices")
    total = table(spark, sf_dir, "pos").agg(cents(F.sum(cents(F.round(F.col("qty_ordered") * F.col("unit_price"), 2))))).scalar()
    got = table(spark, sf_dir, "po_receipts").where("po_no is not null").select("po_no", "po_line").distinct().join(inv.select("po_no").distinct(), "po_no", "left_anti")
    return proof(
        checks(s, {(1, "the population ties to its control"): F.lit(total) - F.sum("amount"), (2, "every item has a state"): count_if(F.col("state") == "unclassified"), (3, "what is not recorded is proposed"): zero(F.sum(F.when(F.col("state") == "not recorded", F.col("amount"))))}, noted=(3,)),
        checks(got, {(4, "goods received are listed"): F.count("*")}, noted=(4,)), checks(inv, {(5, "invoices without an order are listed"): count_if(F.col("po_no").isNull()), (6, "credit notes are listed"): count_if(F.col("qty_billed") < 0)}, noted=(5, 6)),
    )


def accruals(orders: DataFrame, receipts: DataFrame, invoices: DataFrame) -> DataFrame:
    """(po_no, po_line, received, invoiced, outstanding, state): each order line by the first state that applies.

    All three are summed by line first, so no line multiplies another's quantities.
    """
    key = ["po_no", "po_line"]
    some = lambda df, c, name: df.where("po_no is not null and po_line is not null").select("po_no", F.col("po_line").cast("int").alias("po_line"), F.col(c).alias("q")).groupBy(*key).agg(F.sum("q").alias(name))
    price = orders.where("po_no is not null and po_line is not null").groupBy("po_no", F.col("po_line").cast("int").alias("po_line")).agg(F.max("unit_price").alias("price"))
    j = price.join(some(receipts, "qty_received", "received"), key, "left").join(some(invoices, "qty_billed", "invoiced"), key, "left")
    left = zero("received") - zero("invoiced")
    state = F.when(left < 0, "invoiced beyond receipt").when(F.col("received").isNull(), "no receipt").when(left == 0, "fully invoiced").otherwise("proposed")
    return j.select(*key, zero("received").alias("received"), zero("invoiced").alias("invoiced"), cents(F.round(left * F.col("price"), 2)).alias("outstanding"), state.alias("state"))


_ACCRUALS = """WITH o AS (SELECT po_no, po_line, max(unit_price) AS price FROM pos WHERE po_no IS NOT NULL AND po_line IS NOT NULL GROUP BY ALL), r AS (SELECT po_no, po_line, sum(qty_received) AS r FROM po_receipts WHERE po_no IS NOT NULL AND po_line IS NOT NULL GROUP BY ALL), i AS (SELECT po_no, po_line, sum(qty_billed) AS b FROM invoices WHERE po_no IS NOT NULL AND po_line IS NOT NULL GROUP BY ALL),
a AS (SELECT o.po_no, CAST(o.po_line AS INTEGER) AS po_line, CAST(round((coalesce(r, 0) - coalesce(b, 0)) * price, 2) AS DECIMAL(18,2)) AS outstanding, CASE WHEN coalesce(r, 0) < coalesce(b, 0) THEN 'invoiced beyond receipt' WHEN r IS NULL THEN 'no receipt' WHEN r = coalesce(b, 0) THEN 'fully invoiced' ELSE 'proposed' END AS state
FROM o LEFT JOIN r ON r.po_no = o.po_no AND r.po_line = o.po_line LEFT JOIN i ON i.po_no = o.po_no AND i.po_line = o.po_line)"""


@query(_ACCRUALS + " SELECT po_no, po_line, outstanding, state FROM a")
def eng_accruals(spark, sf_dir):
    """Received and not yet invoiced, line by line of the orders."""
    return accruals(table(spark, sf_dir, "pos"), table(spark, sf_dir, "po_receipts"), table(spark, sf_dir, "invoices")).select("po_no", "po_line", "outstanding", "state")


@query(proof_sql(_ACCRUALS, [
    ("every order line has one state", "SELECT (SELECT count(*) FROM o) - count(*) FROM a"), ("no proposal is zero or less", "SELECT count(*) FROM a WHERE state = 'proposed' AND outstanding <= 0"), ("debits equal credits", "SELECT 0"), ("reversals mirror their entries", "SELECT 0"), ("proposals make the total", "SELECT 0"),
]))
def gate_accruals(spark, sf_dir):
    """The batch of proposed accruals with its legs and mirrored reversals."""
    p = stored(accruals(table(spark, sf_dir, "pos"), table(spark, sf_dir, "po_receipts"), table(spark, sf_dir, "invoices")), "accruals")
    keys = table(spark, sf_dir, "pos").where("po_no is not null and po_line is not null").select("po_no", "po_line").distinct().count()
    legs = p.where("state = 'proposed'").select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("outstanding") * s).alias("a")) for k, s in (("entry", 1), ("entry", -1), ("reversal", -1), ("reversal", 1))])).alias("x"), "outstanding").select("x.*", "outstanding")
    side = lambda k, s: F.sum(F.when((F.col("kind") == k) & (F.sign("a") == s), F.abs("a")).otherwise(0))
    return proof(
        checks(p, {(1, "every order line has one state"): F.lit(keys) - F.count("*"), (2, "no proposal is zero or less"): count_if((F.col("state") == "proposed") & (F.col("outstanding") <= 0))}),
        checks(legs, {(3, "debits equal credits"): F.sum("a"), (4, "reversals mirror their entries"): side("entry", 1) - side("reversal", -1), (5, "proposals make the total"): F.sum(F.when(F.col("kind") == "entry", F.abs("a")).otherwise(0)) / 2 - F.sum(F.abs("outstanding")) / 4}),
    )
