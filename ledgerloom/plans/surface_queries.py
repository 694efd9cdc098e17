"""Queries of sources, sinks, scalar functions and policies given as tables."""

from __future__ import annotations

import uuid
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import money, text
from ledgerloom.operators import joins, predicates
from ledgerloom.operators.sampling import monetary_sample, project
from ledgerloom.plans.proofs import cents, zero
from ledgerloom.runtime import shared_dir, stored, table
from ledgerloom.sources import tables as sources

D = Decimal
QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/tabs-{uuid.uuid4().hex}"


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(NULL AS VARCHAR) AS remarks FROM customer")
def src_csv(spark, sf_dir):
    """Customers written as delimited text and scanned again by header name; a column the file lacks is null."""
    path = sources.write_tabs({"customers": table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")}, _folder(spark), "csv")["customers"]
    return sources.scan_csv(spark, path, ["c_custkey", "c_name", "remarks"])


@query("SELECT row_number() OVER (ORDER BY r_regionkey) AS row, CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def src_numbered_csv(spark, sf_dir):
    """A delimited file with the number of each record."""
    path = sources.write_tabs({"regions": table(spark, sf_dir, "region").select("r_regionkey", "r_name").coalesce(1).sortWithinPartitions("r_regionkey")}, _folder(spark), "csv")["regions"]
    return sources.scan_csv(spark, path, ["r_regionkey", "r_name"], row_number="row")


@query("SELECT 0::BIGINT AS n")
def src_optional(spark, sf_dir):
    """A file that may be missing and is."""
    return sources.scan_csv(spark, f"{_folder(spark)}/none.csv", ["a", "b"], optional=True).agg(F.count("*").alias("n"))


@query("SELECT 'nations' AS name, 'nations.DOES_NOT_TIE' AS folder, count(*) AS n FROM nation UNION ALL SELECT 'regions', 'regions.DOES_NOT_TIE', count(*) FROM region")
def sink_status(spark, sf_dir):
    """Result tables written under the status of their gates, and read back."""
    paths = sources.write_tabs({"nations": table(spark, sf_dir, "nation"), "regions": table(spark, sf_dir, "region")}, _folder(spark), "parquet", "[DOES NOT TIE]")
    parts = [sources.read_any(spark, p).agg(F.lit(n).alias("name"), F.lit(p.rsplit("/", 1)[1]).alias("folder"), F.count("*").alias("n")) for n, p in sorted(paths.items())]
    return parts[0].unionAll(parts[1])


@query("SELECT 0::BIGINT AS rows, 'entry_id,amount' AS columns")
def sink_template(spark, sf_dir):
    """An empty table of a worklist's columns."""
    t = sources.template(spark, "entry_id string, amount decimal(18,2)")
    return t.agg(F.count("*").alias("rows"), F.lit(",".join(t.columns)).alias("columns"))


@query("SELECT po_no, open, owner, CAST(periods AS INTEGER) AS periods FROM (SELECT p.po_no, CAST(sum(qty_ordered) AS DECIMAL(18,2)) AS open, CASE WHEN bool_or(po_date < DATE '2025-01-01') THEN 'owner of ' || p.po_no END AS owner, CASE WHEN bool_or(po_date < DATE '2025-01-01') THEN 2 ELSE 1 END AS periods FROM pos p WHERE po_no IS NOT NULL GROUP BY 1)")
def sink_worklist(spark, sf_dir):
    """Open orders whose worklist of the run before is written, read and carried forward."""
    pos = table(spark, sf_dir, "pos").where("po_no is not null")
    items = pos.groupBy("po_no").agg(cents(F.sum("qty_ordered")).alias("open"))
    before = sources.carry_forward(pos.where("po_date < date'2025-01-01'").groupBy("po_no").agg(F.count("*").alias("n")), None, "po_no", ["owner"])
    path = sources.write_tabs({"worklist": before.withColumn("owner", F.concat(F.lit("owner of "), "po_no"))}, _folder(spark))["worklist"]
    return sources.carry_forward(items, sources.read_any(spark, path), "po_no", ["owner"])


@query("SELECT row_id, lower(trim(status)) IN ('y', 'yes', 'true', '1') AS flag, CAST(trunc(qty_ordered) AS INTEGER) AS whole, coalesce(CAST(unit_price AS DECIMAL(18,2)), 0)::DECIMAL(18,2) AS price FROM pos")
def fn_flags(spark, sf_dir):
    """Flags, whole numbers and amounts that count as zero where blank, from texts."""
    p = table(spark, sf_dir, "pos")
    return p.select("row_id", F.when(F.col("status").isNotNull(), money.truthy(F.col("status"))).alias("flag"), money.whole(F.col("qty_ordered").cast("string")).alias("whole"), money.zero_if_blank(cents("unit_price").cast("string")).alias("price"))


@query("""SELECT account, trim(regexp_replace(regexp_replace(replace(lower(coalesce(account_name, '')), '&', 'and'), '[^a-z0-9]+', ' ', 'g'), ' +[0-9]+ *$', '')) AS account_key, trim(regexp_replace(lower(regexp_replace(coalesce(description, ''), '[.,]', '', 'g')), '\\s+', ' ', 'g')) AS payer_key, regexp_replace(lower(coalesce(entry_id, '')), '[^a-z0-9]', '', 'g') AS number_key, count(*) AS n FROM je_entries GROUP BY ALL""")
def fn_name_keys(spark, sf_dir):
    """Keys of account names, payers and document numbers."""
    return table(spark, sf_dir, "je_entries").select("account", text.account_key(F.col("account_name")).alias("account_key"), text.payer_key(F.col("description")).alias("payer_key"), text.number_key(F.col("entry_id")).alias("number_key")).groupBy("account", "account_key", "payer_key", "number_key").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, '***-**-****' || ' ' || c_name AS masked, right(c_name, 4) AS tail FROM customer")
def fn_mask(spark, sf_dir):
    """Identity numbers masked inside a text, and the end of a number."""
    n = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    ssn = F.concat_ws("-", F.substring(n, 1, 3), F.substring(n, 4, 2), F.substring(n, 6, 4))
    return table(spark, sf_dir, "customer").select("c_custkey", text.mask(F.concat_ws(" ", ssn, "c_name")).alias("masked"), F.expr("right(c_name, 4)").alias("tail"))


@query("SELECT o_custkey, CAST(json_extract(to_json({'n': count(*), 'total': CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR)}), '$.n') AS BIGINT) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS VARCHAR) AS total FROM orders GROUP BY 1")
def fn_json(spark, sf_dir):
    """Nested values to text and back."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), cents(F.sum(cents("o_totalprice"))).cast("string").alias("total"))
    j = g.select("o_custkey", F.from_json(F.to_json(F.struct("n", "total")), "n long, total string").alias("j"))
    return j.select("o_custkey", "j.n", "j.total")


@query("SELECT o_custkey, bool_and(o_orderstatus = 'F') AS all_done, bool_or(o_totalprice > 400000) AS any_large FROM orders GROUP BY 1")
def agg_any_all(spark, sf_dir):
    """Whether all or any rows of a group hold."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") == "F").alias("all_done"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_large"))


@query("SELECT row_id, abs(original_amount - open_balance) <= greatest(1.00, greatest(abs(original_amount), abs(open_balance)) * 0.005) AS close FROM aging WHERE original_amount IS NOT NULL AND open_balance IS NOT NULL")
def flt_close(spark, sf_dir):
    """Equal within the larger of a floor and a half percent."""
    a = table(spark, sf_dir, "aging").where("original_amount is not null and open_balance is not null")
    return a.select("row_id", predicates.close(F.col("original_amount"), F.col("open_balance"), D("1.00"), D("0.5")).alias("close"))


_LIMITS = [("6120", "GL-UK", D(500)), ("6120", None, D(800)), (None, "GL-DE", D(900)), (None, None, D(2000))]


@query("""WITH s AS (SELECT account, source, CAST(sum(coalesce(debit, 0) - coalesce(credit, 0)) AS DECIMAL(18,2)) AS net FROM je_entries GROUP BY 1, 2) SELECT account, source, net, CAST(CASE WHEN account = '6120' AND source = 'GL-UK' THEN 500 WHEN account = '6120' THEN 800 WHEN source = 'GL-DE' THEN 900 ELSE 2000 END AS DECIMAL(18,2)) AS allowed FROM s WHERE abs(net) > CASE WHEN account = '6120' AND source = 'GL-UK' THEN 500 WHEN account = '6120' THEN 800 WHEN source = 'GL-DE' THEN 900 ELSE 2000 END""")
def flt_scoped_limit(spark, sf_dir):
    """Variances strictly beyond the limit of the most specific scope: both, account, source, all."""
    s = table(spark, sf_dir, "je_entries").groupBy("account", "source").agg(cents(F.sum(zero("debit") - zero("credit"))).alias("net"))
    limits = spark.createDataFrame(_LIMITS, "account string, source string, allowed decimal(18,2)")
    return predicates.scoped_limit(s, limits, ["account", "source"], "allowed").where(F.abs("net") > F.col("allowed")).select("account", "source", "net", "allowed")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice > 60000 AND o_totalprice < 400000 THEN 'mid' WHEN o_totalprice > 450000 THEN 'high' END AS range, CASE WHEN o_totalprice BETWEEN 50000 AND 60000 THEN 2 WHEN o_totalprice BETWEEN 400000 AND 450000 THEN 2 ELSE 1 END::BIGINT AS matches FROM orders")
def join_range_table(spark, sf_dir):
    """The one range of a table of ranges that holds a value."""
    ranges = spark.createDataFrame([("low", None, D(60000)), ("mid", D(50000), D(450000)), ("high", D(400000), None)], "name string, low decimal(18,2), high decimal(18,2)")
    return joins.one_range_of(table(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("amount")), "o_orderkey", "amount", ranges)


@query("SELECT 100.00::DECIMAL(18,2) AS after, 120.00::DECIMAL(18,2) AS before, 'gap' AS kind UNION ALL SELECT 300.00, 250.00, 'overlap'")
def join_tier_gaps(spark, sf_dir):
    """Where the tiers of a plan leave a gap or overlap."""
    return joins.gaps_and_overlaps(spark.createDataFrame([(D(0), D(100)), (D(120), D(200)), (D(200), D(300)), (D(250), None)], "low decimal(18,2), high decimal(18,2)"))


@query("""WITH t(request, place, term) AS (SELECT form, min(CAST(row AS BIGINT)), description FROM (SELECT form, lower(trim(regexp_replace(description, '[^A-Za-z0-9]+', ' ', 'g'))) AS description, row_number() OVER (ORDER BY field_id, form, description) AS row FROM version_a WHERE description IS NOT NULL) WHERE description <> '' GROUP BY 1, 3), d AS (SELECT doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), ' ') || ' ' AS x FROM documents WHERE text IS NOT NULL)
SELECT request, doc_id, min(term) AS term FROM t JOIN d ON contains(x, ' ' || term || ' ') GROUP BY 1, 2""")
def join_terms_table(spark, sf_dir):
    """Documents that name a term of a table of terms, with the first term in the alphabet."""
    terms = table(spark, sf_dir, "version_a").where("description is not null").select(F.col("form").alias("request"), F.lower(F.trim(F.regexp_replace("description", "[^A-Za-z0-9]+", " "))).alias("term")).where("term != ''").distinct().withColumn("place", F.col("term"))
    return joins.terms_in(table(spark, sf_dir, "documents"), "doc_id", "text", terms)


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_checked_broadcast(spark, sf_dir):
    """A join that broadcasts a side only once its size is known."""
    r = joins.checked_broadcast(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name"))
    return table(spark, sf_dir, "nation").join(r, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@query("""WITH o AS (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS b, CAST(CASE WHEN o_orderstatus = 'F' THEN round(o_totalprice * 0.9, 2) ELSE o_totalprice END AS DECIMAL(18,2)) AS a FROM orders) SELECT count(*) AS n, count(*) FILTER (b <> a) AS wrong FROM o WHERE b >= 400000""")
def sample_projection(spark, sf_dir):
    """Items of an interval or more are all in a monetary sample, at their own difference."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("book"), cents(F.when(F.col("o_orderstatus") == "F", F.round(cents("o_totalprice") * D("0.9"), 2)).otherwise(cents("o_totalprice"))).alias("audited"))
    picked = monetary_sample(o, "o_orderkey", "book", D(400000), 7).where("basis = 'top'").select("o_orderkey")
    p = project(o.join(picked, "o_orderkey"), "book", "audited", D(400000))
    return p.where("projected = book - audited").agg(F.count("*").alias("n"), F.count_if(F.col("projected") != 0).alias("wrong"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS a, CAST(o_orderdate AS DATE) AS d, o_orderstatus = 'F' AS dep FROM orders), x AS (SELECT a.o_orderkey AS deposit_id, b.o_orderkey AS invoice_id, count(*) OVER (PARTITION BY a.o_orderkey) AS n FROM r a JOIN r b ON a.dep AND NOT b.dep AND a.o_custkey = b.o_custkey AND a.a = b.a)
SELECT r.o_orderkey AS deposit_id, CASE WHEN n = 1 THEN invoice_id END AS invoice_id, CASE WHEN n = 1 THEN 'exact' WHEN n > 1 THEN 'ambiguous' ELSE 'open' END AS state FROM r LEFT JOIN (SELECT deposit_id, max(n) AS n, max(invoice_id) AS invoice_id FROM x GROUP BY 1) q ON q.deposit_id = r.o_orderkey WHERE dep""")
def match_exact_or_ambiguous(spark, sf_dir):
    """Deposits with just one open invoice of their amount, with several, and with none."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey", cents("o_totalprice").alias("a"), (F.col("o_orderstatus") == "F").alias("dep"))
    inv = o.where("not dep").groupBy("o_custkey", "a").agg(F.count("*").alias("n"), F.max("k").alias("invoice_id"))
    j = o.where("dep").join(inv, ["o_custkey", "a"], "left")
    return j.select(F.col("k").alias("deposit_id"), F.when(F.col("n") == 1, F.col("invoice_id")).alias("invoice_id"), F.when(F.col("n") == 1, "exact").when(F.col("n") > 1, "ambiguous").otherwise("open").alias("state"))


@query("""WITH m AS (SELECT o_custkey AS c, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (year(o_orderdate) = 1997) AS DECIMAL(18,2)) AS p, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (year(o_orderdate) = 1998) AS DECIMAL(18,2)) AS n FROM orders WHERE year(o_orderdate) IN (1997, 1998) GROUP BY 1), s AS (SELECT coalesce(p, 0) AS p, coalesce(n, 0) AS n, CASE WHEN coalesce(p, 0) = 0 AND coalesce(n, 0) > 0 THEN 'new' WHEN coalesce(n, 0) = 0 AND p > 0 THEN 'churn' WHEN n > p THEN 'expansion' WHEN n < p THEN 'contraction' ELSE 'no change' END AS kind FROM m)
SELECT kind, count(*) AS customers, CAST(sum(n - p) * 12 AS DECIMAL(18,2)) AS change FROM s GROUP BY 1 UNION ALL SELECT 'identity', count(*), CAST(sum(p) * 12 + sum(n - p) * 12 - sum(n) * 12 AS DECIMAL(18,2)) FROM s""")
def eng_arr_waterfall(spark, sf_dir):
    """Recurring revenue, twelve times the month's: new, lost, more and less, and the identity that proves it."""
    o = table(spark, sf_dir, "orders").where(F.year("o_orderdate").isin(1997, 1998))
    of = lambda y: zero(F.sum(F.when(F.year("o_orderdate") == y, cents("o_totalprice"))))
    m = stored(o.groupBy("o_custkey").agg(cents(of(1997)).alias("p"), cents(of(1998)).alias("n")), "recurring")
    p, n = F.col("p"), F.col("n")
    kind = F.when((p == 0) & (n > 0), "new").when((n == 0) & (p > 0), "churn").when(n > p, "expansion").when(n < p, "contraction").otherwise("no change")
    by = m.groupBy(kind.alias("kind")).agg(F.count("*").alias("customers"), cents(F.sum(n - p) * 12).alias("change"))
    return by.unionAll(m.agg(F.lit("identity").alias("kind"), F.count("*").alias("customers"), cents(F.sum(p) * 12 + F.sum(n - p) * 12 - F.sum(n) * 12).alias("change")))


@query("""WITH d AS (SELECT customer, invoice_no, due_date, open_balance, date_diff('day', due_date, DATE '2025-12-31') AS late FROM aging WHERE open_balance > 0 AND due_date < DATE '2025-12-31' AND customer IS NOT NULL), t AS (SELECT customer, count(*) AS invoices, CAST(sum(open_balance) AS DECIMAL(18,2)) AS total, CAST(min(due_date) AS DATE) AS oldest, max(late) AS late FROM d GROUP BY 1)
SELECT customer, invoices, total, oldest, CASE WHEN late <= 30 THEN 'reminder' WHEN late <= 60 THEN 'second' ELSE 'final' END AS tier FROM t""")
def eng_dunning(spark, sf_dir):
    """Overdue customers with their total, oldest due day and the one tier of the policy they fall in."""
    a = table(spark, sf_dir, "aging").where("open_balance > 0 and customer is not null").where(F.col("due_date").cast("date") < F.lit("2025-12-31").cast("date"))
    late = F.datediff(F.lit("2025-12-31").cast("date"), F.col("due_date").cast("date"))
    t = stored(a.groupBy("customer").agg(F.count("*").alias("invoices"), cents(F.sum("open_balance")).alias("total"), F.min(F.col("due_date").cast("date")).alias("oldest"), F.max(late).alias("late")), "overdue")
    policy = spark.createDataFrame([("reminder", 1, 30), ("second", 31, 60), ("final", 61, None)], "name string, low int, high int")
    tiers = joins.one_range_of(t, "customer", "late", policy)
    return t.join(tiers, "customer").select("customer", "invoices", "total", "oldest", F.col("range").alias("tier"))


@query("""WITH l AS (SELECT DISTINCT account, coalesce(nullif(debit, 0), credit) AS a, posted_by FROM je_entries WHERE posted_by IS NOT NULL) SELECT posted_by, count(DISTINCT account) AS accounts, count(*) AS amounts, CAST(sum(a) AS DECIMAL(18,2)) AS total, CAST(rank() OVER (ORDER BY sum(a) DESC NULLS LAST, posted_by) AS INTEGER) AS place FROM l GROUP BY 1""")
def eng_user_profile(spark, sf_dir):
    """What each user posts: accounts, distinct amounts, their sum and place."""
    je = table(spark, sf_dir, "je_entries").where("posted_by is not null")
    g = je.select("account", F.coalesce(F.when(F.col("debit") != 0, F.col("debit")), "credit").alias("a"), "posted_by").distinct().groupBy("posted_by").agg(F.count_distinct("account").alias("accounts"), F.count("*").alias("amounts"), cents(F.sum("a")).alias("total"))
    return g.withColumn("place", F.rank().over(Window.orderBy(F.col("total").desc_nulls_last(), "posted_by")))  # a row a user
