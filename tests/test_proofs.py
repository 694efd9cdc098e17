import datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import joins, predicates
from ledgerloom.plans import closing, proofs
from ledgerloom.sources.tables import carry_forward, scan_csv, write_tabs

TB = "account string, name string, net decimal(18,2), kind string"


def day(n):
    return datetime.date(2025, 6, 15) + datetime.timedelta(n)


def gates(df):
    return {r.num: (r.passed, r.skipped, None if r.difference is None else float(r.difference)) for r in df.collect()}


def test_checks_of_one_table(spark):
    df = spark.createDataFrame([(1, D(5)), (2, None)], "i int, v decimal(18,2)")
    tests = {(1, "zero"): F.sum(F.lit(0)), (2, "off"): F.sum("v"), (3, "missing"): F.max(F.lit(None).cast("int")), (4, "noted"): F.sum("i")}
    assert gates(proofs.checks(df, tests, noted=(4,))) == {1: (True, False, 0), 2: (False, False, 5), 3: (True, True, None), 4: (True, False, 3)}
    assert gates(proofs.checks(df.where("false"), {(1, "empty"): F.count("*")})) == {1: (True, False, 0)}


def test_planted_errors_of_a_trial_balance(spark):
    good = [("1000", "Bank", D(70), "asset"), ("1590", "Accumulated depreciation", D(-20), "asset"), ("2000", "Payables", D(-40), "liability"), ("4000", "Sales", D(-30), "revenue"), ("6000", "Rent", D(20), "expense")]
    mapping = spark.createDataFrame([(r[0], "line") for r in good], "account string, line string")
    none = spark.createDataFrame([], TB)
    run = lambda rows, prior=none: gates(proofs.balance_proof(spark.createDataFrame(rows, TB), mapping, prior))
    assert all(p for p, _, _ in run(good).values())
    bad = [*good[:3], ("4000", "Sales", D(30), "revenue"), ("6000", "Rent & rates 2", D(20), "expense"), ("6001", "rent and rates", D(1), "expense"), ("1100", "Odd", D(0), "expense")]
    failed = {n for n, (p, _, _) in run(bad, spark.createDataFrame([good[0]], TB)).items() if not p}
    assert failed == {1, 2, 4, 5, 6, 7, 8}


def test_journal_and_filing_gates(spark):
    je = spark.createDataFrame([("e1", 1, D(5), None), ("e1", 2, None, D(5)), ("e2", 1, D(5), D(5)), ("e3", 1, D(7), None), ("e3", 1, D(7), None), (None, 1, None, D(1))], "entry_id string, line_no int, debit decimal(18,2), credit decimal(18,2)")
    assert {n: d for n, (_, _, d) in gates(proofs.journal_proof(je)).items()} == {1: 13, 2: 1, 3: 1, 4: 2, 5: 1}
    schema = "field_id string, value string, is_carryforward boolean, changed_at timestamp_ntz"
    a = spark.createDataFrame([("T", "10", False, None), ("C", "10", True, None), ("X", "1", False, None)], schema)
    b = spark.createDataFrame([("t ", "10", False, datetime.datetime(2025, 8, 1)), ("C", "12", True, None)], schema)
    totals = spark.createDataFrame([("T", "C"), ("T", None)], "total_field_id string, component_field_id string")
    assert {n for n, (p, _, _) in gates(proofs.filing_proof(a, b, totals, "2025-06-30")).items() if not p} == {4, 5, 6, 7}


def test_cutoff_and_accruals(spark):
    items = spark.createDataFrame([(1, "A", day(0), "big printer", D(1)), (2, None, day(0), "small printer", D(1)), (3, "Z", day(0), "desk", D(1)), (4, "Z", None, "desk", D(1)), (5, "Z", day(99), "desk", D(1))], "row_id long, ref string, day date, item string, amount decimal(18,2)")
    got = proofs.cutoff_states(items, spark.createDataFrame([("A",), ("A",), (None,)], "ref string"), spark.createDataFrame([("Printer rental",), (None,)], "text string"), "item", "2025-06-30")
    assert {r.row_id: r.state for r in got.collect()} == {1: "recorded", 2: "accrued", 3: "not recorded", 4: "unclassified", 5: "after"}
    key = "po_no string, po_line int, "
    o = spark.createDataFrame([("P", i, D(2)) for i in range(1, 5)] + [(None, 1, D(2))], key + "unit_price decimal(18,6)")
    r = spark.createDataFrame([("P", 1, D(5)), ("P", 1, D(5)), ("P", 2, D(4)), ("P", 3, D(1))], key + "qty_received decimal(18,6)")
    i = spark.createDataFrame([("P", 1, D(4)), ("P", 2, D(4)), ("P", 3, D(3))], key + "qty_billed decimal(18,6)")
    assert {x.po_line: (x.state, x.outstanding) for x in proofs.accruals(o, r, i).collect()} == {1: ("proposed", D(12)), 2: ("fully invoiced", D(0)), 3: ("invoiced beyond receipt", D(-4)), 4: ("no receipt", D(0))}


def test_cash_flow_and_revaluation(spark):
    row = "account string, name string, net decimal(18,2)"
    f = closing.cash_flow(spark.createDataFrame([("1000", "Bank", D(10)), ("1200", "Due", D(5)), ("3000", "Equity", D(-15))], row), spark.createDataFrame([("1000", "Bank", D(40)), ("1500", "Plant", D(5)), ("3000", "Equity", D(-45))], row))
    assert {r.account: (r.section, r.effect) for r in f.collect()} == {"1000": ("cash", D(30)), "1200": ("working capital", D(5)), "1500": ("investing", D(-5)), "3000": ("financing", D(30))}
    b = spark.createDataFrame([("a", "EUR", D(100), D(100)), ("b", "EUR", D("1.25"), D("1.3")), ("c", "XXX", D(5), D(5))], "k string, currency string, foreign decimal(18,2), recorded decimal(18,2)")
    got = closing.revalue(b, spark.createDataFrame([("EUR", D("1.3"))], "currency string, rate decimal(9,4)"), spark.createDataFrame([("b",), ("b",)], "k string"), ["k"])
    assert {r.k: (r.revalued, r.gain, r.realised, r.judgement) for r in got.collect()} == {"a": (D(130), D(30), False, True), "b": (D("1.62"), D("0.32"), True, True), "c": (None, None, False, False)}


def test_clearance_reconciliation_and_traces(spark):
    schema = "{} long, ref string, amount decimal(18,2), day date"
    items = spark.createDataFrame([(1, "r", D(5), day(0)), (2, "r", D(5), day(1)), (3, "s", D(7), day(0)), (4, None, D(1), day(0)), (5, "t", D(2), day(0))], schema.format("item_id"))
    later = spark.createDataFrame([(10, "r", D(5), day(30)), (11, "s", D(6), day(30)), (12, "t", D(2), day(2)), (13, None, D(1), day(30))], schema.format("line_id"))
    assert {r.item_id: (r.cleared_by, r.state) for r in closing.clearance(items, later, "2025-06-30").collect()} == {1: (10, "cleared"), 2: (None, "never cleared"), 3: (11, "cleared for another amount"), 4: (None, "never cleared"), 5: (12, "cleared before the end")}
    rows = "account string, id long, amount decimal(18,2)"
    rec = closing.bank_reconciliation(spark.createDataFrame([("a", 1, D(10)), ("a", 2, D(-3))], rows), spark.createDataFrame([("a", 5, D(10)), ("a", 6, D(4)), ("a", 7, D(-1))], rows), spark.createDataFrame([(1, 5)], "bank_id long, book_id long")).collect()
    assert [(r.closing_bank, r.closing_book, r.transit, r.outstanding, r.unrecorded, r.difference) for r in rec] == [(D(7), D(13), D(4), D(-1), D(-3), D(0))]
    trace = closing.revenue_trace(spark.createDataFrame([(i, D(10)) for i in range(4)], "ref long, booked decimal(18,2)"), spark.createDataFrame([(0, D(10), 1, 0), (1, D(9), 1, 2), (2, D(10), 0, 0)], "ref long, contract decimal(18,2), shipped long, credits long"))
    assert {r.ref: r.state for r in trace.collect()} == {0: "agreed", 1: "differs", 2: "no delivery", 3: "no contract"}


def test_prepaid_never_loses_a_cent(spark):
    rows = [(i, D(100 + i) / 3, day(-40 * i), day(-40 * i + 30 * i)) for i in range(1, 12)] + [(99, None, day(0), day(5)), (98, D(5), day(5), day(0))]
    df = spark.createDataFrame([(i, None if a is None else round(a, 2), s, e) for i, a, s, e in rows], "i long, a decimal(18,2), s date, e date")
    months = [closing.prepaid(df, "i", "a", "s", "e", (2024 + m // 12, m % 12 + 1)).select("i", "current").collect() for m in range(0, 48)]
    total = {}
    for m in months:
        for r in m:
            total[r.i] = total.get(r.i, 0) + r.current
    assert total == {i: round(a, 2) for i, a, s, e in rows if a is not None and s <= e}


def test_policies_as_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, D(5)), (2, D(15)), (3, None), (4, D(99))], "i long, v decimal(18,2)")
    ranges = spark.createDataFrame([("a", None, D(10)), ("b", D(10), D(20)), ("c", D(15), D(30))], "name string, low decimal(18,2), high decimal(18,2)")
    assert {r.i: (r.range, r.matches) for r in joins.one_range_of(rows, "i", "v", ranges).collect()} == {1: ("a", 1), 2: (None, 2), 3: (None, 0), 4: (None, 0)}
    docs = spark.createDataFrame([(1, "The LEASE of the depot."), (2, "released"), (3, None)], "d long, t string")
    terms = spark.createDataFrame([("x", 1, "depot"), ("x", 0, "lease of"), ("y", 0, "..")], "request string, place int, term string")
    assert [tuple(r) for r in joins.terms_in(docs, "d", "t", terms).collect()] == [("x", 1, "lease of")]
    limits = spark.createDataFrame([("A", "x", D(1)), ("a", None, D(2)), (None, "x", D(3)), (None, None, D(4))], "a string, s string, m decimal(18,2)")
    some = spark.createDataFrame([("a ", "X"), ("a", "y"), ("b", "x"), (None, None)], "a string, s string")
    assert [r.m for r in predicates.scoped_limit(some, limits, ["a", "s"], "m").collect()] == [D(1), D(2), D(3), D(4)]
    path = write_tabs({"t": spark.createDataFrame([("b", "2"), ("a", "1")], "k string, v string").coalesce(1)}, f"file://{tmp_path}", "csv")["t"]
    assert [tuple(r) for r in scan_csv(spark, path, ["V", "none"], row_number="row").orderBy("row").collect()] == [("2", None, 1), ("1", None, 2)]
    first = carry_forward(spark.createDataFrame([("p",), ("q",)], "k string"), None, "k", ["owner"])
    again = carry_forward(spark.createDataFrame([("p",), ("r",)], "k string"), first.withColumn("owner", F.lit("me")), "k", ["owner"])
    assert {r.k: (r.owner, r.periods) for r in again.collect()} == {"p": ("me", 2), "r": (None, 1)}


def test_name_keys(spark):
    df = spark.createDataFrame([("A&B  Rent, Ltd. 02", "St. John, A.", "INV-01/x"), (None, None, None)], "a string, p string, n string")
    assert [tuple(r) for r in df.select(text.account_key(F.col("a")), text.payer_key(F.col("p")), text.number_key(F.col("n"))).collect()] == [("aandb rent ltd", "st john a", "inv01x"), ("", "", "")]


def test_journal_tests(spark):
    at = lambda n, h=12: datetime.datetime.combine(day(n), datetime.time(h))
    # 2025-06-15 is a Sunday
    rows = [
        ("a", "1000", "Bank", D(9), None, "cash sale", "u1", None, "HUB", day(1), at(1)), ("a", "4000", "Sales", None, D(9), "cash sale", "u1", None, "HUB", day(1), at(1)), ("b", "6000", "Rent", D(60000), None, "", "u1", None, "GL", day(0), at(10, 22)),
        ("c", "2990", "Clearing", D(8), None, "accrued rent", "u9", None, "GL", day(15), at(15)), ("d", "6000", "Rent", D(3000), None, "x1", "u1", None, "GL", day(3), at(3)), ("e", "6000", "Rent", D(3000), None, "x2", "u1", "f", "GL", day(3), at(20)), ("f", "6000", "Rent", D(2), None, "accrued fee", "u1", None, "GL", day(14), at(14)), (None, "1", "n", D(1), None, None, None, None, None, None, None),
    ]
    schema = "entry_id string, account string, account_name string, debit decimal(18,2), credit decimal(18,2), description string, posted_by string, reversal_of string, source string, day date, stamp timestamp_ntz"
    got = closing.journal_tests(spark.createDataFrame(rows, schema), spark.createDataFrame([("u1",)], "posted_by string"), spark.createDataFrame([(day(1),)], "day date"), "2025-06-30", F.col("source") == "HUB", D(50000), D(5000))
    by = {}
    for r in got.collect():
        by.setdefault(r.entry_id, set()).add(r.code)
    assert by == {
        "a": {"MANUAL", "HOLIDAY", "REVENUEMANUAL", "CASHREVENUE"}, "b": {"WEEKEND", "AFTERHOURS", "POSTLAG", "BLANKDESC", "MATERIAL"}, "c": {"PERIODEND", "SUSPENSE", "UNREVERSED", "UNAUTHUSER"},
        "d": {"DUPNEAR", "SPLIT"}, "e": {"DUPNEAR", "SPLIT", "REVAMOUNT", "POSTLAG", "POSTAFTERCLOSE"}, "f": {"PERIODEND", "WEEKEND"},
    }
    assert {r.entry_id: (r.codes, r.score) for r in closing.scored(got).collect()}["d"] == ("DUPNEAR SPLIT", 6)
