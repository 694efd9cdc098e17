import datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from ledgerloom.gates import GateFailure
from ledgerloom.plans import engines

DAY = datetime.date(2025, 3, 1)


def day(n):
    return DAY + datetime.timedelta(n)


def test_duplicate_payments(spark):
    rows = [
        (1, "I1", "Acme Ltd", D(10), day(0)), (2, "I1", "Acme Ltd", D(10), day(90)), (3, "I2", "Acme Ltd", D(10), day(20)), (4, "I3", "ACME, Inc.", D(10), day(30)), (5, "I4", "Acme Ltd", D(11), day(0)),
        (6, None, "Acme Ltd", D(10), None), (7, "I9", None, D(10), day(0)), (8, "I8", "Acme Ltd", None, day(0)), (9, "I7", "Zed", D(0), day(0)), (10, "I7", "Zed", D(0), day(0)), (11, "I1", "Acme Ltd", D(10), day(0)),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "row_id long, invoice_no string, vendor string, amount decimal(18,2), day date, tier int")
    assert {(r.tier, r.first_row, r.other_row) for r in engines.duplicate_payments(df, 45).collect()} == {(1, 1, 2), (1, 1, 11), (2, 1, 3), (3, 1, 4), (3, 3, 4)}
    assert engines.duplicate_payments(df.where("false")).count() == 0


def test_duplicates_with_dates_of_every_layout(spark, tmp_path):
    texts = ["2025-03-01", "03.02.2025", "Mar 3, 2025", "20250304", "45721", "no date"]  # the serial day is 2025-03-05
    rows = [(i, f"I{i}", "Acme Ltd", None, None, None, D(1), D(10), "10.00", t, "s") for i, t in enumerate(texts)]
    schema = "row_id long, invoice_no string, vendor string, po_no string, po_line int, item string, qty_billed decimal(18,6), unit_price decimal(18,6), extended_amount string, invoice_date string, source string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/invoices.parquet")
    spark.createDataFrame([("s", "UTC", "MDY")], "source string, tz_name string, date_order string").write.parquet(f"{tmp_path}/source_systems.parquet")
    got = {(r.tier, r.first_row, r.other_row) for r in engines.eng_duplicate_payments(spark, str(tmp_path)).collect()}
    assert got == {(2, a, b) for a in range(5) for b in range(a + 1, 5)}


def test_aging_gate_catches_a_planted_error(spark):
    rows = [(1, "c", "i1", day(0), D("19875.00"), "Current"), (2, "c", "i2", day(-40), D("100.00"), "1-30"), (3, None, "i3", None, D("-5.00"), None)]
    df = spark.createDataFrame(rows, "row_id long, customer string, invoice_no string, invoice_date date, open_balance decimal(18,2), reported_bucket string")
    result = engines.aging_tie(df, str(DAY), general_ledger=D("19952.00"))
    with pytest.raises(GateFailure) as e:
        result.require()
    assert "2 the aging ties" in str(e.value) and "3 buckets" in str(e.value) and "4 every item" in str(e.value) and "1 customers" not in str(e.value)
    diff = {r.num: r.difference for r in result.gates.collect()}
    assert diff[2] == D("18.00") and result.require(force=True) == "[DOES NOT TIE]"
    assert engines.aging_tie(df.where("false"), str(DAY)).tables["customers"].count() == 0


def test_three_way_outcomes(spark):
    inv = spark.createDataFrame([(1, "P1", 1, "a", D(5), D(10)), (2, "P1", 1, "a", D(6), D(10)), (3, None, 1, "a", D(5), D(10)), (4, "P9", 1, "a", D(5), D(10)), (5, "P1", 7, "b", D(1), D(99))], "row_id long, po_no string, po_line int, item string, qty_billed decimal(18,6), unit_price decimal(18,6)")
    po = spark.createDataFrame([(1, "P1", 1, "a", D(10), D(10)), (2, "P1", 2, "b", D(10), D(10)), (3, "P1", 1, "a", D(10), D(10))], "row_id long, po_no string, po_line int, item string, qty_ordered decimal(18,6), unit_price decimal(18,6)")
    got = spark.createDataFrame([("P1", 1.0, D(5)), ("P1", 3.0, D(2))], "po_no string, po_line double, qty_received decimal(18,6)")
    result = engines.three_way_match(inv, po, got)
    assert {r.row_id: set(r.outcomes) for r in result.tables["lines"].collect()} == {1: set(), 2: {"over order"}, 3: {"no order"}, 4: {"order not found"}, 5: {"price", "not received"}}
    assert result.require() == "" and [(r.po_line, r.open) for r in result.tables["received_not_billed"].collect()] == [(3, D(2))]


def test_journal_flags(spark):
    schema = "line_id long, entry_id string, line_no int, effective_date string, account string, account_name string, debit decimal(18,2), credit decimal(18,2), description string, posted_by string, approved_by string"
    rows = [(1, "e1", 1, "2025-01-01", "10", "Cash", D(5000), None, "plug", "u", "u"), (2, "e1", 2, "2025-01-01", "20", None, None, D(4999), None, "u", "u"), (3, "e2", 1, "2025-01-01", "10", "Cash", D(5000), None, "A full description", "v", None), (4, "e2", 2, "2025-01-01", "30", "Sales", None, D(5000), "", "v", None)]
    got = {r.entry_id: set(r.codes.split()) for r in engines.journal_flags(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"e1": {"ROUND", "SELFAPPROVED", "GENERICDESC", "RAREACCOUNT", "DUPEXACT", "UNBALANCED"}, "e2": {"ROUND", "UNAPPROVED", "RAREACCOUNT", "DUPEXACT"}}


def test_legs_and_spread_add_up(spark):
    p = spark.createDataFrame([(1, D("10.01"), "a", "b", day(0), day(31))], "id long, amount decimal(18,2), dr string, cr string, day date, nxt date")
    legs = engines.two_legs(p, "id", "amount", "dr", "cr", "nxt")
    assert legs.count() == 4 and legs.agg(F.sum("debit") - F.sum("credit")).first()[0] == 0 and legs.where("kind = 'reversal' and account = 'a'").first().credit == D("10.01")
    rows = spark.createDataFrame([(1, D("10.01"), "x"), (2, D("7.00"), "none"), (3, D("0.00"), "x")], "id long, a decimal(18,2), b string")
    out = engines.spread(rows, "id", "a", "b", [("x", 1, D("33.33")), ("x", 2, D("33.33"))])
    assert {(r.id, r.week): r.amount for r in out.collect()} == {(1, 1): D("3.34"), (1, 2): D("3.34"), (1, 0): D("3.33"), (2, 0): D("7.00")}


def test_deferral_identity_and_bounds(spark):
    rows = [(1, D("120.00"), day(-31), day(-31), day(28)), (2, D("60.00"), day(3), day(3), day(200)), (3, D("10.00"), day(40), day(40), day(50)), (4, None, day(0), day(0), day(1)), (5, D("5.00"), day(0), day(5), day(1)), (6, D("9.00"), day(-90), day(-90), day(-60))]
    df = spark.createDataFrame(rows, "id long, a decimal(18,2), inv date, s date, e date")
    out = {r.id: r for r in engines.deferral_waterfall(df, "id", "a", "inv", "s", "e", ("2025-03-01", "2025-03-31")).collect()}
    assert set(out) == {1, 2, 6} and all(r.beginning + r.additions - r.recognised == r.ending for r in out.values())
    assert (out[1].beginning, out[1].recognised, out[1].ending) == (D("58.00"), D("58.00"), D("0.00")) and out[6].beginning == 0 and out[2].additions == D("60.00")


def test_straight_line_splits_and_statements(spark):
    df = spark.createDataFrame([(1, D("100.00"), 4, day(0), D(0)), (2, D("100.00"), 4, day(-400), D("90.00")), (3, D("100.00"), 0, day(0), None)], "id long, c decimal(18,2), life int, since date, prior decimal(18,2)")
    assert {r.id: r.expected for r in engines.straight_line(df, "id", "c", "life", "since", "prior", 2025).collect()} == {1: D("12.50"), 2: D("10.00"), 3: None}
    claims = spark.createDataFrame([("u", "d", D(60)), ("u", "d", D(60)), ("v", "d", D(60)), ("v", "e", D(60)), (None, "d", D(99)), (None, "d", D(99)), ("w", "d", D(150)), ("w", "d", D(10))], "u string, d string, a decimal(18,2)")
    assert [(r.u, r.n) for r in engines.split_claims(claims, ["u", "d"], "a", D(100)).collect()] == [("u", 2)]
    a = spark.createDataFrame([("1", D(5)), ("2", D(5)), ("3", D("5.01"))], "k string, amount decimal(18,2)")
    b = spark.createDataFrame([("1", D(2)), ("1", D(3)), ("3", D(6)), ("4", D(1))], "k string, amount decimal(18,2)")
    assert {r.k: r.state for r in engines.statement_recon(a, b, ["k"]).collect()} == {"1": "matched", "2": "missing in ledger", "3": "disputed", "4": "not on statement"}
    assert engines.statement_recon(a.where("false"), b.where("false"), ["k"]).count() == 0
