import datetime
import random
from decimal import Decimal as D
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.functions import dates, money, text
from ledgerloom.gates import GateFailure, Result, gates, same_rows
from ledgerloom.operators import joins, predicates, windows
from ledgerloom.operators.formula import formula
from ledgerloom.operators.matching import allocate, match_ledgers, residual_matches, subset_sum
from ledgerloom.operators.sampling import monetary_sample, positions, random_sample, stratified_sample
from ledgerloom.plans import ledger_queries
from ledgerloom.sources import tables as sources
from ledgerloom.streaming import events as streams

DAY = datetime.date(2025, 1, 1)


def day(n):
    return DAY + datetime.timedelta(n)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_money(spark):
    cases = {"1,234.50": "1234.50", "$5": "5.00", "(7.1)": "-7.10", "8-": "-8.00", "-": None, "--": None, "n/a": None, "": None, None: None, "abc": None, " $ 3 ": "3.00", "-0": "0.00", "1,23": None}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", money.money(F.col("s")).alias("m"), money.is_money(F.col("s")).alias("ok")).collect()
    assert {r.s: (None if r.m is None else str(r.m)) for r in rows} == cases
    assert {r.s for r in rows if not r.ok} == {"abc", "1,23"}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.decimals(min_value=-(10**12), max_value=10**12, places=2), min_size=1, max_size=20))
def test_canonical_numbers_keep_value(spark, numbers):
    df = spark.createDataFrame([(f"{n:,}",) for n in numbers], "s string").select(money.canonical_number(F.col("s")).alias("c"))
    assert [D(r.c) for r in df.collect()] == numbers


def test_dates_and_text(spark):
    d = lambda s: F.lit(s).cast("date")
    assert one(spark, dates.tolerant_date(F.lit("1-Mar-2025 10:00"))) == datetime.date(2025, 3, 1)
    assert one(spark, dates.tolerant_date(F.lit("2/30/2025"))) is None
    assert one(spark, dates.months_elapsed(d("2025-01-31"), d("2025-02-28"))) == 0
    assert one(spark, dates.overlap_days(d("2025-01-01"), d("2025-01-10"), d("2025-01-10"), d("2025-02-01"))) == 1
    assert one(spark, dates.recurrences(d("2025-01-31"), d("2025-03-28"), "monthly")) == [datetime.date(2025, m, 28) for m in (1, 2, 3)]
    assert one(spark, dates.recurrences(d("2025-01-01"), d("2025-01-20"), "biweekly")) == [day(0), day(14)]
    assert one(spark, text.generic_text(F.lit(" Reclass - 12 "))) and one(spark, text.generic_text(F.lit("per controller"))) and not one(spark, text.generic_text(F.lit("Monthly depreciation per schedule")))
    assert one(spark, text.mask(F.lit("id 123-45-6789."))) == "id ***-**-****."
    assert one(spark, text.parsed_sum(F.lit("18000; -3200;x"))) == D("14800.00") and one(spark, text.parsed_sum(F.lit("x"))) is None
    letter, complete = text.render("{a} {b}", {"a": F.lit(1)})
    assert one(spark, letter) == "1 {b}" and one(spark, complete) is False


def test_predicates(spark):
    m = lambda v: one(spark, predicates.round_modulus(F.lit(D(v))))
    assert (m("250000"), m("999"), m("1000"), m("21000"), m("-50000"), m("1234.56")) == (50000, None, 1000, None, 50000, None)
    assert one(spark, predicates.just_below(F.lit(D(9600)), [D(10000), D(9700)])) == D(10000)
    assert one(spark, predicates.close(F.lit(D(100)), F.lit(D(101)), D("0.5"), D(1))) is True
    assert one(spark, predicates.wrong_sign(F.lit(D(-1)), F.lit("asset"), ("asset",), F.lit(False))) is True
    assert one(spark, predicates.wrong_sign(F.lit(D(-1)), F.lit("asset"), ("asset",), F.lit(True))) is False


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=2, max_size=8), st.integers(2, 80))
def test_subset_sum(amounts, target):
    want = next((c for k in range(2, min(6, len(amounts)) + 1) for c in combinations(range(len(amounts)), k) if sum(amounts[i] for i in c) == target), None)
    assert subset_sum(amounts, target) == want


def test_residual_passes():
    bank = [(1, 100, 10, frozenset({"alpha"})), (2, 300, 10, frozenset()), (3, 70, 10, frozenset({"x", "y"})), (4, 40, 10, frozenset())]
    book = [(11, 100, 13, frozenset()), (12, 100, 11, frozenset()), (13, 200, 9, frozenset()), (14, 100, 12, frozenset()), (15, 70, 90, frozenset({"x", "y", "z"})), (16, 41, 10, frozenset())]
    assert residual_matches(bank, book, 5, 0.6, 14) == [(1, 12, "nearest_date"), (3, 15, "tokens"), (2, 13, "many_to_one"), (2, 11, "many_to_one")]


def test_ledger_cascade(spark):
    schema = "account string, id long, date date, amount decimal(18,2), check_no string, tokens array<string>, place int"
    bank = [("a", 1, day(0), D(5), "c1", None), ("a", 2, day(0), D(7), None, None), ("a", 3, day(3), D(9), None, None), ("a", 4, day(0), D(0), None, None), (None, 5, day(0), D(5), None, None), ("b", 6, day(0), D(30), None, None)]
    book = [("a", 11, day(40), D(5), "c1", None), ("a", 12, day(0), D(7), None, None), ("a", 13, day(1), D(9), None, None), ("b", 14, day(1), D(10), None, None), ("b", 15, day(1), D(20), None, None)]
    frame = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], schema)
    got = {(r.bank_id, r.book_id, r.rule) for r in match_ledgers(frame(bank), frame(book)).collect()}
    assert got == {(1, 11, "check_amount"), (2, 12, "amount_date"), (3, 13, "nearest_date"), (6, 14, "many_to_one"), (6, 15, "many_to_one")}
    assert match_ledgers(frame([]), frame(book)).collect() == []


def test_allocation_against_a_walk(spark):
    r = random.Random(1)
    d = [(c, 100 * c + i, day(r.randrange(9)), D(r.randrange(-5, 40))) for c in range(4) for i in range(8)]
    v = [(c, 1000 + 100 * c + i, day(r.randrange(9)), D(r.randrange(-5, 40))) for c in range(4) for i in range(8)]
    want = {}
    for c in range(4):
        inv = [[x[1], x[3]] for x in sorted(v, key=lambda x: (x[2], x[1])) if x[0] == c and x[3] > 0]
        for x in sorted(d, key=lambda x: (x[2], x[1])):
            left = x[3] if x[0] == c else 0
            while left > 0 and inv:
                part = min(left, inv[0][1])
                want[x[1], inv[0][0]] = part
                left, inv[0][1] = left - part, inv[0][1] - part
                if inv[0][1] == 0:
                    inv.pop(0)
    got = allocate(spark.createDataFrame(d, "customer long, deposit_id long, date date, amount decimal(18,2)"), spark.createDataFrame(v, "customer long, invoice_id long, date date, open decimal(18,2)"))
    assert {(x.deposit_id, x.invoice_id): x.applied for x in got.collect()} == want


def test_joins(spark):
    left = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "b", "z"), (4, None, None)], "id long, k string, item string")
    right = spark.createDataFrame([("a", "x", 10), ("c", "y", 20), ("c", "y", 21), ("b", "z", 30)], "k string, item string, v int")
    got = joins.priority_join(left, "id", [(right, ["k"], False), (right, ["item"], True)], ["v"])
    assert {(r.id, r.v, r["rank"]) for r in got.collect()} == {(1, 10, 1), (2, 30, 1), (3, 30, 1), (4, None, None)}
    r = random.Random(2)
    rows = [(i, r.choice("ab"), day(r.randrange(40))) for i in range(60)] + [(99, "a", None)]
    pairs = joins.band_pairs(spark.createDataFrame(rows, "id long, k string, d date"), "id", ["k"], "d", 3)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] and b[2] and abs((a[2] - b[2]).days) <= 3}
    got = [(x.a, x.b) for x in pairs.collect()]
    assert set(got) == want and len(got) == len(want)
    links = {x.id: (x.links, x.before) for x in joins.band_links(spark.createDataFrame(rows, "id long, k string, d date"), "id", ["k"], "d", 3).collect()}
    assert {i: n for i, (n, _) in links.items()} == {i: sum(i in p for p in want) for i in {x for p in want for x in p}}
    assert all(b is None or (min(i, b), max(i, b)) in want for i, (_, b) in links.items())
    assert joins.checked_broadcast(left, 2).count() == 4
    spans = joins.tier_split(spark.createDataFrame([("g", 1, D(60)), ("g", 2, D(80))], "g string, i int, a decimal(18,2)"), "g", ["i"], "a", [(D(0), D(100), D(1)), (D(100), None, D(2))])
    assert [(x.i, x.tier, x.portion) for x in spans.orderBy("i", "tier").collect()] == [(1, 1, D(60)), (2, 1, D(40)), (2, 2, D(40))]


def test_balance_breaks_against_a_walk(spark):
    r = random.Random(3)
    rows, want = [], {}
    for g in range(5):
        prior, true = D(0), D(0)
        for i in range(30):
            a = D(r.randrange(-50, 50))
            true += a
            printed = None if r.random() < 0.3 else true + (1 if r.random() < 0.1 else 0)
            expected = prior + a
            if printed is not None and printed != expected:
                want[g, i] = printed - expected
            prior = printed if printed is not None else expected
            rows.append((g, i, a, printed))
    got = windows.balance_breaks(spark.createDataFrame(rows, "g long, i long, a decimal(18,2), p decimal(18,2)"), "g", "i", "a", "p")
    assert {(x.g, x.i): x.difference for x in got.collect()} == want


@pytest.mark.parametrize("start", ["0", "3.5", "9.99"])
def test_monetary_units_against_a_walk(spark, start):
    r = random.Random(4)
    rows = [(i, D(r.randrange(-3, 14))) for i in range(200)]
    hit, cum, want = D(start), D(0), {}
    for i, v in rows:
        if v >= 10:
            want[i] = 1
        elif v > 0:
            cum += v
            while hit <= cum:
                want[i] = want.get(i, 0) + 1
                hit += 10
    got = windows.monetary_hits(spark.createDataFrame(rows, "id long, v decimal(18,2)"), "id", "v", D(10), D(start), part=30)
    assert {x.id: x.hits for x in got.collect()} == want


def test_samples(spark, monkeypatch):
    from ledgerloom.operators import sampling

    monkeypatch.setattr(sampling, "RANGE", 20)
    df = spark.range(100).select("id", (F.col("id") * 3).cast("decimal(18,2)").alias("v"))
    assert sorted(r.id for r in random_sample(df, "id", 10, 5).collect()) == sorted(random.Random(5).sample(range(100), 10))
    assert random_sample(df, "id", 100, 5).count() == 100
    assert sorted(r.position for r in positions(df, [F.col("id")]).collect()) == list(range(100))
    rng = random.Random(5)
    top = [i for i in range(99, -1, -1) if i * 3 >= 150]
    low = [i for i in range(99, 0, -1) if i * 3 < 150]
    want = {top[j] for j in rng.sample(range(len(top)), 4)} | {low[j] for j in rng.sample(range(len(low)), 3)}
    assert {r.id for r in stratified_sample(df, "id", "v", [D(150)], [4, 3], 5).collect()} == want
    assert monetary_sample(df.where("false"), "id", "v", D(10), 1).count() == 0


def test_annuity(spark):
    rows = one(spark, windows.annuity_schedule(F.lit(D("100.00")), F.lit(0.01), F.lit(3)))
    assert rows[-1].balance == 0 and rows[0].interest == D("2.94") and sum(r.interest + r.principal for r in rows) == D("300.00")


def test_formula(spark):
    cols = {"a": F.lit(D(10)), "b": F.lit(D(4))}
    assert one(spark, formula("(a - b) * -2 + 1.5", cols)) == D("-10.5") and one(spark, formula("a / (b - 4)", cols)) is None
    for bad in ("a +", "a b", "c", "(a", "a ** b", "__import__('os')"):
        with pytest.raises(ValueError):
            formula(bad, cols)


def test_gates(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    t = same_rows(a, a.where("x = 2"))
    g = gates(spark, [("tie", t, F.col("missing"), F.col("missing") == 0), ("skipped", t, None, F.lit(None).cast("boolean")), ("surplus", t, F.col("surplus"), F.col("surplus") == 0)])
    result = Result({"a": a}, g)
    with pytest.raises(GateFailure, match="1 tie"):
        result.require()
    assert result.require(force=True) == "[DOES NOT TIE]" and result.failed() == ["1 tie"]
    assert Result({}, g.where("num > 1")).require() == ""


def test_sources(spark, tmp_path):
    f = tmp_path / "in.csv"
    f.write_bytes('﻿Name,amount\n"A, b",1\n"two\nlines",\n'.encode())
    rows = sources.scan_csv(spark, str(f), ["name", "amount", "missing"]).collect()
    assert [tuple(r) for r in rows] == [("A, b", "1", None), ("two\nlines", None, None)]
    assert sources.scan_csv(spark, str(tmp_path / "no.csv"), ["a"], optional=True).count() == 0
    (tmp_path / "e.csv").write_text("a\n")
    with pytest.raises(sources.Empty):
        sources.scan_csv(spark, str(tmp_path / "e.csv"), ["a"], required=True)
    unique, repeated = sources.keyed(spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string"), ["k", "v"])
    assert unique.count() == 1 and repeated.first().n == 2
    for kind in ("parquet", "csv", "json", "orc"):
        paths = sources.write_tabs({"tab": spark.range(3)}, str(tmp_path / kind), kind, "[INCOMPLETE]")
        assert paths["tab"].endswith("tab.INCOMPLETE") and sources.read_any(spark, paths["tab"], kind, "id long", header="true").count() == 3
    assert sources.template(spark, "a int").columns == ["a"]
    assert sources.read_any(spark, str(f), "binary").count() == 1


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, datetime.datetime(2025, 1, 1, i % 20, i % 60), f"u{i % 3}", float(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, u string, v double")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    batch = streams.windowed(df, "ts", "u", "v", "1 hour", "30 minutes", "0 seconds")
    # In append mode windows come out once the watermark has passed them, which the last ones of a stream never see.
    out = streams.run_to_end(spark, streams.windowed(stream, "ts", "u", "v", "1 hour", "30 minutes", "0 seconds"), str(tmp_path / "c"), str(tmp_path / "o"))
    done = {tuple(r) for r in out.collect()}
    assert len(done) > 50 and done <= {tuple(r) for r in batch.collect()}
    assert streams.sessions(df, "ts", "u").count() > 3 and streams.deduplicated(df.unionAll(df), "ts", ["id"]).count() == 100


def test_recurrences_of_every_order(spark):
    at = "/root/testdata/sf0.001"
    got = {r.o_orderkey: (r.n, r.m) for r in ledger_queries.fn_recurrences(spark, at).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.min("due").alias("m")).collect()}
    want = {r.o_orderkey: (12 * (2001 - r.day.year) + 13 - r.day.month, r.day.replace(day=min(r.day.day, 28))) for r in ledger_queries.orders(spark, at).collect()}
    assert got == want and min(m for _, m in want.values()).year < 2001


def test_groups_of_a_ledger_are_matched_as_the_whole_account(spark):
    r = random.Random(11)
    words = ["rent", "fee", "tax", "freight", "loan"]
    schema = "account string, id long, date date, amount decimal(18,2), check_no string, tokens array<string>"
    row = lambda i: (r.choice("xyz"), i, day(r.choice([0, 40, 80, 3650]) + r.randrange(14)), D(r.randrange(1, 12)) * r.choice([1, 1, -1]), None, r.sample(words, r.randrange(3)))
    bank, book = [row(i) for i in range(120)], [row(1000 + i) for i in range(120)]
    got = match_ledgers(spark.createDataFrame(bank, schema), spark.createDataFrame(book, schema)).collect()
    exact = {(x.bank_id, x.book_id) for x in got if x.rule == "amount_date"}
    want = set()
    for account in "xyz":
        flat = lambda rows, used: [(i, int(a * 100), d.toordinal(), frozenset(t)) for acc, i, d, a, _, t in rows if acc == account and i not in used]  # noqa: B023, E731
        want |= set(residual_matches(flat(bank, {a for a, _ in exact}), flat(book, {b for _, b in exact}), 5, 0.6, 14))
    assert {(x.bank_id, x.book_id, x.rule) for x in got if x.rule != "amount_date"} == want
    assert {x.rule for x in got} == {"amount_date", "nearest_date", "tokens", "many_to_one", "one_to_many"}
