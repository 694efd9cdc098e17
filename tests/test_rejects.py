import csv
import io
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.operators.rejects import Parser, is_money_text, load_lines, parse_lines, read_record, rejected_lines, rejected_records

GOOD = 'Firm "X",S-1,2025-01-01,2025-02-01,10.00,"$1,234.50-",1-30,30,trade'


def test_reasons_in_order(spark):
    data = [
        (1, "aging", GOOD), (2, "aging", '"Firm",S-1,2025-01-01,2025-02-01,10,(12.00),1-30,30,trade'), (3, "aging", 'Firm,"S-1,2025-01-01'), (4, "aging", '"Firm"x,S-1,a,b,c,bad,e,f,g'), (5, "aging", "a,b"),
        (6, "aging", "a,b,c,d,e,1O.00,g,h,i"), (7, "aging", ""), (8, "aging", None), (9, None, "a,b"), (10, "other", "a"), (11, "aging", '"two\nlines",b,c,d,e,n/a,g,h,i'), (12, "entries", "e,1,d,t,a,n,--, ,x,,,s,"), (13, "entries", "e,1,d,t,a,n,12,5x,x,,,s,"), (1, "aging", GOOD),
    ]
    lines = spark.createDataFrame([(*d, "clash") for d in data], "line_id long, feed string, raw_text string, reason string")
    assert {(r.line_id, r.reason) for r in rejected_lines(lines).collect()} == {(3, "quoting"), (4, "quoting"), (5, "column_count"), (6, "invalid_value"), (7, "column_count"), (8, "column_count"), (9, "column_count"), (10, "column_count"), (13, "invalid_value")}
    loaded = {r.line_id: r for r in load_lines(lines).collect()}
    assert sorted(loaded) == [1, 2, 11, 12] and load_lines(lines).count() == 5
    assert str(loaded[1].open_balance) == "-1234.50" and str(loaded[2].open_balance) == "-12.00" and loaded[11].customer == "two\nlines" and loaded[12].debit is None


def test_good_records_behind_a_broken_one_load(spark):
    bad, broken = GOOD.replace('"$1,234.50-"', "1O.00"), 'Firm,"S-1,2025-01-01'
    data = [(1, "aging", 'c,"bad,x\n' + GOOD), (2, "aging", f"{GOOD}\n{broken}\nrest\n{GOOD}\n{bad}\n"), (3, "aging", broken + "\na,b\nc,d"), (4, "aging", f"{GOOD}\n{GOOD}"), (5, "aging", f"{bad}\na,b\n{broken}")]
    lines = spark.createDataFrame([(*d, "clash") for d in data], "line_id long, feed string, raw_text string, record string")
    rows = {}
    for r in parse_lines(lines).orderBy("line_id", "record").collect():
        rows.setdefault(r.line_id, []).append(r.reason or "loaded")
    assert rows == {1: ["quoting", "loaded"], 2: ["loaded", "quoting", "loaded", "invalid_value"], 3: ["quoting"], 4: ["loaded", "loaded"], 5: ["invalid_value", "column_count", "quoting"]}
    at = {(r.line_id, r.record): r.start for r in parse_lines(lines).collect()}
    assert at[1, 2] == len('c,"bad,x\n') + 1 and at[4, 2] == len(GOOD) + 2
    assert {(r.line_id, r.reason) for r in rejected_lines(lines).collect()} == {(1, "quoting"), (2, "quoting"), (3, "quoting"), (5, "quoting")}
    assert rejected_records(lines).count() == 7 and load_lines(lines).count() == 5


def test_values_that_cannot_be_read_are_named(spark):
    lines = spark.createDataFrame([(1, "aging", "c,i,d,d,abc,5,1-30,zzz,t"), (2, "invoices", "n,v,d,p,x1,i,1.5,nope,3,n/a,r"), (3, "aging", "c,i,d,d,7,5,1-30,30,t"), (4, "aging", "c,i,d,d,,5,1-30, ,t")], "line_id long, feed string, raw_text string")
    assert {r.line_id: sorted(r.unread) for r in load_lines(lines).collect()} == {1: ["original_amount", "terms_days"], 2: ["po_line", "unit_price"], 3: [], 4: []}


def test_an_open_quote_before_many_lines_is_read_once():
    text = "".join(f'a,"{i}x" y\n' for i in range(5_000)) + 'b,"never closed\n' + "c\n" * 60_000
    began = time.time()
    assert read_record(text, "aging")[1] == "quoting" and time.time() - began < 20


def test_empty_table(spark):
    assert rejected_lines(spark.createDataFrame([], "line_id long, feed string, raw_text string")).collect() == []


def test_recovery_at_the_next_anchor():
    text = 'a,b,c\n"open,1,2\nd,e,f\nx,"y"z,w\ng,h,i\n'
    records = list(Parser(text, 3).parse())
    assert [r.fields for r in records if not r.error] == [["a", "b", "c"], ["d", "e", "f"], ["g", "h", "i"]]
    assert [(r.error, r.field) for r in records if r.error] == [("quoting", 1), ("quoting", 2)]
    assert text[records[1].at] == "y" and text[records[3].at] == "z"  # the first quote is closed by the second


def test_money():
    assert all(map(is_money_text, ["", " ", "-", "--", "N/A", "12", "$1,234.50", "-$5", "$-5", "5-", "(5)", "($5.10)", " .5 ", "1,234"]))
    assert not any(map(is_money_text, ["abc", "1,23", "12..5", "5--", "-5-", "(5", "1O", "$", "1e5", "12 50"]))


def test_very_long_text():
    text = ",".join(['"' + "x" * 300_000 + '"'] * 9)
    assert read_record(text, "aging")[1] == "invalid_value"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet='ab,"\n é', max_size=8), min_size=9, max_size=9))
def test_round_trip(fields):
    fields[5] = "1.00"
    out = io.StringIO()
    csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="").writerow(fields)
    assert read_record(out.getvalue(), "aging")[:2] == (fields, None)
