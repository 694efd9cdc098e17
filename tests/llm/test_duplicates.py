import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.llm.duplicates import Trie, collapse, copies, radix_buckets

SCHEMA = "row_id long, no string, vendor string, line int, qty decimal(18,6), amount string, bucket string, n int"
TEXTS, NUMBERS = ["no", "vendor"], ["line", "qty"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def pairs(df, **kw):
    return {(r.first_row_id, r.copy_row_id) for r in copies(df, "row_id", TEXTS, NUMBERS, "amount", **kw).collect()}


def test_formats(spark):
    d = Decimal
    rows = [
        (5, "INV-01", "Acme, Ltd.", 1, d("2.5"), "1,234.50"), (3, "inv 01", "ACME LTD", 1, d("2.500"), "$1234.5"), (9, "Acme Ltd", "INV01", 1, d("2.5"), " 1234.50 "), (4, "INV-01", "$ 1,234.50", 1, d("2.5"), "Acme Ltd"),
        (6, "INV-01", "Acme Ltd", 1, d("2.5"), "(1234.50)"), (7, "INV-01", "Ltd Acme", 1, d("2.5"), "1234.50"), (8, "INV-02", "Acme Ltd", 1, d("2.5"), "1234.50"), (10, None, None, None, None, None), (11, "", " ", None, None, ""), (12, "INV-01", "Acmé Ltd", 1, d("2.5"), "1234.50"), (13, "INV-01", "Acme Ltd", 1, d("25"), "1234.50"),
    ]
    assert pairs(frame(spark, rows)) == {(3, 5), (3, 9), (3, 4), (10, 11)}


def test_hot_group_long_texts_and_small_buckets(spark):
    rows = [(i, "hot", "v", 1, None, "1") for i in range(400)] + [(1000 + i, "x" * 20_000 + str(i % 40), "v", 1, None, "1") for i in range(80)] + [(2000 + i, f"n{i}", "v", 1, None, "2") for i in range(300)]
    got = pairs(frame(spark, rows), bucket_size=7)
    assert got == {(0, i) for i in range(1, 400)} | {(1000 + i, 1040 + i) for i in range(40)}


def test_counts_and_empty(spark):
    records, _ = collapse(frame(spark, [(1, "a", "b", 1, None, "1"), (2, "A", "b", 1, None, "1.0"), (3, "c", "b", 1, None, "1")]), "row_id", TEXTS, NUMBERS, "amount")
    assert {(r.first_row_id, r.copies) for r in records.collect()} == {(1, 2), (3, 1)}
    assert pairs(frame(spark, [])) == set()


def test_buckets_fit(spark):
    r = random.Random(1)
    texts = {"common" * 5 + "".join(r.choice("ab") for _ in range(12)) for _ in range(500)}
    keys, sizes = radix_buckets(spark.createDataFrame([(t,) for t in texts], "canon string"), 20)
    assert sizes.agg(F.max("rows"), F.sum("rows")).first()[:] == (sizes.agg(F.max("rows")).first()[0], len(texts)) and sizes.agg(F.max("rows")).first()[0] <= 20
    assert keys.where(~F.col("canon").startswith(F.col("bucket"))).count() == 0


def test_trie_counts():
    t, r, want = Trie(), random.Random(2), {}
    for i in range(2000):
        w = "".join(r.choice("abc") for _ in range(r.randrange(7)))
        t.add(w, 1, 5000 - i)
        n, least = want.get(w, (0, 9999))
        want[w] = (n + 1, min(least, 5000 - i))
    assert {w: (n, least) for w, n, least in t.terminals()} == want
