from pyspark.sql import functions as F

from ledgerloom.operators.diff import diff_copies, diff_filings, text_content

SCHEMA = "field_id string, form string, line string, description string, value string, changed_at timestamp, is_carryforward boolean, sign int, content string"


def rows(spark, data):
    return spark.createDataFrame([(a, f, li, d, v, None, c, 1, "x") for a, f, li, d, v, c in data], SCHEMA)


def found(df):
    return {(r.key, r.diff) for r in df.collect()}


def test_every_kind_of_difference(spark):
    a = rows(spark, [("a1", "F", "L", "D", "1,000.50", True), ("a2", "F", "L", "D", "0", None), ("a3", "F", "L", None, "x", False), ("a4", "F", "L", "D", "1", True), (" a5 ", "F", "L", "D", "(12)", True)])
    b = rows(spark, [("A1 ", "F", " L", "D", "$1000.5", True), ("A2", "F", "L", "D", "", False), ("A3", "f", "L", " ", "X", False), ("A5", "F", "L", "D", "-12.00", True), ("A6", "F", "L", "D", "1", True)])
    assert found(diff_filings(a, b)) == {("A2", "value"), ("A2", "is_carryforward"), ("A3", "form"), ("A3", "value"), ("A4", "only_a"), ("A6", "only_b")}


def test_repeats_null_keys_and_long_texts(spark):
    long = "z" * 50_000
    a = rows(spark, [("k", "F", "L", long, "1", True)] * 3 + [(None, "F", "L", "D", "1", True)])
    b = rows(spark, [("K", "F", "L", long + "!", "1", True)])
    assert found(diff_filings(a, b)) == {("K", "description"), ("", "only_a")}


def test_several_rows_of_a_key_compare_as_sets(spark):
    a = rows(spark, [("k", "F", "L", "D", "1", True), ("k", "F", "L", "D", "2", True)])
    b = rows(spark, [("k", "F", "L", "D", "2.0", True), ("k", "F", "L", "D", "1", True)])
    assert found(diff_filings(a, b)) == set()
    assert found(diff_filings(a, b.limit(1))) == {("K", "value")}


def test_empty_tables(spark):
    a = rows(spark, [("k", "F", "L", "D", "1", True)])
    none = a.where("false")
    assert found(diff_filings(none, none)) == set()
    assert found(diff_filings(a, none)) == {("K", "only_a")}
    assert found(diff_filings(none, a)) == {("K", "only_b")}


def test_clashing_column_names(spark):
    a = spark.createDataFrame([("k", "1", "p")], "key string, field string, cell string")
    b = spark.createDataFrame([("k", "2", "p")], "key string, field string, cell string")
    assert found(diff_copies(a, b, F.col("key"), {"field": text_content, "cell": text_content})) == {("k", "field")}


def test_hot_key(spark):
    hot = spark.range(5000).select(F.lit("hot").alias("key"), F.pmod("id", F.lit(7)).cast("string").alias("v"))
    other = spark.range(6).select(F.lit("hot").alias("key"), F.col("id").cast("string").alias("v"))
    (r,) = diff_copies(hot, other, F.col("key"), {"v": text_content}).collect()
    assert (r.diff, r.cells_a, r.cells_b) == ("v", 714, 0)
