import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.mixing import TOKENIZER, document_uses, draw, mix, pack, permuted, token_counts


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"w": 0, "[UNK]": 1}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    path = tmp_path_factory.mktemp("t") / "words.json"
    t.save(str(path))
    return str(path)


def docs(spark, rows):
    return spark.createDataFrame([(i, s, t, 1, 1) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, block int, tokens int")


TARGETS = "source string, target_share double, max_repeats int"


def test_shares_caps_and_report(spark, vocabulary):
    rows = [("big", "w " * 50)] * 200 + [("small", "w " * 30)] * 10 + [("other", "w " * 500)] * 5 + [(None, "w w"), ("big", None), ("big", ""), ("big", "w " * 2000)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.3, 3), ("none", 0.1, 2), ("big", None, None)], TARGETS)
    chosen, pieces, report = mix(docs(spark, rows), targets, tokens=10_000, tokenizer=vocabulary, block=16, shard=100)
    r = {x.source: x for x in report.collect()}
    assert abs(r["big"].tokens - 6000) < 700 and r["big"].drawn_slots >= r["big"].slots and abs(r["big"].share - 0.6 - r["big"].deviation) < 1e-5 and r["small"].tokens <= 900 and r["small"].most_repeats == 3 and r["none"].tokens == 0 and set(r) == {"big", "small", "none"}
    assert abs(sum(x.share for x in r.values()) - 1) < 1e-4
    assert chosen.groupBy("source", "block", "use").count().where("count > 1").count() == 0
    uses = document_uses(chosen, pieces).groupBy("source").agg(F.max("uses")).collect()
    assert {x.source: x[1] for x in uses} == {"big": 1, "small": 3}
    assert pieces.groupBy("source", "block").agg(F.sum("tokens").alias("n")).where("n > 16").count() == 0
    assert pieces.agg(F.sum("tokens")).first()[0] == 200 * 50 + 10 * 30 + 2000
    again = mix(docs(spark, rows), targets, tokens=10_000, tokenizer=vocabulary, block=16, shard=100)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, chosen.collect()))


def test_pack_covers_each_document_once_in_chunks(spark):
    counts = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.pmod("id", F.lit(9)) * 5).cast("long").alias("tokens"))
    pieces = pack(counts, block=32, chunk=50)
    assert pieces.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.min("first").alias("f")).join(counts, "doc_id").where("n != tokens or f != 0").count() == 0
    assert pieces.groupBy("block").agg(F.sum("tokens").alias("n")).where("n != 32").count() <= 1


def test_draws_are_multinomial(spark):
    rows = draw(spark, [("a", 0.25), ("b", 0.75)], 100_050, shard=100, group=7).collect()
    assert sum(r.n for r in rows) == 100_050 and {r.shard for r in rows} == set(range(1001))
    n = np.array([r.n for r in sorted(rows, key=lambda r: r.shard) if r.source == "a" and r.shard < 1000])
    assert abs(n.mean() - 25) < 0.7 and 15 < n.var() < 23  # 100 draws of a quarter: a variance of 18.75
    base = {(r.source, r.shard): r.base for r in rows}
    assert all(base["a", k] == n[:k].sum() for k in range(1000))
    assert sorted(map(tuple, draw(spark, [("a", 0.25), ("b", 0.75)], 100_050, shard=100, group=7).collect())) == sorted(map(tuple, rows))
    assert draw(spark, [], 10).count() == 0 and draw(spark, [("a", 1.0)], 0).count() == 0 and {r.n for r in draw(spark, [("a", 0.0)], 5).collect()} == {0}


def test_ranks_and_whole_tokenizers_count_alike(spark):
    import os

    if not os.path.exists(TOKENIZER):
        pytest.skip("no vocabulary here")
    texts = [("s", "It's 24 cents -- naïve, 東京  \n\n<|endoftext|>"), ("s", ""), ("s", None), ("s", "x" * 20_000)]
    a, b = (sorted((r.doc_id, r.tokens) for r in token_counts(docs(spark, texts), t).collect()) for t in (TOKENIZER, TOKENIZER.replace(".tiktoken", ".json")))
    assert a == b and dict(a)[1] == dict(a)[2] == 0


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    df = spark.range(n).select(permuted(F.col("id"), F.lit(n).cast("long"), F.lit(99).cast("long")).alias("x"))
    assert sorted(r.x for r in df.collect()) == list(range(n)) and np.array([r.x for r in df.collect()]).shape == (n,)


def test_empty(spark, vocabulary):
    chosen, pieces, report = mix(docs(spark, []), spark.createDataFrame([("a", 1.0, 1)], TARGETS), tokenizer=vocabulary)
    assert chosen.count() == 0 and [(r.source, r.tokens, r.share) for r in report.collect()] == [("a", 0, 0.0)]
    assert mix(docs(spark, [("a", "w")]), spark.createDataFrame([], TARGETS), tokenizer=vocabulary)[2].count() == 0
