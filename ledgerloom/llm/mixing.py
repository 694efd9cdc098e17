"""Mixing sources to target shares of all tokens.

Documents are packed, source by source, into blocks of a fixed number of tokens. Every output shard draws how many of its
slots each source fills; the slots of a source, numbered through all shards, go through one pseudorandom permutation of its
blocks after another, so that each block is used once before any is used again; slots are joined to blocks by index.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.runtime import forget, stored

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pieces into which the byte-level vocabularies cut a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 128
SHARD = 8_192
#: Shards of one group, within which a running sum is taken.
SHARDS = 4_096
#: Documents of one chunk, within which a running sum is taken.
CHUNK = 20_000
SEED = 17


def _counter(vocabulary: str, ranks: bool):
    """A function from texts to their numbers of tokens."""
    if ranks:
        import tiktoken

        table = {base64.b64decode(a): int(n) for a, n in map(str.split, vocabulary.splitlines())}
        encoding = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=table, special_tokens={})
        return lambda texts: [len(encoding.encode_ordinary(t)) for t in texts]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(vocabulary)
    t.encode_special_tokens = True
    return lambda texts: [len(e.ids) for i in range(0, len(texts), 200) for e in t.encode_batch(texts[i : i + 200], add_special_tokens=False)]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of each document by the tokenizer in the file ``tokenizer``; 0 for a null or empty text.

    The file has ranks (``.tiktoken``) or is a whole tokenizer (``.json``); strings of special tokens are ordinary text.
    """
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = documents.sparkSession.sparkContext.broadcast(f.read())
    ranks = tokenizer.endswith(".tiktoken")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = _counter(vocabulary.value, ranks)
        for f in frames:
            n = count([x if isinstance(x, str) else "" for x in f["text"]])
            yield pd.DataFrame({"doc_id": f["doc_id"], "source": f["source"], "tokens": pd.Series(n, dtype="int64")})

    return documents.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, tokens long")


def pack(counts: DataFrame, block: int = BLOCK, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """(source, block, doc_id, first, tokens): the pieces of documents in each block; ``first`` is a piece's first token.

    The documents of a source follow one another in a pseudorandom order. Their places are running sums within chunks on top
    of the sums of the chunks before, so that no source is summed in one task.
    """
    some = counts.where((F.col("tokens") > 0) & F.col("source").isNotNull())
    sizes = some.groupBy("source").agg((F.floor(F.count("*") / chunk) + 1).alias("chunks"))
    placed = some.join(F.broadcast(sizes), "source").withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("chunks"))).drop("chunks")
    sums = placed.groupBy("source", "chunk").agg(F.sum("tokens").alias("sum"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "chunk", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "chunk").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.join(base, ["source", "chunk"]).withColumn("start", F.col("base") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))
    end = F.col("start") + F.col("tokens")
    pieces = at.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((end - 1) / block))))
    lo, hi = F.greatest("start", F.col("block") * block), F.least(end, (F.col("block") + 1) * block)
    return pieces.select("source", F.col("block").cast("long").alias("block"), "doc_id", (lo - F.col("start")).alias("first"), (hi - lo).alias("tokens"))


def draw(spark, targets: list[tuple[str, float]], slots: int, shard: int = SHARD, seed: int = SEED, group: int = SHARDS) -> DataFrame:
    """(shard, source, n, base): slots of each source in each shard, and how many its earlier shards have.

    The counts of a shard are one multinomial draw of its slots by the target shares, from a generator set by the seed and the
    shard's number, so that any shard can be drawn again by itself. Sums of earlier shards are taken within groups of shards
    on top of those of the groups before.
    """
    names, shares = [t[0] for t in targets], np.array([t[1] for t in targets], dtype=float)
    total = shares.sum()
    shards = max(1, -(-slots // shard))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i in f["id"]:
                size = min(shard, slots - i * shard)
                n = np.random.default_rng((seed, int(i))).multinomial(size, shares / total) if total > 0 else np.zeros(len(names), dtype=int)
                rows += [(int(i), s, int(k)) for s, k in zip(names, n, strict=True)]
            yield pd.DataFrame(rows, columns=["shard", "source", "n"])

    drawn = spark.range(shards).mapInPandas(run, "shard long, source string, n long") if names and slots else spark.createDataFrame([], "shard long, source string, n long")
    drawn = stored(drawn.withColumn("group", F.floor(F.col("shard") / group)), "draws")
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = drawn.groupBy("source", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("source", "group", before(Window.partitionBy("source").orderBy("group"), "n").alias("earlier"))
    within = drawn.withColumn("base", before(Window.partitionBy("source", "group").orderBy("shard"), "n"))
    return within.join(groups, ["source", "group"]).select("shard", "source", "n", (F.col("base") + F.col("earlier")).alias("base"))


def permuted(k: Column, n: Column, key: Column) -> Column:
    """Place of ``k`` in a pseudorandom permutation of 0..n-1 set by ``key``: a Feistel network, walked until it falls below n."""

    @F.pandas_udf("long")
    def feistel(k: pd.Series, n: pd.Series, key: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            x, size, salt = k.to_numpy(np.uint64), n.to_numpy(np.uint64), key.to_numpy(np.int64).astype(np.uint64)
            half = np.ones_like(size)
            while (short := (np.uint64(1) << (half * np.uint64(2))) < size).any():
                half = np.where(short, half + np.uint64(1), half)
            mask = (np.uint64(1) << half) - np.uint64(1)
            out, left = x.copy(), np.ones(len(x), dtype=bool)
            while left.any():
                v, m, h, s = out[left], mask[left], half[left], salt[left]
                a, b = v >> h, v & m
                for r in range(4):
                    z = (b + s + np.uint64(r + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
                    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                    a, b = b, a ^ ((z ^ (z >> np.uint64(32))) & m)
                out[left] = (a << h) | b
                left[left] = out[left] >= size[left]
        return pd.Series(out.astype(np.int64))

    return feistel(k, n, key)


def mix(documents: DataFrame, targets: DataFrame, tokens: int | None = None, tokenizer: str = TOKENIZER, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as (shard, slot, source, block, use), the pieces of its blocks, and a report by source.

    ``targets`` has source, target_share and max_repeats; it is collected, being one row a source. ``tokens`` is the size of
    the mix, by default that of all documents. Slots of a source beyond its blocks times max_repeats stay empty, and those of
    a source without documents: neither is filled with other sources, so the shares reached are reported. Documents of no
    listed source, or without tokens, aren't used. The report has the slots each source drew, those its cap left it, and
    ``deviation``, by how much the share reached differs from the target. A null share or number of repeats is 0. A source listed twice has the sum
    of its shares and the larger number of repeats.
    """
    spark = documents.sparkSession
    counts = stored(token_counts(documents, tokenizer), "tokens")
    wanted = targets.where("source is not null").groupBy("source").agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    goals = sorted((r.source, float(r.target_share), int(r.max_repeats)) for r in wanted.collect())  # one row a source
    goal_rows = F.broadcast(spark.createDataFrame(goals, "source string, target_share double, max_repeats int"))
    pieces = stored(pack(counts.join(F.broadcast(wanted.select("source")), "source"), block, seed=seed), "pieces")
    held = pieces.groupBy("source").agg((F.max("block") + 1).alias("blocks"), F.sum("tokens").alias("available"))
    size = tokens if tokens is not None else counts.agg(F.sum("tokens")).first()[0] or 0
    forget(counts)
    wished = -(-size // block)
    slots = stored(draw(spark, [g[:2] for g in goals], wished, shard, seed), "drawn")
    filled = slots.join(goal_rows, "source").join(F.broadcast(held), "source")  # both have a row for each source
    filled = filled.withColumn("n", F.least("n", F.greatest(F.lit(0), F.col("blocks") * F.col("max_repeats") - F.col("base")))).where("n > 0")
    each = filled.withColumn("k", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("n") - 1)))
    use = F.floor(F.col("k") / F.col("blocks")).cast("long")
    chosen = each.select("shard", "source", use.alias("use"), permuted(F.pmod("k", "blocks"), F.col("blocks"), F.xxhash64("source", use, F.lit(seed))).alias("block"), F.xxhash64("k", "source", F.lit(seed)).alias("order"))
    chosen = stored(chosen.withColumn("slot", F.row_number().over(Window.partitionBy("shard").orderBy("order", "source", "block", "use"))).drop("order"), "slots")
    in_block = pieces.groupBy("source", "block").agg(F.sum("tokens").alias("tokens"))
    used = chosen.join(in_block, ["source", "block"]).groupBy("source").agg(F.count("*").alias("slots"), F.sum("tokens").alias("tokens"), (F.max("use") + 1).alias("most_repeats"))
    report = goal_rows.join(slots.groupBy("source").agg(F.sum("n").alias("drawn")), "source", "left").join(held, "source", "left").join(used, "source", "left").withColumn("all", F.sum(F.coalesce("tokens", F.lit(0))).over(Window.partitionBy(F.lit(1))))
    zero = lambda c: F.coalesce(c, F.lit(0))
    report = report.select(
        "source", "target_share", "max_repeats", zero("available").alias("available_tokens"), zero("drawn").alias("drawn_slots"), zero("slots").alias("slots"), zero("tokens").alias("tokens"), zero("most_repeats").alias("most_repeats"),
        F.round(F.coalesce(F.col("tokens") / F.col("available"), F.lit(0.0)), 6).alias("repeats"), F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 6).alias("share"),
        F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)) - F.col("target_share"), 6).alias("deviation"),
    )
    return chosen, pieces, report


def document_uses(chosen: DataFrame, pieces: DataFrame) -> DataFrame:
    """(doc_id, source, uses, tokens): how often the most used token of each document is in the mix, and its tokens in all."""
    by_block = chosen.groupBy("source", "block").agg(F.count("*").alias("uses"))
    return pieces.join(by_block, ["source", "block"]).groupBy("doc_id", "source").agg(F.max("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
