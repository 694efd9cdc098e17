import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.hierarchy import descendants, hierarchy


def brute(parent):
    nodes = set(parent) | {p for p in parent.values() if p}
    out = {}
    for v in nodes:
        chain, x, seen = [], v, set()
        while x is not None and x not in seen:
            seen.add(x)
            chain.append(x)
            x = parent.get(x)
        if x is None:
            out[v] = (chain[-1], len(chain) - 1, tuple(reversed(chain)))
        else:
            ring, y = [x], parent[x]
            while y != x:
                ring.append(y)
                y = parent[y]
            out[v] = (min(ring), -1, None)
    return out


def solve(spark, pairs, fragment=25):
    df = spark.createDataFrame(pairs, "p string, c string").withColumn("node", F.lit("clash")).withColumn("place", F.lit(1))
    return {r.node: (r.root, r.depth, tuple(r.path) if r.path else None) for r in hierarchy(df, F.col("p"), F.col("c"), True, fragment).collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force(spark, seed):
    r = random.Random(seed)
    parent = {}
    for i in range(150):
        m = r.random()
        if seed:  # long chains
            parent[f"n{i:03}"] = f"n{i - 1:03}" if i and m < 0.95 else (f"n{r.randrange(150):03}" if m < 0.98 else None)
        else:
            parent[f"n{i:03}"] = f"n{r.randrange(150):03}" if m < 0.75 else None
    pairs = [(p, c) for c, p in parent.items()] * 2
    assert solve(spark, pairs) == brute(parent)


def test_nulls_repeats_self_loops_and_several_parents(spark):
    got = solve(spark, [("t", None), ("a", "b"), ("a", "b"), (None, "lone"), (None, None), ("s", "s"), ("s", "under"), ("y", "m"), ("x", "m")])
    assert got == {"t": ("t", 0, ("t",)), "a": ("a", 0, ("a",)), "b": ("a", 1, ("a", "b")), "lone": ("lone", 0, ("lone",)), "s": ("s", -1, None), "under": ("s", -1, None), "x": ("x", 0, ("x",)), "y": ("y", 0, ("y",)), "m": ("x", 1, ("x", "m"))}


def test_empty(spark):
    assert solve(spark, []) == {}


def test_hot_parent_and_descendants(spark):
    df = spark.range(300).select(F.lit("top").alias("p"), F.concat(F.lit("c"), F.col("id")).alias("c")).unionAll(spark.createDataFrame([("c7", "deep")], "p string, c string"))
    got = descendants(df, F.col("p"), F.col("c"), fragment=40)
    assert got.where("ancestor = 'top'").count() == 301
    assert got.where("descendant = 'deep'").orderBy("distance").select("ancestor", "distance").collect() == [("c7", 1), ("top", 2)]
