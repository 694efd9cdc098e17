"""Parent-child links of unknown depth to full hierarchies, by contracting fragments.

Every level of the recursion places the nodes in fragments of bounded size, contracts each parent chain inside a fragment
to the point where it leaves the fragment, and keeps as the next, smaller forest only the nodes that some other fragment's
chain enters. The first fragments are ranges of nodes, one a partition, so that chains of nodes named alike are contracted
where they stand; further ones are set by hash. Leaves drop out of each level. A node with one child is placed, by a coin of its own, in the fragment of its
child's side, so that long thin chains shrink by a constant share at each level, too. Once a forest fits in one fragment it
is solved there, and the levels are expanded again in reverse with one join each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.runtime import forget, stored

#: Nodes of one fragment; the dictionaries of one take some 10 MB.
FRAGMENT = 20_000
LEVELS = 64

#: up: first node outside the fragment, null at a top or a cycle; steps: links up to it; low: smallest node passed, itself
#: included; top and cycle: set where the chain ends inside.
CONTRACTED = "node string, up string, steps long, low string, top string, cycle string, trail array<string>"


def _contract(frames: Iterator[pd.DataFrame], trails: bool) -> Iterator[pd.DataFrame]:
    """Contract the chains of each fragment of this partition; rows are (place, node, parent, steps, low, trail)."""
    parts = list(frames)
    if not parts:
        return
    rows = pd.concat(parts, ignore_index=True)
    for _, own in rows.groupby("place", sort=False):
        link = {n: (p, s, low, t) for n, p, s, low, t in zip(own["node"], own["parent"], own["steps"], own["low"], own["trail"], strict=True)}
        done: dict[str, tuple] = {}
        for start in link:
            chain, at, seen = [], start, {}
            while at in link and at not in done and at not in seen:
                seen[at] = len(chain)
                chain.append(at)
                at = link[at][0]
            if at in seen:  # a cycle inside the fragment
                ring = chain[seen[at] :]
                least = min(link[x][2] for x in ring)
                for x in chain:
                    done[x] = (None, 0, least, None, least, None)
                continue
            for x in reversed(chain):
                p, s, low, trail = link[x]
                own_trail = list(trail) if trails else None
                if p is None:
                    done[x] = (None, 0, low, x, None, own_trail)
                elif p in done:
                    up, steps, low_up, top, cycle, above = done[p]
                    if cycle is not None:
                        done[x] = (None, 0, cycle, None, cycle, None)
                    else:
                        done[x] = (up, s + steps, min(low, low_up), top, None, own_trail + above if trails else None)
                else:
                    done[x] = (p, s, low, None, None, own_trail)
        yield pd.DataFrame([(n, *v) for n, v in done.items()], columns=["node", "up", "steps", "low", "top", "cycle", "trail"])


def _placed(forest: DataFrame, fragments: int, level: int) -> DataFrame:
    """Each node with the fragment it belongs to. A node whose parent has no other child joins its parent for a coin's throw."""
    spot = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(fragments))
    heads = lambda c: F.pmod(F.xxhash64(c, F.lit(-1 - level)), F.lit(2)) == 0
    if fragments == 1:
        return forest.withColumn("place", F.lit(0).cast("long"))
    only = forest.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n"), F.first("node").alias("child")).where("n = 1")
    joins = only.where(heads(F.col("parent")) & ~heads(F.col("child"))).select(F.col("child").alias("node"), F.lit(True).alias("joins"))
    return forest.join(joins, "node", "left").withColumn("place", F.when(F.col("joins"), spot(F.col("parent"))).otherwise(spot(F.col("node")))).drop("joins")


def _solve(forest: DataFrame, size: int, level: int, fragment: int, trails: bool, steps: list[DataFrame]) -> DataFrame:
    """(node, top, steps, cycle, trail) of each node of ``forest`` (node, parent, steps, low, trail; one row per node)."""
    if level > LEVELS:
        raise RuntimeError("the hierarchy didn't shrink")
    fragments = -(-size // fragment) if size > fragment else 1
    if fragments > 1 and level == 0:
        placed = forest.repartitionByRange(fragments, "node").withColumn("place", F.lit(0).cast("long"))
    else:
        placed = _placed(forest, fragments, level)
        placed = placed.repartition(fragments, "place") if fragments > 1 else placed.repartition(1)
    small = stored(placed.select("place", "node", "parent", "steps", "low", "trail").mapInPandas(lambda it: _contract(it, trails), CONTRACTED), f"fragments{level}")
    steps.append(small)
    if fragments == 1:
        return small.select("node", "top", "steps", "cycle", "trail")
    entered = small.where("up is not null").select(F.col("up").alias("node")).distinct()
    quotient = stored(small.join(entered, "node", "left_semi").select("node", F.col("up").alias("parent"), "steps", "low", "trail", "top", "cycle"), f"quotient{level}")
    steps.append(quotient)
    n = quotient.count()
    # Entries whose chain ended inside are the tops of the quotient; what they ended in is put back below.
    above = _solve(quotient.select("node", "parent", "steps", "low", F.when(F.col("parent").isNotNull(), F.col("trail")).otherwise(F.array().cast("array<string>")).alias("trail")), n, level + 1, fragment, trails, steps)
    ends = quotient.where("parent is null").select(F.col("node").alias("top"), F.col("top").alias("end_top"), F.col("steps").alias("end_steps"), F.col("cycle").alias("end_cycle"), F.col("trail").alias("end_trail"))
    joined_trail = (lambda a, b: F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))) if trails else (lambda a, b: F.lit(None).cast("array<string>"))
    solved = above.join(ends, "top", "left").select(
        F.col("node").alias("up"),
        F.col("end_top").alias("a_top"),
        (F.coalesce("steps", F.lit(0)) + F.coalesce("end_steps", F.lit(0))).alias("a_steps"),
        F.coalesce("cycle", "end_cycle").alias("a_cycle"),
        joined_trail(F.col("trail"), F.col("end_trail")).alias("a_trail"),
    )
    return small.join(solved, "up", "left").select(
        "node",
        F.coalesce("top", "a_top").alias("top"),
        (F.col("steps") + F.coalesce("a_steps", F.lit(0))).alias("steps"),
        F.coalesce("cycle", "a_cycle").alias("cycle"),
        F.when(F.col("up").isNull(), F.col("trail")).otherwise(joined_trail(F.col("trail"), F.col("a_trail"))).alias("trail"),
    )


def hierarchy(links: DataFrame, parent: Column, child: Column, paths: bool = False, fragment: int = FRAGMENT) -> DataFrame:
    """(node, root, depth, path) of every node named in ``links``.

    ``root`` is the topmost parent and ``depth`` the number of links up to it. A node on a circle or beneath one has the
    smallest node of the circle as root, depth -1 and no path. ``path`` runs from the root to the node and is null unless
    ``paths``. Repeated links count once; a null child only states that the parent exists, a null parent that the child
    does; a row of two nulls states nothing. A child of several parents hangs under the smallest one, so that there is a
    forest; :func:`other_parents` has the links left out. Nodes compare as texts. An empty table gives no rows; further columns are ignored.
    """
    pairs = links.select(parent.cast("string").alias("p"), child.cast("string").alias("c"))
    named = pairs.select(F.explode(F.array(F.struct(F.col("c").alias("node"), F.col("p").alias("parent")), F.struct(F.col("p").alias("node"), F.lit(None).cast("string").alias("parent")))).alias("x"))
    forest = named.select("x.*").where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    forest = stored(forest.select("node", "parent", F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("node").alias("low"), (F.array("node") if paths else F.lit(None).cast("array<string>")).alias("trail")), "forest")
    steps = [forest]
    solved = _solve(forest, forest.count(), 0, fragment, paths, steps)
    circled = F.col("cycle").isNotNull()
    tree = solved.select(
        "node",
        F.coalesce("cycle", "top").alias("root"),
        F.when(circled, -1).otherwise(F.col("steps")).cast("int").alias("depth"),
        F.when(~circled & F.lit(paths), F.reverse("trail")).alias("path"),
    )
    tree = stored(tree, "tree")
    forget(*steps)
    return tree


def other_parents(links: DataFrame, parent: Column, child: Column) -> DataFrame:
    """(child, parent, other): links that a forest has no room for: each further parent of a child that hangs under another."""
    pairs = links.select(parent.cast("string").alias("other"), child.cast("string").alias("child")).dropna()
    least = pairs.groupBy("child").agg(F.min("other").alias("parent"), F.max("other").alias("most")).where("parent != most").drop("most")
    return pairs.distinct().join(least, "child").where("other != parent").select("child", "parent", "other")


def descendants(links: DataFrame, parent: Column, child: Column, fragment: int = FRAGMENT) -> DataFrame:
    """(ancestor, descendant, distance) for every node and each node beneath it; nodes on or beneath circles have none."""
    tree = hierarchy(links, parent, child, paths=True, fragment=fragment)
    below = tree.where("depth > 0").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor"))
    return below.where("at < depth").select("ancestor", "descendant", (F.col("depth") - F.col("at")).cast("int").alias("distance"))
