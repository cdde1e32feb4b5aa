"""Problem 6: splits that keep related records together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import running_sum
from ..runtime import materialize, salted_join, small

EMPTY_SHA1 = "da39a3ee5e6b4b0d3255bfef95601890afd80709"
#: Links up to which the last forests are merged by one task; beyond it stars are contracted by shuffles.
MERGE_LINKS = 2_000_000
#: Largest groups that the driver assigns one by one; it assigns the others by size, all of one size together.
LARGEST = 50_000


def link_value(value: Column) -> Column:
    """Lower case, blanks trimmed and runs of blanks made one; null, empty, 'unknown' and the digest of nothing are null."""
    v = F.lower(F.trim(F.regexp_replace(value, r"\s+", " ")))
    return F.when(~v.isin("", "unknown", EMPTY_SHA1), v)


def links(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct (a, b) between the values that a record carries; a value alone is linked with itself.

    Nodes carry the number of their column, so equal strings of different columns are different nodes.
    """
    nodes = F.array_compact(F.array(*[F.concat(F.lit(f"{i}:"), link_value(F.col(c))) for i, c in enumerate(columns)]))
    rows = df.select(nodes.alias("n")).where("size(n) > 0").distinct()
    return rows.select(F.col("n")[0].alias("a"), F.explode("n").alias("b")).distinct()


def _forest(frames):
    """Union-find over all links of a partition; gives each node's root, the smallest node of its tree."""
    parent: dict = {}

    def find(x):
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for frame in frames:
        for a, b in zip(frame["a"], frame["b"]):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pd.DataFrame({"a": nodes, "b": [find(x) for x in nodes]})


def local_forests(edges: DataFrame) -> DataFrame:
    return edges.mapInPandas(_forest, "a string, b string")


def components(edges: DataFrame, merge_links: int = MERGE_LINKS, fan_in: int = 8) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node of its component.

    Each partition reduces its links to a forest, which is no larger than its nodes. Forests are then
    merged fan_in at a time while all their links fit the bound; if they don't, large-star and
    small-star contractions follow until nothing changes, each a pair of aggregations with partial
    sums, so that a node with very many links is no hot spot. Every step is written to shared storage.
    """
    now = materialize(local_forests(edges).distinct())
    seen = _print(now)
    n = seen[0]
    parts = max(1, now.rdd.getNumPartitions())
    while n > merge_links:
        larger = now.where("a != b")
        both = larger.union(larger.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = salted_join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = star.groupBy("a").agg(F.min("b").alias("m"))
        hop = salted_join(materialize(star), least, "a")
        after = materialize(
            hop.select("a", F.col("m").alias("b"))
            .union(hop.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .union(now.select("b", "b").toDF("a", "b"))
            .distinct()
        )
        was, seen = seen, _print(after)
        if was == seen:
            return _flatten(after)
        now, n = after, seen[0]
    while True:
        parts = max(1, parts // fan_in)
        now = materialize(local_forests(now.coalesce(parts)))
        if parts == 1:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _print(links: DataFrame) -> tuple:
    """What tells a set of links from another: their number and sums of their hashes, whatever their order."""
    h = F.xxhash64("a", "b")
    return tuple(links.agg(F.count("*"), F.sum(h.cast("decimal(20,0)")), F.bit_xor(h)).first())


def _flatten(stars: DataFrame) -> DataFrame:
    return stars.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.col("b").alias("root"))


def linked_values(df: DataFrame, columns: tuple[str, ...], of: int = 0) -> DataFrame:
    """(value, root): the component of every value of column number `of`."""
    found = components(links(df, *columns))
    return found.where(F.col("node").startswith(f"{of}:")).select(F.substring("node", len(str(of)) + 2, 1 << 30).alias("value"), "root")


def linked_pairs(df: DataFrame, columns: tuple[str, ...], of: int = 0) -> DataFrame:
    """(a, b), a < b: values of column number `of` in one component. Only roots with several values are joined."""
    members = materialize(linked_values(df, columns, of))
    several = members.groupBy("root").count().where("count > 1").select("root")
    some = members.join(several, "root", "left_semi")
    a, b = (some.select(F.col("value").alias(x), "root") for x in "ab")
    return salted_join(a, b, "root").where("a < b").select("a", "b")


def share_out(lack: dict[str, float], size: int, n: int) -> dict[str, int]:
    """How many of n groups of one size go to each split if each goes to the one furthest below its target; lack is updated."""
    out = dict.fromkeys(lack, 0)

    def give(s, k):
        out[s] += k
        lack[s] -= k * size
        return k

    while n > 0:
        order = sorted(lack, key=lambda x: (lack[x], x), reverse=True)
        first, last = lack[order[0]], lack[order[-1]]
        if size <= 0:
            n -= give(order[0], n)
        elif first - last <= size and n >= len(order):
            # all are level: they take turns
            for s in order:
                give(s, n // len(order))
            n %= len(order)
        else:
            second = lack[order[1]] if len(order) > 1 else first
            n -= give(order[0], min(n, max(1, int((first - second) // size))))
    return out


def split_groups(sizes: DataFrame, shares: dict[str, float], largest: int = LARGEST) -> DataFrame:
    """(root, split): greedy, the largest group first, into the split furthest below its target.

    sizes: (root, size). The driver assigns the `largest` largest groups one by one, and of the rest how many of each
    size go where: no more numbers than the sizes below those. Groups of one size are then told apart by a
    prefix sum over their hashes, so that no task sees all groups.
    """
    spark = sizes.sparkSession
    sizes = materialize(sizes.select("root", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    lack = {s: share * total for s, share in shares.items()}
    top = sizes.orderBy(F.desc("size"), "root").limit(largest).collect()
    placed = []
    for r in top:
        s = max(lack, key=lambda x: (lack[x], x))
        lack[s] -= r.size
        placed.append((r.root, s))
    done = spark.createDataFrame(placed, "root string, split string")
    if len(top) < largest:
        return done
    rest = materialize(sizes.join(small(done), "root", "left_anti"))
    found = rest.groupBy("size").agg(F.count("*").alias("n")).orderBy(F.desc("size")).toArrow().to_pylist()
    cuts = []
    for r in found:
        at = 0
        for s, k in share_out(lack, r["size"], r["n"]).items():
            if k:
                cuts.append((r["size"], at, at + k, s))
                at += k
    ranked = running_sum(rest.withColumn("one", F.lit(1)).withColumn("at", F.xxhash64("root")), ["at", "root"], "one", "rank", ["size"])
    edges = small(materialize(spark.createDataFrame(cuts, "size bigint, low bigint, high bigint, split string")))
    return done.union(ranked.join(edges, "size").where("rank >= low and rank < high").select("root", "split"))
