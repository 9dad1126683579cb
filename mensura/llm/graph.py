"""Connected components of a link table, as rounds of joins; no link or component reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mensura.llm import _store
from mensura.llm._store import cut, meet


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b): the smallest node that it reaches; nodes that only link to themselves are left out.

    Each round contracts the links to labels, hooks every label under its
    smallest neighbour, follows two hooks, and drops what has become inner.
    Every label that isn't smallest among its neighbours disappears in a round,
    so rounds grow with the logarithm of the longest chain. Links (u, v) and the
    labels (u = v) of nodes are rows of one table, which is written once a round.
    """
    none = F.lit(None).cast("long")
    row = lambda u, v, node: F.struct(F.col(u).alias("u"), F.col(v).alias("v"), node.alias("node"))
    ways = F.array(row("a", "b", none), row("b", "a", none), row("a", "a", F.col("a")), row("b", "b", F.col("b")))
    rows = cut(links.where("a <> b").select(F.inline(ways)).distinct())
    while n := (open_links := rows.where("node IS NULL")).count():
        few = n <= _store.BROADCAST_ROWS
        hooks = open_links.groupBy("u").agg(F.min("v").alias("up")).where("up < u")
        hooks = hooks if few else cut(hooks)
        once = meet(hooks, hooks.select(F.col("u").alias("up"), F.col("up").alias("over")), ["up"], "u", "left", stored=True, bound=n)
        twice = once.select("u", F.coalesce("over", "up").alias("up"))
        twice = twice if few else cut(twice)
        # many links may begin or end at one label
        left = meet(rows, twice, ["u"], ["v", "node"], "left", stored=True, bound=n).select(F.coalesce("up", "u").alias("u"), "v", "node")
        right = meet(left, twice.select(F.col("u").alias("v"), "up"), ["v"], ["u", "node"], "left", stored=True, bound=n)
        rows = cut(right.select("u", F.coalesce("up", "v").alias("v"), "node").where("u <> v OR node IS NOT NULL").distinct())
    return rows.where("node IS NOT NULL").select("node", F.col("u").alias("label"))
