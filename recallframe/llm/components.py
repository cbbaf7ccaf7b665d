"""Connected components of a link table by hooking and pointer jumping, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage_table, stage_table

#: Links for each partition of the tables.
ROWS = 50_000


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has a link: columns node, component.

    Each round hooks every node on its smallest neighbour, jumps pointers until they rest on roots, and
    contracts the links to their roots. Minima are combined before they are shuffled and joins run on
    written tables, so that a node with very many links neither gathers in one task nor in memory. A root
    without a smaller neighbour takes in a neighbour, or stands next to a smaller root in the next round; so two rounds
    at least halve the roots of a component that isn't done, and pointers double their reach: with n nodes there are
    at most 2 log2(n) rounds of log2(n) jumps each.
    Nulls and links of a node to itself are left out; without links the result is empty.
    """
    links = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    links = stage_table(links.where(F.col("a") < F.col("b")).distinct(), "links")
    found = None
    n = links.count()
    while True:
        parts = 1 + n // ROWS  # of all tables of this round: none has more rows than two for each link
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
        up = table = stage_table(up.select("node", F.least("node", "m").alias("root")), "roots", parts=parts)
        while True:
            above = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = up.join(above, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
            jumped = stage_table(jumped, "roots", parts=parts)
            moved = jumped.where("moved").limit(1).count()
            drop_stage_table(table)
            table, up = jumped, jumped.select("node", "root")
            if not moved:
                break
        if found is None:
            found, kept, most = up, table, parts
        else:
            later = up.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = stage_table(found.join(later, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots", parts=most)
            drop_stage_table(kept)
            kept = found
        ra, rb = up.select(F.col("node").alias("a"), F.col("root").alias("ra")), up.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        left = links.join(ra, "a").join(rb, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        rest = stage_table(left.distinct(), "links", parts=parts)
        drop_stage_table(links, *([table] if table is not kept else []))
        links, n = rest, rest.count()
        if not n:
            drop_stage_table(links)
            return found.select("node", F.col("root").alias("component"))
