"""Connected components of a table of links, by alternating star contraction.

Every round writes its links to the shared folder, so lineage stays short and nothing passes through
the driver but one count. Links of a popular node are spread by adaptive skew joins, as both sides
of each join are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm._shared import Scratch


#: Links that a task takes. Rounds on few links are many small jobs, so their tables have as few files as that allows.
LINKS_A_TASK = 50_000


def _star(links: DataFrame, scratch: Scratch, name: str, parts: int) -> DataFrame:
    """Links (u, v): every v gets linked to the least of u's neighbours and u."""
    least = links.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("least"))
    return links.join(scratch.save(least.coalesce(parts), f"{name}-least"), "u")


def _digest(links: DataFrame) -> tuple[int, int | None]:
    """Number and combined hash of distinct links: two numbers that tell whether a round changed anything."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def contracted(links: DataFrame) -> DataFrame:
    """Fewer links (u, v), u > v, that connect the same: each node's least smaller neighbour is linked to the node and to its other smaller ones.

    For links that lead to few nodes, as those of tasks do that link the members of a cell to its
    smallest: many nodes then share the same other ones. A node's own links meet in one task.
    """
    links = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    ends = links.withColumn("least", F.min("v").over(Window.partitionBy("u")))
    # a row is the node's own link to its least neighbour, or another neighbour's
    own = F.col("v") == F.col("least")
    return ends.select(F.when(own, F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v")).distinct()


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root): for every node of ``links`` (u, v) the smallest node that it is connected with.

    Null ends are dropped; loops and repeated links do no harm. No links: an empty result.
    """
    links = scratch.save(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links-0")
    before = _digest(links)
    parts = 1 + before[0] // LINKS_A_TASK
    for i in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, scratch, f"large-{i}", parts).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u <> v")
        large = scratch.save(large.distinct().coalesce(parts), f"large-{i}")
        # towards smaller neighbours only; the node itself is linked to the least as well
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(down, scratch, f"small-{i}", parts)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v"))).filter("u <> v")
        after = scratch.save(small.distinct().coalesce(parts), f"links-{i + 1}")
        now = _digest(after)
        scratch.drop(f"large-{i}-least", f"large-{i}", f"small-{i}-least", f"links-{i}")
        links = after
        if now == before:
            roots = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
