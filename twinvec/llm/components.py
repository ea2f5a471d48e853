"""Connected components of a table of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.session import checkpoint, discard


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links (a, b)``, as a stored table; the component is its smallest node.

    Each step keeps at most one row per link and is stored in the shared folder, so a lost executor repeats one step.
    A node with very many links is only ever the key of a combined minimum and of a join that can be split. No links: no rows.
    """
    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())

    e = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = mark(e)
    while seen[0]:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("x")).union(e.select("v", "u"))
        low = both.groupBy("n").agg(F.least(F.min("x"), F.col("n")).alias("m"))
        large = both.where("x > n").join(low, "n").select(F.col("x").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        after = checkpoint(small.union(low.select("u", "m")).distinct())
        discard(e)
        e, now = after, mark(after)
        if now == seen:
            break
        seen = now
    named = checkpoint(e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v")).distinct())
    discard(e)
    return named
