"""Connected components of a stored edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.llm.common import lookup, stored


def _mins(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node ties its larger neighbours to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    tied = lookup(both, _mins(both), "a", "n", 2 * rows).where(F.col("b") > F.col("a"))
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node ties its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tied = lookup(down, _mins(down), "a", "n", rows)
    pairs = F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))
    return tied.select(F.inline(pairs)).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node reachable from it, for all nodes of ``edges`` (a, b) but the labels themselves."""
    now, seen = stored(edges.where("a <> b").select("a", "b"), "edges"), None
    while True:
        sums = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))).first()
        if not sums[0] or (sums[0], sums[1]) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        seen = (sums[0], sums[1])
        large = stored(_large_star(now, sums[0]), "large-star")
        now = stored(_small_star(large, large.count()), "small-star")
