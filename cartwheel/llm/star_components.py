"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import written

#: A node's row is copied so many times when it meets the node's links, so that a hub's links spread over tasks.
SPREAD = 8


def _least_neighbour(links: DataFrame) -> DataFrame:
    """Every link ``(u, v)`` with ``least``, the smallest of u and its neighbours (combined map-side; hubs are salted)."""
    least = links.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
    copies = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return links.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SPREAD)).cast("int")).join(copies, ["u", "salt"])


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of its neighbourhood."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least_neighbour(both).filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _least_neighbour(down)
    return met.select(F.col("v").alias("u"), F.col("least").alias("v")).unionAll(met.select("u", F.col("least").alias("v"))).filter("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def star_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of all ids in ``links (a, b)``; the component is its smallest id.

    Both steps keep the components and pull links towards the smallest id; when a round
    changes nothing, every id is linked to that id alone.  Each step's links go to the
    shared folder.  Self-links and links with a null end are left out.
    """
    now = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct(), "star-links")
    before = None
    while (state := _state(now)) != before:
        before = state
        now = written(_small_star(written(_large_star(now), "large-star")), "small-star")
    lead = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(lead)
