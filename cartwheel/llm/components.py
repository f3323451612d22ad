"""Connected components by contraction: every node joins its smallest neighbour until no link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` of all ids in ``links (a, b)``; the component is its smallest id.

    Links shrink to links between contracted nodes each round, so a long chain takes
    about the logarithm of its length; every round's tables go to the shared folder.
    """
    rest = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    ids = rest.select(F.col("a").alias("id")).unionAll(rest.select("b")).distinct()
    label = written(ids.withColumn("component", F.col("id")), "labels")
    while not rest.isEmpty():
        both = rest.unionAll(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("to")), "steps")
        hop = step.select(F.col("id").alias("to"), F.col("to").alias("then"))
        step = written(step.join(hop, "to").select("id", F.col("then").alias("to")), "steps")  # two steps at once
        label = written(label.join(step.select(F.col("id").alias("component"), "to"), "component", "left")
                        .select("id", F.coalesce("to", "component").alias("component")), "labels")
        ends = rest.join(step.select(F.col("id").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("id").alias("b"), F.col("to").alias("y")), "b")
        rest = written(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), "links")
    return label
