"""Exact quantiles of numeric columns without gathering their values.

Values are counted, the (value, count) table is range-partitioned, and the partitions'
totals (one row each) tell which partition holds a wanted rank; only there are counts
summed up in order.  NULL and NaN are missing values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.session import ensure_checkpoint_dir


def exact_quantiles(df: DataFrame, cols: Sequence[str], fractions: Sequence[float]) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles per column; None for a column without values.

    Runs jobs when called: one aggregation over the input, then passes over a few
    partitions of its distinct values.
    """
    if not cols:
        return {}
    ensure_checkpoint_dir(df.sparkSession)
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)]))
    counts = (df.select(cells.alias("x")).select("x.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
                .groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")))
    ranged = counts.repartitionByRange("c", "v").withColumn("part", F.spark_partition_id()).checkpoint(eager=True)
    totals = ranged.groupBy("c", "part").agg(F.sum("n").alias("n"), F.min("v").alias("lo")).collect()   # a row per column and partition
    wanted, need = {}, F.lit(False)
    before: dict[tuple[int, int], int] = {}
    for i in range(len(cols)):
        mine = sorted((t for t in totals if t["c"] == i), key=lambda t: t["lo"])
        n, below = sum(t["n"] for t in mine), 0
        places = [f * (n - 1) for f in fractions] if n else []
        ranks = {int(p) for p in places} | {min(n - 1, int(p) + 1) for p in places}
        wanted[i] = (n, places, ranks)
        for t in mine:
            if any(below <= r < below + t["n"] for r in ranks):
                before[i, t["part"]] = below
                need = need | ((F.col("c") == i) & (F.col("part") == t["part"]))
            below += t["n"]
    running = F.sum("n").over(Window.partitionBy("c", "part").orderBy("v"))
    offset = F.coalesce(*[F.when((F.col("c") == i) & (F.col("part") == p), F.lit(b)) for (i, p), b in before.items()], F.lit(0))
    ends = ranged.where(need).withColumn("end", running + offset)
    hit = F.lit(False)
    for i, (_, _, ranks) in wanted.items():
        for r in ranks:
            hit = hit | ((F.col("c") == i) & (F.col("end") > r) & (F.col("end") - F.col("n") <= r))
    rows = ends.where(hit).select("c", "v", "n", "end").collect() if before else []   # two rows per column and fraction at most
    out = {}
    for i, c in enumerate(cols):
        n, places, _ = wanted[i]
        at = lambda r, i=i: next(x["v"] for x in rows if x["c"] == i and x["end"] - x["n"] <= r < x["end"])
        out[c] = [None] * len(fractions)
        for k, p in enumerate(places):
            lo, hi = int(p), min(n - 1, int(p) + 1)
            out[c][k] = at(lo) if p == lo else (hi - p) * at(lo) + (p - lo) * at(hi)
    return out
