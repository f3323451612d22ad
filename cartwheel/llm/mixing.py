"""Mixing sources to target weights by Sainte-Laguë apportionment.

Targets are the sources' weighted shares of all words, capped at a number of repeats and
reshared.  Targets are turned into integer quotas of equal blocks of words: first per
source, then per shard of a source, each time giving the blocks to the highest quotients
``V / (2 s + 1)``.  Inside a shard the documents stand in a seeded order on a line of
words; full passes over the line count as repeats and the rest is cut from a seeded start.

Everything is DataFrame code.  A document's place on the line needs a running sum over
its shard only (about ``shard_rows`` documents, however large the source), so a source
with a third of all rows is spread over as many tasks as it has shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartwheel.llm.common import WORD, text_or_empty, written

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def cycled_weights(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Give the sources, in code-point order with null last, the weights in turn."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int")))


def targets(sources: DataFrame, max_repeats: float = 3.0, share: float = 1.0) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight)``: weighted shares, none above its cap.

    Sources whose cap per weight is lowest are filled first; the rest share what is left
    by weight, which is where repeated resharing ends.  One row per source.
    """
    fill = F.struct((F.col("cap") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), F.col("source").alias("s"))
    everything = W.partitionBy(F.lit(0))
    before = W.orderBy(F.col("fill")).rowsBetween(W.unboundedPreceding, -1)
    after = W.orderBy(F.col("fill")).rowsBetween(W.currentRow, W.unboundedFollowing)
    rows = (sources.withColumn("cap", max_repeats * F.col("source_size")).withColumn("fill", fill)
            .withColumn("total", F.sum("source_size").over(everything) * share)
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)))
    # the water level: that of the first source which its own cap does not stop
    level = F.min(F.when(F.col("level") <= F.col("fill.r"), F.struct("fill", "level"))).over(everything)["level"]
    return (rows.withColumn("water", level)
            .withColumn("target", F.when(F.col("water").isNull() | (F.col("fill.r") < F.col("water")), F.col("cap")).otherwise(F.col("weight") * F.col("water")))
            .drop("cap", "fill", "total", "level", "water"))


def sainte_lague(rows: DataFrame, groups: list[str], claim: str, seats: str, out: str = "quota") -> DataFrame:
    """Add to every row its seats among the ``seats`` of its group (the same value on all of a group's rows).

    A row's quotients are ``claim / (2 s + 1)``, s = 0, 1, …; the highest win, equal ones
    in column order of the row.  With n rows a row's result lies within ``part * n / 2 + 1/2``
    of its proportional share, so seats below that are sure, seats above it impossible,
    and only the few in between are ranked.  Rows must be distinct.
    """
    own = list(rows.columns)
    whole = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    part = F.when(F.col("__sum") > 0, F.col(claim) / F.col("__sum")).otherwise(0.0)
    share, margin = part * F.col(seats), part * F.col("__n") / 2 + 1
    near = (rows.withColumn("__sum", F.sum(claim).over(whole)).withColumn("__n", F.count(F.lit(1)).over(whole))
            .withColumn("__low", F.greatest(F.lit(0), F.floor(share - margin)).cast("long"))
            .withColumn("__high", F.when(part > 0, F.ceil(share + margin)).otherwise(0).cast("long"))
            .withColumn("__given", F.sum("__low").over(whole)))
    seat = F.explode_outer(F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low"), F.col("__high") - 1)))
    ranked = (near.withColumn("__seat", seat).withColumn("__quotient", F.col(claim) / (2 * F.col("__seat") + 1))
              .withColumn("__rank", F.row_number().over(whole.orderBy(F.col("__quotient").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in own], "__seat"))))
    won = (F.col("__rank") <= F.col(seats) - F.col("__given")) & F.col("__seat").isNotNull()
    return ranked.groupBy(*own, "__low").agg(F.sum(won.cast("long")).alias("__won")).withColumn(out, F.col("__low") + F.col("__won")).select(*own, out)


def _draw(seed: int, *what: Column) -> Column:
    """32 seeded bits of a key (md5, so the same on every engine and cluster)."""
    key = F.concat_ws("/", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in what])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        max_repeats: int = 3, share: float = 1.0, block_words: int = 16, shard_rows: int = 512, seed: int = 7, keep: bool = False) -> DataFrame:
    """``(id, size, source, source_size, target, taken)`` for every row.

    ``size`` counts words (null text: 0); ``taken`` is how many words of the document the
    mix takes, repeats counted, at most ``max_repeats`` times its size.  A document may be
    cut at a block's edge.  A null source is a source of its own, the last.  Documents of
    equal id are ordered by size; rows repeated in full get equal places in turn.  The
    same rows give the same mix whatever the partitioning.  Sizes and quotas are written
    to the shared folder, so this call runs jobs before it returns.  The list of sources
    (a row each) is sorted in one task; documents never are.  With ``keep`` every row comes
    back with its own columns, those of the added names replaced, and ``size, source_size,
    target, taken``; whatever ids it shares, it is never joined back by them.
    """
    measured = [F.col(doc_id).alias("id"), F.col(source).cast("string").alias("source"), word_count(text_or_empty(text)).alias("size")]
    sized = written(df.select(measured), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    sources = targets(cycled_weights(sources, weights), float(max_repeats), share)
    sources = sources.withColumn("seats", F.round(F.sum("target").over(W.partitionBy(F.lit(0))) / block_words).cast("long"))
    sources = sainte_lague(sources, [], "target", "seats").withColumn("shards", F.ceil(F.col("n_docs") / shard_rows).cast("long"))
    plan = written(sources.select(F.col("source").alias("s"), "source_size", "target", F.col("quota").alias("blocks"), "shards"), "quotas")

    def place(rows: DataFrame) -> DataFrame:
        return (rows.join(plan, rows["source"].eqNullSafe(plan["s"])).drop("s")
                .withColumn("shard", F.pmod(_draw(seed, F.lit("shard"), F.col("id")), F.col("shards"))))

    placed = place(sized)
    cells = placed.groupBy("source", "source_size", "target", "blocks", "shard").agg(F.sum("size").alias("cell"))
    cells = cells.withColumn("claim", F.when(F.col("source_size") > 0, F.col("target") * F.col("cell") / F.col("source_size")).otherwise(0.0))
    cells = sainte_lague(cells, ["source"], "claim", "blocks")
    wanted = F.least(F.col("quota") * block_words, F.col("cell") * max_repeats)
    cells = (cells.select(F.col("source").alias("s"), F.col("shard").alias("h"), "cell", wanted.alias("wanted"))
             .withColumn("passes", F.when(F.col("cell") > 0, F.floor(F.col("wanted") / F.col("cell"))).otherwise(0).cast("long"))
             .withColumn("rest", F.col("wanted") - F.col("passes") * F.col("cell"))
             .withColumn("first", F.when(F.col("cell") > 0, F.pmod(_draw(seed, F.lit("start"), F.col("s"), F.col("h")) * block_words, F.col("cell"))).otherwise(0)))
    line = W.partitionBy("source", "shard").orderBy("__order", F.col("id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    if keep:
        placed = place(df.select(*measured, F.struct(*df.columns).alias("__row")))
    lined = (placed.withColumn("__order", _draw(seed, F.lit("order"), F.col("id")))
             .withColumn("end", F.sum("size").over(line)).withColumn("begin", F.col("end") - F.col("size")))
    rows = lined.join(cells, lined["source"].eqNullSafe(cells["s"]) & (lined["shard"] == cells["h"]))

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("end"), hi) - F.greatest(F.col("begin"), lo))

    stop = F.col("first") + F.col("rest")
    cut = overlap(F.col("first"), F.least(stop, F.col("cell"))) + overlap(F.lit(0), stop - F.col("cell"))
    taken = (F.col("passes") * F.col("size") + cut).cast("long").alias("taken")
    if keep:
        own = [F.col("__row")[c].alias(c) for c in df.columns if c not in ("size", "source_size", "target", "taken")]
        return rows.select(*own, "size", "source_size", "target", taken)
    return rows.select(F.col("id").alias(doc_id), "size", "source", "source_size", "target", taken)
