"""Reuse of recommendation lists when a miss fills the cache.

Whether a request computes its list depends on when a list was last computed, not on the
last request: the first request of a user and k computes, and so does the first request at
or after each expiry.  The requests that compute form a chain.  Every request's successor
in such a chain is found inside a window of two TTLs, and the chain that starts at the
first request is followed by pointer doubling, so neither a long history nor a user with
very many requests is ever walked row by row or ordered in one task.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.operators.recommend import CACHE_TTL_SECONDS, cache_lookup
from cartwheel.session import ensure_checkpoint_dir

_KEY = ["user_id", "top_k"]


def _bucket(ts: Column, ttl_seconds: int) -> Column:
    epoch = F.lit(_dt.datetime(1970, 1, 1)).cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", epoch, ts) / F.lit(ttl_seconds))


def expiry_successors(times: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """``(user_id, top_k, ts, to)``: of distinct times the first one of the same key at or after ``ts + ttl`` (null: none).

    Time is cut into TTL-long buckets, so an expiry falls into the bucket behind its
    request's own: there it is ordered among the bucket's times, ahead of an equal time.
    If none of them follows, the next bucket that has any gives its first time; buckets
    are linked by one row each.
    """
    own = times.withColumn("b", _bucket(F.col("ts"), ttl_seconds))
    buckets = own.groupBy(*_KEY, "b").agg(F.min("ts").alias("head"))
    line = Window.partitionBy(*_KEY).orderBy("b")   # a row per TTL in which the key was asked for
    linked = buckets.select(*_KEY, "b", F.lead("head").over(line).alias("next"), F.lead("b").over(line).alias("next_b"))
    # what follows a bucket's own times, also in the bucket behind it if that has none
    tails = linked.select(*_KEY, F.explode(F.when(F.col("next_b") == F.col("b") + 1, F.array("b")).otherwise(F.array(F.col("b"), F.col("b") + 1))).alias("b"), F.col("next").alias("at"))
    none = F.lit(None).cast("timestamp_ntz")
    expiry = F.col("ts") + F.make_dt_interval(secs=F.lit(ttl_seconds))
    rows = (own.select(*_KEY, "b", expiry.alias("place"), F.lit(0).alias("kind"), none.alias("at"), F.col("ts").alias("asked")).withColumn("b", F.col("b") + 1)
            .unionByName(own.select(*_KEY, "b", F.col("ts").alias("place"), F.lit(1).alias("kind"), F.col("ts").alias("at"), none.alias("asked")))
            .unionByName(tails.select(*_KEY, "b", none.alias("place"), F.lit(2).alias("kind"), "at", none.alias("asked"))))
    behind = Window.partitionBy(*_KEY, "b").orderBy(F.col("place").asc_nulls_last(), "kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return rows.withColumn("to", F.first("at", ignorenulls=True).over(behind)).where("kind = 0").select(*_KEY, F.col("asked").alias("ts"), "to")


def _on_chain(steps: DataFrame) -> DataFrame:
    """``(user_id, top_k, ts)`` reached from each key's first time by following ``steps (…, ts, to)``.

    Round j adds what 2^j steps reach and doubles the steps, so a chain of n takes about
    log2 n rounds; steps that lead nowhere are dropped.
    """
    jump = steps.where("to IS NOT NULL").checkpoint()
    reached = steps.groupBy(*_KEY).agg(F.min("ts").alias("ts")).checkpoint()
    while not jump.isEmpty():
        found = reached.join(jump, [*_KEY, "ts"]).select(*_KEY, F.col("to").alias("ts"))
        reached = reached.unionByName(found).distinct().checkpoint()
        far = jump.select(*_KEY, F.col("ts").alias("to"), F.col("to").alias("beyond"))
        jump = jump.join(far, [*_KEY, "to"]).select(*_KEY, "ts", F.col("beyond").alias("to")).checkpoint()
    return reached


def cache_sessions(requests: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Which requests compute a list and which are served from the one computed last.

    requests: ``(request_id, user_id, top_k, ts)``.  A list computed at t serves the
    requests of its user and k in [t, t + ttl); the next one computes anew.  Of requests
    at one time the one with the smallest request_id computes.  Returns the requests with
    ``computed_at`` (when the list they get was computed) and ``source`` ("compute" or
    "cache").  Requests without a time, user or k are answered by themselves: "compute",
    with no computed_at.  Runs jobs when called.
    """
    ensure_checkpoint_dir(requests.sparkSession)
    asked = requests.select("request_id", *_KEY, F.col("ts").cast("timestamp_ntz").alias("ts"))
    whole = F.col("user_id").isNotNull() & F.col("top_k").isNotNull() & F.col("ts").isNotNull()
    computed = _on_chain(expiry_successors(asked.where(whole).select(*_KEY, "ts").distinct(), ttl_seconds))
    served = cache_lookup(asked.where(whole), computed.withColumnRenamed("ts", "computed_at"), ttl_seconds)
    first = Window.partitionBy(*_KEY, "ts").orderBy("request_id")
    computes = (F.col("ts") == F.col("cached_at")) & (F.row_number().over(first) == 1)
    out = served.select("request_id", *_KEY, "ts", F.col("cached_at").alias("computed_at"), F.when(computes, "compute").otherwise("cache").alias("source"))
    loose = asked.where(~whole).select("request_id", *_KEY, "ts", F.lit(None).cast("timestamp_ntz").alias("computed_at"), F.lit("compute").alias("source"))
    return out.unionByName(loose)
