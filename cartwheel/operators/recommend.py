"""Recommendation tables: readable rows, display rows, payloads, request guards, reuse."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.functions.numeric import round_half_up
from cartwheel.functions.text import safe_str

# Fixed values of the studied output formats.
READABLE_COLUMNS = ["user_id", "rank", "product_id", "product_type_name", "colour_group_name",
                    "garment_group_name", "product_group_name", "detail_desc", "score"]
UNKNOWN = "Unknown"
DISPLAY_FILLS = {"product_type_name": "Unknown", "colour_group_name": "Unknown", "garment_group_name": "Unknown",
                 "product_group_name": "Unknown", "detail_desc": "No description available"}
DISPLAY_NAMES = {"item_id": "Product ID", "product_type_name": "Product Type", "colour_group_name": "Color",
                 "garment_group_name": "Garment Group", "product_group_name": "Category",
                 "detail_desc": "Description", "score": "Score"}
DISPLAY_ORDER = ["user_id", "rank", "Product ID", "Product Type", "Color", "Garment Group", "Category", "Score",
                 "Description"]
TOP_K_RANGE = (1, 100)
DEFAULT_TOP_K = 10
CACHE_TTL_SECONDS = 3600


def _with_metadata(recs: DataFrame, articles: DataFrame) -> DataFrame:
    """Recs LEFT JOIN metadata on item_id = article_id (AQE picks broadcast by size)."""
    meta = articles.withColumnRenamed("article_id", "item_id")
    return recs.join(meta, "item_id", "left")


def readable_recommendations(recs: DataFrame, articles: DataFrame) -> DataFrame:
    """Fixed column set; absent columns and NULL text become 'Unknown'."""
    j = _with_metadata(recs, articles).withColumnRenamed("item_id", "product_id")
    cols = []
    for c in READABLE_COLUMNS:
        if c not in j.columns:
            cols.append(F.lit(UNKNOWN).alias(c))
        elif dict(j.dtypes)[c] == "string":
            cols.append(F.coalesce(F.col(c), F.lit(UNKNOWN)).alias(c))
        else:
            cols.append(F.col(c))
    return j.select(*cols)


def display_recommendations(recs: DataFrame, articles: DataFrame) -> DataFrame:
    """Per-column fills, description cut to 120 characters, display names."""
    j = _with_metadata(recs, articles)
    sel = [F.col("user_id"), F.col("rank")]
    for c, name in DISPLAY_NAMES.items():
        col = F.col(c) if c in j.columns else F.lit(None).cast("string")
        if c in DISPLAY_FILLS:
            col = F.coalesce(col, F.lit(DISPLAY_FILLS[c]))
        if c == "detail_desc":
            col = F.substring(col, 1, 120)
        sel.append(col.alias(name))
    return j.select(*sel).select(*DISPLAY_ORDER)


# Fixed value: key layout of a stored recommendation list.
CACHE_KEY_FORMAT = "recommendations:%s:top%d"

PAYLOAD_SCHEMA = ("struct<user_id:string,total_recommendations:int,recommendations:array<struct<rank:int,"
                  "product_id:string,product_type:string,color:string,garment_group:string,product_group:string,"
                  "score:double>>>")


def cache_key(user: Column, k: Column) -> Column:
    """``recommendations:{user}:top{k}``."""
    return F.format_string(CACHE_KEY_FORMAT, user, k)


def parse_payload(json_col: Column) -> Column:
    """The stored JSON text back into the nested record."""
    return F.from_json(json_col, PAYLOAD_SCHEMA)


def payload(recs: DataFrame, articles: DataFrame, top_k: int) -> DataFrame:
    """One nested record per user (list bounded by k) and its JSON text.

    Unknown items keep NULL metadata, scores are rounded to 6 places.  ``top_k`` is the
    number that was asked for: the cache key holds it also when the list is shorter.
    """
    j = _with_metadata(recs, articles)
    item = F.struct(F.col("rank"), F.col("item_id").alias("product_id"),
                    safe_str(F.col("product_type_name")).alias("product_type"),
                    safe_str(F.col("colour_group_name")).alias("color"),
                    safe_str(F.col("garment_group_name")).alias("garment_group"),
                    safe_str(F.col("product_group_name")).alias("product_group"),
                    round_half_up(F.col("score")).alias("score"))
    g = j.groupBy("user_id").agg(F.array_sort(F.collect_list(item)).alias("recommendations"))
    g = g.withColumn("total_recommendations", F.size("recommendations"))
    g = g.withColumn("cache_key", cache_key(F.col("user_id"), F.lit(top_k)))
    return g.withColumn("json", F.to_json(F.struct("user_id", "total_recommendations", "recommendations"),
                                          {"ignoreNullFields": "false"}))


def request_guard(requests: DataFrame, known_users: DataFrame) -> DataFrame:
    """Clamp k to [1, 100], a missing k is the default; unknown users are rejected with a reason."""
    known = known_users.select(F.col(known_users.columns[0]).alias("user_id")).distinct().withColumn("_known", F.lit(True))
    k = F.col("top_k")
    clamped = F.greatest(F.lit(TOP_K_RANGE[0]), F.least(F.lit(TOP_K_RANGE[1]), F.coalesce(k, F.lit(DEFAULT_TOP_K))))
    j = requests.join(known, "user_id", "left")
    return j.select(*[c for c in requests.columns if c != "top_k"], k.alias("top_k_requested"),
                    clamped.alias("top_k"),
                    F.when(F.col("_known"), "served").otherwise("rejected").alias("status"),
                    F.when(F.col("_known"), F.lit(None).cast("string")).otherwise("unknown user").alias("reason"))


def cache_lookup(requests: DataFrame, computed: DataFrame, ttl_seconds: int = CACHE_TTL_SECONDS) -> DataFrame:
    """Serve a request from the latest list stored for its user and k at or before it, if still fresh.

    An as-of join without a range join.  Only entries younger than the TTL can
    serve, so time is cut into TTL-long buckets and every entry is also copied
    into the next bucket; requests and entries are then ordered inside
    (user, k, bucket) and the last entry time is carried forward with
    ``last(ignorenulls)``.  No partition is larger than two TTL windows of one
    user, however many rows that user has overall.
    requests: ``(request_id, user_id, top_k, ts)``; computed: ``(user_id, top_k, computed_at)``.
    """
    epoch = F.lit(_dt.datetime(1970, 1, 1)).cast("timestamp_ntz")
    # seconds are counted on the wall-clock value itself: no session time zone, no DST jumps
    bucket = lambda c: F.floor(F.timestamp_diff("SECOND", epoch, F.col(c).cast("timestamp_ntz")) / F.lit(ttl_seconds))
    r = requests.select("request_id", "user_id", "top_k", "ts", F.lit(None).cast("timestamp_ntz").alias("_c"),
                        F.lit(1).alias("_o"), bucket("ts").alias("_b"))
    c = computed.select(F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), "user_id", "top_k",
                        F.col("computed_at").alias("ts"), F.col("computed_at").alias("_c"), F.lit(0).alias("_o"),
                        F.explode(F.array(bucket("computed_at"), bucket("computed_at") + 1)).alias("_b"))
    w = (Window.partitionBy("user_id", "top_k", "_b").orderBy("ts", "_o")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = r.unionByName(c).withColumn("cached_at", F.last("_c", ignorenulls=True).over(w)).where(F.col("_o") == 1)
    fresh = F.col("cached_at").isNotNull() & (F.col("ts") < F.col("cached_at") + F.make_dt_interval(secs=F.lit(ttl_seconds)))
    return u.select("request_id", "user_id", "top_k", "ts", F.when(fresh, F.col("cached_at")).alias("cached_at"),
                    F.when(fresh, "cache").otherwise("compute").alias("source"))
