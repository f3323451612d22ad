"""Sampling, splitting, id indexing and negative sampling.

All randomness is an md5 of ``seed:key`` (portable and repeatable).  Nothing
here orders or ranks a whole table in a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwheel.functions.hashing import seeded_fraction_below, seeded_key
from cartwheel.operators.selection import first_rows, key_at
from cartwheel.session import stored

SEED = 42


def index_ids(df: DataFrame, col: str, start: int = 0, partitions: int | None = None) -> DataFrame:
    """Dense index in sorted id order: ``(col, idx)`` with idx = start, start+1, ...

    Equivalent to ``dense_rank() over (order by col) - 1 + start`` without the
    single-partition window: ids are range-partitioned and sorted, each partition
    counts its rows, a tiny table of per-partition offsets is joined back.  The
    sorted ids are checkpointed so both passes see the same partitioning.
    """
    spark = df.sparkSession
    from cartwheel.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = df.select(col).where(F.col(col).isNotNull()).distinct()
    srt = (ids.repartitionByRange(n, col).sortWithinPartitions(col)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_pos", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
              .checkpoint(eager=True))
    counts = srt.groupBy("_pid").agg(F.count("*").alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition: tiny
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (srt.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
               .select(col, (F.col("_off") + F.col("_pos") + F.lit(start)).alias("idx")))


def vocabulary(df: DataFrame, col: str) -> DataFrame:
    """Id -> int index, 0 reserved for unknown ids (lookup with ``coalesce(idx, 0)``)."""
    return index_ids(df, col, start=1)


def sample_n(df: DataFrame, n: int, key_cols: list[str], seed: int = SEED) -> DataFrame:
    """``n`` rows chosen by seeded hash order, found by radix selection: rows are only filtered.

    Runs jobs when called.  Rows whose key columns hold a null take part (the key of a null is "").
    """
    keyed = df.withColumn("_h", seeded_key(seed, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]))
    return first_rows(keyed, "_h", n).drop("_h")


def train_test_split(df: DataFrame, key_cols: list[str], train_fraction: float = 0.8,
                     seed: int = SEED) -> DataFrame:
    """R2: adds ``split`` in {'train','test'} from a hash threshold (no shuffle at all)."""
    return df.withColumn("split", F.when(seeded_fraction_below(seed, train_fraction, *key_cols), "train")
                                   .otherwise("test"))


def train_test_split_exact(df: DataFrame, key_cols: list[str], train_fraction: float = 0.8,
                           seed: int = SEED) -> DataFrame:
    """R2 exact form: the first ``int(n * fraction)`` rows in seeded hash order are 'train'.

    The hash where they end is found by radix selection; rows that share it stay together
    and are 'test'.  Writes the rows and runs jobs over them when called, so that what leads to them runs once.
    """
    keyed = stored(df, "split").withColumn("_h", seeded_key(seed, *key_cols))
    end, _ = key_at(keyed, "_h", lambda n: int(n * train_fraction))
    train = F.lit(True) if end is None else F.col("_h") < end
    return keyed.withColumn("split", F.when(train, "train").otherwise("test")).drop("_h")


def temporal_split(df: DataFrame, cut, col: str = "t_dat") -> DataFrame:
    """Rows strictly before ``cut`` are training rows."""
    return df.withColumn("split", F.when(F.col(col) < F.lit(cut).cast("date"), "train").otherwise("test"))


def eligible_users(inter: DataFrame, min_items: int = 2, user: str = "customer_id",
                   item: str = "article_id") -> DataFrame:
    """Users with at least ``min_items`` distinct items."""
    return (inter.groupBy(user).agg(F.count_distinct(item).alias("n_items"))
                 .where(F.col("n_items") >= min_items))


def sample_eval_users(inter: DataFrame, max_users: int | None = None, min_items: int = 2,
                      seed: int = SEED, user: str = "customer_id", item: str = "article_id") -> DataFrame:
    """Eligible users; ``max_users`` None / <= 0 / >= eligible means all of them."""
    el = eligible_users(inter, min_items, user, item).select(user)
    if not max_users or max_users <= 0:
        return el
    return sample_n(el, max_users, [user], seed)


def prime_from(n: int) -> int:
    """The smallest prime that is at least ``n`` (and 2)."""
    p = max(2, n)
    while any(p % d == 0 for d in range(2, int(p ** 0.5) + 1)):
        p += 1
    return p


def negatives(tx: DataFrame, ratio: int = 1, seed: int = SEED, block: int = 4096) -> DataFrame:
    """per user ``n_pos * ratio`` never-bought articles, drawn without replacement.

    Draw j of a user is ``(start + j * step) mod P``, P the smallest prime not below the
    number of articles, start and step hashed from the user: a permutation of ``0..P-1``,
    so no draw repeats.  ``n_neg + n_pos`` draws and as many as P exceeds the articles
    leave ``n_neg`` survivors, or use up the catalogue: a user always gets
    ``min(n_neg, articles not bought)``.  Work is linear in the positives; there is no
    user x item product.  Draws are made in chunks of ``block`` and never shuffled: a positive is the
    draw ``(idx - start) / step mod P`` of its user, so the positives go to their chunks, and only survivors
    that are kept are joined with the articles.  A user who owns a large share of all rows has many chunks:
    survivors are counted per chunk, and offsets are a running sum over a user's few chunks.  Counts the
    articles when called.
    """
    from cartwheel.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(tx.sparkSession)
    # the positives feed three branches (item index, counts, draws): write them once, compressed
    pos = stored(tx.select("customer_id", "article_id").distinct(), "positives")
    items = index_ids(pos, "article_id")
    n_items = items.count()
    prime = prime_from(n_items)
    number = lambda *what: F.conv(F.substring(seeded_key(seed, "customer_id", *what), 1, 15), 16, 10).cast("long")
    walk = {"start": F.pmod(number(F.lit("start")), F.lit(prime)), "step": 1 + F.pmod(number(F.lit("step")), F.lit(prime - 1))}
    npos = pos.groupBy("customer_id").agg(F.count("*").alias("n_pos"))
    # draws are generated chunk by chunk: a user with a huge history is spread over
    # many tasks instead of exploding into one
    chunks = (npos.withColumn("n_neg", F.col("n_pos") * ratio)
                  .withColumn("m", F.least(F.col("n_neg") + F.col("n_pos") + F.lit(prime - n_items), F.lit(prime)))
                  .withColumns(walk)
                  .where(F.col("n_neg") > 0)
                  .withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / block))))
                  .repartition("customer_id", "blk"))
    # the positive with index idx is draw j: step to the power P - 2 is its inverse modulo P
    bits = F.array(*[F.lit(bit == "1") for bit in bin(prime - 2)[2:]])
    # the step travels in the state: its hash would be made again for every bit
    power = lambda x, bit: x["power"] * x["power"] % F.lit(prime) * F.when(bit, x["step"]).otherwise(F.lit(1)) % F.lit(prime)
    inverse = F.aggregate(bits, F.struct(F.lit(1).cast("long").alias("power"), F.col("step").cast("long").alias("step")),
                          lambda x, bit: F.struct(power(x, bit).alias("power"), x["step"].alias("step")), lambda x: x["power"])
    hits = pos.join(items.hint("merge"), "article_id").select("customer_id", "idx").withColumns(walk)
    # exploded, so that it is found once and not for each use
    hits = hits.select("customer_id", F.explode(F.array(F.pmod((F.col("idx") - F.col("start")) * inverse, F.lit(prime)))).alias("j"))
    taken = (hits.select("customer_id", F.floor(F.col("j") / block).alias("blk"), "j").repartition("customer_id", "blk")
                 .groupBy("customer_id", "blk").agg(F.collect_list("j").alias("taken")))
    index = lambda j: F.pmod(F.col("start") + j * F.col("step"), F.lit(prime))
    draws = F.sequence(F.col("blk") * block, F.least(F.col("m"), (F.col("blk") + 1) * block) - 1)
    # merge: sizes guessed before the draws are made would have them broadcast, all of them through the driver
    free = (chunks.join(taken.hint("merge"), ["customer_id", "blk"], "left")
                  .withColumn("free", F.filter(F.array_except(draws, F.coalesce("taken", F.array().cast("array<long>"))), lambda j: index(j) < F.lit(n_items)))
                  .select("customer_id", "blk", "n_neg", "start", "step", "free"))
    per_blk = free.select("customer_id", "blk", F.size("free").alias("_c"))
    w = Window.partitionBy("customer_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_blk.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).drop("_c")
    left = F.greatest(F.lit(0), F.least(F.col("n_neg") - F.col("_before"), F.size("free"))).cast("int")
    kept = (free.join(offs.hint("merge"), ["customer_id", "blk"])
                .withColumn("j", F.explode(F.slice("free", F.lit(1), left)))
                .select("customer_id", index(F.col("j")).alias("idx")))
    return (kept.hint("merge").join(items, "idx")
                .select("customer_id", "article_id", F.lit(0).alias("label"),
                        F.lit(0.0).alias("recency_weight"),
                        F.lit(None).cast("int").alias("days_since_purchase")))


def training_pairs(positives: DataFrame, negs: DataFrame, seed: int | None = SEED) -> DataFrame:
    """Positives UNION ALL negatives, missing columns NULL.

    The studied notebook shuffles the rows; here each row gets a seeded
    ``shuffle_key`` (md5 of seed:user:item) to order by when an order is wanted -
    no global shuffle is performed.
    """
    out = positives.unionByName(negs, allowMissingColumns=True)
    if seed is not None:
        out = out.withColumn("shuffle_key", seeded_key(seed, "customer_id", "article_id"))
    return out
