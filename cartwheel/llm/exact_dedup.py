"""Exact dedup by composable polynomial fingerprints.

A text is cut into byte chunks; every chunk gets polynomial hashes modulo two primes,
and neighbouring hashes combine by length-shifted arithmetic,
``H(xy) = H(x) * B^|y| + H(y)``, so the fingerprint of a huge text is a reduction over
chunks that were hashed side by side.  Texts whose (length, fingerprint) agree are then
compared byte by byte, chunk against chunk of the group's representative; members that
differ (a collision) form a new group and are compared again.

Fingerprints are aggregated with map-side combining, and members join their
representative on (group, chunk).  Heads and sizes of groups are written before they are
joined: only a join of two plain shuffles is one that adaptive execution splits when one
group holds a third of all rows.  No text is ever gathered per group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import fresh, written

PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 741103597)
HASH_CHUNK = 1 << 12
#: Chunks hashed as one matrix: of a text of any length only about 1 MB is widened to 64 bits at a time.
HASH_CHUNKS = 1 << 8
COMPARE_CHUNK = 1 << 16
_COLUMNS = ("keep_id", "group_size", "kept", "text_sha256")


class Fingerprint:
    """(length, residues) of byte strings; ``combine`` joins the prints of two neighbours."""

    def __init__(self, primes=PRIMES, bases=BASES, chunk: int = HASH_CHUNK):
        self.primes, self.bases, self.chunk = primes, bases, chunk
        self.powers = []
        for p, b in zip(primes, bases):
            powers = np.empty(chunk, np.uint64)
            x = 1
            for k in range(chunk - 1, -1, -1):
                powers[k] = x
                x = x * b % p
            self.powers.append(powers)

    def chunks(self, data) -> Iterator[tuple[int, ...]]:
        """Prints of the chunks, hashed as matrices of ``HASH_CHUNKS`` rows (the last chunk is shorter)."""
        raw = np.frombuffer(data, np.uint8)
        step = self.chunk * HASH_CHUNKS
        for at in range(0, len(raw), step):
            part = raw[at:at + step]
            full = len(part) // self.chunk
            body, tail = part[:full * self.chunk].reshape(full, self.chunk) + np.uint64(1), part[full * self.chunk:] + np.uint64(1)
            columns = [((body * powers).sum(axis=1) % np.uint64(p)).tolist() for p, powers in zip(self.primes, self.powers)]
            yield from zip([self.chunk] * full, *columns)
            if len(tail):
                yield len(tail), *(int((tail * powers[-len(tail):]).sum() % np.uint64(p)) for p, powers in zip(self.primes, self.powers))

    def combine(self, x: tuple[int, ...], y: tuple[int, ...]) -> tuple[int, ...]:
        return (x[0] + y[0], *((a * pow(b, y[0], p) + c) % p for a, c, b, p in zip(x[1:], y[1:], self.bases, self.primes)))

    def of(self, data) -> tuple[int, ...]:
        """Print of a bytes-like object: its chunks' prints combined from left to right, none of them kept."""
        done = (0,) + (0,) * len(self.primes)
        for part in self.chunks(data):
            done = self.combine(done, part)
        return done


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", primes=PRIMES) -> DataFrame:
    """``(id, fingerprint, text_sha256)`` of every row; null texts count as empty."""
    printer_args = (primes, BASES[:len(primes)])
    content = F.coalesce(F.col(text), F.lit(""))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        printer = Fingerprint(*printer_args)
        for batch in batches:
            prints = [":".join(map(str, printer.of(t.as_buffer()))) for t in batch.column("__bytes")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string()), batch.column(2)], ["id", "fingerprint", "text_sha256"])

    rows = df.select(F.col(doc_id).alias("id"), F.encode(content, "UTF-8").alias("__bytes"), F.sha2(content, 256).alias("text_sha256"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"id {kind}, fingerprint string, text_sha256 string")


def _pieces(rows: DataFrame) -> DataFrame:
    """(…, chunk, bytes) of every text in ``rows``; an empty text has one empty chunk."""
    last = F.greatest(F.lit(0), F.floor((F.length("__bytes") - 1) / COMPARE_CHUNK)).cast("int")
    out = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    return out.withColumn("__bytes", F.expr(f"substring(__bytes, chunk * {COMPARE_CHUNK} + 1, {COMPARE_CHUNK})"))


def _differing(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Of ``members (id, text_sha256, grp, keep)``, those whose text is not the representative's.

    ``docs`` is ``(id, __bytes, text_sha256)``.  The SHA-256 only tells rows of one id apart.
    """
    texts = _pieces(docs.join(members, (docs["id"].eqNullSafe(members["id"])) & (docs["text_sha256"] == members["text_sha256"]), "inner")
                    .select(members["id"], members["text_sha256"], "grp", "keep", "keep_sha", "__bytes"))
    is_keep = F.col("id").eqNullSafe(F.col("keep")) & (F.col("text_sha256") == F.col("keep_sha"))
    keeper = (texts.filter(is_keep).groupBy("grp", "chunk").agg(F.first("__bytes").alias("kept_bytes")))
    paired = texts.filter(~is_keep).join(keeper, ["grp", "chunk"], "left")
    wrong = paired.filter(~F.col("__bytes").eqNullSafe(F.col("kept_bytes")))
    return wrong.select("id", "text_sha256", "grp").distinct()


def group_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", primes=PRIMES) -> DataFrame:
    """Every row's id with ``keep_id, group_size, kept, text_sha256``, dropped copies included.

    Texts are equal when all their bytes are; null counts as empty.  Of equal texts the
    row with the largest id stays (null ids sort below all others); rows repeated with
    the same id and text are all marked kept (``drop_copies`` leaves one).  Fingerprints
    are written to the shared folder, so this call runs jobs before it returns.
    """
    prints = written(fingerprints(df, doc_id, text, primes), "prints").withColumn("grp", F.col("fingerprint"))
    content = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(doc_id).alias("id"), F.encode(content, "UTF-8").alias("__bytes"), F.sha2(content, 256).alias("text_sha256"))
    pending = prints
    for round_ in range(1, 1 << 20):
        # null ids sort lowest in a struct comparison; max of the struct keeps the id and its row's digest together
        heads = pending.groupBy("grp").agg(F.max(F.struct("id", "text_sha256")).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        heads = written(heads, "heads")
        members = pending.join(heads, "grp").select("id", "text_sha256", "grp", F.col("head.id").alias("keep"), F.col("head.text_sha256").alias("keep_sha"))
        odd = written(_differing(docs, members), "collisions")
        if odd.isEmpty():
            break
        # the differing members leave their group together and are compared among themselves
        moved = odd.select(F.col("id").alias("o_id"), F.col("text_sha256").alias("o_sha"), F.col("grp").alias("o_grp"))
        prints = written(prints.join(moved, prints["id"].eqNullSafe(F.col("o_id")) & (prints["text_sha256"] == F.col("o_sha")) & (prints["grp"] == F.col("o_grp")), "left")
                         .withColumn("grp", F.when(F.col("o_grp").isNotNull(), F.concat("grp", F.lit(f"/{round_}"))).otherwise(F.col("grp")))
                         .select("id", "fingerprint", "text_sha256", "grp"), "prints")
        pending = prints.filter(F.col("grp").endswith(f"/{round_}"))
    groups = written(prints.groupBy("grp").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    return prints.join(groups, "grp").select(F.col("id").alias(doc_id), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each text, with the row's own columns: the largest id."""
    key, sha, own = (fresh(df, c) for c in ("__id", "__sha", "__text_sha"))
    kept = group_copies(df, doc_id, text).filter("kept").select(F.col(doc_id).alias(key), F.col("text_sha256").alias(sha)).distinct()
    rows = df.withColumn(own, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    out = rows.join(kept, rows[doc_id].eqNullSafe(F.col(key)) & (F.col(own) == F.col(sha)), "left_semi")
    # rows repeated with id and text: whole-row order decides, on rows that share the id only
    return out.dropDuplicates([doc_id, own]).drop(own)
