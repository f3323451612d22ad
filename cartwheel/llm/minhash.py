"""Near-duplicate groups by MinHash, banding, verification and star components.

1. Every text becomes its set of hashed word shingles, and the set a signature of
   ``ROWS * BANDS`` minima of universal hash functions (multiply-shift).  Identical sets
   collapse to one node, so copies cost one row each.
2. The signature is cut into bands; nodes that agree in a whole band share a bucket.  A
   pair at similarity 0.85 misses every band with probability (1 - 0.85^5)^32 < 1e-8.
3. Every member of a bucket is held against the bucket's smallest id: first signature
   against signature, then set against set.  Links are contracted by alternating
   large-star and small-star.
4. Buckets whose other members still lie in several components are compared member by
   member in blocks of bounded size: by signature, then, for members that agree with
   one of another component, by full sets.  Only links that join two components leave a
   task, so a block of n members gives fewer than n rows.

No bucket is dropped or cut short, and pairs inside a component are never listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm import shingles
from cartwheel.llm.common import written
from cartwheel.llm.star_components import star_components

ROWS, BANDS = 5, 32
HASHES = ROWS * BANDS
#: A pair is verified if its signatures agree in at least the share that the threshold expects less so many standard deviations.
DEVIATIONS = 6
#: Nodes on one side of a block when the rest of a bucket is compared.
BLOCK = 512
#: Copies of a group's row when it meets the rows of the group, so that a hot group spreads over tasks.
SPREAD = 16

_RNG = np.random.default_rng(12)
_FACTOR = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The minima of all hash functions over each set, a row of 32-bit values; an empty set has the largest values."""
    out = np.full((len(sets), HASHES), 0xFFFFFFFF, np.uint32)
    some = np.array([k for k, s in enumerate(sets) if len(s)], np.int64)
    if not len(some):
        return out
    flat = np.concatenate([sets[k] for k in some])
    starts = np.concatenate([[0], np.cumsum([len(sets[k]) for k in some])[:-1]])
    h = np.empty_like(flat)
    for k in range(HASHES):
        np.multiply(flat, _FACTOR[k], out=h)
        h += _SHIFT[k]
        h >>= np.uint64(32)
        out[some, k] = np.minimum.reduceat(h, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band of every signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        key = shingles.mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k] + np.uint64(1))
    return key


def least_agreement(percent: int) -> int:
    """Fewest equal minima with which a pair is verified."""
    s = percent / 100
    return max(1, int(HASHES * s - DEVIATIONS * (HASHES * s * (1 - s)) ** 0.5))


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """``(id, n, print, signature)`` of every row."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in shingles.chunks(batch.column(1)):
                found = shingles.sets(part, width)
                prints = [s.sum(dtype=np.uint64).tobytes() + shingles.mixed(s).sum(dtype=np.uint64).tobytes() + len(s).to_bytes(8, "little") for s in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array([len(s) for s in found], pa.int64()), pa.array(prints, pa.binary()),
                                                  pa.array([s.tobytes() for s in signatures(found)], pa.binary())], ["id", "n", "print", "signature"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(kernel, f"id {kind}, n long, print binary, signature binary")


def _banded(nodes: DataFrame) -> DataFrame:
    """``(key, id)`` of every band of every node."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = band_keys(_matrix(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))], ["key", "id"])

    kind = nodes.schema["id"].dataType.simpleString()
    return nodes.select("id", "signature").mapInArrow(kernel, f"key long, id {kind}")


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint32).reshape(len(column), HASHES)


def _agreeing(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` whose signatures agree in enough places."""
    least, kind = least_agreement(percent), nodes.schema["id"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_matrix(batch.column(2).to_pylist()) == _matrix(batch.column(3).to_pylist())).sum(axis=1)
            yield batch.select(["a", "b"]).filter(pa.array(same >= least))

    held = (pairs.distinct().join(nodes.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a")
            .join(nodes.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b"))
    return held.select("a", "b", "x", "y").mapInArrow(kernel, f"a {kind}, b {kind}")


def _sets_of(ids: DataFrame, docs: DataFrame, width: int, sketched: bool = False) -> DataFrame:
    """``(id, members, low)``: the full sets of the named ids, and on demand the low bytes of their minima."""
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in shingles.chunks(batch.column(1)):
                found = shingles.sets(part, width)
                low = [s.tobytes() for s in (signatures(found) & np.uint32(255)).astype(np.uint8)] if sketched else [None] * len(found)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array([s.tobytes() for s in found], pa.binary()), pa.array(low, pa.binary())],
                                                 ["id", "members", "low"])

    rows = docs.join(written(ids, "near-ids"), "id", "left_semi").select("id", "text")
    return written(rows.mapInArrow(members, f"id {docs.schema['id'].dataType.simpleString()}, members binary, low binary"), "near-sets")


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full shingle sets meet the threshold."""
    kind = docs.schema["id"].dataType.simpleString()
    pairs = written(pairs.distinct(), "near-pairs")
    sets = _sets_of(pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct(), docs, width)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [bool(_linked(np.frombuffer(x.as_buffer(), np.uint64), [np.frombuffer(y.as_buffer(), np.uint64)], percent)[0])
                    for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    held = (pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b"))
    return written(held.select("a", "b", "x", "y").mapInArrow(linked, f"a {kind}, b {kind}"), "near-links")


def _linked(one: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Of each of the other sets, whether it is linked with the one."""
    sizes = np.array([len(x) for x in others])
    if not len(one) or not sizes.all():
        return np.array([len(one) > 0 and len(x) > 0 and bool(_linked(one, [x], percent)[0]) for x in others])
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    both = np.add.reduceat((one[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return 100 * both >= percent * (len(one) + sizes - both)


def _tiles(buckets: DataFrame, label: DataFrame) -> DataFrame:
    """Blocks of the buckets whose members, without the pivot, lie in several components.

    Buckets with the same members are taken once.  A bucket is cut into blocks, and a tile
    holds two of them at most.
    """
    rest = (buckets.filter("id <> pivot").join(label, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component")))
    rest = written(rest, "near-rest")
    open_ = (rest.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("component").alias("lo"), F.max("component").alias("hi"),
                                     F.bit_xor(F.xxhash64("id")).alias("h"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("g"))
             .filter("lo <> hi").dropDuplicates(["m", "h", "g"]).select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    open_ = written(open_, "near-open")
    own = F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")
    tiles = (rest.join(open_, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), F.col("own").alias("side"),
                     (F.col("own") != F.col("other")).alias("across"), "id", "component"))
    return written(tiles, "near-tiles")


def _candidates(tile: pd.DataFrame, least: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each member of a tile with the later ones of other components (and blocks) whose minima agree often enough."""
    component, side, across = (tile[c].to_numpy() for c in ("component", "side", "across"))
    low = np.frombuffer(b"".join(tile["low"]), np.uint8).reshape(len(tile), HASHES)
    for k in range(len(tile) - 1):
        later = np.arange(k + 1, len(tile))
        later = later[(component[later] != component[k]) & (~across[k] | (side[later] != side[k]))]
        if len(later):
            later = later[(low[later] == low[k]).sum(axis=1) >= least]
            if len(later):
                yield k, later


def _rest_links(tiles: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links between different components inside the tiles, at most one fewer than a tile has members.

    Members meet by the low bytes of their minima (equal minima have equal bytes, so
    nothing that could link is lost), and those that agree by their full sets.  Links
    that close a circle stay in the task.
    """
    least, kind = least_agreement(percent), docs.schema["id"].dataType.simpleString()
    size = F.pmod("tile", F.lit(max(1, tiles.count() // 2048)))
    sets = _sets_of(tiles.select("id").distinct(), docs, width, sketched=True)

    def contract(part: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, tile in part.groupby("tile", sort=False):
            ids, members = tile["id"].to_numpy(), [np.frombuffer(m, np.uint64) for m in tile["members"]]
            group = pd.factorize(tile["component"])[0]
            for k, later in _candidates(tile, least):
                later = later[group[later] != group[k]]
                if len(later):
                    for m in later[_linked(members[k], [members[m] for m in later], percent)]:
                        if group[m] != group[k]:
                            group[group == group[m]] = group[k]
                            a.append(ids[k])
                            b.append(ids[m])
        return pd.DataFrame({"a": np.array(a, ids.dtype) if a else part["id"].to_numpy()[:0], "b": np.array(b, ids.dtype) if a else part["id"].to_numpy()[:0]})

    return written(tiles.join(sets, "id").groupBy(size.alias("task")).applyInPandas(contract, f"a {kind}, b {kind}"), "near-links")


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` of every row; ``kept`` marks the smallest id of a group.

    Documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of
    ``width``-word shingles (A-Z lower-cased).  A null or empty text, or one without
    words, has an empty set and is linked with nothing.  Rows that share an id are one
    document: the links of any of its texts count for it, and each row tells its own
    n_shingles.  A row with a null id is not linked, has a null component and is kept.
    ``doc_id`` must be an integer; other columns are left out.  Runs jobs before it returns.
    """
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    table = written(_signed(docs, width), "near-signed")
    same = table.filter("n > 0 AND id IS NOT NULL")
    groups = written(same.groupBy("print").agg(F.min("id").alias("lead"), F.max("id").alias("top"), F.count(F.lit(1)).alias("m")), "near-copies")
    copied = groups.filter("lead <> top").select("print", "lead")
    copied = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    salt = F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")
    led = written(same.withColumn("salt", salt).join(copied, ["print", "salt"], "left")
                  .select("id", "n", "print", "signature", F.coalesce("lead", "id").alias("lead")), "near-led")
    nodes = led.filter("id = lead").select("id", "signature")
    # of rows with one id and one set a single node is left; different sets of one id stay apart until they are linked below
    nodes = written(nodes.dropDuplicates(["id", "signature"]), "near-nodes")
    repeated = led.groupBy("id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).filter("lo <> hi").select("id")
    own = led.join(repeated, "id", "left_semi").filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))

    keys = _banded(nodes)
    shared = keys.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("top")).filter("pivot <> top").select("key", "pivot")
    buckets = written(keys.join(written(shared, "near-keys"), "key"), "near-buckets")

    links = _verified(_agreeing(buckets.filter("id <> pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")), nodes, percent), docs, width, percent)
    more = _rest_links(_tiles(buckets, written(star_components(links), "near-label")), docs, width, percent)
    label = written(star_components(links.unionAll(more).unionAll(own)), "near-label")

    member = led.select("id", "n", "lead").join(_salted(label), (F.col("lead") == F.col("node")) & (salt == F.col("salt")), "left").select("id", "n", F.coalesce("component", "lead").alias("component"))
    loose = table.filter("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component"))
    out = member.unionAll(loose)
    return out.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def _salted(label: DataFrame) -> DataFrame:
    return label.select(F.col("id").alias("node"), "component").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
