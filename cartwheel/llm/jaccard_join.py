"""Exact Jaccard similarity join of shingle sets in a metric space.

Sets are embedded in a space of bucket counts, where the distance L1 never exceeds the
symmetric difference, so linked sets lie within ``R`` of each other.  The join:

1. identical sets collapse to one representative;
2. every set enters regions: one for each of the hashed shingles at the head of its
   order, by class of set size.  Linked sets share a shingle there (the order puts
   shingles that are frequent somewhere last, so that regions are small);
3. a region picks its most central set as pivot; all members are held against it, and
   what is linked through pivots is contracted to components;
4. a region that still holds several components and is large is cut into the Voronoi
   cells of several pivots, where a set joins each cell whose pivot is at most
   ``2 R`` farther than its nearest (triangle inequality); cells are cut again until they
   are small, and a cut that copies too many sets is not used;
5. small regions are joined directly, and those that cannot be cut in blocks of bounded
   size; only pairs of different components within ``R`` leave a task, and every pair
   is verified on the whole sets with integer arithmetic.

No step drops a pair that could be linked, so components are exact.
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
from cartwheel.llm.components import components

BUCKETS, COARSE = 256, 64  # distances are first taken between sums of neighbouring buckets
#: A task reports a shingle as frequent from so many sets on; the table keeps the most frequent ones.
LOCAL_FREQUENT, FREQUENT_SHINGLES = 4, 300_000
#: Regions up to this size are joined directly; larger ones are cut by so many pivots.
SMALL_REGION, PIVOTS, MAX_DEPTH = 2048, 8, 4
#: A cut into cells is kept if boundary sets make its rows at most so many times as many.
MOST_COPIES = 2


class Threshold:
    """Integer bounds for ``100 * |A & B| >= percent * |A | B|``."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]
        while self.edges[-1] < 1 << 40:
            self.edges.append(self.edges[-1] * 100 // percent + 1)
        self.edges = np.array(self.edges)

    def size_class(self, n: int) -> int:
        """Linked sets are of the same or of neighbouring classes."""
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def heads(self, n: int) -> tuple[int, int]:
        """Length of the head that meets larger or equal sets of the same class, and of that which meets the next class."""
        t = self.percent
        return n - -(-t * n // 100) + 1, n - -(-2 * t * n // (100 + t)) + 1

    def apart(self, n):
        """Most that the symmetric difference of linked sets can be, by the sum of their sizes (times 100 + percent)."""
        return (100 - self.percent) * n


def _frequent(docs: DataFrame, width: int) -> np.ndarray:
    """Shingles that are frequent inside some task; orders the regions, changes no result.  Bounded by FREQUENT_SHINGLES."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0

        def flush():
            h, n = np.unique(np.concatenate(kept), return_counts=True)
            often = n >= LOCAL_FREQUENT
            return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "n"])

        for batch in batches:
            for _, part in shingles.chunks(batch.column(0)):
                for s in shingles.sets(part, width):
                    kept.append(s)
                    size += len(s)
                if size > 4_000_000:
                    yield flush()
                    kept, size = [], 0
        if kept:
            yield flush()

    most = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(FREQUENT_SHINGLES)
    return np.sort(most.toPandas()["h"].to_numpy(np.int64).view(np.uint64))


def _set_table(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(id, n, print, sketch, heads)`` of every row: set size, fingerprint, bucket counts, region keys."""
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, width))
    # region keys are as wide as the input needs: two shingles that share one only make a region larger
    spare_bits = np.uint64(max(1, 64 - (docs.count().bit_length() + 18)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound, often = Threshold(percent), frequent.value
        for batch in batches:
            sizes, prints, sketches, heads = [], [], [], []
            for _, part in shingles.chunks(batch.column(1)):
                for s in shingles.sets(part, width):
                    n = len(s)
                    sizes.append(n)
                    prints.append(f"{int(s.sum(dtype=np.uint64)):x}.{int(shingles.mixed(s).sum(dtype=np.uint64)):x}.{n}")
                    sketches.append(np.minimum(np.bincount((s & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes())
                    if not n:
                        heads.append(np.zeros(0, np.int64))
                        continue
                    order = s >> np.uint64(1)
                    if len(often):
                        at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                        order |= (often[at] == s).astype(np.uint64) << np.uint64(63)
                    own, up = bound.heads(n)
                    c = bound.size_class(n)
                    head = np.sort(order)[:max(own, up)]
                    keys = [shingles.mixed(head[:m] * np.uint64(2) + np.uint64(k * 0x9E3779B9 + 1)) for m, k in ((own, c), (up, c + 1))]
                    heads.append((np.concatenate(keys) >> spare_bits).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints), pa.array(sketches, pa.binary()),
                                              pa.array(heads, pa.list_(pa.int64()))], ["id", "n", "print", "sketch", "heads"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(kernel, f"id {kind}, n long, print string, sketch binary, heads array<long>")


def _l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of a to all rows of b."""
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += np.abs(a[:, k, None] - b[None, :, k])
    return out


def _coarse(matrix: np.ndarray) -> np.ndarray:
    """Sums of neighbouring buckets; distances between them are bounds as well."""
    return matrix.reshape(len(matrix), COARSE, -1).sum(axis=2, dtype=np.int16)


def _matrix(sketches: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), BUCKETS).astype(np.int16)


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose whole sets meet the threshold."""
    pairs = written(pairs.distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b")).distinct()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [s.tobytes() for _, part in shingles.chunks(batch.column(1)) for s in shingles.sets(part, width)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "members"])

    kind = docs.schema["id"].dataType.simpleString()
    # rows repeated with their id repeat a pair, which does no harm
    members = written(docs.join(written(ids, "ids"), "id", "left_semi").mapInArrow(kernel, f"id {kind}, members binary"), "sets")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    joined = (pairs.join(members.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
              .join(members.select(F.col("id").alias("b"), F.col("members").alias("y")), "b"))
    return written(joined.select("a", "b", "x", "y").mapInArrow(linked, f"a {kind}, b {kind}"), "links")


def _could_link(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``(a, b)`` that sketch distance and sizes leave possible."""
    kind = nodes.schema["id"].dataType.simpleString()
    held = (pairs.distinct().join(nodes.select(F.col("id").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("x")), "a")
            .join(nodes.select(F.col("id").alias("b"), "n", F.col("sketch").alias("y")), "b"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            apart = np.abs(_matrix(b["x"]) - _matrix(b["y"])).sum(axis=1)
            yield b.loc[(100 + percent) * apart <= (100 - percent) * (b["m"] + b["n"]), ["a", "b"]]

    return held.mapInPandas(near, f"a {kind}, b {kind}")


def _star(rows: DataFrame, degree: DataFrame) -> DataFrame:
    """Pairs of every member of a region and its pivot, the set that stands in the most shared regions."""
    central = F.max_by("id", F.col("degree") * (1 << 32) + F.pmod(F.xxhash64("id"), F.lit(1 << 32)))
    pivots = written(rows.join(degree, "id").groupBy("region").agg(central.alias("pivot")), "pivots")
    return rows.join(pivots, "region").filter("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b"))


def _open(regions: DataFrame) -> DataFrame:
    """Regions with several components, with their number of members and largest set."""
    return regions.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("top"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("region", "m", "top")


def _cells(regions: DataFrame, percent: int, depth: int) -> DataFrame:
    """Cut regions into the cells of their pivots, boundary sets into every cell they could have a link in."""
    ranked = regions.groupBy("region").agg(F.slice(F.sort_array(F.collect_set(F.when(F.pmod(F.xxhash64("id", F.lit(depth)), F.greatest(F.lit(1), (F.col("m") / 64).cast("long"))) == 0,
                                                                                      F.struct(F.xxhash64("id", F.lit(depth)).alias("k"), "sketch")))), 1, PIVOTS).alias("pivots"))
    pivots = written(ranked.select("region", F.transform("pivots", lambda p: p["sketch"]).alias("pivots")), "pivots")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, part in b.groupby("region", sort=False):
                centres, reach = part["pivots"].iloc[0], 2 * ((100 - percent) * 2 * part["top"].iloc[0] // (100 + percent))
                d = _l1(_coarse(_matrix(part["sketch"])), _coarse(_matrix(pd.Series(list(centres))))) if len(centres) else np.zeros((len(part), 1))
                row, cell = np.nonzero(d <= d.min(axis=1, keepdims=True) + reach)
                yield part.iloc[row].drop(columns=["pivots"]).assign(cell=cell)

    columns = ["region", "id", "n", "sketch", "component", "m", "top"]
    kinds = ", ".join(f"{c} {regions.schema[c].dataType.simpleString()}" for c in columns)
    cut = regions.select(columns).join(pivots, "region").mapInPandas(assign, f"{kinds}, cell long")
    return cut.withColumnRenamed("region", "parent").withColumn("region", F.xxhash64("parent", "cell", F.lit(depth))).drop("cell")


def _direct(regions: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components that could be linked, of every region, by blocks of at most SMALL_REGION sets a side.

    Many small regions share a task; all their pairs are held against each other offset
    by offset as arrays.
    """
    kind = regions.schema["id"].dataType.simpleString()
    blocks = F.ceil(F.col("m") / SMALL_REGION).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    # block pairs i <= j: a set goes to the pairs with its block on either side
    tiled = (regions.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("cross", F.col("own") != F.col("other"))
             .select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), F.col("own").alias("side"), "cross", "id", "n", "sketch", "component"))
    tiled = written(tiled, "tiles")
    groups = max(1, tiled.count() // 4096)

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["tile", "id"], kind="stable")
        tile, side, cross, ids, n, component = (part[c].to_numpy() for c in ("tile", "side", "cross", "id", "n", "component"))
        sketch, a, b = _matrix(part["sketch"]), [], []
        coarse = _coarse(sketch)
        here = np.arange(len(part))
        for offset in range(1, len(part)):
            here = here[here + offset < len(part)]
            here = here[tile[here] == tile[here + offset]]
            if not len(here):
                break
            x = here[(component[here] != component[here + offset]) & (~cross[here] | (side[here] != side[here + offset]))]
            y = x + offset
            x, y = x[good := (100 + percent) * np.abs(n[x] - n[y]) <= (100 - percent) * (n[x] + n[y])], y[good]
            for points in (coarse, sketch):
                apart = np.abs(points[x] - points[y]).sum(axis=1)
                good = (100 + percent) * apart <= (100 - percent) * (n[x] + n[y])
                x, y = x[good], y[good]
            a.append(ids[x])
            b.append(ids[y])
        a, b = (np.concatenate(v) if v else ids[:0] for v in (a, b))
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()

    return tiled.groupBy(F.pmod("tile", F.lit(groups)).alias("task")).applyInPandas(join, f"a {kind}, b {kind}")


def link_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """``(id, n_shingles, component_id)`` of every row.

    Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of
    ``width``-word shingles (A-Z lower-cased); component_id is the smallest id reachable.
    A null or empty text, or one without words, has an empty set and its own component.  A
    row with a null id is not joined and has a null component.  Repeated rows share
    theirs; different texts of one id are not told apart.  ``doc_id`` must be an integer.
    Runs jobs before it returns.
    """
    docs = df.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    table = written(_set_table(docs, width, percent), "sets")
    same = table.filter("n > 0 AND id IS NOT NULL")
    leads = written(same.groupBy("print").agg(F.min("id").alias("lead")), "leads")
    # one row of every distinct set; rows that share the lead's id but not its set are told apart by the print
    heads = (same.join(leads, (same["print"] == leads["print"]) & (same["id"] == leads["lead"])).select(same["print"], "id", "n", "heads").dropDuplicates(["print"]))
    # nodes are prints, numbered by their lead: distinct prints may share a lead only if an id repeats
    keys = heads.select("id", F.explode("heads").alias("region"))
    shared = keys.groupBy("region").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("region")
    rows = written(keys.join(shared, "region"), "regions")
    degree = written(rows.groupBy("id").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    nodes = written(same.select("id", "n", "sketch").join(degree.select("id"), "id", "left_semi").dropDuplicates(["id"]), "nodes")

    links = _verified(_could_link(_star(rows, degree), nodes, percent), docs, width, percent)
    label = components(links)
    labelled = written(rows.join(nodes.select("id", "n"), "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id")), "labelled")
    rest = labelled.join(written(_open(labelled).filter("m > 2"), "open"), "region").join(nodes.select("id", "sketch"), "id")
    rest = written(rest.select("region", "id", "n", "sketch", "component", "m", "top"), "open-regions")
    done = rest.filter(F.col("m") <= SMALL_REGION)
    large = rest.filter(F.col("m") > SMALL_REGION)
    for depth in range(MAX_DEPTH):
        if large.isEmpty():
            break
        cut = written(_cells(large, percent, depth), "cells")
        useful = (cut.groupBy("parent").agg(F.count(F.lit(1)).alias("rows"), F.max("m").alias("m"), F.count_distinct("region").alias("cells"))
                  .filter((F.col("rows") <= MOST_COPIES * F.col("m")) & (F.col("cells") > 1)).select("parent"))
        useful = written(useful, "useful-cuts")
        done = done.unionAll(large.join(useful.withColumnRenamed("parent", "region"), "region", "left_anti"))
        cut = cut.join(useful, "parent", "left_semi").drop("parent", "m", "top")
        cut = written(cut.join(written(_open(cut), "open"), "region").select(rest.columns), "cells")
        done = done.unionAll(cut.filter(F.col("m") <= SMALL_REGION))
        large = cut.filter(F.col("m") > SMALL_REGION)
    more = _verified(_direct(done.unionAll(large), percent), docs, width, percent)
    label = components(links.unionAll(more))

    lead = table.join(leads, "print", "left").join(label.select(F.col("id").alias("lead"), "component"), "lead", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "lead")).otherwise(F.col("id"))
    return lead.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own).alias("component_id"))
