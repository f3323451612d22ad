"""Removal of long repeated byte strings by a distributed, sampled suffix array.

A byte goes if a string of ``length`` bytes that covers it also starts elsewhere.  Of
all suffixes only those at *anchors* are sorted: in every window of ``length`` bytes
the smallest hash of the 50-byte grams inside marks an anchor, so equal windows have
their anchor at the same offset, and a window is known by its anchor and that offset.

1. Anchors of all texts; an anchor whose gram occurs once in the corpus proves that
   its windows occur once, and is dropped by an aggregation and a join.
2. Each remaining anchor is one suffix record: the bytes after it (the suffix) and
   before it, as far as its windows reach.  Equal records collapse to one with a count,
   so copies of a text weigh nothing.
3. Records are range-partitioned by the leading bytes of the suffix at sampled
   splitters.  A bucket sorts its suffixes, and the reversed bytes before them, by
   multikey sorting; the longest common prefixes of neighbours tell for every offset
   which windows are equal.  Records with one lead never straddle a boundary; a lead
   with very many records is compared across buckets by its windows' digests instead.
4. Records carry their repeated offsets back to the texts that hold them.

Texts are known by digest throughout, so ids need not be unique.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import written
from cartwheel.llm.shingles import mixed

GRAM = 50
#: Records that share a gram are sorted in one bucket up to this number.
HOT_LEAD = 20_000
#: Records that a bucket sorts together.
SORT_ROWS = 8_192
_PIECE = 1 << 22
_BASE = 0x9E3779B97F4A7C15
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64))


def _gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-byte grams, by doubling."""
    power, out, have, width, rest = _BYTE[data], None, 0, 1, q
    while True:
        if rest & 1:
            n = len(data) - have - width + 1
            out = power[:n].copy() if out is None else out[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + power[have:have + n]
            have += width
        rest >>= 1
        if not rest:
            return mixed(out)
        power = power[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
        width *= 2


def _window_minima(key: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[:len(key) - (w - size)], key[w - size:])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, gram hashes, first and last start of the windows each anchor stands for)."""
    found = []
    for begin in range(0, max(0, len(data) - length + 1), _PIECE):
        piece = np.frombuffer(data, np.uint8, min(len(data) - begin, _PIECE + length - 1), begin)
        h = _gram_hashes(piece, GRAM)
        low = np.uint64((1 << 24) - 1)  # equal hashes: the leftmost
        at = (_window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), length - GRAM + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        found.append((at[first] + begin, h[at[first]], first + begin, last + begin))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found))


def _rows(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for t in batch.column(column):
        yield t.as_buffer().to_pybytes()


def _anchor_rows(texts: DataFrame, length: int) -> DataFrame:
    """``(key, grams)`` of each text that is long enough: positions in order, hashes."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, grams = [], []
            for data in _rows(batch, "bytes"):
                pos, h, _, _ = anchors(data, length)
                at.append(pos)
                grams.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(at, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))], ["key", "at", "gram"])

    rows = texts.filter(F.length("bytes") >= length).mapInArrow(kernel, "key binary, at array<long>, gram array<long>")
    return rows.select("key", F.explode(F.arrays_zip("at", "gram")).alias("x")).select("key", "x.at", "x.gram")


def _records(packed: DataFrame, length: int) -> DataFrame:
    """One row per repeated anchor: record digest, text key, position, suffix, reversed prefix and offsets.

    ``packed`` is ``(key, packed, at)``; offsets are distances from a window's start to its anchor.
    """
    schema = "record binary, key binary, at long, lead binary, suffix binary, before binary, low int, high int"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        names = ["record", "key", "at", "lead", "suffix", "before", "low", "high"]
        kinds = [pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
        for batch in batches:
            rows, size = [], 0
            for key, zipped, wanted in zip(batch.column("key"), _rows(batch, "packed"), batch.column("at")):
                data, key = unpack.decompress(zipped), key.as_py()
                pos, _, first, last = anchors(data, length)
                chosen = np.isin(pos, wanted.values.to_numpy())
                for a, p, q in zip(pos[chosen].tolist(), first[chosen].tolist(), last[chosen].tolist()):
                    after, before = data[a:q + length], data[p:a][::-1]
                    digest = hashlib.blake2b(b"%d %d " % (len(before), len(after)) + before + after, digest_size=16).digest()
                    rows.append((digest, key, a, after[:GRAM], after, before, a - q, a - p))
                    size += len(after) + len(before)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return packed.mapInArrow(kernel, schema)


def _symbols(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrix of symbols (byte plus one, 0 past the end) and the same packed seven to a word."""
    width = -(-max(width, 1) // 7) * 7
    size = np.fromiter(map(len, strings), np.int64, len(strings))
    out = np.zeros((len(strings), width), np.uint16)
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1
    row = np.repeat(np.arange(len(strings)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    words = np.zeros((len(strings), width // 7), np.uint64)
    for k in range(7):
        words = (words << np.uint64(9)) | out[:, k::7].astype(np.uint64)
    return out, words


def multikey_sort(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of rows by group, then word by word; only rows still tied are looked at again."""
    order = np.argsort(group, kind="stable")
    rank = group[order]
    tied = np.arange(len(order))
    for c in range(words.shape[1]):
        if not len(tied):
            break
        key = words[order[tied], c]
        moved = np.lexsort((key, rank[tied]))
        order[tied], key = order[tied][moved], key[moved]
        inside = rank[tied]  # ranks are in order already and moves stay inside a rank
        new = np.concatenate([[True], (inside[1:] != inside[:-1]) | (key[1:] != key[:-1])])
        rank[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        same = ~new
        keep = same.copy()
        keep[:-1] |= same[1:]
        tied = tied[keep]
    return order


def _common(symbols: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Longest common prefix of each row in order with the row before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 4096):
        x, y = symbols[order[lo:lo + 4096]], symbols[order[lo - 1:lo + 4095]][:len(order[lo:lo + 4096])]
        differs = (x != y) | (x == 0)  # a string's end is no common byte
        out[lo:lo + 4096] = np.where(differs.any(axis=1), differs.argmax(axis=1), symbols.shape[1])
    return out


def repeated_offsets(suffixes: list[bytes], befores: list[bytes], low: np.ndarray, high: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Matrix (record, offset): does the window at that offset occur at least twice?"""
    n = len(suffixes)
    lead, group = np.unique(np.array([s[:GRAM].hex() for s in suffixes]), return_inverse=True)
    after, words = _symbols(suffixes, length)
    order_a = multikey_sort(words, group)
    common_a = _common(after, order_a)
    before, words = _symbols(befores, length - GRAM)
    order_b = multikey_sort(words, group)
    common_b = _common(before, order_b)
    common_b[np.concatenate([[True], group[order_b][1:] != group[order_b][:-1]])] = -1
    common_a[:1] = -1
    out = np.zeros((n, length - GRAM + 1), bool)
    class_a, class_b = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(length - GRAM + 1):
        rows = np.flatnonzero((low <= offset) & (offset <= high))
        if len(rows) == 0:
            continue
        class_a[order_a] = np.cumsum(common_a < length - offset)
        class_b[order_b] = np.cumsum(common_b < offset)
        both = class_a[rows] * (n + 1) + class_b[rows]
        _, place = np.unique(both, return_inverse=True)
        out[rows, offset] = np.bincount(place, count[rows])[place] > 1
    return out


def _runs(hit: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """Byte ranges, from the anchor, that the windows of a row's repeated offsets cover."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return (1 - edge[1::2]).tolist(), (length - edge[::2]).tolist()


_SPANS = "record binary, begins array<int>, ends array<int>"


def _in_buckets(records: DataFrame, length: int) -> DataFrame:
    """Covered ranges of every record; whole leads of a range partition are sorted together."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def solve(part: list[tuple]) -> pa.RecordBatch:
            record, _, suffix, before, low, high, count = zip(*part)
            hits = repeated_offsets(list(suffix), list(before), np.array(low), np.array(high), np.array(count), length)
            some = np.flatnonzero(hits.any(axis=1))
            runs = [_runs(hits[k], length) for k in some]
            return pa.RecordBatch.from_arrays([pa.array([record[k] for k in some], pa.binary()), pa.array([b for b, _ in runs], pa.list_(pa.int32())),
                                               pa.array([e for _, e in runs], pa.list_(pa.int32()))], ["record", "begins", "ends"])

        for batch in batches:
            rows += zip(*(batch.column(c).to_pylist() for c in ("record", "lead", "suffix", "before", "low", "high", "count")))
            while len(rows) >= SORT_ROWS:
                cut = SORT_ROWS
                while cut < len(rows) and rows[cut][1] == rows[cut - 1][1]:
                    cut += 1
                if cut == len(rows):  # the lead may go on in the next batch
                    break
                yield solve(rows[:cut])
                rows = rows[cut:]
        if rows:
            yield solve(rows)

    return records.repartitionByRange("lead").sortWithinPartitions("lead").mapInArrow(kernel, _SPANS)


def _across_buckets(records: DataFrame, length: int) -> DataFrame:
    """The same for records of hot leads: windows are counted by digest, which any number of tasks can share."""
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["record", "suffix", "before", "low", "high", "count"]).to_pylist():
                whole = row["before"][::-1] + row["suffix"]
                offsets = list(range(row["low"], row["high"] + 1))
                digests = [hashlib.blake2b(whole[len(row["before"]) - i:len(row["before"]) - i + length], digest_size=16).digest() for i in offsets]
                yield pa.RecordBatch.from_arrays([pa.array([row["record"]] * len(offsets), pa.binary()), pa.array(offsets, pa.int32()), pa.array(digests, pa.binary()),
                                                  pa.array([row["count"]] * len(offsets), pa.int64())], ["record", "offset", "window", "count"])

    rows = written(records.mapInArrow(windows, "record binary, offset int, window binary, count long"), "windows")
    twice = written(rows.groupBy("window").agg(F.sum("count").alias("c")).filter("c > 1").select("window"), "twice")
    hits = rows.join(twice, "window").groupBy("record").agg(F.sort_array(F.collect_list("offset")).alias("offsets"))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = []
            for offsets in batch.column("offsets"):
                hit = np.zeros(length - GRAM + 1, bool)
                hit[offsets.values.to_numpy()] = True
                runs.append(_runs(hit, length))
            yield pa.RecordBatch.from_arrays([batch.column("record"), pa.array([b for b, _ in runs], pa.list_(pa.int32())), pa.array([e for _, e in runs], pa.list_(pa.int32()))],
                                             ["record", "begins", "ends"])

    return hits.mapInArrow(spans, _SPANS)


def _packed(texts: DataFrame) -> DataFrame:
    """Texts compressed before they are shuffled."""
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([pack.compress(d) for d in _rows(batch, "bytes")], pa.binary())], ["key", "packed"])

    return texts.select("key", "bytes").mapInArrow(kernel, "key binary, packed binary")


def repeated_spans(texts: DataFrame, length: int = 200) -> DataFrame:
    """``(key, begins, ends)``: byte ranges of each text in ``texts (key, bytes)`` to remove, not yet merged.

    Rows of one key must have the same bytes; a text that stands on several rows repeats
    itself.  Texts without a repeat have no row.
    """
    found = written(_anchor_rows(texts, length), "anchors")
    twice = found.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram")
    kept = found.join(written(twice, "grams"), "gram").groupBy("key").agg(F.collect_set("at").alias("at"))
    rows = _records(_packed(texts).join(written(kept, "kept"), "key"), length)
    rows = written(rows, "records")
    records = written(rows.groupBy("record").agg(*[F.first(c).alias(c) for c in ("lead", "suffix", "before", "low", "high")], F.count(F.lit(1)).alias("count")), "distinct-records")
    hot = written(records.groupBy("lead").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > HOT_LEAD).select("lead"), "hot-leads")
    spans = _in_buckets(records.join(hot, "lead", "left_anti"), length)
    if not hot.isEmpty():
        spans = spans.unionAll(_across_buckets(records.join(hot, "lead", "left_semi"), length))
    spans = written(spans, "spans")
    shift = lambda c: F.transform(c, lambda x: x + F.col("at"))
    placed = rows.select("record", "key", "at").join(spans, "record").select("key", F.explode(F.arrays_zip(shift("begins").alias("b"), shift("ends").alias("e"))).alias("x"))
    return placed.groupBy("key").agg(F.collect_set("x").alias("spans"))


def remove_repeats(df: DataFrame, text: str = "text", length: int = 200, with_text: bool = False) -> DataFrame:
    """Add ``n_bytes, n_removed, n_spans, kept_sha256`` (and ``kept`` bytes) to every row; columns of these names are replaced.

    Every byte that a ``length``-byte string covers which also starts elsewhere in the
    corpus (same text included, overlaps count) is removed; what is judged is the input.
    Null counts as empty; shorter texts keep all.  Runs jobs before it returns.
    """
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    bytes_ = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    key = F.unhex(F.substring(F.sha2(bytes_, 256), 1, 32))
    texts = df.select(key.alias("key"), bytes_.alias("bytes"))
    spans = written(repeated_spans(texts, length), "text-spans")
    schema = "__key binary, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            removed, number, digest, kept = [], [], [], []
            for zipped, ranges in zip(_rows(batch, "packed"), batch.column("spans").to_pylist()):
                data, parts, end, begin, gone, runs = unpack.decompress(zipped), [], 0, -1, 0, 0
                for x in sorted((x["b"], x["e"]) for x in ranges):
                    if begin < 0 or x[0] > end:
                        parts.append(data[end:x[0]])
                        begin, runs = x[0], runs + 1
                        gone += x[1] - x[0]
                    else:
                        gone += max(0, x[1] - end)
                    end = max(end, x[1])
                rest = b"".join(parts) + data[end:]
                removed.append(gone)
                number.append(runs)
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [batch.column("key"), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(digest)] + [pa.array(kept, pa.binary())] * with_text
            yield pa.RecordBatch.from_arrays(columns, ["__key", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text)

    # copies of a text collapse before its bytes are cut
    changed = _packed(texts).join(spans, "key").dropDuplicates(["key"]).mapInArrow(cut, schema)
    rows = df.drop(*[c for c in new if c in df.columns and c != text]).withColumns({"__key": key, "n_bytes": F.length(bytes_).cast("long"), "__sha": F.sha2(bytes_, 256)})
    out = rows.join(written(changed, "cut"), "__key", "left")
    out = out.withColumns({"n_removed": F.coalesce("n_removed", F.lit(0).cast("long")), "n_spans": F.coalesce("n_spans", F.lit(0).cast("long")),
                           "kept_sha256": F.coalesce("kept_sha256", "__sha")})
    if with_text:
        out = out.withColumn("kept", F.coalesce("kept", bytes_))
    return out.drop("__key", "__sha")
