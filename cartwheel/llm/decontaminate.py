"""Benchmark decontamination by q-gram lemma filtering.

A passage within ``k`` edits of an item of length ``m`` shares at least
``m - q + 1 - k q`` q-grams with it, and their positions lie within ``k`` diagonals of
each other.  Shared q-grams of a document and the items are counted in overlapping
diagonal bands (width 2 (k + 1), step k + 1, so any run of k + 1 diagonals lies whole in
one band); bands that meet the bound are verified by banded alignment of the item with
the region.  Items shorter than the bound allows are searched with a smaller q.  Items too
short for an edit must occur unedited and from word bound to word bound; whole items are
looked up at all such places of the text.

The items are the query set: they are read in blocks of bounded size, each sent to the
tasks as sorted NumPy arrays, and every block is held against all documents in one pass.
No document ever moves except to report a hit.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of items in one block.
BLOCK_CHARS = 4_000_000
#: Edits allowed per character of the item.
EDIT_SHARE = 0.05
#: Length of the q-grams at most; q falls for short items until the bound is positive.
Q = 12
#: Characters that an item has at least after normalisation: only empty ones are no items.
MIN_CHARS = 1
#: Scripts written without spaces, where every character may begin a word.
_UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]
#: Pairs of a run and an item's q-gram that are counted at once.
PAIRS = 1 << 20
#: Diagonals that are aligned at once.
WIDE = 1 << 14
#: Numbers apart for the bands of two items.
_SPREAD = 1 << 40
_MIX = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    """Lower case, white space as one space."""
    return " ".join(text.lower().split())


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(code: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams of a sequence of code points, built by doubling."""
    if len(code) < q:
        return np.zeros(0, np.uint64)
    base, width = int(_MIX), 1
    power = code.astype(np.uint64) + np.uint64(1)
    power *= _MIX  # spreads the code points
    power ^= power >> np.uint64(29)
    out, have, rest = None, 0, q
    while True:
        if rest & 1:
            n = len(code) - have - width + 1
            out = power[:n].copy() if out is None else out[:n] * np.uint64(pow(base, width, 1 << 64)) + power[have:have + n]
            have += width
        rest >>= 1
        if not rest:
            break
        power = power[:-width] * np.uint64(pow(base, width, 1 << 64)) + power[width:] if len(power) > width else power[:0]
        width *= 2
    out ^= out >> np.uint64(31)
    return out


def budget(m: int, share: float = EDIT_SHARE) -> int:
    return int(m * share)


def least_shared(m: int, k: int, q: int) -> int:
    return m - q + 1 - k * q


class Block:
    """Items with one q and lengths within a factor of two, as arrays sorted by q-gram hash."""

    def __init__(self, q: int, items: list[tuple[int, np.ndarray, int]]):
        self.q, self.items = q, items
        hashes, item, at = [], [], []
        for k, (_, code, _) in enumerate(items):
            h = gram_hashes(code, q)
            hashes.append(h)
            item.append(np.full(len(h), k, np.int32))
            at.append(np.arange(len(h), dtype=np.int32))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hash, self.item, self.at = h[order], np.concatenate(item)[order], np.concatenate(at)[order]
        self.bits = max(16, int(len(h) * 16).bit_length())
        self.maybe = np.zeros(1 << self.bits, bool)  # most q-grams of a document are told apart here
        self.maybe[(h >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.edits = np.array([e for _, _, e in items])
        self.reach = max(len(c) + e for _, c, e in items)
        self.need = np.array([max(1, least_shared(len(c), e, q)) for _, c, e in items])

    def dense(self, spot: np.ndarray) -> np.ndarray:
        """Text positions that have the least shared q-grams of any item within the longest region."""
        few = int(self.need.min())
        if len(spot) < few:
            return spot[:0]
        close = spot[few - 1:] - spot[:len(spot) - few + 1] <= self.reach
        edge = np.zeros(len(spot) + 1, np.int64)
        edge[:len(close)] += close
        edge[few:few + len(close)] -= close
        return spot[np.cumsum(edge[:-1]) > 0]

    def bands(self, h: np.ndarray) -> list[tuple[int, int, int]]:
        """(item, first diagonal, last diagonal) of regions whose bands share enough q-grams; a diagonal is text minus item position.

        ``h`` are the hashes of the text's q-grams.  Shared q-grams are counted by runs of
        text positions and in slices, so that a text of one repeated character costs an item
        no more than its bands.
        """
        spot = self.dense(np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.bits)).astype(np.int64)]))
        if not len(spot):
            return []
        lo = np.searchsorted(self.hash, h[spot], "left")
        n = np.searchsorted(self.hash, h[spot], "right") - lo
        real = self.dense(spot[n > 0])
        among = np.searchsorted(spot, real)
        spot, lo, n = real, lo[among], n[among]
        if not len(spot):
            return []
        # a run: text positions of one q-gram, each at most the smallest step behind the one before; it fills its cells without a hole
        order = np.lexsort((spot, lo))
        spot, lo, n = spot[order], lo[order], n[order]
        same = lo[1:] == lo[:-1]
        opens = np.append(True, ~same | (np.diff(spot) > int(self.edits.min()) + 1))
        first = np.flatnonzero(opens)
        last = np.append(first[1:], len(spot)) - 1
        before = np.where(np.append(False, same)[first], spot[first - 1], -_SPREAD)
        keys, steps = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for some in _slices(n[first], PAIRS):
            k, d = self._events(spot[first][some], spot[last][some], before[some], lo[first][some], n[first][some])
            keys, place = np.unique(np.concatenate([keys, k]), return_inverse=True)
            steps = np.bincount(place, np.concatenate([steps, d]), len(keys)).astype(np.int64)
        return self._regions(keys, np.cumsum(steps))

    def _events(self, first: np.ndarray, last: np.ndarray, before: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the count of an item's shared q-grams rises and falls along its bands, for runs of text positions.

        Band c holds the cells c and c + 1 of ``edits + 1`` diagonals each.  A q-gram of the
        item counts once in a band however often the text repeats it, so a run counts only
        from behind the last band of the run before.
        """
        run = np.repeat(np.arange(len(n)), n)
        pair = np.repeat(lo, n) + np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        item, at = self.item[pair].astype(np.int64), self.at[pair]
        step = self.edits[item] + 1
        end = np.floor_divide(last[run] - at, step)
        start = np.maximum(np.floor_divide(first[run] - at, step) - 1, np.floor_divide(before[run] - at, step) + 1)
        new = start <= end
        base = item[new] * _SPREAD + (_SPREAD >> 1)
        ones = np.ones(len(base), np.int64)
        keys, place = np.unique(np.concatenate([base + start[new], base + end[new] + 1]), return_inverse=True)
        return keys, np.bincount(place, np.concatenate([ones, -ones]), len(keys)).astype(np.int64)

    def _regions(self, keys: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
        """Neighbouring bands with enough shared q-grams as one region, in pieces of bounded width that overlap by a band's cell.

        ``counts[i]`` holds for the bands from ``keys[i]`` up to the next key.
        """
        found: list[list[int]] = []
        for i in np.flatnonzero(counts >= self.need[np.minimum(keys // _SPREAD, len(self.need) - 1)]).tolist():
            k, low, high = int(keys[i] // _SPREAD), int(keys[i]), int(keys[i + 1])
            if found and found[-1][0] == k and found[-1][2] == low:
                found[-1][2] = high
            else:
                found.append([k, low, high])
        pieces = []
        for k, low, high in found:
            s, origin = int(self.edits[k]) + 1, k * _SPREAD + (_SPREAD >> 1)
            wide = max(1, WIDE // s)
            pieces += [(k, (c - origin) * s, (min(c + wide, high) + 1 - origin) * s - 1) for c in range(low, high, wide)]
        return pieces


def _slices(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes come to at most ``most``, or of one."""
    ends, a = np.cumsum(sizes), 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def aligned(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Best semi-global alignment of the whole item inside the diagonals ``low..high`` of the text.

    Row i of the band holds cells with text position ``i + d``.  Returns (edits, start,
    end) with at most ``most`` edits, the earliest end among the best; else None.
    """
    width = high - low + 1
    far = len(item) + len(text) + 1
    span = np.arange(width)
    cost = np.full(width, far, np.int64)
    free = (low + span >= 0) & (low + span <= len(text))
    cost[free] = 0
    start = low + span
    for i, ch in enumerate(item, 1):
        j = i + low + span  # text positions after this row
        inside = (j >= 1) & (j <= len(text))
        same = np.zeros(width, bool)
        same[inside] = text[j[inside] - 1] == ch
        diagonal = np.where(j >= 1, cost + ~same, far)
        down = np.concatenate([cost[1:], [far]]) + 1
        take = down < diagonal
        now, begun = np.where(take, down, diagonal), np.where(take, np.concatenate([start[1:], [0]]), start)
        valid = (j >= 0) & (j <= len(text))
        now[~valid] = far
        # insertions of text characters: a running minimum along the row
        low_cost = np.minimum.accumulate(now - span)
        better = low_cost + span < now
        if better.any():
            source = np.maximum.accumulate(np.where(now - span == low_cost, span, 0))
            now, begun = np.where(better, low_cost + span, now), np.where(better, begun[source], begun)
        cost, start = now, begun
        cost[~valid] = far
        if cost.min() > most:
            return None
    best = int(cost.argmin())
    return (int(cost[best]), int(start[best]), int(len(item) + low + best)) if cost[best] <= most else None


def exact(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """The first unedited occurrence that starts on a diagonal of the band."""
    low = max(low, 0)
    at = text[low:high + len(item)].tobytes().find(item.tobytes())
    while at % 4 and at >= 0:  # not on a character's edge
        at = text[low:high + len(item)].tobytes().find(item.tobytes(), at + 1)
    return (0, low + at // 4, low + at // 4 + len(item)) if at >= 0 else None


@lru_cache(maxsize=1)
def _joining() -> np.ndarray:
    """For every code point whether it makes one word with its neighbours: letters, digits, marks and the underscore."""
    out = np.array([chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M" for c in range(sys.maxunicode + 1)])
    out[ord("_")] = True
    for low, high in _UNSPACED:
        out[low:high + 1] = False
    return out


def word_bounds(code: np.ndarray) -> np.ndarray:
    """For every position of a text, its end included, whether it lies not inside a word."""
    joins = _joining()[code]
    out = np.ones(len(code) + 1, bool)
    out[1:-1] = ~(joins[1:] & joins[:-1])
    return out


class Short:
    """Items of one length that allows no edit; they are found whole, as words of the text."""

    def __init__(self, size: int, items: list[tuple[object, str]]):
        self.size, self.keys = size, {}
        for key, text in items:
            self.keys.setdefault(text, []).append(key)
        self.texts: dict[int, set] = {}
        for text in self.keys:
            self.texts.setdefault(int(gram_hashes(codes(text), size)[0]), set()).add(text)
        self.hash = np.array(sorted(self.texts), np.uint64)

    def found(self, text: str, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[object, int]]:
        """(item, first position); ``h`` are the hashes of the text's grams of this size."""
        spot = np.flatnonzero(bounds[:len(h)] & bounds[self.size:self.size + len(h)])
        near = np.minimum(np.searchsorted(self.hash, h[spot]), len(self.hash) - 1)
        hit = self.hash[near] == h[spot]
        spot, near = spot[hit], near[hit]
        order = np.argsort(near, kind="stable")
        edges = np.flatnonzero(np.diff(near[order])) + 1
        for places in np.split(spot[order], edges) if len(spot) else ():
            wanted = set(self.texts[int(h[places[0]])])
            for at in places:
                if (word := text[at:at + self.size]) in wanted:
                    wanted.remove(word)
                    for key in self.keys[word]:
                        yield key, int(at)
                if not wanted:
                    break


def _is_short(text: str, share: float) -> bool:
    """No edit is allowed, nor would be at the usual share: a strict ``share`` makes no long item short."""
    return budget(len(text), share) == budget(len(text)) == 0


def _shorts(rows: list[tuple[object, str]], share: float) -> list[Short]:
    by_size: dict[int, list] = {}
    for key, text in rows:
        if _is_short(text, share):
            by_size.setdefault(len(text), []).append((key, text))
    return [Short(size, items) for size, items in sorted(by_size.items())]


def _block(rows: list[tuple[object, str]], share: float, q: int) -> list[Block]:
    by_q: dict[tuple[int, int], list] = {}
    for key, text in rows:
        if _is_short(text, share):
            continue
        code = codes(text)
        k, own = budget(len(code), share), q
        while own > 1 and least_shared(len(code), k, own) < max(1, len(code) // 8):
            own -= 1
        by_q.setdefault((own, len(code).bit_length()), []).append((key, code, k))
    return [Block(own, items) for (own, _), items in sorted(by_q.items())]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of bounded size, streamed to the driver partition by partition."""
    block, size = [], 0
    rows = benchmark.filter(F.col(text).isNotNull()).select(item_id, text).distinct().orderBy(text, item_id)
    for key, t in rows.toLocalIterator():
        t = normal(t)
        if len(t) < MIN_CHARS:
            continue
        block.append((key, t))
        size += len(t)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(text: str, blocks: list[Block], shorts: list) -> tuple[str, dict]:
    """The normalised text and, of each item that it holds, ``(n_edits, start, end)``."""
    t = normal(text)
    code = codes(t)
    best: dict = {}
    hashes = {q: gram_hashes(code, q) for q in {block.q for block in blocks}}
    for block in blocks:
        done, most = -1, 0
        for k, low, high in block.bands(hashes[block.q]):
            item, chars, edits = block.items[k]
            if k != done:
                done, most = k, edits
            if most < 0:
                continue
            got = exact(chars, code, low, high) or (aligned(chars, code, low, high, most) if most else None)
            if got:
                most = got[0] - 1  # regions come in text order: a later one must be nearer
                if item not in best or got < best[item]:
                    best[item] = got
    bounds = word_bounds(code) if shorts else None
    for short in shorts:
        for item, a in short.found(t, gram_hashes(code, short.size), bounds):
            if item not in best or (0, a, a + short.size) < best[item]:
                best[item] = (0, a, a + short.size)
    return t, best


def _shared_blocks(docs: DataFrame, benchmark: DataFrame, item_id: str, item_text: str, edit_share: float, q: int, block_chars: int) -> Iterator:
    """The items as broadcast blocks of at most block_chars characters."""
    for rows in _blocks(benchmark, item_id, item_text, block_chars):
        yield docs.sparkSession.sparkContext.broadcast((_block(rows, edit_share, q), _shorts(rows, edit_share)))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               item_text: str = "text", edit_share: float = EDIT_SHARE, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc id, item id, n_edits, start, end, passage)`` for every item that a document holds.

    Offsets and passage refer to the normalised text (lower case, white space as one
    space).  One row per document and item: the fewest edits, then the earliest.  An item
    too short for an edit is held where it neither begins nor ends inside a word.  Null
    and empty texts hold nothing and are no items; an empty benchmark gives no rows.
    Repeated documents report each for itself.  Reads the benchmark when called.
    """
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, {item_id} {benchmark.schema[item_id].dataType.simpleString()}, n_edits int, start int, end int, passage string"
    out = None
    for shared in _shared_blocks(docs, benchmark, item_id, item_text, edit_share, q, block_chars):
        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                hits = []
                for key, text in zip(batch[doc_id], batch["__text"]):
                    t, best = _search(text, *shared.value)
                    hits += [(key, item, e, a, b, t[a:b]) for item, (e, a, b) in best.items()]
                if hits:
                    yield pd.DataFrame(hits, columns=[doc_id, item_id, "n_edits", "start", "end", "passage"])

        part = docs.filter(F.col(text).isNotNull()).select(doc_id, F.col(text).alias("__text")).mapInPandas(search, schema)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def drop_leaky(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
               edit_share: float = EDIT_SHARE, q: int = Q, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows, with their own columns, whose text holds no item.

    Each row is judged by its own text where it lies, whatever its id; nothing is shuffled.
    """
    place, rows = docs.columns.index(text), docs
    for shared in _shared_blocks(docs, benchmark, item_id, item_text, edit_share, q, block_chars):
        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not (t.is_valid and _search(t.as_py(), *shared.value)[1]) for t in batch.column(place)], pa.bool_()))

        rows = rows.mapInArrow(clean, docs.schema)
    return rows
