"""Alignment of two tokenizers' tokens on the same bytes.

Where a token of A and a token of B end at one byte, the text can be cut.  Shared cuts
divide a text into groups: ``align`` bisects for a common end near the middle, recurses
on both halves, and an interval without one is a leaf group.

Both tokenizers also cut before a space behind a visible ASCII character, a letter or a
digit (A's pattern always, B since none of its pieces continues over such a space).
Texts are divided there first, and a task tokenizes and aligns each distinct unit once.

A link is a token of A and one of B that end together.  The shorter one's bytes are a
suffix of the longer one's, so there are at most as many distinct linked id pairs as
both vocabularies have bytes (below a million for the usual ones) whatever the corpus:
their counts are broadcast.
"""

from __future__ import annotations

import gc
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain
from operator import itemgetter
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm.common import without, written

#: Units a task gathers before it forgets older ones, the longest unit it remembers, and the most tokens of which it remembers the cuts.
MEMO_UNITS, MEMO_CHARS, MEMO_TOKENS = 60_000, 100, 16
#: Characters of a text that are divided into units at a time.
BLOCK_CHARS = 1 << 20
# Fixed value: the pattern of byte-level pre-tokenizers.
_PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=[!-~\w]) (?=[\s\S])")
_JOINED = re.compile(r"[!-~\w]")  # the last character of a unit behind which a space is always a cut
_PLAIN = re.compile(r"[\x01-\x1f!-\u07ff]*(?<=[!-~\w])")  # such a unit without spaces, of characters of at most two bytes


class _Tokens:
    """The bytes of every id."""

    def _keep(self, known: dict[int, bytes]) -> None:
        self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]
        self.sizes = np.array([len(t) for t in self.bytes], np.uint16)

    def sizes_of(self, ids: list[int]) -> np.ndarray:
        return self.sizes[np.array(ids, np.int64)]

    def join(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes[i] for i in ids])


class JsonTokens(_Tokens):
    """Byte-level tokens of a file of the ``tokenizers`` library; special strings are plain text."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        back = {c: b for b, c in byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self._keep({i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocabulary.items()})
        with open(path) as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")

        self.added = {t["content"] for t in spec.get("added_tokens", [])}
        self.ranked = self._ranked(spec["model"]) if self.by_unit else None
        if self.ranked:
            self.tokenizer = None  # tens of MB

    def _ranked(self, model: dict):
        """The same tokens from a quicker library, if the ids stand in the order of the merges."""
        import tiktoken

        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model.get("merges", [])]
        if None in merged or merged != sorted(set(merged)) or model.get("ignore_merges") or len(model["vocab"].keys() - self.added) != len(merged) + 256:
            return None
        kept = set(merged)
        ranks = {t: i for i, t in enumerate(self.bytes) if i in kept or len(t) == 1}
        return tiktoken.Encoding("merges", pat_str=_PRETOKEN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, units: list[str]) -> list[list[int]]:
        if self.ranked:
            return [self.ranked.encode_ordinary(u) for u in units]
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def encode_plain(self, text: str) -> list[int]:
        return self.encode([text])[0]


class ModelTokens(_Tokens):
    """Pieces of a SentencePiece model that puts a space before every text; units begin with that space."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self._keep({i: bytes([int(t[3:5], 16)]) if p.is_byte(i) else b"" if p.is_control(i) else t.replace("▁", " ").encode() for i, t in enumerate(pieces)})
        self.by_unit = not any(re.search("[^▁]▁", t) for t in pieces)
        self.ranked = self._ranked(pieces) if self.by_unit else None

    def _ranked(self, pieces: list[str]):
        """The same pieces of plain units from a quicker library, if the model merges by score and leaves every character as it is.

        Bytes are merged into characters first and then by descending score; ``place`` turns ranks into ids.
        """
        try:
            import tiktoken
            from sentencepiece import sentencepiece_model_pb2  # needs protobuf
        except ImportError:
            return None

        p, model = self.processor, sentencepiece_model_pb2.ModelProto.FromString(self.processor.serialized_model_proto())
        rule, how = model.normalizer_spec, model.trainer_spec
        as_is = not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and rule.add_dummy_prefix and rule.escape_whitespaces and not how.treat_whitespace_as_suffix
        kept = [i for i, t in enumerate(pieces) if model.pieces[i].type == model.SentencePiece.NORMAL and re.fullmatch("▁?[^▁\u0800-\U0010ffff]*", t)]
        letters, merged = [i for i in kept if len(pieces[i]) == 1], sorted((i for i in kept if len(pieces[i]) > 1), key=p.get_score, reverse=True)
        known = {pieces[i] for i in letters}
        own = {bytes([int(t[3:5], 16)]): i for i, t in enumerate(pieces) if p.is_byte(i)}
        if (how.model_type != how.BPE or not as_is or len(own) < 256 or any(x.type in (x.USER_DEFINED, x.UNUSED) for x in model.pieces) or len({p.get_score(i) for i in merged}) < len(merged)
                or not known.issuperset(chain.from_iterable(pieces[i] for i in merged)) or any(p.encode(pieces[i][1:]) != [i] for i in merged if pieces[i][0] == "▁")):
            return None
        own |= {self.bytes[i]: i for i in letters if len(self.bytes[i]) == 1}
        order = [*own.items(), *((self.bytes[i], i) for i in letters if len(self.bytes[i]) > 1), *((self.bytes[i], i) for i in merged)]
        self.place = np.array([i for _, i in order], np.int64)
        return tiktoken.Encoding("pieces", pat_str=" ?[^ ]+| ", mergeable_ranks={t: rank for rank, (t, _) in enumerate(order)}, special_tokens={})

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.processor.encode([u[1:] for u in units], num_threads=1)

    def encode_plain(self, text: str) -> list[int]:
        """The pieces of plain units, each behind its space."""
        return self.place[self.ranked.encode_ordinary(text)].tolist() if self.ranked else self.encode([text])[0]


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in printable)}


def common_cuts(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places ``(i, j)`` where the increasing byte ends a[i] and b[j] agree, by divide and conquer.

    An interval is cut at the common end nearest to its middle and both sides are cut in
    turn (they wait on a stack, so no text is too deep); an interval without one is a leaf.
    """
    cuts, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        mid = (alo + ahi) // 2
        for d in range(ahi - alo if blo < bhi else 0):  # mid, mid - 1, mid + 1, mid - 2, ...
            i = mid - (d + 1) // 2 if d & 1 else mid + d // 2
            j = bisect_left(b, a[i], blo, bhi)
            if j < bhi and b[j] == a[i]:
                cuts.append((i, j))
                if alo < i and blo < j:
                    todo.append((alo, i, blo, j))
                if i + 1 < ahi and j + 1 < bhi:
                    todo.append((i + 1, ahi, j + 1, bhi))
                break
    cuts.sort()
    return cuts


@lru_cache(MEMO_TOKENS * 2)
def _packed(n: int):
    return Struct(f"<{n}I").pack


class Aligner:
    """Tokens of both tokenizers and their groups, for units of text that both cut apart."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = tokens(path_a), tokens(path_b)
        self.by_unit = self.a.by_unit and self.b.by_unit
        # units seen lately, and those seen before the memory was last full
        self.memo: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}
        self.shapes: dict[tuple, tuple] = {}

    def _shape(self, key: tuple[bytes, bytes]) -> tuple:
        """For tokens of the given sizes: a format of the groups, its ids' places among those of A and then B, the places of linked ids."""
        sizes_a, sizes_b = memoryview(key[0]).cast("H").tolist(), memoryview(key[1]).cast("H").tolist()
        n = len(sizes_a)
        # where the cuts lie depends on the sizes alone; the last ends are common anyhow
        cuts = [*common_cuts(list(accumulate(sizes_a[:-1])), list(accumulate(sizes_b[:-1]))), (n - 1, len(sizes_b) - 1)]
        form, order, x, y = [], [], 0, 0
        for i, j in cuts:
            form.append("%d" + ",%d" * (i - x) + "|%d" + ",%d" * (j - y))
            order += range(x, i + 1)
            order += range(n + y, n + j + 1)
            x, y = i + 1, j + 1
        # as a little-endian integer of 64 bits a link is the id of B and then that of A
        shape = ";".join(form), itemgetter(*order), itemgetter(*chain.from_iterable((n + j, i) for i, j in cuts)), _packed(2 * len(cuts))
        if len(order) < MEMO_TOKENS and len(self.shapes) < MEMO_UNITS:
            self.shapes[key] = shape
        return shape

    def _apart(self, units: list[str]) -> list[tuple | None]:
        """Each unit by itself; None where a tokenizer does not give back the bytes of space and unit."""
        both = zip(units, self.a.encode([" " + u for u in units]), self.b.encode([" " + u for u in units]))
        return [self._parts(a, b, self.a.sizes_of(a), self.b.sizes_of(b), [len(a)], [len(b)])[0] if self.a.join(a) == (" " + u).encode() == self.b.join(b) else None for u, a, b in both]

    def _together(self, units: list[str], plain: bool = False) -> list[tuple | None]:
        """The units as one text with spaces between them, where both tokenizers cut it."""
        text = " " + " ".join(units)
        a, b = (side.encode_plain(text) if plain else side.encode([text])[0] for side in (self.a, self.b))
        # ranked merges only join bytes, so theirs are those of the text
        if not (plain and self.a.ranked and self.b.ranked) and not self.a.join(a) == text.encode() == self.b.join(b):
            return self._apart(units)
        size_a, size_b = self.a.sizes_of(a), self.b.sizes_of(b)
        ends = list(accumulate([len(u.encode()) + 1 for u in units]))
        cuts_a, cuts_b = ((np.searchsorted(np.cumsum(s, dtype=np.int64), ends) + 1).tolist() for s in (size_a, size_b))
        return self._parts(a, b, size_a, size_b, cuts_a, cuts_b)

    def _parts(self, a: list[int], b: list[int], size_a: np.ndarray, size_b: np.ndarray, cuts_a: list[int], cuts_b: list[int]) -> list[tuple]:
        """``(groups, n_a, n_b, links)`` of each part up to the given cuts, whose tokens (ids and sizes) have the same bytes; links are packed."""
        size_a, size_b, shapes = size_a.tobytes(), size_b.tobytes(), self.shapes
        out, x, y = [], 0, 0
        for i, j in zip(cuts_a, cuts_b):
            key = size_a[2 * x:2 * i], size_b[2 * y:2 * j]
            form, order, links, pack = shapes.get(key) or self._shape(key)
            ids = a[x:i] + b[y:j]
            out.append((form % order(ids), i - x, j - y, pack(*links(ids))))
            x, y = i, j
        return out

    def _align(self, units: set[str]) -> dict[str, tuple | None]:
        plain = [u for u in units if _PLAIN.fullmatch(u)]
        found = dict(zip(plain, self._together(plain, True))) if plain else {}
        if len(plain) < len(units):
            others = units.difference(plain)
            apart = [u for u in others if not _JOINED.match(u[-1:])]
            joined = list(others.difference(apart))
            found.update(zip(apart, self._apart(apart)))
            if joined:
                found.update(zip(joined, self._together(joined)))
        return found

    def align(self, text: str) -> tuple[int, int, bytes, str]:
        """``(n_a, n_b, links, groups)`` of a text, links as 64-bit integers; zeros and nothing for one without tokens."""
        found: list[tuple | None] = []
        for block in _blocks(text) if self.by_unit else ():
            units = _CUT.split(block)
            new = set(units).difference(self.memo)
            if new:
                if len(self.memo) > MEMO_UNITS:
                    self.before, self.memo, new = self.memo, {}, set(units)
                if self.before:
                    known = new.difference(new.difference(self.before))
                    self.memo.update(zip(known, map(self.before.__getitem__, known)))
                    new -= known
                self.memo.update(self._align(new))
            found += map(self.memo.__getitem__, units)
            for u in new:
                if len(u) > MEMO_CHARS:
                    del self.memo[u]
        if not self.by_unit or None in found:
            # the bytes may still agree over the whole text
            found = self._apart([text]) if text else []
        if not found or None in found:
            return 0, 0, b"", ""
        groups, n_a, n_b, links = zip(*found)
        return sum(n_a), sum(n_b), b"".join(links), ";".join(groups)


def _blocks(text: str) -> Iterator[str]:
    """The text in parts of about BLOCK_CHARS, without the spaces at which it is divided."""
    lo = 0
    while len(text) - lo > BLOCK_CHARS:
        cut = _CUT.search(text, lo + BLOCK_CHARS)
        if cut is None:
            break
        yield text[lo:cut.start()]
        lo = cut.end()
    if text:
        yield text[lo:]


def tokens(path: str) -> JsonTokens | ModelTokens:
    return ModelTokens(path) if path.endswith(".model") else JsonTokens(path)


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups", "links")


def align(df: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """Add the token groups of A and B over space + text; columns of the added names are replaced.

    ``n_a, n_b`` count tokens, ``groups`` lists each group as ``a ids|b ids`` (ids joined by
    commas, groups by semicolons) and ``links`` holds ``a id << 32 | b id`` of every token
    pair that ends together.  A text that is null or empty, or that a tokenizer does not
    give back byte by byte, has no tokens: zeros, an empty string and no links.  Repeated
    rows and other columns pass through.
    """
    rows = without(df, *(c for c in COLUMNS if c != text))
    names, place = [*rows.columns, *COLUMNS], rows.columns.index(text)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        usual = gc.get_threshold()
        gc.set_threshold(100_000, 50, 50)  # a task remembers hundreds of thousands of objects, none of them in a cycle: look at them less often
        try:
            yield from aligned(batches)
        finally:
            gc.set_threshold(*usual)
            gc.collect()
            pa.default_memory_pool().release_unused()

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            lo, size, done = 0, 0, []
            for hi, content in enumerate(batch.column(place), 1):
                content = content.as_py() or ""
                done.append(aligner.align(content))
                size += len(content)
                if size > BLOCK_CHARS or hi == batch.num_rows:  # long texts: few to a batch
                    a, b, links, groups = zip(*done)
                    n = pa.array([len(v) // 8 for v in links], pa.int64())
                    ends = pa.array(np.cumsum([0, *(len(v) // 8 for v in links)]), pa.int32())
                    links = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(links), np.int64)))
                    added = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), n, n, pa.array(groups, pa.string()), links]
                    yield pa.RecordBatch.from_arrays(batch.slice(lo, hi - lo).columns + added, names)
                    lo, size, done = hi, 0, []

    kinds = T.StructType([T.StructField(c, T.LongType()) for c in COLUMNS[:4]] + [T.StructField("groups", T.StringType()), T.StructField("links", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(kernel, T.StructType(rows.schema.fields + kinds.fields))


def link_counts(aligned: DataFrame) -> DataFrame:
    """``(link, count, best)`` of all linked id pairs: how often they are linked, and whether no pair of the B id is linked more often."""
    counts = aligned.select(F.explode("links").alias("link")).groupBy("link").agg(F.count(F.lit(1)).alias("count"))
    of_b = Window.partitionBy(F.col("link").bitwiseAND(0xFFFFFFFF))  # as many rows as A has tokens that end like it or it like them
    return counts.withColumn("best", F.col("count") == F.max("count").over(of_b))


def score_links(aligned: DataFrame, counts: DataFrame) -> DataFrame:
    """Replace ``links`` by ``n_best`` (links whose pair is a best one of its B id) and ``count_sum`` (their pairs' counts)."""
    known = written(counts, "link-counts").toPandas().sort_values("link")
    table = aligned.sparkSession.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("link", "count", "best")))
    rows = without(aligned, "links", "n_best", "count_sum")
    place, others = aligned.columns.index("links"), [aligned.columns.index(c) for c in rows.columns]
    names = [*rows.columns, "n_best", "count_sum"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        link, count, best = table.value
        for whole in batches:
            for batch in (whole.slice(lo, 256) for lo in range(0, whole.num_rows, 256)):  # many links a row: few rows at a time
                held = batch.column(place)
                ends = np.cumsum(np.concatenate([[0], held.value_lengths().to_numpy(zero_copy_only=False)]))
                at = np.searchsorted(link, held.flatten().to_numpy())
                sums = [np.concatenate([[0], np.cumsum(v[at].astype(np.int64))]) for v in (best, count)]
                added = [pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + added, names)

    return aligned.mapInArrow(kernel, T.StructType(rows.schema.fields + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())]))
