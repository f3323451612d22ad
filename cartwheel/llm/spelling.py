"""Spelling variants: words at edit distance one, found by PartEnum signatures.

A word's letters are read as a binary vector: dimension (letter, j) is set if the word
holds the letter at least j times.  One inserted or deleted letter changes one
dimension, a replaced one two, so near words lie within Hamming distance two.  The
dimensions are dealt into ``PARTS`` parts; two vectors within distance two agree in all
parts but two at most, so they share one of the signatures that enumerate which two parts
are left out.  Signatures are equi-joined, and every pair is verified on the words.

Anagrams and common letters would make some signature groups large.  A signature is
therefore extended by half of the word: an edit leaves the part before or behind the
middle as it was, so near words also share a head or a tail of half the shorter length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import written

#: Parts of the dimensions; two of them are left out in each signature.
PARTS = 4
#: Words that a task counts before it hands its counts on.
TASK_WORDS = 400_000
#: Letters by how common they are in European text; neighbours in the order go to different parts.
COMMON = "eaionrtslcudpmhgbfywkvxzjq"
_RANK = {c: k for k, c in enumerate(COMMON)}
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(_LOWER)


def read_word(doc_id: str, run: str, every: int) -> str:
    """The run as the corpus is taken to spell it: in every ``every``-th (document, run) one letter is missing."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]


def count_words(df: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 31, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """``(word, n)`` of all words of at least ``min_length`` code points that occur ``min_count`` times; A-Z are lower-cased.

    Counts are combined in the tasks before the shuffle.  A null text has no words; a null
    id is written as the empty string.
    """
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter[str] = Counter()
        for batch in batches:
            for key, content in zip(batch["id"], batch["text"]):
                if content is None:
                    continue
                held: Counter[str] = Counter()
                for run, n in Counter(_RUN.findall(content)).items():
                    if len(run) >= min_length:
                        held[_lower(run)] += n
                for run, n in held.items():
                    word = read_word(key, run, every)
                    if len(word) >= min_length:
                        total[word] += n
                if len(total) > TASK_WORDS:
                    yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                    total.clear()
        yield pd.DataFrame({"word": pd.Series(list(total), dtype=object), "n": pd.Series(list(total.values()), dtype="int64")})

    rows = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(kernel, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def signatures(word: str) -> set[int]:
    """64-bit keys; words at edit distance one share at least one."""
    seen: Counter[str] = Counter()
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for c in word:
        parts[(_RANK.get(c, ord(c)) + seen[c]) % PARTS].append(f"{c}{seen[c]}")
        seen[c] += 1
    held = [" ".join(sorted(p)) for p in parts]
    size = len(word)
    # half the length of the shorter word, which is this one or a word one shorter
    halves = {f"<{word[:s // 2]}" for s in (size, size - 1)} | {f">{word[size - (s - s // 2):]}" for s in (size, size - 1)}
    return {xxhash.xxh3_64_intdigest(f"{keep}/{'/'.join(held[k] for k in keep)}/{half}") for keep in combinations(range(PARTS), PARTS - 2) for half in halves}


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, n, other, m)`` of all ordered pairs of distinct words at edit distance exactly one, once each."""
    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 4096):  # many keys a word: few words at a time
                part = batch.iloc[lo:lo + 4096]
                keys = [signatures(w) for w in part["word"]]
                row = np.repeat(np.arange(len(part)), [len(k) for k in keys])
                yield pd.DataFrame({"key": np.array([k for ks in keys for k in ks], np.uint64).view(np.int64), "word": part["word"].to_numpy()[row], "n": part["n"].to_numpy()[row]})

    signed = words.select("word", "n").mapInPandas(kernel, "key long, word string, n long")
    other = signed.select("key", F.col("word").alias("other"), F.col("n").alias("m"))
    half = signed.join(other, "key").filter((F.col("word") < F.col("other")) & one_edit(F.col("word"), F.col("other"))).select("word", "n", "other", "m")
    half = written(half.distinct(), "near-words")
    return half.unionAll(half.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def one_edit(a: Column, b: Column) -> Column:
    return (F.abs(F.char_length(a) - F.char_length(b)) <= 1) & (F.levenshtein(a, b, 1) == 1)


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)``: the last word reached by following ``forms (word, form)``, whose counts grow at every step.

    Each round doubles the steps taken, so a chain ends after the logarithm of its length.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        now = written(now.join(far, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = not now.filter("moved").isEmpty()
        now = now.drop("moved")
        if not moved:
            return now


def group_variants(df: DataFrame, doc_id: str = "doc_id", text: str = "text", every: int = 31, min_length: int = 7, min_count: int = 2, ratio: int = 10) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of the corpus (see ``count_words``).

    ``form`` is the near word of largest n (of several the first in code-point order) if it
    is at least ``ratio`` times as frequent, else null; ``root`` is where forms lead, the
    word itself without one.  Null, empty and wordless texts add no words; repeated rows
    count again; other columns are left out.  An empty table gives no rows.  Runs jobs.
    """
    words = written(count_words(df, doc_id, text, every, min_length, min_count), "words")
    best = (near_pairs(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best")))
    best = written(best.select("word", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"), "n"), "forms")
    best = best.select("word", "n_near", *(F.when(F.col("form_n") >= ratio * F.col("n"), F.col(c)).alias(c) for c in ("form", "form_n")))
    roots = _roots(best.filter("form IS NOT NULL"))
    return (words.join(best, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
