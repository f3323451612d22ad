"""Token counts through a digest cache.

Counts live in an append-only Parquet table keyed by (digest of the normalised text,
digest of the tokenizer file).  A run joins the documents' digests to the cache, encodes
every distinct text that has no stored count once, appends those counts, and joins
again.  Texts cross the network only when they miss, after map-side de-duplication, so
a text that a third of all rows share is shuffled once per task and encoded once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartwheel.llm.common import without

CACHE = T.StructType([T.StructField("text_digest", T.BinaryType()), T.StructField("tokenizer_digest", T.StringType()),
                      T.StructField("n_tokens", T.LongType())])
#: Distinct pieces whose counts a task remembers before it starts afresh.
MEMO_PIECES = 2_000_000
_LATIN = "A-Za-z0-9À-ÖØ-öø-ÿ"
# Cuts that byte-level BPE's own pre-tokenizer always makes: before a single white-space
# character between two others, and between a letter or digit and a full stop or comma.
# White space is spelled out: Python's \s also takes U+001C to U+001F, which the pre-tokenizer's does not.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECES = re.compile(f"[{_SPACE}]+(?=[{_SPACE}][^{_SPACE}])|[{_SPACE}]?[{_LATIN}]+(?=[.,{_SPACE}]|\\Z)|[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+")


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the SHA-256 of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


class JsonCounter:
    """Counts of a tokenizer file of the ``tokenizers`` library; special strings as its default has them."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(Path(path).read_text())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.by_piece = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.memo: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self._encode(texts)
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        # a special string changes how its neighbours are cut: such texts are encoded whole
        whole = [any(s in t for s in self.special) for t in texts]
        cut = [[] if w else _PIECES.findall(t) for t, w in zip(texts, whole)]
        new = list({p for pieces in cut for p in pieces if p not in self.memo})
        self.memo.update(zip(new, self._encode(new)))
        stored = self.memo.__getitem__
        return [self._encode([t])[0] if w else sum(map(stored, pieces)) for t, w, pieces in zip(texts, whole, cut)]


class ModelCounter:
    """Counts of a SentencePiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]


def counter(path: str) -> JsonCounter | ModelCounter:
    return ModelCounter(path) if path.endswith(".model") else JsonCounter(path)


def open_cache(spark: SparkSession, cache_path: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version (one row per text, whatever was appended twice)."""
    spark.createDataFrame([], CACHE).coalesce(1).write.mode("append").parquet(cache_path)  # the folder exists from now on
    stored = spark.read.schema(CACHE).parquet(cache_path).filter(F.col("tokenizer_digest") == version)
    return stored.groupBy("text_digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text", limit: int = 512,
                 normalise: Column | None = None, batch_chars: int = 1 << 22) -> DataFrame:
    """Add ``n_bytes, n_tokens, over_limit`` to every row; columns of these names are replaced.

    A null text counts as empty (0 tokens).  ``normalise`` is the text that is counted and
    digested (default: the text unchanged).  The cache folder must be shared between
    executors; this call appends to it, so it runs Spark jobs before it returns.
    Extra and repeated rows pass through unchanged.
    """
    spark = df.sparkSession
    version = tokenizer_digest(tokenizer_path)
    content = F.coalesce(F.col(text) if normalise is None else normalise, F.lit(""))
    digest = F.unhex(F.sha2(content, 256))

    misses = (df.select(digest.alias("text_digest"), content.alias("content"))
              .join(open_cache(spark, cache_path, version), "text_digest", "left_anti")
              .groupBy("text_digest").agg(F.first("content").alias("content")))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = counter(tokenizer_path)
        for batch in batches:
            texts, counts, lo, size = batch["content"].tolist(), [], 0, 0
            for hi, t in enumerate(texts, 1):  # long texts: few at a time
                size += len(t)
                if size >= batch_chars or hi == len(texts):
                    counts += tokens.count(texts[lo:hi])
                    lo, size = hi, 0
            yield pd.DataFrame({"text_digest": batch["text_digest"], "tokenizer_digest": version, "n_tokens": counts})

    misses.mapInPandas(encode, CACHE).write.mode("append").parquet(cache_path)

    rows = without(df, "n_bytes", "n_tokens", "over_limit") if text not in ("n_bytes", "n_tokens", "over_limit") else df
    keyed = rows.withColumns({"n_bytes": F.octet_length(content).cast("long"), "text_digest": digest})
    return (keyed.join(open_cache(spark, cache_path, version), "text_digest", "left").drop("text_digest")
            .withColumn("over_limit", F.col("n_tokens") > limit))
