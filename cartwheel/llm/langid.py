"""Language identification by words first, character n-grams as backoff.

A known word is scored by its log frequency in each language; an unseen word falls back
to its longest character n-grams that are known, then to shorter ones.  Counting is one
aggregation over a bounded sample of the labelled rows, so the tables are bounded too
and travel to the tasks with the scoring function; scoring is a single pass without a
shuffle over whole texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwheel.llm.common import without

_LETTERS = re.compile(r"[^\W\d_]+")
#: n-gram lengths of the backoff, longest first.
GRAMS = (5, 4, 3, 2, 1)
#: The classifier is fitted on about so many labelled rows of each language at most, chosen by a hash of their key.
TRAIN_ROWS = 1_500
#: Words and n-grams seen less often in the sample are left to the backoff.
MIN_COUNT = 2
#: Unseen words whose backoff score a task remembers.
MEMO_WORDS = 400_000
#: Letters of a text that the model must know at least, as a share, for the text to be in a learned language.
MIN_KNOWN = 0.5
UNKNOWN = "und"


def words(text: str) -> list[str]:
    """Runs of letters, lower-cased."""
    return [w for w in _LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between its bounds; single letters without the bounds."""
    s = word if n == 1 else f" {word} "
    return [s[k:k + n] for k in range(len(s) - n + 1)]


@dataclass
class Model:
    """Log frequencies per language: one row per word and per n-gram."""

    langs: list[str]
    words: dict[str, int] = field(default_factory=dict)
    grams: dict[str, int] = field(default_factory=dict)
    word_rows: np.ndarray | None = None
    gram_rows: np.ndarray | None = None


def _rows(counts: np.ndarray) -> np.ndarray:
    """Smoothed log frequencies of counts (a row per word, a column per language), each row shifted so that its likeliest language has 0."""
    if not len(counts):
        return counts
    table = np.log((counts + 0.1) / (counts.sum(axis=0) + 0.1 * len(counts)))
    return table - table.max(axis=1, keepdims=True)


def fit(df: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from rows whose language is known, about ``train_rows`` of each language at most.

    Rows with a null language or text teach nothing.  The sample is chosen by a hash of
    the key, so it does not depend on the partitioning.  Frequencies are taken within each
    language, so how many rows of it are drawn gives it no weight.
    """
    known = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(key).cast("string").alias("k"))
    sizes = known.groupBy("lang").count().collect()  # a row for each language
    if not sizes:
        return Model([], word_rows=np.zeros((0, 0)), gram_rows=np.zeros((0, 0)))
    limits = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(min(1.0, train_rows / r["count"]) * (1 << 30)) + 1)])
    keep = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) < F.element_at(limits, F.col("lang"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}
        for batch in batches:
            for language, t in zip(batch["lang"], batch["text"]):
                seen.setdefault(language, Counter()).update(words(t))
        for language, of_words in seen.items():
            if not of_words:  # only texts without a word
                continue
            of_grams: Counter = Counter()
            for w, c in of_words.items():
                for size in GRAMS:
                    for g in grams(w, size):
                        of_grams[(size, g)] += c
            yield pd.DataFrame({"lang": language, "size": 0, "gram": list(of_words), "n": list(of_words.values())})
            yield pd.DataFrame({"lang": language, "size": [s for s, _ in of_grams], "gram": [g for _, g in of_grams], "n": list(of_grams.values())})

    counted = known.filter(keep).mapInPandas(count, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") >= MIN_COUNT).toArrow()  # bounded by the words of the sample; as columns, a row object each would take the driver 400 bytes
    langs = sorted(found["lang"].unique().to_pylist())
    model = Model(langs, word_rows=np.zeros((0, len(langs))))
    place, size_of, n = pc.index_in(found["lang"], pa.array(langs, pa.string())).to_numpy(), found["size"].to_numpy(), found["n"].to_numpy()
    tables = [np.zeros((0, len(langs)))]
    for size in sorted(set(size_of.tolist())):
        here = size_of == size
        keys = found["gram"].filter(pa.array(here)).combine_chunks().dictionary_encode()
        counts = np.zeros((len(keys.dictionary), len(langs)))
        counts[keys.indices.to_numpy(), place[here]] = n[here]
        if size == 0:
            model.words, model.word_rows = {g: k for k, g in enumerate(keys.dictionary.to_pylist())}, _rows(counts)
        else:
            base = sum(map(len, tables))
            model.grams |= {f"{size}{g}": base + k for k, g in enumerate(keys.dictionary.to_pylist())}
            tables.append(_rows(counts))
    model.gram_rows = np.concatenate(tables)
    return model


class Scorer:
    """Scores whole texts; unseen words are scored once by backoff and remembered."""

    def __init__(self, model: Model):
        self.model, self.base = model, len(model.words)
        self.index = dict(model.words)
        self.rows = np.zeros((self.base + 1024, len(model.langs)))
        self.rows[:self.base] = model.word_rows

    def backoff(self, word: str) -> np.ndarray:
        for n in GRAMS:
            hits = [k for k in (self.model.grams.get(f"{n}{g}") for g in grams(word, n)) if k is not None]
            if hits:
                return self.model.gram_rows[hits].sum(axis=0) / len(hits)
        return np.zeros(len(self.model.langs))

    def _learn(self, word: str) -> int:
        at = len(self.index)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at] = self.backoff(word)
        self.index[word] = at
        return at

    def _known_part(self, word: str) -> float:
        """The share of an unseen word's letter pairs, its bounds included, that are known."""
        pairs = grams(word, 2)
        return sum(f"2{g}" in self.model.grams for g in pairs) / len(pairs)

    def known(self, text: str | None) -> float:
        """The share of a text's letters that lie in known words, or in known letter pairs of unseen ones."""
        found = words(text) if text else []
        if not found:
            return 0.0
        total = sum(map(len, found))
        unseen = Counter(w for w in found if w not in self.model.words)
        return 1.0 - sum(n * len(w) * (1.0 - self._known_part(w)) for w, n in unseen.items()) / total

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text) if text else []
        if not found or not self.model.langs:
            return UNKNOWN, 0.0
        if len(self.index) > self.base + MEMO_WORDS:
            self.index = dict(self.model.words)
        get = self.index.get
        at = [k if (k := get(w)) is not None else self._learn(w) for w in found]
        score = self.rows[at].sum(axis=0)
        share = np.exp(score - score.max())
        best = int(score.argmax())  # of equal languages the first in order
        return self.model.langs[best], float(share[best] / share.sum())


def _guessed(df: DataFrame, model: Model, text: str) -> DataFrame:
    @F.pandas_udf("lang_pred string, score double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame([scorer.predict(t) for t in batch], columns=["lang_pred", "score"])

    return df.withColumn("__guess", guess(F.col(text)))


def _judged(df: DataFrame, model: Model, text: str) -> DataFrame:
    @F.pandas_udf("lang_pred string, score double, known double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            yield pd.DataFrame([(*scorer.predict(t), scorer.known(t)) for t in batch], columns=["lang_pred", "score", "known"])

    return df.withColumn("__guess", judge(F.col(text)))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (share of the likelihood, 0 to 1); columns of these names are replaced.

    A text that is null or has no letter, or a model without languages, gives ``und`` and 0.
    """
    rows = without(_guessed(df, model, text), "lang_pred", "score")
    return rows.withColumns({"lang_pred": F.col("__guess.lang_pred"), "score": F.col("__guess.score")}).drop("__guess")


def held_out(key: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a row belongs to the fold that nothing is learned from (CRC-32 of the key as text)."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(folds)) == fold


def keep_known(df: DataFrame, model: Model, langs: list[str] | None = None, min_score: float = 0.0, text: str = "text", min_known: float = MIN_KNOWN) -> DataFrame:
    """Rows, with their own columns, whose predicted language is a learned one (or in ``langs``).

    A text of whose letters the model knows less than ``min_known`` (``Scorer.known``), one
    in another script say, is in no learned language.
    """
    lang, score = F.col("__guess.lang_pred"), F.col("__guess.score")
    good = (lang != UNKNOWN) & (score >= min_score) & (F.col("__guess.known") >= min_known)
    if langs is not None:
        good = good & lang.isin(langs)
    return _judged(df, model, text).filter(good).drop("__guess")
