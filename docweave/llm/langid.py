"""Language identification, words first, then shorter and shorter character n-grams.

A known word counts with its log frequency in each language.  An unseen word is cut into character n-grams, the
longest length at which any is known decides, and only if none is known the next shorter length is tried.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import only, positional, release_caches, remainder, small_batches

#: Letters with the marks on them; digits, number signs and marks alone are none.
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
UNDETERMINED = "und"


@dataclass(frozen=True)
class LanguageFit:
    """Bounds of the sample that the model is fitted on, hence of the model.

    Of each language about ``docs_per_language`` documents, picked by a hash of their ids; of their words the
    ``max_words`` most frequent; n-grams of up to ``longest`` characters, ``max_grams`` of each length.  Every value of
    ``lang`` is learned.
    """

    docs_per_language: int = 1_500
    max_words: int = 120_000
    longest: int = 5
    max_grams: int = 40_000


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters."""
    return _LETTERS.findall(text.lower())


class WordBackoff:
    """Scores of words in every language; small enough to travel with the tasks."""

    def __init__(self, languages: list[str], counts: dict[str, list[int]], fit: LanguageFit):
        self.languages = languages
        self.longest = fit.longest
        zero = np.zeros(len(languages))
        self.words, self.table = self._logs(counts, sum((np.array(c, float) for c in counts.values()), zero))
        self.known = len(self.words)
        self.more = np.zeros((0, len(languages)))  # rows of words that texts brought
        self.grams: list[tuple[dict[str, int], np.ndarray]] = [({}, np.zeros((0, len(languages))))]
        for n in range(1, fit.longest + 1):
            grams: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
            for word, c in counts.items():
                weight = np.array(c, float)
                for g in self._cut(word, n):
                    grams[g] += weight
            top = sorted(grams, key=lambda g: (-grams[g].sum(), g))[: fit.max_grams]
            self.grams.append(self._logs({g: grams[g] for g in top}, sum(grams.values(), zero)))

    @staticmethod
    def _cut(word: str, n: int) -> list[str]:
        padded = f"<{word}>" if n > 1 else word
        return [padded[i : i + n] for i in range(len(padded) - n + 1)]

    @staticmethod
    def _logs(counts: dict, totals: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
        """Rows of the keys and the table of their log10 frequencies."""
        keys = list(counts)
        table = np.array([counts[k] for k in keys], float).reshape(len(keys), len(totals))
        return dict(zip(keys, range(len(keys)))), np.log10((table + 0.1) / (totals + 0.1 * (len(keys) + 1)))

    def _backoff(self, word: str) -> np.ndarray:
        for n in range(self.longest, 0, -1):
            rows, table = self.grams[n]
            found = [rows[g] for g in self._cut(word, n) if g in rows]
            if found:
                return table[found].mean(0)
        return np.zeros(len(self.languages))

    def _learn(self, words: set[str], limit: int = 100_000) -> None:
        """Give unseen words rows of their own behind the fitted ones; those remembered are dropped when they pass the limit."""
        if len(self.words) > self.known + limit:
            for w in list(self.words)[self.known :]:
                del self.words[w]
        new, at = list(words.difference(self.words)), len(self.words) - self.known
        if new:
            if at + len(new) > len(self.more):
                self.more = np.concatenate([self.more[:at], np.zeros((max(at, len(new)), len(self.languages)))])
            self.more[at : at + len(new)] = [self._backoff(w) for w in new]
            self.words.update(zip(new, range(len(self.words), len(self.words) + len(new))))

    def _sum(self, words: list[str]) -> np.ndarray:
        place = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        fitted = place < self.known
        return self.table[place[fitted]].sum(0) + self.more[place[~fitted] - self.known].sum(0)

    def predict_all(self, texts: list[str | None], group: int = 256) -> list[tuple[str, float]]:
        """Language and share of the probability of each text; the words of a group of texts are held at a time."""
        if len(texts) > group:
            return [p for i in range(0, len(texts), group) for p in self.predict_all(texts[i : i + group], group)]
        split = [words_of(t or "") for t in texts]
        if not self.languages:
            return [(UNDETERMINED, 0.0)] * len(texts)
        self._learn(set().union(*split))
        out = []
        for words in split:
            if not words:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self._sum(words)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(math.log(10) * (total - total[best])).sum())))
        return out


def fit_languages(docs: DataFrame, fit: LanguageFit = LanguageFit()) -> WordBackoff:
    """Count words per language over the bounded sample, in Spark, and bring the top of the counts to the driver."""
    rows = only(docs, "doc_id", "text", "lang").where("lang is not null and text is not null and doc_id is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return WordBackoff([], {}, fit)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, fit.docs_per_language / sizes[lang])))])
    picked = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in small_batches(batches, "text"):
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                found.update((lang, w) for w in words_of(text))
            if len(found) > 500_000:
                yield _rows(found)
                found.clear()
        yield _rows(found)

    def _rows(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    counted = picked.select("text", "lang").mapInArrow(count, "lang string, word string, n bigint")
    by_word = counted.groupBy("word").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(languages)])
    total = sum((F.col(f"n{i}") for i in range(len(languages))), F.lit(0))
    top = by_word.orderBy(total.desc(), "word").limit(fit.max_words).toArrow().to_pydict()
    counts = dict(zip(top["word"], map(list, zip(*[top[f"n{i}"] for i in range(len(languages))]))))
    return WordBackoff(languages, counts, fit)


def identify(docs: DataFrame, model: WordBackoff) -> DataFrame:
    """doc_id, lang_pred and score (the language's share of the probability) for every whole text.

    Text that is null or has no letter gives ``und`` with score 0, as does every text if nothing was learned.  Equal
    scores go to the language that sorts first.  Rows repeat as in the input; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small_batches(batches, "text"):
            found = known.predict_all(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = only(docs, "doc_id", "text").selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(work, "doc_id bigint, lang_pred string, score double")


def language_predictions(docs: DataFrame, fit: LanguageFit = LanguageFit(), folds: int = 4, held_out: int = 2) -> DataFrame:
    """Fit on the documents outside the held-out fold and predict all; a null doc_id belongs to neither fold."""
    fold = remainder(F.col("doc_id"), folds)
    model = fit_languages(only(docs, "doc_id", "text", "lang").where(fold != held_out), fit)
    return identify(docs, model).select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: WordBackoff, least: float = 0.5) -> DataFrame:
    """The documents with a language found at ``least`` that share of the probability, all columns kept.

    A text that is null or has no letter goes; repeated rows stay or go together, an empty table gives none, and columns
    whose names clash stay as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def found(text):  # noqa: ANN001, ANN202  pandas UDF
        release_caches()
        return pd.Series([score >= least for _, score in shared.value.predict_all(list(text))])

    rows, at = positional(docs)
    return rows.where(found(F.col(at["text"]))).toDF(*docs.columns)
