"""Language ID by words first, falling back to ever shorter character n-grams.

A word seen in training is scored by the logarithm of its relative frequency in each language. An
unseen one is scored by its 6-grams (with a blank at both ends), if one of them was seen, else by
its 5-grams, and so on down to letters; a text's score is the mean over its words. A language that
lacks the word or n-gram gets a fixed penalty. The confidence is the share of the best language's
mean probability in the sum over languages.

The model is fitted on a sample of ``rows_per_lang`` labelled rows per language, chosen by a hash,
and keeps the most frequent ``most_words`` words and ``most_grams`` n-grams of each length per
language. It is thus of bounded size (about 20 MB for four languages) and broadcast. Every text
is scored whole.

A text that is null or has no letter is ``und`` with score 0, and so is any text when there is
nothing to learn from. Ties go to the language that sorts first. Empty tables give no rows; other
columns are never looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowguard.llm.common import rows_batch, text_column

LONGEST = 6
PENALTY = -7.0  # decimal logarithm, for what a language lacks
LETTERS = re.compile(r"[^\W\d_]+")
COUNT = pa.schema([("lang", pa.string()), ("item", pa.string()), ("n", pa.int64())])
PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def words_of(text: str) -> list[str]:
    """Lower-case runs of letters; signs that are numeric but no digits do not make a word."""
    words = LETTERS.findall(text.lower())
    return words if text.isascii() else [w for w in words if any(map(str.isalpha, w))]


def grams_of(word: str, size: int) -> list[str]:
    padded = f" {word} " if size > 1 else word
    return [padded[i:i + size] for i in range(len(padded) - size + 1)]


@dataclass
class Model:
    """Items of each length (0: whole words) with a row of log frequencies per language."""

    langs: list[str]
    items: list[dict[str, int]]
    logs: list[np.ndarray]

    def row(self, word: str) -> np.ndarray:
        at = self.items[0].get(word)
        if at is not None:
            return self.logs[0][at]
        for size in range(LONGEST, 0, -1):
            seen = [at for g in grams_of(word, size) if (at := self.items[size].get(g)) is not None]
            if seen:
                return self.logs[size][seen].mean(0)
        return np.full(len(self.langs), PENALTY, np.float32)


class Scorer:
    """Scores texts; rows of words met before are kept in a table of bounded size."""

    def __init__(self, model: Model, most: int = 200_000):
        self.model, self.most = model, most
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.langs)), np.float32)

    def __call__(self, text: str) -> tuple[str, float]:
        words = words_of(text)
        if not words or not self.model.langs:
            return "und", 0.0
        total = np.zeros(len(self.model.langs))
        for k in range(0, len(words), 100_000):
            part = words[k:k + 100_000]
            if len(self.place) > self.most:
                self.clear()
            for w in set(part).difference(self.place):
                at = len(self.place)
                if at == len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[at] = self.model.row(w)
                self.place[w] = at
            total += self.rows[[self.place[w] for w in part]].sum(0, dtype=np.float64)
        mean = total / len(words)
        best = int(mean.argmax())
        return self.model.langs[best], float(1 / (10 ** (mean - mean[best])).sum())


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), text_column(batch, "text")):
            counts.setdefault(lang, Counter()).update(words_of(text))
    yield from _counted(counts)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            grams = counts.setdefault(lang, Counter())
            for size in range(1, LONGEST + 1):
                for g in grams_of(word, size):
                    grams[g] += n
    yield from _counted(counts)


def _counted(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for lang, items in counts.items():
        pairs = list(items.items())
        for i in range(0, len(pairs), 20_000):
            part = pairs[i:i + 20_000]
            yield rows_batch({"lang": [lang] * len(part), "item": [p[0] for p in part],
                              "n": [p[1] for p in part]}, COUNT)


def train(labelled: DataFrame, rows_per_lang: int = 4000, most_words: int = 30_000,
          most_grams: int = 8_000) -> Model:
    """Fit on the columns ``doc_id`` (for the sample only), ``text`` and ``lang``."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(labelled.groupBy("lang").count().collect())  # one row per language
    langs, unit = sorted(sizes), 1 << 30
    if not langs:
        return Model([], [{}] * (LONGEST + 1), [np.zeros((0, 0), np.float32)] * (LONGEST + 1))
    share = F.create_map(*(x for g in langs for x in (
        F.lit(g), F.lit(int(unit * min(1.0, rows_per_lang / sizes[g]))))))
    sample = labelled.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(unit)) < share[F.col("lang")])
    schema = "lang string, item string, n long"

    def summed(rows):
        return rows.groupBy("lang", "item").agg(F.sum("n").alias("n"))

    words = summed(sample.select("lang", "text").mapInArrow(_count_words, schema)).cache()
    grams = summed(words.mapInArrow(_count_grams, schema))
    # One-letter words and n-grams of one letter are told apart by the size column.
    both = (words.withColumn("size", F.lit(0))
            .union(grams.withColumn("size", F.length("item"))))
    per = Window.partitionBy("lang", "size")
    top = (both.withColumn("total", F.sum("n").over(per))
           .withColumn("k", F.row_number().over(per.orderBy(F.desc("n"), "item")))
           .where(F.col("k") <= F.when(F.col("size") == 0, most_words).otherwise(most_grams)))
    items: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    found = sorted(top.select("size", "item", "lang", "n", "total").collect())
    words.unpersist()
    for size, item, *_ in found:
        items[size].setdefault(item, len(items[size]))
    logs = [np.full((len(x), len(langs)), PENALTY, np.float32) for x in items]
    for size, item, lang, n, total in found:
        logs[size][items[size][item], langs.index(lang)] = max(PENALTY, np.log10(n / total))
    return Model(langs, items, logs)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row, from the text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            found = [score(t) for t in text_column(batch, "text")]
            yield rows_batch({"doc_id": batch.column("doc_id"), "lang_pred": [f[0] for f in found],
                              "score": [f[1] for f in found]}, PREDICTED)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        work, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: remainder 1 of the CRC-32 of the id's text by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows of ``docs`` that are not held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))), **options)
    return predict(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least_lift: float = 1.02, **options) -> DataFrame:
    """Rows whose language is told better than by chance; all columns as they are.

    Chance is an even share for each language; a score must be ``least_lift`` times that. Short or
    mixed texts stay. With one language to learn there is no chance level.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))), **options)
    least_score = least_lift / len(model.langs) if len(model.langs) > 1 else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for batch in batches:
            found = [score(t) for t in text_column(batch, "text")]
            good = [lang != "und" and p >= least_score for lang, p in found]
            yield batch.filter(pa.array(good, pa.bool_()))
    return docs.mapInArrow(work, docs.schema)
