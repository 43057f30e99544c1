"""Language identification, word first: known words score by their log frequency in each language; an unseen word backs
off to its longest character n-grams that are known, from 5 characters down to 1.

The classifier is fitted on a bounded sample of labelled rows: about DOCS_PER_LANG documents of each language, chosen by
a hash of the id, so that the model's size doesn't depend on the corpus. Every document gets a prediction.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, small, with_struct

DOCS_PER_LANG = 2000
MIN_WORD, MIN_GRAM, LONGEST = 2, 3, 5
FIELDS = "lang_pred string, score double"
#: Unseen words that a task remembers.
REMEMBERED = 200_000
#: Words of more letters aren't remembered, and their n-grams are counted in Python, in linear time.
LONG = 64
#: Letters of a word whose n-grams are made at a time.
CHUNK = 65_536
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> Counter:
    return Counter(_WORDS.findall(text.lower()))


def gram_chunks(word: str, n: int) -> Iterator[list[str]]:
    """The n-grams of a word between spaces, some at a time, so that a very long word needs little memory."""
    padded = f" {word} "
    last = len(padded) - n + 1
    for at in range(0, last, CHUNK):
        yield [padded[i : i + n] for i in range(at, min(at + CHUNK, last))]


def long_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n, types) of long words from (lang, word, n)."""
    for batch in batches:
        for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for k in range(1, LONGEST + 1):
                for chunk in gram_chunks(word, k):
                    c = Counter(chunk)
                    times = np.fromiter(c.values(), np.int64, len(c))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(times * n), pa.array(times)], names=["lang", "gram", "n", "types"])


def training_rows(docs: DataFrame) -> DataFrame:
    """The sample: of each non-null lang, documents in fold 1 to 4 whose hash is in the share that gives DOCS_PER_LANG."""
    fit_on = docs.select("doc_id", "text", "lang").where((fold() != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = fit_on.groupBy("lang").count().select(F.col("lang").alias("of"), (F.lit(float(DOCS_PER_LANG)) / F.col("count")).alias("share"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    return fit_on.join(small(share, 10_000), F.col("lang") == F.col("of")).where(place < F.col("share")).select("text", "lang")


class Model:
    """Languages, and log frequencies of words and n-grams: a row of a matrix for each."""

    def __init__(self, langs: list[str], words: dict[str, int], word_logs: np.ndarray, gram_rows: dict[str, int], gram_logs: np.ndarray):
        self.langs, self.words, self.word_logs, self.gram_rows, self.gram_logs = langs, words, word_logs, gram_rows, gram_logs

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            total, seen = 0.0, 0
            for chunk in gram_chunks(word, n):
                if found := [self.gram_rows[g] for g in chunk if g in self.gram_rows]:
                    total, seen = total + self.gram_logs[found].sum(axis=0, dtype=float), seen + len(found)
            if seen:
                return total / seen
        return np.zeros(len(self.langs), np.float32)


def fit(docs: DataFrame) -> Model:
    """Counts of words and n-grams by language over the sample, add-a-half smoothed."""

    def count(batches):
        for batch in slices(batches, "text"):
            texts, langs = (batch.column(i).to_pylist() for i in (0, 1))
            by: dict[str, Counter] = defaultdict(Counter)
            for t, x in zip(texts, langs, strict=True):
                by[x].update(words_of(t))
            for x, c in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([x] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])

    words = training_rows(docs).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    logged = words.withColumn("n", F.log1p("n"))  # a word counts for its n-grams by the log of its count
    short = logged.where(F.length("word") <= LONG).select("lang", F.explode(F.flatten(F.array(*(_cuts(padded, k) for k in range(1, LONGEST + 1))))).alias("gram"), "n", F.lit(1).cast("long").alias("types"))
    long = logged.where(F.length("word") > LONG).select("lang", "word", "n").mapInArrow(long_grams, "lang string, gram string, n double, types long")
    pieces = short.union(long).groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).where(F.col("types") >= MIN_GRAM)
    known = words.where(F.col("n") >= MIN_WORD).toArrow().to_pydict()
    known_grams = pieces.toArrow().to_pydict()
    langs = sorted(set(known["lang"]) | set(known_grams["lang"]))

    def logs(keys: list[str], of: list[str], n: list[float]) -> tuple[dict[str, int], np.ndarray]:
        rows: dict[str, int] = {}
        at = np.fromiter((rows.setdefault(k, len(rows)) for k in keys), np.int64, len(keys))
        counts = np.zeros((len(rows), len(langs)))
        np.add.at(counts, (at, np.fromiter(map(langs.index, of), np.int64, len(of))), np.asarray(n, float))
        return rows, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * (len(rows) + 1))).astype(np.float32)

    return Model(langs, *logs(known["word"], known["lang"], known["n"]), *logs(known_grams["gram"], known_grams["lang"], known_grams["n"]))


def _cuts(text, k: int):
    starts = F.sequence(F.lit(1), F.length(text) - (k - 1))
    return F.when(F.length(text) >= k, F.transform(starts, lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def predictor(model: Model):
    """What turns texts into languages and the posterior probability of the best one, under equal priors."""
    memory: dict[str, np.ndarray] = {}

    def of_unseen(word: str) -> np.ndarray:
        got = memory.get(word)
        if got is None:
            if len(memory) >= REMEMBERED:
                memory.clear()
            got = model.unseen(word)
            if len(word) <= LONG:
                memory[word] = got
        return got

    def one(text: str | None) -> tuple[str, float]:
        counts = words_of(text or "")
        if not model.langs or not any(c.isalpha() for w in counts for c in w):
            return "und", 0.0
        rows, times, total = [], [], np.zeros(len(model.langs))
        for word, n in counts.items():
            row = model.words.get(word)
            if row is None:
                total += n * of_unseen(word)
            else:
                rows.append(row)
                times.append(n)
        if rows:
            total += np.asarray(times, float) @ model.word_logs[rows].astype(float)
        best = int(np.argmax(total))  # of equals, the first language in order
        return model.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())

    return lambda texts: zip(*map(one, texts), strict=True)


def with_language(docs: DataFrame, model: Model, into: str = "__language", text: str = "text") -> DataFrame:
    """docs with struct<lang_pred,score>: `und` and 0 if the text is null or has no letter, or nothing was learned.

    Nothing but the text enters a prediction, so repeated rows agree. Texts and words of any length are read whole. Of languages
    that fit equally, the first in order is taken. Other columns pass through, whatever their names; one named as `into` is
    replaced. A table without rows gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_struct(docs, into, FIELDS, lambda: predictor(sent.value), text)
