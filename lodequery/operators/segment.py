"""Words of text that is written without spaces: a lattice of dictionary words, and the likeliest path through it.

The dictionary is learnt from the corpus in Spark: from texts with spaces, their words; from scripts without, sequences of
characters that occur together far more often than their parts would by chance, and that don't nearly always go on the same way.
A segmenter is a column function, so it can stand wherever texts are cut to tokens (`Segment` in search).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import accumulate
from math import log

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens

#: Characters of scripts without spaces, and of words between spaces.
HAN, LETTERS = "[一-鿿]+", "[a-zà-öø-ÿß]+"
#: Characters of a word at most, its occurrences at least, how much oftener than by chance its parts meet, the share of its
#: occurrences up to which one character may follow or precede it, and words of a dictionary (the most frequent ones).
LONGEST, LEAST, COHESION, SAME_NEXT, MOST = 4, 5, 30.0, 0.9, 200_000


def _runs(docs: DataFrame, script: str, text: str) -> DataFrame:
    """(run, n): different runs of a script's characters in lower case, and how often each occurs."""
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(script), F.lit(0))).alias("run"))
    return found.groupBy("run").agg(F.count("*").alias("n"))


def spaced_words(docs: DataFrame, text: str = "text", script: str = LETTERS, least: int = 2, most: int = MOST) -> DataFrame:
    """(word, n): the most frequent words of texts with spaces; ties by word."""
    return _runs(docs, script, text).where(F.col("n") >= least).select(F.col("run").alias("word"), "n").orderBy(F.desc("n"), "word").limit(most)


def unspaced_words(
    docs: DataFrame, text: str = "text", script: str = HAN, longest: int = LONGEST, least: int = LEAST, cohesion: float = COHESION, most: int = MOST
) -> DataFrame:
    """(word, n) of a script without spaces: single characters, and sequences of up to `longest` that hold together."""
    runs = _runs(docs, script, text)
    cuts = lambda k: F.when(F.length("run") >= k, F.transform(F.sequence(F.lit(1), F.length("run") - (k - 1)), lambda i: F.substring(F.col("run"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    grams = runs.select(F.explode(F.flatten(F.array(*(cuts(k) for k in range(1, longest + 2))))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))
    grams = grams.withColumn("size", F.length("word"))
    single = grams.where("size = 1").select("word", "n")
    total = single.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = grams.where((F.col("size") > 1) & (F.col("size") <= longest) & (F.col("n") >= least)).select("word", "n", "size")
    part = grams.select(F.col("word").alias("part"), F.col("n").alias("of"))
    # the weakest of the places where a word could fall apart
    places = words.select("word", "n", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("at"))
    halves = places.select("word", "n", F.expr("substring(word, 1, at)").alias("left"), F.expr("substring(word, at + 1)").alias("right"))
    both = halves.join(part.toDF("left", "of_left"), "left").join(part.toDF("right", "of_right"), "right")
    held = both.groupBy("word").agg(F.min(F.col("n") * float(max(total, 1)) / (F.col("of_left") * F.col("of_right"))).alias("held")).where(F.col("held") >= cohesion)
    longer = grams.where("size > 1")
    after = longer.groupBy(F.expr("substring(word, 1, size - 1)").alias("word")).agg(F.max("n").alias("after"))
    before = longer.groupBy(F.expr("substring(word, 2)").alias("word")).agg(F.max("n").alias("before"))
    free = words.join(held, "word", "left_semi").join(after, "word", "left").join(before, "word", "left")
    apart = F.greatest(F.coalesce("after", F.lit(0)), F.coalesce("before", F.lit(0))) <= F.col("n") * SAME_NEXT
    return free.where(apart).select("word", "n").unionByName(single).orderBy(F.desc("n"), "word").limit(most)


class Lattice:
    """The likeliest way to cut a text into dictionary words, each with its log share; an unknown character counts half."""

    def __init__(self, words: dict[str, int]):
        total = sum(words.values()) or 1
        self.weight = {w: log(n / total) for w, n in words.items()}
        self.unknown = log(0.5 / total)
        self.read = ahocorasick.Automaton()  # finds all words in one pass
        for w, x in self.weight.items():
            self.read.add_word(w, (len(w), x))
        self.read.make_automaton()

    def cut(self, run: str) -> list[str]:
        """Of equally likely ways, that with the longest last word, then the longest one before it, and so on."""
        at = self.places(run)
        return [run[a:b] for a, b in zip(at, at[1:], strict=False)]

    def places(self, run: str) -> list[int]:
        """Where the words of cut() end, from 0 on."""
        best, size, n, unknown = [0.0], [0], 0, self.unknown
        for last, (k, w) in self.read.iter(run) if self.weight else ():
            while n <= last:
                best.append(best[n] + unknown)
                size.append(1)
                n += 1
            x = best[n - k] + w
            if x > best[n] or (x == best[n] and k > size[n]):
                best[n], size[n] = x, k
        size += [1] * (len(run) - n)
        out, end = [len(run)], len(run)
        while end:
            end -= size[end]
            out.append(end)
        return out[::-1]


def dictionary(words: DataFrame) -> Callable[[], Lattice]:
    """The lattice of (word, n), MOST rows at most, for use inside tasks, where it is made once."""
    sent = words.sparkSession.sparkContext.broadcast({r["word"]: r["n"] for r in words.limit(MOST).collect()})
    made: dict[int, Lattice] = {}
    return lambda: made.get(0) or made.setdefault(0, Lattice(sent.value))


def segmenter(words: DataFrame, script: str = HAN) -> Callable[[Column], Column]:
    """Texts to tokens: cut at white space, and runs of the script's characters by the dictionary (word, n), MOST rows at most.

    What isn't of the script stays whole between runs. A null text has no tokens.
    """
    find, blank, known = re.compile(f"({script})"), re.compile(tokens.BLANK + "+"), dictionary(words)

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        lattice = known()

        def one(text: str | None) -> list[str]:
            out = []
            for token in blank.split(text or ""):
                for i, piece in enumerate(find.split(token)):
                    if piece:
                        out += lattice.cut(piece) if i % 2 else [piece]
            return out

        return texts.map(one)

    return lambda text: cut(F.coalesce(text, F.lit("")))


def glued_agreement(docs: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text", script: str = LETTERS) -> DataFrame:
    """(key, n_words, n_pieces, n_same): each line's words written without spaces and cut again; words that come back as they were.

    A measure of a dictionary. Null and empty texts have no words; texts of any length are cut line by line.
    """
    lines = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "\n"), lambda x: x.rlike(script))
    found = F.transform(lines, lambda x: F.array_join(F.regexp_extract_all(x, F.lit(script), F.lit(0)), " "))
    known = dictionary(words)

    @F.pandas_udf("n_words int, n_pieces int, n_same int")
    def compared(texts: pd.Series) -> pd.DataFrame:
        lattice, out = known(), []
        spans = lambda at: set(zip(at, at[1:], strict=False))

        for lines in texts:
            n_words = n_pieces = n_same = 0
            for line in lines:
                said = line.split(" ")
                pieces = lattice.places("".join(said))
                n_words, n_pieces = n_words + len(said), n_pieces + len(pieces) - 1
                n_same += len(spans([0, *accumulate(map(len, said))]) & spans(pieces))
            out.append((n_words, n_pieces, n_same))
        return pd.DataFrame(out, columns=["n_words", "n_pieces", "n_same"])

    return docs.select(F.col(key), compared(found).alias("c")).select(key, "c.*")
