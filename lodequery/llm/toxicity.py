"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted by distance.

Terms are whole words and beginnings of words (3 to 5 letters), as insults are inflected; those are kept that toxic examples
hold more often than chance allows, and all other words of a text are one more term, so that a single unlucky word in
a long text weighs little. A vector has (1 + log count) times the inverse document frequency of each term, at unit length.

Examples of equal vectors are one entry with the weight of each label. Entries stand in blocks of alike ones; a term has
postings by entry and its greatest impact in each block. A search sums these bounds by block, scores the blocks of greatest
bound, and then only blocks that can still hold one of the k nearest; what it finds is what a full scan finds.

The examples are a bounded sample: at most PER_LABEL documents of each label, by a hash of the id. Votes are weighted by what
an example stands for, so that scores follow the corpus and not the sample. Every document gets a score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, with_struct, written

PER_LABEL, TERMS, NEAREST = 1500, 512, 10
#: The least likelihood ratio statistic of a term, and the least score of a text that is called toxic.
LEAST_G2, TOXIC_FROM = 20.0, 0.3
#: Entries of a block, letters of beginnings of words, and of the longest word that can be a term.
BLOCK, STARTS, LONGEST = 32, (3, 4, 5), 40
#: Blocks that a search scores first.
FIRST = 4
#: What is added to a distance before its inverse square weighs a vote, and examples that are named as evidence.
NEAR, EVIDENCE = 0.02, 3
FIELDS = "score double, predicted int, evidence array<struct<doc_id:long,toxic:int,cosine:double>>"
_OTHER = re.compile(r"[\W\d_]+")


def plain(text: str | None) -> str:
    """Lower-cased words between single spaces, spaces at both ends."""
    return f" {_OTHER.sub(' ', (text or '').lower()).strip()} "


def grams(said: str) -> set[str]:
    """The possible terms of a plain text."""
    out = set()
    for w in set(said.split()):
        if len(w) <= LONGEST:
            out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in STARTS if len(w) >= k)
    return out


class BlockMax:
    """Unit vectors (a row each, most of it zero) as an inverted index with the greatest impact of each term in each block."""

    def __init__(self, rows: np.ndarray, size: int = BLOCK):
        n, terms = rows.shape
        # alike entries side by side: by strongest term, then by its weight
        strongest = rows.argmax(axis=1) if n else np.zeros(0, int)
        self.order = np.lexsort((-rows.max(axis=1, initial=0.0), strongest))
        self.size, self.n, self.visited, self.blocks = size, n, 0, -(-n // size)
        # a term's postings: its impact by entry, room for whole blocks; a block's are side by side
        self.postings = np.zeros((terms, self.blocks * size))
        self.postings[:, :n] = rows[self.order].T
        self.most = self.postings.reshape(terms, self.blocks, size).max(axis=2, initial=0.0)
        self.inside = np.arange(size)

    def _scores(self, blocks: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of some blocks that share a term with a query, and their cosines."""
        self.visited += len(blocks)
        at = (blocks[:, None] * self.size + self.inside).ravel()
        scores = weights @ self.postings[terms[:, None], at]
        hit = scores > 0
        return at[hit], np.round(scores[hit], 12)

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k rows of greatest cosine, and these; of equals the first in index order.

        The FIRST blocks of greatest bound are scored, then those whose bound reaches the k-th cosine so far.
        """
        bound = weights @ self.most[terms]
        first = np.argsort(-bound, kind="stable")[:FIRST]
        at, found = self._scores(first, terms, weights)
        floor = np.partition(found, len(found) - k)[len(found) - k] if len(found) >= k else 0.0
        bound[first] = -1.0
        late = np.flatnonzero(bound >= max(floor - 1e-9, 1e-12))
        if len(late):
            more, cosines = self._scores(late, terms, weights)
            at, found = np.concatenate([at, more]), np.concatenate([found, cosines])
        good = found >= floor
        at, found = at[good], found[good]
        best = np.lexsort((at, -found))[:k]
        return self.order[at[best]], found[best]


@dataclass
class Model:
    terms: list[str]
    idf: np.ndarray  # of the terms, and 1 for all other words
    index: BlockMax
    mass: np.ndarray  # of each row of the index: clean and toxic documents that its examples stand for
    evidence: list[list[tuple[int, int]]]  # of each row: some of its examples and their labels


def vector(said: str, counts: Counter, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of a plain text, at unit length; `counts` has its terms by number."""
    at = np.array([*sorted(counts), len(idf) - 1])
    n = np.array([*(counts[i] for i in at[:-1]), max(1, said.count(" ") - 1)], float)
    weights = (1 + np.log(n)) * idf[at]
    return at, weights / np.sqrt((weights**2).sum())


def finder(terms: list[str]) -> Callable[[str], Counter]:
    """What counts the terms in a plain text, all at once."""
    automaton = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        automaton.add_word(t, i)
    automaton.make_automaton()
    return (lambda said: Counter(i for _, i in automaton.iter(said))) if terms else lambda said: Counter()


def examples(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, toxic) of the sample, at most per_label of each label, and how many rows each label has in all.

    Only rows whose crc32(doc_id as text) mod 4 is not 2 teach. A doc_id that is labelled twice is toxic if one label says so;
    of documents that share an id, the first text in order counts.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold("doc_id", 4) != 2)
    marked = marked.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    place = F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity"))
    first = [marked.where(F.col("toxic") == x).orderBy(place, "doc_id").limit(per_label) for x in (0, 1)]
    # at most per_label rows each
    chosen = F.broadcast(first[0].union(first[1]).withColumnRenamed("doc_id", "id"))
    met = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(chosen, F.col("doc_id") == F.col("id"))
    return met.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")), totals


def telling(sample: DataFrame, clean: int, toxic: int, most: int = TERMS) -> list[tuple[str, int]]:
    """(term, examples with it): terms that more of the toxic examples hold than chance allows, by likelihood ratio, strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            held = Counter(), Counter()
            for text, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[x].update(grams(plain(text)))
            for x in (0, 1):
                if held[x]:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held[x]), pa.string()), pa.array([n * (1 - x) for n in held[x].values()], pa.int64()), pa.array([n * x for n in held[x].values()], pa.int64())], names=["term", "clean", "toxic"])

    counts = sample.select("text", "toxic").mapInArrow(run, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    both, all_ = F.col("clean") + F.col("toxic"), float(max(clean + toxic, 1))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    cells = [(F.col("toxic"), both * (toxic / all_)), (F.col("clean"), both * (clean / all_)), (toxic - F.col("toxic"), (all_ - both) * (toxic / all_)), (clean - F.col("clean"), (all_ - both) * (clean / all_))]
    scored = counts.withColumn("g2", sum((part(s, e) for s, e in cells), F.lit(0.0))).where((F.col("g2") >= LEAST_G2) & (F.col("toxic") * clean > F.col("clean") * toxic))
    return [(r["term"], r["clean"] + r["toxic"]) for r in scored.orderBy(F.desc(F.round("g2", 6)), "term").limit(most).collect()]


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, most: int = TERMS) -> Model:
    """The labelled examples as an index. Without labels nothing is near any text."""
    sample, totals = examples(docs, labels, per_label)
    sample = written(sample, "examples")
    taken = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    chosen = telling(sample, taken.get(0, 0), taken.get(1, 0), most)
    terms, n = [t for t, _ in chosen], sum(taken.values())
    idf = np.array([np.log((n + 1) / (df + 1)) + 1 for _, df in chosen] + [1.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = finder(terms)
        for batch in slices(batches, "text"):
            made = []
            for text in batch.column(2).to_pylist():
                said = plain(text)
                made.append([x.tolist() for x in vector(said, count(said), idf)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.list_(pa.int64())), pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["doc_id", "toxic", "at", "weights"])

    # 2 * per_label rows of at most TERMS numbers
    entries: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
    rows = sample.select(F.col("doc_id").cast("long"), "toxic", "text").mapInArrow(run, "doc_id long, toxic int, at array<long>, weights array<double>").collect()
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        entries[tuple(r["at"]), tuple(np.round(r["weights"], 12))].append((r["doc_id"], r["toxic"]))
    dense, mass = np.zeros((len(entries), len(terms) + 1)), np.zeros((len(entries), 2))
    for i, ((at, weights), members) in enumerate(entries.items()):
        dense[i, list(at)] = weights
        for _, x in members:
            mass[i, x] += totals[x] / taken[x]
    return Model(terms, idf, BlockMax(dense), mass, [m[:EVIDENCE] for m in entries.values()])


def scorer(model: Model, k: int = NEAREST) -> Callable[[list], list[list]]:
    """What turns texts into scores, verdicts and evidence."""
    count, known = finder(model.terms), {}

    def one(text: str | None) -> tuple[float, int, list[dict]]:
        said = plain(text)
        counts = count(said)
        if not counts and known:
            return known[()]  # texts without a term all have the same vector
        at, cosine = model.index.search(*vector(said, counts, model.idf), k)
        if not len(at):
            return 0.0, 0, []
        vote = (model.mass[at] * (1 / (1 - np.minimum(cosine, 1) + NEAR) ** 2)[:, None]).sum(axis=0)
        score = float(vote[1] / vote.sum())
        seen = [{"doc_id": d, "toxic": x, "cosine": float(c)} for i, c in zip(at, cosine, strict=True) for d, x in model.evidence[i]]
        got = score, int(score >= TOXIC_FROM), seen[:EVIDENCE]
        if not counts:
            known[()] = got
        return got

    return lambda texts: list(zip(*map(one, texts), strict=True)) or [[], [], []]


def with_toxicity(docs: DataFrame, model: Model, into: str = "__toxicity", text: str = "text") -> DataFrame:
    """docs with struct<score,predicted,evidence>: the share of toxic votes, whether it is at least TOXIC_FROM, nearest examples.

    Null and empty texts are texts without a term, whose nearest examples are others without one. Texts of any length are read
    whole; repeated rows agree; of examples equally near, the first in index order votes. If nothing is labelled, scores are 0.
    Other columns pass through, whatever their names; one named as `into` is replaced. A table without rows gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return with_struct(docs, into, FIELDS, lambda: scorer(sent.value), text)
