"""Language-model scoring by a hidden Markov model, trained by Baum-Welch over all training documents.

Words are lower-cased (A-Z) runs of characters other than space and \\t to \\r; each text ends with one end token.

1. Texts are split once, and numbered by a word list for each batch of them. The lists' counts add up to the corpus's
   word count table, which gives the unigram base score.
2. The model's symbols are the TOP most frequent words at most, classes of all other words by ending and length, and the
   end token. Training starts from the corpus's bigram counts over its most frequent words, which are clustered
   spectrally, and runs ITERATIONS rounds of Baum-Welch: each partition's expected counts are rows, added up by Spark.
   Texts are never cut.
3. The last round also counts every other word state by state: those among the HEAD most frequent come to the driver, all
   others stay a distributed table that grows with the corpus. So every training word has emissions of its own: the class's
   times the word's within its class, of which half is the state's and half that of the class at large, which leaves room
   for words never seen.
4. The table's counts return to the batches that hold the words, and the exact scaled forward recursion scores whole texts.

What is sent to every task has a bound: HEAD words, and STATES probabilities for each of them and of the classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, give_back, slices, written

STATES, ITERATIONS = 8, 2
TOP, HEAD = 16_384, 131_072
ENDINGS, LENGTHS = 48, 4
CLASSES = ENDINGS * LENGTHS
#: The most frequent words whose bigrams give the start.
STARTERS = 512
SMOOTH = 0.1
#: The share of the class at large in an outer word's probability within its class.
AT_LARGE = 0.5
#: Tokens whose state probabilities are held at a time: those of texts that step through the recursions together.
ROOM = 300_000
#: Tokens that a task gathers before it runs the recursions.
GATHERED = 1_000_000
#: Bytes of text that are numbered together.
BATCH_BYTES = 8 << 20
#: Shares of states of an outer word travel as 16-bit numbers, four in a long.
SHARE = 65535
END = "\n"
_STATES = [f"g{z}" for z in range(STATES)]


def class_of(word: str) -> int:
    """0 to CLASSES - 1, by the last two characters and the length in characters."""
    return zlib.crc32(word[-2:].encode()) % ENDINGS * LENGTHS + (len(word) > 4) + (len(word) > 8) + (len(word) > 14)


def classes_of(words: pa.Array) -> np.ndarray:
    """class_of() of each word; endings are few."""
    ends = pa.compute.utf8_slice_codeunits(words, start=-2).dictionary_encode()
    by_end = np.array([zlib.crc32(e.encode()) % ENDINGS * LENGTHS for e in ends.dictionary.to_pylist()], np.int32)
    sizes = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False)
    return (by_end[ends.indices.to_numpy()] if len(words) else np.zeros(0, np.int32)) + (sizes > 4) + (sizes > 8) + (sizes > 14)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unsqueezed(data: bytes) -> pa.Buffer:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd")


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Words of all texts as numbers, 0 for the end after each text; how many each text has; the words in the order of their numbers."""
    lists = pa.compute.ascii_split_whitespace(pa.compute.ascii_lower(texts.fill_null("")))
    every = lists.flatten()  # with empty strings where a text begins or ends in white space
    some = pa.compute.binary_length(every).to_numpy(zero_copy_only=False) > 0
    upto, at = np.concatenate([[0], np.cumsum(some)]), lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes = (upto[at[1:]] - upto[at[:-1]] + 1).astype(np.int32)
    words = every.filter(pa.array(some)).dictionary_encode()
    out = np.zeros(len(words) + len(sizes), np.int32)
    is_word = np.ones(len(out), bool)
    is_word[np.cumsum(sizes) - 1] = False
    out[is_word] = words.indices.to_numpy() + 1
    return out, sizes, words.dictionary.to_pylist()


def listed(words: bytes) -> pa.Array:
    """The word list of a row: the end, then the words."""
    rest = unsqueezed(words).to_pybytes().decode()
    return pa.concat_arrays([pa.array([END]), pa.compute.split_pattern(pa.array([rest]), " ").flatten()]) if rest else pa.array([END])


ENCODED = "batch long, ids array<long>, learn binary, symbols binary, sizes binary, words binary, n array<long>"


def encoded(docs: DataFrame) -> DataFrame:
    """A row for many texts of docs (key, text, learn): keys, which to learn from, words as numbers (squeezed), lengths, the words
    (squeezed, without the end), and how often the end and each of them occurs in the texts to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BATCH_BYTES):
            symbols, sizes, words = numbered(batch.column(1))
            learn = np.array(batch.column(2).to_pylist(), bool)
            n = np.bincount(symbols[np.repeat(learn, sizes)], minlength=len(words) + 1)
            row = [number, batch.column(0).to_pylist(), learn.tobytes(), squeezed(symbols.tobytes()), sizes.tobytes(), squeezed(" ".join(words).encode()), n]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in ENCODED.split(", ")])
            number += 1

    return docs.mapInArrow(run, ENCODED)


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over the encoded training texts, the end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in zip(*batch.columns, strict=True):
                n = n.values
                some = pa.compute.greater(n, 0)
                yield pa.RecordBatch.from_arrays([listed(words.as_py()).filter(some), n.filter(some)], names=["word", "n"])

    return texts.select("words", "n").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _class_column(word: Column) -> Column:
    """class_of() as an expression."""
    size = F.length(word)
    longer = sum(((size > k).cast("int") for k in (4, 8, 14)), F.lit(0))
    return (F.crc32(F.right(word, F.lit(2)).cast("binary")) % ENDINGS * LENGTHS + longer).cast("int")


class Lexicon:
    """What the count table tells every task: totals, class totals, and the head's words, most frequent first.

    Symbols are the first words of the head (`top`), the classes of all other words, and the end token. A head word occurs
    twice at least; of words with equal counts, all or none are in the head, or among its first.
    """

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("n"), F.count("*")).first()
        self.n, self.v = total[0] or 0, total[1]
        words = counts.where(F.col("word") != END)
        steps = words.select(F.floor(F.log2("n") * 64).alias("step"), "n").groupBy("step").agg(F.count("*").alias("words"), F.min("n").alias("n")).orderBy(F.desc("step")).collect()
        self.least, least_top = _least(steps, HEAD), _least(steps, TOP)
        head = words.where(F.col("n") >= self.least).toArrow().to_pydict()
        order = sorted(range(len(head["n"])), key=lambda i: (-head["n"][i], head["word"][i]))
        self.words = pa.array([head["word"][i] for i in order], pa.string())
        n = np.array([head["n"][i] for i in order], np.int64)
        self.top = int((n >= least_top).sum())
        #: Counts and classes of the head's other words.
        self.middle_n = n[self.top :]
        self.middle_class = classes_of(self.words[self.top :]).astype(np.int32)
        self.class_n, self.class_v = np.zeros(CLASSES), np.zeros(CLASSES)
        for r in words.where(F.col("n") < least_top).groupBy(_class_column(F.col("word")).alias("cls")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            self.class_n[r["cls"]], self.class_v[r["cls"]] = r["n"], r["v"]
        ends = counts.where(F.col("word") == END).agg(F.sum("n")).first()[0] or 0
        self.symbols = self.top + CLASSES + 1
        self.symbol_n = np.concatenate([n[: self.top].astype(float), self.class_n, [float(ends)]])

    def base_log(self) -> float:
        return float(np.log10(self.n + 0.5 * (self.v + 1)))

    def class_size(self) -> np.ndarray:
        """What a class's word counts, each with a half added, and a half for words never seen add up to."""
        return self.class_n + 0.5 * (self.class_v + 1)

    def log_of(self, n: np.ndarray) -> np.ndarray:
        """The base score of words that occur so often."""
        return np.log10(n + 0.5) - self.base_log()

    def codes(self, words: pa.Array, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a word list: symbols, the places of words outside the head, and their classes.

        A word that isn't a symbol has its class's; `apart`, the head's other words come after the symbols, in order, and
        then the list's words outside the head.
        """
        at = pa.compute.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int32)
        at[0] = -2
        outer, middle = np.flatnonzero(at == -1), np.flatnonzero(at >= self.top)
        cls = classes_of(words.take(pa.array(outer))).astype(np.int32)
        if apart:
            at[middle] += self.symbols - self.top
            at[outer] = self.symbols + len(self.middle_n) + np.arange(len(outer), dtype=np.int32)
        else:
            at[middle] = self.top + self.middle_class[at[middle] - self.top]
            at[outer] = self.top + cls
        at[0] = self.symbols - 1
        return at, outer, cls


def _least(steps: list, most: int) -> int:
    """The least count, 2 or more, that `most` words at most reach. steps: numbers of words by count, the highest first."""
    seen, least = 0, steps[0]["n"] + 1 if steps else 2  # above all, should even the most frequent be too many
    for r in steps:
        seen += r["words"]
        if seen > most:
            break
        least = r["n"]
    return max(2, least)


class Hmm:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, say: np.ndarray):
        self.start, self.move, self.say = start, move, say

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, say: np.ndarray) -> Hmm:
        """Smoothed: every state keeps a small share for each symbol, in proportion to how often it occurs at all."""
        overall = say.sum(axis=0) + SMOOTH
        say = say + SMOOTH * len(overall) * overall / overall.sum()
        return Hmm((start + SMOOTH) / (start + SMOOTH).sum(), (move + SMOOTH) / (move + SMOOTH).sum(axis=1, keepdims=True), say / say.sum(axis=1, keepdims=True))

    @staticmethod
    def any(symbols: int, seed: int = 1) -> Hmm:
        rng = np.random.Generator(np.random.PCG64(seed))
        return Hmm.from_counts(np.ones(STATES), np.ones((STATES, STATES)) + 8 * np.eye(STATES), rng.random((STATES, symbols)) + 0.05)

    @staticmethod
    def first(symbol_n: np.ndarray, pairs: np.ndarray) -> Hmm:
        """Where training starts: each state says mostly one cluster of the most frequent words, and all others by their counts.

        pairs: how often one of these words follows another. They are clustered by the singular vectors of these counts
        (normalised by row and column sums) and by k-means from the words that lie farthest apart. With fewer words than
        states, fixed random factors tell the states apart.
        """
        m = len(pairs)
        share = np.full((STATES, len(symbol_n)), 1.0)
        move = np.ones((STATES, STATES)) + 8 * np.eye(STATES)
        if m > STATES:
            rows, cols = np.sqrt(pairs.sum(axis=1) + 1.0), np.sqrt(pairs.sum(axis=0) + 1.0)
            u, _, vt = np.linalg.svd(pairs / rows[:, None] / cols[None, :])
            x = np.concatenate([u[:, :STATES], vt[:STATES].T], axis=1)
            x /= np.sqrt((x * x).sum(axis=1))[:, None] + 1e-12
            centers = [0]
            for _ in range(STATES - 1):
                centers.append(int(np.argmin((x @ x[centers].T).max(axis=1))))
            middle = x[centers]
            for _ in range(20):
                cluster = np.argmax(x @ middle.T, axis=1)
                middle = np.stack([x[cluster == z].mean(axis=0) if (cluster == z).any() else middle[z] for z in range(STATES)])
            share[:, :m] = 0.2
            share[cluster, np.arange(m)] = 4.0
            member = np.eye(STATES)[cluster]
            move = member.T @ pairs @ member + 1.0 + move.mean()
        else:
            share *= np.random.Generator(np.random.PCG64(1)).random(share.shape) + 0.5
        return Hmm.from_counts(np.ones(STATES), move, symbol_n * share)

    def with_words(self, words: np.ndarray) -> Hmm:
        """The model with more symbols: for each a column of probabilities by state."""
        return Hmm(self.start, self.move, np.concatenate([self.say, words], axis=1))

    def log10(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Exact log10 likelihood of each sequence by the scaled forward recursion, all of them a step at a time."""
        if not sequences:
            return np.zeros(0)
        sizes = np.array([len(s) for s in sequences])
        order = np.argsort(-sizes, kind="stable")
        going = _going(sizes[order])
        flat = np.concatenate([sequences[i] for i in order])
        first = np.cumsum(sizes[order]) - sizes[order]
        say, back, total = np.ascontiguousarray(self.say), np.ascontiguousarray(self.move.T), np.zeros(len(sequences))
        alpha = np.repeat(self.start[:, None], len(sequences), axis=1)
        for t, n in enumerate(going.tolist()):
            if t:
                alpha = back @ alpha[:, :n]
            alpha *= say[:, flat[first[:n] + t]]
            scale = alpha.sum(axis=0)
            alpha /= scale
            total[:n] += np.log10(scale)
        out = np.empty(len(sequences))
        out[order] = total
        return out

    def expected(self, sequences: list[np.ndarray], real: type = np.float32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (Baum-Welch) of starts, moves and emissions over whole sequences.

        State probabilities are held for ROOM tokens at a time. Where one sequence has more, the forward pass keeps them at
        block borders only and each block's are made again on the way back. Probabilities of a token have 32 bits, sums 64.
        """
        s, c = self.say.shape
        start, move, out = np.zeros(s), np.zeros((s, s)), np.zeros((s, c))
        ordered = sorted(sequences, key=len, reverse=True)
        group = np.zeros(len(ordered), np.int64)  # sequences of about equal length go together
        held = 0
        for k, x in enumerate(ordered):
            held += len(x)
            group[k] = group[k - 1] + (held > ROOM) if k else 0
            held = len(x) if held > ROOM else held
        for k in range(group[-1] + 1 if len(group) else 0):
            lanes = _Lanes(self, ordered[np.searchsorted(group, k) : np.searchsorted(group, k, side="right")], real)
            pairs, later = np.zeros((s, s)), None  # later: what a step says of the one before it
            for a, b, before in reversed(lanes.blocks()):
                spans, symbols, says, alpha, scale = lanes.forward(a, b, before)
                for i, j in reversed(list(zip(spans, spans[1:], strict=False))):
                    now, beta = alpha[:, i:j], np.ones((s, j - i), real)
                    if later is not None:
                        n = later.shape[1]
                        pairs += now[:, :n] @ later.T
                        np.matmul(lanes.onward, later, out=beta[:, :n])
                    now *= beta  # now the probability of each state given the whole sequence
                    beta *= says[:, i:j]
                    beta /= scale[i:j]
                    later = beta
                for z in range(s):
                    out[z] += np.bincount(symbols, alpha[z], c)
                if a == 0:
                    start += alpha[:, : spans[1]].sum(axis=1, dtype=float)
            move += self.move * pairs
        return start, move, out


class _Lanes:
    """Sequences, longest first, that step through the forward recursion together: an array's row is a state, a column a token,
    by step and then by sequence."""

    def __init__(self, model: Hmm, sequences: list[np.ndarray], real: type):
        sizes = np.array([len(x) for x in sequences])
        self.flat, self.at, self.going = np.concatenate(sequences), np.cumsum(sizes) - sizes, _going(sizes)
        self.upto = np.concatenate([[0], np.cumsum(self.going)])
        self.borders = [0]
        while self.borders[-1] < len(self.going):
            most = int(np.searchsorted(self.upto, self.upto[self.borders[-1]] + ROOM, side="right")) - 1
            self.borders.append(max(self.borders[-1] + 1, most))
        self.say, self.start = model.say.astype(real), model.start.astype(real)[:, None]
        self.onward, self.back = np.ascontiguousarray(model.move, real), np.ascontiguousarray(model.move.T, real)
        self.room = np.empty((2, len(self.start), max(self.upto[b] - self.upto[a] for a, b in self.spans())), real)

    def spans(self) -> list[tuple[int, int]]:
        return list(zip(self.borders, self.borders[1:], strict=False))

    def blocks(self) -> list[tuple[int, int, np.ndarray | None]]:
        """Steps a to b of each block, with the state probabilities just before it."""
        entry: list[np.ndarray | None] = [None]
        for a, b in self.spans()[:-1]:
            spans, _, _, alpha, _ = self.forward(a, b, entry[-1])
            entry.append(alpha[:, spans[-2] : spans[-1]].copy())
        return [(a, b, e) for (a, b), e in zip(self.spans(), entry, strict=True)]

    def forward(self, a: int, b: int, before: np.ndarray | None) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where each step begins, symbols, their probabilities, scaled state probabilities and scales of a block."""
        n, spans = self.going[a:b], (self.upto[a : b + 1] - self.upto[a]).tolist()
        lane = np.arange(spans[-1]) - np.repeat(self.upto[a:b] - self.upto[a], n)
        symbols = self.flat[self.at[lane] + np.repeat(np.arange(a, b), n)]
        says, alpha = (x[:, : spans[-1]] for x in self.room)
        np.take(self.say, symbols, axis=1, out=says, mode="clip")
        scale = np.empty(spans[-1], says.dtype)
        for i, j in zip(spans, spans[1:], strict=False):
            now, whole = alpha[:, i:j], scale[i:j]
            if before is None:
                np.multiply(self.start, says[:, i:j], out=now)
            else:
                np.matmul(self.back, before[:, : j - i], out=now)
                now *= says[:, i:j]
            np.add.reduce(now, axis=0, out=whole)
            now /= whole
            before = now
        return spans, symbols, says, alpha, scale


def _going(sizes: np.ndarray) -> np.ndarray:
    """How many of the sequences, longest first, have a step t, for each t."""
    return np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")


def _sequences(codes: np.ndarray, symbols: bytes, sizes: bytes) -> list[np.ndarray]:
    """Each text of a row as symbols, which codes gives for the numbers of its word list."""
    n = np.frombuffer(sizes, np.int32)
    return np.split(codes[np.frombuffer(unsqueezed(symbols), np.int32)], np.cumsum(n)[:-1])


def _to_learn(batches: Iterator[pa.RecordBatch], lexicon: Lexicon, apart: bool) -> Iterator[tuple[list[np.ndarray], list[tuple]]]:
    """Training sequences in symbols, many rows at a time; `apart`: words that are no symbols come beyond these.

    With them, for each row (batch, words, n, places of words outside the head in these, their classes, the first one's number).
    """
    kept: list[np.ndarray] = []
    rows: list[tuple] = []
    first = lexicon.symbols + len(lexicon.middle_n)
    held, more = 0, 0
    give_back()
    for columns in batches:
        for batch, learn, symbols, sizes, words, n in zip(*columns, strict=True):
            words = listed(words.as_py())
            codes, outer, cls = lexicon.codes(words, apart)
            if apart:
                codes[outer] += more
                rows.append((batch.as_py(), words, n.values.to_numpy(), outer, cls, first + more))
                more += len(outer)
            new = [x for x, use in zip(_sequences(codes, symbols.as_py(), sizes.as_py()), np.frombuffer(learn.as_py(), bool), strict=True) if use]
            kept += new
            held += sum(map(len, new))
            if held >= GATHERED:
                yield kept, rows
                kept, rows, held, more = [], [], 0, 0
    if kept or rows:
        yield kept, rows
    kept, rows = [], []
    give_back()


def _learning(texts: DataFrame) -> DataFrame:
    return texts.select("batch", "learn", "symbols", "sizes", "words", "n")


#: Cells of the counts of starts and of moves from each state; cells from 0 on are symbols.
_START, _MOVE = -1, -2
_CELLS = "cell long, " + ", ".join(f"{g} float" for g in _STATES)
_WORDS = "batch long, at int, word string, n long, low long, high long"
assert STATES == 8


def _cell_rows(start: np.ndarray, move: np.ndarray, say: np.ndarray) -> pa.RecordBatch:
    cell = np.concatenate([[_START], _MOVE - np.arange(STATES), np.arange(say.shape[1])])
    values = np.concatenate([start[:, None], move.T, say], axis=1).astype(np.float32)
    some = np.flatnonzero(values.any(axis=0))
    return pa.RecordBatch.from_arrays([pa.array(cell[some]), *(pa.array(v[some]) for v in values)], names=["cell", *_STATES])


def packed_shares(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The share of each state (row) in a column's sum as two longs; 0 for columns of zeros."""
    total = values.sum(axis=0)
    q = np.round(values / np.where(total > 0, total, 1.0) * SHARE).astype(np.uint64)
    low, high = (np.bitwise_or.reduce(q[k : k + 4] << (np.arange(4, dtype=np.uint64) * np.uint64(16))[:, None], axis=0) for k in (0, 4))
    return low.view(np.int64), high.view(np.int64)


def unpacked_shares(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    q = np.stack([(x.view(np.uint64) >> np.uint64(16 * k)) & np.uint64(SHARE) for x in (low, high) for k in range(4)]).astype(float)
    return q / np.maximum(q.sum(axis=0), 1.0)


def _counted(texts: DataFrame, lexicon: Lexicon, model: Hmm, apart: bool = False, outer_only: bool = False) -> DataFrame:
    """Expected counts of each task as rows of cells; `apart`: of the head's other words too; outer_only: instead a row for each
    batch and word outside the head."""
    sent = texts.sparkSession.sparkContext.broadcast((lexicon, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, hmm = sent.value
        s, m = lex.symbols, lex.symbols + len(lex.middle_n) * apart
        start, move, say = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((STATES, m))
        for sequences, rows in _to_learn(batches, lex, apart):
            cls = np.concatenate([lex.middle_class[: m - s], *(r[4] for r in rows)])
            a, b, c = hmm.with_words(hmm.say[:, lex.top + cls]).expected(sequences)
            for batch, words, n, outer, _, first in rows if outer_only else []:
                low, high = packed_shares(c[:, first : first + len(outer)])
                cols = [pa.array(np.full(len(outer), batch)), pa.array(outer.astype(np.int32)), words.take(pa.array(outer)), pa.array(n[outer]), pa.array(low), pa.array(high)]
                yield pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _WORDS.split(", ")])
            start, move, say = start + a, move + b, say + c[:, :m]
            for z in range(STATES):
                say[z, lex.top : lex.top + CLASSES] += np.bincount(cls, c[z, s:], CLASSES)
        if not outer_only:
            yield _cell_rows(start, move, say)

    return _learning(texts).mapInArrow(run, _WORDS if outer_only else _CELLS)


def _model_of(rows: DataFrame, symbols: int, more: int = 0) -> tuple[Hmm, np.ndarray]:
    """The model that the rows of cells add up to, and the counts by state of its symbols and of `more` cells after them."""
    sums = rows.groupBy("cell").agg(*(F.sum(g).alias(g) for g in _STATES)).toArrow()
    cell, values = sums.column("cell").to_numpy(), np.stack([sums.column(g).to_numpy() for g in _STATES])
    start, move, say = np.zeros((STATES, 1)), np.zeros((STATES, STATES)), np.zeros((STATES, symbols + more))
    start[:, _START - cell[cell == _START]] = values[:, cell == _START]
    move[:, _MOVE - cell[cell <= _MOVE]] = values[:, cell <= _MOVE]
    say[:, cell[cell >= 0]] = values[:, cell >= 0]
    return Hmm.from_counts(start[:, 0], move.T, say[:, :symbols]), say


def bigrams(texts: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """How often each of the STARTERS most frequent words follows each, over all training texts."""
    m, sent = min(STARTERS, lexicon.top), texts.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m * m)
        for sequences, _ in _to_learn(batches, sent.value, False):
            x = np.concatenate(sequences).astype(np.int64)
            a, b = x[:-1], x[1:]  # across texts too, but there stands an end, which is no starter
            both = (a < m) & (b < m)
            total += np.bincount(a[both] * m + b[both], minlength=m * m)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    sums = _learning(texts).mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(m * m)
    out[sums.column("cell").to_numpy()] = sums.column("n").to_numpy()
    return out.reshape(m, m)


def train(texts: DataFrame, lexicon: Lexicon) -> tuple[Hmm, np.ndarray, np.ndarray, DataFrame]:
    """Baum-Welch over the encoded training texts: the model, the classes' counts by state, the head's other words' as well, and the
    words outside the head in each batch (batch, at, n, low, high) with their counts and shares of states over the whole corpus."""
    s, m = lexicon.symbols, len(lexicon.middle_n)
    model = Hmm.first(lexicon.symbol_n, bigrams(texts, lexicon))
    for _ in range(ITERATIONS - 1):
        model, _ = _model_of(_counted(texts, lexicon, model), s)
    # the last round's words outside the head are counted again on their way to the batches, rather than written in between
    outer = _totals(_counted(texts, lexicon, model, apart=True, outer_only=True))
    model, say = _model_of(_counted(texts, lexicon, model, apart=True), s, m)
    return model, say[:, lexicon.top : lexicon.top + CLASSES], say[:, s:], outer


def _totals(words: DataFrame) -> DataFrame:
    """n and the shares of states (low, high) of each word in each batch, over all batches. A word outside the head is rare, and
    no batch lists it twice."""
    w = Window.partitionBy("word")
    one = lambda c, k: F.shiftrightunsigned(F.col(c), 16 * k).bitwiseAND(F.lit(SHARE).cast("long"))
    sums = words.select("batch", "at", F.sum("n").over(w).alias("total"), *(F.sum(F.col("n") * one(c, k)).over(w).alias(f"{c}{k}") for c in ("low", "high") for k in range(4)))
    again = lambda c: reduce(Column.bitwiseOR, (F.shiftleft(F.round(F.col(f"{c}{k}") / F.col("total")).cast("long"), 16 * k) for k in range(4)))
    return sums.where("total > 0").select("batch", "at", F.col("total").alias("n"), again("low").alias("low"), again("high").alias("high"))


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(texts: DataFrame, lexicon: Lexicon, model: Hmm, in_class: np.ndarray, middle: np.ndarray, outer: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) for every encoded text; the outer words of a batch of texts are more symbols
    to the model there."""
    sent = texts.sparkSession.sparkContext.broadcast((lexicon, model, in_class, middle))

    def run(batch: pa.Table, known: pa.Table) -> pa.Table:
        lex, hmm, in_class, middle = sent.value
        out = []
        for ids, symbols, sizes, words in zip(*(batch.column(c) for c in ("ids", "symbols", "sizes", "words")), strict=True):
            codes, places, cls = lex.codes(listed(words.as_py()), True)
            row = np.zeros(len(codes), np.int64)
            row[places] = np.arange(len(places))
            at = row[known.column("at").to_numpy()]
            n, own = np.zeros(len(places)), np.zeros((STATES, len(places)))
            n[at] = known.column("n").to_numpy()
            own[:, at] = unpacked_shares(known.column("low").to_numpy(), known.column("high").to_numpy()) * n[at]
            n, own, cls = np.concatenate([lex.middle_n, n]), np.concatenate([middle, own], axis=1), np.concatenate([lex.middle_class, cls])
            whole = hmm.with_words(hmm.say[:, lex.top + cls] * outer_probability(n, own, in_class[:, cls], lex.class_size()[cls]))
            n = np.concatenate([lex.symbol_n, n])
            logs, seen = lex.log_of(n), (n > 0).astype(np.int64)
            sequences = _sequences(codes, symbols.as_py(), sizes.as_py())
            flat, starts = np.concatenate(sequences), np.cumsum([0, *map(len, sequences[:-1])])
            cols = [pa.array(ids.as_py(), pa.int64()), pa.array([len(x) for x in sequences], pa.int64()), pa.array(np.add.reduceat(seen[flat], starts)), pa.array(np.add.reduceat(logs[flat], starts)), pa.array(whole.log10(sequences))]
            out.append(pa.Table.from_arrays(cols, names=[x.split()[0] for x in SCORED.split(", ")]))
        return pa.concat_tables(out)

    return texts.select("batch", "ids", "symbols", "sizes", "words").groupBy("batch").cogroup(outer.groupBy("batch")).applyInArrow(run, SCORED)


def outer_probability(counts: np.ndarray, own: np.ndarray, in_class: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The probability of words within their class, a row for each state.

    counts, own: a word's occurrences, and those by state; in_class, size: the same of its class. A state with under a
    hundredth of the class takes the class at large, as its shares are too small to be exact.
    """
    at_large, never = (counts + 0.5) / size, in_class <= 0.01 * in_class.sum(axis=0)
    return (1 - AT_LARGE) * np.where(never, at_large, own / np.where(never, 1.0, in_class)) + AT_LARGE * at_large


def scores(docs: DataFrame, held_out: int = 1) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of docs (doc_id, text).

    Learned from the rows whose fold isn't held out; a null doc_id is not learned from. A null or empty text is one end.
    Rows that repeat an id or a text are learned from and scored each for itself, in any table, one without rows included;
    a text of any length is one sequence. With nothing to learn from, counts are 0 and the model says all symbols alike.
    """
    learn = F.coalesce(fold() != held_out, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), learn.alias("learn"))
    texts = written(encoded(rows), "symbols")
    counts = written(word_counts(texts), "counts")
    lexicon = Lexicon(counts)
    scored = score(texts, lexicon, *train(texts, lexicon))
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(lexicon.n).cast("long").alias("train_tokens"), "base_score", "score")
