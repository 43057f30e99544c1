"""Two tokenizers aligned: how the tokens of one vocabulary correspond to those of another over a corpus.

Byte offsets at which tokens of both end cut a text into groups; the tokens of both that end there are linked. Texts repeat
few groups many times, so a group is interned as the string of its ids, `a1,a2|b1`: each task counts its own, and one
aggregation makes the dictionary of distinct groups with their occurrences and documents. Links are expanded once for each
entry and weighted by its count, and what they are worth goes back to the documents by a join on the group. The most frequent
groups, at most HEAD of them, are joined by broadcast; the others, each of them rare, by a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate, chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bpe
from .common import slices, written

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Entries of the dictionary that are broadcast, the most frequent ones.
HEAD = 262_144
#: Words that a task remembers, and the longest of them.
REMEMBERED, LONGEST = 300_000, 64
#: Below this code point, and without carriage returns, no token of either vocabulary begins before white space and ends
#: after it (a test holds words against whole texts), so words are encoded once.
SAME_BELOW = "ɐ"
_OTHERS = re.compile(f"[\r{SAME_BELOW}-\U0010ffff]")
_WORDS = re.compile("[\t\n\x0b\x0c \x85\xa0]*[^\t\n\x0b\x0c \x85\xa0]+|[\t\n\x0b\x0c \x85\xa0]+$")
SPACE = "▁"
ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups array<struct<g:string,times:long>>"
COUNTED = f"{ROW}, g string, freq long, docs long"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: visible ones for themselves, the others from U+0100 on."""
    visible = [b for first, last in ("!~", "¡¬", "®ÿ") for b in range(ord(first), ord(last) + 1)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def piece_bytes(piece: str) -> bytes:
    return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace(SPACE, " ").encode()


class Aligner:
    """Groups of texts by a byte-level vocabulary (tokenizers file) and a piece vocabulary (sentencepiece model).

    A result is (n_a, n_b, groups joined by semicolons).
    """

    def __init__(self, a_path: str | None = None, b_path: str | None = None):
        import sentencepiece
        import tokenizers

        own = public_tokenizers.path(A), public_tokenizers.path(B)
        a_path, b_path = a_path or own[0], b_path or own[1]
        self.a, self.b = tokenizers.Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters, vocabulary = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        self.of_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.of_a[i] = bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode()
        self.of_b = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.sizes = [len(x) for x in self.of_a], [len(x) for x in self.of_b]
        self.names = list(map(str, range(max(len(self.of_a), len(self.of_b)))))
        self.blank, self.fast = self.b.piece_to_id(SPACE), None
        if (a_path, b_path) == own:
            import tiktoken

            ranks = bpe.read_ranks(public_tokenizers.path(A.replace(".json", ".tiktoken")))
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        # what was met lately, and before that; a word that is met again stays
        self._new: dict[str, tuple[int, int, str] | None] = {}
        self._old: dict[str, tuple[int, int, str] | None] = {}

    def cut(self, a: list[int], b: list[int], whole: bytes) -> tuple[int, int, str] | None:
        """The groups of the ids of one text; none if the bytes of either aren't the text's."""
        if b"".join(map(self.of_a.__getitem__, a)) != whole or b"".join(map(self.of_b.__getitem__, b)) != whole:
            return None
        names, (size_a, size_b) = self.names, self.sizes
        if len(a) == 1 or len(b) == 1:
            return len(a), len(b), f"{','.join([names[i] for i in a])}|{','.join([names[i] for i in b])}"
        groups, j, at_b, of_a, of_b, at_a = [], 0, 0, [], [], 0
        for i in a:
            at_a += size_a[i]
            of_a.append(names[i])
            while at_b < at_a:
                at_b += size_b[b[j]]
                of_b.append(names[b[j]])
                j += 1
            if at_a == at_b:
                groups.append(f"{','.join(of_a)}|{','.join(of_b)}")
                of_a, of_b = [], []
        return len(a), len(b), ";".join(groups)

    def whole(self, text: str) -> tuple[int, int, str] | None:
        said = " " + text
        return self.cut(self.a.encode(said, add_special_tokens=False).ids, self.b.encode(text), said.encode())

    def words(self, words: list[str]) -> list[tuple[int, int, str] | None]:
        """Words with the white space before them: as inside a text, where nothing is put before them."""
        out = []
        for w, b in zip(words, self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1), strict=True):
            if w == " ":
                b = [self.blank]
            elif w[0] != " " and b[:1] == [self.blank]:
                b = b[1:]
            out.append(self.cut(self.fast(w), b, w.encode()))
        return out

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words of some texts that aren't known yet."""
        new, old = self._new, self._old
        if len(new) >= REMEMBERED:
            self._new, self._old = new, old = {}, new
        unseen = []
        for w in set(chain.from_iterable(texts)):
            if w not in new:
                if w in old:
                    new[w] = old[w]
                else:
                    unseen.append(w)
        new.update(zip(unseen, self.words(unseen), strict=True))

    def __call__(self, texts: list[str | None]) -> list[tuple[int, int, str]]:
        """A result for each text: nothing for a null or empty one, and for one that a vocabulary can't give back."""
        cut = [_WORDS.findall(" " + t) if t and self.fast and not _OTHERS.search(t) else None for t in texts]
        self.learn([c for c in cut if c])
        known, out = self._new, []
        for t, words in zip(texts, cut, strict=True):
            got = None
            if words:
                met = list(map(known.__getitem__, words))
                if None not in met:
                    n_a, n_b, groups = zip(*met, strict=True)
                    got = sum(n_a), sum(n_b), ";".join(groups)
            elif t:
                got = self.whole(t)
            out.append(got or (0, 0, ""))
        for w in [w for w in known if len(w) > LONGEST]:
            del known[w]
        return out


_ALIGNERS: dict[tuple[str | None, str | None], Aligner] = {}


def aligner(a_path: str | None = None, b_path: str | None = None) -> Aligner:
    """A worker process serves many tasks; an aligner is made once in each."""
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def counted(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row for each document (n is its number, g is null), and rows of groups as each batch of documents has counted them.

    Only doc_id and text are read. A group of a document is in `groups` once, with how often it occurs.
    """
    kinds = to_arrow_schema(T.StructType.fromDDL(COUNTED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        for batch in slices(batches, "text", 4 << 20):
            made = align(batch.column(1).to_pylist())
            cut = [m[2].split(";") if m[2] else [] for m in made]
            times = list(map(Counter, cut))
            at = [0, *accumulate(map(len, times))]
            inner = pa.StructArray.from_arrays([pa.array(list(chain.from_iterable(times)), pa.string()), pa.array(list(chain.from_iterable(t.values() for t in times)), pa.int64())], fields=list(kinds.field("groups").type.value_type))
            sizes = [len(c) for c in cut]
            digests = [sha256(m[2].encode()).hexdigest() if m[2] else "" for m in made]
            rows = [batch.column(0), [m[0] for m in made], [m[1] for m in made], sizes, sizes, digests, pa.ListArray.from_arrays(pa.array(at, pa.int32()), inner, type=kinds.field("groups").type)]
            none = [[None] * len(made)] * 3
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(rows + none, kinds, strict=True)], schema=kinds)
            freq, within = Counter(chain.from_iterable(cut)), Counter(chain.from_iterable(times))
            own = [[None] * len(freq)] * 7 + [list(freq), list(freq.values()), [within[g] for g in freq]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(own, kinds, strict=True)], schema=kinds)

    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return plain.mapInArrow(run, COUNTED).withColumn("n", F.monotonically_increasing_id())


def dictionary(counts: DataFrame) -> DataFrame:
    """(g, freq, docs): the distinct groups, how often they occur, and in how many documents."""
    return counts.where("g IS NOT NULL").groupBy("g").agg(F.sum("freq").alias("freq"), F.sum("docs").alias("docs"))


def links(groups: DataFrame, weight: str = "freq") -> DataFrame:
    """(a, b, count, best) for each linked pair of ids; best: no pair of this b counts more. weight: freq or docs.

    Tokens have at least one byte, so the links of a group are that of its last two tokens.
    """
    last = lambda side: F.element_at(F.split(F.element_at(F.split("g", "\\|"), side), ","), -1).cast("long")
    pairs = groups.select(last(1).alias("a"), last(2).alias("b"), weight).groupBy("a", "b").agg(F.sum(weight).alias("count"))
    most = pairs.groupBy("b").agg(F.max("count").alias("most"))
    return pairs.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def frequent(groups: DataFrame, most: int) -> int:
    """The least frequency such that at most so many groups have it or a greater one; 0 if all of them are few enough."""
    total, least = 0, 0
    # as many rows as there are different frequencies, greatest first
    for r in groups.groupBy("freq").count().orderBy(F.desc("freq")).toLocalIterator():
        total += r["count"]
        if total > most:
            return r["freq"] + 1
    return least


def worth(groups: DataFrame, weight: str = "freq") -> DataFrame:
    """groups with the count of their link and whether it is its b's best."""
    last = lambda side: F.element_at(F.split(F.element_at(F.split("g", "\\|"), side), ","), -1).cast("long")
    return groups.withColumns({"a": last(1), "b": last(2)}).join(links(groups, weight), ["a", "b"]).select("g", "freq", "docs", "count", "best")


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, weight: str = "freq", head: int = HEAD) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each document.

    Null and empty texts, and those whose joined tokens of either side aren't the text behind a space, have zeros and no digest
    (an empty string). Texts of any length are aligned whole. Repeated rows and null ids are documents of their own; links that
    count equally are all best; columns besides doc_id and text don't matter; without documents there are no rows.
    """
    counts = written(counted(docs, a_path, b_path), "alignments")
    groups = written(dictionary(counts), "groups")
    known = written(worth(groups, weight), "links")
    rows = counts.where("g IS NULL").drop("g", "freq", "docs")
    least = frequent(groups, head)
    met = rows.select("n", F.explode("groups").alias("x")).select("n", "x.g", "x.times")
    value = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")]
    common = F.broadcast(known.where(F.col("freq") >= least).select("g", "count", "best"))
    if least:
        rare = known.where(F.col("freq") < least).select("g", "count", "best")
        met = met.join(common, "g").unionByName(met.join(common, "g", "left_anti").join(rare, "g"))
    else:
        met = met.join(common, "g")
    sums = met.groupBy("n").agg(*value)
    got = rows.join(sums, "n", "left")
    return got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
