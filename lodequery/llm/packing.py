"""Best-fit packing planned over a histogram of lengths.

Documents become pieces of at most SIZE tokens. What the plan needs of them is how many pieces have each length: at most
SIZE counts. Best-fit decreasing runs over these counts, moving ranges of sequences with equal room at once, and yields
slots: for pieces of one length, ranks lo to hi go to consecutive sequences, `per` to each. Then every piece takes its
slot by its rank within its length. Ranks come from hash groups of bounded size and the groups' running counts, so that a
length shared by most pieces is no hot spot.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import slices, small, written

VOCABULARY, END_ID, SIZE = "byte_bpe_50k.json", 2, 1024
#: Pieces that are ranked together, about.
GROUP = 2_000
#: Rows up to which the running counts of groups (one row for GROUP pieces) are broadcast.
BROADCAST_ROWS = 500_000
#: Below this code point both tokenizer libraries split texts alike (a test compares them on every such character).
SAME_BELOW = "ɐ"


class Ids:
    """The ids of a text by the vocabulary in a tokenizers file.

    If its merges are at hand as ranks, texts of ordinary Latin characters take the faster library for the same
    vocabulary, which gives the same ids (tests hold the two against each other on generated texts). Other texts, those that
    hold the string of a special token, and other vocabularies are encoded by the file itself, special tokens and all.
    """

    def __init__(self, path: str, ranks_path: str | None):
        import tokenizers

        self.slow = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(ranks_path), special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if not text:
            return []
        if self.fast and max(text) < SAME_BELOW and not any(x in text for x in self.special):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


_IDS: dict[str, Ids] = {}


def ids_of(path: str | None = None) -> Ids:
    path = path or public_tokenizers.path(VOCABULARY)
    if path not in _IDS:
        own = path == public_tokenizers.path(VOCABULARY)
        _IDS[path] = Ids(path, public_tokenizers.path(VOCABULARY.replace(".json", ".tiktoken")) if own else None)
    return _IDS[path]


def cuts(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens: only the first may be shorter than size."""
    first = n if n <= size else n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size) if n > size]


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    A null or empty text is one piece with the end id alone. A null doc_id stays null; repeated rows are documents of
    their own.
    """

    def run(batches):
        encode = ids_of(path)
        for batch in slices(batches, "text"):
            cols: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = array("I", encode(text or ""))
                ids.append(end_id)
                for k, (start, n) in enumerate(cuts(len(ids), size)):
                    part = ids[start : start + n]
                    for c, v in zip(cols, (doc, k, start, n, zlib.crc32(part.tobytes()), part), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()) + (pa.list_(pa.int64()),) * with_ids
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(c if n != "ids" else [list(x) for x in c], type=t) for c, t, n in zip(cols, kinds, names, strict=False)], names=names)

    assert array("I").itemsize == 4 and np.little_endian
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Slots (length, lo, hi, sequence, per, offset) and the number of sequences, by best-fit decreasing over counts.

    The piece of rank r, lo <= r < hi, goes to sequence + (r - lo) // per, at offset + (r - lo) % per * length. A range of
    sequences is halved in room at least each time it is visited, so that there are at most about 30 * size slots.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)
    slots, made = [], 0
    for length in range(size, 0, -1):
        n, rank = counts.get(length, 0), 0

        def place(first: int, bins: int, left: int, per: int, length: int = length) -> None:
            nonlocal rank
            slots.append((length, rank, rank + bins * per, first, per, size - left))
            rank += bins * per
            if left - per * length:
                room[left - per * length].append((first, bins))

        for left in sorted(r for r in room if r >= length):
            ranges, room[left], per = room[left], [], left // length
            for first, bins in ranges:
                full = min(bins, (n - rank) // per)
                if full:
                    place(first, full, left, per)
                part = min(n - rank, per) if full < bins and n > rank else 0
                if part:
                    place(first + full, 1, left, part)
                if bins - full - bool(part):
                    room[left].append((first + full + bool(part), bins - full - bool(part)))
            if not room[left]:
                del room[left]
            if rank == n:
                break
        per = size // length
        for bins, each in (((n - rank) // per, per), (1, (n - rank) % per)):
            if bins and each:
                place(made, bins, size, each)
                made += bins
        assert rank == n
    return slots, made


def placed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut (pieces, written) with sequence_id and offset; the pieces of a sequence follow each other without gaps from 0."""
    spark = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    slots, _ = plan(counts, size)
    if not counts:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    parts = spark.createDataFrame([(n, -(-c // GROUP)) for n, c in counts.items()], "length long, parts long")
    by = ["length", "part"]
    keyed = cut.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "piece"), "parts")).drop("parts")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    groups = keyed.groupBy(*by).count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = ["doc_id", "piece", *(c for c in ("start", "ids_crc32") if c in cut.columns)]
    ranked = keyed.withColumn("local", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).join(small(written(groups, "groups"), BROADCAST_ROWS), by)
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local"))
    table = spark.createDataFrame(slots, "of long, lo long, hi long, sequence long, per long, at long")
    put = ranked.join(F.broadcast(table), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    nth = F.col("rank") - F.col("lo")
    return put.select(*(F.col(c) for c in cut.columns), (F.col("sequence") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("per") * F.col("length")).cast("long").alias("offset"))


def packed(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """A row for each piece with its place. The pieces are written once; counting and placing read them."""
    return placed(written(pieces(docs, path, size), "pieces"), size)


def sequences(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """The packed sequences themselves: sequence_id and at most `size` ids."""
    put = placed(written(pieces(docs, path, size, with_ids=True), "pieces"), size)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return put.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
