"""Byte-level BPE encoding and decoding by two-tier lookup.

Whole pre-tokens that are in the vocabulary resolve through a minimal perfect hash: two hashes of the bytes, a displacement
by bucket, and one comparison. The others are merged with a heap of pair ranks over linked bytes. What a task has resolved it
remembers, up to a bound; the vocabulary is a fixed file, so it is small enough to send to every task.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable

import pandas as pd
import public_tokenizers
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, with_struct

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens that a task remembers, and the longest of them in bytes.
REMEMBERED, LONGEST = 700_000, 64
_M64 = (1 << 64) - 1
FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash of byte strings by hash and displace: n keys have the slots 0 to n - 1.

    A key's bucket is its hash modulo the number of buckets. The bucket's displacement is mixed into the hashes of its keys
    so that each falls on a slot of its own; large buckets are placed first. A bucket of one key names its slot directly.
    """

    def __init__(self, table: dict[bytes, int], per_bucket: int = 4):
        self.n, self.m = max(1, len(table)), max(1, len(table) // per_bucket)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for key in table:
            h = xxhash.xxh3_64_intdigest(key)
            buckets.setdefault(h % self.m, []).append((h, key))
        self.shift = [0] * self.m
        slots: list[bytes | None] = [None] * self.n
        in_order = sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0]))
        for b, members in in_order:
            if len(members) == 1:
                break
            d = 0
            while len(at := {self._slot(h, d) for h, _ in members}) < len(members) or any(slots[i] is not None for i in at):
                d += 1
            self.shift[b] = d
            for h, key in members:
                slots[self._slot(h, d)] = key
        free = (i for i, k in enumerate(slots) if k is None)
        for b, members in in_order:
            if len(members) == 1:
                i = next(free)
                self.shift[b], slots[i] = -1 - i, members[0][1]
        self.keys = slots
        self.values = [table[k] if k is not None else -1 for k in slots]

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & _M64
        return ((x * 0xD6E8FEB86659FD93 & _M64) >> 24) % self.n

    def get(self, key: bytes) -> int:
        """The key's value, -1 for other byte strings."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.m]
        i = -1 - d if d < 0 else self._slot(h, d)
        return self.values[i] if self.keys[i] == key else -1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merge the leftmost pair of lowest rank, by a heap over a doubly linked list."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    get = ranks.get
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        r, i, size = pop(heap)
        left = parts[i]
        if left is None or (j := after[i]) >= n:
            continue
        right = parts[j]
        if len(left) + len(right) != size or get(both := left + right) != r:
            continue  # one of the two has been merged since
        parts[i], parts[j] = both, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := get(both + parts[k])) is not None:
                push(heap, (q, i, size + len(parts[k])))
        if (h := before[i]) >= 0 and (q := get(parts[h] + both)) is not None:
            push(heap, (q, h, size + len(parts[h])))
    return [ranks[p] for p in parts if p is not None]


class Codec:
    """Encoding to ids and decoding to bytes, by the ranks of a vocabulary file and a pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.whole, self.find = ranks, PerfectHash(ranks), regex.compile(pattern).findall
        self.token = {str(i): t for t, i in ranks.items()}
        self._said: dict[str, str] = {}

    def piece(self, word: str) -> list[int]:
        data = word.encode()
        i = self.whole.get(data)
        return [i] if i >= 0 else merge(data, self.ranks)

    def encode(self, text: str) -> list[int]:
        return [i for w in self.find(text) for i in self.piece(w)]

    def listed(self, text: str) -> str:
        """The ids as decimal numbers joined by commas."""
        said, out = self._said, []
        for w in self.find(text):
            s = said.get(w)
            if s is None:
                s = ",".join(map(str, self.piece(w)))
                if len(w) <= LONGEST:
                    if len(said) >= REMEMBERED:
                        said.clear()
                    said[w] = s
            out.append(s)
        return ",".join(out)

    def decode_listed(self, listed: str) -> bytes:
        return b"".join(map(self.token.__getitem__, listed.split(","))) if listed else b""

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(self.token[str(i)] for i in ids)


#: A worker process serves many tasks; the codec of a vocabulary and pattern is made once in each.
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> Codec:
    path = path or public_tokenizers.path(VOCABULARY)
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(read_ranks(path), pattern)
    return _CODECS[path, pattern]


def with_digests(docs: DataFrame, into: str = "__bpe", text: str = "text", path: str | None = None) -> DataFrame:
    """docs with struct<n_tokens,ids_sha256,decoded_sha256>. A null text counts as an empty one: no ids.

    Texts of any length are encoded whole, so repeated rows agree; of pairs that could be merged with equal rank, the first in
    the text is. Other columns pass through, whatever their names; one named as `into` is replaced. A table without rows gives none.
    """

    def make() -> Callable:
        c = codec(path)

        def one(t: str | None) -> tuple[int, str, str]:
            ids = c.listed(t or "")
            return ids.count(",") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(c.decode_listed(ids)).hexdigest()

        return lambda texts: zip(*map(one, texts), strict=True)

    return with_struct(docs, into, FIELDS, make, text)


def encoded(docs: DataFrame, into: str = "ids", text: str = "text", path: str | None = None) -> DataFrame:
    """docs with the ids themselves, array<int>."""

    def make() -> Callable:
        c = codec(path)
        return lambda texts: [[c.encode(t or "") for t in texts]]

    own = free_name(docs, "encoded ids")
    return with_struct(docs, own, "ids array<int>", make, text).withColumn(into, F.col(f"`{own}`")["ids"]).drop(own)


def decoded(rows: DataFrame, ids: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """rows with the bytes that the ids stand for, as binary; null ids give null."""

    @F.pandas_udf("binary")
    def back(column: pd.Series) -> pd.Series:
        c = codec(path)
        return column.map(lambda x: None if x is None else c.decode(list(x)))

    return rows.withColumn(into, back(F.col(ids)))

