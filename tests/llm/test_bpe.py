import hashlib
import random

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequery.llm import bpe

CODEC = bpe.codec()
WANT = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text())
def test_like_the_library(text):
    ids = CODEC.encode(text)
    assert ids == WANT.encode_ordinary(text) and CODEC.decode(ids) == text.encode()
    assert CODEC.listed(text) == ",".join(map(str, ids)) and CODEC.decode_listed(CODEC.listed(text)) == text.encode()


def test_perfect_hash_is_minimal():
    h = CODEC.whole
    assert h.n == len(CODEC.ranks) and sorted(h.values) == sorted(CODEC.ranks.values())
    assert all(h.get(t) == r for t, r in CODEC.ranks.items())
    rng = random.Random(1)
    others = {bytes(rng.randrange(256) for _ in range(7)) for _ in range(2000)} - CODEC.ranks.keys()
    assert all(h.get(o) == -1 for o in others) and bpe.PerfectHash({}).get(b"x") == -1


def test_table(spark):
    texts = [None, "", "hello  world", "é𝄞\x85日本", "a" * 50_000, " " * 50_000, "don't <|endoftext|> 12345"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    for r in bpe.with_digests(docs).collect():
        t, ids = texts[r.doc_id] or "", WANT.encode_ordinary(texts[r.doc_id] or "")
        assert tuple(r["__bpe"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decoded(bpe.encoded(docs)).collect()
    assert [bytes(r.decoded).decode() for r in sorted(back)] == [t or "" for t in texts]
    assert bpe.with_digests(docs.limit(0)).count() == 0


def test_repeated_rows_agree(spark):
    docs = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], "doc_id long, text string")
    got = [tuple(r["__bpe"]) for r in bpe.with_digests(docs).collect()]
    assert len(got) == 3 and len(set(got)) == 1
