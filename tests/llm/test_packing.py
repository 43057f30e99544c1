import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequery.llm import packing


def encoder():
    import tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    return lambda x: t.encode(x, add_special_tokens=False).ids


SLOW = encoder()


def test_both_libraries_split_alike():
    slow, fast = encoder(), packing.ids_of()
    for c in map(chr, range(ord(packing.SAME_BELOW))):
        for text in (f"a{c}b", f"{c}{c} 1{c}2", f" {c} {c}\n{c}a", c, f"x {c}", f"'{c}'s {c}ll"):
            assert fast(text) == slow(text), hex(ord(c))


def test_special_tokens_as_the_file_says():
    assert packing.ids_of()("a<|endoftext|>b") == encoder()("a<|endoftext|>b") == [64, 50256, 65]


LATIN = st.characters(max_codepoint=ord(packing.SAME_BELOW) - 1)
PARTS = st.one_of(
    st.text(LATIN, max_size=12), st.text(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0", max_size=6), st.text("0123456789²³¼", max_size=6), st.text("aàßÿĀž'", max_size=8),
    st.sampled_from(["'s", "'LL", "'re", "'t", " 've", "<|endoftext|>", "<|endoftext", "<|", "don't", " \n ", "  x", "ﬁ", "日本", "\u0301", "𝄞"]),
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_ids_are_the_files_on_generated_texts(text):
    assert packing.ids_of()(text) == SLOW(text)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 24), st.integers(1, 30), max_size=12))
def test_plan_is_best_fit_decreasing(counts):
    slots, made = packing.plan(counts, 24)
    rooms = []  # plain best-fit decreasing, a piece at a time
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((24 if fit is None else fit) - n)
    assert made == len(rooms)
    used = {}
    for length, lo, hi, seq, per, at in slots:
        for r in range(hi - lo):
            used.setdefault(seq + r // per, []).append((at + r % per * length, length))
    assert sorted((s[2] - s[1]) for s in slots) and sum(s[2] - s[1] for s in slots) == sum(counts.values()) if counts else not slots
    for places in used.values():
        end = 0
        for at, n in sorted(places):
            assert at == end
            end += n
        assert end <= 24


@pytest.mark.parametrize("n,want", [(1, [(0, 1)]), (4, [(0, 4)]), (5, [(0, 1), (1, 4)]), (8, [(0, 4), (4, 4)]), (10, [(0, 2), (2, 4), (6, 4)])])
def test_cuts(n, want):
    assert packing.cuts(n, 4) == want


def test_against_plain_tokens(spark):
    texts = {0: None, 1: "", 2: "hello world", 3: "The and of " * 900, 4: "日本語 𝄞 é", 5: "x" * 30_000, 6: "hello world", 7: " " * 5000, 8: "é <|endoftext|> é", 9: "日<|endoftext|>"}
    docs = spark.createDataFrame([*((i, t, 7) for i, t in texts.items()), (None, "no id", 7), (2, "hello world", 7)], "doc_id long, text string, piece int")
    rows = packing.packed(docs).collect()
    slow = encoder()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc[2]) == 2 and len(by_doc[None]) == 1
    for i, t in texts.items():
        if i == 2:
            continue
        ids, at = [*(slow(t) if t else []), 2], 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        end = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i * 40)) for i in range(12)], "doc_id long, text string")
    got = sorted(i for r in packing.sequences(docs).collect() for i in r.ids)
    assert got == sorted(i for r in docs.collect() for i in [*packing.ids_of()(r.text), 2]) and sys.byteorder == "little"
    assert packing.packed(docs.limit(0)).count() == 0


def test_hot_length_is_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 7)
    docs = spark.createDataFrame([(i, "same text") for i in range(100)], "doc_id long, text string")
    rows = packing.packed(docs, size=8).collect()
    assert len(rows) == 100 and len({(r.sequence_id, r.offset) for r in rows}) == 100 and len({r.sequence_id for r in rows}) == -(-100 // (8 // rows[0].length))
