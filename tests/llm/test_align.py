from collections import Counter
from hashlib import sha256

import public_tokenizers
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from lodequery.llm import align

LIB_A = tokenizers.Tokenizer.from_file(public_tokenizers.path(align.A))
LIB_A.encode_special_tokens = True
LIB_B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(align.B))
LETTERS = align.byte_letters()
OWN = align.aligner()
LATIN = st.text(st.one_of(st.characters(max_codepoint=0x24F, exclude_characters="\r"), st.sampled_from(" \n\t' aeñ1.,\xa0")))


def ends_of(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


def plain(text):
    """Ids and groups by the definition: offsets at which both end."""
    if not text:
        return [], [], []
    a, b = LIB_A.encode(" " + text, add_special_tokens=False).ids, LIB_B.encode(text)
    of_a = [bytes(LETTERS[c] for c in LIB_A.id_to_token(i)) for i in a]
    of_b = [align.piece_bytes(LIB_B.id_to_piece(i)) for i in b]
    if not b"".join(of_a) == b"".join(of_b) == (" " + text).encode():
        return [], [], []
    ends_a, ends_b = ends_of(of_a), ends_of(of_b)
    groups, low = [], 0
    for end in sorted(set(ends_a) & set(ends_b)):
        groups.append(([i for i, e in zip(a, ends_a) if low < e <= end], [i for i, e in zip(b, ends_b) if low < e <= end]))
        low = end
    return a, b, groups


def said(groups):
    return [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups]


def plain_rows(texts):
    made = [plain(t) for t in texts]
    count = Counter((a[-1], b[-1]) for _, _, groups in made for a, b in groups)
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for a, b, groups in made:
        linked = [count[x[-1], y[-1]] for x, y in groups]
        best = sum(count[x[-1], y[-1]] == most[y[-1]] for x, y in groups)
        out.append((len(a), len(b), len(groups), len(groups), best, sum(linked), sha256(";".join(said(groups)).encode()).hexdigest() if groups else ""))
    return out


TEXTS = [
    None, "", " ", "a", "hello  world", "Is and retitioning\nouen the of, nterti\n\n  thorreou ndernt. ", "don't <|endoftext|> </s> <0x0A> <unk>", "é𝄞\x85日本 text", "a▁b", "x\r\ny\r\n\n z",
    "\n", " \n \t x", "a" * 3000, " " * 500, "Über straße\xa0naïve", "hello  world", "tab\tin", "1234 5678.90", "\x00\x1f", "ends with blanks   ", "the the the the",
]


@settings(max_examples=400, deadline=None)
@given(st.one_of(LATIN, st.text()))
def test_groups_like_the_libraries(text):
    a, b, groups = plain(text)
    assert OWN([text, "so", None]) == [(len(a), len(b), ";".join(said(groups))), OWN(["so"])[0], (0, 0, "")]


def test_table(spark):
    rows = [(i if i else None, t, "x", "y") for i, t in enumerate(TEXTS)] + [(3, "a", "x", "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, g string, `n a` string")
    want = sorted((r[0] or -1, *w) for r, w in zip(rows, plain_rows([r[1] for r in rows]), strict=True))
    assert sorted((r[0] or -1, *r[1:]) for r in align.aligned(docs).collect()) == want
    assert sorted((r[0] or -1, *r[1:]) for r in align.aligned(docs, head=5).collect()) == want
    assert align.aligned(docs.limit(0)).count() == 0


def test_registered_query(spark):
    from lodequery.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = {d.doc_id: w for d, w in zip(docs, plain_rows([d.text for d in docs]), strict=True)}
    got = queries.op13_cross_tokenizer(spark, sf).collect()
    assert len(got) == len(docs) and {r.doc_id: tuple(r)[1:] for r in got} == want


def test_documents_as_weight(spark):
    docs = spark.createDataFrame([(1, "the the the"), (2, "the cat")], "doc_id long, text string")
    groups = align.dictionary(align.counted(docs))
    (g,) = said(plain("the")[2])
    assert groups.where(f"g = '{g}'").select("freq", "docs").collect() == [(4, 2)]
    a, b = map(int, g.split("|"))
    assert align.links(groups, "docs").where(f"a = {a} AND b = {b}").collect()[0]["count"] == 2
