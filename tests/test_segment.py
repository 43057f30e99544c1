import math
import random
import re
from collections import Counter
from itertools import accumulate

from pyspark.sql import functions as F

from lodequery import queries
from lodequery.operators import search
from lodequery.operators import segment as S

HAN = [chr(0x4E00 + i) for i in range(0, 6000, 37)]


def every_cut(run):
    if not run:
        yield []
    for k in range(1, len(run) + 1):
        for rest in every_cut(run[k:]):
            yield [run[:k], *rest]


def test_likeliest_of_all_ways():
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))): rng.randrange(1, 50) for _ in range(25)}
    lattice, total = S.Lattice(words), sum(words.values())

    def weight(way):
        known = [words.get(w, 0.5 if len(w) == 1 else 0) for w in way]
        return sum(math.log(n / total) for n in known) if all(known) else -math.inf

    for _ in range(150):
        run = "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 10)))
        got, best = lattice.cut(run), max(map(weight, every_cut(run)))
        assert "".join(got) == run and math.isclose(weight(got), best)
    assert S.Lattice({}).cut("ab") == ["a", "b"] and len(lattice.cut("abc" * 50_000)) > 0


def test_only_words_that_occur_are_weighed():
    """a place costs the words that end there, however long the longest word of the dictionary is."""

    class Counting(dict):
        looks = 0

        def get(self, *x):
            self.looks += 1
            return super().get(*x)

    lattice = S.Lattice({"ab": 3, "a": 5, "b" + "c" * 60 + "z": 2})
    lattice.weight = Counting(lattice.weight)
    assert lattice.cut("xab" * 200) == ["x", "ab"] * 200 and lattice.weight.looks <= 600  # 60 for each place before
    assert lattice.cut("ab" + "c" * 60 + "z") == ["a", "b" + "c" * 60 + "z"] and lattice.cut("") == []


def test_words_are_learnt_and_searched(spark):
    rng = random.Random(6)
    lexicon = sorted({"".join(rng.sample(HAN, rng.choice([1, 2, 2, 3, 4]))) for _ in range(60)})
    texts = [[rng.choice(lexicon) for _ in range(12)] for _ in range(500)]
    docs = spark.createDataFrame([(i, "".join(t) + "，ok v2 " + "".join(t[:3])) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    words = S.unspaced_words(docs)
    cut = S.segmenter(words)
    got = {r.doc_id: r.t for r in docs.select("doc_id", cut(F.col("text")).alias("t")).collect()}
    spans = lambda parts: set(zip([0, *accumulate(map(len, parts))], accumulate(map(len, parts)), strict=False))
    hit = sum(len(spans(t + ["，ok", "v2"] + t[:3]) & spans(got[i])) for i, t in enumerate(texts))
    assert hit >= 0.85 * sum(len(t) + 5 for t in texts) and got[900] == got[901] == []
    word = max((w for w in lexicon if len(w) == 2), key=lambda w: sum(w in t for t in got.values()))
    asked = spark.createDataFrame([(1, word)], "query_id long, text string")
    found = {r.chunk_id for r in search.keyword_index(docs, False, segment=cut).search(asked, 500).collect()}
    assert found == {i for i, t in got.items() if word in t} and found
    assert not search.keyword_index(docs, False).search(asked, 500).collect()  # without a segmenter a run is one token


def test_registered_query_like_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    said = {d: [re.findall(S.LETTERS, x) for x in t.lower().split("\n")] for d, t in texts.items()}
    counts = Counter(w for lines in said.values() for x in lines for w in x)
    lattice = S.Lattice({w: n for w, n in counts.items() if n >= 2})
    spans = lambda parts: set(zip([0, *accumulate(map(len, parts))], accumulate(map(len, parts)), strict=False))
    got = {r.doc_id: tuple(r)[1:] for r in queries.segmented_words(spark, sf).collect()}
    assert set(got) == set(texts)
    for d, lines in said.items():
        words, pieces = [w for x in lines for w in x], [w for x in lines for w in lattice.cut("".join(x))]
        assert got[d] == (len(words), len(pieces), len(spans(words) & spans(pieces)))
    assert sum(x[2] for x in got.values()) > 0.5 * sum(x[0] for x in got.values())
