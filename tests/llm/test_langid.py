import math
import random
import re
import zlib
from collections import Counter, defaultdict

from lodequery.llm import langid, queries

EN = "the and that with from there which would about other were their what some".split()
DE = "und nicht aber auch schon über wird eine keine werden zwischen können müssen".split()


def corpus(spark):
    rows = []
    for i in range(200):
        w = EN if i % 2 else DE
        rows.append((i, " ".join(w[(i + k * k) % len(w)] for k in range(12)), "en" if i % 2 else "de", "s"))
    rows += [(1000, None, "en", "s"), (1001, "12345 ... !!", "de", "s"), (1002, "the and und", None, "s"), (None, "über keine", "de", None), (1003, "", "en", "s"), (1004, "zwischenkönnenkeine", "en", "s"), (1005, "x" * 100_000, "en", "s"), (1006, "²", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")


def test_held_out_accuracy_and_odd_texts(spark):
    docs = corpus(spark)
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.with_language(docs, model).collect()}
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and all(got[i]["__language"].lang_pred == ("en" if i % 2 else "de") for i in held)
    assert [got[i]["__language"].lang_pred for i in (1000, 1001, 1003, 1006)] == ["und"] * 4
    assert got[1004]["__language"].lang_pred == "de" and got[1002].lang_pred == "s"
    assert all(0 <= r["__language"].score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [r["__language"].lang_pred for r in langid.with_language(docs, langid.fit(docs)).collect()] == ["und", "und"]
    none = docs.limit(0)
    assert langid.with_language(none, langid.fit(none)).count() == 0


def test_backoff_takes_longest_known_grams():
    import numpy as np

    m = langid.Model(["a", "b"], {}, np.zeros((0, 2)), {"abcde": 0, "x": 1}, np.array([[0.0, -1.0], [-2.0, 0.0]]))
    assert list(m.unseen("abcdex")) == [0.0, -1.0] and list(m.unseen("zx")) == [-2.0, 0.0] and list(m.unseen("q")) == [0.0, 0.0]


def test_long_words_count_whole(spark, monkeypatch):
    monkeypatch.setattr(langid, "CHUNK", 50)
    model = langid.fit(corpus(spark))
    docs = spark.createDataFrame([(1, "the" * 12 + "".join(DE) * 500 + "the" * 12)], "doc_id long, text string")
    assert langid.with_language(docs, model).first()["__language"].lang_pred == "de"
    assert [g for c in langid.gram_chunks("a" * 60 + "b" * 60, 5) for g in c] == [(" " + "a" * 60 + "b" * 60 + " ")[i : i + 5] for i in range(118)]
    rows = [(i, "qwzpk" * 40, "xx") for i in range(60)] + [(100 + i, "some plain words here", "yy") for i in range(60)]
    learned = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {"qwzpk", "kqwzp"} <= set(learned.gram_rows)


def test_query_against_brute_force(spark, tmp_path):
    """The registered query's predictions are those of plain counts: log frequencies of words, else of the longest known n-grams."""
    rng = random.Random(6)
    letters = {"en": "thernosaiwd", "de": "üßzchtgeunk", "fr": "éàlesqtunoi"}
    word = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randrange(1, 8)))
    known = {x: [word(x) for _ in range(60)] for x in letters}
    rows = []
    for i in range(240):
        x = rng.choice(list(letters))
        rows.append((i, " ".join(rng.choice(known[x]) if rng.random() < 0.6 else word(x).title() for _ in range(rng.randrange(1, 30))) + ". 12", x if i % 11 else None))
    rows += [(500, None, "en"), (501, "123 ²", "de"), (502, "", None), (503, "thedie" * 40, None), (None, "the der", "en"), (505, "日本", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, str(tmp_path)).collect()}
    split = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    words = defaultdict(Counter)
    for i, t, x in rows:
        if i is not None and not held(i) and x is not None and t is not None:
            words[x].update(split(t))
    langs = sorted(words)
    grams, types = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for x in langs:
        for w, n in words[x].items():
            for k in range(1, langid.LONGEST + 1):
                for j in range(len(w) + 2 - k + 1):
                    grams[x][f" {w} "[j : j + k]] += math.log1p(n)
                    types[x][f" {w} "[j : j + k]] += 1

    def table(counts):
        keys = {k for x in langs for k in counts[x]}
        return {k: [math.log((counts[x].get(k, 0) + 0.5) / (sum(counts[x].values()) + 0.5 * (len(keys) + 1))) for x in langs] for k in keys}

    by_word = table({x: {w: n for w, n in words[x].items() if n >= langid.MIN_WORD} for x in langs})
    by_gram = table({x: {g: n for g, n in grams[x].items() if types[x][g] >= langid.MIN_GRAM} for x in langs})
    for i, t, _ in rows:
        total = [0.0] * len(langs)
        for w in split(t):
            row = by_word.get(w)
            for k in range(langid.LONGEST, 0, -1):
                if row is None and (found := [by_gram[g] for j in range(len(w) + 2 - k + 1) if (g := f" {w} "[j : j + k]) in by_gram]):
                    row = [sum(c) / len(found) for c in zip(*found, strict=True)]
            total = [a + b for a, b in zip(total, row or [0.0] * len(langs), strict=True)]
        best = max(range(len(langs)), key=lambda k: (round(total[k], 6), -k))
        r = got[i]
        assert r.held_out == held(i) or i is None
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            score = 1 / sum(math.exp(x - total[best]) for x in total)
            assert r.lang_pred == langs[best] and abs(r.score - score) < 1e-4, (i, r, total)


def test_repeated_rows_agree(spark):
    docs = corpus(spark)
    model = langid.fit(docs)
    twice = langid.with_language(docs.union(docs).select("doc_id", "text"), model, "a.b").collect()
    by = defaultdict(set)
    for r in twice:
        by[r.text].add(tuple(r["a.b"]))
    assert len(twice) == 2 * docs.count() and all(len(x) == 1 for x in by.values())
