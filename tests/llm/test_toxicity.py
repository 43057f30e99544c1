import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lodequery.llm import toxicity

WORDS = re.compile(r"[^\W\d_]+")


def test_block_max_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    rows = rng.random((300, 40)) * (rng.random((300, 40)) < 0.1)
    rows[:, -1] = rng.random(300)
    rows[50:60] = rows[50]
    rows /= np.sqrt((rows**2).sum(axis=1))[:, None]
    index = toxicity.BlockMax(rows)
    for _ in range(200):
        q = rows[rng.integers(300)] + 0.2 * rng.random(40) * (rng.random(40) < 0.2)
        q /= np.sqrt((q**2).sum())
        at = np.flatnonzero(q)
        got_at, got = index.search(at, q[at], 10)
        scan = np.round(rows[index.order] @ q, 12)
        want = np.lexsort((np.arange(300), -scan))[:10]
        assert np.allclose(got, scan[want], atol=1e-11) and (got_at == index.order[want]).all()
    assert index.visited < 200 * index.blocks  # and it doesn't visit all
    assert not len(toxicity.BlockMax(np.zeros((0, 3))).search(np.array([0]), np.array([1.0]), 5)[0])


def brute(docs, labels):
    """doc_id -> score by the definition: all examples scanned. Every label in the sample, texts one for each id."""
    texts = dict(docs)
    teach = {d: x for d, x in labels if zlib.crc32(str(d).encode()) % 4 != 2 and d in texts}
    said = {d: WORDS.findall((t or "").lower()) for d, t in texts.items()}

    def terms_of(words):
        return Counter(t for w in words for t in [f" {w} "] * (len(w) <= 40) + [f" {w[:k]}" for k in (3, 4, 5) if len(w) >= k])

    n = Counter(teach.values())
    df = {x: Counter(t for d, y in teach.items() if y == x for t in terms_of(said[d])) for x in (0, 1)}
    total = n[0] + n[1]
    g2 = {}
    for t in df[1]:
        a, b = df[1][t], df[0][t]
        cells = [(a, (a + b) * n[1] / total), (b, (a + b) * n[0] / total), (n[1] - a, (total - a - b) * n[1] / total), (n[0] - b, (total - a - b) * n[0] / total)]
        if a * n[0] > b * n[1]:
            g2[t] = sum(2 * o * math.log(o / e) for o, e in cells if o)
    terms = sorted((t for t in g2 if g2[t] >= 20), key=lambda t: (-round(g2[t], 6), t))[: toxicity.TERMS]
    idf = {t: math.log((total + 1) / (df[0][t] + df[1][t] + 1)) + 1 for t in terms}

    def vector(words):
        counts = terms_of(words)
        v = {t: (1 + math.log(counts[t])) * idf[t] for t in terms if counts[t]}
        v["all"] = 1 + math.log(max(1, len(words)))
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    entries = {}
    for d, x in teach.items():
        v = vector(said[d])
        entries.setdefault(tuple(sorted((t, round(w, 12)) for t, w in v.items())), [v, [0, 0]])[1][x] += 1
    out = {}
    for d in texts:
        q = vector(said[d])
        near = sorted(((round(sum(w * v.get(t, 0.0) for t, w in q.items()), 12), mass) for v, mass in entries.values()), key=lambda x: -x[0])
        cut = near[toxicity.NEAREST - 1 : toxicity.NEAREST + 1]
        votes = [0.0, 0.0]
        for c, mass in near[: toxicity.NEAREST]:
            for x in (0, 1):
                votes[x] += mass[x] / (1 - min(c, 1) + toxicity.NEAR) ** 2
        out[d] = (votes[1] / sum(votes), len(cut) == 2 and abs(cut[0][0] - cut[1][0]) < 1e-9)  # a tie at the end leaves the choice open
    return out


def test_registered_query_like_brute_force(spark):
    from lodequery.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()]
    want = brute(docs, labels)
    got = queries.op11_toxicity(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        score, tied = want[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3) and (tied or math.isclose(r.score, score, abs_tol=1e-6))


def test_held_out_documents(spark):
    from lodequery.llm import queries

    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(truth[r.doc_id], r.predicted) for r in queries.op11_toxicity(spark, sf).where("held_out").collect() if r.doc_id in truth]
    caught = [p for x, p in held if x]
    clean = [p for x, p in held if not x]
    assert sum(caught) >= 0.92 * len(caught) and sum(clean) <= 0.005 * len(clean)


def test_odd_rows(spark):
    rng = random.Random(2)
    words = ["tal", "vorn", "misk", "lemod", "harn"]
    text = lambda bad: " ".join(["grobble" if bad and i % 9 == 0 else rng.choice(words) for i in range(60)])
    rows = [(i, text(i % 5 == 0), "x", 1.5) for i in range(200)] + [(500, None, "x", 0.0), (501, "", "x", 0.0), (None, text(True), "x", 0.0), (502, "vorn " * 50_000, "x", 0.0)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, score string, `to xic` double")
    labels = spark.createDataFrame([(i, int(i % 5 == 0), "x") for i in range(200)] + [(0, 0, "x"), (None, 1, "x"), (3, None, "x"), (9999, 1, "x")], "doc_id long, toxic int, text string")
    model = toxicity.fit(docs, labels)
    got = toxicity.with_toxicity(docs, model).collect()
    assert len(got) == len(rows) + 3 and got[0].__fields__ == ["doc_id", "text", "score", "to xic", "__toxicity"]
    by = {r.doc_id: r["__toxicity"] for r in got}
    assert all(by[i].predicted == (i % 5 == 0) for i in range(200)) and by[None].predicted == 1
    assert by[500] == by[501] and by[500].predicted == by[502].predicted == 0
    assert by[5].evidence and all(e.toxic == 1 for e in by[5].evidence)
    nothing = toxicity.with_toxicity(docs, toxicity.fit(docs, labels.limit(0))).collect()
    assert {(r["__toxicity"].score, r["__toxicity"].predicted) for r in nothing} == {(0.0, 0)}
    assert toxicity.with_toxicity(docs.limit(0), model).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, f"word{i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    sample, totals = toxicity.examples(docs, labels, per_label=20)
    taken = Counter(r.toxic for r in sample.collect())
    assert taken == {0: 20, 1: 20} and sum(totals.values()) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(400))
