import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodequery.llm import hmm, queries


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def learned(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 != 1


def corpus():
    rng = random.Random(5)
    topics = [[f"{c}{i}" for i in range(30)] for c in "ab"]
    rows = []
    for i in range(240):
        topic = topics[i % 2]
        rows.append((i, " ".join(rng.choice(topic[: rng.randrange(1, 30)]).upper() for _ in range(rng.randrange(1, 60))), 1.0))
    rows += [(1000, None, 1.0), (1001, "", None), (1002, "never seen Ünknown wörds a1", 1.0), (None, "a1 a2", 1.0), (1003, "a1 " * 20_000, 1.0), (7, "a1 again", 1.0)]
    return rows


def test_base_score_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hmm, "HEAD", 20)
    monkeypatch.setattr(hmm, "TOP", 8)
    monkeypatch.setattr(hmm, "BATCH_BYTES", 3000)
    rows = corpus()
    counts = Counter(t for i, x, _ in rows if learned(i) for t in [*words_of(x), "\n"])
    n, v = sum(counts.values()), len(counts)
    got = hmm.scores(spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)).collect()
    assert len(got) == len(rows)
    texts = {(i, len(words_of(x)) + 1): x for i, x, _ in rows}
    for r in got:
        want = [*words_of(texts[r.doc_id, r.n_tokens]), "\n"]
        assert r.train_tokens == n and r.n_known == sum(counts[t] > 0 for t in want)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in want), rel_tol=1e-9)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 240 and not learned(r.doc_id)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_word_probabilities_add_up(spark, monkeypatch):
    """Within a class and state, the words that training holds and one word for all others exhaust the class."""
    monkeypatch.setattr(hmm, "HEAD", 20)
    monkeypatch.setattr(hmm, "TOP", 8)
    monkeypatch.setattr(hmm, "BATCH_BYTES", 3000)
    docs = spark.createDataFrame([r for r in corpus() if learned(r[0])], "doc_id long, text string, x double").select("doc_id", "text")
    texts = hmm.encoded(docs.withColumn("learn", F.lit(True))).cache()
    lex = hmm.Lexicon(hmm.word_counts(texts).cache())
    assert 0 < lex.top <= 8 < len(lex.words) <= 20
    model, in_class, middle, outer = hmm.train(texts, lex)
    words = {(r.batch, k): w for r in texts.select("batch", "words").collect() for k, w in enumerate(hmm.listed(r.words).to_pylist())}
    assert len({b for b, _ in words}) > 1
    found = {words[r.batch, r["at"]]: (r.n, hmm.unpacked_shares(np.array([r.low]), np.array([r.high]))[:, 0]) for r in outer.collect()}
    total, size = np.zeros((hmm.STATES, hmm.CLASSES)), lex.class_size()
    for k, p in zip(lex.middle_class, hmm.outer_probability(lex.middle_n, middle, in_class[:, lex.middle_class], size[lex.middle_class]).T, strict=True):
        total[:, k] += p
    for w, (n, share) in found.items():
        k = hmm.class_of(w)
        total[:, k] += hmm.outer_probability(np.array([n]), (n * share)[:, None], in_class[:, [k]], size[[k]])[:, 0]
    none = hmm.outer_probability(np.zeros(hmm.CLASSES), np.zeros((hmm.STATES, hmm.CLASSES)), in_class, size)
    assert np.allclose((total + none)[:, lex.class_v > 0], 1, atol=1e-3)
    assert np.allclose(model.say.sum(axis=1), 1)
    want = Counter(w for i, x, _ in corpus() if learned(i) for w in words_of(x))
    assert {w: n for w, (n, _) in found.items()} == {w: n for w, n in want.items() if n < lex.least}


def test_class_expression(spark):
    some = ["a", "ab", "über", "wörter", "日本語", "x" * 20, "𝒳𝒴𝒵", "-", "ends-here"]
    got = spark.createDataFrame([(w,) for w in some], "word string").select(hmm._class_column(F.col("word"))).collect()
    assert [r[0] for r in got] == [hmm.class_of(w) for w in some]


def test_forward_and_counts_against_enumeration():
    rng = np.random.default_rng(2)
    m = hmm.Hmm(*(x / x.sum(axis=-1, keepdims=True) for x in (rng.random(3), rng.random((3, 3)), rng.random((3, 4)))))
    sequences = [rng.integers(0, 4, n).astype(np.int32) for n in (5, 1, 4, 5, 2)]
    want, start, move, say = [], np.zeros(3), np.zeros((3, 3)), np.zeros((3, 4))
    for s in sequences:
        total, parts = 0.0, []
        for path in np.ndindex(*(3,) * len(s)):
            p = m.start[path[0]] * m.say[path[0], s[0]]
            for a, b, x in zip(path, path[1:], s[1:], strict=False):
                p *= m.move[a, b] * m.say[b, x]
            total += p
            parts.append((path, p))
        want.append(math.log10(total))
        for path, p in parts:
            start[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                move[a, b] += p / total
            for a, x in zip(path, s, strict=True):
                say[a, x] += p / total
    assert np.allclose(m.log10(sequences), want)
    for got, exact in zip(m.expected(sequences), (start, move, say), strict=True):
        assert np.allclose(got, exact)
    assert len(m.log10([])) == 0


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(4)
    data = [np.concatenate([rng.integers(0, 5, 20), rng.integers(5, 10, 20)]).astype(np.int32) for _ in range(60)]
    m, last = hmm.Hmm.any(10), -math.inf
    for _ in range(6):
        m = hmm.Hmm.from_counts(*m.expected(data))
        now = m.log10(data).sum()
        assert now > last - 1
        last = now


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(i, "some words", 0) for i in range(40) if not learned(i)], "doc_id long, text string, x int")
    for r in hmm.scores(docs).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.base_score == 0
    assert hmm.scores(docs.limit(0)).count() == 0


def naive(m, x):
    """Likelihood and expected counts of one sequence by the unscaled recursions over nested lists."""
    s, n = len(m.start), len(x)
    alpha, beta = [[0.0] * s for _ in x], [[1.0] * s for _ in x]
    for t in range(n):
        for z in range(s):
            came = m.start[z] if t == 0 else sum(alpha[t - 1][y] * m.move[y, z] for y in range(s))
            alpha[t][z] = came * m.say[z, x[t]]
    for t in range(n - 2, -1, -1):
        for z in range(s):
            beta[t][z] = sum(m.move[z, y] * m.say[y, x[t + 1]] * beta[t + 1][y] for y in range(s))
    whole = sum(alpha[-1])
    gamma = np.array([[alpha[t][z] * beta[t][z] / whole for z in range(s)] for t in range(n)])
    pairs = np.zeros((s, s))
    for t in range(1, n):
        for y in range(s):
            for z in range(s):
                pairs[y, z] += alpha[t - 1][y] * m.move[y, z] * m.say[z, x[t]] * beta[t][z] / whole
    return math.log10(whole), gamma, pairs


def test_query_against_brute_force(spark, monkeypatch, tmp_path):
    """The registered query's scores are those of a plain Baum-Welch over all training texts with every word's own counts."""
    monkeypatch.setattr(hmm, "HEAD", 24)
    monkeypatch.setattr(hmm, "TOP", 12)
    monkeypatch.setattr(hmm, "STARTERS", 10)
    monkeypatch.setattr(hmm, "BATCH_BYTES", 500)
    rng = random.Random(9)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(0, 25)))) for i in range(90)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op10_hmm"](spark, str(tmp_path)).collect()}
    train = {i: words_of(x) for i, x in rows if learned(i)}
    counts = Counter(w for x in train.values() for w in x)
    order = sorted((w for w, n in counts.items() if n > 1), key=lambda w: (-counts[w], w))
    while len(order) > 12:  # words with equal counts go together
        order = [w for w in order if counts[w] > counts[order[-1]]]
    at, end = {w: k for k, w in enumerate(order)}, len(order) + hmm.CLASSES
    code = lambda x: [at.get(w, len(order) + hmm.class_of(w)) for w in x] + [end]
    n = np.zeros(end + 1)
    pairs = np.zeros((min(10, len(order)),) * 2)
    for x in train.values():
        for a in code(x):
            n[a] += 1
        for a, b in zip(code(x), code(x)[1:], strict=False):
            if a < len(pairs) and b < len(pairs):
                pairs[a, b] += 1
    m = hmm.Hmm.first(n, pairs)
    for _ in range(hmm.ITERATIONS):
        start, move, say, own = np.zeros(hmm.STATES), np.zeros((hmm.STATES,) * 2), np.zeros((hmm.STATES, end + 1)), {}
        for x in train.values():
            _, gamma, more = naive(m, code(x))
            start, move = start + gamma[0], move + more
            for k, w, g in zip(code(x), [*x, None], gamma, strict=True):
                say[:, k] += g
                own[w] = own.get(w, 0) + g
        m = hmm.Hmm.from_counts(start, move, say)
    cls_n, cls_v = Counter(), Counter()
    for w, c in counts.items():
        if w not in at:
            cls_n[hmm.class_of(w)] += c
            cls_v[hmm.class_of(w)] += 1
    for i, x in rows:
        y, extra = [], []
        for w, k in zip([*words_of(x), None], code(words_of(x)), strict=True):
            if len(order) <= k < end:
                c = k - len(order)
                large = (counts[w] + 0.5) / (cls_n[c] + 0.5 * (cls_v[c] + 1))
                used = [say[z][k] > 0.01 * say[:, k].sum() for z in range(hmm.STATES)]
                state = [(own[w][z] / say[z][k] if w in own else 0.0) if used[z] else large for z in range(hmm.STATES)]
                extra.append(m.say[:, k] * (0.5 * np.array(state) + 0.5 * large))
                k = end + len(extra)
            y.append(k)
        want = naive(m.with_words(np.array(extra).reshape(-1, hmm.STATES).T), y)[0]
        assert math.isclose(got[i].score, want, rel_tol=1e-3), (i, got[i].score, want)
    assert len(got) == 90


def test_blocks_change_nothing(monkeypatch):
    """Forward probabilities kept at block borders only give the same counts, however long a sequence is."""
    rng = np.random.default_rng(8)
    m = hmm.Hmm.any(30)
    data = [rng.integers(0, 30, n).astype(np.int32) for n in (700, 3, 90, 1, 250, 250)]
    whole = m.expected(data, np.float64)
    for room in (1, 7, 100, 1293):
        monkeypatch.setattr(hmm, "ROOM", room)
        for a, b in zip(m.expected(data, np.float64), whole, strict=True):
            assert np.allclose(a, b)
    monkeypatch.setattr(hmm, "ROOM", 600)
    for a, b in zip(m.expected(data), whole, strict=True):
        assert np.allclose(a, b, rtol=1e-4, atol=1e-4)
