import random
import re
import time

import numpy as np
import pytest

from lodequery.llm import components, minhash


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def plain(rows):
    sets = [plain_set(t) for _, t, *_ in rows]
    ids = [r[0] for r in rows]
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(ids[i]), find(ids[j])))
                parent[b] = a
    return {i: (len(s), find(i), find(i) == i) for i, s in zip(ids, sets, strict=True)}


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for group in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([6, 30, 120, 400]))]
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5, 12])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
            rows.append((len(rows), rng.choice([text, text.upper(), text.replace(" ", " \t\n", 3)]), group))
    base = [rng.choice(vocabulary) for _ in range(150)]  # a large group whose members lie around the threshold
    for _ in range(120):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((len(rows), " ".join(words), 99))
    for odd in (None, "", "  \n", "one two", "ONE  two", "one two three four", "one two three four five", "É one two three four five", "é one two three four five", "x y a b c d", "long " * 20_000, "long " * 19_000):
        rows.append((len(rows), odd, 7))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rounds", [0, 2])
def test_against_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", max(1, rounds))
    rows = corpus()
    want = plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept long").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == want


def test_one_of_each_keeps_rows_and_columns(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(5, text, "a"), (3, text, "b"), (None, text, "c"), (3, text, "d"), (None, None, "e"), (9, "", "f"), (9, "", "f"), (None, "other words that stay here alone", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted(r.component for r in minhash.one_of_each(docs).collect())
    assert got in (["b", "e", "f", "f", "g"], ["d", "e", "f", "f", "g"])
    assert minhash.one_of_each(docs.limit(0)).count() == 0 and minhash.near_duplicates(docs.limit(0)).count() == 0
    dups = {(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs.drop("component")).collect()}
    assert (5, 3, False) in dups and (3, 3, True) in dups and (None, 3, False) in dups and (9, 9, True) in dups and (None, None, False) in dups


def test_rows_without_id_link_too(spark):
    """Two texts that are near only to one without an id are connected by it; texts without ids alone have no component's name."""
    words = [f"t{i}" for i in range(200)]
    left, middle, right = words[:], words[:], words[:]
    left[20:24], right[100:104], right[150:153] = ["a"] * 4, ["b"] * 4, ["c"] * 3
    left[60:63] = ["d"] * 3
    other = " ".join(f"o{i}" for i in range(50))
    rows = [(7, " ".join(left)), (None, " ".join(middle)), (4, " ".join(right)), (None, other), (None, other + " x")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    alone = minhash.near_duplicates(spark.createDataFrame([rows[0], rows[2]], "doc_id long, text string")).collect()
    assert {r.component_id for r in alone} == {4, 7}
    assert got == {(7, 196, 4, False), (None, 196, 4, False), (4, 196, 4, True), (None, 46, None, False), (None, 47, None, False)}
    none = minhash.near_duplicates(spark.createDataFrame(rows[3:], "doc_id long, text string")).collect()
    assert [(r.component_id, r.kept) for r in none] == [(None, False)] * 2


@pytest.mark.parametrize("block", [4, 1000])
def test_blocks_of_open_buckets(spark, monkeypatch, block):
    """A family of pages from one template, half of them near others, none connected by a leader: every pair counts."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "LEADER_ROUNDS", 1)
    rng = random.Random(12)
    template = [f"page{i}" for i in range(150)]
    rows = []
    for i in range(60):
        words = template + [f"own{i // 3 if i % 2 else i}-{k}" for k in range(45)]
        words[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(words), 0))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept long")).collect()}
    assert got == plain(rows)


def test_pairs_of_an_open_bucket_stay_in_its_meetings(spark, monkeypatch):
    """60 pages of one template, similar at 0.723, two of them linked: no table of pairs has more rows than there are pages."""
    pairs = []

    def spy(df, what, real=minhash.written):
        out = real(df, what)
        if out.columns == ["a", "b"]:
            pairs.append(out.count())
        return out

    monkeypatch.setattr(minhash, "written", spy)
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rows = [(i, " ".join([f"page{k}" for k in range(150)] + [f"own{i}-{k}" for k in range(28)]), 0) for i in range(60)]
    rows[50] = (50, rows[20][1] + " more", 0)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept long")).collect()}
    assert got == plain(rows) and got[50][1] == 20
    assert max(pairs) <= len(rows)


def test_many_pairs_of_one_document(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SPLIT", 3)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, kept long")).collect()}
    assert got == plain(rows)


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(1)
    common, rows = rng.integers(0, 1 << 63, 3000, np.uint64), []
    for k, share in enumerate((0.0, 0.5, 0.75, 1.0)):  # Jaccard similarity of two sets of 2000
        n = round(4000 * share / (1 + share))
        both = [minhash.pack(minhash.minima(np.concatenate([common[:n], rng.integers(0, 1 << 63, 2000 - n, np.uint64)]))).view(np.int64).tolist() for _ in "ab"]
        rows.append((k, share, *both))
    import pyspark.sql.functions as F

    df = spark.createDataFrame(rows, "k int, share double, x array<long>, y array<long>")
    wide = [(k, share, *(minhash.pack(minhash.minima(np.concatenate([common[: (n := round(4000 * share / (1 + share)))], rng.integers(0, 1 << 63, 2000 - n, np.uint64)]), minhash._WIDE)).view(np.int64).tolist() for _ in "ab")) for k, share in enumerate((0.0, 0.5, 0.75, 1.0))]
    for _, share, x, y in wide:
        assert abs(minhash.similarity(np.array(x, np.int64).view(np.uint64), np.array(y, np.int64).view(np.uint64), minhash.WIDE) - share) < 0.06
    for r in rows:
        assert abs(minhash.similarity(np.array(r[2], np.int64).view(np.uint64), np.array(r[3], np.int64).view(np.uint64), minhash.HASHES) - r[1]) < 0.13
    for s in "xy":
        df = df.withColumn(s, F.struct(*(F.col(s)[i].alias(f"s{i}") for i in range(minhash.PACKED))))
    for r in df.select("share", minhash.estimate("x", "y").alias("e")).collect():
        assert abs(r.e - r.share) < 0.13


def test_components(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (201, 200), (300, 300), (None, 4)] + [(1000, 1000 + i) for i in range(1, 400)]
    got = {r.id: r.component for r in components.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(51), 100]} | {200: 200, 201: 200} | {1000 + i: 1000 for i in range(400)}
    assert components.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jobs_leave_little_with_the_driver(spark, monkeypatch):
    """Rows aren't taken to the driver to be counted, and the shuffles of earlier rounds don't pile up there."""
    from pyspark.sql.classic.dataframe import DataFrame

    def taken(self, num, real=DataFrame.take):
        assert num == 1
        return real(self, num)

    monkeypatch.setattr(DataFrame, "take", taken)
    live = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = live()
    out = minhash.near_duplicates(spark.createDataFrame([r[:2] for r in corpus()[:60]], "doc_id long, text string"))
    for _ in range(20):  # the cleaner works on its own
        if live() - before < 5:
            break
        time.sleep(0.2)
    assert live() - before < 5
    assert out.count() == 60
