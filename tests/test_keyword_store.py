import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodequery.operators import blockmax, search
from lodequery.sources import keyword_store as ks

WORDS = [f"w{i}" for i in range(60)]


def rows(n, seed=0):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(WORDS[: 1 + rng.randrange(60)]) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(n, None), (n + 1, "rare w1 w1"), (n + 2, "same text"), (n + 3, "same text")]


def hits(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def asked(spark):
    texts = ["w1 w2 w3", "w0", "rare", "same", "w59 w58 w57 w57", "nothing known", "", None, "w10 w20 w30 w40 w50 w5 w6 w7"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_many_additions_like_a_fresh_index(spark, tmp_path, asked):
    docs = spark.createDataFrame(rows(150), "doc_id long, text string")
    path = str(tmp_path / "grown")
    for i in range(9):
        assert ks.append(docs.where(F.col("doc_id") % 9 == i), path, batch=f"s:{i}", fan=3)
    now = ks.state(spark, path)
    assert [x for x, _, _ in now.live.values()] == [2] and len(now.batches) == 9  # 9 parts, 3 parts, one part
    grown, fresh = ks.load(spark, path), search.keyword_index(docs, False)
    assert hits(grown.search(asked, 5)) == hits(fresh.search(asked, 5)) and hits(grown.search(asked, 50)) == hits(fresh.search(asked, 50))
    raw = [r[0] for r in fresh.terms.select(F.log(fresh.docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).collect()]
    assert (grown.docs, grown.tokens) == (fresh.docs, fresh.tokens) and math.isclose(grown.mean, sum(raw) / len(raw), abs_tol=1e-9)
    assert ks.vacuum(spark, path) == 12 and hits(ks.load(spark, path).search(asked, 5)) == hits(fresh.search(asked, 5))


def test_a_batch_counts_once_and_an_interrupted_one_again(spark, tmp_path, asked, monkeypatch):
    docs, path = spark.createDataFrame(rows(30), "doc_id long, text string"), str(tmp_path / "i")
    commit = ks._commit

    def lost(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(ks, "_commit", lost)
    with pytest.raises(RuntimeError):
        ks.append(docs, path, batch="s:0")
    monkeypatch.setattr(ks, "_commit", commit)
    assert ks.state(spark, path) is None and ks.append(docs, path, batch="s:0")
    first = hits(ks.load(spark, path).search(asked, 5))
    assert not ks.append(docs, path, batch="s:0") and hits(ks.load(spark, path).search(asked, 5)) == first == hits(search.bm25(asked, docs, 5))


def test_folded_index_and_nothing_to_add(spark, tmp_path):
    docs, path = spark.createDataFrame([(1, "Alpha beta"), (2, "ALPHA"), (3, ""), (4, "gamma gamma"), (5, None)], "doc_id long, text string"), str(tmp_path / "i")
    ks.append(docs.limit(0), path, fold=True)
    ks.append(docs, path)
    asked = spark.createDataFrame([(1, "alpha GAMMA")], "query_id long, text string")
    assert hits(ks.load(spark, path).search(asked, 9)) == hits(search.keyword_index(docs, True).search(asked, 9)) and ks.load(spark, path).docs == 3
    with pytest.raises(ValueError):
        ks.load(spark, str(tmp_path / "none"))


def test_blocks_are_skipped_and_hot_terms_are_cut(spark, tmp_path, asked):
    rng = random.Random(5)
    texts = [" ".join(["all"] * (1 + i % 3) + [rng.choice(WORDS) for _ in range(rng.choice([3, 30, 400]))]) for i in range(400)] + ["all w1 w2 w3"] * 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    postings = search.postings_of(docs, False)
    classes, n, _ = blockmax.sizes(search.tokenised(docs, "doc_id", "text", False))
    blocks = blockmax.blocks_of(postings, classes, block=20)
    assert n == 430 and blocks.where("term = 'all'").count() > 10 and blocks.agg(F.max(F.size("entries"))).first()[0] < 100
    assert blockmax.postings_in(blocks).exceptAll(postings.select("term", "chunk_id", "dl", F.col("tf").cast("int"))).isEmpty()
    totals = search.keyword_index(docs, False)
    index = blockmax.BlockIndex(blocks.withColumn("part", F.lit("p")), totals.terms, totals.docs, totals.tokens, 0.0, False, 1.5, 0.75)
    mean = totals.terms.select(F.avg(F.log(totals.docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
    index = blockmax.BlockIndex(index.blocks, index.terms, index.docs, index.tokens, mean, False, 1.5, 0.75)
    few = asked.where("query_id in (0, 4, 8)")
    assert hits(index.search(few, 5)) == hits(totals.search(few, 5))
    work = index.skipped(few, 5).collect()
    assert len(work) == 3 and sum(r.scored for r in work) < sum(r.blocks for r in work)


def test_postings_are_shuffled_once(spark):
    """blocks come from texts by one shuffle."""
    docs = spark.createDataFrame([(i, f"a b{i} a c") for i in range(50)] + [(90, None), (91, "")], "doc_id long, text string")
    blocks, n, tokens = blockmax.block_postings(docs, False, "doc_id", "text")
    assert (n, tokens) == (52, 200)
    assert blockmax.postings_in(blocks).exceptAll(search.postings_of(docs, False).select("term", "chunk_id", "dl", F.col("tf").cast("int"))).isEmpty()
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1  # two before


def test_blocks_and_scores_without_shuffling_postings(spark, asked, monkeypatch):
    """blocks of enough documents are as the task that read them made them, and scoring explodes no postings."""
    blank = ["a  b\tc", " x\x0by\x0c z\r\n", "n\xa0o p\x1cq\x85r s　t", "", " ", None, "e"] + [f"w1 w{i % 7} w{i % 5} all" for i in range(700)]
    docs = spark.createDataFrame(list(enumerate(blank)), "doc_id long, text string").coalesce(1)
    split = search.tokenised(docs, "doc_id", "text", False)
    pieces = search.written(blockmax.pieces_of(blockmax.uncut(docs, "doc_id", "text", False)), "pieces")
    assert blockmax.totals(pieces) == tuple(split.agg(F.count("*"), F.sum("dl")).first())
    want = search.postings_of(docs, False).select("term", "chunk_id", "dl", F.col("tf").cast("int"))
    for made in (pieces, blockmax.pieces_of(split), blockmax.gathered(pieces)):
        both = blockmax.postings_in(made.where("term is not null"))
        assert both.exceptAll(want).isEmpty() and want.exceptAll(both).isEmpty()
    one = search.written(blockmax.pieces_of(split.coalesce(1)), "pieces")
    assert blockmax.gathered(one) is one and one.select("block").distinct().count() == 1  # before: grouped anew by a shuffle
    totals = search.keyword_index(docs, False)
    mean = totals.terms.select(F.avg(F.log(totals.docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]
    index = blockmax.BlockIndex(search.written(blockmax.pieces_of(split, 40), "pieces").withColumn("part", F.lit("p")), totals.terms, totals.docs, totals.tokens, mean, False, 1.5, 0.75)
    best = hits(totals.search(asked, 5))
    found = index.search(asked, 5)
    assert hits(found) == best and "explode" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(blockmax, "SCAN_TERMS", 3)  # too many terms for all tasks
    assert hits(index.search(asked, 5)) == best


def test_a_block_scored_by_steps(monkeypatch):
    """F2: what is held at a time changes no score."""
    rng = random.Random(2)
    lists = [sorted(rng.sample(range(30), rng.randrange(1, 20))) for _ in range(8)]
    left = pa.table({"term": [f"t{i}" for i in range(8)], "chunk_id": lists, "tf": [[1 + i % 3 for i in x] for x in lists], "dl": [[5 + i for i in x] for x in lists]})
    right = pa.table({"query_id": list(range(9)), "floor": [0.0] * 8 + [1.5]})
    weights = pa.table({"query_id": [q for q in range(10) for _ in range(3)], "term": [f"t{(q + i) % 9}" for q in range(10) for i in range(3)], "weight": [rng.random() - 0.2 for _ in range(30)]})
    impact, sums = blockmax.impact_of(12.0, 1.5, 0.75), {}
    for q, t, w in zip(*weights.to_pydict().values(), strict=True):
        for i in lists[int(t[1:])] if q < 9 and t != "t8" else []:
            sums[q, i] = sums.get((q, i), 0) + w * impact(1 + i % 3, 5 + i)
    want = sorted((q, i, round(x, 9)) for (q, i), x in sums.items() if x > 0 and (q < 8 or x >= 1.5))
    for held in (1 << 21, 40, 7):
        monkeypatch.setattr(blockmax, "HELD", held)
        assert sorted(zip(*blockmax.block_scores(left, right, weights, impact, 99).to_pydict().values(), strict=True)) == want


def test_merging_moves_blocks(spark, tmp_path, asked, monkeypatch):
    """a merge writes whole blocks again as they are; before, all postings were taken apart and grouped anew."""
    docs, path, plans, write = spark.createDataFrame([(i, f"w{i % 9} w{i % 4} same") for i in range(1200)], "doc_id long, text string"), str(tmp_path / "m"), [], ks._write
    monkeypatch.setattr(ks, "uncut", lambda docs, key, text, fold, segment: search.tokenised(docs.coalesce(1), key, text, fold))
    monkeypatch.setattr(ks, "_write", lambda blocks, *rest: plans.append(blocks._jdf.queryExecution().optimizedPlan().toString()) or write(blocks, *rest))
    for i in range(2):
        ks.append(docs.where(F.col("doc_id") % 2 == i), path, fan=2)
    now = ks.state(spark, path)
    assert [x for x, _, _ in now.live.values()] == [1] and len(plans) == 3 and not any("Aggregate" in p for p in plans)
    index = ks.load(spark, path)
    assert index.blocks.where("term = 'same'").count() == 2 and hits(index.search(asked, 5)) == hits(search.bm25(asked, docs, 5))
