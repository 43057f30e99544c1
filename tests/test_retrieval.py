import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodequery.functions import keys, rules
from lodequery.operators import fusion, search


def q(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_bm25_golden(spark):
    docs = spark.createDataFrame(list(enumerate(["graph search engine", "sparse search scoring", "graph graph database", "vector index", "late chunk pooling", "web crawl", "rank fusion"])), "doc_id long, text string")
    got = {r.chunk_id: round(r.score, 6) for r in search.bm25(q(spark, "graph search"), docs).collect()}
    assert got == {0: 1.466897, 1: 0.733449, 2: 1.069095}
    few = search.bm25_relative(q(spark, "Graph SEARCH", "nothing"), docs, 5).collect()
    assert [(r.chunk_id, round(r.score, 4)) for r in sorted(few, key=lambda r: r.rank) if r.query_id == 0] == [(0, 1.0), (2, 0.7288), (1, 0.5), (3, 0.0), (4, 0.0)]
    assert [r.score for r in few if r.query_id == 1] == [0.0] * 5


def test_bm25_negative_idf(spark):
    docs = spark.createDataFrame(list(enumerate(["a b", "a c", "a d"])), "doc_id long, text string")
    got = {r.chunk_id: round(r.score, 6) for r in search.bm25_scores(q(spark, "a b"), docs, False).collect()}
    assert got == {0: 0.484986, 1: -0.02584, 2: -0.02584}
    assert [r.chunk_id for r in search.bm25(q(spark, "a b"), docs).collect()] == [0]


def test_scan_like_the_index(spark, monkeypatch):
    """F4, F5, F7 to F9, F11 to F15: hits of a scan are the index's, and neither postings nor all scores are shuffled or written."""
    words = ["a", "b", "c", "d", "e", "F", "g"]
    rng = np.random.default_rng(8)
    docs = spark.createDataFrame([(i, " ".join(words[x] for x in rng.integers(0, 7, n))) for i, n in enumerate(rng.integers(0, 9, 300))] + [(900, None), (901, "")], "doc_id long, text string")
    asked = q(spark, "a b b", "F z", "", "zz", "c d e g a")
    monkeypatch.setattr(search, "SCAN_SCORES", 50)
    row = lambda df: sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 8)) for r in df.collect())
    with monkeypatch.context() as m:
        m.setattr(search, "keyword_index", None)
        hits, relative = row(search.bm25(asked, docs, 7)), row(search.bm25_relative(asked, docs, 7))
    assert hits == row(search.keyword_index(docs, False).search(asked, 7)) and len(hits) == 21
    assert relative == row(search.keyword_index(docs, True).relative(asked, 7, docs.where("text != ''").select(F.col("doc_id").alias("chunk_id"))))
    monkeypatch.setattr(search, "SCAN_TERMS", 3)  # too many terms for a scan
    assert row(search.bm25(asked, docs, 7)) == hits and row(search.bm25_relative(asked, docs, 7)) == relative


def test_vector_search(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [3.0, 3.0]), (3, [0.0, 2.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "chunk_id long, embedding array<double>")
    got = search.vector_search(spark.createDataFrame([(9, [2.0, 0.0]), (8, None)], "query_id long, embedding array<double>"), v, 2).collect()
    assert [(r.query_id, r.chunk_id, round(r.score, 6), r.rank) for r in sorted(got, key=lambda r: r.rank)] == [(9, 1, 1.0, 1), (9, 2, 0.707107, 2)]


def hits(spark, rows):
    return fusion.in_order(spark.createDataFrame(rows, "query_id long, route string, chunk_id string, score double, rank int, content string"))


def test_rrf_golden(spark):
    rows = [(0, "vector", c, 0.5, i + 1, c) for i, c in enumerate("xyz")] + [(0, "bm25", c, 0.5, i + 1, c) for i, c in enumerate("yxw")]
    got = fusion.reciprocal_rank(hits(spark, rows)).orderBy("rank").collect()
    assert [(r.key, round(r.rrf_score, 6)) for r in got] == [("x", 0.032522), ("y", 0.032522), ("z", 0.015873), ("w", 0.015873)]
    same = fusion.reciprocal_rank(hits(spark, [(0, "vector", None, 0.5, 1, "text"), (0, "bm25", None, 0.5, 1, "text")])).collect()
    assert len(same) == 1 and fusion.reciprocal_rank(hits(spark, rows).limit(0)).count() == 0


def test_weighted_golden(spark):
    rows = [(0, "vector", "a", 0.9, 1, "same  text"), (0, "bm25", "b", 1.0, 1, "same text"), (0, "graph", None, 0.7, 1, "graph"), (0, "bm25", "e", 9.0, 2, "")]
    got = fusion.weighted(hits(spark, rows)).orderBy("rank").collect()
    assert [(r.chunk_id, round(r.fusion_score, 6), r.matched_by) for r in got] == [("a", 0.745, ["vector", "bm25"]), (None, 0.14, ["graph"])]


def test_merge_compress_rerank(spark):
    rows = [(0, "vector", "a", 0.2, 1, "aaaa"), (0, "vector", "b", 0.9, 2, "bbbb"), (0, "bm25", "a", 0.5, 1, "aaaa"), (0, "bm25", "c", 0.1, 2, "cccc")]
    h = hits(spark, rows)
    assert [(r.chunk_id, r.score) for r in fusion.merged(h).orderBy("rank").collect()] == [("a", 0.5), ("b", 0.9), ("c", 0.1)]
    assert [r.chunk_id for r in fusion.merged(h, 2).orderBy("rank").collect()] == ["b", "a"]
    cut = fusion.compressed(h.withColumn("rank", F.col("ord")), 10).orderBy("rank").collect()
    assert [r.content for r in cut] == ["aaaa", "bbbb", "aa"]
    pool = spark.createDataFrame([(0, "v", c, 0.1, i + 1, c, i + 1) for i, c in enumerate("abc")], "query_id long, route string, chunk_id string, score double, rank int, content string, ord int")
    best = fusion.reranked(pool, q(spark, "x"), 3, lambda query, contents: [{"a": 0.6, "b": 0.2, "c": 0.95}[c] for c in contents]).orderBy("rank").collect()
    assert [(r.chunk_id, r.pre_rank) for r in best] == [("c", 3), ("a", 1), ("b", 2)]


def test_crag_golden(spark):
    rows = [(i, s, s) for i, s in enumerate((0.95, 0.5, 0.05)) for _ in range(5)]
    h = spark.createDataFrame(rows, "query_id long, score double, rerank_score double")
    got = {r.query_id: (r.score, r.decision) for r in fusion.crag(h, q(spark, "", "", "", "")).collect()}
    assert got == {0: (0.965, "use"), 1: (0.65, "rewrite"), 2: (0.035, "fallback"), 3: (0.0, "fallback")}


@pytest.mark.parametrize("score,rewrites,first,capped", [(0.85, 0, "use", "use"), (0.5, 0, "rewrite", "rewrite"), (0.15, 0, "fallback", "fallback"), (0.5, 2, "fallback", "fallback"), (0.9, 2, "use", "fallback"), (0.6999, 1, "rewrite", "rewrite"), (0.3, 0, "rewrite", "rewrite"), (0.29, 0, "fallback", "fallback")])
def test_decisions(spark, score, rewrites, first, capped):
    r = spark.range(1).select(rules.decision_score_first(F.lit(score), F.lit(rewrites)).alias("a"), rules.decision_cap_first(F.lit(score), F.lit(rewrites)).alias("b")).first()
    assert (r.a, r.b) == (first, capped)


def test_functions(spark):
    row = spark.range(1).select(
        F.slice(keys.hash_embedding(F.lit("hello")), 1, 4).alias("e"), keys.norm(keys.hash_embedding(F.lit("hello"))).alias("n"), keys.path_id(F.array(*map(F.lit, ("n0", "n1", "n2")))).alias("p"),
        keys.rendered_path(F.array(*map(F.lit, ("A", "B", "C"))), F.array(F.lit("USES"), F.lit("HAS"))).alias("r"), rules.confidence(F.lit(0)).alias("c"), rules.verdict(F.lit("PASS")).alias("v"),
        rules.json_object(F.lit('x ```json\n{"a": 1}\n``` {"b": 2}')).alias("j"), rules.json_object(F.lit("[1]")).alias("none"), rules.keyword_score(F.lit("Big Cat"), F.array(F.lit("cat"), F.lit("dog"))).alias("k"),
        rules.shown_score(F.lit(0.0), F.lit(0.4)).alias("s"), rules.effective_score(F.lit(0.0), F.lit(0.4)).alias("t"), rules.sigmoid(F.lit(0.0)).alias("g"),
        rules.answer_text(F.lit("A"), F.array(F.lit("s1")), F.lit(0.5), F.array().cast("array<string>")).alias("a"), rules.link_target(F.lit(""), F.lit("d"), F.lit("e")).alias("l"),
    ).first()
    assert [round(x, 6) for x in row.e] == [0.034357, 0.024013, 0.023644, 0.015516] and math.isclose(row.n, 1)
    assert (row.p, row.r, row.c, row.v) == ("n0->n1->n2@d2", "A —[USES]→ B —[HAS]→ C", 0.8, "pass")
    assert row.j.strip() == '{"a": 1}' and row.none is None and row.k == 0.5 and (row.s, row.t, row.g) == (0.4, 0.0, 0.5)
    assert row.a == "A\n\nSources:\n- s1\n\nNote: low confidence" and row.l == "doc:d"


def test_vector_blocks(spark):
    """Blocks of queries against slices of vectors give what one scan gives: ties, copies, odd vectors, two widths."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4 if i % 5 else 3)]) for i in range(120)]
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None, 0.0, 1.0]), (204, [float("nan"), 1.0, 1.0, 1.0]), (205, [float("inf"), 1.0, 1.0, 1.0]), (206, rows[1][1]), (207, rows[1][1])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<double>")
    queries = vectors.where("chunk_id % 2 = 0").withColumnRenamed("chunk_id", "query_id")
    ok = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    want = set()
    for i in (i for i in ok if i % 2 == 0):
        near = sorted((-round(float(ok[i] @ w / np.linalg.norm(ok[i]) / np.linalg.norm(w)), 9), j) for j, w in ok.items() if len(w) == len(ok[i]))[:6]
        want |= {(i, j, -s, r + 1) for r, (s, j) in enumerate(near)}
    for sizes in ({}, {"query_block": 9, "vector_block": 25}):
        got = {(r.query_id, r.chunk_id, r.score, r.rank) for r in search.vector_search(queries, vectors, 6, **sizes).collect()}
        assert got == want, sizes
    assert {r.chunk_id for r in search.vector_search(queries, vectors, 99, dims=3, query_block=3, vector_block=5).collect()} == {i for i, v in ok.items() if len(v) == 3}
    assert search.vector_search(queries.limit(0), vectors).count() == search.vector_search(queries, vectors.limit(0), query_block=3).count() == 0
