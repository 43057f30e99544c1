import numpy as np
from pyspark.sql import functions as F

from lodequery import queries
from lodequery.operators import ann, search

SF = "/root/testdata/sf0.1"


def test_recall_against_the_exact_search(spark):
    rows = queries.vector_index_recall(spark, SF).collect()
    assert len(rows) == 20 and sum(r.found for r in rows) >= 0.9 * sum(r.wanted for r in rows)


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")


def test_all_cells_like_the_exact_search(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ann, "SLICE", 25)  # so that copies are met in slices
    rng = np.random.default_rng(3)
    plain = [*rng.normal(size=(120, 7)), *([np.ones(7)] * 90)]
    vectors = table(spark, plain)
    ann.build(vectors.where("vec_id < 100"), str(tmp_path / "i"), cells=6)
    ann.add(vectors.where("vec_id >= 100"), str(tmp_path / "i"))
    index = ann.load(spark, str(tmp_path / "i"))
    assert index.rows.count() == 210
    asked = vectors.where("vec_id % 30 = 0").withColumnRenamed("vec_id", "query_id")
    got = {tuple(r) for r in index.search(asked, 8, probed=1.0).collect()}
    want = {tuple(r) for r in search.vector_search(asked, vectors.withColumnRenamed("vec_id", "chunk_id"), 8).collect()}
    assert {(q, rank, score) for q, _, _, score, rank in got} == {(q, rank, score) for q, _, _, score, rank in want}
    assert {x for x in got if x[0] < 120} == {x for x in want if x[0] < 120}


def test_odd_vectors(spark, tmp_path):
    odd = [None, [], [0, 0, 0], [1, None, 2], [float("nan"), 1, 1], [float("inf"), 0, 0], [1, 2], [1e200, 1e200, 0], [1e-200, 1e-200, 0], [3, 4, 0]]
    vectors = table(spark, odd)
    ann.build(vectors, str(tmp_path / "i"))
    index = ann.load(spark, str(tmp_path / "i"))
    assert sorted(r.chunk_id for r in index.rows.collect()) == [7, 8, 9]
    got = index.search(vectors.withColumnRenamed("vec_id", "query_id"), 2).collect()
    assert {r.query_id for r in got} == {7, 8, 9} and {(r.chunk_id, r.score) for r in got if r.query_id == 7 and r.score == 1} == {(7, 1.0), (8, 1.0)}
    ann.build(vectors.limit(0), str(tmp_path / "none"))
    assert ann.load(spark, str(tmp_path / "none")).search(vectors.withColumnRenamed("vec_id", "query_id"), 2).count() == 0


def test_a_probe_reads_codes_and_no_vectors(spark, tmp_path):
    ann.build(table(spark, np.eye(6)), str(tmp_path / "i"))
    index = ann.load(spark, str(tmp_path / "i"))
    plan = index.search(table(spark, np.eye(6)[:1]).withColumnRenamed("vec_id", "query_id"), 1)._jdf.queryExecution().executedPlan().toString()
    scans = [x.split("ReadSchema:")[1] for x in plan.split("\n") if "ReadSchema:" in x and "codes" in x.split("ReadSchema:")[1]]
    assert scans and all("embedding" not in x for x in scans)


def test_many_copies_like_the_exact_search(spark, tmp_path):
    """More copies than there are candidates: of equal scores the smallest ids come first."""
    rng = np.random.default_rng(5)
    some = rng.normal(size=(12, 5))
    rows = [(i, [float(e) for e in some[(i * 7) % 12]]) for i in range(1200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").orderBy(F.desc("vec_id"))
    ann.build(vectors.where("vec_id % 2 = 0"), str(tmp_path / "i"), cells=4)
    ann.add(vectors.where("vec_id % 2 = 1"), str(tmp_path / "i"))
    asked = vectors.where("vec_id < 12").withColumnRenamed("vec_id", "query_id")
    got = {tuple(r) for r in ann.load(spark, str(tmp_path / "i")).search(asked, 5, probed=1.0).collect()}
    assert got == {tuple(r) for r in search.vector_search(asked, vectors.withColumnRenamed("vec_id", "chunk_id"), 5).collect()}
