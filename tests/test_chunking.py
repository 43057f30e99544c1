import time

import pytest
from pyspark.sql import functions as F

from lodequery.operators import chunking as C


def test_fixed(spark):
    docs = spark.createDataFrame([(1, "x" * 1000), (2, "y" * 512), (3, ""), (4, None)], "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_index, len(r.content)) for r in C.fixed_chunks(docs).collect())
    assert got == [(1, 0, 512), (1, 1, 512), (1, 2, 76), (2, 0, 512), (3, 0, 0)]
    with pytest.raises(ValueError):
        C.fixed_chunks(docs, 50, 50)


@pytest.mark.parametrize("doc,text,most,overlap,want", [
    ("d1", "这是一句话。这是另一句。", 512, 32, [("这是一句话。 这是另一句。", 10, "d1:0:0a3986ef4d44")]),
    ("d4", "一句。二句。三句。四句。", 4, 1, [("一句。 二句。", 4, "d4:0:84dac1951940"), ("二句。三句。", 4, "d4:1:fc8a3e8dde4d"), ("三句。四句。", 4, "d4:2:47a0e0acd56c")]),
])
def test_semantic_golden(spark, doc, text, most, overlap, want):
    rows = C.semantic_chunks(spark.createDataFrame([(doc, text)], "doc_id string, text string"), most, overlap).orderBy("chunk_index").collect()
    assert [(r.content, r.token_count, r.chunk_id) for r in rows] == want


def test_semantic_many(spark):
    docs = spark.createDataFrame([("a", "".join(f"这是第{i}句。" for i in range(200)))], "doc_id string, text string")
    rows = C.semantic_chunks(docs, 50, 10).orderBy("chunk_index").collect()
    assert len(rows) == 25 and max(r.token_count for r in rows) == 50 and rows[1].content.startswith("这是第10句。 这是第11句。这是第12句。")
    rows = C.semantic_chunks(spark.createDataFrame([("d3", " ".join(f"sentence-{i}." for i in range(60)))], "doc_id string, text string"), 20, 8).orderBy("chunk_index").collect()
    assert len(rows) == 14 and rows[0].token_count == 20 and rows[0].chunk_id == "d3:0:f711372f6da2" and rows[1].content.startswith("sentence-5. sentence-6.sentence-7. ")
    assert C.semantic_chunks(docs.limit(0)).count() == 0


def test_markdown(spark):
    text = "intro\n# A\nbody one.\n## B ##\n```\n# not a heading\n```\ntext\n### C\n\n# D\nlast"
    rows = C.markdown_chunks(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("section_index").collect()
    assert [(r.breadcrumbs, r.heading_depth) for r in rows] == [("", 0), ("A", 1), ("A > B", 2), ("D", 1)]
    assert "# not a heading" in rows[2].content and all(r.chunk_index == 0 for r in rows)
    long = "# T\n```\n" + "x = 1. y = 2! " * 400 + "\n```\n"
    many = C.markdown_chunks(spark.createDataFrame([(1, long)], "doc_id long, text string"))
    assert many.count() > 1 and C.markdown_chunks(spark.createDataFrame([(1, long)], "doc_id long, text string"), atomic_fences=True).count() == 1


def test_claims(spark):
    texts = ["检索增强是一种方法。It uses Neo4j. Does it work? Yes!", "A `x`. ```a. b. c.``` then $$x. y.$$ end.", "", None, "no end", "3.14 is pi. ok"]
    rows = C.claims(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    by = {}
    for r in sorted(rows):
        by.setdefault(r.id, []).append(r.claim)
    assert by == {0: ["检索增强是一种方法。", "It uses Neo4j.", "Does it work?", "Yes!"], 1: ["A `x`.", "```a. b. c.```", "then", "$$x. y.$$", "end."], 4: ["no end"], 5: ["3.14 is pi.", "ok"]}


def test_pooling_and_spans(spark):
    vectors = spark.createDataFrame([(i, [float(i), -float(i)]) for i in range(200)], "position long, embedding array<float>")
    spans = spark.createDataFrame([(0, 0, 3), (1, 60, 130), (2, 5, 5)], "span_id int, token_start long, token_end long")
    got = {r.span_id: r.pooled for r in C.pooled(vectors, spans).collect()}
    assert got == {0: [1.0, -1.0], 1: [94.5, -94.5], 2: []}
    assert {r.span_id: r.pooled for r in C.pooled(vectors, spans, "max").collect()}[1] == [129.0, -60.0]
    with pytest.raises(ValueError):
        C.pooled(vectors, spans, "sum")
    chunks = spark.createDataFrame([(1, 0, "abcdefgh"), (1, 1, "一二"), (1, 2, "")], "doc_id long, chunk_index int, content string")
    assert [(r.token_start, r.token_end) for r in C.late_spans(chunks).orderBy("chunk_index").collect()] == [(0, 2), (2, 4), (4, 4)]


def test_contextual(spark):
    docs = spark.createDataFrame([(1, "First. Second."), (2, " ")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, "Second."), (2, "x")], "doc_id long, content string")
    got = {r.doc_id: r.augmented_content for r in C.contextualised(chunks, docs).collect()}
    assert got == {1: "First.\n\nSecond.", 2: "x"}
    assert C.contextualised(chunks, docs, lambda d, c: F.lit(None).cast("string")).where("augmented_content = content").count() == 2


def test_many_short_sentences_are_linear():
    """Sentences under four characters count for nothing, so one chunk takes them all: without going over them again each time."""
    began = time.process_time()
    assert len(list(C.Packer().chunks("a. " * 40_000))) == 1
    for overlap in (512, 513, -1):
        with pytest.raises(ValueError):
            C.Packer(512, overlap)
    assert time.process_time() - began < 3


def test_failing_context_leaves_the_chunk(spark):
    docs = spark.createDataFrame([(1, "First. Second."), (2, "Other.")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, "Second."), (2, "x")], "doc_id long, content string")

    def writer(document, chunk):
        if chunk == "x":
            raise RuntimeError("down")
        return f"about {chunk}"

    assert {r.doc_id: r.augmented_content for r in C.contextualised(chunks, docs, writer=writer).collect()} == {1: "about Second.\n\nSecond.", 2: "x"}


def test_batches(spark):
    rows = spark.createDataFrame([(i, i % 2) for i in range(25)], "i int, k int").repartition(4)
    assert {r.i: r.batch_index for r in C.batches(rows, 10, "i").collect()} == {i: i // 10 for i in range(25)}
    assert {r.i: r.batch_index for r in C.batches(rows, 10, "i", by="k").collect()} == {i: i // 20 for i in range(25)}
    assert C.batches(rows.limit(0), 10, "i").count() == 0
    with pytest.raises(ValueError):
        C.batches(rows, 0, "i")


def test_chunks_in_sql(spark):
    """The table function by a lateral join gives the rows of semantic_chunks, nulls, empty and long texts included."""
    long = " ".join(f"sentence number {i}." for i in range(400))
    docs = spark.createDataFrame([("a", long), ("b", None), ("c", ""), ("d", "   "), ("e", "一二三。四五六。" * 60), ("a", "again.")], "doc_id string, text string")
    C.register_chunks(spark)
    got = spark.sql("SELECT doc_id, c.* FROM {docs}, LATERAL chunks_of(doc_id, text, 40, 10) c", docs=docs)
    want = C.semantic_chunks(docs, 40, 10)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    counted = spark.sql("SELECT doc_id, count(*) AS n, max(token_count) AS most FROM {docs}, LATERAL chunks_of(doc_id, text, 40, 10) WHERE length(text) > 400 GROUP BY 1", docs=docs)
    assert {r.doc_id for r in counted.where("n > 3 AND most <= 40").collect()} == {"a", "e"}
