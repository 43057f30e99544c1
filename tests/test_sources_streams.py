import datetime
import io
import json
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from lodequery.functions import checks, keys, outputs
from lodequery.operators import fusion, graph, search
from lodequery.plans import agents, ask, bench, tools
from lodequery.plans.service import Service
from lodequery.sources import files, stores
from lodequery.streaming import streams


def docx(paragraphs, table):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in paragraphs)
    rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in r) + "</w:tr>" for r in table)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{p}<w:tbl>{rows}</w:tbl></w:body></w:document>')
    return out.getvalue()


def pptx(slides):
    a = "http://schemas.openxmlformats.org/drawingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, t in enumerate(slides, 1):
            z.writestr(f"ppt/slides/slide{i}.xml", f'<p xmlns:a="{a}"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p>')
    return out.getvalue()


def test_files(spark, tmp_path):
    for name, data in {"a.txt": "héllo".encode(), "b.MD": b"# T", "c.docx": docx(["one", " ", "two"], [["x", "y"]]), "d.pptx": pptx(["first", " ", "third"]), "e.png": b"img", "f.exe": b"x", "g.txt": b"\xff\xfe\xff", "h.txt": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.file_name: r for r in files.parsed(files.files(spark, str(tmp_path)), {".png": lambda b: {"full_text": "seen", "ocr": [{"text": "seen", "confidence": 0.5, "bbox": [[0.0, 1.0]]}]}}).collect()}
    assert got["a.txt"].full_text == "héllo" and got["a.txt"].size == 6 and len(got["a.txt"].file_hash) == 64 and got["b.MD"].file_type == ".md"
    assert got["c.docx"].full_text == "one\ntwo" and got["c.docx"].tables == [[["x", "y"]]]
    assert [(p.page, p.text) for p in got["d.pptx"].pages] == [(1, "first"), (3, "third")] and got["d.pptx"].full_text == "first\n\nthird"
    assert got["e.png"].ocr[0].confidence == 0.5 and "unsupported" in got["f.exe"].error and got["g.txt"].error and got["g.txt"].full_text == ""
    gate = {r.file_name: r.rejected for r in files.upload_gate(files.parsed(files.files(spark, str(tmp_path))), text="full_text").collect()}
    assert gate["a.txt"] is None and gate["f.exe"] == "file type" and gate["e.png"] == "no text"
    sizes = spark.createDataFrame([("h.txt", 0), ("i.txt", None), ("big.pdf", files.MAX_BYTES + 1), ("noext", 5), (None, 5)], "file_name string, size long")
    assert [r.rejected for r in files.upload_gate(sizes).collect()] == ["empty file", "empty file", "too large", "file type", "file type"]
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "type": "t", "question": "q", "expected_keywords": ["a"]}]))
    assert files.question_file(spark, str(tmp_path / "q.json")).first().expected_keywords == ["a"]


def test_stores(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    stores.save_index(docs, str(tmp_path / "i"), fold=True)
    index = stores.load_index(spark, str(tmp_path / "i"))
    assert {(r.term, r.chunk_id, r.tf) for r in index.postings.collect()} == {("a", 1, 2), ("b", 1, 1), ("b", 2, 1), ("c", 2, 1)} and (index.docs, index.tokens) == (2, 5) and index.terms.count() == 3
    v = spark.createDataFrame([(1, [3.0, 4.0])], "vec_id long, embedding array<double>")
    stores.append_vectors(v, str(tmp_path / "v"))
    stores.append_vectors(v, str(tmp_path / "v"))
    assert [r.embedding for r in spark.read.parquet(str(tmp_path / "v")).collect()] == [[0.6, 0.8]] * 2
    with pytest.raises(ValueError):
        stores.append_vectors(v.union(spark.createDataFrame([(2, [1.0])], v.schema)), str(tmp_path / "v"))
    pages = spark.createDataFrame([("u1", "<p>Cats and <b>dogs</b></p><script>cats cats birds</script>"), ("u2", "<!-- cats --> birds"), ("u3", None)], "url string, html string")
    got = stores.web_hits(spark.createDataFrame([(0, "cats dogs"), (1, "birds")], "query_id long, text string"), pages).orderBy("query_id").collect()
    assert [(r.query_id, r.chunk_id, r.score, r.content) for r in got] == [(0, "web:u1", 1.0, "Cats and dogs"), (1, "web:u2", 1.0, "birds")]
    assert [r.chunk_id for r in stores.static_hits(spark, [(0, "b", 0.1, ""), (0, "a", 0.9, ""), (0, "c", 0.5, "")], 2).orderBy("rank").collect()] == ["b", "a"]
    p = stores.payload_split(spark.createDataFrame([(1, {"content": "x", "other": "y"})], "id int, payload map<string,string>")).first()
    assert (p.content, p.doc_id, p.metadata) == ("x", None, {"other": "y"})
    stores.append_events(spark.createDataFrame([("planner", datetime.datetime(2024, 1, 1))], "node string, ts timestamp"), str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).first().event == "audit.planner"


def test_ingest_and_entities(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "x" * 1000)], "doc_id long, text string").write.parquet(src)
    streams.ingest(spark, src, str(tmp_path / "chunks"), str(tmp_path / "c1")).awaitTermination()
    spark.createDataFrame([(2, "y")], "doc_id long, text string").write.mode("append").parquet(src)
    streams.ingest(spark, src, str(tmp_path / "chunks"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "chunks")).count() == 4
    streams.extract_entities(spark, src, str(tmp_path / "ents"), str(tmp_path / "c2"), lambda c: c.select("doc_id", F.length("content").alias("chars")), 900).awaitTermination()
    assert {(r.doc_id, r.chars) for r in spark.read.parquet(str(tmp_path / "ents")).collect()} == {(1, 900), (2, 1)}  # more than a chunk of 512


def test_upsert(spark, tmp_path):
    src = str(tmp_path / "in")
    for n, rows in enumerate(([("a", 1, 1), ("b", 1, 2)], [("a", 2, 3)])):
        spark.createDataFrame(rows, "k string, v int, seq int").write.mode("append").parquet(src)
        streams.upsert(spark.readStream.schema("k string, v int, seq int").parquet(src), str(tmp_path / "t"), ["k"], "seq", str(tmp_path / "c")).awaitTermination()
        assert {r.k: r.v for r in streams.read_upserted(spark, str(tmp_path / "t")).collect()} == ({"a": 1, "b": 1}, {"a": 2, "b": 1})[n]
    assert sorted(len(v) for v in streams.versions(spark, str(tmp_path / "t")).values()) == [1, 2]  # only the bucket of a was written again


def at(second):
    return datetime.datetime(2024, 1, 1, 0, 0, 0, tzinfo=datetime.timezone.utc) + datetime.timedelta(seconds=second)


def test_rate_limit_stream(spark, tmp_path):
    rows = [("c", at(i)) for i in range(4)] + [("d", at(0)), ("c", at(100)), ("z", at(100_000))]
    spark.createDataFrame(rows, "client string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.over_limit_stream(spark.readStream.schema("client string, ts timestamp").parquet(str(tmp_path / "in")), 3).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = [("c", 4)]
    assert [(r.client, r.requests) for r in spark.table("limited").collect()] == want
    assert [(r.client, r.requests) for r in streams.over_limit(spark.read.parquet(str(tmp_path / "in")), 3).collect()] == want


def test_breaker(spark, tmp_path):
    rows = [("s", at(i), i < 3) for i in range(5)] + [("s", at(40), False), ("t", at(0), True)]
    spark.createDataFrame(rows, "service string, ts timestamp, failed boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    q = streams.breaker(spark.readStream.schema("service string, ts timestamp, failed boolean").parquet(str(tmp_path / "in")), 3).writeStream.format("memory").queryName("broken").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.service, r.ts, r.allowed) for r in spark.table("broken").collect())
    assert [x[2] for x in got if x[0] == "s"] == [True, True, True, False, False, True] and [x[2] for x in got if x[0] == "t"] == [True]
    calls = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "service string, ts timestamp, failed boolean, call_id int")
    assert [r.call_id for r in streams.openings(calls, 3).collect()] == [2]


def test_completeness_stream(spark, tmp_path):
    spark.createDataFrame([(1, "planner"), (1, "auditor"), (1, "planner"), (2, "x")], "run_id int, node string").write.parquet(str(tmp_path / "in"))
    q = streams.run_completeness(spark.readStream.schema("run_id int, node string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("runs").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.run_id: r.completeness for r in spark.table("runs").collect()} == {1: 0.5, 2: 0.0}


def test_engine_and_service(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "corvid speaks quill", 0, "d"), ("c2", "lattice uses corvid", 0, "d"), ("c3", "nothing else here", 0, "e")], "chunk_id string, content string, chunk_index int, doc_id string")
    route = ask.keyword_route(chunks, "chunk_id", "content")

    def broken(queries, k):
        raise RuntimeError("down")

    engine = ask.Engine({"bm25": route, "kg": broken})
    questions = spark.createDataFrame([(1, "corvid quill"), (2, "zzz yyy")], "query_id long, text string")
    got = engine.ask(questions)
    answers = {r.query_id: r for r in got["answers"].collect()}
    assert (answers[1].decision, answers[1].rewrites) == ("use", 0) and answers[2].decision == "fallback"
    assert {r.query_id: r.verdict for r in got["verdicts"].collect()} == {1: "pass", 2: "warn"}
    nodes = {}
    for r in got["audit"].collect():
        nodes.setdefault(r.query_id, set()).add(r.node)
    assert nodes == {1: {"planner", "retriever", "evaluator", "generator", "auditor"}, 2: {"planner", "retriever", "evaluator", "fallback"}}
    assert engine.retrieve(questions)[2] == ["kg: down"] and engine.plan() == ["bm25", "kg"]
    low = ask.Engine({"bm25": route}, use=2.0, rewrite_from=-1.0).ask(questions.where("query_id = 1"))
    assert low["answers"].first().rewrites == 2 and low["answers"].first().decision == "fallback"
    assert [r.rewrite for r in low["rewrites"].orderBy("seq").collect()] == ["corvid quill (rewrite 1)", "corvid quill (rewrite 1) (rewrite 2)"]
    n, e = stores.static_triples(spark, [("A", "USES", "B")])
    vectors = chunks.select("chunk_id", keys.hash_embedding(F.col("content")).alias("embedding"))
    s = Service(spark, chunks, vectors, n.withColumns({"confidence": F.lit(0.8), "properties": F.create_map().cast("map<string,string>")}), e, engine)
    assert s.vector_search(spark.createDataFrame([(0, "corvid speaks quill")], "query_id long, text string"), 1).first().chunk_id == "c1"
    assert s.entity("A").first().name == "B" and s.path("A", "B").first().path == "A->B@d1" and s.graph()[1].count() == 1 and s.vector_stats().first().dims == 512
    assert {r.store: r.rows for r in s.status().collect()} == {"chunks": 3, "vectors": 3, "nodes": 2, "edges": 1} and s.graph_stats().count() == 3
    assert s.search_tool("search.bm25", questions).count() == 2 and s.ask(questions, 1)["fused"].groupBy("query_id").count().first()["count"] == 1
    (tmp_path / "x.txt").write_text("hello")
    (tmp_path / "y.exe").write_text("no")
    taken, refused = s.upload(str(tmp_path))
    assert taken.first().content == "hello" and refused.first().file_name == "y.exe"
    assert ask.hybrid(questions, {"bm25": route, "bad": broken})[1] == ["bad: down"] and graph.clamp(9, 1, 4) == 4


def test_index_grows(spark, tmp_path):
    """An index that is added to finds what one over all documents finds; a part without totals isn't read."""
    rows = [(1, "graph search engine"), (2, "sparse search"), (3, ""), (4, None), (5, "graph graph")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame([(0, "graph search")], "query_id long, text string")
    for fold in (True, False):
        path = str(tmp_path / f"i{fold}")
        stores.save_index(docs.where("doc_id < 3"), path, fold)
        stores.add_to_index(docs.where("doc_id >= 3"), path, fold)
        stores.postings_of(docs, fold).write.parquet(f"{path}/postings/part=interrupted")
        index = stores.load_index(spark, path)
        want = search.keyword_index(docs, fold)
        assert (index.docs, index.tokens, index.fold) == (want.docs, want.tokens, fold) == (3 if fold else 5, 7, fold)
        assert sorted(index.search(asked).collect()) == sorted(want.search(asked).collect())


def test_disconnected_stores(spark, tmp_path):
    store = stores.graph_store(spark, str(tmp_path / "none"))
    assert not store.connected and store["nodes"].count() == 0 and store.error and stores.load_vectors(spark, str(tmp_path / "none")).count() == 0
    n, e = stores.static_triples(spark, [("A", "USES", "B")])
    stores.save_graph(n, e, str(tmp_path / "g"))
    assert {p.name for p in (tmp_path / "g" / "edges").iterdir() if p.is_dir()} == {"rel_type=USES"}
    store = stores.graph_store(spark, str(tmp_path / "g"))
    assert store.connected and store["nodes"].count() == 2 and store["edges"].first().type == "USES"
    assert stores.load_graph(spark, str(tmp_path / "g"))[1].columns == e.select("source", "type", "target", "edge_id").columns


def test_every_route_fails(spark):
    def broken(queries, k):
        raise RuntimeError("down")

    def late(queries, k):  # fails in its tasks, not when it is planned
        bad = F.assert_true(F.lit(False), F.lit("late failure"))
        return queries.select("query_id", F.lit("web").alias("route"), F.lit("x").alias("chunk_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.concat("text", F.coalesce(bad.cast("string"), F.lit(""))).alias("content"))

    questions = spark.createDataFrame([(1, "corvid quill")], "query_id long, text string")
    fused, warnings, hits = ask.hybrid(questions, {"a": broken, "b": late})
    assert fused.count() == hits.count() == 0 and len(warnings) == 2
    got = ask.Engine({"a": broken, "b": late}).ask(questions)
    assert got["answers"].first().decision == "fallback" and got["warnings"].count() >= 2 and got["records"].first().branch == "fallback"


def test_hooks(spark):
    chunks = spark.createDataFrame([(1, "corvid speaks quill"), (2, "lattice uses corvid"), (3, "else"), (4, "more"), (5, "words")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "corvid quill"), (2, "bad one")], "query_id long, text string")

    def embedder(text):
        if "bad" in text:
            raise ValueError("no vector")
        return [1.0, float(len(text))]

    vectors = ask.embedded(chunks.select(F.col("doc_id").alias("query_id"), "text"), embedder).withColumnRenamed("query_id", "doc_id")
    got = ask.embedded_route(chunks, vectors, embedder, 2)(asked, 5).collect()
    assert {r.query_id for r in got} == {1} and len(got) == 5
    assert ask.embedded(asked, embedder, 3).count() == 0
    assert [r.name for r in ask.query_entities(asked, lambda t: [w for w in t.upper().split() if len(w) > 3]).collect()] == ["corvid", "quill"]
    assert [r.name for r in ask.query_entities(asked).where("query_id = 2").collect()] == ["bad", "one"]
    hits = fusion.in_order(spark.createDataFrame([(1, "bm25", "a", 0.9, 1, "x"), (1, "bm25", "b", 0.8, 2, "y"), (2, "bm25", "c", 0.7, 1, "z")], "query_id long, route string, chunk_id string, score double, rank int, content string"))

    def scorer(query, contents):
        if "bad" in query:
            raise ValueError("no score")
        return [float(c == "y") for c in contents]

    top = fusion.reranked(hits, asked, 5, scorer).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.chunk_id, r.rerank_score) for r in top] == [(1, "b", 1.0), (1, "a", 0.0), (2, "c", None)]
    judged = fusion.crag(hits, asked, scorer=lambda q, c: [0.5] * len(c)).orderBy("query_id").collect()
    assert [(r.relevance, r.coverage, r.score) for r in judged] == [(0.5, 0.0, 0.35), (0.5, 0.0, 0.35)] or judged[0].relevance == 0.5
    failing = ask.Engine({"bm25": ask.keyword_route(chunks)}, auditor=lambda a, e: a.select("no such column")).ask(asked.where("query_id = 1"))
    assert failing["cited"].count() > 0 and "auditor_failed" in failing["warnings"].first().warning


def test_agents_and_frames(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "corvid speaks quill"), (2, "other things"), (3, "nothing here")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "corvid quill")], "query_id long, text string")

    def model(prompt):
        if "Sources:" in prompt:
            raise RuntimeError("down")
        return 'Sure: ```json\n{"intent": "compare", "query_rewrite": "corvid", "answer": "a raven", "confidence": "high"}\n```'

    assert agents.analysed(asked, model).first().analysis.query_rewrite == "corvid"
    evidence = agents.evidence_texts(ask.hybrid(asked, {"bm25": ask.keyword_route(chunks)})[0])
    said = agents.reasoned(asked, evidence, model).first()
    assert said.reasoning.answer == "a raven" and said.reasoning.confidence == 0.0 and "corvid speaks quill" in said.evidence
    assert agents.reasoned(asked, evidence.limit(0), model).first().reasoning.limitations == "retrieval_empty"
    calls = tmp_path / "calls"

    def counting(prompt):
        with calls.open("a") as f:
            f.write("x")
        return "{}"

    many = spark.createDataFrame([(i, "corvid quill" if i == 1 else "zzz") for i in range(20)], "query_id long, text string")
    got = agents.reasoned(many, evidence, counting).collect()
    assert len(got) == 20 and calls.read_text() == "x" and sum(r.reasoning.limitations == "retrieval_empty" for r in got) == 19
    events = agents.event_rows(many.where("query_id < 3"), {"bm25": ask.keyword_route(chunks)}, lambda p: iter(["a ", "raven"])).orderBy("query_id", "seq").collect()
    assert [(e.query_id, e.type, e.text) for e in events if e.type == "token"] == [(0, "token", agents.NO_EVIDENCE), (1, "token", "a "), (1, "token", "raven"), (2, "token", agents.NO_EVIDENCE)]
    assert json.loads([e.data for e in events if e.query_id == 1][1]) == {"bm25_count": 1} and [e.type for e in events if e.query_id == 1][-2:] == ["answer_end", "done"]
    checked = agents.verified(asked.withColumns({"answer": F.lit("x"), "sources": F.array(F.lit("s"))}), model).first().verification
    assert (checked.is_supported, checked.confidence, checked.issues) == (False, 0.0, [])
    events = list(agents.answer_events(asked, {"bm25": ask.keyword_route(chunks)}, lambda p: iter(["a ", "raven"]), model))
    assert [e["type"] for e in events] == ["phase", "phase", "answer_start", "token", "token", "answer_end", "done"] and events[1]["data"]["bm25_count"] == 1
    assert events[-1]["data"]["sources"] == ["corvid speaks quill"]
    empty = list(agents.answer_events(asked, {}, lambda p: iter(["never"])))
    assert [e["text"] for e in empty if e["type"] == "token"] == [agents.NO_EVIDENCE]
    frames = list(agents.event_frames(iter(events)))
    assert frames[0].startswith("event: phase\ndata: {") and all(f.endswith("\n\n") for f in frames)

    def breaks():
        yield events[0]
        raise RuntimeError("gone")

    assert [f.split("\n")[0] for f in agents.event_frames(breaks())] == ["event: phase", "event: error"]


def test_tools_and_access(spark):
    described = {r.name: (r.read_only, json.loads(r.descriptor)) for r in tools.tool_list(spark).collect()}
    assert list(described) == ["search.vector", "search.bm25", "search.kg", "search.web", "orchestrate.ask"]
    read_only, first = described["search.vector"]
    assert read_only and list(first) == ["name", "description", "inputSchema", "outputSchema", "annotations", "metadata"] and first["metadata"] == {"route": "vector"}
    assert first["annotations"] == {"readOnlyHint": True, "idempotent": True, "openWorld": False} and first["inputSchema"]["required"] == ["query"]
    writing = tools.described(tools.service_tools(spark).withColumn("writes", F.lit(True))).first()
    assert not writing.read_only and not json.loads(writing.descriptor)["annotations"]["readOnlyHint"]
    assert tools.planned_tools() == ["retrieve_vector", "retrieve_bm25", "retrieve_kg"] and tools.planned_tools(False, True)[-1] == "retrieve_web"
    rows = spark.createDataFrame([("a",), (None,), ("z",)], "key string")
    assert [r[0].status for r in rows.select(checks.access(F.col("key"), True, "a, b")).collect()] == [200, 401, 401]
    assert [r[0].status for r in rows.select(checks.access(F.col("key"), True, " ,")).collect()] == [503] * 3
    assert "s3cret" not in rows.select(checks.access(F.col("key"), True, "s3cret, b"))._jdf.queryExecution().toString()
    assert checks.asserted(rows, F.lit(True), "fine").count() == 3
    with pytest.raises(Exception, match="no key"):
        checks.asserted(rows, F.col("key").isNotNull(), "no key").collect()
    bad = spark.createDataFrame([("[1, {\"text\": \"t\", \"support\": 3}]",), ("nope",), (None,), ("{\"k\": 1}",), ("[{\"text\": \"t\", \"evidence_ids\": [\"e\"], \"x\": 1}]",)], "t string")
    assert [[tuple(c) for c in r[0]] for r in bad.select(outputs.coerced_claims(F.col("t"))).collect()] == [[], [], [], [("k", [], "unsupported")], [("t", ["e"], "supported")]]
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}\+00:00", spark.range(1).select(outputs.now_iso()).first()[0])


def test_guarded_route(spark):
    now, calls = [0.0], []

    def down(queries, k):
        calls.append(now[0])
        raise RuntimeError("down")

    asked = spark.createDataFrame([(1, "x")], "query_id long, text string")
    route = ask.Guarded(down, failures=2, seconds=30, clock=lambda: now[0])
    for t in (0, 1, 2, 31.5, 40):
        now[0] = float(t)
        assert route(asked, 5).count() == 0
    assert calls == [0.0, 1.0, 31.5]  # open after the second failure, tried again when it has rested, open again
    engine = ask.Engine({"kg": down, "web": down}, disabled=frozenset({"web"}))
    assert engine.plan() == ["kg"]


def test_segmenter_and_stream(spark):
    docs = spark.createDataFrame([(1, "图谱检索"), (2, "向量检索"), (3, "图表"), (4, "其他"), (5, "More")], "doc_id long, text string")
    index = search.keyword_index(docs, True, segment=lambda t: F.split(t, ""))
    assert [r.chunk_id for r in index.search(spark.createDataFrame([(0, "图谱")], "query_id long, text string")).orderBy("rank").collect()] == [1, 3]
    chunks = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    s = Service(spark, chunks, chunks, chunks, chunks, ask.Engine({"bm25": ask.keyword_route(docs)}))
    frames = list(s.stream(spark.createDataFrame([(0, "其他")], "query_id long, text string"), lambda prompt: iter(["yes"])))
    assert frames[-1].startswith("event: done") and s.tools().count() == 5


def test_whole_bench(spark):
    chunks = spark.createDataFrame([("c1", "corvid speaks quill daily", ["corvid"]), ("c2", "lattice uses granite", ["lattice"])], "chunk_id string, content string, entities array<string>")
    asked = spark.createDataFrame([(1, "Does the Corvid speaks quill?"), (2, "lattice granite")], "query_id long, text string")
    triples = spark.createDataFrame([("corvid", "SPEAKS", "quill")], "head string, relation string, tail string")
    planted = spark.createDataFrame([(1, "distractor:1", "corvid speaks other daily")], "case_id long, chunk_id string, content string")
    gold = asked.where("query_id = 1").crossJoin(chunks.where("chunk_id = 'c1'")).select("query_id", "chunk_id", "content")
    row = bench.run(asked, chunks, triples, planted, gold).first()
    assert row.questions == 2 and row.mean_ps == 1.0 and row.misled_rate == 0.0 and row.cases == 1
    assert {(r.query_id, r.name) for r in bench.named_in(asked, chunks.select(F.explode("entities").alias("name"))).collect()} == {(1, "corvid"), (2, "lattice")}
    assert bench.run(asked, chunks, triples, planted, gold, cases=lambda q, g, d: bench.adversarial_cases(q, g, d, strip=False)).first().misled_rate == 1.0
