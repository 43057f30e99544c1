from lodequery.operators import answers as A
from lodequery.plans import bench
from lodequery.sources import stores

CHUNKS = [
    ("c01", "Corvid is a property store that speaks Quill as its query language.", ["Corvid", "Quill"]),
    ("c02", "Lattice is a search design that joins vectors with graph walks.", ["Lattice"]),
    ("c03", "Lattice uses Corvid as its default store in many open programs.", ["Lattice", "Corvid"]),
    ("c04", "科维德 Corvid 是一种图数据库，查询语言为 Quill。", ["Corvid", "Quill"]),
]
TRIPLES = [("Corvid", "speaks", "Quill"), ("Lattice", "stores_in", "Corvid"), ("Quill", "is", "Quill")]


def test_bench(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, content string, entities array<string>")
    questions = spark.createDataFrame([("q1", "Which query language does Corvid speak?"), ("q2", "Corvid 的查询语言是什么？"), ("q3", "zzz")], "query_id string, text string")
    parts = bench.answered(questions, chunks, spark.createDataFrame(TRIPLES, "head string, relation string, tail string"))
    cited = {}
    for r in sorted(parts["cited"].collect(), key=lambda r: r.pos):
        cited.setdefault(r.query_id, []).append(r.chunk_id)
    assert cited == {"q1": ["c01", "c03", "c04"], "q2": ["c04", "c01", "c03"], "q3": ["c01"]}
    assert {r.query_id: r.verdict for r in parts["verdicts"].collect()} == {"q1": "supported", "q2": "supported", "q3": "supported"}
    scores = {r.query_id: (r.recall, r.coverage, r.ps) for r in bench.scored(parts).collect()}
    assert scores == {q: (1.0, 1.0, 1.0) for q in ("q1", "q2", "q3")}
    assert {(r.seed, r.rendered) for r in parts["paths"].where("query_id = 'q1'").collect()} >= {("Quill", "Quill -[is]-> Quill"), ("Corvid", "Lattice -[stores_in]-> Corvid")}
    assert parts["paths"].where("query_id = 'q1' and seed = 'Quill'").count() == 2
    report = stores.markdown_report("Bench", ("KPI", A.provenance_summary(bench.scored(parts))))
    assert "| mean_ps | median_ps | pass_rate | questions |" in report and "| 1.0 | 1.0 | 1.0 | 3 |" in report


def test_adversarial_adapter_and_raw_rates(spark):
    questions = spark.createDataFrame([("a", "Which query language does Corvid speak?"), ("b", "Lattice default store?")], "query_id string, text string")
    gold = spark.createDataFrame([("a", "c01", CHUNKS[0][1]), ("b", "c03", CHUNKS[2][1])], "query_id string, chunk_id string, content string")
    planted = A.with_distractor(spark.createDataFrame([("a", CHUNKS[0][1], "Quill", "Pen"), ("b", CHUNKS[2][1], "Corvid", "Magpie")], "case_id string, content string, swap_from string, swap_to string"))
    kept = A.passes(A.adversarial(bench.adversarial_cases(questions, gold, planted))).first()
    assert (kept.misled_rate, kept.hallucination_rate, kept.distractor_visited_rate, kept.passes) == (0.0, 0.0, 1.0, True)
    raw = A.adversarial(bench.adversarial_cases(questions, gold, planted, strip=False)).first()
    assert raw.misled_rate == 1.0


def test_adversarial_golden(spark):
    names = "case_id string, distractor_id string, node_id string, cited array<string>, evidence array<string>, visited array<string>, verdict string"
    rate = lambda *r: tuple(A.adversarial(spark.createDataFrame([("x", *r)], names)).first())[:3]
    assert rate("d", "n", ["g"], ["g"], ["n"], "supported") == (0.0, 0.0, 1.0)
    assert rate("d", "n", ["d"], ["d"], ["n"], "supported") == (1.0, 1.0, 0.0)
    assert rate("d", "n", [], [], [], "unsupported") == (0.0, 1.0, 0.0)
    assert tuple(A.adversarial(spark.createDataFrame([], names)).first()) == (0.0, 0.0, 0.0, 0)


def test_provenance_golden(spark):
    said = spark.createDataFrame([(0, "Lattice uses Corvid. The moon is cheese.")], "query_id int, answer string")
    used = spark.createDataFrame([(0, "c1", 1)], "query_id int, chunk_id string, pos int")
    contents = spark.createDataFrame([(0, "c1", "Lattice uses Corvid daily")], "query_id int, chunk_id string, content string")
    claims = spark.createDataFrame([(0, 0, "Lattice uses Corvid.", ["c1"]), (0, 1, "The moon is cheese.", ["c1", "c9"]), (0, 2, " ", [])], "query_id int, claim_index int, claim string, evidence_ids array<string>")
    r = A.provenance(said, claims, used, contents).first()
    assert (r.recall, r.coverage, r.missing) == (0.5, round(3 / 7, 4), ["The moon is cheese."]) and r.ps == round(0.35 + 0.3 * (3 / 7) / 0.5, 4)
    r = A.provenance(said, claims, used, contents, entailer=lambda premise, hypothesis: 0.9 if "moon" in hypothesis else 0.0).first()
    assert r.recall == 1.0 and r.missing == []


def test_claims_without_contexts(spark):
    said = spark.createDataFrame([(0, "One. Two."), (1, "")], "query_id int, answer string")
    used = spark.createDataFrame([(0, "b", 2), (0, "a", 1)], "query_id int, chunk_id string, pos int")
    got = A.heuristic_claims(said, used, None).orderBy("claim_index").collect()
    assert [(r.claim, r.evidence_ids, r.support) for r in got] == [("One.", ["a", "b"], "supported"), ("Two.", ["a", "b"], "supported")]


def test_metrics_golden(spark):
    audit = spark.createDataFrame([(1, "planner"), (1, "retriever"), (1, "x")], "run_id int, node string")
    assert A.trace_completeness(audit).first().completeness == 0.5
    calls = spark.createDataFrame([(1, "a"), (1, "b")], "run_id int, tool string")
    assert A.tool_necessity(calls, calls.where("tool = 'a'")).first().necessity == 0.5
    runs = spark.createDataFrame([(1, "use"), (2, "fallback"), (1, "USE"), (0, "use")], "rewrites int, final_decision string")
    assert abs(A.fix_rate(runs).first().fix_rate - 2 / 3) < 1e-12 and A.fix_rate(runs.limit(0)).first().fix_rate == 0.0
    assert A.audit_coverage(audit, audit.union(spark.createDataFrame([(1, "auditor")], "run_id int, node string"))).first().coverage == 0.75
    means = A.external_means(spark.createDataFrame([("q",)], "question string"), {"good": lambda s: 1.0, "bad": lambda s: 1 / 0}).first()
    assert means.good == 1.0 and means.bad != means.bad


def test_trace_golden(spark):
    hits = spark.createDataFrame([(0, "vector", "a", 0.9, 1, None), (0, "bm25", "a", 0.8, 2, None), (0, "kg", "k", 0.7, 3, ["n1", "n2"]), (0, "bm25", "b", 0.1, 4, None), (0, "bm25", "b", 0.1, 5, None)], "query_id int, route string, chunk_id string, score double, ord int, visited array<string>")
    fused = spark.createDataFrame([(0, "a", 2, 0.5, 0.9), (0, "b", 1, 0.6, None)], "query_id int, chunk_id string, rank int, score double, rerank_score double")
    cited = spark.createDataFrame([(0, "a")], "query_id int, chunk_id string")
    rewrites = spark.createDataFrame([(0, "one", 1), (0, "two", 2)], "query_id int, rewrite string, seq int")
    got = A.retrieval_trace(hits, fused, cited, rewrites).orderBy("position").collect()
    assert [(r.chunk_id, r.route, r.cited, r.visited_node_count) for r in got] == [("a", "vector", True, 0), ("a", "bm25", True, 0), ("b", "bm25", False, 0), ("k", "kg", False, 2)]
    assert {r.rewritten_query for r in got} == {"two"}


def test_run_view_and_drawer(spark):
    audit = spark.createDataFrame([(1, "planner", 1), (1, "retriever", 2), (1, "planner", 3)], "run_id int, node string, seq int")
    edges = spark.createDataFrame([("planner", "retriever"), ("retriever", "evaluator")], "source string, target string")
    trace = spark.createDataFrame([(1, i, i == 3) for i in range(1, 15)], "run_id int, position int, cited boolean")
    assert [tuple(r) for r in A.run_view(audit, edges, trace).collect()] == [(1, "planner", "retriever", True)]
    one, rows = A.audit_drawer(audit, trace, "planner")
    assert one.first().seq == 1 and rows.count() == 10
    ids = spark.createDataFrame([("t",)], "trace_id string")
    assert A.incomplete_traces(ids, ids.union(spark.createDataFrame([("u",)], "trace_id string")), ids).count() == 1
