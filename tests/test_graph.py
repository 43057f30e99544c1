import random

from pyspark.sql import functions as F

from lodequery.functions import keys
from lodequery.operators import graph as G
from lodequery.sources import stores


def triangle(spark):
    return stores.static_triples(spark, [("A", "USES", "B"), ("B", "QUERIED_BY", "C"), ("C", "NEAR", "A"), ("D", "LOOP", "D")])


def test_trails_and_neighbours(spark):
    nodes, edges = triangle(spark)
    start = spark.createDataFrame([("A",)], "name string")
    got = {(r.name, r.distance) for r in G.neighbours(nodes, edges, start, 3).collect()}
    assert got == {("B", 1), ("C", 1), ("A", 3)}
    assert {tuple(r.nodes) for r in G.trails(edges, start, 2).collect()} == {("A", "B"), ("A", "C"), ("A", "B", "C"), ("A", "C", "B")}
    assert [tuple(r.nodes) for r in G.trails(edges, spark.createDataFrame([("D",)], "name string"), 3).collect()] == [("D", "D")]


def test_paths_and_hits(spark):
    nodes, edges = triangle(spark)
    got = G.paths_between(edges, spark.createDataFrame([("A", "C")], "source string, target string")).orderBy("rank").collect()
    assert [(r.path, r.rel_list) for r in got] == [("A->C@d1", "NEAR"), ("A->B->C@d2", "USES,QUERIED_BY")]
    hits = G.path_hits(nodes, edges, spark.createDataFrame([(0, "a"), (0, "zz")], "query_id int, name string"), k=3).orderBy("rank").collect()
    assert [r.content for r in hits] == ["A —[USES]→ B", "A —[NEAR]→ C", "A —[USES]→ B —[QUERIED_BY]→ C"]
    assert hits[0].visited == "A,B,C" and hits[2].chunk_id == "kg:A->...->C@d2" and hits[1].score == 0.5


def test_upserts(spark):
    new = spark.createDataFrame([("x", "Technology", 0.0, {"a": "1", "b": "1"}, 1), ("x", "Technology", 0.5, {"b": "2"}, 2), ("y", "Strange", None, {}, 3), ("", "Technology", 1.0, {}, 4), (None, "Concept", 1.0, {}, 5), ("x", "Person", 0.9, {}, 6)], "name string, type string, confidence double, properties map<string,string>, seq long")
    first = G.upserted_nodes(None, new)
    assert {(r.type, r.name, r.confidence, tuple(sorted(r.properties.items()))) for r in first.collect()} == {("Technology", "x", 0.5, (("a", "1"), ("b", "2"))), ("Entity", "y", 0.8, ()), ("Person", "x", 0.9, ())}
    again = G.upserted_nodes(first, new.where("seq = 1"))
    assert {r.properties["b"] for r in again.where("type = 'Technology'").collect()} == {"1"} and again.count() == 3
    rel = spark.createDataFrame([("x", "y", "USES"), ("x", "y", "USES"), ("x", "nobody", "USES"), ("x", "", "USES"), ("y", "y", "ODD")], "source string, target string, type string")
    edges = G.upserted_edges(first, rel)
    assert sorted((r.source_type, r.source, r.type, r.target) for r in edges.collect()) == [("Entity", "y", "RELATED_TO", "y"), ("Person", "x", "USES", "y"), ("Technology", "x", "USES", "y")]
    counts = {(r.what, r.type): r.rows for r in G.upsert_counts(first, rel).collect()}
    assert counts == {("entity", "Technology"): 1, ("entity", "Person"): 1, ("entity", "Entity"): 1, ("relation", "USES"): 4, ("relation", "RELATED_TO"): 1}


def test_export_search_stats(spark, tmp_path):
    nodes, edges = triangle(spark)
    full = nodes.withColumn("confidence", F.lit(0.9)).withColumn("properties", F.when(F.col("name") == "A", F.create_map(F.lit("source_url"), F.lit("http://a"))).otherwise(F.create_map().cast("map<string,string>")))
    shown = G.exported_nodes(full, edges, 2)
    assert [(r.id, r.degree, r.source) for r in shown.orderBy("id").collect()] == [("A", 2, "url:http://a"), ("B", 2, "entity:B")]
    assert [(r.source, r.relation, r.target) for r in G.exported_links(shown, edges).collect()] == [("A", "USES", "B")]
    assert G.exported_nodes(full, edges, 9, "Person").count() == 0 and G.exported_nodes(full, edges, 9, "unknown").count() == 4
    asked = spark.createDataFrame([(0, 1, "A"), (0, 2, "C")], "query_id int, pos int, name string")
    assert {(r.name, r.distance) for r in G.graph_search(nodes, edges, asked).collect()} == {("B", 1), ("C", 1), ("A", 1)}
    assert {r.what: r.value for r in G.stats(nodes, edges).collect()} == {"nodes": 4, "relations": 4, "type:Entity": 4}
    assert {r.name: r.neighbours for r in G.adjacency(edges).collect()} == {"A": ["B", "C"], "B": ["A", "C"], "C": ["A", "B"], "D": ["D"]}
    stores.save_graph(nodes, edges, str(tmp_path))
    assert [x.count() for x in stores.load_graph(spark, str(tmp_path))] == [4, 4]


def test_neighbours_like_trails(spark):
    """Distances by frontiers are those of the shortest paths without repeated edges, returns to the start included."""
    rng = random.Random(3)
    names = [f"n{i}" for i in range(14)]
    for density in (10, 22):
        rows = [(rng.choice(names), rng.choice(names), "USES", f"e{i}") for i in range(density)] + [("n0", "n1", "USES", "x1"), ("n0", "n1", "CAUSES", "x2")]
        edges = spark.createDataFrame(rows, "source string, target string, type string, edge_id string")
        starts = spark.createDataFrame([(n,) for n in names], "name string")
        for depth in (1, 2, 3):
            want = {(r.start, r.end): r.d for r in G.trails(edges, starts, depth).groupBy("start", "end").agg(F.min("depth").alias("d")).collect()}
            assert {(r.start, r.name): r.distance for r in G._reached(edges, starts, depth, 1000).collect()} == want
        nodes = starts.withColumn("type", F.lit("Entity"))
        few = {(r.start, r.name, r.distance) for r in G.neighbours(nodes, edges, starts, 3, 4).collect()}
        order = sorted((s, d, e) for (s, e), d in want.items())
        assert few == {(s, e, d) for i, (s, d, e) in enumerate(order) if sum(x[0] == s for x in order[:i]) < 4}
        pairs = spark.createDataFrame([(a, b) for a in names[:5] for b in names[5:8]], "source string, target string")
        found = {(r.source, r.target, r.rank): (r.depth, r.path) for r in G.paths_between(edges, pairs, 3, 2).collect()}
        every = G.trails(edges, starts, 3).select("start", "end", "depth", keys.path_id(F.col("nodes")).alias("p"), F.array_join("rels", ",").alias("r")).collect()
        for a in names[:5]:
            for b in names[5:8]:
                best = sorted((r.depth, r.p, r.r) for r in every if (r.start, r.end) == (a, b))[:2]
                assert [found[a, b, k + 1] for k in range(len(best))] == [x[:2] for x in best] and (a, b, len(best) + 1) not in found


def test_paths_like_trails(spark):
    """Paths from both ends are those of whole trails: cycles, loops, equal edges and null names included."""
    rng = random.Random(5)
    names = [f"n{i}" for i in range(9)]
    rows = [(rng.choice(names), rng.choice(names), rng.choice(["USES", "CAUSES"]), f"e{i}") for i in range(15)]
    edges = spark.createDataFrame(rows + [("n0", "n0", "USES", "loop"), ("n1", "n2", "USES", "x1"), ("n1", "n2", "USES", "x2")], "source string, target string, type string, edge_id string")
    pairs = [(a, b) for a in names[:4] for b in names] + [("n1", "n1"), ("n1", None), (None, "n1"), ("n1", "nobody")]
    asked = spark.createDataFrame(pairs + pairs[:3], "source string, target string")
    starts = spark.createDataFrame([(n,) for n in names], "name string")
    every = G.trails(edges, starts, 4).select("start", "end", "depth", keys.path_id(F.col("nodes")).alias("p"), F.array_join("rels", ",").alias("r")).collect()
    for depth, limit in ((1, 9), (2, 1), (3, 4), (4, 3), (4, 100_000)):
        got = sorted((r.source, r.target, r.rank, r.depth, r.path, r.rel_list) for r in G.paths_between(edges, asked, depth, limit).collect())
        want = []
        for a, b in set(pairs):
            best = sorted((r.depth, r.p, r.r) for r in every if (r.start, r.end) == (a, b) and r.depth <= depth)[:limit]
            want += [(a, b, i + 1, *x) for i, x in enumerate(best)]
        assert got == sorted(want)
    assert G.paths_between(edges.limit(0), asked).count() == G.paths_between(edges, asked.limit(0)).count() == 0


def test_paths_through_hub(spark):
    """A hub of 10,000 edges on the way of all pairs costs its edges, which are dealt out, and not their square."""
    hub = spark.range(10_000).select(F.concat(F.lit("leaf"), "id").alias("source"), F.lit("hub").alias("target"), F.lit("USES").alias("type"))
    legs = spark.createDataFrame([("a", "hub", "USES"), ("b", "hub", "USES"), ("leaf7", "c", "CAUSES"), ("leaf9", "d", "CAUSES")], "source string, target string, type string")
    edges = hub.union(legs).withColumn("edge_id", F.concat_ws("|", "source", "target"))
    step, _ = G._steps(edges)
    slices = {r.slice: r.n for r in step.where("u = 'hub'").groupBy("slice").agg(F.count("*").alias("n")).collect()}
    assert len(slices) == 5 and max(slices.values()) < 2 * G.HUB_EDGES and sum(slices.values()) == 10_002
    asked = spark.createDataFrame([("a", "b"), ("a", "c"), ("c", "d"), ("hub", "d")], "source string, target string")
    got = {(r.source, r.target): r.path for r in G.paths_between(edges, asked, 4).collect()}
    assert got == {("a", "b"): "a->hub->b@d2", ("a", "c"): "a->hub->leaf7->c@d3", ("c", "d"): "c->leaf7->hub->leaf9->d@d4", ("hub", "d"): "hub->leaf9->d@d2"}


def test_few_trails_of_a_hub_meet(spark, monkeypatch):
    """of the many trails to a hub only those meet that can be among the first paths; parallel edges and odd names change nothing."""
    rng = random.Random(11)
    names = [f"n{i}" for i in range(6)] + ["n1->n2", "n1-", ">n2", "n"]
    rows = [(rng.choice(names), rng.choice(names), rng.choice(["R", "S", "R,S", "A"])) for _ in range(30)]
    rows = [(a, b, t, f"e{i if rng.random() < 0.8 else 0}") for i, (a, b, t) in enumerate(rows)]
    kind = "source string, target string, type string, edge_id string"
    edges = spark.createDataFrame(rows, kind)
    asked = spark.createDataFrame([(a, b) for a in names[:3] for b in names[2:8]], "source string, target string")
    found = {}
    for r in G.trails(edges, asked.select(F.col("source").alias("name")), 4).withColumn("path", keys.path_id(F.col("nodes"))).collect():
        found.setdefault((r.start, r.end), []).append((r.depth, r.path, ",".join(r.rels)))
    for depth, limit in ((4, 3),):
        got = {}
        for r in G.paths_between(edges, asked, depth, limit).orderBy("rank").collect():
            got.setdefault((r.source, r.target), []).append((r.depth, r.path, r.rel_list))
        want = {(a, b): sorted(x for x in found.get((a, b), []) if x[0] <= depth)[:limit] for a, b in asked.collect()}
        assert got == {p: x for p, x in want.items() if x}, (depth, limit)
    star = [(a, f"{a}{i}", "R") for a in "AB" for i in range(60)] + [(f"{a}{i}", "hub", "S") for a in "AB" for i in range(60)]
    met, meet = [], G._met
    monkeypatch.setattr(G, "_met", lambda *x: met.append(meet(*x)) or met[-1])
    pair = spark.createDataFrame([("A", "B")], "source string, target string")
    paths = G.paths_between(spark.createDataFrame([(*x, "|".join(x)) for x in star], kind), pair, 4, 5).orderBy("rank").collect()
    assert [r.path for r in paths] == [f"A->A0->hub->{b}->B@d4" for b in sorted(f"B{i}" for i in range(60))[:5]]
    assert met[-1].count() <= 81  # 60 * 60 before
