"""A property graph in two tables: nodes (name, type, confidence, ...) and edges (edge_id, source, target, type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, rules
from ..tables import written

BRANCHES = 8
#: Edges of a node in one slice of it, and nodes of several slices up to which they pass the driver and are broadcast.
HUB_EDGES, BROADCAST_HUBS = 2048, 50_000


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(high, x))


def upserted_nodes(old: DataFrame | None, new: DataFrame) -> DataFrame:
    """Nodes by (type, name), properties merged key by key with the last one winning, confidence of the last.

    new: name, type, confidence, properties map, seq; rows without a name are dropped, unknown types become Entity.
    """
    ok = new.where(F.coalesce(F.col("name"), F.lit("")) != "").withColumn("type", rules.entity_type(F.col("type"))).withColumn("confidence", rules.confidence(F.col("confidence")))
    rows = ok if old is None else old.withColumn("seq", F.lit(-1).cast("long")).unionByName(ok)
    props = rows.select("type", "name", "seq", F.explode("properties").alias("k", "v")).groupBy("type", "name", "k").agg(F.max_by("v", "seq").alias("v"))
    maps = props.groupBy("type", "name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("properties"))
    last = rows.groupBy("type", "name").agg(F.max_by("confidence", "seq").alias("confidence"))
    return last.join(maps, ["type", "name"], "left").withColumn("properties", F.coalesce("properties", F.create_map().cast("map<string,string>")))


def upserted_edges(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Edges by (source, type, target) between known names; unknown relation types become RELATED_TO.

    Endpoints meet nodes by name whatever the type, so each pair of equally named nodes is an edge of its own, and relations
    with an unknown end are dropped.
    """
    ok = relations.where((F.coalesce("source", F.lit("")) != "") & (F.coalesce("target", F.lit("")) != "")).select("source", "target", rules.relation_type(F.col("type")).alias("type")).distinct()
    a, b = (nodes.select(F.col("name").alias(s), F.col("type").alias(f"{s}_type")) for s in ("source", "target"))
    met = ok.join(a, "source").join(b, "target")
    return met.select("source", "source_type", "type", "target", "target_type", F.sha2(F.concat_ws("|", "source_type", "source", "type", "target_type", "target").cast("binary"), 256).substr(1, 16).alias("edge_id"))


def upsert_counts(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows that an upsert takes by type: entities with a name, and relations once for each pair of nodes that they meet."""
    ents = nodes.where(F.coalesce("name", F.lit("")) != "").groupBy(F.lit("entity").alias("what"), rules.entity_type(F.col("type")).alias("type")).agg(F.count("*").alias("rows"))
    a, b = (nodes.select(F.col("name").alias(s)) for s in ("source", "target"))
    rels = relations.join(a, "source").join(b, "target").groupBy(F.lit("relation").alias("what"), rules.relation_type(F.col("type")).alias("type")).agg(F.count("*").alias("rows"))
    return ents.union(rels)


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end; a loop once."""
    there = edges.select(F.col("source").alias("u"), F.col("target").alias("v"), "type", "edge_id")
    return there.union(edges.where("source != target").select("target", "source", "type", "edge_id"))


def _steps(edges: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Edges from either end with the slice of their node they belong to, and the nodes of several slices (u, slices), if any.

    A slice holds about HUB_EDGES edges, so a join by node and slice deals a hub's edges out to many tasks.
    """
    step = written(both_ways(edges), "steps")
    hubs = step.groupBy("u").agg(F.ceil(F.count("*") / HUB_EDGES).cast("int").alias("slices")).where("slices > 1")
    first = hubs.take(BROADCAST_HUBS + 1)
    if not first:
        return step, None
    hubs = written(hubs, "hubs") if len(first) > BROADCAST_HUBS else F.broadcast(edges.sparkSession.createDataFrame(first, hubs.schema))
    part = F.coalesce(F.pmod(F.xxhash64("edge_id"), F.col("slices")), F.lit(0)).cast("int")
    return step.join(hubs, "u", "left").select("u", "v", "type", "edge_id", part.alias("slice")), hubs


def _at(starts: DataFrame) -> DataFrame:
    """Trails without edges (start, end, nodes, rels, edge_ids), one for each start."""
    none = F.array().cast("array<string>")
    return starts.select("start", F.col("start").alias("end"), F.array("start").alias("nodes"), none.alias("rels"), none.alias("edge_ids"))


def _onward(now: DataFrame, step: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Trails with one more edge, which they don't hold yet."""
    by = ["end"]
    if hubs is not None:
        slices = F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)
        now, by = now.join(hubs.withColumnRenamed("u", "end"), "end", "left").withColumn("slice", F.explode(slices)).drop("slices"), ["end", "slice"]
    met = now.join(step.withColumnRenamed("u", "end"), by)
    more = lambda c, one: F.concat(c, F.array(one)).alias(c)
    fresh = met.where(~F.array_contains("edge_ids", F.col("edge_id")))
    return fresh.select("start", F.col("v").alias("end"), more("nodes", "v"), more("rels", "type"), more("edge_ids", "edge_id"))


def trails(edges: DataFrame, starts: DataFrame, depth: int, enough: int | None = None) -> DataFrame:
    """Undirected paths of 1 to depth edges, none of which repeats: start, end, depth, nodes, rels, edge_ids. Unrolled joins.

    enough: starts with so many paths already are not followed further, as longer ones would come after these.
    """
    step, hubs = _steps(edges)
    now, out = _at(starts.select(F.col("name").alias("start")).distinct()), None
    for _ in range(depth):
        if out is not None and enough is not None:
            done = out.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") >= enough).select("start")
            now = now.join(done, "start", "left_anti")
        now = _onward(now, step, hubs)
        out = now if out is None else out.union(now)
    return out.withColumn("depth", F.size("rels"))


def _reached(edges: DataFrame, starts: DataFrame, depth: int, limit: int) -> DataFrame:
    """(start, name, distance): least number of edges of a path without repeated edges, by distinct frontiers, a level at a time.

    Starts with `limit` names are not followed further. A start comes back to itself by a loop, two edges to one neighbour, or
    a triangle.
    """
    step = both_ways(edges).groupBy("u", "v").agg(F.count("*").alias("edges"))
    first = starts.select(F.col("name").alias("start")).distinct().join(step, F.col("start") == F.col("u")).select("start", F.col("v").alias("name"), "edges")
    reached = first.select("start", "name", F.lit(1).alias("distance"))
    others = first.where("name != start")
    for d in range(2, depth + 1):
        follow = reached.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") < limit).select("start")
        frontier = reached.where((F.col("distance") == d - 1) & (F.col("name") != F.col("start"))).join(follow, "start", "left_semi")
        ahead = frontier.select("start", F.col("name").alias("u")).join(step, "u").select("start", F.col("v").alias("name")).where("name != start").distinct()
        if d == 2:
            back = others.where("edges > 1").select("start").distinct()
        else:
            legs = others.select("start", F.col("name").alias("u")).join(step, "u").where("u != v").select("start", F.col("v").alias("name"))
            back = legs.join(others.select("start", "name"), ["start", "name"], "left_semi").select("start").distinct()
        more = ahead.union(back.join(follow, "start", "left_semi").select("start", F.col("start").alias("name"))).join(reached, ["start", "name"], "left_anti")
        reached = reached.union(more.withColumn("distance", F.lit(d)))
    return reached


def neighbours(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 2, limit: int = 50) -> DataFrame:
    """(start, name, type, distance): the nearest `limit` within depth; ties by name. The start may come back through a cycle."""
    near = _reached(edges, starts, clamp(depth, 1, 3), limit)
    w = Window.partitionBy("start").orderBy("distance", "name")
    kept = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")
    return kept.join(nodes.groupBy("name").agg(F.min("type").alias("type")), "name").select("start", "name", "type", "distance")


def paths_between(edges: DataFrame, pairs: DataFrame, depth: int = 3, limit: int = 5) -> DataFrame:
    """(source, target, rank, depth, path, rel_list): the shortest `limit` paths of each pair (source, target); ties by path.

    Trails grow from both ends in turn, each to half the depth, and meet in a join, so a hub between two names costs its edges
    and not their square. Of one name's trails of two edges to the same node only those are met that can be part of the first
    `limit` paths. Pairs that have `limit` paths are left out of longer ones. A pair of one name twice asks for cycles; null
    names have no path.
    """
    pairs, depth = written(pairs.select("source", "target").distinct(), "pairs"), clamp(depth, 1, 4)
    step, hubs = _steps(edges)
    side = lambda c: _at(pairs.select(F.col(c).alias("start")).distinct())
    ahead, back, opened, found = side("source"), side("target"), pairs, None
    ranked = Window.partitionBy("source", "target").orderBy("path", "rel_list")
    most = lambda *by: step.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    parallel = most("u", "v") * most("u", "edge_id") if depth > 2 else 1
    for d in range(1, depth + 1):
        grown, end = (ahead, "source") if d % 2 else (back, "target")
        grown = _onward(grown.join(opened.select(F.col(end).alias("start")).distinct(), "start", "left_semi"), step, hubs)
        grown = _first_trails(grown, d == 3, d, limit, parallel) if d > 2 else grown
        grown = written(grown, "trails") if d == 3 < depth else grown  # shorter ones are one join of a written table
        ahead, back = (grown, back) if d % 2 else (ahead, grown)
        paths = _met(ahead, back, opened).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit)
        now = paths.select("source", "target", F.lit(d).alias("depth"), "path", "rel_list")
        now = written(now, "paths") if d < depth else now
        found = now if found is None else found.union(now)
        if d == depth:
            break
        full = found.groupBy("source", "target").agg(F.count("*").alias("n")).where(F.col("n") >= limit)
        opened = pairs.join(full, ["source", "target"], "left_anti")
    w = Window.partitionBy("source", "target").orderBy("depth", "path", "rel_list")
    best = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return best.select("source", "target", "rank", "depth", "path", "rel_list")


def _first_trails(trails: DataFrame, ahead: bool, depth: int, limit: int, parallel: int) -> DataFrame:
    """Of trails of two edges, those that can be part of the first `limit` paths of `depth` edges between any two names.

    Among trails with the same ends, what comes first stays first whatever it is joined with, unless they have an edge in common.
    The other part has two edges at most, and each of them is in at most 2 `parallel` of these trails (`parallel`: edges between the
    same two nodes at most, times edges of a node with the same id at most), so limit + 4 parallel trails are enough. A path is compared as text: trails that paths begin with
    and whose names hold the arrow, or types the comma, between which that order isn't fixed, all stay.
    """
    nodes, rels = (F.col(c) if ahead else F.reverse(c) for c in ("nodes", "rels"))
    text = F.concat(F.array_join(nodes, "->"), F.lit("->" if ahead else f"@d{depth}"))
    types = F.concat(F.array_join(rels, ","), F.lit("," if ahead else ""))
    odd = F.exists("nodes", lambda x: F.contains(x, F.lit("->"))) | F.exists("rels", lambda x: F.coalesce(F.contains(x, F.lit(",")), F.lit(True)))
    marked = trails.withColumns({"text": text, "types": types, "odd": F.coalesce(odd, F.lit(True)) if ahead else F.lit(False)})
    w = Window.partitionBy("start", "end").orderBy("text", "types")
    kept = marked.where("not odd").withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit + 4 * parallel).drop("place")
    return (kept.unionByName(marked.where("odd")) if ahead else kept).select(trails.columns)


def _met(ahead: DataFrame, back: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, path, rel_list): trails from a pair's source that end where some from its target do, without a common edge."""
    there = ahead.select(F.col("start").alias("source"), F.col("end").alias("mid"), "nodes", "rels", "edge_ids").join(pairs, "source")
    here = back.select(F.col("start").alias("target"), F.col("end").alias("mid"), *(F.reverse(c).alias(f"{c}_back") for c in ("nodes", "rels", "edge_ids")))
    met = there.join(here, ["target", "mid"]).where(~F.arrays_overlap("edge_ids", "edge_ids_back"))
    nodes = F.concat("nodes", F.slice("nodes_back", 2, F.size("nodes_back")))
    return met.select("source", "target", keys.path_id(nodes).alias("path"), F.array_join(F.concat("rels", "rels_back"), ",").alias("rel_list"))


def entity_pairs(entities: DataFrame) -> DataFrame:
    """Pairs of each query's entities (query_id, pos, name) in the order they are named."""
    a, b = entities.select("query_id", F.col("pos").alias("i"), F.col("name").alias("source")), entities.select("query_id", F.col("pos").alias("j"), F.col("name").alias("target"))
    return a.join(b, "query_id").where("i < j").select("query_id", "source", "target")


def graph_search(nodes: DataFrame, edges: DataFrame, entities: DataFrame, depth: int = 2) -> DataFrame:
    """Contexts of each query: the neighbours of its entities, the first one for each name (by entity, then distance)."""
    found = neighbours(nodes, edges, entities.select("name"), depth).withColumnRenamed("name", "neighbour")
    met = entities.join(found, entities["name"] == found["start"]).select("query_id", "pos", "neighbour", "type", "distance")
    best = met.groupBy("query_id", "neighbour").agg(F.min_by(F.struct("type", "distance"), F.struct("pos", "distance")).alias("b"))
    content = rules.graph_context(F.col("neighbour"), F.col("b.type"), F.col("b.distance"))
    score = F.round(rules.distance_score(F.col("b.distance")), 9)
    return best.select("query_id", F.col("neighbour").alias("name"), "b.type", "b.distance", content.alias("content"), score.alias("score"))


def graph_search_paths(edges: DataFrame, entities: DataFrame, depth: int = 3, limit: int = 5) -> DataFrame:
    """(query_id, source, target, rank, depth, path, rel_list): the paths between each two of a query's entities, which graph_search
    goes with."""
    pairs = entity_pairs(entities).distinct()
    return pairs.join(paths_between(edges, pairs, depth, limit), ["source", "target"]).select("query_id", "source", "target", "rank", "depth", "path", "rel_list")


def path_record(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """paths (path_id, nodes, rels arrays) as records: arrays of nodes with their types, and of relations with both ends."""
    placed = paths.select("path_id", F.posexplode("nodes").alias("pos", "name")).join(nodes.groupBy("name").agg(F.min("type").alias("type")), "name", "left")
    listed = placed.groupBy("path_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type"))).alias("n"))
    rels = F.transform("rels", lambda r, i: F.struct(F.get(F.col("nodes"), i).alias("source"), F.get(F.col("nodes"), i + 1).alias("target"), r.alias("type")))
    return paths.join(listed, "path_id").select("path_id", F.size("rels").alias("depth"), F.transform("n", lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"))).alias("node_list"), rels.alias("rel_list"))


def shown_stats(shown: DataFrame, links: DataFrame) -> DataFrame:
    """(nodes, links, types): what a view of exported nodes and links counts."""
    return shown.agg(F.count("*").alias("nodes"), F.count_distinct("type").alias("types")).crossJoin(links.agg(F.count("*").alias("links"))).select("nodes", "links", "types")  # a row each


def labelled(shown: DataFrame, part: str) -> DataFrame:
    """Nodes whose label contains a text, in any case."""
    return shown.where(F.contains(F.lower("label"), F.lit(part.lower())))


def view(shown: DataFrame, attachments: bool = True, orphans: bool = True, existing: DataFrame | None = None) -> DataFrame:
    """Exported nodes as a view filters them: without documents (attachments), without those of no degree, only existing names."""
    kept = shown if attachments else shown.where("type != 'Document'")
    kept = kept if orphans else connected_only(kept)
    return kept if existing is None else kept.join(existing.select(F.col("name").alias("id")).distinct(), "id", "left_semi")


def stats(nodes: DataFrame, edges: DataFrame, top: int = 10) -> DataFrame:
    """(what, value): totals, and the `top` types by count."""
    kinds = nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(top).select(F.concat(F.lit("type:"), "type").alias("what"), F.col("n").alias("value"))
    return nodes.agg(F.count("*").alias("value")).select(F.lit("nodes").alias("what"), "value").union(edges.agg(F.count("*").alias("value")).select(F.lit("relations"), "value")).union(kinds)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("name")).union(edges.where("source != target").select("target"))
    return nodes.join(ends.groupBy("name").agg(F.count("*").alias("degree")), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def exported_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 500, kind: str = "all") -> DataFrame:
    """The `limit` (1 to 2000) nodes of the highest degree with what they link to; an unknown kind filters nothing."""
    kept = nodes.where(F.col("type") == kind) if kind != "all" and kind in rules.ENTITY_TYPES else nodes
    target = rules.link_target(F.col("properties")["source_url"], F.col("properties")["doc_id"], F.col("name"))
    first = degrees(kept, edges).orderBy(F.desc("degree"), "name").limit(clamp(limit, 1, 2000)).where(F.coalesce("name", F.lit("")) != "")
    name, confidence = F.col("name"), F.coalesce("confidence", F.lit(0.0))
    return first.select(name.alias("id"), name.alias("label"), "type", "degree", confidence.alias("confidence"), target.alias("source"))


def exported_links(shown: DataFrame, edges: DataFrame) -> DataFrame:
    ids = shown.select(F.col("id"))
    return edges.join(ids, F.col("source") == F.col("id"), "left_semi").join(ids, F.col("target") == F.col("id"), "left_semi").select("source", "target", F.col("type").alias("relation"), F.lit(0.5).alias("weight"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(name, neighbours): sorted distinct names on the other end of a node's edges."""
    return both_ways(edges).select("u", "v").distinct().groupBy(F.col("u").alias("name")).agg(F.array_sort(F.collect_list("v")).alias("neighbours"))


def connected_only(shown: DataFrame) -> DataFrame:
    """Without orphans."""
    return shown.where("degree > 0")


def path_hits(nodes: DataFrame, edges: DataFrame, entities: DataFrame, depth: int = 2, branches: int = BRANCHES, k: int = 20) -> DataFrame:
    """Path hits for each query (query_id, name in lower case): per seed the `branches` shortest paths, 4 k in all, k of them hits.

    Scores are reciprocal ranks. The first hit carries the sorted ids of all nodes that the query's paths visit.
    """
    seeds = entities.select("query_id", "name").distinct().join(nodes.select(F.col("name").alias("seed")).distinct(), F.col("name") == F.lower("seed"))
    found = trails(edges, seeds.select(F.col("seed").alias("name")), clamp(depth, 1, 4), branches).withColumn("path", keys.path_id(F.col("nodes"))).withColumn("rel_list", F.array_join("rels", ","))
    per_seed = Window.partitionBy("start").orderBy("depth", "path", "rel_list")
    few = found.withColumn("b", F.row_number().over(per_seed)).where(F.col("b") <= branches)
    w = Window.partitionBy("query_id").orderBy("depth", "path", "rel_list")
    met = seeds.join(few, F.col("seed") == F.col("start")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 4 * k)
    visited = met.select("query_id", F.explode("nodes").alias("n")).distinct().groupBy("query_id").agg(F.array_sort(F.collect_list("n")).alias("all_nodes"))
    hits = met.where(F.col("rank") <= k).join(visited, "query_id")
    seen = F.when(F.col("rank") == 1, F.col("all_nodes")).otherwise(F.col("nodes"))
    return hits.select(
        "query_id",
        "rank",
        keys.path_hit_id(F.col("nodes")).alias("chunk_id"),
        F.lit("kg").alias("route"),
        F.round(1 / F.col("rank"), 9).alias("score"),
        keys.rendered_path(F.col("nodes"), F.col("rels")).alias("content"),
        "depth",
        F.element_at("rels", 1).alias("relation"),
        F.array_join(seen, ",").alias("visited"),
    )


def one_hop(triples: DataFrame, seeds: DataFrame) -> DataFrame:
    """Triples (head, relation, tail) at each seed (query_id, name), from either end; a loop once for its seed."""
    at_head = seeds.join(triples, F.col("name") == F.col("head"))
    at_tail = seeds.join(triples.where("head != tail"), F.col("name") == F.col("tail"))
    return at_head.union(at_tail).select("query_id", F.col("name").alias("seed"), "head", "relation", "tail", keys.rendered_triple(F.col("head"), F.col("relation"), F.col("tail")).alias("rendered"))
