"""Question answering by token overlap over a chunk table, and its benchmark: all questions at once.

Chunks: chunk_id, content, entities array. Questions: query_id, text. Triples: head, relation, tail.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import answers as A
from ..operators.graph import one_hop
from ..operators.mentions import mentions

TOP, VISITED = 3, 6


def overlap_ranking(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, overlap, rank): chunks by shared bench tokens, ties by id; the chunk of smallest id if none shares any.

    Tokens meet in an equi-join, so only chunks that share something are ranked; zeros matter for the visited ones alone and
    are filled up from the smallest ids.
    """
    q = questions.select("query_id", F.explode(tokens.bench_tokens(F.col("text"))).alias("t"))
    c = chunks.select("chunk_id", F.explode(tokens.bench_tokens(F.col("content"))).alias("t"))
    shared = q.join(c, "t").groupBy("query_id", "chunk_id").agg(F.count("*").alias("overlap"))
    first = [r[0] for r in chunks.select("chunk_id").orderBy("chunk_id").limit(2 * VISITED).collect()]
    zeros = questions.select("query_id").withColumn("chunk_id", F.explode(F.array(*map(F.lit, first)).cast("array<string>"))).join(shared, ["query_id", "chunk_id"], "left_anti").withColumn("overlap", F.lit(0).cast("long"))
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "chunk_id")
    return shared.unionByName(zeros).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= VISITED)


def cited(ranking: DataFrame) -> DataFrame:
    """(query_id, chunk_id, pos): the first three that share a token, else the first one."""
    best = F.max("overlap").over(Window.partitionBy("query_id"))
    kept = ranking.withColumn("best", best).where((F.col("rank") <= TOP) & ((F.col("overlap") > 0) | ((F.col("best") == 0) & (F.col("rank") == 1))))
    return kept.select("query_id", "chunk_id", F.col("rank").alias("pos"))


def answered(questions: DataFrame, chunks: DataFrame, triples: DataFrame) -> dict[str, DataFrame]:
    """ranking, cited, answers, claims, verdicts, paths, nodes and visited of all questions."""
    ranking = overlap_ranking(questions, chunks)
    used = cited(ranking)
    contexts = used.join(chunks.select("chunk_id", "content"), "chunk_id").select("query_id", "chunk_id", "content")
    said = used.where("pos = 1").join(chunks.select("chunk_id", "content"), "chunk_id").select("query_id", F.col("content").alias("answer"))
    claims = A.heuristic_claims(said, used, contexts)
    unsupported = claims.groupBy("query_id").agg(F.min(F.size("evidence_ids")).alias("least"))
    verdict = questions.select("query_id").join(unsupported, "query_id", "left").select("query_id", F.when(F.col("least") > 0, "supported").otherwise("unsupported").alias("verdict"))
    entities = chunks.select("chunk_id", F.explode("entities").alias("name"))
    named = named_in(questions, entities)
    seeds = named.union(used.join(entities, "chunk_id").select("query_id", "name")).distinct()
    paths = one_hop(triples, seeds)
    nodes = seeds.union(paths.select("query_id", "head")).union(paths.select("query_id", "tail")).distinct()
    visited = nodes.union(ranking.join(entities, "chunk_id").select("query_id", "name")).distinct()
    return {"ranking": ranking, "cited": used, "answers": said, "contexts": contexts, "claims": claims, "verdicts": verdict, "paths": paths, "nodes": nodes, "visited": visited}


def named_in(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, name): entities whose name a question's text contains, in any case."""
    return mentions(questions, entities, "query_id").select("query_id", "name")


def scored(parts: dict[str, DataFrame]) -> DataFrame:
    """Provenance of each question."""
    return A.provenance(parts["answers"], parts["claims"].select("query_id", "claim_index", "claim", "evidence_ids"), parts["cited"], parts["contexts"])


def run(questions: DataFrame, chunks: DataFrame, triples: DataFrame, distractors: DataFrame, gold: DataFrame, answer: Callable[..., dict[str, DataFrame]] = answered, cases: Callable[..., DataFrame] | None = None) -> DataFrame:
    """Both suites in a row: provenance of all questions, rates of all planted cases, and whether all of it passes.

    answer: what answers questions, (questions, chunks, triples) -> parts as of answered(); cases: what meets the planted chunks,
    (questions, gold, distractors) -> cases. The overlap answerer is the default for both.
    """
    summary = A.provenance_summary(scored(answer(questions, chunks, triples)))
    return A.bench_report(summary, A.adversarial((cases or adversarial_cases)(questions, gold, distractors)))


def adversarial_cases(questions: DataFrame, gold: DataFrame, distractors: DataFrame, strip: bool = True) -> DataFrame:
    """What the overlap answerer does with each case's own chunks (query_id, chunk_id, content) and its planted one.

    With strip, the planted chunk is taken out of citations and evidence before it is judged, which makes misled_rate 0 by
    construction; without, the rates say what the ranking alone achieves.
    """
    both = gold.select("query_id", "chunk_id", "content").union(distractors.select(F.col("case_id").alias("query_id"), "chunk_id", "content"))
    q = questions.select("query_id", tokens.bench_tokens(F.col("text")).alias("q"))
    ranked = both.join(q, "query_id").withColumn("overlap", F.size(F.array_intersect("q", tokens.bench_tokens(F.col("content"))))).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("overlap"), "chunk_id")))
    used = cited(ranked)
    contexts = used.join(both, ["query_id", "chunk_id"])
    said = contexts.where("pos = 1").select("query_id", F.col("content").alias("answer"))
    claims = A.heuristic_claims(said, used, contexts)
    planted = distractors.select(F.col("case_id").alias("query_id"), F.col("chunk_id").alias("distractor_id"))
    ids = used.groupBy("query_id").agg(F.collect_set("chunk_id").alias("cited"))
    evidence = claims.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("evidence_ids"))).alias("evidence"), F.min(F.size("evidence_ids")).alias("least"))
    out = planted.join(ids, "query_id", "left").join(evidence, "query_id", "left").withColumn("visited", F.array("distractor_id"))
    if strip:
        bare = lambda c: F.array_except(F.coalesce(c, F.array().cast("array<string>")), F.array("distractor_id"))
        out = out.withColumns({"cited": bare(F.col("cited")), "evidence": bare(F.col("evidence"))})
        verdict = F.when(F.size("cited") > 0, "supported").otherwise("unsupported")
    else:
        verdict = F.when(F.col("least") > 0, "supported").otherwise("unsupported")
    return out.select(F.col("query_id").alias("case_id"), "distractor_id", F.lit(None).cast("string").alias("node_id"), "cited", "evidence", "visited", verdict.alias("verdict"))
