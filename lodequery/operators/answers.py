"""Claims, provenance, audits, metrics and traces of answers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules, tokens
from .chunking import claim_array

MIN_OVERLAP = 2
EXPECTED_NODES = ("planner", "retriever", "evaluator", "auditor")


def heuristic_claims(answers: DataFrame, cited: DataFrame, contexts: DataFrame | None, least: int = MIN_OVERLAP) -> DataFrame:
    """(query_id, claim_index, claim, evidence_ids, support): each claim of an answer with the cited chunks that share `least` tokens.

    answers: query_id, answer; cited: query_id, chunk_id, pos; contexts: query_id, chunk_id, content (None: every claim has all
    that is cited). Evidence is in the order of citation.
    """
    parts = answers.select("query_id", F.posexplode(claim_array(F.col("answer"))).alias("claim_index", "claim"))
    met = parts.join(cited, "query_id", "left")
    if contexts is not None:
        texts = contexts.select("query_id", "chunk_id", F.col("content").alias("__content"))
        known = texts.select("query_id").distinct().withColumn("__any", F.lit(True))
        met = met.join(texts, ["query_id", "chunk_id"], "left").join(known, "query_id", "left")
        shared = F.size(F.array_intersect(tokens.claim_tokens(F.col("claim")), tokens.claim_tokens(F.col("__content"))))
        ok = F.col("chunk_id").isNotNull() & (F.col("__any").isNull() | (shared >= least))
    else:
        ok = F.col("chunk_id").isNotNull()
    ids = F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("pos", "chunk_id")))), lambda s: s["chunk_id"])
    made = met.groupBy("query_id", "claim_index", "claim").agg(ids.alias("evidence_ids"))
    return made.withColumn("support", F.when(F.size("evidence_ids") > 0, "supported").otherwise("unsupported"))


def is_supported(support, evidence_ids):
    return (support == "supported") & (F.size(evidence_ids) > 0)


def provenance(answers: DataFrame, claims: DataFrame, cited: DataFrame, contents: DataFrame, floor: float = 0.5, least: int = MIN_OVERLAP, recall_weight: float = 0.7, entailer: Callable[[str, str], float] | None = None, entailed_from: float = 0.4) -> DataFrame:
    """Per query: recall (claims whose evidence is cited and overlaps), coverage (answer tokens in cited texts), ps, missing claims.

    claims: query_id, claim_index, claim, evidence_ids; contents: query_id, chunk_id, content. The entailer is asked for those
    pairs only whose overlap isn't enough.
    """
    held = cited.select("query_id", "chunk_id").distinct().join(contents.where(F.coalesce("content", F.lit("")) != ""), ["query_id", "chunk_id"])
    real = claims.where(tokens.stripped(F.col("claim")) != "")
    pairs = real.select("query_id", "claim_index", "claim", F.explode("evidence_ids").alias("chunk_id")).join(held, ["query_id", "chunk_id"])
    ok = F.size(F.array_intersect(tokens.claim_tokens(F.col("claim")), tokens.claim_tokens(F.col("content")))) >= least
    pairs = pairs.withColumn("ok", ok)
    if entailer is not None:

        @F.pandas_udf("double")
        def entail(c: pd.Series, h: pd.Series) -> pd.Series:
            return pd.Series([float(entailer(a, b)) for a, b in zip(c, h, strict=True)])

        failed = pairs.where(~F.col("ok")).withColumn("ok", entail("content", "claim") >= entailed_from)
        pairs = pairs.where("ok").unionByName(failed)
    good = pairs.where("ok").select("query_id", "claim_index").distinct().withColumn("sufficient", F.lit(True))
    judged = real.join(good, ["query_id", "claim_index"], "left").withColumn("sufficient", F.coalesce("sufficient", F.lit(False)))
    missing = F.transform(F.array_sort(F.collect_list(F.when(~F.col("sufficient"), F.struct("claim_index", "claim")))), lambda s: s["claim"])
    recall = judged.groupBy("query_id").agg(F.avg(F.col("sufficient").cast("double")).alias("recall"), missing.alias("missing"))
    asked = answers.select("query_id", F.explode_outer(tokens.claim_tokens(F.col("answer"))).alias("t"))
    there = held.select("query_id", F.explode(tokens.claim_tokens(F.col("content"))).alias("t")).distinct().withColumn("hit", F.lit(1))
    coverage = asked.join(there, ["query_id", "t"], "left").groupBy("query_id").agg((F.count("hit") / F.greatest(F.count("t"), F.lit(1))).alias("coverage"))
    both = coverage.join(recall, "query_id", "left").withColumn("recall", F.coalesce("recall", F.lit(0.0)))
    bonus = F.when(F.col("coverage") >= floor, 1.0).otherwise(F.col("coverage") / floor)
    return both.select("query_id", F.round("recall", 4).alias("recall"), F.round("coverage", 4).alias("coverage"), F.round(recall_weight * F.col("recall") + (1 - recall_weight) * bonus, 4).alias("ps"), F.coalesce("missing", F.array().cast("array<string>")).alias("missing"))


def provenance_summary(scores: DataFrame, passing: float = 0.8) -> DataFrame:
    return scores.agg(F.round(F.avg("ps"), 4).alias("mean_ps"), F.round(F.median("ps"), 4).alias("median_ps"), F.round(F.avg((F.col("ps") >= passing).cast("double")), 4).alias("pass_rate"), F.count("*").alias("questions"))


def adversarial(cases: DataFrame) -> DataFrame:
    """Rates over cases: case_id, distractor_id, node_id, cited array, evidence array, visited array, verdict."""
    misled = F.coalesce(F.array_contains("cited", F.col("distractor_id")), F.lit(False))
    touched = F.coalesce(F.array_contains("evidence", F.col("distractor_id")), F.lit(False))
    lost = F.lower(F.coalesce("verdict", F.lit("unsupported"))).isin("hallucination", "unsupported") | touched
    seen = F.coalesce(F.array_contains("visited", F.coalesce("node_id", "distractor_id")), F.lit(False)) & ~misled
    rate = lambda c, name: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 4).alias(name)
    return cases.agg(rate(misled, "misled_rate"), rate(lost, "hallucination_rate"), rate(seen, "distractor_visited_rate"), F.count("*").alias("cases"))


def passes(report: DataFrame, misled: float = 0.1, hallucinated: float = 0.1, visited: float = 0.5) -> DataFrame:
    return report.withColumn("passes", (F.col("misled_rate") <= misled) & (F.col("hallucination_rate") <= hallucinated) & (F.col("distractor_visited_rate") >= visited))


def with_distractor(chunks: DataFrame, score: float = 0.85) -> DataFrame:
    """The planted chunk of each case: content with one phrase swapped (case_id, content, swap_from, swap_to)."""
    return chunks.select("case_id", F.concat(F.lit("distractor:"), "case_id").alias("chunk_id"), F.replace("content", F.col("swap_from"), F.col("swap_to")).alias("content"), F.lit(score).alias("score"))


def trace_completeness(audit: DataFrame) -> DataFrame:
    """(run_id, completeness): share of the expected nodes among a run's audit rows (run_id, node)."""
    hit = F.count_distinct(F.when(F.col("node").isin(*EXPECTED_NODES), F.col("node")))
    return audit.groupBy("run_id").agg((hit / len(EXPECTED_NODES)).alias("completeness"))


def _of_runs(shares: DataFrame, name: str, runs: DataFrame | None) -> DataFrame:
    """shares with 1 for the runs (run_id) that have none."""
    return shares if runs is None else runs.select("run_id").distinct().join(shares, "run_id", "left").withColumn(name, F.coalesce(name, F.lit(1.0)))


def tool_necessity(calls: DataFrame, cited: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, necessity): share of a run's distinct tools (run_id, tool) that its audit cites; 1 for runs without calls."""
    used = calls.select("run_id", "tool").distinct().join(cited.select("run_id", "tool").distinct().withColumn("hit", F.lit(1)), ["run_id", "tool"], "left")
    return _of_runs(used.groupBy("run_id").agg(F.round(F.count("hit") / F.count("*"), 4).alias("necessity")), "necessity", runs)


def audit_coverage(audit: DataFrame, decisions: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, coverage): share of a run's distinct deciding nodes that its audit has; 1 for runs without decisions."""
    made = decisions.select("run_id", "node").distinct().join(audit.select("run_id", "node").distinct().withColumn("hit", F.lit(1)), ["run_id", "node"], "left")
    return _of_runs(made.groupBy("run_id").agg(F.round(F.count("hit") / F.count("*"), 4).alias("coverage")), "coverage", runs)


def fix_rate(runs: DataFrame) -> DataFrame:
    """Share of runs with rewrites (rewrites, final_decision) that ended in use; 0 without any."""
    return runs.where("rewrites > 0").agg(F.coalesce(F.avg((F.lower(F.coalesce("final_decision", F.lit(""))) == "use").cast("double")), F.lit(0.0)).alias("fix_rate"), F.count("*").alias("rewritten_runs"))


def keyword_evaluation(answers: DataFrame) -> DataFrame:
    """(id, score) of answers (id, answer, keywords array)."""
    return answers.select("id", F.round(rules.keyword_score(F.coalesce("answer", F.lit("")), F.col("keywords")), 6).alias("score"))


def keyword_report(scores: DataFrame) -> DataFrame:
    """(average, answers) of keyword_evaluation; 0 without answers. `seconds`, if scores have it, is averaged too."""
    extra = [F.coalesce(F.avg("seconds"), F.lit(0.0)).alias("seconds")] if "seconds" in scores.columns else []
    return scores.agg(F.round(F.coalesce(F.avg("score"), F.lit(0.0)), 6).alias("average"), F.count("*").alias("answers"), *extra)


def bench_report(provenance_report: DataFrame, adversarial_report: DataFrame, target: float = 0.8) -> DataFrame:
    """Both suites' figures in a row, with all_pass: the mean provenance reaches its target and the adversarial rates pass."""
    met = provenance_report.crossJoin(passes(adversarial_report))  # a row each
    return met.withColumn("all_pass", F.col("passes") & (F.col("mean_ps") >= target))


def of_route(trace: DataFrame, route: str) -> DataFrame:
    """The rows of a retrieval trace that one route found."""
    return trace.where(F.col("route") == route)


def audited(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations of each answer (query_id, chunk_id, pos): chunks whose id the answer names, else the first three."""
    met = hits.join(answers.select("query_id", "answer"), "query_id").withColumn("named", F.contains("answer", F.col("chunk_id").cast("string")))
    some = F.max("named").over(Window.partitionBy("query_id"))
    return met.withColumn("some", some).where(F.col("named") | (~F.col("some") & (F.col("rank") <= 3))).select("query_id", "chunk_id", F.col("rank").alias("pos"))


def verdicts(answers: DataFrame, claims: DataFrame, cited: DataFrame) -> DataFrame:
    """(query_id, auditor_verdict, verdict, claims, unsupported)."""
    n = claims.groupBy("query_id").agg(F.count("*").alias("claims"), F.sum((~is_supported(F.col("support"), F.col("evidence_ids"))).cast("long")).alias("unsupported"))
    any_ = cited.select("query_id").distinct().withColumn("c", F.lit(True))
    raw = F.when(F.col("c"), "pass").otherwise("unsupported")
    out = answers.select("query_id").join(n, "query_id", "left").join(any_, "query_id", "left")
    return out.select("query_id", rules.verdict(raw).alias("auditor_verdict"), rules.verdict(raw).alias("verdict"), F.coalesce("claims", F.lit(0)).alias("claims"), F.coalesce("unsupported", F.lit(0)).alias("unsupported"))


def retrieval_trace(hits: DataFrame, fused: DataFrame, cited: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """A row for each (query_id, route, chunk_id) that was hit: raw and fused ranks, whether it is cited, latest rewrite, order.

    hits: with ord and visited (array, may be null); fused: query_id, chunk_id, rank, score, rerank_score; the last of equal
    fused ids counts.
    """
    first = hits.groupBy("query_id", "route", "chunk_id").agg(F.min("ord").alias("raw_rank"), F.min_by("score", "ord").alias("raw_score"))
    last = fused.groupBy("query_id", "chunk_id").agg(F.max("rank").alias("fused_rank"), F.max_by("score", "rank").alias("fused_score"), F.max_by("rerank_score", "rank").alias("rerank_score"))
    seen = hits.select("query_id", F.explode("visited").alias("n")).groupBy("query_id").agg(F.count_distinct("n").alias("seen"))
    named = cited.select("query_id", "chunk_id").distinct().withColumn("c", F.lit(True))
    out = first.join(last, ["query_id", "chunk_id"], "left").join(named, ["query_id", "chunk_id"], "left").join(seen, "query_id", "left")
    if rewrites is not None:
        out = out.join(rewrites.groupBy("query_id").agg(F.max_by("rewrite", "seq").alias("rewritten_query")), "query_id", "left")
    else:
        out = out.withColumn("rewritten_query", F.lit(None).cast("string"))
    out = out.withColumn("cited", F.coalesce("c", F.lit(False))).withColumn("visited_node_count", F.when(F.col("route") == "kg", F.coalesce("seen", F.lit(0))).otherwise(0).cast("long"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cited"), F.coalesce("fused_rank", F.lit(9999)), F.coalesce("raw_rank", F.lit(9999)), "route")
    return out.withColumn("position", F.row_number().over(w)).select("query_id", "position", "route", "chunk_id", "raw_rank", "raw_score", "fused_rank", "fused_score", "rerank_score", "cited", "visited_node_count", "rewritten_query")


def incomplete_traces(traces: DataFrame, steps: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows of steps and decisions that name no known trace."""
    ids = traces.select("trace_id")
    return steps.join(ids, "trace_id", "left_anti").select("trace_id", F.lit("step").alias("what")).union(decisions.join(ids, "trace_id", "left_anti").select("trace_id", F.lit("decision")))


def run_view(audit: DataFrame, pipeline_edges: DataFrame, trace: DataFrame) -> DataFrame:
    """Edges of the pipeline between nodes that a run's audit has, highlighted where anything in its trace is cited."""
    there = audit.select("run_id", "node").distinct()
    lit = trace.groupBy("run_id").agg(F.max("cited").alias("highlighted"))
    met = there.join(pipeline_edges, F.col("node") == F.col("source")).join(there.select(F.col("run_id").alias("r"), F.col("node").alias("t")), (F.col("run_id") == F.col("r")) & (F.col("target") == F.col("t")))
    return met.join(lit, "run_id", "left").select("run_id", "source", "target", F.coalesce("highlighted", F.lit(False)).alias("highlighted"))


def audit_drawer(audit: DataFrame, trace: DataFrame, node: str, rows: int = 10) -> tuple[DataFrame, DataFrame]:
    """The first audit row of a node in each run, and the first rows of each run's trace."""
    one = audit.where(F.col("node") == node).withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))).where("n = 1").drop("n")
    return one, trace.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy("position"))).where(F.col("n") <= rows).drop("n")


def external_means(samples: DataFrame, metrics: dict[str, Callable[[dict], float]]) -> DataFrame:
    """Means of injected per-sample metrics; a metric that fails on a sample counts as NaN there, no samples give 0."""
    names = list(metrics)

    def value(name: str, sample: dict) -> float:
        try:
            return float(metrics[name](sample))
        except Exception:
            return float("nan")

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([value(n, r) for r in rows], pa.float64()) for n in names], names=names)

    scored = samples.mapInArrow(run, ", ".join(f"`{n}` double" for n in names))
    return scored.agg(*(F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names))
