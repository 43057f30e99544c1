"""Questions from retrieval to audited answer, many at once, with the rewrite loop as a bounded driver loop.

Each stage is a table; every stage leaves one audit row for each question that passes it.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules, tokens
from ..operators import answers as A
from ..operators import fusion, search
from ..tables import written

#: What finds hits: (queries, k) -> hits with content.
Retriever = Callable[[DataFrame, int], DataFrame]


HIT = "route string, chunk_id string, score double, rank int, content string"


def gathered(queries: DataFrame, routes: dict[str, Retriever], k: int) -> tuple[DataFrame, list[str]]:
    """The hits of all routes that work, in order, and a warning for each that doesn't; none may work.

    A route's hits are written before they are joined with others, so that a failure in its tasks is its own.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    found, warnings = queries.sparkSession.createDataFrame([], f"query_id {kind}, {HIT}"), []
    for name, route in routes.items():
        try:
            hits = written(route(queries, k).select("query_id", "route", F.col("chunk_id").cast("string").alias("chunk_id"), F.col("score").cast("double").alias("score"), "rank", "content"), "route")
        except Exception as e:  # whatever a route fails at, the others go on
            warnings.append(f"{name}: {str(e).splitlines()[0] if str(e) else type(e).__name__}")
            continue
        found = found.unionByName(hits)
    return fusion.in_order(found), warnings


class Guarded:
    """A route that rests after `failures` calls in a row have failed: for `seconds` it finds nothing, without being called."""

    def __init__(self, route: Retriever, failures: int = 5, seconds: float = 30.0, clock: Callable[[], float] = time.monotonic):
        self.route, self.failures, self.seconds, self.clock = route, failures, seconds, clock
        self.run, self.until = 0, float("-inf")

    def __call__(self, queries: DataFrame, k: int) -> DataFrame:
        kind = queries.schema["query_id"].dataType.simpleString()
        nothing = queries.sparkSession.createDataFrame([], f"query_id {kind}, {HIT}")
        if self.clock() < self.until:
            return nothing
        try:
            hits = written(self.route(queries, k).select(nothing.columns), "guarded")
        except Exception:  # as a service that doesn't answer
            self.run += 1
            if self.run >= self.failures:
                self.until = self.clock() + self.seconds
            return nothing
        self.run = 0
        return hits


@dataclass
class Engine:
    retrievers: dict[str, Retriever]
    hits_before, hits_after, max_rewrites = 20, 5, rules.MAX_REWRITES
    use: float = rules.USE
    rewrite_from: float = rules.REWRITE
    scorer: Callable | None = None
    crag_scorer: Callable | None = None
    auditor: Callable | None = None
    rerank: bool = True
    disabled: frozenset[str] = frozenset()
    rewriter: Callable = field(default=lambda text, n: F.concat(text, F.lit(f" (rewrite {n})")))
    generator: Callable | None = None

    def plan(self) -> list[str]:
        """The tools that a question is sent to: all that aren't disabled."""
        return [name for name in self.retrievers if name not in self.disabled]

    def retrieve(self, queries: DataFrame, k: int | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
        """All routes' hits in order, the best few after merging and reranking, and warnings of routes that failed."""
        hits, warnings = gathered(queries, {name: self.retrievers[name] for name in self.plan()}, self.hits_before)
        first = F.struct("score", -F.col("ord"))
        best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max_by("route", first).alias("route"), F.max_by("content", first).alias("content"), F.min("ord").alias("ord"))
        pool = fusion.ranked(best, "score", None)
        k = k or self.hits_after
        fused = fusion.reranked(pool, queries, k, self.scorer) if self.rerank else pool.where(F.col("rank") <= k).withColumn("rerank_score", F.lit(None).cast("double"))
        return hits, fused, warnings

    def ask(self, questions: DataFrame, k: int | None = None) -> dict[str, DataFrame]:
        """answers, claims, citations, verdicts, decisions, audit and the rest of questions (query_id, text); `warnings` is a table too.

        An auditor, given (answers, evidence), may return citations (query_id, chunk_id, pos); where it fails, they are found by rule.
        """
        spark, warned = questions.sparkSession, []
        open_, final, decisions, audit, all_hits, rewrites = questions.select("query_id", "text"), None, None, None, None, None
        for n in range(self.max_rewrites + 1):
            hits, fused, warnings = self.retrieve(open_, k)
            warned += [(n, w) for w in warnings]
            fused = written(fused, "fused")
            judged = fusion.crag(fused, open_, use=self.use, rewrite=self.rewrite_from, scorer=self.crag_scorer)
            gated = written(judged.withColumn("decision", rules.decision_gated(F.col("decision"), F.lit(n), self.max_rewrites)).withColumn("rewrites", F.lit(n)), "judged")
            done = gated.where("decision != 'rewrite'")
            mine = fused.join(done.select("query_id"), "query_id", "left_semi")
            steps = open_.select("query_id").withColumn("node", F.explode(F.array(*map(F.lit, ("planner", "retriever", "evaluator") if n == 0 else ("rewriter", "retriever", "evaluator"))))).withColumn("round", F.lit(n))
            union = lambda a, b: b if a is None else a.unionByName(b)
            final, decisions, audit, all_hits = union(final, mine), union(decisions, done), union(audit, steps), union(all_hits, hits.withColumn("round", F.lit(n)))
            if n < self.max_rewrites:
                again = gated.where("decision = 'rewrite'").select("query_id")
                open_ = written(open_.join(again, "query_id", "left_semi").withColumn("text", self.rewriter(F.col("text"), n + 1)), "open")
                rewrites = union(rewrites, open_.select("query_id", F.col("text").alias("rewrite"), F.lit(n + 1).alias("seq")))
        shown = rules.shown_score(F.col("rerank_score"), F.col("score"))
        line = rules.evidence_line(F.col("rank"), F.col("route"), shown, F.coalesce("content", F.lit("")))
        evidence = final.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("evidence"), F.count("*").alias("n"))
        judged = questions.join(decisions.select("query_id", "score", "decision", "rewrites"), "query_id").join(evidence, "query_id", "left")
        base = judged.withColumns({"evidence": F.coalesce("evidence", F.lit("(no evidence)")), "n": F.coalesce("n", F.lit(0))})
        skeleton = F.concat(F.col("n").cast("string"), F.lit(" passages bear on: "), F.col("text"))
        composed = self.generator(base) if self.generator else skeleton
        said = base.withColumn("answer", F.when(F.col("decision") == "use", composed).otherwise(rules.fallback_answer(F.col("text"), F.col("score"), F.col("rewrites"))))
        used = said.where("decision = 'use'")
        citations = final.join(used.select("query_id"), "query_id", "left_semi").select("query_id", F.col("rank").alias("pos"), F.coalesce("chunk_id", F.col("rank").cast("string")).alias("chunk_id"), F.substring(F.coalesce("content", F.lit("")), 1, 120).alias("span"), shown.alias("confidence"))
        used = written(used, "answers")
        cited = self._cited(used.select("query_id", "answer"), final, warned)
        claims = written(A.heuristic_claims(used.select("query_id", "answer"), cited, final.select("query_id", "chunk_id", "content")), "claims")
        warn, none = F.lit("warn"), F.lit(0).cast("long")
        fallen = said.where("decision != 'use'").select("query_id", warn.alias("auditor_verdict"), warn.alias("verdict"), none.alias("claims"), none.alias("unsupported"))
        verdicts = A.verdicts(used, claims, cited).unionByName(fallen)
        tail = said.select("query_id", F.explode(F.when(F.col("decision") == "use", F.array(F.lit("generator"), F.lit("auditor"))).otherwise(F.array(F.lit("fallback")))).alias("node"), F.col("rewrites").alias("round"))
        return {
            "answers": said.select("query_id", "answer", "score", "decision", "rewrites"),
            "citations": citations,
            "cited": cited,
            "claims": claims,
            "verdicts": verdicts,
            "audit": audit.unionByName(tail),
            "hits": all_hits,
            "fused": final,
            "rewrites": rewrites,
            "records": decision_records(decisions),
            "warnings": spark.createDataFrame(warned, "round int, warning string"),
        }

    def _cited(self, answers: DataFrame, evidence: DataFrame, warned: list) -> DataFrame:
        if self.auditor is not None:
            try:
                return written(self.auditor(answers, evidence).select("query_id", F.col("chunk_id").cast("string").alias("chunk_id"), "pos"), "cited")
            except Exception as e:
                warned.append((self.max_rewrites, f"auditor_failed: {e}"))
        return written(A.audited(answers, evidence), "cited")


def decision_records(decisions: DataFrame) -> DataFrame:
    """A record for each decision (query_id, score, rewrites): the branch by either rule, and the reason in words."""
    score, n = F.col("score"), F.col("rewrites")
    branch, capped = rules.decision_score_first(score, n), rules.decision_cap_first(score, n)
    reason = F.format_string("score %.4f after %d rewrites: %s", score, n.cast("int"), branch)
    return decisions.select("query_id", score.alias("confidence_score"), n.alias("rewrite_count"), branch.alias("branch"), capped.alias("branch_cap_first"), reason.alias("reasoning"))


def keyword_route(chunks: DataFrame, key: str = "doc_id", text: str = "text") -> Retriever:
    counts: list[search.TextScan] = []  # taken once for all rounds of questions

    def find(queries: DataFrame, k: int) -> DataFrame:
        if not counts:
            counts.append(search.text_scan(chunks, False, key, text))
        hits = counts[0].search(queries, k)
        if hits is None:
            hits = search.bm25(queries, chunks, k, key, text)
        return hits.join(chunks.select(F.col(key).alias("chunk_id"), F.col(text).alias("content")), "chunk_id")

    return find


def vector_route(chunks: DataFrame, vectors: DataFrame, query_vectors: DataFrame, key: str = "doc_id", text: str = "text") -> Retriever:
    """vectors: (key, embedding); query_vectors: (query_id, embedding)."""

    def find(queries: DataFrame, k: int) -> DataFrame:
        asked = query_vectors.join(queries.select("query_id"), "query_id", "left_semi")
        return search.vector_search(asked, vectors.withColumnRenamed(key, "chunk_id"), k).join(chunks.select(F.col(key).alias("chunk_id"), F.col(text).alias("content")), "chunk_id")

    return find


def hybrid(queries: DataFrame, routes: dict[str, Retriever], k: int = 5, budget: int = fusion.BUDGET) -> tuple[DataFrame, list[str], DataFrame]:
    """The first generation's search: every route that works, weighted fusion, context within the budget. With warnings and hits."""
    hits, warnings = gathered(queries, routes, k)
    return fusion.compressed(fusion.weighted(hits, k), budget), warnings, hits


def embedded_route(chunks: DataFrame, vectors: DataFrame, embedder: Callable[[str], list[float]], dims: int | None = None, key: str = "doc_id", text: str = "text") -> Retriever:
    """vector_route whose query vectors an injected embedder makes; a query that it fails at, or that gets other dimensions, finds nothing."""

    def find(queries: DataFrame, k: int) -> DataFrame:
        return vector_route(chunks, vectors, embedded(queries, embedder, dims), key, text)(queries, k)

    return find


def embedded(queries: DataFrame, embedder: Callable[[str], list[float]], dims: int | None = None) -> DataFrame:
    """(query_id, embedding) of (query_id, text)."""

    def safe(text: str | None) -> list[float] | None:
        try:
            v = [float(x) for x in embedder(text or "")]
        except Exception:  # costs this query's vector alone
            return None
        return v if dims is None or len(v) == dims else None

    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series([safe(t) for t in texts], dtype=object)

    return queries.select("query_id", embed("text").alias("embedding")).where("embedding is not null")


def query_entities(queries: DataFrame, recogniser: Callable[[str], list[str]] | None = None) -> DataFrame:
    """(query_id, pos, name): lower-cased entities that an injected recogniser finds; without one, tokens of two characters or more."""
    found = tokens.query_entities(F.coalesce("text", F.lit("")))
    if recogniser is not None:

        @F.pandas_udf("array<string>")
        def recognise(texts: pd.Series) -> pd.Series:
            return pd.Series([[str(x).lower() for x in recogniser(t or "") if x] for t in texts], dtype=object)

        found = recognise("text")
    return queries.select("query_id", F.posexplode(found).alias("pos", "name"))
