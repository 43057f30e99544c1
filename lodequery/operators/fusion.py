"""Fusing, reranking and budgeting hits. Hits: query_id, route, chunk_id, score, rank, and where needed content and ord.

ord is the place of a hit in its query's list of all routes; ties in a score go to the hit seen first.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys, rules, tokens

ROUTES = ("vector", "bm25", "graph", "kg", "web")
RRF_K = 60
BUDGET = 6000


def in_order(hits: DataFrame) -> DataFrame:
    """hits with ord: by route as listed in ROUTES, then rank."""
    place = F.array_position(F.array(*map(F.lit, ROUTES)), F.col("route"))
    return hits.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy(place, "rank", "chunk_id")))


def ranked(df: DataFrame, score: str, k: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "ord")))
    return out if k is None else out.where(F.col("rank") <= k)


def weighted(hits: DataFrame, k: int = 5) -> DataFrame:
    """Sum of score times route weight over hits of equal content; the first one's payload; routes in the order they came."""
    mine = hits.where(F.length(F.coalesce("content", F.lit(""))) > 0).withColumn("key", keys.fingerprint(F.col("content")))
    worth = F.coalesce("score", F.lit(0.0)) * rules.route_weight(F.col("route"))
    by_route = mine.groupBy("query_id", "key", "route").agg(F.sum(worth).alias("s"), F.min("ord").alias("ord"), F.min_by(F.struct("chunk_id", "content"), "ord").alias("first"))
    fused = by_route.groupBy("query_id", "key").agg(F.round(F.sum("s"), 9).alias("fusion_score"), F.min_by("first", "ord").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "route"))), lambda x: x["route"]).alias("matched_by"), F.min("ord").alias("ord"))
    return ranked(fused, "fusion_score", k).select("query_id", "rank", "first.chunk_id", "first.content", "fusion_score", "matched_by")


def reciprocal_rank(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Sum of 1 / (k + rank in its route) by chunk id, or content key where there is none; payload of the best raw score. No limit."""
    mine = hits.withColumn("key", F.coalesce(F.nullif(F.col("chunk_id").cast("string"), F.lit("")), keys.content_key(F.col("content"))))
    fused = mine.groupBy("query_id", "key").agg(F.round(F.sum(1 / (k + F.col("rank"))), 9).alias("rrf_score"), F.max_by(F.struct("route", "content"), F.struct(F.coalesce("score", F.lit(0.0)), -F.col("ord"))).alias("best"), F.min("ord").alias("ord"))
    return ranked(fused, "rrf_score").select("query_id", "rank", "key", "best.route", "best.content", "rrf_score")


def merged(hits: DataFrame, k: int | None = None) -> DataFrame:
    """One hit for each chunk id, the best by score, in the order of first appearance; with k, the best k instead."""
    best = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max_by("route", F.struct("score", -F.col("ord"))).alias("route"), F.min("ord").alias("ord"))
    if k is not None:
        return ranked(best, "score", k).select("query_id", "rank", "chunk_id", "route", "score")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("ord"))).select("query_id", "rank", "chunk_id", "route", "score")


def compressed(evidence: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Rows of each query, by rank, while their contents fit into `budget` characters; the last is cut to fit."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    used = evidence.where(F.length(F.coalesce("content", F.lit(""))) > 0).withColumn("__used", F.coalesce(F.sum(F.length("content")).over(w), F.lit(0)))
    return used.where(F.col("__used") < budget).withColumn("content", F.expr(f"substring(content, 1, int({budget} - __used))")).drop("__used")


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the query's claim tokens that the content has: the scorer where none is given."""
    asked = tokens.claim_tokens(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens.claim_tokens(content))) / F.size(asked)).otherwise(0.0)


def reranked(hits: DataFrame, queries: DataFrame, k: int = 5, scorer: Callable[[str, list[str]], list[float]] | None = None) -> DataFrame:
    """The k best of each query by rerank_score; null counts as 0. scorer: (query, contents) -> scores, called with at most a batch.

    Where the scorer fails on a query, that query's hits keep their order and have no rerank_score.
    """
    met = hits.join(queries.select("query_id", F.col("text").alias("__query")), "query_id")
    if scorer is None:
        scored = met.withColumn("rerank_score", overlap_score(F.col("__query"), F.col("content")))
    else:

        @F.pandas_udf("double")
        def score(q: pd.Series, c: pd.Series) -> pd.Series:
            out = pd.Series(float("nan"), index=q.index)
            for query, at in q.groupby(q).groups.items():
                try:
                    out.loc[at] = [float(x) for x in scorer(query, c.loc[at].fillna("").tolist())]
                except Exception:  # no score says so
                    continue
            return out

        made = F.nanvl(score("__query", "content"), F.lit(None).cast("double"))
        scored = met.withColumn("rerank_score", made)
        failed = F.max(F.col("rerank_score").isNull()).over(Window.partitionBy("query_id"))  # batches may part a query's hits
        scored = scored.withColumn("__failed", failed).withColumn("rerank_score", F.when(~F.col("__failed"), F.col("rerank_score"))).drop("__failed")
    pre = scored.withColumn("pre_rank", F.col("rank")).withColumn("__r", F.coalesce("rerank_score", F.lit(0.0)))
    w = Window.partitionBy("query_id").orderBy(F.desc("__r"), F.when(F.col("rerank_score").isNull(), F.col("pre_rank")), "ord")
    return pre.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("__r", "__query")


def crag(hits: DataFrame, queries: DataFrame, alpha: float = 0.7, covered_from: float = 0.5, use: float = rules.USE, rewrite: float = rules.REWRITE, scorer: Callable[[str, list[str]], list[float]] | None = None) -> DataFrame:
    """relevance, coverage, score and decision for each query; without hits 0 and fallback.

    Relevance is the mean rerank score of hits that have one, else the mean score; coverage is the share of hits whose
    effective score reaches covered_from. scorer: (query, contents) -> scores, whose mean is the
    relevance instead; a query's few hits are one call.
    """
    if "rerank_score" not in hits.columns:
        hits = hits.withColumn("rerank_score", F.lit(None).cast("double"))
    effective = rules.effective_score(F.col("rerank_score"), F.col("score"))
    means = hits.groupBy("query_id").agg(F.coalesce(F.avg("rerank_score"), F.avg("score")).alias("relevance"), F.avg((effective >= covered_from).cast("double")).alias("coverage"), F.count("*").alias("hits"))
    if scorer is not None:
        gathered = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("content", F.lit("")).alias("content")))), lambda h: h["content"])

        @F.pandas_udf("double")
        def mean(q: pd.Series, contents: pd.Series) -> pd.Series:
            scores = [list(scorer(a, list(b))) for a, b in zip(q, contents, strict=True)]
            return pd.Series([sum(s) / len(s) if s else 0.0 for s in scores], dtype=float)

        by_query = hits.groupBy("query_id").agg(gathered.alias("contents")).join(queries.select("query_id", "text"), "query_id")
        means = means.drop("relevance").join(by_query.select("query_id", mean("text", "contents").alias("relevance")), "query_id")
    mixed = alpha * F.col("relevance") + (1 - alpha) * F.col("coverage")
    score = F.when(mixed.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed)))
    filled = queries.select("query_id").join(means, "query_id", "left").withColumn("score", F.round(F.coalesce(score, F.lit(0.0)), 6))
    return filled.select("query_id", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(F.coalesce("relevance", F.lit(0.0)), 6).alias("relevance"), F.round(F.coalesce("coverage", F.lit(0.0)), 6).alias("coverage"), "score", rules.decision(F.col("score"), use, rewrite).alias("decision"))
