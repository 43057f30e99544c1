"""Decisions, defaults and formats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ENTITY_TYPES = ("Person", "Organization", "Product", "Technology", "Concept", "Document", "Event", "Location", "Entity")
RELATION_TYPES = ("USES", "BELONGS_TO", "DEPENDS_ON", "RELATED_TO", "CAUSES", "PART_OF", "COMPARES_WITH", "CONTAINS", "CREATED", "WORKS_FOR")
EXTENSIONS = (".pdf", ".docx", ".pptx", ".txt", ".md", ".jpg", ".jpeg", ".png", ".mp3", ".wav", ".mp4")
ROUTE_WEIGHTS = {"vector": 0.55, "bm25": 0.25, "graph": 0.20}
OTHER_WEIGHT = 0.1
USE, REWRITE = 0.7, 0.3
MAX_REWRITES = 2


def entity_type(label: Column) -> Column:
    return F.when(label.isin(*ENTITY_TYPES), label).otherwise("Entity")


def relation_type(label: Column) -> Column:
    return F.when(label.isin(*RELATION_TYPES), label).otherwise("RELATED_TO")


def confidence(value: Column) -> Column:
    """Null and zero count as 0.8."""
    return F.coalesce(F.nullif(value.cast("double"), F.lit(0.0)), F.lit(0.8))


def distance_score(distance: Column) -> Column:
    """0.7 over the distance, which is 1 at least."""
    return F.lit(0.7) / F.greatest(F.coalesce(distance, F.lit(1)), F.lit(1))


def graph_context(name: Column, kind: Column, distance: Column) -> Column:
    """Fixed format."""
    return F.concat(F.lit("实体: "), name, F.lit("; 类型: "), kind, F.lit("; 图谱距离: "), distance.cast("string"))


def route_weight(route: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, w in ROUTE_WEIGHTS.items():
        out = F.when(route == name, w).otherwise(out)
    return out


def sigmoid(x: Column) -> Column:
    """With the base 2.71828, a fixed value."""
    return 1 / (1 + F.pow(F.lit(2.71828), -x))


def decision(score: Column, use: float = USE, rewrite: float = REWRITE) -> Column:
    return F.when(score >= use, "use").when(score >= rewrite, "rewrite").otherwise("fallback")


def decision_score_first(score: Column, rewrites: Column) -> Column:
    """A good score is used however often the query was rewritten; only rewriting has a limit."""
    return F.when(score >= USE, "use").when((score >= REWRITE) & (rewrites < MAX_REWRITES), "rewrite").otherwise("fallback")


def decision_cap_first(score: Column, rewrites: Column, cap: int = MAX_REWRITES) -> Column:
    """Once the limit is reached the answer falls back, even with a good score."""
    return F.when(rewrites >= cap, "fallback").otherwise(decision(score))


def decision_gated(made: Column, rewrites: Column, cap: int = MAX_REWRITES) -> Column:
    """The router's rule: of decisions already made, only a rewrite beyond the limit becomes a fallback."""
    return F.when((made == "rewrite") & (rewrites >= cap), "fallback").otherwise(made)


def verdict(raw: Column) -> Column:
    low = F.lower(F.trim(raw))
    return F.when(low.isin("pass", "warn", "fail"), low).when(low.isin("unsupported", "hallucination"), "fail").otherwise("warn")


def effective_score(rerank: Column, score: Column) -> Column:
    return F.coalesce(rerank, score)


def shown_score(rerank: Column, score: Column) -> Column:
    """As effective_score, but a rerank score of zero counts as none."""
    return F.coalesce(F.nullif(rerank, F.lit(0.0)), score, F.lit(0.0))


def keyword_score(answer: Column, keywords: Column) -> Column:
    """The share of keywords that the answer contains in any case; 0 without keywords."""
    held = F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k)))
    return F.when(F.size(keywords) > 0, F.size(held) / F.size(keywords)).otherwise(0.0)


def evidence_line(i: Column, source: Column, score: Column, content: Column) -> Column:
    return F.format_string("[chunk:%d] (source=%s, score=%.3f)\n%s", i.cast("int"), source, score, content)


def link_target(url: Column, doc: Column, entity: Column) -> Column:
    """kind:value of what a node links to: its url, else its document, else itself."""
    return F.when(F.coalesce(url, F.lit("")) != "", F.concat(F.lit("url:"), url)).when(F.coalesce(doc, F.lit("")) != "", F.concat(F.lit("doc:"), doc)).otherwise(F.concat(F.lit("entity:"), entity))


def json_object(text: Column) -> Column:
    """The first candidate that parses to a JSON object: a ```json block, any fenced block, the whole text, first { to last }.

    Null if there is none.
    """
    out = F.lit(None).cast("string")
    whole = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    for candidate in (whole, F.trim(text), F.trim(F.regexp_extract(text, r"(?s)```[A-Za-z]*\s*(.*?)```", 1)), F.trim(F.regexp_extract(text, r"(?s)```json\s*(.*?)```", 1))):
        variant = F.try_parse_json(candidate)
        out = F.when(variant.isNotNull() & F.startswith(candidate, F.lit("{")), candidate).otherwise(out)
    return out


def answer_text(answer: Column, sources: Column, confident: Column, issues: Column) -> Column:
    """The answer with its sources, a note if confidence is under 0.6, and issues."""
    listed = lambda title, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n\n{title}:\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    return F.concat(answer, listed("Sources", sources), F.when(confident < 0.6, "\n\nNote: low confidence").otherwise(""), listed("Issues", issues))


def fallback_answer(question: Column, score: Column, rewrites: Column) -> Column:
    return F.format_string("The evidence for '%s' isn't sufficient (score %.2f after %d rewrites).", question, score, rewrites.cast("int"))
