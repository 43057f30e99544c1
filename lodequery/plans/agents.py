"""Model calls around retrieval: analysis of questions, reasoning over evidence, verification, and answers as a stream.

A model is a function from a prompt to a text, given by the caller and called in Arrow batches. What it returns is read as
JSON and typed with defaults, so that a call that fails, or answers anything else, costs its own row's fields alone.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import outputs, rules
from ..operators import fusion
from .ask import Retriever, hybrid

Model = Callable[[str], str]
#: The types of a stream's events, in order, and its phases; a stream may end with an error instead.
PHASES, EVENTS = ("analysis", "retrieval"), ("phase", "answer_start", "token", "answer_end", "done", "error")
#: Rows of evidence that reasoning sees, sources that verification and the end of a stream see, and characters of these.
EVIDENCE, SOURCES, SOURCE_CHARS = 10, 5, 200
NO_EVIDENCE = "There is not enough in the knowledge base to answer this question."
NO_ANSWER = "What is known doesn't suffice for an answer."


def called(model: Model, prompt: Column) -> Column:
    """The model's JSON object for each prompt; `{}` where a call fails."""

    def safe(p: str | None) -> str:
        try:
            return model(p or "") or "{}"
        except Exception:  # as a model that can't be reached
            return "{}"

    @F.pandas_udf("string")
    def call(prompts: pd.Series) -> pd.Series:
        return pd.Series([safe(p) for p in prompts], dtype=object)

    return F.coalesce(rules.json_object(call(prompt)), F.lit("{}"))


def analysed(queries: DataFrame, model: Model) -> DataFrame:
    """queries (query_id, text) with analysis."""
    return queries.withColumn("__said", called(model, F.col("text"))).withColumn("analysis", outputs.analysis(F.col("__said"), F.col("text"))).drop("__said")


def evidence_texts(fused: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """(query_id, evidence, sources): the first rows of each query's fused evidence as one text, and their first contents."""
    line = rules.evidence_line(F.col("rank"), F.element_at("matched_by", 1), F.col("fusion_score"), F.col("content"))
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"), "content")))
    grouped = fused.where(F.col("rank") <= most).groupBy("query_id").agg(rows.alias("rows"))
    return grouped.select("query_id", F.array_join(F.transform("rows", lambda r: r["line"]), "\n\n").alias("evidence"), F.transform(F.slice("rows", 1, SOURCES), lambda r: r["content"]).alias("sources"))


def reasoned(queries: DataFrame, evidence: DataFrame, model: Model) -> DataFrame:
    """queries with reasoning over (query_id, evidence, sources); without evidence the model isn't asked."""
    met = queries.join(evidence, "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit("")))
    prompt = F.concat(F.lit("Answer from the evidence alone, with the numbers of what you use, as JSON (answer, reasoning_path, sources_used, confidence, limitations).\n\nQuestion: "), "text", F.lit("\n\nEvidence:\n"), "evidence")
    # a condition around a Python function doesn't hold its calls back, so the rows part ways
    asked = met.where("evidence != ''").withColumn("__said", called(model, prompt))
    empty = F.lit(json.dumps({"answer": NO_EVIDENCE, "reasoning_path": ["nothing was found"], "limitations": "retrieval_empty"}))
    both = asked.unionByName(met.where("evidence = ''").withColumn("__said", empty))
    return both.withColumn("reasoning", outputs.reasoning(F.col("__said"), NO_ANSWER)).drop("__said")


def verified(answers: DataFrame, model: Model) -> DataFrame:
    """answers (query_id, text, answer, sources) with verification: whether the first sources bear the answer."""
    numbered = F.array_join(F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s)), "\n")
    prompt = F.concat(F.lit("Do the sources bear the answer? As JSON (is_supported, hallucination_detected, confidence, issues, source_mapping).\n\nQuestion: "), "text", F.lit("\n\nAnswer: "), "answer", F.lit("\n\nSources:\n"), numbered)
    return answers.withColumn("verification", outputs.verification(called(model, prompt)))


def answer_events(question: DataFrame, routes: dict[str, Retriever], stream: Callable[[str], Iterator[str]], analyse: Model | None = None, verify: Model | None = None, k: int = 10) -> Iterator[dict]:
    """One question (a row query_id, text) as a stream: analysis, retrieval, the answer's tokens as they come, and the end.

    Everything here is of one question and bounded by k, so it is the driver's to send.
    """
    silent: Model = lambda prompt: "{}"
    found = analysed(question, analyse or silent).select("query_id", "text", "analysis").first()
    analysis = found["analysis"].asDict()
    yield {"type": "phase", "phase": "analysis", "data": analysis}
    asked = question.sparkSession.createDataFrame([(found["query_id"], analysis["query_rewrite"])], question.select("query_id", "text").schema)
    fused, counts, warnings = hybrid_counts(asked, routes, k)
    yield {"type": "phase", "phase": "retrieval", "data": {**{f"{name}_count": n for name, n in counts.items()}, "warnings": warnings}}
    evidence = evidence_texts(fused).first()
    yield {"type": "answer_start"}
    said = []
    for token in stream(f"Question: {found['text']}\n\nEvidence:\n{evidence['evidence']}") if evidence else [NO_EVIDENCE]:
        said.append(token)
        yield {"type": "token", "text": token}
    yield {"type": "answer_end"}
    sources = list(evidence["sources"]) if evidence else []
    row = question.sparkSession.createDataFrame([(found["query_id"], found["text"], "".join(said), sources)], f"query_id {question.schema['query_id'].dataType.simpleString()}, text string, answer string, sources array<string>")
    checked = verified(row, verify or silent).first()["verification"].asDict()
    yield {"type": "done", "data": {"sources": [s[:SOURCE_CHARS] for s in sources], "confidence": checked["confidence"], "verification": checked, "analysis": analysis}}


def streamed(answer: Callable[[str], Iterator[str]], prompt: Column) -> Column:
    """The tokens that a model yields for each prompt."""

    @F.pandas_udf("array<string>")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series([list(answer(p)) for p in prompts], dtype=object)

    return run(prompt)


def event_rows(queries: DataFrame, routes: dict[str, Retriever], answer: Callable[[str], Iterator[str]], analyse: Model | None = None, verify: Model | None = None, k: int = 10) -> DataFrame:
    """(query_id, seq, type, text, data): the events that a stream of each question's answer has, for many questions at once.

    text is a phase's name or a token; data is JSON, as answer_events has it. A question without evidence isn't sent to the
    model that answers; its one token says so.
    """
    silent: Model = lambda prompt: "{}"
    found = analysed(queries.select("query_id", "text"), analyse or silent)
    fused, _, hits = hybrid(found.select("query_id", F.col("analysis.query_rewrite").alias("text")), routes, k)
    counts = hits.groupBy("query_id").pivot("route", list(routes)).count().select("query_id", F.struct(*(F.coalesce(F.col(r), F.lit(0)).alias(f"{r}_count") for r in routes)).alias("counts"))
    met = found.join(evidence_texts(fused), "query_id", "left")
    prompt = F.concat(F.lit("Question: "), "text", F.lit("\n\nEvidence:\n"), "evidence")
    told = met.where("evidence IS NOT NULL").withColumn("tokens", streamed(answer, prompt)).unionByName(met.where("evidence IS NULL").withColumn("tokens", F.array(F.lit(NO_EVIDENCE))))
    checked = verified(told.withColumn("answer", F.array_join("tokens", "")), verify or silent).join(counts, "query_id", "left")
    nothing = F.lit(None).cast("string")
    event = lambda kind, text=None, data=None: F.struct(F.lit(kind).alias("type"), (nothing if text is None else text).alias("text"), (nothing if data is None else data).alias("data"))
    shown = F.transform(F.coalesce("sources", F.array().cast("array<string>")), lambda x: F.substring(x, 1, SOURCE_CHARS))
    done = F.to_json(F.struct(shown.alias("sources"), "verification.confidence", "verification", "analysis"))
    events = F.concat(
        F.array(event("phase", F.lit(PHASES[0]), F.to_json("analysis")), event("phase", F.lit(PHASES[1]), F.to_json("counts")), event("answer_start")),
        F.transform("tokens", lambda t: event("token", t)), F.array(event("answer_end"), event("done", None, done)),
    )
    return checked.select("query_id", F.posexplode(events).alias("seq", "e")).select("query_id", "seq", "e.*")


def hybrid_counts(queries: DataFrame, routes: dict[str, Retriever], k: int) -> tuple[DataFrame, dict[str, int], list[str]]:
    """Fused evidence, how many hits each route gave, and warnings."""
    fused, warnings, hits = hybrid(queries, routes, k)
    counts = {r["route"]: r["count"] for r in hits.groupBy("route").count().collect()}
    return fused, {name: counts.get(name, 0) for name in routes}, warnings


def event_frames(events: Iterator[dict]) -> Iterator[str]:
    """Server-sent events: a frame for each, closed by an empty line; an error ends the stream with a frame of its own."""
    try:
        for e in events:
            yield f"event: {e['type']}\ndata: {json.dumps(e, ensure_ascii=False)}\n\n"
    except Exception as e:  # the client has had a status by now; all that is left is to say so
        yield f"event: error\ndata: {json.dumps({'type': 'error', 'message': str(e)}, ensure_ascii=False)}\n\n"
