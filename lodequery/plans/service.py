"""The service's calls as functions of tables: each returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import graph, search
from ..operators.chunking import fixed_chunks, ingest_rows
from ..sources.files import files, parsed, upload_gate
from . import agents, tools
from .ask import Engine


class Service:
    """Chunks (chunk_id, doc_id, chunk_index, content), vectors, nodes and edges, and an engine for questions."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, vectors: DataFrame, nodes: DataFrame, edges: DataFrame, engine: Engine):
        self.spark, self.chunks, self.vectors, self.nodes, self.edges, self.engine = spark, chunks, vectors, nodes, edges, engine

    def upload(self, path: str) -> tuple[DataFrame, DataFrame]:
        """Chunks of the accepted files under a path, and the rejected files with the reason."""
        gate = upload_gate(parsed(files(self.spark, path)), text="full_text")
        docs = gate.where("rejected is null and error is null").select(F.col("file_hash").alias("doc_id"), F.col("full_text").alias("text"), "file_name")
        return ingest_rows(fixed_chunks(docs)), gate.where("rejected is not null or error is not null").select("file_name", F.coalesce("error", "rejected").alias("reason"))

    def ask(self, questions: DataFrame, top_k: int | None = None) -> dict[str, DataFrame]:
        return self.engine.ask(questions, top_k)

    def stream(self, question: DataFrame, model: Callable[[str], Iterator[str]], top_k: int = 10) -> Iterator[str]:
        """The answer to one question (a row query_id, text) as server-sent events; model yields the answer's tokens."""
        return agents.event_frames(agents.answer_events(question, {n: self.engine.retrievers[n] for n in self.engine.plan()}, model, k=top_k))

    def tools(self) -> DataFrame:
        return tools.tool_list(self.spark)

    def vector_search(self, queries: DataFrame, top_k: int = 5) -> DataFrame:
        """queries (query_id, text) by hash embedding."""
        return search.vector_search(queries.select("query_id", keys.hash_embedding(F.col("text")).alias("embedding")), self.vectors, graph.clamp(top_k, 1, 50))

    def graph_stats(self) -> DataFrame:
        return graph.stats(self.nodes, self.edges)

    def entity(self, name: str, depth: int = 2) -> DataFrame:
        return graph.neighbours(self.nodes, self.edges, self.spark.createDataFrame([(name,)], "name string"), depth)

    def path(self, source: str, target: str, depth: int = 3) -> DataFrame:
        return graph.paths_between(self.edges, self.spark.createDataFrame([(source, target)], "source string, target string"), depth)

    def graph(self, limit: int = 500, kind: str = "all") -> tuple[DataFrame, DataFrame]:
        shown = graph.exported_nodes(self.nodes, self.edges, limit, kind)
        return shown, graph.exported_links(shown, self.edges)

    def vector_stats(self) -> DataFrame:
        return self.vectors.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dims"))

    def status(self) -> DataFrame:
        count = lambda df, name: df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("store"), "rows", (F.col("rows") > 0).alias("ready"))
        return count(self.chunks, "chunks").union(count(self.vectors, "vectors")).union(count(self.nodes, "nodes")).union(count(self.edges, "edges"))

    def search_tool(self, name: str, queries: DataFrame, k: int = 5) -> DataFrame:
        """search.<route>, as tools call it."""
        return self.engine.retrievers[name.removeprefix("search.")](queries, k)
