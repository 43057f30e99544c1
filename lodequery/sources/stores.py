"""Stored indexes, static sources, the offline web route, and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions import keys, tokens
from ..operators.search import B, K1, KeywordIndex, document_frequencies, postings_of

WEB_CHARS = 2000


def append_vectors(table: DataFrame, path: str, key: str = "vec_id") -> None:
    """Append (key, embedding) at unit length; rows of other lengths than the first one's are an error."""
    sizes = [r[0] for r in table.select(F.size("embedding").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sizes}")
    table.select(key, keys.normalised(F.col("embedding")).alias("embedding")).write.mode("append").parquet(path)


def add_to_index(docs: DataFrame, path: str, fold: bool, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> None:
    """Add documents to the keyword index under a path, which may not exist yet.

    An addition is a part of its own: postings (sorted by term, so that a search prunes files), document frequencies, which
    add up over parts, and a row of totals, written last. A part without totals was interrupted and is not read.
    """
    part = uuid.uuid4().hex
    postings_of(docs, fold, key, text).repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/postings/part={part}")
    postings = docs.sparkSession.read.parquet(f"{path}/postings/part={part}")
    document_frequencies(postings).write.parquet(f"{path}/terms/part={part}")
    n = (docs.where(F.coalesce(F.col(text), F.lit("")) != "") if fold else docs).count()
    totals = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("tokens")).select(F.lit(n).alias("docs"), "tokens", F.lit(fold).alias("fold"), F.lit(k1).alias("k1"), F.lit(b).alias("b"))
    totals.withColumn("part", F.lit(part)).coalesce(1).write.mode("append").parquet(f"{path}/totals")


def save_index(docs: DataFrame, path: str, fold: bool, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B) -> None:
    """A new index; what is under the path is replaced."""
    where = docs.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(docs.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
    add_to_index(docs, path, fold, key, text, k1, b)


def load_index(spark: SparkSession, path: str) -> KeywordIndex:
    """The index under a path, ready to be searched; its parameters are those of the first part."""
    totals = spark.read.parquet(f"{path}/totals").orderBy("part").collect()
    parts = [r["part"] for r in totals]
    read = lambda name: spark.read.option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/part={p}" for p in parts)).drop("part")
    terms = read("terms").groupBy("term").agg(F.sum("df").alias("df"))
    return KeywordIndex(read("postings"), terms, sum(r["docs"] for r in totals), sum(r["tokens"] for r in totals), totals[0]["fold"], totals[0]["k1"], totals[0]["b"])


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by their type and edges by theirs, a folder for each; a search for one type reads that folder alone."""
    nodes.withColumn("label", F.col("type")).write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    edges.withColumn("rel_type", F.col("type")).write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes").drop("label"), spark.read.parquet(f"{path}/edges").drop("rel_type")


class Store:
    """Tables under a path that are read when they are first asked for. A store that can't be read is disconnected, and empty.

    schemas: what the tables hold, by name.
    """

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path, schemas
        self.error: str | None = None
        self._tables: dict[str, DataFrame] | None = None

    def _connect(self) -> dict[str, DataFrame]:
        if self._tables is None:
            try:
                self._tables, self.error = {n: self.spark.read.parquet(f"{self.path}/{n}") for n in self.schemas}, None
            except Exception as e:  # whatever is wrong with a store, the service goes on without it
                self.error = str(e).split("\n")[0]
                return {n: self.spark.createDataFrame([], s) for n, s in self.schemas.items()}
        return self._tables

    @property
    def connected(self) -> bool:
        self._connect()
        return self.error is None

    def __getitem__(self, name: str) -> DataFrame:
        return self._connect()[name]

    def close(self) -> None:
        """Forget the tables; the next use connects again."""
        self._tables = self.error = None


def graph_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, {"nodes": "name string, type string, confidence double, properties map<string,string>", "edges": "source string, target string, type string, edge_id string"})


def vector_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path, {"vectors": "chunk_id string, embedding array<double>", "chunks": "chunk_id string, content string"})


def load_vectors(spark: SparkSession, path: str, key: str = "vec_id", kind: str = "long") -> DataFrame:
    """The stored vectors (key, embedding); a store that can't be read is an empty one."""
    try:
        return spark.read.parquet(path)
    except Exception:  # as at the first start
        return spark.createDataFrame([], f"{key} {kind}, embedding array<double>")


def static_hits(spark: SparkSession, rows: list[tuple], k: int, route: str = "vector") -> DataFrame:
    """The first k of given hits (query_id, chunk_id, score, content) for each query."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, query_id long, chunk_id string, score double, content string")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).where(F.col("rank") <= k).drop("n").withColumn("route", F.lit(route))


def static_triples(spark: SparkSession, triples: list[tuple[str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of (head, relation, tail)."""
    t = spark.createDataFrame(triples, "source string, type string, target string").distinct()
    names = t.select(F.col("source").alias("name")).union(t.select("target")).distinct()
    return names.withColumn("type", F.lit("Entity")), t.withColumn("edge_id", F.md5(F.concat_ws("|", "source", "type", "target").cast("binary")))


def page_text(html: Column) -> Column:
    """What a page shows, roughly: without scripts, styles, comments and tags, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " "), "(?s)<[^>]*>", " ")
    return tokens.stripped(F.regexp_replace(bare, f"{tokens.BLANK}+", " "))


def web_hits(queries: DataFrame, pages: DataFrame, k: int = 5) -> DataFrame:
    """The web route over stored pages: query terms found in a page, best first; score 1 / rank, content of WEB_CHARS at most.

    Terms meet page tokens in an equi-join, so that only matching pages are counted.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens.folded_tokens(F.col("text")))).alias("term"))
    shown = pages.select("url", page_text(F.coalesce("html", F.lit(""))).alias("content"))
    found = shown.select("url", F.explode(F.array_distinct(tokens.folded_tokens(F.col("content")))).alias("term")).join(asked, "term").groupBy("query_id", "url").agg(F.count("*").alias("n"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "url"))).where(F.col("rank") <= k)
    return best.join(shown, "url").select("query_id", "rank", F.concat(F.lit("web:"), "url").alias("chunk_id"), F.lit("web").alias("route"), F.round(1 / F.col("rank"), 9).alias("score"), F.substring("content", 1, WEB_CHARS).alias("content"))


class WebSearchSource(DataSource):
    """spark.read.format("web_search"): options endpoint, query, limit; POSTs the query and reads results as rows."""

    @classmethod
    def name(cls) -> str:
        return "web_search"

    def schema(self) -> str:
        return "chunk_id string, score double, content string, title string"

    def reader(self, schema) -> DataSourceReader:
        return _WebReader(self.options)


class _WebReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def read(self, partition):
        import json
        import urllib.request

        body = json.dumps({"query": self.options["query"], "max_results": int(self.options.get("limit", "5"))}).encode()
        with urllib.request.urlopen(urllib.request.Request(self.options["endpoint"], body, {"Content-Type": "application/json"}), timeout=float(self.options.get("timeout", "10"))) as r:
            for i, x in enumerate(json.load(r).get("results", [])):
                yield f"web:{x.get('url', '')}", float(x.get("score") or 1 / (i + 1)), (x.get("content") or "")[:WEB_CHARS], x.get("title")


def payload_split(points: DataFrame, known: tuple[str, ...] = ("content", "doc_id", "source"), payload: str = "payload") -> DataFrame:
    """Known keys of a payload map as columns, the others as metadata."""
    rest = F.map_filter(payload, lambda k, v: ~k.isin(*known))
    return points.select(*(c for c in points.columns if c != payload), *(F.col(payload)[k].alias(k) for k in known), rest.alias("metadata"))


def markdown_report(title: str, *tables: tuple[str, DataFrame]) -> str:
    """Small results as a text with one table each."""
    out = [f"# {title}"]
    for name, df in tables:
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|") for v in r) + " |" for r in df.collect()]
    return "\n".join(out) + "\n"


def append_events(audit: DataFrame, path: str) -> None:
    """Each audit row as an event audit.<node>, appended to a table of events by day."""
    audit.withColumns({"event": F.concat(F.lit("audit."), "node"), "day": F.to_date("ts")}).write.mode("append").partitionBy("day").parquet(path)
