"""Row generators: chunks, sentences, sections, claims, spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import keys, tokens
from ..tables import written

# Fixed values.
SENTENCE_END = "(?<=[。！？.!?])"
FENCES = r"(?s)```.*?```|\$\$.*?\$\$"
CLAIM_END = r"(?<=[。！？!?.])[ \t\n\x0B\f\r]+|(?<=[。！？])"
FENCE_LINE, HEADING, LEVELS = "^\\s*```", "^(#{1,6})\\s+(.*?)\\s*#*\\s*$", range(1, 7)
LINE_END = "\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
DEFAULT_SIZE, DEFAULT_OVERLAP = 512, 50
DEFAULT_TOKENS, DEFAULT_OVERLAP_TOKENS = 512, 64

Counter = Callable[[str], int]
CHUNKS = "chunk_index int, chunk_id string, content string, token_count int"


def fixed_chunks(docs: DataFrame, size: int = DEFAULT_SIZE, overlap: int = DEFAULT_OVERLAP, text: str = "text") -> DataFrame:
    """Windows of `size` characters every size - overlap characters; a text of at most `size` is one chunk. Null: no chunk."""
    overlap = overlap or DEFAULT_OVERLAP
    if not 0 < overlap < size:
        raise ValueError("overlap must be less than size")
    step, n = size - overlap, F.length(text)
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(step)))
    cut = docs.where(F.col(text).isNotNull()).select("*", F.posexplode(starts).alias("chunk_index", "__start"))
    return cut.withColumn("content", F.expr(f"substring(`{text}`, __start + 1, {size})")).drop("__start", text)


def sentence_array(text: Column) -> Column:
    """Stripped sentences; the whole text if there is none."""
    found = F.filter(F.transform(F.split(text, SENTENCE_END), tokens.stripped), lambda s: s != "")
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def sentences(docs: DataFrame, text: str = "text") -> DataFrame:
    rest = [c for c in docs.columns if c != text]
    return docs.where(F.col(text).isNotNull()).select(*rest, F.posexplode(sentence_array(F.col(text))).alias("sentence_index", "sentence"))


def estimate(text: str) -> int:
    cjk = sum("一" <= c <= "鿿" for c in text)
    return cjk + (len(text) - cjk) // 4


class Packer:
    """Packs sentences greedily under a token budget and carries an overlap from each chunk's end into the next.

    A piece is a sentence with its separator: a space, unless it opens a chunk or stands between two CJK characters.
    """

    def __init__(self, most: int = DEFAULT_TOKENS, overlap: int = DEFAULT_OVERLAP_TOKENS, count: Counter | None = None):
        if not 0 <= overlap < most:
            raise ValueError("overlap must be less than the budget")
        self.most, self.overlap, self.count = most, overlap, count or estimate

    @staticmethod
    def sentences(text: str) -> list[str]:
        return [s for s in (p.strip() for p in re.split(SENTENCE_END, text)) if s] or [text]

    def carried(self, pieces: list[str]) -> list[str]:
        """As many pieces from the end as the overlap holds, one at least."""
        used, k = 0, len(pieces)
        while k and (used + self.count(pieces[k - 1]) <= self.overlap or k == len(pieces)):
            k -= 1
            used += self.count(pieces[k])
        return pieces[k:] if self.overlap > 0 else []

    def chunks(self, text: str) -> Iterator[tuple[str, int]]:
        """Content and token count of each chunk. Each piece is counted once; the total runs along."""
        pieces: list[str] = []
        total, blank = 0, True  # blank: nothing but white space so far
        for sentence in self.sentences(text):
            joined = pieces and "一" <= pieces[-1][-1:] <= "鿿" and "一" <= sentence[:1] <= "鿿"
            piece = sentence if joined or not pieces else " " + sentence
            n = self.count(piece)
            if pieces and total + n > self.most:
                yield from self._chunk(pieces, total)
                pieces = [] if blank else self.carried(pieces)
                piece = sentence
                total, blank, n = sum(map(self.count, pieces)), not "".join(pieces).strip(), self.count(piece)
            pieces.append(piece)
            total, blank = total + n, blank and not piece.strip()
        yield from self._chunk(pieces, total)

    def _chunk(self, pieces: list[str], total: int) -> Iterator[tuple[str, int]]:
        if content := "".join(pieces).strip():
            yield content, total


def chunk_key(doc: object, index: int, content: str) -> str:
    return f"{doc}:{index}:{hashlib.sha256(f'{doc}|{index}|{content}'.encode()).hexdigest()[:12]}"


def _per_text(docs: DataFrame, key: str, text: str, fields: str, rows: Callable[[object, str], Iterator[tuple]]) -> DataFrame:
    names = [f.split()[0] for f in fields.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 256):
                part = f.iloc[at : at + 256]
                yield pd.DataFrame([(k, *r) for k, t in zip(part[key], part[text], strict=True) if t is not None for r in rows(k, t)], columns=[key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, {fields}")


def semantic_chunks(docs: DataFrame, most: int = DEFAULT_TOKENS, overlap: int = DEFAULT_OVERLAP_TOKENS, count: Counter | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed sentences of each document. The fold over sentences is sequential, so it runs in Python, a text at a time."""
    packer = Packer(most, overlap, count)

    def rows(doc: object, body: str) -> Iterator[tuple]:
        for i, (content, n) in enumerate(packer.chunks(body)):
            yield i, chunk_key(doc, i, content), content, n

    return _per_text(docs, key, text, CHUNKS, rows)


class ChunkRows:
    """The table function behind register_chunks: a row for each chunk of a text, none for a null one."""

    def eval(self, doc: str, text: str, most: int, overlap: int):
        if text is not None:
            for i, (content, n) in enumerate(Packer(most, overlap).chunks(text)):
                yield i, chunk_key(doc, i, content), content, n


def register_chunks(spark: SparkSession, name: str = "chunks_of") -> None:
    """Registers packing as a table function, so that it composes in SQL by a lateral join: name(doc, text, most, overlap)."""
    spark.udtf.register(name, F.udtf(ChunkRows, returnType=CHUNKS, useArrow=True))


def markdown_sections(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section_index, breadcrumbs array, content) of the sections of each markdown text that hold anything.

    Lines are rows. A line is code while the number of fence lines up to it is odd; a heading that isn't code opens a section.
    Of a section's headings so far, the last one of a level counts unless a shallower one came after it.
    """
    numbered = docs.where(F.col(text).isNotNull()).select(F.col(key), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    lines = numbered.select(key, "row", F.posexplode(F.split("text", LINE_END)).alias("pos", "line"))
    so_far = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(FENCE_LINE)
    marks = F.regexp_extract("line", HEADING, 1)
    level = F.when(~fence & (F.sum(fence.cast("int")).over(so_far) % 2 == 0) & F.col("line").rlike(HEADING), F.length(marks))
    leveled = lines.withColumn("level", level).withColumn("title", tokens.stripped(F.regexp_extract("line", HEADING, 2)))
    last = [F.max(F.when(F.col("level") == k, F.struct("pos", "title"))).over(so_far) for k in LEVELS]
    placed = leveled.withColumn("section", F.count("level").over(so_far)).withColumns({f"h{k}": c for k, c in zip(LEVELS, last, strict=True)})
    place = lambda k: F.coalesce(F.col(f"h{k}")["pos"], F.lit(-1))
    alive = [F.when(place(k) > F.greatest(F.lit(-1), *(place(j) for j in LEVELS if j < k), F.lit(-1)), F.col(f"h{k}")["title"]) for k in LEVELS]
    crumbs = F.filter(F.array(*alive), lambda t: t.isNotNull())
    own = placed.select(key, "row", "section", "pos", F.when(F.col("level").isNull(), F.col("line")).alias("line"), crumbs.alias("crumbs"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("pos", "line")))), lambda s: s["line"]), "\n")
    made = own.groupBy(key, "row", "section").agg(tokens.stripped(body).alias("content"), F.max_by("crumbs", "pos").alias("breadcrumbs")).where("content != ''")
    index = F.row_number().over(Window.partitionBy("row").orderBy("section")) - 1
    return made.select(key, index.alias("section_index"), "breadcrumbs", "content")


def markdown_chunks(docs: DataFrame, most: int = DEFAULT_TOKENS, overlap: int = DEFAULT_OVERLAP_TOKENS, count: Counter | None = None, atomic_fences: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Chunks of each section with its breadcrumbs; chunk_index starts again in each section, section_index tells them apart.

    With atomic_fences a section that holds a fence is one chunk, however long.
    """
    packer = Packer(most, overlap, count)

    def rows(doc: object, part: tuple) -> Iterator[tuple]:
        section, crumbs, content = part
        whole = atomic_fences and "```" in content
        for i, (chunk, n) in enumerate([(content, packer.count(content))] if whole else packer.chunks(content)):
            yield section, i, chunk_key(doc, i, chunk), chunk, n, " > ".join(crumbs), len(crumbs)

    parts = markdown_sections(docs, key, text).select(key, F.struct("section_index", "breadcrumbs", "content").alias("part"))
    return _per_text(parts, key, "part", f"section_index int, {CHUNKS}, breadcrumbs string, heading_depth int", lambda doc, p: rows(doc, (p["section_index"], p["breadcrumbs"], p["content"])))


def batches(rows: DataFrame, n: int, order: str, by: str | None = None) -> DataFrame:
    """rows with batch_index: successive rows, n at a time, in the order given (within each value of `by`).

    Without `by`, positions come from a range partitioning and its partitions' sizes, so that no task sees all rows.
    """
    if n < 1:
        raise ValueError("a batch holds one row at least")
    if by is not None:
        return rows.withColumn("batch_index", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1) / n))
    dealt = written(rows.repartitionByRange(order).withColumn("__part", F.spark_partition_id()), "batches")
    counts = dealt.groupBy("__part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", before.alias("__before"))  # a row for each partition
    local = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    return dealt.withColumn("__local", local).join(F.broadcast(offsets), "__part").withColumn("batch_index", F.floor((F.col("__before") + F.col("__local")) / n)).drop("__part", "__local", "__before")


def late_spans(chunks: DataFrame, key: str = "doc_id", order: str = "chunk_index", content: str = "content", tokens_of: Column | None = None) -> DataFrame:
    """token_start and token_end of each chunk: running sums of token counts within a document."""
    n = tokens.token_estimate(F.col(content)) if tokens_of is None else tokens_of
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    counted = chunks.withColumn("__n", n)
    return counted.withColumn("token_start", F.coalesce(F.sum("__n").over(before), F.lit(0)).cast("long")).withColumn("token_end", (F.col("token_start") + F.col("__n")).cast("long")).drop("__n")


def pooled(vectors: DataFrame, spans: DataFrame, how: str = "mean", position: str = "position", vector: str = "embedding") -> DataFrame:
    """A vector for each span (span_id, token_start, token_end) over token vectors: mean or max by dimension; none if the span is empty.

    A token meets a span by the blocks of positions that the span covers, which is an equi-join.
    """
    if how not in ("mean", "max"):
        raise ValueError(f"unknown pooling: {how}")
    block = 64
    covered = spans.where("token_end > token_start").withColumn("__b", F.explode(F.sequence(F.floor(F.col("token_start") / block), F.floor((F.col("token_end") - 1) / block))))
    inside = covered.join(vectors.withColumn("__b", F.floor(F.col(position) / block)), "__b").where((F.col(position) >= F.col("token_start")) & (F.col(position) < F.col("token_end")))
    dims = inside.select("span_id", F.posexplode(vector).alias("dim", "x")).groupBy("span_id", "dim").agg((F.avg if how == "mean" else F.max)(F.col("x").cast("double")).alias("x"))
    made = dims.groupBy("span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("pooled"))
    return spans.join(made, "span_id", "left").withColumn("pooled", F.coalesce("pooled", F.array().cast("array<double>")))


def contextualised(chunks: DataFrame, docs: DataFrame, context: Callable[[Column, Column], Column] | None = None, key: str = "doc_id", writer: Callable[[str, str], str] | None = None) -> DataFrame:
    """chunks with context and augmented_content: context, a blank line, the chunk; the chunk alone if the context is blank.

    context makes it from (document text, chunk) as columns; without one it is the document's first sentence. A writer, a
    function of both texts, is called in Arrow batches instead; where it fails, the context is blank and the chunk stays.
    """
    make = context or (lambda document, chunk: F.element_at(sentence_array(document), 1))
    if writer is not None:

        def safe(document: str | None, chunk: str | None) -> str:
            try:
                return writer(document or "", chunk or "") or ""
            except Exception:  # a model that fails on one chunk costs that chunk's context alone
                return ""

        @F.pandas_udf("string")
        def written_by(document: pd.Series, chunk: pd.Series) -> pd.Series:
            return pd.Series([safe(d, c) for d, c in zip(document, chunk, strict=True)], dtype=object)

        make = written_by
    met = chunks.join(docs.select(key, F.col("text").alias("__document")), key)
    made = tokens.stripped(F.coalesce(make(F.col("__document"), F.col("content")), F.lit("")))
    return met.withColumn("context", made).drop("__document").withColumn("augmented_content", F.when(F.col("context") != "", F.concat_ws("\n\n", "context", "content")).otherwise(F.col("content")))


def claim_array(answer: Column) -> Column:
    """The spans of an answer that stand for claims: fenced code and display mathematics whole, the rest by sentence."""
    prose, fences = F.split(answer, FENCES, -1), F.regexp_extract_all(answer, F.lit(FENCES), F.lit(0))
    cut = lambda p: F.filter(F.transform(F.split(p, CLAIM_END), tokens.stripped), lambda s: s != "")
    parts = F.transform(prose, lambda p, i: F.concat(cut(p), F.when(i < F.size(fences), F.array(tokens.stripped(F.get(fences, i)))).otherwise(F.array().cast("array<string>"))))
    return F.when(tokens.stripped(F.coalesce(answer, F.lit(""))) == "", F.array().cast("array<string>")).otherwise(F.flatten(parts))


def claims(answers: DataFrame, text: str = "text") -> DataFrame:
    rest = [c for c in answers.columns if c != text]
    return answers.select(*rest, F.posexplode(claim_array(F.col(text))).alias("claim_index", "claim"))


def ingest_rows(chunks: DataFrame) -> DataFrame:
    """chunks with the id under which they are stored."""
    return chunks.withColumn("chunk_id", keys.chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("content")))
