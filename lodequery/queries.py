"""The operators as queries over the test tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checks, keys, outputs, rules, tokens
from .operators import answers as A
from .operators import ann, chunking, fusion, graph, mentions, search, segment
from .plans import agents, ask, bench
from .sources import files, keyword_store, stores
from .streaming import streams
from .tables import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def benchmark_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- pieces of SQL ---------------------------------------------------------------------------------------------------

BL = r"[ \t\n\x0B\f\r]"


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BL}+|{BL}+$', '', 'g')"


def s_split(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{BL}+'), lambda t: t <> '')"


def s_claim(x: str) -> str:
    return f"list_distinct(list_transform(regexp_extract_all(coalesce({x}, ''), '{tokens.CLAIM_TOKEN}'), lambda t: lower(t)))"


STOP = "[" + ", ".join(f"'{w}'" for w in tokens.STOP_WORDS) + "]"


def s_bench(x: str) -> str:
    return f"list_filter(list_distinct(list_transform(regexp_extract_all(coalesce({x}, ''), '[一-鿿]|[A-Za-z][A-Za-z0-9_\\-]+'), lambda t: lower(t))), lambda t: NOT list_contains({STOP}, t))"


def s_sentences(x: str) -> str:
    parts = f"list_filter(list_transform(string_split(regexp_replace({x}, '([。！？.!?])', '\\1' || chr(1), 'g'), chr(1)), lambda s: {s_strip('s')}), lambda s: s <> '')"
    return f"(CASE WHEN len({parts}) > 0 THEN {parts} ELSE [{x}] END)"


def s_claims(x: str) -> str:
    """Fences between chr(2), then sentence ends within the other parts."""
    marked = f"string_split(regexp_replace({x}, '(?s)(```.*?```|\\$\\$.*?\\$\\$)', chr(2) || '\\1' || chr(2), 'g'), chr(2))"
    ends = f"regexp_replace(regexp_replace(p, '([。！？!?.]){BL}+', '\\1' || chr(1), 'g'), '([。！？])', '\\1' || chr(1), 'g')"
    cut = f"list_filter(list_transform(string_split({ends}, chr(1)), lambda s: {s_strip('s')}), lambda s: s <> '')"
    return f"flatten(list_transform({marked}, lambda p, i: CASE WHEN i % 2 = 0 THEN [{s_strip('p')}] ELSE {cut} END))"


def s_estimate(x: str) -> str:
    other = f"length(regexp_replace({x}, '[一-鿿]', '', 'g'))"
    return f"CAST(length({x}) - {other} + {other} // 4 AS INTEGER)"


CHUNKS = """chunks AS (SELECT doc_id, CAST(st // 462 AS INTEGER) AS chunk_index, substr(text, CAST(st + 1 AS BIGINT), 512) AS content
  FROM (SELECT doc_id, text, unnest(CASE WHEN length(text) <= 512 THEN [0] ELSE range(0, length(text), 462) END) AS st FROM documents WHERE text IS NOT NULL))"""


def s_bm25(fold: bool, name: str = "bm25", k: int = 20) -> str:
    low = (lambda x: f"lower({x})") if fold else (lambda x: x)
    return f"""split AS (SELECT doc_id, {s_split(low("coalesce(text, '')"))} AS toks FROM documents{" WHERE coalesce(text, '') <> ''" if fold else ""}),
lens AS (SELECT doc_id, len(toks) AS dl FROM split),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM lens),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS term FROM split) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
raws AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs, tot),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raws) ELSE raw END AS idf FROM raws),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({s_split(low("coalesce(text, '')"))}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM asked JOIN tfs USING (term) JOIN idf USING (term) JOIN lens USING (doc_id), tot GROUP BY query_id, doc_id),
{name} AS (SELECT query_id, 'bm25' AS route, doc_id AS chunk_id, score, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


def s_vectors(queries: str, k: int = 20) -> str:
    cos = "list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e)))"
    return f"""ve AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), vq AS (SELECT query_id, e FROM ve JOIN ({queries}) ON vec_id = query_id),
vector AS (SELECT query_id, 'vector' AS route, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM (SELECT query_id, v.vec_id AS chunk_id, round({cos}, 9) AS score FROM vq q, ve v)) WHERE rank <= {k})"""


FP = f"md5(substr({s_strip(f"regexp_replace(content, '{BL}+', ' ', 'g')")}, 1, 500))"
#: Three routes for each benchmark text: keywords, the vector of the same id, and what the graph says of the nation of the same key.
S_HITS = f"""{s_bm25(False)}, {s_vectors("SELECT item_id AS query_id FROM benchmark")},
graph_hits AS (SELECT n_nationkey AS query_id, 'graph' AS route, NULL AS chunk_id, 0.7 AS score, 1 AS rank, '实体: ' || r_name || '; 类型: Location; 图谱距离: 1' AS content
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey IN (SELECT item_id FROM benchmark)),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE route WHEN 'vector' THEN 1 WHEN 'bm25' THEN 2 ELSE 3 END, rank, chunk_id) AS ord FROM (
  SELECT h.query_id, route, CAST(chunk_id AS VARCHAR) AS chunk_id, score, rank, text AS content FROM (SELECT * FROM vector UNION ALL SELECT * FROM bm25) h JOIN documents ON chunk_id = doc_id
  UNION ALL SELECT query_id, route, chunk_id, score, rank, content FROM graph_hits))"""
S_WEIGHTED = f"""fused0 AS (SELECT query_id, {FP} AS key, route, sum(coalesce(score, 0) * CASE route WHEN 'vector' THEN 0.55 WHEN 'bm25' THEN 0.25 WHEN 'graph' THEN 0.2 ELSE 0.1 END) AS s, min(ord) AS ord,
  arg_min(coalesce(chunk_id, ''), ord) AS chunk_id, arg_min(content, ord) AS content FROM hits WHERE content <> '' GROUP BY 1, 2, 3),
fused1 AS (SELECT query_id, key, round(sum(s), 9) AS fusion_score, arg_min(chunk_id, ord) AS chunk_id, arg_min(content, ord) AS content, string_agg(route, ',' ORDER BY ord) AS matched_by, min(ord) AS ord FROM fused0 GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, ord) AS rank FROM fused1) WHERE rank <= 5)"""


def all_hits(spark: SparkSession, d: str) -> DataFrame:
    docs, asked = table(spark, d, "documents"), benchmark_queries(spark, d)
    texts = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    by_vector = search.vector_search(asked.join(vectors, F.col("query_id") == F.col("chunk_id")).select("query_id", "embedding"), vectors)
    found = search.bm25(asked, docs).unionByName(by_vector).join(texts, "chunk_id").withColumn("chunk_id", F.col("chunk_id").cast("string"))
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("query_id"), "r_name").join(asked.select("query_id"), "query_id", "left_semi")
    about = places.select("query_id", F.lit("graph").alias("route"), F.lit(None).cast("string").alias("chunk_id"), rules.distance_score(F.lit(1)).alias("score"), F.lit(1).alias("rank"), rules.graph_context(F.col("r_name"), F.lit("Location"), F.lit(1)).alias("content"))
    return fusion.in_order(found.select(about.columns).unionByName(about))


# --- chunking --------------------------------------------------------------------------------------------------------


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, content, doc_id || ':' || chunk_index || ':' || substr(sha256(doc_id || '|' || chunk_index || '|' || content), 1, 12) AS chunk_id FROM chunks")
def fixed_chunks(spark, d):
    return chunking.ingest_rows(chunking.fixed_chunks(table(spark, d, "documents").select("doc_id", "text")))


@query(f"WITH s AS (SELECT doc_id, {s_sentences('text')} AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_index, l[i] AS sentence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM s)")
def sentence_split(spark, d):
    return chunking.sentences(table(spark, d, "documents").select("doc_id", "text"))


def s_estimate(x: str) -> str:
    others = f"len(regexp_replace({x}, '{tokens.CJK}', '', 'g'))"
    return f"(len({x}) - {others} + {others} // 4)"


#: A step for each sentence: the pieces of the open chunk, their tokens, and the chunk that the sentence closes, if any.
S_PACKED = f"""sen AS (SELECT doc_id, i, l[i] AS sen, len(l) AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {s_sentences('text')} AS l FROM documents WHERE text IS NOT NULL))),
step(doc_id, i, pieces, total, chunk_index, closed, closed_total) AS (
  SELECT doc_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(NULL AS VARCHAR[]), CAST(NULL AS BIGINT) FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, i, list_append(tail, piece), CAST(coalesce(list_sum(list_transform(tail, lambda x: {s_estimate('x')})), 0) + {s_estimate('piece')} AS BIGINT),
    chunk_index + CAST(spills AS BIGINT), CASE WHEN spills THEN pieces END, CASE WHEN spills THEN total END
  FROM (SELECT *, CASE WHEN spills THEN sen ELSE plain END AS piece,
      CASE WHEN spills THEN list_filter(pieces, lambda x, j: j = len(pieces) OR list_sum(list_transform(pieces[j:], lambda y: {s_estimate('y')})) <= 64) ELSE pieces END AS tail
    FROM (SELECT *, len(pieces) > 0 AND total + {s_estimate('plain')} > 512 AS spills
      FROM (SELECT p.doc_id, s.i, pieces, total, chunk_index, sen,
          CASE WHEN len(pieces) = 0 OR (regexp_matches(pieces[-1], '{tokens.CJK}$') AND regexp_matches(sen, '^{tokens.CJK}')) THEN sen ELSE ' ' || sen END AS plain
        FROM step p JOIN sen s ON s.doc_id = p.doc_id AND s.i = p.i + 1)))),
packed AS (SELECT doc_id, chunk_index, closed AS pieces, closed_total AS total FROM step WHERE closed IS NOT NULL
  UNION ALL SELECT doc_id, chunk_index + 1, pieces, total FROM step JOIN (SELECT DISTINCT doc_id, n FROM sen) USING (doc_id) WHERE i = n),
made AS (SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, {s_strip("array_to_string(pieces, '')")} AS content, CAST(total AS INTEGER) AS token_count FROM packed)
SELECT doc_id, chunk_index, doc_id || ':' || chunk_index || ':' || substr(sha256(doc_id || '|' || chunk_index || '|' || content), 1, 12) AS chunk_id, content, token_count FROM made WHERE content <> ''"""


@query(f"WITH RECURSIVE {S_PACKED}")
def semantic_chunks(spark, d):
    return chunking.semantic_chunks(table(spark, d, "documents"))


@query(f"WITH RECURSIVE {S_PACKED}")
def semantic_chunks_lateral(spark, d):
    """The same by a lateral join in SQL."""
    chunking.register_chunks(spark)
    docs = table(spark, d, "documents").select("doc_id", "text")
    return spark.sql("SELECT doc_id, c.* FROM {docs}, LATERAL chunks_of(CAST(doc_id AS STRING), text, 512, 64) c", docs=docs)


@query()
def markdown_chunks(spark, d):
    return chunking.markdown_chunks(markdown_texts(spark, d))


#: A conversation as markdown: a heading for each turn, three levels deep in turn, and code that holds what looks like one.
S_MARKDOWN = """md AS (SELECT conv_id AS doc_id, string_agg(repeat('#', 1 + turn % 3) || ' ' || coalesce(role, '') || chr(10) || coalesce(text, '') || CASE WHEN turn % 5 = 4 THEN chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' ELSE '' END, chr(10) ORDER BY turn, role, text) AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1)"""


def markdown_texts(spark, d) -> DataFrame:
    turns = table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    code = F.when(F.col("turn") % 5 == 4, "\n```\n# code\n```").otherwise("")
    part = F.concat(F.expr("repeat('#', cast(1 + turn % 3 as int))"), F.lit(" "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), code)
    parts = F.array_sort(F.collect_list(F.struct("turn", "role", "text", part.alias("part"))))
    return turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.transform(parts, lambda s: s["part"]), "\n").alias("text"))


def s_crumbs() -> str:
    """Of the last heading of each level, those after which no shallower one came."""
    place = lambda k: f"coalesce(p{k}, -1)"
    return "list_filter([" + ", ".join(f"CASE WHEN {place(k)} > greatest(-1, {', '.join(['-1', *(place(j) for j in range(1, k))])}) THEN t{k} END" for k in range(1, 7)) + "], lambda t: t IS NOT NULL)"


S_HEADING = r"'^(#{1,6})\s+(.*?)\s*#*\s*$'"


@query(f"""WITH {S_MARKDOWN}, cut AS (SELECT doc_id, string_split_regex(text, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]') AS l FROM md),
lines AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM cut), f AS (SELECT *, regexp_matches(line, '^\\s*```') AS fence FROM lines),
n AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS fences FROM f),
v AS (SELECT *, CASE WHEN NOT fence AND fences % 2 = 0 AND regexp_matches(line, {S_HEADING}) THEN length(regexp_extract(line, {S_HEADING}, 1)) END AS level, {s_strip(f"regexp_extract(line, {S_HEADING}, 2)")} AS title FROM n),
s AS (SELECT *, count(level) OVER w AS section, {", ".join(f"max(CASE WHEN level = {k} THEN pos END) OVER w AS p{k}, last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER w AS t{k}" for k in range(1, 7))} FROM v
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
m AS (SELECT doc_id, section, {s_strip("coalesce(string_agg(CASE WHEN level IS NULL THEN line END, chr(10) ORDER BY pos), '')")} AS content, arg_max(array_to_string({s_crumbs()}, ' > '), pos) AS breadcrumbs FROM s GROUP BY 1, 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS INTEGER) AS section_index, breadcrumbs, content FROM m WHERE content <> ''""")
def markdown_sections(spark, d):
    return chunking.markdown_sections(markdown_texts(spark, d)).withColumn("breadcrumbs", F.array_join("breadcrumbs", " > "))


@query("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) // 100 AS BIGINT) AS batch_index FROM events")
def batches(spark, d):
    return chunking.batches(table(spark, d, "events").select("event_id"), 100, "event_id")


@query(f"""WITH {CHUNKS}, n AS (SELECT doc_id, chunk_index, {s_estimate('content')} AS n FROM chunks),
e AS (SELECT doc_id, chunk_index, n, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS BIGINT) AS token_end FROM n)
SELECT doc_id, chunk_index, token_end - n AS token_start, token_end FROM e""")
def late_chunk_plan(spark, d):
    return chunking.late_spans(chunking.fixed_chunks(table(spark, d, "documents").select("doc_id", "text"))).drop("content")


@query("""WITH x AS (SELECT vec_id // 10 AS span_id, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS dim FROM embeddings)
SELECT CAST(span_id AS BIGINT) AS span_id, CAST(dim AS INTEGER) AS dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(max(CAST(x AS DOUBLE)), 6) AS max FROM x GROUP BY ALL""")
def pooling(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("position"), "embedding")
    spans = vectors.groupBy(F.floor(F.col("position") / 10).alias("span_id")).agg((F.floor(F.min("position") / 10) * 10).alias("token_start"), (F.max("position") + 1).alias("token_end"))
    both = [chunking.pooled(vectors, spans, how).select("span_id", F.posexplode("pooled").alias("dim", how)).withColumn(how, F.round(how, 6)) for how in ("mean", "max")]
    return both[0].join(both[1], ["span_id", "dim"])


@query(f"WITH {CHUNKS} SELECT doc_id, chunk_index, {s_strip(f'{s_sentences('text')}[1]')} AS context, CASE WHEN context <> '' THEN context || chr(10) || chr(10) || content ELSE content END AS augmented_content FROM chunks JOIN documents USING (doc_id)")
def contextual_augment(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return chunking.contextualised(chunking.fixed_chunks(docs), docs).drop("content")


@query(f"WITH s AS (SELECT conv_id, turn, {s_claims('text')} AS l FROM conversations WHERE text IS NOT NULL) SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS claim_index, l[i] AS claim FROM (SELECT conv_id, turn, l, unnest(range(1, len(l) + 1)) AS i FROM s)")
def claim_split(spark, d):
    return chunking.claims(table(spark, d, "conversations").select("conv_id", "turn", "text"))


# --- functions -------------------------------------------------------------------------------------------------------


@query(f"""SELECT doc_id, CAST(len({s_split('lower(text)')}) AS INTEGER) AS folded, CAST(len({s_split('text')}) AS INTEGER) AS split, CAST(len({s_claim('text')}) AS INTEGER) AS claim, CAST(len({s_bench('text')}) AS INTEGER) AS bench,
{s_estimate('text')} AS estimate, CASE WHEN regexp_matches(text, '[一-鿿]') THEN 'zh' ELSE 'en' END AS script, {FP.replace('content', 'text')} AS fingerprint,
'sha256:' || substr(sha256(substr(text, 1, 80)), 1, 16) AS content_key, substr(text, 1, 200) AS head, CAST(len(list_filter({s_split('lower(text)')}, lambda t: length(t) >= 2)) AS INTEGER) AS entities FROM documents""")
def text_functions(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(tokens.folded_tokens(t)).alias("folded"), F.size(tokens.blank_split(t)).alias("split"), F.size(tokens.claim_tokens(t)).alias("claim"), F.size(tokens.bench_tokens(t)).alias("bench"), tokens.token_estimate(t).alias("estimate"), tokens.script_language(t).alias("script"), keys.fingerprint(t).alias("fingerprint"), keys.content_key(t).alias("content_key"), F.substring(t, 1, 200).alias("head"), F.size(tokens.query_entities(t)).alias("entities"))


@query("""WITH b AS (SELECT doc_id, list_transform(range(0, 16), lambda i: CAST(CAST('0x' || substr(md5(text), CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER) AS DOUBLE)) AS v FROM documents),
n AS (SELECT doc_id, v, sqrt(32 * list_dot_product(v, v)) AS n FROM b) SELECT doc_id, 512 AS dims, round(v[1] / n, 6) AS e1, round(v[16] / n, 6) AS e512, round(list_sum(v) * 32 / n, 6) AS total FROM n""")
def hash_embedding(spark, d):
    v = table(spark, d, "documents").select("doc_id", keys.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", F.size("v").alias("dims"), F.round(F.element_at("v", 1), 6).alias("e1"), F.round(F.element_at("v", -1), 6).alias("e512"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""WITH t AS (SELECT event_id, CASE CAST(event_id % 4 AS INTEGER) WHEN 0 THEN props WHEN 1 THEN 'Here:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'so ' || props || ' it is' ELSE 'none' END AS t FROM events),
c AS (SELECT event_id, list_filter([trim(regexp_extract(t, '(?s)```json\\s*(.*?)```', 1), chr(10) || ' '), trim(regexp_extract(t, '(?s)```[A-Za-z]*\\s*(.*?)```', 1), chr(10) || ' '), t, regexp_extract(t, '(?s)(\\{.*\\})', 1)], lambda x: starts_with(x, '{') AND json_valid(x)) AS l FROM t)
SELECT event_id, trim(l[1], chr(10) || ' ') AS object FROM c""")
def json_objects(spark, d):
    kind, p = F.col("event_id") % 4, F.col("props")
    text = F.when(kind == 0, p).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("so "), p, F.lit(" it is"))).otherwise("none")
    return table(spark, d, "events").select("event_id", tokens.stripped(rules.json_object(text)).alias("object"))


@query("""SELECT l_returnflag, decision, score_first, cap_first, gated, verdict, count(*) AS n, round(sum(sigmoid), 4) AS sigmoid FROM (
SELECT l_returnflag, 1 / (1 + pow(2.71828, -l_discount)) AS sigmoid, least(1, l_discount * 12) AS s, l_linenumber % 4 AS r,
CASE WHEN s >= 0.7 THEN 'use' WHEN s >= 0.3 THEN 'rewrite' ELSE 'fallback' END AS decision,
CASE WHEN s >= 0.7 THEN 'use' WHEN s >= 0.3 AND r < 2 THEN 'rewrite' ELSE 'fallback' END AS score_first,
CASE WHEN r >= 2 THEN 'fallback' ELSE decision END AS cap_first, CASE WHEN decision = 'rewrite' AND r >= 2 THEN 'fallback' ELSE decision END AS gated,
CASE l_linestatus WHEN 'O' THEN 'fail' ELSE 'warn' END AS verdict FROM lineitem) GROUP BY ALL""")
def decision_rules(spark, d):
    s, r = F.least(F.lit(1.0), F.col("l_discount") * 12), F.col("l_linenumber") % 4
    raw = F.when(F.col("l_linestatus") == "O", "Unsupported ").otherwise("other")
    rows = table(spark, d, "lineitem").select("l_returnflag", rules.sigmoid(F.col("l_discount")).alias("x"), rules.decision(s).alias("decision"), rules.decision_score_first(s, r).alias("score_first"), rules.decision_cap_first(s, r).alias("cap_first"), rules.decision_gated(rules.decision(s), r).alias("gated"), rules.verdict(raw).alias("verdict"))
    return rows.groupBy("l_returnflag", "decision", "score_first", "cap_first", "gated", "verdict").agg(F.count("*").alias("n"), F.round(F.sum("x"), 4).alias("sigmoid"))


# --- search ----------------------------------------------------------------------------------------------------------


@query()
def segmented_words(spark, d):
    """Every text's words written without spaces, and cut again by the words of all texts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return segment.glued_agreement(docs, segment.spaced_words(docs))


@query(f"WITH {s_bm25(False)} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_statistics(spark, d):
    return search.keyword_index(table(spark, d, "documents"), False).idf().withColumn("idf", F.round("idf", 6))


@query(f"WITH {s_bm25(False)} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM bm25")
def bm25_search(spark, d):
    return search.bm25(benchmark_queries(spark, d), table(spark, d, "documents")).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {s_bm25(False)} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM bm25")
def bm25_saved_search(spark, d):
    """An index that is saved, added to and loaded again."""
    docs, path = table(spark, d, "documents"), f"{shared_dir(spark)}/lodequery-index-{uuid.uuid4().hex}"
    stores.save_index(docs.where("lang = 'en'"), path, fold=False)
    stores.add_to_index(docs.where("lang is null or lang != 'en'"), path, fold=False)
    return stores.load_index(spark, path).search(benchmark_queries(spark, d)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(SQL["bm25_search"])
def bm25_blockmax_search(spark, d):
    """Blocks that can't hold a hit are skipped."""
    path = f"{shared_dir(spark)}/lodequery-blocks-{uuid.uuid4().hex}"
    keyword_store.append(table(spark, d, "documents"), path)
    return keyword_store.load(spark, path).search(benchmark_queries(spark, d)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(SQL["bm25_search"])
def bm25_stream_search(spark, d):
    """An index that a stream of three batches keeps, two of which are merged."""
    path = f"{shared_dir(spark)}/lodequery-stream-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text")
    thirds = max(docs.rdd.getNumPartitions() // 3, 1)  # files of a batch
    docs.repartition(3 * thirds).write.parquet(f"{path}/landed")
    landed = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", thirds).parquet(f"{path}/landed")
    keyword_store.keep(landed, f"{path}/index", f"{path}/checkpoint", fan=2, once=True).awaitTermination()
    return keyword_store.load(spark, f"{path}/index").search(benchmark_queries(spark, d)).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"""WITH {s_bm25(True)}, every AS (SELECT item_id AS query_id, doc_id, coalesce(score, 0) AS score FROM benchmark b CROSS JOIN split LEFT JOIN scored USING (doc_id) WHERE scored.query_id = b.item_id OR scored.query_id IS NULL
  UNION SELECT item_id, doc_id, 0 FROM benchmark, split WHERE (item_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM scored)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM every), m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS most FROM r WHERE rank <= 10)
SELECT query_id, doc_id AS chunk_id, CAST(rank AS INTEGER) AS rank, round(score / CASE WHEN most = 0 THEN 1 ELSE most END, 6) AS score FROM m""")
def bm25_relative_search(spark, d):
    return search.bm25_relative(benchmark_queries(spark, d), table(spark, d, "documents")).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {s_vectors('SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 100 = 0', 5)} SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM vector")
def vector_search(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return search.vector_search(asked, vectors, 5).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def vector_index(spark, d) -> tuple[ann.VectorIndex, DataFrame, DataFrame]:
    """An index of all embeddings in two additions, these, and the ones that are asked for."""
    vectors, path = table(spark, d, "embeddings").select("vec_id", "embedding"), f"{shared_dir(spark)}/lodequery-vectors-{uuid.uuid4().hex}"
    ann.build(vectors.where("vec_id % 3 > 0"), path)
    ann.add(vectors.where("vec_id % 3 = 0"), path)
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return ann.load(spark, path), vectors.withColumnRenamed("vec_id", "chunk_id"), asked


@query(SQL["vector_search"])
def vector_index_search(spark, d):
    """All cells probed: what codes and re-ranking find is what the exact search finds."""
    index, _, asked = vector_index(spark, d)
    return index.search(asked, 5, probed=1.0).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@query()
def vector_index_recall(spark, d):
    """How many of the ten exact hits of each query the index finds with its usual share of cells."""
    index, vectors, asked = vector_index(spark, d)
    exact = search.vector_search(asked, vectors, 10).select("query_id", "chunk_id")
    found = index.search(asked, 10).select("query_id", "chunk_id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "chunk_id"], "left").groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT vec_id, len(e) AS dims, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM v""")
def vector_normalised(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding", keys.normalised(F.col("embedding")).alias("u"))
    return v.select("vec_id", F.size("u").cast("long").alias("dims"), F.round(keys.norm(F.col("embedding")), 6).alias("norm"), F.round(F.element_at("u", 1), 6).alias("first"))


@query(f"""WITH shown AS (SELECT url, {s_strip(f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '{BL}+', ' ', 'g')")} AS content FROM pages),
asked AS (SELECT item_id AS query_id, unnest(list_distinct({s_split('lower(text)')})) AS term FROM benchmark),
found AS (SELECT query_id, url, count(*) AS n FROM (SELECT url, unnest(list_distinct({s_split('lower(content)')})) AS term FROM shown) JOIN asked USING (term) GROUP BY ALL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, url) AS rank FROM found) WHERE rank <= 5)
SELECT query_id, CAST(rank AS INTEGER) AS rank, 'web:' || url AS chunk_id, 'web' AS route, round(1 / rank, 9) AS score, substr(content, 1, 2000) AS content FROM best JOIN shown USING (url)""")
def web_route(spark, d):
    return stores.web_hits(benchmark_queries(spark, d), table(spark, d, "pages"))


# --- fusion and decisions --------------------------------------------------------------------------------------------


@query(f"WITH {S_HITS}, {S_WEIGHTED} SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, md5(content) AS content, round(fusion_score, 6) AS fusion_score, matched_by FROM fused")
def weighted_fusion(spark, d):
    return fusion.weighted(all_hits(spark, d)).select("query_id", "rank", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.md5(F.col("content").cast("binary")).alias("content"), F.round("fusion_score", 6).alias("fusion_score"), F.array_join("matched_by", ",").alias("matched_by"))


@query(f"""WITH {S_HITS}, k AS (SELECT *, coalesce(chunk_id, 'sha256:' || substr(sha256(substr(content, 1, 80)), 1, 16)) AS key FROM hits),
f AS (SELECT query_id, key, round(sum(1.0 / (60 + rank)), 9) AS rrf_score, arg_max(route, {{'a': score, 'b': -ord}}) AS route, min(ord) AS ord FROM k GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, ord) AS INTEGER) AS rank, key, route, round(rrf_score, 7) AS rrf_score FROM f""")
def reciprocal_rank_fusion(spark, d):
    return fusion.reciprocal_rank(all_hits(spark, d)).select("query_id", "rank", "key", "route", F.round("rrf_score", 7).alias("rrf_score"))


@query(f"""WITH {S_HITS}, f AS (SELECT query_id, chunk_id, max(score) AS score, arg_max(route, {{'a': score, 'b': -ord}}) AS route, min(ord) AS ord FROM hits GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord) AS INTEGER) AS rank, coalesce(chunk_id, '') AS chunk_id, route, round(score, 6) AS score FROM f""")
def merge_hits(spark, d):
    return fusion.merged(all_hits(spark, d)).select("query_id", "rank", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "route", F.round("score", 6).alias("score"))


@query(f"""WITH {S_HITS}, {S_WEIGHTED}, u AS (SELECT query_id, rank, content, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM fused)
SELECT query_id, CAST(rank AS INTEGER) AS rank, substr(content, 1, CAST(6000 - used AS BIGINT)) AS content FROM u WHERE used < 6000""")
def context_compression(spark, d):
    return fusion.compressed(fusion.weighted(all_hits(spark, d))).select("query_id", "rank", "content")


S_RERANK = f"""t AS (SELECT item_id AS query_id, {s_claim('text')} AS qt FROM benchmark), pool AS (SELECT query_id, chunk_id, max(score) AS score, arg_min(content, ord) AS content, min(ord) AS ord FROM hits WHERE chunk_id IS NOT NULL GROUP BY 1, 2),
rr AS (SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS pre_rank, CASE WHEN len(qt) > 0 THEN len(list_intersect(qt, {s_claim('content')})) / len(qt) ELSE 0 END AS rerank_score FROM pool p JOIN t USING (query_id)),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, ord) AS rank FROM rr) WHERE rank <= 5)"""


def reranked_hits(spark, d) -> DataFrame:
    hits = all_hits(spark, d).where("chunk_id is not null")
    pool = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.min_by("content", "ord").alias("content"), F.min("ord").alias("ord"))
    return fusion.reranked(fusion.ranked(pool, "score"), benchmark_queries(spark, d))


@query(f"WITH {S_HITS}, {S_RERANK} SELECT query_id, CAST(rank AS INTEGER) AS rank, CAST(pre_rank AS INTEGER) AS pre_rank, chunk_id, round(rerank_score, 6) AS rerank_score FROM reranked")
def rerank(spark, d):
    return reranked_hits(spark, d).select("query_id", "rank", "pre_rank", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"))


@query(f"""WITH {S_HITS}, {S_RERANK}, m AS (SELECT query_id, avg(rerank_score) AS relevance, avg(CASE WHEN rerank_score >= 0.5 THEN 1.0 ELSE 0 END) AS coverage, count(*) AS hits FROM reranked GROUP BY 1),
s AS (SELECT item_id AS query_id, coalesce(hits, 0) AS hits, round(coalesce(relevance, 0), 6) AS relevance, round(coalesce(coverage, 0), 6) AS coverage, round(CASE WHEN relevance IS NULL THEN 0 ELSE greatest(0, least(1, 0.7 * relevance + 0.3 * coverage)) END, 6) AS score FROM benchmark LEFT JOIN m ON item_id = query_id)
SELECT *, CASE WHEN score >= 0.7 THEN 'use' WHEN score >= 0.3 THEN 'rewrite' ELSE 'fallback' END AS decision FROM s""")
def crag_scores(spark, d):
    return fusion.crag(reranked_hits(spark, d), benchmark_queries(spark, d))


# --- claims, provenance, metrics -------------------------------------------------------------------------------------

S_CLAIMS = f"""cited AS (SELECT query_id, chunk_id, rank AS pos, text AS content FROM bm25 JOIN documents ON chunk_id = doc_id WHERE rank <= 3),
parts AS (SELECT query_id, i - 1 AS claim_index, l[i] AS claim FROM (SELECT query_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id AS query_id, {s_claims('text')} AS l FROM benchmark))),
met AS (SELECT p.*, chunk_id, pos, chunk_id IS NOT NULL AND len(list_intersect({s_claim('claim')}, {s_claim('content')})) >= 2 AS ok FROM parts p LEFT JOIN cited USING (query_id)),
claims AS (SELECT query_id, claim_index, claim, coalesce(string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY pos) FILTER (WHERE ok), '') AS evidence FROM met GROUP BY 1, 2, 3)"""


def answer_parts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    docs, asked = table(spark, d, "documents"), benchmark_queries(spark, d)
    used = search.bm25(asked, docs, 3).select("query_id", "chunk_id", F.col("rank").alias("pos"))
    contexts = used.join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id").select("query_id", "chunk_id", "content")
    said = asked.select("query_id", F.col("text").alias("answer"))
    return said, used, contexts, A.heuristic_claims(said, used, contexts)


@query(f"WITH {s_bm25(False)}, {S_CLAIMS} SELECT query_id, CAST(claim_index AS INTEGER) AS claim_index, claim, evidence, CASE WHEN evidence <> '' THEN 'supported' ELSE 'unsupported' END AS support FROM claims")
def heuristic_claims(spark, d):
    return answer_parts(spark, d)[3].select("query_id", "claim_index", "claim", F.array_join(F.transform("evidence_ids", lambda x: x.cast("string")), ",").alias("evidence"), "support")


S_PROVENANCE = f"""rec AS (SELECT query_id, avg(CASE WHEN evidence <> '' THEN 1.0 ELSE 0 END) AS recall, string_agg(CASE WHEN evidence = '' THEN claim END, '|' ORDER BY claim_index) AS missing FROM claims GROUP BY 1),
cov AS (SELECT query_id, count(h.t) / greatest(count(a.t), 1) AS coverage FROM (SELECT item_id AS query_id, unnest({s_claim('text')}) AS t FROM benchmark) a
  LEFT JOIN (SELECT DISTINCT query_id, unnest({s_claim('content')}) AS t FROM cited) h USING (query_id, t) GROUP BY 1),
prov AS (SELECT query_id, round(coalesce(recall, 0), 4) AS recall, round(coverage, 4) AS coverage, round(0.7 * coalesce(recall, 0) + 0.3 * least(1, coverage / 0.5), 4) AS ps, coalesce(missing, '') AS missing FROM cov LEFT JOIN rec USING (query_id))"""


def provenance_rows(spark, d) -> DataFrame:
    said, used, contexts, made = answer_parts(spark, d)
    return A.provenance(said, made.select("query_id", "claim_index", "claim", "evidence_ids"), used, contexts)


@query(f"WITH {s_bm25(False)}, {S_CLAIMS}, {S_PROVENANCE} SELECT * FROM prov")
def provenance(spark, d):
    return provenance_rows(spark, d).withColumn("missing", F.array_join("missing", "|"))


@query(f"WITH {s_bm25(False)}, {S_CLAIMS}, {S_PROVENANCE} SELECT round(avg(ps), 4) AS mean_ps, round(median(ps), 4) AS median_ps, round(avg(CASE WHEN ps >= 0.8 THEN 1.0 ELSE 0 END), 4) AS pass_rate, count(*) AS questions FROM prov")
def provenance_summary(spark, d):
    return A.provenance_summary(provenance_rows(spark, d))


S_NODE = "CASE event_type WHEN 'click' THEN 'planner' WHEN 'view' THEN 'retriever' WHEN 'signup' THEN 'evaluator' WHEN 'purchase' THEN 'auditor' ELSE 'fallback' END"


def run_log(spark, d) -> DataFrame:
    node = F.expr(S_NODE)
    return table(spark, d, "events").select(F.col("user_id").alias("run_id"), node.alias("node"), F.col("event_type").alias("tool"), "ts", "event_id", "value")


@query(f"SELECT user_id AS run_id, count(DISTINCT CASE WHEN node <> 'fallback' THEN node END) / 4 AS completeness FROM (SELECT user_id, {S_NODE} AS node FROM events) GROUP BY 1")
def trace_completeness(spark, d):
    return A.trace_completeness(run_log(spark, d))


@query("WITH c AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_type IN ('click', 'error')), r AS (SELECT DISTINCT user_id FROM events), g AS (SELECT DISTINCT user_id, event_type, 1 AS hit FROM events WHERE value > 100) SELECT r.user_id AS run_id, coalesce(round(count(hit) / nullif(count(c.event_type), 0), 4), 1.0) AS necessity FROM r LEFT JOIN c USING (user_id) LEFT JOIN g ON c.user_id = g.user_id AND c.event_type = g.event_type GROUP BY 1")
def tool_necessity(spark, d):
    log = run_log(spark, d)
    return A.tool_necessity(log.where("tool in ('click', 'error')"), log.where("value > 100"), log)


@query(f"WITH e AS (SELECT user_id, value, {S_NODE} AS node FROM events), c AS (SELECT DISTINCT user_id, node FROM e WHERE node IN ('planner', 'fallback')), r AS (SELECT DISTINCT user_id FROM e), g AS (SELECT DISTINCT user_id, node, 1 AS hit FROM e WHERE value < 20) SELECT r.user_id AS run_id, coalesce(round(count(hit) / nullif(count(c.node), 0), 4), 1.0) AS coverage FROM r LEFT JOIN c USING (user_id) LEFT JOIN g ON c.user_id = g.user_id AND c.node = g.node GROUP BY 1")
def audit_coverage(spark, d):
    log = run_log(spark, d)
    return A.audit_coverage(log.where("value < 20"), log.where("node in ('planner', 'fallback')"), log)


@query("WITH r AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS rewrites, arg_max(event_type, {'a': ts, 'b': event_id}) AS last FROM events GROUP BY 1) SELECT coalesce(avg(CASE WHEN last = 'purchase' THEN 1.0 ELSE 0 END), 0) AS fix_rate, count(*) AS rewritten_runs FROM r WHERE rewrites > 0")
def fix_rate(spark, d):
    runs = run_log(spark, d).groupBy("run_id").agg(F.sum((F.col("tool") == "error").cast("int")).alias("rewrites"), F.max_by("tool", F.struct("ts", "event_id")).alias("last"))
    return A.fix_rate(runs.withColumn("final_decision", F.when(F.col("last") == "purchase", "Use").otherwise("fallback")))


@query(f"""WITH {s_bm25(False)}, k AS (SELECT item_id AS id, {s_split('text')}[1:5] AS keywords FROM benchmark), a AS (SELECT query_id AS id, lower(text) AS answer FROM bm25 JOIN documents ON chunk_id = doc_id WHERE rank = 1)
SELECT id, round(CASE WHEN len(keywords) > 0 THEN len(list_filter(keywords, lambda k: contains(coalesce(answer, ''), lower(k)))) / len(keywords) ELSE 0 END, 6) AS score FROM k LEFT JOIN a USING (id)""")
def keyword_evaluation(spark, d):
    docs, asked = table(spark, d, "documents"), benchmark_queries(spark, d)
    best = search.bm25(asked, docs, 1).join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("answer")), "chunk_id").select("query_id", "answer")
    return A.keyword_evaluation(asked.join(best, "query_id", "left").select(F.col("query_id").alias("id"), "answer", F.slice(tokens.blank_split(F.col("text")), 1, 5).alias("keywords")))


@query(f"WITH scores AS ({SQL['keyword_evaluation']}) SELECT round(coalesce(avg(score), 0), 6) AS average, count(*) AS answers FROM scores")
def keyword_report(spark, d):
    return A.keyword_report(keyword_evaluation(spark, d))


@query(f"""WITH {S_HITS}, h AS (SELECT * FROM hits WHERE chunk_id IS NOT NULL), m AS (SELECT query_id, chunk_id, max(score) AS score, min(ord) AS ord FROM h GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS fused_rank FROM m), first AS (SELECT query_id, route, chunk_id, min(ord) AS raw_rank, arg_min(score, ord) AS raw_score FROM h GROUP BY 1, 2, 3),
o AS (SELECT a.*, CASE WHEN f.fused_rank <= 5 THEN f.fused_rank END AS fused_rank, CASE WHEN f.fused_rank <= 5 THEN f.score END AS fused_score, coalesce(b.rank <= 3, false) AS cited FROM first a LEFT JOIN f USING (query_id, chunk_id) LEFT JOIN bm25 b ON a.query_id = b.query_id AND a.chunk_id = CAST(b.chunk_id AS VARCHAR))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cited DESC, coalesce(fused_rank, 9999), coalesce(raw_rank, 9999), route) AS INTEGER) AS position, route, chunk_id, CAST(raw_rank AS INTEGER) AS raw_rank, round(raw_score, 6) AS raw_score, CAST(fused_rank AS INTEGER) AS fused_rank, round(fused_score, 6) AS fused_score, cited FROM o""")
def retrieval_trace(spark, d):
    hits = all_hits(spark, d).where("chunk_id is not null").withColumn("visited", F.lit(None).cast("array<string>"))
    fused = fusion.merged(hits, 5).withColumn("rerank_score", F.lit(None).cast("double"))
    out = A.retrieval_trace(hits, fused, hits.where("route = 'bm25' and rank <= 3"))
    return out.select("query_id", "position", "route", "chunk_id", "raw_rank", F.round("raw_score", 6).alias("raw_score"), "fused_rank", F.round("fused_score", 6).alias("fused_score"), "cited")


@query(f"WITH trace AS ({SQL['retrieval_trace']}) SELECT * FROM trace WHERE route = 'bm25'")
def trace_of_route(spark, d):
    return A.of_route(retrieval_trace(spark, d), "bm25")


@query(f"""WITH q AS (SELECT item_id AS query_id, unnest({s_bench('text')}) AS t FROM benchmark), c AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, unnest({s_bench('text')}) AS t FROM documents),
s AS (SELECT query_id, chunk_id, count(*) AS overlap FROM q JOIN c USING (t) GROUP BY ALL)
SELECT query_id, chunk_id, overlap, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk_id) AS rank FROM s) WHERE rank <= 6""")
def overlap_ranking(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    return bench.overlap_ranking(benchmark_queries(spark, d), chunks)


#: For each benchmark text the document that shares most of its tokens, and a copy of it without the text's first word.
S_ADVERSARIAL = f"""asked AS (SELECT item_id AS query_id, text AS question, {s_bench('text')} AS q, {s_split('text')}[1] AS word FROM benchmark),
found AS (SELECT * FROM ({SQL['overlap_ranking']}) WHERE rank = 1),
pool AS (SELECT query_id, chunk_id, text AS content FROM found JOIN documents ON chunk_id = CAST(doc_id AS VARCHAR)
  UNION ALL SELECT query_id, 'distractor:' || query_id, replace(text, word, 'zzz') FROM found JOIN documents ON chunk_id = CAST(doc_id AS VARCHAR) JOIN asked USING (query_id)),
o AS (SELECT query_id, chunk_id, content, len(list_intersect(q, {s_bench('content')})) AS overlap FROM pool JOIN asked USING (query_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, chunk_id) AS rank, max(overlap) OVER (PARTITION BY query_id) AS best FROM o),
u AS MATERIALIZED (SELECT *, {s_claim('content')} AS own FROM r WHERE rank <= 3 AND (overlap > 0 OR (best = 0 AND rank = 1))),
p AS (SELECT query_id, i AS claim_index, l[i] AS claim FROM (SELECT query_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT query_id, {s_claims('content')} AS l FROM u WHERE rank = 1))),
m AS (SELECT p.query_id, claim_index, u.chunk_id, len(list_intersect({s_claim('claim')}, own)) >= 2 AS ok FROM p LEFT JOIN u USING (query_id)),
e AS (SELECT query_id, claim_index, count(*) FILTER (WHERE ok) AS n, coalesce(bool_or(ok AND starts_with(chunk_id, 'distractor:')), false) AS touched FROM m GROUP BY 1, 2),
v AS (SELECT query_id, min(n) AS least, bool_or(touched) AS touched FROM e GROUP BY 1), w AS (SELECT query_id, bool_or(starts_with(chunk_id, 'distractor:')) AS misled FROM u GROUP BY 1),
cases AS (SELECT coalesce(misled, false) AS misled, coalesce(least, 0) = 0 OR coalesce(touched, false) AS lost FROM found LEFT JOIN v USING (query_id) LEFT JOIN w USING (query_id)),
rates AS (SELECT round(avg(CASE WHEN misled THEN 1.0 ELSE 0 END), 4) AS misled_rate, round(avg(CASE WHEN lost THEN 1.0 ELSE 0 END), 4) AS hallucination_rate, round(avg(CASE WHEN misled THEN 0 ELSE 1.0 END), 4) AS distractor_visited_rate, count(*) AS cases FROM cases)"""


@query(f"WITH {S_ADVERSARIAL} SELECT *, misled_rate <= 0.1 AND hallucination_rate <= 0.1 AND distractor_visited_rate >= 0.5 AS passes FROM rates")
def adversarial_rates(spark, d):
    """Each benchmark text against the document nearest to it and a copy of that with a word swapped."""
    return A.passes(adversarial_report(spark, d))


def adversarial_report(spark, d) -> DataFrame:
    chunks = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"))
    asked = benchmark_queries(spark, d)
    gold = bench.overlap_ranking(asked, chunks).where("rank = 1 and overlap > 0").join(chunks, "chunk_id").join(asked.select("query_id", "text"), "query_id")
    word = F.get(tokens.blank_split(F.col("text")), 0)
    planted = A.with_distractor(gold.select(F.col("query_id").alias("case_id"), "content", word.alias("swap_from"), F.lit("zzz").alias("swap_to")))
    return A.adversarial(bench.adversarial_cases(asked, gold, planted, strip=False))


@query(f"""WITH {s_bm25(False)}, {S_CLAIMS}, {S_PROVENANCE}, {S_ADVERSARIAL}, ps AS (SELECT round(avg(ps), 4) AS mean_ps, round(median(ps), 4) AS median_ps, round(avg(CASE WHEN ps >= 0.8 THEN 1.0 ELSE 0 END), 4) AS pass_rate, count(*) AS questions FROM prov),
kpis AS (SELECT *, misled_rate <= 0.1 AND hallucination_rate <= 0.1 AND distractor_visited_rate >= 0.5 AS passes FROM ps, rates) SELECT *, passes AND mean_ps >= 0.8 AS all_pass FROM kpis""".replace("asked AS (SELECT item_id AS query_id, text AS question", "asked_of AS (SELECT item_id AS query_id, text AS question").replace("JOIN asked USING (query_id)", "JOIN asked_of USING (query_id)"))
def bench_report(spark, d):
    return A.bench_report(provenance_summary(spark, d), adversarial_report(spark, d))


@query()
def ask_questions(spark, d):
    docs, asked = table(spark, d, "documents"), benchmark_queries(spark, d)
    got = ask.Engine({"bm25": ask.keyword_route(docs)}).ask(asked)
    return got["answers"].join(got["verdicts"], "query_id").select("query_id", "decision", "rewrites", "score", "verdict", "claims", "unsupported")


S_HYBRID = f"""{s_bm25(False, k=5)}, {s_vectors("SELECT item_id AS query_id FROM benchmark", 5)},
hits AS (SELECT h.query_id, route, CAST(chunk_id AS VARCHAR) AS chunk_id, score, rank, text AS content, row_number() OVER (PARTITION BY h.query_id ORDER BY CASE route WHEN 'vector' THEN 1 ELSE 2 END, rank, CAST(chunk_id AS VARCHAR)) AS ord
  FROM (SELECT * FROM vector UNION ALL SELECT * FROM bm25) h JOIN documents ON chunk_id = doc_id)"""


def hybrid_routes(spark, d) -> dict:
    docs = table(spark, d, "documents")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")

    def down(queries: DataFrame, k: int) -> DataFrame:
        raise ConnectionError("no graph here")

    return {"bm25": ask.keyword_route(docs), "vector": ask.vector_route(docs, vectors, vectors.withColumnRenamed("doc_id", "query_id")), "graph": down}


@query(f"""WITH {S_HYBRID}, {S_WEIGHTED}, u AS (SELECT *, coalesce(sum(length(content)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM fused)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, round(fusion_score, 6) AS fusion_score, CAST(least(length(content), 6000 - used) AS INTEGER) AS chars FROM u WHERE used < 6000""")
def hybrid_search(spark, d):
    """Two routes, and a third that fails and leaves them alone."""
    fused, _, _ = ask.hybrid(benchmark_queries(spark, d), hybrid_routes(spark, d))
    return fused.select("query_id", "rank", "chunk_id", F.round("fusion_score", 6).alias("fusion_score"), F.length("content").alias("chars"))


@query(f"""WITH q AS (SELECT item_id AS query_id, {s_split('text')} AS l FROM benchmark), e AS (
  SELECT query_id, 0 AS seq, 'phase' AS type, 'analysis' AS text FROM q UNION ALL SELECT query_id, 1, 'phase', 'retrieval' FROM q
  UNION ALL SELECT query_id, 2, 'answer_start', '' FROM q
  UNION ALL SELECT query_id, 3 + i, 'token', l[i + 1] FROM (SELECT query_id, l, unnest(range(0, len(l))) AS i FROM q)
  UNION ALL SELECT query_id, 3 + len(l), 'answer_end', '' FROM q UNION ALL SELECT query_id, 4 + len(l), 'done', '' FROM q)
SELECT query_id, CAST(seq AS INTEGER) AS seq, type, text FROM e""")
def answer_stream(spark, d):
    """The events of every benchmark question, each answered by its own words one at a time."""
    own_words = lambda prompt: (w for w in re.split(r"[ \t\n\x0b\f\r]+", prompt.split("\n\nEvidence:")[0].removeprefix("Question: ")) if w)
    events = agents.event_rows(benchmark_queries(spark, d), hybrid_routes(spark, d), own_words, k=5)
    return events.select("query_id", "seq", "type", F.coalesce("text", F.lit("")).alias("text"))


# --- model output, records, access -----------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, text, coalesce(role, '') AS evidence, 'supported' AS support FROM conversations WHERE text IS NOT NULL
UNION ALL SELECT conv_id, turn, role, '', 'unsupported' FROM conversations WHERE role IS NOT NULL""")
def claim_coercion(spark, d):
    """From a list of an object, one without a text, a number, and a string."""
    whole, bare = F.to_json(F.struct("text", F.array("role").alias("evidence_ids"))), F.to_json(F.array("role"))
    listed = F.concat(F.lit("["), whole, F.lit(', {"evidence_ids": ["x"]}, 7, '), F.expr("substring(bare, 2, length(bare) - 1)"))
    turns = table(spark, d, "conversations").withColumn("bare", bare)
    return turns.select("conv_id", "turn", F.explode(outputs.coerced_claims(listed)).alias("c")).select("conv_id", "turn", "c.text", F.array_join("c.evidence_ids", ",").alias("evidence"), "c.support")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'compare' ELSE 'query' END AS intent, CASE event_id % 3 WHEN 0 THEN 'a,b' ELSE '' END AS entities, 'medium' AS complexity, event_id % 3 = 0 AS requires_multi_hop,
CASE event_id % 3 WHEN 1 THEN 'better ' || event_type ELSE event_type END AS query_rewrite, event_id % 3 = 1 AS is_supported, CASE event_id % 3 WHEN 1 THEN 0.5 ELSE 0 END AS confidence,
CASE event_id % 3 WHEN 1 THEN 'so' ELSE 'nothing' END AS answer, CASE event_id % 3 WHEN 1 THEN 'a>b' ELSE '' END AS reasoning_path, CASE event_id % 3 WHEN 1 THEN 'few' ELSE '' END AS limitations FROM events""")
def typed_outputs(spark, d):
    """Fields that are there, missing, mistyped, and a text that is no JSON."""
    kind = F.col("event_id") % 3
    said = F.when(kind == 0, '{"intent": "compare", "entities": ["a", "b"], "requires_multi_hop": true, "query_rewrite": "", "confidence": null}').when(
        kind == 1, F.concat(F.lit('{"intent": 7, "query_rewrite": "better '), "event_type", F.lit('", "is_supported": true, "confidence": 0.5, "complexity": [], "answer": "so", "reasoning_path": ["a", "b"], "limitations": "few"}'))
    ).otherwise("no JSON")
    rows = table(spark, d, "events").select("event_id", outputs.analysis(said, F.col("event_type")).alias("a"), outputs.verification(said).alias("v"), outputs.reasoning(said, "nothing").alias("r"))
    return rows.select("event_id", "a.intent", F.array_join("a.entities", ",").alias("entities"), "a.complexity", "a.requires_multi_hop", "a.query_rewrite", "v.is_supported", "v.confidence", "r.answer", F.array_join("r.reasoning_path", ">").alias("reasoning_path"), "r.limitations")


@query("""SELECT event_id, event_id % 4 = event_id % 3 + 1 AND user_id % 3 = event_id % 3 AS path_fits, regexp_matches(CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'X' || event_type END, '^[a-z][a-z0-9_]*$') AS plain_name,
value / 100 BETWEEN 0 AND 1 AS unit_score, event_id % 5 BETWEEN 0 AND 2 AS rewrites_fit, coalesce(length(props) BETWEEN 10 AND 2000, false) AS reasoning_fits FROM events""")
def record_checks(spark, d):
    n = F.col("event_id")
    name = F.when(n % 2 == 0, F.col("event_type")).otherwise(F.concat(F.lit("X"), "event_type"))
    nodes, rels = F.expr("array_repeat('n', cast(event_id % 4 as int))"), F.expr("array_repeat('r', cast(user_id % 3 as int))")
    return table(spark, d, "events").select(
        "event_id", checks.path_fits(n % 3, nodes, rels).alias("path_fits"), checks.plain_name(name).alias("plain_name"), checks.unit_score(F.col("value") / 100).alias("unit_score"),
        checks.rewrites_fit(n % 5).alias("rewrites_fit"), checks.reasoning_fits(F.col("props")).alias("reasoning_fits"),
    )


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 200 ELSE 401 END AS status, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS key, 503 AS unlisted, 'auth_disabled' AS unchecked FROM customer")
def key_access(spark, d):
    key = F.col("c_mktsegment")
    listed, unlisted, off = checks.access(key, True, " BUILDING, MACHINERY ,"), checks.access(key, True, " , "), checks.access(key, False, "")
    return table(spark, d, "customer").select("c_custkey", listed["status"].alias("status"), listed["key"].alias("key"), unlisted["status"].alias("unlisted"), off["key"].alias("unchecked"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.7 THEN 'use' WHEN s >= 0.3 AND r < 2 THEN 'rewrite' ELSE 'fallback' END AS branch, CASE WHEN r >= 2 THEN 'fallback' WHEN s >= 0.7 THEN 'use' WHEN s >= 0.3 THEN 'rewrite' ELSE 'fallback' END AS branch_cap_first,
printf('score %.4f after %d rewrites: %s', s, r, branch) AS reasoning FROM (SELECT l_orderkey, l_linenumber, round(least(1, l_discount * 10), 1) AS s, CAST(l_linenumber % 3 AS INTEGER) AS r FROM lineitem)""")
def decision_records(spark, d):
    rows = table(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("query_id"), F.round(F.least(F.lit(1.0), F.col("l_discount") * 10), 1).alias("score"), (F.col("l_linenumber") % 3).cast("int").alias("rewrites"))
    return ask.decision_records(rows).select("query_id.*", "branch", "branch_cap_first", "reasoning")


# --- graph -----------------------------------------------------------------------------------------------------------

S_GRAPH = """nodes AS (SELECT r_name AS name, 'Location' AS type FROM region UNION ALL SELECT n_name, 'Location' FROM nation UNION ALL SELECT s_name, 'Organization' FROM supplier UNION ALL SELECT c_name, 'Person' FROM customer),
edges AS (SELECT n_name AS source, r_name AS target, 'PART_OF' AS type FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT s_name, n_name, 'BELONGS_TO' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, n_name, 'BELONGS_TO' FROM customer JOIN nation ON c_nationkey = n_nationkey),
both_ways AS (SELECT source AS u, target AS v, type, source || '|' || type || '|' || target AS e FROM edges UNION ALL SELECT target, source, type, source || '|' || type || '|' || target FROM edges)"""


def star_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    region, nation, supplier, customer = (table(spark, d, t) for t in ("region", "nation", "supplier", "customer"))
    named = lambda df, c, kind: df.select(F.col(c).alias("name"), F.lit(kind).alias("type"))
    nodes = named(region, "r_name", "Location").union(named(nation, "n_name", "Location")).union(named(supplier, "s_name", "Organization")).union(named(customer, "c_name", "Person"))
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("type"))
    edges = edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name", "PART_OF").union(edge(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "n_name", "BELONGS_TO"))
    edges = edges.union(edge(customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")), "c_name", "n_name", "BELONGS_TO"))
    return nodes, edges.withColumn("edge_id", F.concat_ws("|", "source", "type", "target"))


S_TRAILS = """t1(start, fin, depth, nodes, rels, es) AS (SELECT name, v, 1, [u, v], [type], [e] FROM starts JOIN both_ways ON name = u),
t2(start, fin, depth, nodes, rels, es) AS (SELECT start, v, 2, list_append(nodes, v), list_append(rels, type), list_append(es, e) FROM t1 JOIN both_ways ON fin = u WHERE NOT list_contains(es, e)),
t3(start, fin, depth, nodes, rels, es) AS (SELECT start, v, 3, list_append(nodes, v), list_append(rels, type), list_append(es, e) FROM t2 JOIN both_ways ON fin = u WHERE NOT list_contains(es, e))"""
S_NEAR = """near AS (SELECT start, fin AS name, min(depth) AS distance FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2) GROUP BY 1, 2),
neighbours AS (SELECT start, name, type, distance FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY distance, name) AS rn FROM near) JOIN nodes USING (name) WHERE rn <= 50)"""


@query("""SELECT p_brand AS name, 'Entity' AS type, coalesce(nullif(CAST(arg_max(p_size, p_partkey) AS DOUBLE), 0), 0.8) AS confidence, arg_max(p_type, p_partkey) AS kind, CAST(arg_max(p_size, p_partkey) AS VARCHAR) AS size FROM part WHERE p_brand <> '' GROUP BY 1""")
def graph_upsert(spark, d):
    part = table(spark, d, "part")
    new = part.select(F.col("p_brand").alias("name"), F.col("p_type").alias("type"), F.col("p_size").cast("double").alias("confidence"), F.create_map(F.lit("kind"), "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("properties"), F.col("p_partkey").cast("long").alias("seq"))
    return graph.upserted_nodes(None, new).select("name", "type", "confidence", F.col("properties")["kind"].alias("kind"), F.col("properties")["size"].alias("size"))


@query(f"WITH {S_GRAPH} SELECT 'entity' AS what, type, count(*) AS rows FROM nodes GROUP BY 2 UNION ALL SELECT 'relation', e.type, count(*) FROM edges e JOIN nodes a ON a.name = source JOIN nodes b ON b.name = target GROUP BY 2")
def graph_upsert_counts(spark, d):
    nodes, edges = star_graph(spark, d)
    return graph.upsert_counts(nodes, edges)


@query(f"WITH {S_GRAPH} SELECT source, e.type AS type, target, a.type AS source_type, b.type AS target_type, substr(sha256(a.type || '|' || source || '|' || e.type || '|' || b.type || '|' || target), 1, 16) AS edge_id FROM (SELECT DISTINCT * FROM edges) e JOIN nodes a ON a.name = source JOIN nodes b ON b.name = target")
def graph_relations(spark, d):
    return graph.upserted_edges(*star_graph(spark, d))


@query(f"WITH {S_GRAPH}, k AS (SELECT type, count(*) AS n FROM nodes GROUP BY 1 ORDER BY n DESC, type LIMIT 10) SELECT 'nodes' AS what, count(*) AS value FROM nodes UNION ALL SELECT 'relations', count(*) FROM edges UNION ALL SELECT 'type:' || type, n FROM k")
def graph_stats(spark, d):
    return graph.stats(*star_graph(spark, d))


@query(f"WITH {S_GRAPH}, starts AS (SELECT n_name AS name FROM nation), {S_TRAILS}, {S_NEAR} SELECT * FROM neighbours")
def graph_neighbours(spark, d):
    nodes, edges = star_graph(spark, d)
    return graph.neighbours(nodes, edges, table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query(f"""WITH {S_GRAPH}, starts AS (SELECT n_name AS name FROM nation), {S_TRAILS}, a AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
p AS (SELECT a.n_name AS source, b.n_name AS target FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey),
f AS (SELECT source, target, depth, array_to_string(nodes, '->') || '@d' || depth AS path, array_to_string(rels, ',') AS rel_list FROM a JOIN p ON start = source AND fin = target)
SELECT source, target, CAST(rank AS INTEGER) AS rank, depth, path, rel_list FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY depth, path, rel_list) AS rank FROM f) WHERE rank <= 5""")
def graph_paths(spark, d):
    nodes, edges = star_graph(spark, d)
    nation = table(spark, d, "nation").select(F.lit(0).alias("query_id"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name"))
    return graph.paths_between(edges, graph.entity_pairs(nation).drop("query_id"))


@query("""WITH names AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name <> '' UNION SELECT DISTINCT substr(lower(text), 1, 8) FROM benchmark WHERE text <> '')
SELECT doc_id, name, CAST(strpos(lower(text), lower(name)) AS INTEGER) AS first FROM documents JOIN names ON contains(lower(text), lower(name))""")
def name_mentions(spark, d):
    """Where documents name parts, or hold the beginnings of benchmark passages."""
    begun = table(spark, d, "benchmark").select(F.lower("text").substr(1, 8).alias("name"))
    return mentions.mentions(table(spark, d, "documents"), table(spark, d, "part").select(F.col("p_name").alias("name")).union(begun), "doc_id")


def brand_graph(spark, d) -> DataFrame:
    """Regions, nations, suppliers and the brands they deliver, which are hubs of all suppliers."""
    region, nation, supplier, part = (table(spark, d, t) for t in ("region", "nation", "supplier", "part"))
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("source"), F.col(b).alias("target"), F.lit(kind).alias("type"))
    delivered = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    brands = delivered.join(part, "p_partkey").select("s_suppkey", "p_brand").distinct().join(supplier, "s_suppkey")
    edges = edge(nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "r_name", "PART_OF")
    edges = edges.union(edge(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")), "s_name", "n_name", "BELONGS_TO"))
    return edges.union(edge(brands, "s_name", "p_brand", "USES")).withColumn("edge_id", F.concat_ws("|", "source", "type", "target"))


@query("""WITH edges AS (SELECT n_name AS source, r_name AS target, 'PART_OF' AS type FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, n_name, 'BELONGS_TO' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT DISTINCT s_name, p_brand, 'USES' FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
both_ways AS (SELECT source AS u, target AS v, type, source || '|' || type || '|' || target AS e FROM edges UNION ALL SELECT target, source, type, source || '|' || type || '|' || target FROM edges),
p AS (SELECT a.n_name AS source, b.n_name AS target FROM nation a JOIN nation b ON b.n_nationkey - a.n_nationkey BETWEEN 1 AND 2),
"""
+ "starts AS (SELECT DISTINCT source AS name FROM p), " + S_TRAILS + """,
t4 AS (SELECT start, v AS fin, 4 AS depth, list_append(nodes, v) AS nodes, list_append(rels, type) AS rels FROM t3 JOIN p ON start = source JOIN both_ways ON fin = u AND target = v WHERE NOT list_contains(es, e)),
a AS (SELECT start, fin, depth, nodes, rels FROM t1 UNION ALL SELECT start, fin, depth, nodes, rels FROM t2 UNION ALL SELECT start, fin, depth, nodes, rels FROM t3 UNION ALL SELECT * FROM t4),
f AS (SELECT source, target, depth, array_to_string(nodes, '->') || '@d' || depth AS path, array_to_string(rels, ',') AS rel_list FROM a JOIN p ON start = source AND fin = target)
SELECT source, target, CAST(rank AS INTEGER) AS rank, depth, path, rel_list FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY depth, path, rel_list) AS rank FROM f) WHERE rank <= 20""")
def graph_paths_deep(spark, d):
    """Paths of up to four edges between nations of neighbouring keys."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    ahead = nation.select(F.col("n_name").alias("source"), F.explode(F.array(F.col("n_nationkey") + 1, F.col("n_nationkey") + 2)).alias("n_nationkey"))
    return graph.paths_between(brand_graph(spark, d), ahead.join(nation, "n_nationkey").select("source", F.col("n_name").alias("target")), 4, 20)


S_ENTITIES = "entities AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, CAST(n_nationkey AS BIGINT) AS pos, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey)"


def named_entities(spark, d) -> DataFrame:
    """Each region asks for its nations."""
    return table(spark, d, "nation").select(F.col("n_regionkey").cast("long").alias("query_id"), F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("name"))


@query(f"""WITH {S_GRAPH}, {S_ENTITIES}, starts AS (SELECT DISTINCT name FROM entities), {S_TRAILS}, {S_NEAR},
m AS (SELECT query_id, n.name, arg_min(type, {{'a': pos, 'b': distance}}) AS type, arg_min(distance, {{'a': pos, 'b': distance}}) AS distance FROM entities e JOIN neighbours n ON e.name = n.start GROUP BY 1, 2)
SELECT query_id, name, type, distance, '实体: ' || name || '; 类型: ' || type || '; 图谱距离: ' || distance AS content, round(0.7 / greatest(distance, 1), 9) AS score FROM m""")
def graph_search(spark, d):
    return graph.graph_search(*star_graph(spark, d), named_entities(spark, d))


@query(f"""WITH {S_GRAPH}, {S_ENTITIES}, starts AS (SELECT DISTINCT name FROM entities), {S_TRAILS}, a AS (SELECT start, depth, nodes, rels, array_to_string(nodes, '->') || '@d' || depth AS path, array_to_string(rels, ',') AS rel_list FROM (SELECT * FROM t1 UNION ALL SELECT * FROM t2)),
few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY depth, path, rel_list) AS b FROM a) WHERE b <= 8),
m AS (SELECT * FROM (SELECT query_id, few.*, row_number() OVER (PARTITION BY query_id ORDER BY depth, path, rel_list) AS rank FROM entities e JOIN few ON e.name = start) WHERE rank <= 80),
vis AS (SELECT query_id, string_agg(DISTINCT n, ',' ORDER BY n) AS all_nodes FROM (SELECT query_id, unnest(nodes) AS n FROM m) GROUP BY 1)
SELECT query_id, CAST(rank AS INTEGER) AS rank, 'kg:' || nodes[1] || '->...->' || nodes[-1] || '@d' || depth AS chunk_id, 'kg' AS route, round(1 / rank, 9) AS score,
nodes[1] || array_to_string(list_transform(range(1, len(nodes)), lambda i: ' —[' || rels[i] || ']→ ' || nodes[i + 1]), '') AS content, depth, rels[1] AS relation, CASE WHEN rank = 1 THEN all_nodes ELSE array_to_string(nodes, ',') END AS visited FROM m JOIN vis USING (query_id) WHERE rank <= 20""")
def graph_path_hits(spark, d):
    return graph.path_hits(*star_graph(spark, d), named_entities(spark, d).withColumn("name", F.lower("name")))


@query(f"""WITH {S_GRAPH}, {S_ENTITIES}, starts AS (SELECT DISTINCT name FROM entities), {S_TRAILS}, a AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
p AS (SELECT a.query_id, a.name AS source, b.name AS target FROM entities a JOIN entities b USING (query_id) WHERE a.pos < b.pos),
f AS (SELECT query_id, source, target, depth, array_to_string(nodes, '->') || '@d' || depth AS path, array_to_string(rels, ',') AS rel_list FROM a JOIN p ON start = source AND fin = target)
SELECT query_id, source, target, CAST(rank AS INTEGER) AS rank, depth, path, rel_list FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source, target ORDER BY depth, path, rel_list) AS rank FROM f) WHERE rank <= 5""")
def graph_search_paths(spark, d):
    return graph.graph_search_paths(star_graph(spark, d)[1], named_entities(spark, d))


@query(f"""WITH {S_GRAPH}, starts AS (SELECT r_name AS name FROM region), {S_TRAILS}, k AS (SELECT name, min(type) AS type FROM nodes GROUP BY 1)
SELECT nodes[1] || '->' || nodes[2] || '@d1' AS path_id, 1 AS depth, a.name || ':' || a.type || ',' || b.name || ':' || b.type AS node_list, nodes[1] || '|' || rels[1] || '|' || nodes[2] AS rel_list FROM t1 JOIN k a ON a.name = nodes[1] JOIN k b ON b.name = nodes[2]""")
def graph_path_records(spark, d):
    nodes, edges = star_graph(spark, d)
    paths = graph.trails(edges, table(spark, d, "region").select(F.col("r_name").alias("name")), 1).withColumn("path_id", keys.path_id(F.col("nodes")))
    made = graph.path_record(nodes, paths.select("path_id", "nodes", "rels"))
    ends = lambda r: F.concat_ws("|", r["source"], r["type"], r["target"])
    return made.select("path_id", "depth", F.array_join(F.transform("node_list", lambda n: F.concat_ws(":", n["name"], n["type"])), ",").alias("node_list"), F.array_join(F.transform("rel_list", ends), ",").alias("rel_list"))


S_DEGREE = "ends AS (SELECT source AS name FROM edges UNION ALL SELECT target FROM edges), deg AS (SELECT n.name, n.type, coalesce(c, 0) AS degree FROM nodes n LEFT JOIN (SELECT name, count(*) AS c FROM ends GROUP BY 1) USING (name)), shown AS (SELECT * FROM deg ORDER BY degree DESC, name LIMIT 500)"


def shown_nodes(spark, d) -> tuple[DataFrame, DataFrame]:
    nodes, edges = star_graph(spark, d)
    full = nodes.withColumn("confidence", rules.confidence(F.lit(None))).withColumn("properties", F.create_map().cast("map<string,string>"))
    return graph.exported_nodes(full, edges), edges


@query(f"WITH {S_GRAPH}, {S_DEGREE} SELECT name AS id, name AS label, type, degree, CAST(0.8 AS DOUBLE) AS confidence, 'entity:' || name AS source FROM shown")
def graph_export_nodes(spark, d):
    return shown_nodes(spark, d)[0]


@query(f"WITH {S_GRAPH}, {S_DEGREE} SELECT source, target, type AS relation, CAST(0.5 AS DOUBLE) AS weight FROM edges WHERE source IN (SELECT name FROM shown) AND target IN (SELECT name FROM shown)")
def graph_export_links(spark, d):
    return graph.exported_links(*shown_nodes(spark, d))


@query(f"WITH {S_GRAPH}, {S_DEGREE} SELECT count(*) AS nodes, (SELECT count(*) FROM edges WHERE source IN (SELECT name FROM shown) AND target IN (SELECT name FROM shown)) AS links, count(DISTINCT type) AS types FROM shown")
def graph_view_stats(spark, d):
    shown, edges = shown_nodes(spark, d)
    return graph.shown_stats(shown, graph.exported_links(shown, edges))


@query(f"WITH {S_GRAPH}, {S_DEGREE} SELECT name AS id, degree FROM shown WHERE contains(lower(name), 'at') AND type <> 'Document' AND degree > 0 AND name IN (SELECT n_name FROM nation)")
def graph_labels(spark, d):
    shown, _ = shown_nodes(spark, d)
    existing = table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return graph.labelled(graph.view(shown, attachments=False, orphans=False, existing=existing), "AT").select("id", "degree")


@query(f"WITH {S_GRAPH} SELECT u AS name, count(*) AS n, md5(string_agg(v, ',' ORDER BY v)) AS digest FROM (SELECT DISTINCT u, v FROM both_ways) GROUP BY 1")
def graph_adjacency(spark, d):
    return graph.adjacency(star_graph(spark, d)[1]).select("name", F.size("neighbours").cast("long").alias("n"), F.md5(F.array_join("neighbours", ",").cast("binary")).alias("digest"))


@query(f"WITH {S_GRAPH}, {S_ENTITIES} SELECT query_id, e.name AS seed, source AS head, g.type AS relation, target AS tail, source || ' -[' || g.type || ']-> ' || target AS rendered FROM entities e JOIN edges g ON e.name = source OR e.name = target")
def graph_one_hop(spark, d):
    triples = star_graph(spark, d)[1].select(F.col("source").alias("head"), F.col("type").alias("relation"), F.col("target").alias("tail"))
    return graph.one_hop(triples, named_entities(spark, d).select("query_id", "name"))


# --- logs and sources ------------------------------------------------------------------------------------------------


@query("SELECT user_id AS client, date_trunc('hour', ts) AS window_start, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def rate_limit(spark, d):
    requests = table(spark, d, "events").select(F.col("user_id").alias("client"), "ts")
    return streams.over_limit(requests, 1, "1 hour").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
s AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i)
SELECT user_id AS service, ts, event_id AS call_id, CAST(streak AS BIGINT) AS streak FROM s WHERE event_type = 'error' AND streak % 2 = 0""")
def breaker_openings(spark, d):
    calls = table(spark, d, "events").select(F.col("user_id").alias("service"), "ts", F.col("event_id").alias("call_id"), (F.col("event_type") == "error").alias("failed"))
    return streams.openings(calls, 2).drop("failed")


@query(SQL["breaker_openings"].replace(", CAST(streak AS BIGINT) AS streak", ""))
def breaker_stream(spark, d):
    """Three batches of events in order, through a breaker that keeps its state between them and opens for no time at all."""
    calls = table(spark, d, "events").select(F.col("user_id").alias("service"), "ts", F.col("event_id").alias("call_id"), (F.col("event_type") == "error").alias("failed"))
    path = f"{shared_dir(spark)}/lodequery-calls-{uuid.uuid4().hex}"
    first, last = calls.agg(F.min("ts"), F.max("ts")).first()
    for i in range(3):  # files are taken by the time they were written
        low, high = first + (last - first) / 3 * i, first + (last - first) / 3 * (i + 1)
        part = calls.where((F.col("ts") >= F.lit(low)) & ((F.col("ts") < F.lit(high)) | F.lit(i == 2)))
        part.coalesce(1).write.mode("append").parquet(f"{path}/calls")
    landed = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/calls")
    kept = streams.as_streak(landed.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", streams.LATE), 2, 0)
    streams.with_rocksdb(spark)
    kept.where("opened").writeStream.format("parquet").option("path", f"{path}/opened").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    opened = spark.read.schema("service long, ts timestamp, call_id long").parquet(f"{path}/opened")
    return opened.withColumn("service", F.col("service").cast(calls.schema["service"].dataType)).withColumn("ts", F.col("ts").cast(calls.schema["ts"].dataType))


@query("SELECT user_id, arg_max(event_type, {'a': ts, 'b': event_id}) AS event_type, round(arg_max(value, {'a': ts, 'b': event_id}), 6) AS value FROM events GROUP BY 1")
def latest_state(spark, d):
    rows = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("seq"), "event_type", "value")
    return streams.latest(rows, ["user_id"], "seq").select("user_id", "event_type", F.round("value", 6).alias("value"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'file type' WHEN html IS NULL OR html = '' THEN 'empty file' ELSE 'taken' END AS outcome FROM pages""")
def upload_gate(spark, d):
    pages = table(spark, d, "pages").withColumn("file_name", F.concat(F.lit("p"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 3 == 0, ".exe").otherwise(".MD"))).withColumn("size", F.octet_length("html"))
    return files.upload_gate(pages).select("page_id", F.coalesce("rejected", F.lit("taken")).alias("outcome"))


@query(f"""WITH {S_HITS}, {S_WEIGHTED} SELECT query_id, string_agg('[chunk:' || rank || '] (source=' || split_part(matched_by, ',', 1) || ', score=' || printf('%.3f', fusion_score) || ')' || chr(10) || substr(content, 1, 120), chr(10) || chr(10) ORDER BY rank) AS evidence FROM fused GROUP BY 1""")
def evidence_text(spark, d):
    fused = fusion.weighted(all_hits(spark, d))
    line = rules.evidence_line(F.col("rank"), F.element_at("matched_by", 1), F.col("fusion_score"), F.substring("content", 1, 120))
    return fused.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda s: s["line"]), "\n\n").alias("evidence"))
