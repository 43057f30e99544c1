"""A keyword index on shared storage that grows by additions, from batches or a stream, and stays searchable.

An addition is a part: blocks of postings sorted by term, document frequencies, and last of all one row in the log of commits. A
part without its row was interrupted; it isn't read, and the same addition writes it again. An addition that names its
batch is made once, however often it is run. FAN parts of a level are merged to one of the next level, so additions leave
at most FAN - 1 parts on each of log-many levels; a merged part's row names the parts that it replaces, and that row alone makes
the exchange. The log also keeps how many terms have each document frequency: an addition moves the terms it touches, so that
a search knows the mean idf without reading the dictionary. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.blockmax import BlockIndex, gathered, mean_idf, pieces_of, totals, uncut
from ..operators.search import K1, B, Segment
from ..tables import written

FAN = 8
LOG = "seq long, part string, level int, replaces array<string>, batch string, docs long, tokens long, fold boolean, k1 double, b double, frequencies map<long,long>"


@dataclass(frozen=True)
class State:
    """What the log says: live parts and their levels, batches that were added, totals, and terms by document frequency."""

    seq: int
    live: dict[str, tuple[int, int, int]]  # part: level, documents, tokens
    batches: frozenset[str]
    frequencies: Counter
    fold: bool
    k1: float
    b: float

    @property
    def docs(self) -> int:
        return sum(n for _, n, _ in self.live.values())

    @property
    def tokens(self) -> int:
        return sum(n for _, _, n in self.live.values())


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def state(spark: SparkSession, path: str) -> State | None:
    """None before the first addition. The log has a row for each addition and merge."""
    if not _exists(spark, f"{path}/log"):
        return None
    rows = spark.read.schema(LOG).parquet(f"{path}/log").orderBy("seq").collect()
    if not rows:
        return None
    gone = {p for r in rows for p in r["replaces"]}
    live = {r["part"]: (r["level"], r["docs"], r["tokens"]) for r in rows if r["part"] not in gone}
    last = rows[-1]
    return State(last["seq"], live, frozenset(r["batch"] for r in rows if r["batch"]), Counter(last["frequencies"]), last["fold"], last["k1"], last["b"])


def _read(spark: SparkSession, path: str, name: str, parts: list[str]) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{name}").parquet(*(f"{path}/{name}/part={p}" for p in parts)).withColumn("part", F.col("part").cast("string"))


def _write(blocks: DataFrame, path: str, part: str) -> DataFrame:
    """Blocks of a part. They stay in the partitions they were made in. What an interrupted run left is replaced."""
    blocks.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/blocks/part={part}")
    return _read(blocks.sparkSession, path, "blocks", [part]).drop("part")


def _write_terms(blocks: DataFrame, path: str, part: str) -> DataFrame:
    """(term, df) of a part's blocks."""
    df = blocks.where("term is not null").groupBy("term").agg(F.sum(F.size("entries.tf")).alias("df"))
    df.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms/part={part}")
    return _read(blocks.sparkSession, path, "terms", [part]).drop("part")


def _commit(spark: SparkSession, path: str, row: tuple) -> None:
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")


def _moved(spark: SparkSession, path: str, before: State | None, added: DataFrame) -> Counter:
    """Terms by document frequency after an addition: only its own terms are looked up."""
    if not before or not before.live:
        return Counter({r["df"]: r["count"] for r in added.groupBy("df").count().collect()})
    out = Counter(before.frequencies)
    old = _read(spark, path, "terms", list(before.live)).select("term", "df")
    known = old.join(added.select("term"), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("old"))
    both = added.join(known, "term", "left").select(F.coalesce("old", F.lit(0)).cast("long").alias("old"), (F.coalesce("old", F.lit(0)) + F.col("df")).cast("long").alias("new"))
    moves = both.select(F.explode(F.array(F.struct(F.col("old").alias("df"), F.lit(-1).alias("by")), F.struct(F.col("new").alias("df"), F.lit(1).alias("by")))).alias("m"))
    # a row for each different frequency
    for r in moves.where("m.df > 0").groupBy("m.df").agg(F.sum("m.by").alias("by")).collect():
        out[r["df"]] += r["by"]
    return Counter({df: n for df, n in out.items() if n})


def append(docs: DataFrame, path: str, batch: str | None = None, fold: bool = False, key: str = "doc_id", text: str = "text", k1: float = K1, b: float = B, segment: Segment | None = None, fan: int = FAN) -> bool:
    """Add documents; whether anything was done. A batch that was added before is not added again.

    The first addition decides on fold, k1 and b. Documents without tokens count for the mean length (those without a character
    don't if tokens are folded); an id that is added twice is two documents.
    """
    spark, before = docs.sparkSession, state(docs.sparkSession, path)
    if before and batch is not None and batch in before.batches:
        return False
    if before:
        fold, k1, b = before.fold, before.k1, before.b
    part = f"b{uuid.uuid5(uuid.NAMESPACE_OID, batch).hex}" if batch is not None else f"a{uuid.uuid4().hex}"
    pieces = _write(pieces_of(uncut(docs, key, text, fold, segment)), path, part)
    n, tokens = totals(pieces)
    blocks = gathered(pieces)
    if blocks is not pieces:
        pieces = _write(written(blocks, "gathered"), path, part)
    frequencies = _moved(spark, path, before, _write_terms(pieces, path, part))
    _commit(spark, path, ((before.seq if before else 0) + 1, part, 0, [], batch, n, tokens, fold, k1, b, dict(frequencies)))
    while merge(spark, path, fan):
        pass
    return True


def merge(spark: SparkSession, path: str, fan: int = FAN) -> bool:
    """Merge the parts of the lowest level that has `fan` of them; whether there was one. Replaced parts stay on disk until vacuum."""
    now = state(spark, path)
    if not now:
        return False
    for level in sorted({x for x, _, _ in now.live.values()}):
        parts = sorted(p for p, (x, _, _) in now.live.items() if x == level)
        if len(parts) < fan:
            continue
        docs, tokens = sum(now.live[p][1] for p in parts), sum(now.live[p][2] for p in parts)
        blocks = _read(spark, path, "blocks", parts).withColumn("block", F.hex(F.xxhash64("part", "block"))).drop("part")
        name = f"m{now.seq + 1}-{uuid.uuid4().hex}"
        _write_terms(_write(gathered(blocks), path, name), path, name)
        _commit(spark, path, (now.seq + 1, name, level + 1, parts, None, docs, tokens, now.fold, now.k1, now.b, dict(now.frequencies)))
        return True
    return False


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the files of parts that no search reads any more; how many. For a time when no older reader is at work."""
    now, n = state(spark, path), 0
    for name in ("blocks", "terms"):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        files = where.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in files.listStatus(where) if now and files.exists(where) else []:
            part = f.getPath().getName().removeprefix("part=")
            if part not in now.live:
                files.delete(f.getPath(), True)
                n += name == "blocks"
    return n


def load(spark: SparkSession, path: str, segment: Segment | None = None) -> BlockIndex:
    """The index as the log has it now."""
    now = state(spark, path)
    if not now:
        raise ValueError(f"no keyword index at {path}")
    parts = list(now.live)
    return BlockIndex(_read(spark, path, "blocks", parts), _read(spark, path, "terms", parts).drop("part"), now.docs, now.tokens, mean_idf(now.frequencies.items(), now.docs), now.fold, now.k1, now.b, segment)


def keep(docs: DataFrame, path: str, checkpoint: str, name: str = "documents", fan: int = FAN, segment: Segment | None = None, once: bool = False, **options) -> StreamingQuery:
    """Keep the index up with a stream of documents. A batch that is run again after a failure changes nothing.

    name tells streams into one index apart; options as for append.
    """

    def add(batch: DataFrame, number: int) -> None:
        append(batch, path, f"{name}:{number}", fan=fan, segment=segment, **options)

    writer = docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
