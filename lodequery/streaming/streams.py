"""Structured Streaming: ingestion, upserts, rate limits, circuit breaking, run metrics. Each has a batch twin for tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.answers import EXPECTED_NODES
from ..operators.chunking import fixed_chunks, ingest_rows

LIMIT, WINDOW = 60, "1 minute"
FAILURES, OPEN_SECONDS, IDLE_SECONDS = 5, 30, 3600
LATE, WITHIN = "10 minutes", "1 hour"
#: Folders of an upserted table; tables have no such columns of their own.
BUCKET, VERSION = "__bucket", "__version"


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "doc_id long, text string"):
    """Documents that arrive as Parquet files, chunked and appended; started, to be awaited by the caller."""
    arrived = spark.readStream.schema(schema).parquet(source)
    return ingest_rows(fixed_chunks(arrived)).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def extract_entities(spark: SparkSession, source: str, target: str, checkpoint: str, extract: Callable[[DataFrame], DataFrame], chars: int = 3000, schema: str = "doc_id long, text string"):
    """A second stream over the documents that ingest() chunks: extract makes entity rows from the first `chars` characters of each.

    extract sees doc_id and content. Chunks overlap and are shorter than that, so it is the document that is read.
    """
    arrived = spark.readStream.schema(schema).parquet(source).where(F.coalesce("text", F.lit("")) != "").withColumn("content", F.substring("text", 1, chars)).drop("text")
    return extract(arrived).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert(stream: DataFrame, path: str, keys: list[str], order: str, checkpoint: str, buckets: int = 64):
    """The latest row of each key. The table is divided by a hash of the key; a batch writes a new version of the buckets it touches.

    A version is named by its batch, so a batch that is run again overwrites its own versions alone. A bucket's version before the
    last one is deleted. read_upserted() reads each bucket's last version.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
        rows = latest(batch, keys, order).withColumn(BUCKET, bucket)
        touched = [r[0] for r in rows.select(BUCKET).distinct().collect()]
        before = {b: v for b, v in versions(spark, path).items() if b in touched}
        old = [f"{path}/{BUCKET}={b}/{VERSION}={max(x for x in v if x < n)}" for b, v in before.items() if any(x < n for x in v)]
        if old:
            rows = spark.read.option("basePath", path).parquet(*old).drop(VERSION).unionByName(rows)
        kept = latest(rows, [*keys, BUCKET], order).withColumn(VERSION, F.lit(n).cast("long"))
        kept.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, VERSION).parquet(path)
        fs, hadoop = _file_system(spark, path)
        for b, v in before.items():
            for x in sorted(x for x in v if x < n)[:-1]:
                fs.delete(hadoop(f"{path}/{BUCKET}={b}/{VERSION}={x}"), True)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each bucket of an upserted table that are there in full."""
    fs, hadoop = _file_system(spark, path)
    out: dict[int, list[int]] = {}
    for status in fs.globStatus(hadoop(f"{path}/{BUCKET}=*/{VERSION}=*")) or []:
        bucket, v = (part.rpartition("=")[2] for part in status.getPath().toString().split("/")[-2:])
        out.setdefault(int(bucket), []).append(int(v))
    return out


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    last = [f"{path}/{BUCKET}={b}/{VERSION}={max(v)}" for b, v in versions(spark, path).items()]
    return spark.read.option("basePath", path).parquet(*last).drop(BUCKET, VERSION)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last value of every column for each key; append-only tables and last-write-wins fields meet here."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def over_limit(requests: DataFrame, limit: int = LIMIT, window: str = WINDOW) -> DataFrame:
    """(client, window_start, requests) where a client made more than `limit` requests in a window; streams need a watermark first."""
    return requests.groupBy("client", F.window("ts", window).alias("w")).agg(F.count("*").alias("requests")).where(F.col("requests") > limit).select("client", F.col("w.start").alias("window_start"), "requests")


def over_limit_stream(requests: DataFrame, limit: int = LIMIT, window: str = WINDOW) -> DataFrame:
    return over_limit(requests.withWatermark("ts", LATE), limit, window)


def failure_runs(calls: DataFrame) -> DataFrame:
    """calls (service, ts, call_id, failed) with `streak`: failures in a row up to this call, by gaps and islands."""
    w = Window.partitionBy("service").orderBy("ts", "call_id")
    island = calls.withColumn("island", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy("service", "island").orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, 0)
    return island.withColumn("streak", F.sum(F.col("failed").cast("long")).over(inner)).drop("island")


def openings(calls: DataFrame, failures: int = FAILURES) -> DataFrame:
    """Where a breaker that never waits would open: every `failures`-th failure in a row."""
    return failure_runs(calls).where(F.col("failed") & (F.col("streak") % failures == 0))


def breaker(calls: DataFrame, failures: int = FAILURES, open_seconds: int = OPEN_SECONDS) -> DataFrame:
    """A stream of calls (service, ts, failed) with `allowed`: calls while the breaker is open are refused and don't count.

    State of a service: failures in a row, and until when it is open, two numbers for each service there is.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, until = state.get if state.exists else (0, 0.0)
        for f in frames:
            f = f.sort_values("ts")
            allowed = []
            for ts, failed in zip(f["ts"], f["failed"], strict=True):
                now = ts.timestamp()
                ok = now >= until
                if ok:
                    run = run + 1 if failed else 0
                    if run >= failures:
                        run, until = 0, now + open_seconds
                allowed.append(ok)
            yield f.assign(allowed=allowed)[["service", "ts", "failed", "allowed"]]
        state.update((run, until))

    return calls.groupBy("service").applyInPandasWithState(step, "service string, ts timestamp, failed boolean, allowed boolean", "run int, until double", "append", GroupStateTimeout.NoTimeout)


def run_completeness(audit: DataFrame) -> DataFrame:
    """Progress of each run: share of expected nodes seen so far; as a stream, in update mode.

    Distinct nodes are counted by one flag for each expected node, which a streaming aggregation can keep.
    """
    seen = sum((F.max(F.when(F.col("node") == n, 1).otherwise(0)) for n in EXPECTED_NODES[1:]), F.max(F.when(F.col("node") == EXPECTED_NODES[0], 1).otherwise(0)))
    return audit.groupBy("run_id").agg((seen / len(EXPECTED_NODES)).alias("completeness"))


def as_streak(calls: DataFrame, failures: int = FAILURES, open_seconds: float = OPEN_SECONDS, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """The breaker with state that leaves: calls (service, ts, call_id, failed) with `allowed`, and `opened` where it opens.

    Needs a watermark on ts and the RocksDB state store (`with_rocksdb`). State of a service: failures in a row, until when it is
    open, and when it may be forgotten. Its timer clears it once the watermark is idle_seconds past the service's last call,
    so services that are gone cost nothing. Rows of a service are put in order of (ts, call_id) within a batch.
    """
    kinds = {f.name: f.dataType.simpleString() for f in calls.schema.fields}

    class Breaker(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.state = handle.getValueState("breaker", "run int, until double, leaves long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            run, until, leaves = self.state.get() if self.state.exists() else (0, 0.0, 0)
            batch = pd.concat(list(rows)).sort_values(["ts", "call_id"])
            allowed, opened = [], []
            for ts, failed in zip(batch["ts"], batch["failed"], strict=True):
                now = ts.timestamp()
                ok = now >= until
                run = (run + 1 if failed else 0) if ok else run
                opens = bool(ok and failed and run >= failures)
                if opens:
                    run, until = 0, now + open_seconds
                allowed.append(bool(ok))
                opened.append(opens)
            last = int((batch["ts"].iloc[-1].timestamp() + idle_seconds) * 1000)
            if last > leaves:
                self.handle.registerTimer(last)
            self.state.update((int(run), float(until), max(last, leaves)))
            yield batch.assign(allowed=allowed, opened=opened)[["service", "ts", "call_id", "failed", "allowed", "opened"]]

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            # a timer that later calls have overtaken clears nothing
            if self.state.exists() and expiredTimerInfo.getExpiryTimeInMs() >= self.state.get()[2]:
                self.state.clear()
            return iter([])

        def close(self) -> None:
            pass

    out = f"service {kinds['service']}, ts timestamp, call_id {kinds['call_id']}, failed boolean, allowed boolean, opened boolean"
    return calls.groupBy("service").transformWithStateInPandas(Breaker(), out, "Append", "EventTime")


def with_rocksdb(spark: SparkSession) -> SparkSession:
    """State with timers lives in RocksDB; streams that are started from now on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def matched_stream(made: DataFrame, seen: DataFrame, what: str, within: str = WITHIN, late: str = LATE) -> DataFrame:
    """(run_id, what, ts, hit): each different thing of a run that one stream has (run_id, what, ts), and whether the other has it.

    Streams join on run and thing, with times at most `within` apart; rows later than `late` are left out. A thing that is never
    matched is told once no match can come any more.
    """
    key = ["run_id", what]
    left = made.select(*key, "ts").withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
    right = seen.select(F.col("run_id").alias("run"), F.col(what).alias("thing"), F.col("ts").alias("seen_at")).withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["run", "thing"])
    near = F.expr(f"run_id = run AND `{what}` = thing AND seen_at BETWEEN ts - INTERVAL {within} AND ts + INTERVAL {within}")
    return left.join(right, near, "leftOuter").select(*key, "ts", F.col("run").isNotNull().alias("hit"))


def share_of_matched(rows: DataFrame, what: str, name: str) -> DataFrame:
    """(run_id, name) from the rows of matched_stream so far: tool necessity of tools, audit coverage of nodes."""
    different = rows.groupBy("run_id", what).agg(F.max(F.col("hit").cast("int")).alias("hit"))
    return different.groupBy("run_id").agg(F.round(F.sum("hit") / F.count("*"), 4).alias(name))


def fix_rate_stream(runs: DataFrame) -> DataFrame:
    """One row, in complete mode: the share of rewritten runs that ended in use so far, and how many were rewritten."""
    used = (F.lower(F.coalesce("final_decision", F.lit(""))) == "use").cast("double")
    return runs.where("rewrites > 0").agg(F.coalesce(F.avg(used), F.lit(0.0)).alias("fix_rate"), F.count("*").alias("rewritten_runs"))
