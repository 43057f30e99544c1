import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodequery.operators import answers as A
from lodequery.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def landed(spark, folder, batches, schema):
    """A stream of one file for each batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return q, stream.sparkSession.table(name)


def test_breaker_state_leaves_after_the_timeout(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    S.with_rocksdb(spark)
    try:
        calls = [("a", at(0), 1, True), ("a", at(1), 3, True), ("a", at(1), 2, False), ("b", at(2), 4, True)]
        more = [("a", at(3), 5, True), ("a", at(4), 6, True), ("a", at(4.1), 7, True), ("c", at(5), 8, False)]
        far = [("c", at(500), 9, True)]
        farther = [("c", at(501), 10, True)]
        schema = "service string, ts timestamp, call_id long, failed boolean"
        stream = landed(spark, str(tmp_path / "calls"), [calls, more, far, farther], schema).withWatermark("ts", "1 minute")
        q, got = run(S.as_streak(stream, 2, 90), tmp_path, "kept")
        rows = {r.call_id: (r.allowed, r.opened) for r in got.collect()}
        # 3 follows 2 by id and starts a run that 5 completes; 6 and 7 fall into the open time
        assert rows[3] == (True, False) and rows[5] == (True, True) and rows[6] == rows[7] == (False, False) and rows[10] == (True, True)
        state = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
        assert max(state) > state[-1]  # a and b are gone
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


@pytest.mark.parametrize("what,name,batch", [("tool", "necessity", A.tool_necessity), ("node", "coverage", lambda made, seen: A.audit_coverage(seen, made))])
def test_joined_streams_like_their_batch_twins(spark, tmp_path, what, name, batch):
    schema = f"run_id string, {what} string, ts timestamp"
    made = [("r1", "x", at(0)), ("r1", "y", at(1)), ("r1", "x", at(2)), ("r2", "x", at(3))]
    seen = [("r1", "y", at(20)), ("r2", "z", at(5))]
    late_made, late_seen = [("r2", "y", at(12)), ("r3", "x", at(30))], [("r2", "x", at(14)), ("r3", "x", at(29)), ("r1", "y", at(21))]
    flush = [("end", "end", at(900))]
    left = landed(spark, str(tmp_path / "made"), [made, late_made, flush, flush], schema)
    right = landed(spark, str(tmp_path / "seen"), [seen, late_seen, flush, flush], schema)
    _, rows = run(S.matched_stream(left, right, what, "1 hour", "10 minutes"), tmp_path, f"rows_{name}")
    every = [spark.createDataFrame(a + b, schema) for a, b in ((made, late_made), (seen, late_seen))]
    want = {tuple(r) for r in batch(*every).collect()}
    assert {tuple(r) for r in S.share_of_matched(rows.where("run_id != 'end'"), what, name).collect()} == want and len(want) == 3


def test_fix_rate_stream(spark, tmp_path):
    schema = "run_id string, rewrites int, final_decision string"
    batches = [[("a", 1, "use"), ("b", 0, "use")], [("c", 2, None), ("d", 1, "USE")], [("e", 1, "abstain")]]
    stream = landed(spark, str(tmp_path / "runs"), batches, schema)
    _, got = run(S.fix_rate_stream(stream), tmp_path, "fixed", "complete")
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    assert got.collect() == A.fix_rate(whole).collect() == [(0.5, 4)]
