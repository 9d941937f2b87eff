"""The stream pipeline from a folder of messages to its sinks."""

import datetime as dt
import hashlib
import json
import uuid

import pytest

from chronofold.streaming import events


def uid(event):
    return str(uuid.UUID(int=ord(event)))


def message(i, event, kind="entity.created", version=1, **extra):
    own = {f: "1" for f in events.KINDS.get(kind, ())}
    body = {"schema_version": version, "event_id": uid(event), "produced_at": "2024-01-01T00:00:00Z", "producer_run_id": 7, "source_id": "s", "kind": kind} | own | extra
    return (f"{i}-0", json.dumps(body))


def test_drain(spark, tmp_path):
    rows = [message(1, "a"), message(2, "a"), message(3, "b"), message(4, "c", version=2), message(5, "d", version=0), message(6, "e", kind="nope"), message(7, "f", more="x"), ("8-0", "not json"), message(9, "g", kind="stream.entry_redacted", actor_kind="user", traceparent=None), message(10, "h", actor_kind="robot"), message(11, "i", produced_at="2024-01-01T00:00:00"), message(12, "j", event_id="j")]
    spark.createDataFrame(rows, "message_id string, payload string").write.parquet(f"{tmp_path}/in")
    put = '{"gone":true}'
    registry = spark.createDataFrame([(uid("b"), put, hashlib.sha256(put.encode()).hexdigest())], "event_id string, replacement string, sha256 string")
    for _ in range(2):  # the second run finds nothing new
        events.drain(spark, f"{tmp_path}/in", "message_id string, payload string", f"{tmp_path}/out", f"{tmp_path}/dead", f"{tmp_path}/ck", registry)
    good = {r["event_id"]: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert set(good) == {uid(x) for x in "abg"} and good[uid("b")]["payload"] == put and good[uid("b")]["is_redacted"] and not good[uid("a")]["is_redacted"]
    dead = {r["message_id"]: r["error"] for r in spark.read.parquet(f"{tmp_path}/dead").collect()}
    assert dead == {"4-0": "too_new", "5-0": "too_old", "6-0": "unknown_kind", "7-0": "extra_fields", "8-0": "not_json", "10-0": "bad_value", "11-0": "bad_value", "12-0": "bad_value"}


def test_replay_writes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    for _ in range(2):
        events.append_new(df, f"{tmp_path}/t", ["k"])
    assert spark.read.parquet(f"{tmp_path}/t").count() == 2


def test_days_of_a_batch_are_read(spark, tmp_path):
    day = lambda d: dt.datetime(2024, 1, d)
    schema = "k long, at timestamp"
    for rows in ([(1, day(1)), (2, day(2)), (4, None)], [(2, day(2)), (3, day(2)), (4, None)], []):
        events.append_new(spark.createDataFrame(rows, schema), f"{tmp_path}/t", ["k"], "at")
    assert sorted(r["k"] for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 2, 3, 4]


def test_dead_letters_of_two_groups_and_a_replay(spark, tmp_path):
    bad = spark.createDataFrame([("1-0", "p", "e" * 9000), ("2-0", None, "x")], "message_id string, payload string, error string")
    for stream, group in (("s", "g"), ("s", "h"), ("s", "g")):
        events.append_new(events.dead_letters(bad, stream, group), f"{tmp_path}/t", events.DEAD)
    rows = spark.read.parquet(f"{tmp_path}/t").collect()
    assert len(rows) == 4 and len({r["failure_id"] for r in rows}) == 4 and max(len(r["error"]) for r in rows) == 8000


def test_wrong_redaction_hash_is_an_error(spark):
    e = spark.createDataFrame([("a", "p")], "event_id string, payload string")
    bad = spark.createDataFrame([("a", "q", "0")], "event_id string, replacement string, sha256 string")
    with pytest.raises(Exception, match="mismatch"):
        events.redacted(e, bad).collect()


def test_sixth_failure_goes_to_the_dead_letters(spark, tmp_path):
    schema = "message_id string, at long"
    out = []
    for batch, n in enumerate((3, 2, 1, 4)):
        spark.createDataFrame([("m", i) for i in range(n)] + [("other", 1)] * (batch == 0), schema).write.mode("append").parquet(f"{tmp_path}/in")
        q = events.failures(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).foreachBatch(lambda b, _: out.extend((r["message_id"], r["n"]) for r in b.collect())).start()
        q.awaitTermination()
    assert out == [("m", 6)]


def test_monthly_rollup_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 5), 2.0), (1, dt.datetime(2024, 1, 9), 4.0), (1, dt.datetime(2024, 2, 1), None), (2, dt.datetime(2024, 2, 2), 1.0)]
    schema = "series_id long, ts timestamp, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    q = events.monthly(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("monthly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["series_id"], r["month"].month, r["last_value"], r["n"]) for r in spark.table("monthly").collect()} == {(1, 1, 4.0, 2), (2, 2, 1.0, 1)}
