"""The series catalog, audit records and stream publication."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronofold.operators import audit, entities, series
from chronofold.streaming import events

CATALOG = "series_id long, series_code string, source_id string, frequency string, unit string"


def test_series_identity_is_fixed_once_observed(spark):
    held = spark.createDataFrame([(1, "a", "s", "daily", "x"), (2, "b", "s", "daily", "x")], CATALOG)
    seen = spark.createDataFrame([(1,)], "series_id long")
    after, outcome = series.upsert_series(held, spark.createDataFrame([(2, "b", "s", "monthly", "x"), (3, "c", "s", "daily", "x")], CATALOG), seen)
    assert {r["series_code"]: r["outcome"] for r in outcome.collect()} == {"b": "changed", "c": "created"} and after.count() == 3
    with pytest.raises(entities.Conflict):
        series.upsert_series(held, spark.createDataFrame([(1, "a", "s", "monthly", "x")], CATALOG), seen)
    assert series.get(held, "a")["series_id"] == 1
    with pytest.raises(entities.Missing):
        series.get(held, "zz")


def test_identifying_series(spark):
    catalog = spark.createDataFrame([(1, "identifying"), (2, "none")], "series_id long, pii_class string")
    rows = spark.createDataFrame([(1, "text", None), (1, None, '{"a":1}'), (1, None, "{}"), (2, "text", None)], "series_id long, value_text string, metadata string")
    none = spark.createDataFrame([], "series_id long, subject_id string")
    assert sorted(r["rule"] for r in series.identifying_guard(rows, catalog, none).collect()) == ["clear_text", "metadata", "no_subject"]


def test_context_and_stamps(spark):
    assert audit.Context().resolved().actor_id == "system:unknown"
    with pytest.raises(PermissionError):
        audit.Context().resolved(strict=True)
    r = audit.stamp(spark.range(1), audit.Context("me", "user", request_id="r")).first()
    assert (r["actor_id"], r["client_ip"], r["request_id"]) == ("me", None, "r")


def test_append_only(spark):
    held = spark.createDataFrame([(1, 1)], "k long, as_of long")
    assert audit.append_only(held, spark.createDataFrame([(1, 2)], "k long, as_of long"), ["k", "as_of"]).count() == 1
    with pytest.raises(audit.AppendOnly):
        audit.append_only(held, held, ["k", "as_of"])


def test_run_lifecycle():
    with audit.ingestion_run("s", "j") as run:
        run.count("rows", 3)
    assert run.status == "succeeded" and run.counters == {"rows": 3} and run.finished_at >= run.started_at
    with pytest.raises(RuntimeError), audit.ingestion_run("s", "j", lambda: dt.datetime(2024, 1, 1)) as bad:
        raise RuntimeError("x" * 5000)
    assert bad.status == "failed" and len(bad.error) == 4000


def test_publish(spark):
    rows = spark.createDataFrame([("a", "k1"), ("b", "k2")], "event_id string, kind string")
    out, record = events.publish(rows, 5, "me")
    assert {r["stream"] for r in out.collect()} == {"events.k1", "events.k2"}
    assert record.first()["n_events"] == 2
    with pytest.raises(ValueError):
        events.publish(rows.unionByName(rows), 5, "me")


def test_configs(spark):
    schema = "name string, applies_from date, applies_to date, method string"
    d = dt.date
    held = spark.createDataFrame([("a", d(2020, 1, 1), d(2021, 1, 1), "m")], schema)
    out = series.upsert_configs(held, spark.createDataFrame([("a", d(2020, 1, 1), None, "n"), ("b", d(2020, 1, 1), None, "m")], schema))
    assert [(r["name"], r["method"]) for r in out.collect()] == [("a", "n"), ("b", "m")]
    with pytest.raises(ValueError):
        series.upsert_configs(held, held.withColumn("applies_to", F.lit("2019-01-01").cast("date")))


def test_lineage_and_patch(spark):
    e = spark.createDataFrame([(1, "x", {"a": "1", "b": "2"}), (2, "y", {"a": "1"})], "entity_id long, legal_name string, metadata map<string,string>")
    got = {r["entity_id"]: (r["legal_name"], r["metadata"]) for r in entities.patch(e, 1, {"b": "3", "c": "4"}, legal_name="z").collect()}
    assert got == {1: ("z", {"a": "1", "b": "3", "c": "4"}), 2: ("y", {"a": "1"})}
