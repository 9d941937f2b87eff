"""Durable state, canonical values from a manifest, roles and the counting of overlaps."""

import random

import pytest

from chronofold.operators import analytics, entities, mapping, roles, temporal
from chronofold.operators.audit import Context
from chronofold.operators.state import Audit, Runs, Watermarks
from chronofold.plans import research


def test_watermarks_outlive_the_object(spark, tmp_path):
    w = Watermarks(spark, f"{tmp_path}/w")
    assert w.get("j", "k") is None and w.list_for_job("j").count() == 0
    assert w.advance("j", "k", "1", None) and not w.advance("j", "k", "2", None) and w.advance("j", "k", "2", "1")
    w.set("j", "b", "9")
    again = Watermarks(spark, f"{tmp_path}/w")
    assert [(r["key"], r["value"]) for r in again.list_for_job("j").collect()] == [("b", "9"), ("k", "2")]
    assert again.get("j", "k") == "2" and again.get("x", "k") is None and not again.advance("j", "k", "3", "1")


def test_runs_are_stored(spark, tmp_path):
    runs = Runs(spark, f"{tmp_path}/r")
    with runs.start("a", "s", "job") as run:
        run.count("docs", 3)
        assert {r["status"] for r in runs.table().collect()} == {"running"}
    with pytest.raises(RuntimeError), runs.start("b", "s", "job"):
        raise RuntimeError("broken")
    got = {r["run_id"]: r for r in Runs(spark, f"{tmp_path}/r").table().collect()}
    assert (got["a"]["status"], got["a"]["counters"]) == ("succeeded", {"docs": 3})
    assert (got["b"]["status"], got["b"]["error"]) == ("failed", "broken") and got["b"]["finished_at"] is not None


def test_audit_records(spark, tmp_path):
    audit = Audit(spark, f"{tmp_path}/a")
    audit.record("1", "filing.create", "filing", {"id": 1}, Context("u", "user"), after={"b": 1, "a": "ç"})
    audit.record("2", "filing.delete", "filing", {"id": 1}, Context(), before={"a": 1})
    with pytest.raises(PermissionError):
        audit.record("3", "x", "y", {}, Context(), strict=True)
    got = {r["event_id"]: r for r in audit.rows().collect()}
    assert set(got) == {"1", "2"} and got["1"]["after"] == '{"a": "ç", "b": 1}' and got["1"]["before"] is None
    assert got["2"]["actor_id"] == "system:unknown" and got["1"]["actor_kind"] == "user"


def test_canonical_values(spark):
    lines = [
        mapping.Line("r", "is", "pick_first", ("b", "a")), mapping.Line("s", "is", "sum_components", ("c", "d")), mapping.Line("x", "is", "residual", parent="r", components=("s", "none")),
        mapping.Line("f", "is", formula="r - s"), mapping.Line("g", "is", formula="f + missing"),
    ]
    rows = [(1, "a", 5.0), (1, "b", 7.0), (1, "c", 1.0), (1, "d", 2.0), (1, "d", 9.0), (1, "other", 3.0), (2, "a", 4.0), (2, "b", None), (3, "c", None)]
    df = spark.createDataFrame(rows, "k long, line_code string, value double")
    got = {(r["k"], r["canonical_code"]): (r["value"], r["n_sources"]) for r in mapping.canonical_values(df, lines, ["k"]).collect()}
    assert got == {(1, "r"): (7.0, 2), (1, "s"): (3.0, 2), (1, "x"): (4.0, 0), (1, "f"): (4.0, 0), (2, "r"): (4.0, 1), (2, "x"): (4.0, 0)}
    assert mapping.canonical_values(df.limit(0), lines, ["k"]).count() == 0


def test_manifest_errors():
    assert mapping.terms("a.x + b - c") == [(1, "a.x"), (1, "b"), (-1, "c")]
    for bad in ("a b", "a * b", "+", "a +"):
        with pytest.raises(ValueError):
            mapping.terms(bad)
    for bad in ({"mode": "best"}, {}, {"mode": "residual"}):
        with pytest.raises(ValueError):
            mapping.Line("x", "is", **bad)


def test_roles(spark):
    df = spark.createDataFrame([(1, "text", "u")], "filing_id long, body_text string, actor_id string")
    assert roles.visible(df, "filing_body").columns == ["filing_id", "actor_id"] and roles.visible(df, "entity").columns == df.columns
    with pytest.raises(PermissionError):
        roles.visible(df, "api_key")


def test_overlaps_are_counted_like_pairs(spark):
    rng = random.Random(3)
    rows = [(i, "n", rng.choice("abc"), f"2000-01-{rng.randint(1, 9):02}", f"2000-01-{rng.randint(1, 12):02}") for i in range(120)]
    df = spark.createDataFrame(rows, "identifier_id long, namespace string, value string, f string, t string").selectExpr("identifier_id", "namespace", "value", "cast(f as date) valid_from", "cast(t as date) valid_to")
    want = {(r["value"], r["count"]) for r in entities.overlaps(df).groupBy("value").count().collect()}
    assert {(r["value"], r["n"]) for r in entities.overlap_counts(df).collect()} == want and want


def test_lineage_of_versions_with_ties_and_null_ends(spark):
    v = spark.createDataFrame([(1, "2000-01-05", 1), (1, "2000-01-01", 2), (2, None, 3)], "entity_id long, a string, row_no long").selectExpr("entity_id", "cast(a as timestamp_ntz) as_of", "row_no")
    edges = [("merged", 1, 2, "2000-01-02", 1, "x"), ("merged", 1, 2, "2000-01-02", 2, "y"), ("merged", 1, 2, "2000-01-09", 3, "z"), ("split", None, 1, "2000-01-03", 4, "n"), ("split", 1, 1, "2000-01-01", 5, "s")]
    e = spark.createDataFrame(edges, "event_kind string, from_entity_id long, into_entity_id long, a string, row_no long, reason string").selectExpr("event_kind", "from_entity_id", "into_entity_id", "date'2000-01-01' event_at", "cast(a as timestamp_ntz) as_of", "row_no", "reason")
    got = sorted((r["row_no"], r["l_reason"]) for r in temporal.lineage_as_of(v, e).collect())
    assert got == [(1, "n"), (1, "s"), (1, "y"), (2, "s")]


def test_pages_refuse_what_is_out_of_range(spark):
    df = spark.createDataFrame([(1, "a", None)], "entity_id long, legal_name string, ticker string")
    for args in ((0, 0), (101, 0), (1, -1), (1, 10_001), (1, 0, "x" * 101)):
        with pytest.raises(ValueError):
            analytics.entity_page(df, *args)
    assert research.FILINGS_WARNING["code"] == "PRE_BITEMPORAL_TABLE"
