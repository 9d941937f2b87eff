"""Pages put together are the unpaged read; seeks reach the scan; invariants of real tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from chronofold.operators import analytics, quality, temporal
from chronofold.plans import research
from chronofold.schemas import REGISTRY
from chronofold.sources import projections as P

T = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def obs(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice([None, *[T + dt.timedelta(days=i) for i in range(15)]]), T + dt.timedelta(minutes=rng.randrange(40)), rng.choice([None, 1.0, 2.5]), i) for i in range(160)]
    return spark.createDataFrame(rows, "series_id long, ts timestamp_ntz, as_of timestamp_ntz, value double, event_id long").persist()


def pages(df, name, query, limit, **options):
    cursor, out, n = None, [], 0
    while True:
        rows, cursor = research.page(df, name, query, cursor, limit, **options)
        got = rows.collect()
        assert len(got) <= limit
        out, n = out + got, n + 1
        if cursor is None:
            return out, n


@pytest.mark.parametrize("query", [research.Read(), research.Read(as_of="2024-01-01 00:20:00"), research.Read(between=("2024-01-01 00:05:00", "2024-01-01 00:30:00")), research.Read(equal={"series_id": 1, "value": 1.0})])
@pytest.mark.parametrize("limit", [23, 500])
def test_pages_are_the_read(obs, query, limit):
    got, n = pages(obs, "observation", query, limit)
    want = research.read(obs, "observation", query)
    order = [F.col(c.lstrip("-")).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in research._places("observation", query)]
    assert got == want.orderBy(*order).collect() and (n > 1) == (len(got) >= limit)


@pytest.mark.parametrize("name", ["filing_event", "entity_version", "canonical_financial", "disclosures_version", "entity_quality_score", "entity_lineage", "financial_line_item"])
def test_pages_of_every_read(spark, sf, name):
    df = P.ALL[name](spark, sf).where(F.col("entity_id") < 6 if name != "entity_lineage" else F.col("from_entity_id") < 12).persist()
    for query in (research.Read(as_of="1998-06-15 00:00:00"), research.Read(between=("1995-01-01 00:00:00", "1998-01-01 00:00:00"))):
        want = research.read(df, name, query)
        got, n = pages(df, name, query, max(2, want.count() // 2))
        assert sorted(map(repr, got)) == sorted(map(repr, want.collect())) and n >= 2
    df.unpersist()


def test_seek_reaches_the_scan(spark, sf):
    x, q = P.observation(spark, sf), research.Read(as_of="2024-01-15 12:00:00")
    _, cursor = research.page(x, "observation", q, limit=20)
    plan = research.page(x, "observation", q, cursor, 20)[0]._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "GreaterThanOrEqual(user_id," in scan[scan.index("PushedFilters") :]


def test_cursors_are_checked(obs):
    _, cursor = research.page(obs, "observation", research.Read(), limit=5)
    for other in (research.Read(as_of="2024-01-01 00:20:00"), research.Read(equal={"series_id": 1}), research.Read(closed={"value": (1, None)})):
        with pytest.raises(ValueError, match="cursor"):
            research.page(obs, "observation", other, cursor)
    with pytest.raises(ValueError, match="limit"):
        research.page(obs, "observation", research.Read(), limit=501)
    assert research.page(obs.where("false"), "observation", research.Read())[1] is None


def test_events_and_lineage(spark):
    rows = [(1, "A", 1, 5, T, T, None, '{"counterparty":"x","amount":1}', "r1", "m1", "p1", bytearray(b"\x01\xff")), (2, "B", 1, 5, T + dt.timedelta(days=3), T, None, "{}", "r2", "m2", "p2", None)]
    x = spark.createDataFrame(rows, "filing_id long, event_type string, event_seq int, entity_id long, event_ts timestamp_ntz, as_of timestamp_ntz, superseded_at timestamp_ntz, payload string, row_no string, primary_model_version string, primary_prompt_version string, input_text_sha256 binary")
    got, lineage = research.events_with_lineage(x, research.Read(), occurred_to="2024-01-02 00:00:00")
    assert [tuple(r) for r in lineage.collect()] == [("m1", "p1", "01ff")] and "REDACTED" in got.first()["payload"]
    assert [r["model_identity"] for r in research.events_with_lineage(x, research.Read())[1].collect()] == ["m2"]
    assert research.events_with_lineage(x, research.Read(equal={"filing_id": 9}))[1].count() == 0


def test_warnings_go_along(spark, sf):
    rows, warning = research.canonical(P.canonical_financial(spark, sf), 5, research.Read())
    held = research.warned(rows, warning).select("warnings").distinct().collect()
    assert [[(w["code"], w["n"]) for w in r["warnings"]] for r in held] == [[("TAS29_PRESENT", rows.where("restatement_basis = 'cpi_normalized'").count())]]
    assert research.warned(rows, warning.where("false")).select(F.size("warnings")).distinct().collect()[0][0] == 0


def test_financials_by_consolidation(spark):
    line = lambda c, p, v: (1, "is.1", dt.date(2024, 3, 31), p, c, "TRY", "ifrs", "as_reported", dt.date(9999, 1, 1), 1000, v, T, "r")
    kind = "entity_id long, canonical_code string, period_end date, period_type string, consolidation string, currency_code string, accounting_standard string, restatement_basis string, cpi_base_date date, mapping_version int, value double, as_of timestamp_ntz, row_no string"
    x = spark.createDataFrame([line("solo", "q", 1.0), line("consolidated", "q", 2.0), line("consolidated", "y", 3.0)], kind)
    scores = x.withColumn("score", F.col("value").cast("int"))
    for p, c, v in (("q", "solo", 1), ("q", "consolidated", 2), ("y", "consolidated", 3)):
        assert [(r["lines"], r["score"]) for r in analytics.entity_financials(x, scores, period_type=p, consolidation=c).collect()] == [({"is.1": v}, v)]
    assert analytics.entity_financials(x, scores, period_type="y", consolidation="solo").count() == 0


def test_invariants_read_the_schemas(spark, sf, tmp_path):
    tables = {n: f(spark, sf) for n, f in P.ALL.items()}
    path = str(tmp_path / "t")
    quality.guarded(temporal.interval(tables["entity_version"], "entity_version", "1995-01-01 00:00:00", "1995-02-01 00:00:00")).write.parquet(path)
    tables["entity_version"] = spark.read.parquet(path)
    tables["extra"] = tables["observation"].limit(1)
    tables["observation"] = quality.guarded(tables["observation"]).unionByName(tables["observation"].limit(2).withColumn("as_of", F.lit(None).cast("timestamp_ntz")))
    seen = {r["name"]: (r["has_as_of"], r["guarded"]) for r in quality.described(tables).collect()}
    assert seen["entity_version"] == (True, True) and seen["filing_event"] == (True, False) and seen["price"] == (False, False)
    got = {r["name"]: (r["violations"], r["status"]) for r in quality.bitemporal_invariants(tables, REGISTRY).collect()}
    assert got["registry_completeness"] == (1, "FAIL") and got["observation_as_of_not_null"] == (2, "FAIL")
    assert got["append_only_marks"][0] in (6, 7) and len(got) == 8
