"""Point-in-time reads in SQL against those of the library."""

import pytest

from chronofold.operators import temporal
from chronofold.plans import table_functions
from chronofold.schemas import REGISTRY
from chronofold.sources import projections as P


@pytest.fixture(scope="module")
def functions(spark, sf):
    return table_functions.register(spark, {n: P.ALL[n](spark, sf) for n in (*REGISTRY, "identifier")})


@pytest.mark.parametrize("table", sorted(REGISTRY))
@pytest.mark.parametrize("at", ["1995-03-01 00:00:00", "2024-01-15 12:00:00"])
def test_function_is_the_read(spark, sf, functions, table, at):
    got = spark.sql(f"SELECT * FROM {table_functions.name(table)}(TIMESTAMP '{at}')")
    want = temporal.pit(P.ALL[table](spark, sf), table, at).select(got.columns)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_nine_functions(functions):
    assert sorted(functions) == sorted(f"{n}_at" for n in ("observation", "financial_line_item", "canonical_financial", "entity_quality_score", "entity", "entity_lineage", "filing_event", "disclosures", "identifier"))


def test_key_filters_reach_the_scan(spark, functions):
    plan = spark.sql("SELECT value FROM observation_at(TIMESTAMP '2024-01-15 12:00:00') WHERE series_id = 7 AND value > 3")._jdf.queryExecution().executedPlan().toString()
    scan = plan[plan.index("FileScan") :]
    assert "EqualTo(user_id,7)" in scan and "GreaterThan(value" not in scan and plan.count("Window [") == 1


def test_time_zones_and_nulls(spark, functions):
    one = spark.sql("SELECT count(*) AS n FROM observation_at(TIMESTAMP '2024-01-10 12:00:00+03:00')").first()["n"]
    assert one == spark.sql("SELECT count(*) AS n FROM observation_at(TIMESTAMP '2024-01-10 09:00:00Z')").first()["n"] > 0
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert spark.sql("SELECT count(*) AS n FROM observation_at(TIMESTAMP '2024-01-10 18:00:00')").first()["n"] == one
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert spark.sql("SELECT * FROM observation_at(CAST(NULL AS TIMESTAMP))").count() == 0


def test_odd_tables(spark):
    x = spark.createDataFrame([(1, "a b", None)], "identifier_id long, `odd name` string, valid_from date").withColumn("valid_to", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("date"))
    assert table_functions.register(spark, {"identifier": x}, prefix="odd_") == ["odd_identifier_at"]
    assert spark.sql("SELECT `odd name` FROM odd_identifier_at(current_timestamp())").count() == 0
    with pytest.raises(KeyError):
        table_functions.register(spark, {"nothing": x})
