"""The domain's tables as pure projections of a star schema, for queries over shared test data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

METRICS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quarter_end(col: str) -> Column:
    return F.last_day(F.add_months(F.trunc(F.col(col).cast("date"), "quarter"), 2))


def observation(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("series_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"), F.col("ts").alias("as_of"), "value", "event_id")


def series_catalog(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "events").select(F.col("user_id").alias("series_id")).distinct()
    source = F.element_at(F.array(F.lit("bist"), F.lit("tefas"), F.lit("evds")), (F.col("series_id") % 3 + 1).cast("int"))
    return ids.select("series_id", F.concat(F.lit("S"), F.col("series_id").cast("string")).alias("series_code"), source.alias("source_id"), F.when(F.col("series_id") % 2 == 0, "daily").otherwise("monthly").alias("frequency"))


def price(spark: SparkSession, d: str) -> DataFrame:
    """Long prices: one metric a row."""
    e = table(spark, d, "events")
    names = F.create_map(*[x for a, b in zip(METRICS, ("price_open", "price_high", "price_low", "price_close", "volume"), strict=True) for x in (F.lit(a), F.lit(b))])
    value = F.when(F.col("event_id") % 17 != 0, F.col("value"))
    return e.select((F.col("user_id") % 20).alias("entity_id"), names[F.col("event_type")].alias("metric"), "ts", value.alias("value"), "event_id")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey")
    x = li.join(o, li.l_orderkey == o.o_orderkey)
    statement = F.when(F.col("l_returnflag") == "A", "bs").when(F.col("l_returnflag") == "N", "is").otherwise("cf")
    row = F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"), F.round(F.col("l_discount") * 100).cast("long"), F.round(F.col("l_tax") * 100).cast("long"), F.col("l_quantity").cast("long"))
    return x.withColumn("statement_type", statement).withColumn("row_no", row).withColumn("period_end", _quarter_end("l_shipdate"))


def financial_line_item(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d)
    code = F.concat_ws(".", "statement_type", (F.col("l_partkey") % 20).cast("string"))
    return x.select(F.col("o_custkey").alias("entity_id"), F.col("l_orderkey").alias("filing_id"), "statement_type", code.alias("line_code"), F.when(F.col("l_linestatus") == "O", "consolidated").otherwise("solo").alias("consolidation"), "period_end", F.col("l_shipdate").alias("as_of"), F.col("l_extendedprice").alias("value"), "row_no")


def canonical_financial(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d)
    code = F.concat_ws(".", "statement_type", (F.col("l_partkey") % 5).cast("string"))
    cpi = F.col("l_linestatus") == "F"
    return x.select(
        F.col("o_custkey").alias("entity_id"), code.alias("canonical_code"), "period_end", F.lit("q").alias("period_type"), F.lit("consolidated").alias("consolidation"), F.when(F.col("l_suppkey") % 4 == 0, "USD").otherwise("TRY").alias("currency_code"), F.lit("ifrs").alias("accounting_standard"),
        F.when(cpi, "cpi_normalized").otherwise("as_reported").alias("restatement_basis"), F.when(cpi, F.lit("2022-12-31")).otherwise(F.lit("9999-01-01")).cast("date").alias("cpi_base_date"), (F.lit(1000) + F.col("l_linenumber")).cast("int").alias("mapping_version"), F.col("l_extendedprice").alias("value"), F.col("l_shipdate").alias("as_of"), "row_no",
    )


def entity_quality_score(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    state = F.when(F.col("o_orderstatus") == "F", "pass").when(F.col("o_orderstatus") == "O", "warn").otherwise("fail")
    checks = F.to_json(F.struct(F.struct(F.struct(state.alias("state"), F.round(F.col("o_totalprice") / 1000).cast("int").alias("delta_pct"), F.lit("x").alias("internal")).alias("balance"), F.struct(F.lit(80).alias("coverage_pct")).alias("coverage")).alias("checks")))
    return o.select(F.col("o_custkey").alias("entity_id"), _quarter_end("o_orderdate").alias("period_end"), F.lit("q").alias("period_type"), F.lit("consolidated").alias("consolidation"), F.lit("TRY").alias("currency_code"), F.lit("ifrs").alias("accounting_standard"), F.when(F.col("o_orderkey") % 2 == 0, "as_reported").otherwise("cpi_normalized").alias("restatement_basis"), F.lit("9999-01-01").cast("date").alias("cpi_base_date"), (1000 + F.col("o_orderkey") % 3).cast("int").alias("mapping_version"), F.floor(F.col("o_totalprice") % 101).cast("int").alias("score"), checks.alias("quality"), F.col("o_orderdate").alias("as_of"), F.col("o_orderkey").alias("row_no"))


def entity(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    start = F.lit("1990-01-01").cast("date")
    return c.select(F.col("c_custkey").alias("entity_id"), F.col("c_name").alias("legal_name"), F.lower("c_mktsegment").alias("entity_type"), F.when(F.col("c_custkey") % 11 == 0, "merged").when(F.col("c_custkey") % 7 == 0, "inactive").otherwise("active").alias("status"), F.date_add(start, (F.col("c_custkey") % 1000).cast("int")).cast("timestamp_ntz").alias("created_at"), F.date_add(start, (F.col("c_custkey") % 1000 + F.col("c_custkey") % 3).cast("int")).cast("timestamp_ntz").alias("updated_at"))


def entity_version(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", "updated").when(F.col("o_orderstatus") == "O", "renamed").otherwise("deleted")
    return o.select(F.col("o_custkey").alias("entity_id"), F.concat(F.lit("Entity "), F.col("o_orderpriority")).alias("legal_name"), kind.alias("event_kind"), F.col("o_orderdate").alias("as_of"), F.col("o_orderkey").alias("row_no"))


def identifier(spark: SparkSession, d: str) -> DataFrame:
    """Ticker ranges of each entity; some are empty and some overlap those of other entities."""
    o = table(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    to = F.coalesce(F.lead(F.col("o_orderdate").cast("date")).over(w), F.lit("9999-12-31").cast("date"))
    return o.select(F.col("o_orderkey").alias("identifier_id"), F.col("o_custkey").alias("entity_id"), F.when(F.col("o_orderkey") % 5 == 0, "isin").otherwise("ticker").alias("namespace"), F.concat(F.lit("T"), (F.col("o_custkey") % 400).cast("string")).alias("value"), F.col("o_orderdate").cast("date").alias("valid_from"), to.alias("valid_to"), (F.col("o_orderkey") % 2 == 0).alias("is_primary"))


def entity_lineage(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 3 = 0")
    return o.select(F.when(F.col("o_orderkey") % 2 == 0, "merged").otherwise("split").alias("event_kind"), F.col("o_custkey").alias("from_entity_id"), (F.col("o_custkey") * 7 % 1000).alias("into_entity_id"), F.trunc(F.col("o_orderdate").cast("date"), "year").alias("event_at"), F.col("o_orderdate").alias("as_of"), F.col("o_orderkey").alias("row_no"))


def disclosures_version(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    unknown = F.col("o_orderkey") % 13 == 0
    return o.select(F.concat_ws("-", F.col("o_custkey").cast("string"), F.substring("o_orderpriority", 1, 1)).alias("disclosure_id"), F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("form_type"), F.when(F.col("o_orderstatus") == "P", "deleted").when(F.col("o_orderstatus") == "F", "indexed").otherwise("republished").alias("event_kind"), F.when(unknown, "pre_bitemporal_unknown").otherwise("observed").alias("provenance"), F.when(~unknown, F.col("o_orderdate")).alias("as_of"), F.col("o_orderdate").alias("published_at"), F.col("o_orderkey").alias("row_no"))


def filing_event(spark: SparkSession, d: str) -> DataFrame:
    x = _lines(spark, d)
    w = Window.partitionBy("l_orderkey", "l_returnflag").orderBy("l_shipdate", "row_no")
    gone = F.when(F.col("l_partkey") % 2 == 0, F.lead("l_shipdate").over(w))
    payload = F.to_json(F.struct(F.concat(F.lit("party"), F.col("l_suppkey").cast("string")).alias("counterparty"), F.col("l_partkey").alias("amount")))
    return x.select(F.col("l_orderkey").alias("filing_id"), F.col("l_returnflag").alias("event_type"), F.col("l_linenumber").cast("int").alias("event_seq"), F.col("o_custkey").alias("entity_id"), F.col("l_shipdate").alias("event_ts"), F.col("l_shipdate").alias("as_of"), gone.alias("superseded_at"), payload.alias("payload"), "row_no")


def filing(spark: SparkSession, d: str) -> DataFrame:
    """Offered filings: a source, a reference that some share, and the bytes."""
    x = table(spark, d, "documents")
    return x.select(F.col("doc_id").alias("offer_id"), F.col("source").alias("source_id"), F.concat(F.lit("ref"), (F.col("doc_id") % 600).cast("string")).alias("source_ref"), F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n_chars"))


def outbox(spark: SparkSession, d: str) -> DataFrame:
    """Stream messages: every tenth event comes twice, some with other schema versions."""
    e = table(spark, d, "events")
    twice = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    version = F.when(F.col("event_id") % 29 == 0, 3).when(F.col("event_id") % 31 == 0, 0).otherwise(1)
    return e.select(F.col("event_id"), F.col("event_type").alias("kind"), F.col("ts").alias("produced_at"), version.alias("schema_version"), "user_id", "value", "props", F.explode(twice).alias("copy"))


ALL: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (observation, series_catalog, price, financial_line_item, canonical_financial, entity_quality_score, entity, entity_version, identifier, entity_lineage, disclosures_version, filing_event, filing, outbox)}
