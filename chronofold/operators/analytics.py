"""Financial analytics over collapsed facts: periods, comparisons, dual bases, prices, rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.temporal import first_per_key

SENTINEL = "9999-01-01"


def latest_mapping(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """The newest mapping version of each key, whatever its as_of; as_of and the row settle ties."""
    return first_per_key(df, key, F.col("mapping_version").desc(), F.col("as_of").desc(), F.col("row_no").desc())


def entity_financials(canonical: DataFrame, scores: DataFrame, basis: str = "as_reported", statement: str | None = None, limit: int = 20, period_type: str | None = None, consolidation: str | None = None) -> DataFrame:
    """Per entity the newest periods, each with its lines as a map and its quality score. ``period_type`` and ``consolidation`` hold for lines and scores alike."""
    same = F.col("restatement_basis") == basis
    for column, value in (("period_type", period_type), ("consolidation", consolidation)):
        same = same if value is None else same & (F.col(column) == value)
    x = canonical.where(same)
    if statement:
        x = x.where(F.col("canonical_code").like(f"{statement}.%"))
    x = latest_mapping(x, ["entity_id", "canonical_code", "period_end"])
    lines = x.groupBy("entity_id", "period_end").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("canonical_code", "value")))).alias("lines"))
    newest = Window.partitionBy("entity_id").orderBy(F.col("period_end").desc())
    lines = lines.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit).drop("n")
    best = latest_mapping(scores.where(same), ["entity_id", "period_end"]).select("entity_id", "period_end", "score")
    return lines.join(best, ["entity_id", "period_end"], "left")


def compare_metric(canonical: DataFrame, entities: Sequence[int], code: str, basis: str = "as_reported", limit: int = 20) -> DataFrame:
    """The newest points of one line for each entity asked for, with an empty list where there are none."""
    if not 1 <= len(entities) <= 10 or len(set(entities)) < len(entities):
        raise ValueError("between one and ten different entities")
    x = canonical.where(F.col("entity_id").isin(list(entities)) & (F.col("canonical_code") == code) & (F.col("restatement_basis") == basis))
    x = latest_mapping(x, ["entity_id", "period_end"])
    newest = Window.partitionBy("entity_id").orderBy(F.col("period_end").desc())
    x = x.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= limit)
    points = x.groupBy("entity_id").agg(F.sort_array(F.collect_list(F.struct("period_end", "value")), asc=False).alias("points"))
    asked = canonical.sparkSession.createDataFrame([(e,) for e in entities], "entity_id long")
    return asked.join(points, "entity_id", "left").withColumn("points", F.coalesce("points", F.array().cast(points.schema["points"].dataType)))


def dual_series(canonical: DataFrame, code: str) -> DataFrame:
    """Both bases side by side per entity and period; the sentinel base date becomes null."""

    def side(basis: str, value: str) -> DataFrame:
        x = canonical.where((F.col("canonical_code") == code) & (F.col("restatement_basis") == basis))
        x = latest_mapping(x, ["entity_id", "period_end", "period_type"])
        base = F.when(F.col("cpi_base_date") != F.lit(SENTINEL).cast("date"), F.col("cpi_base_date"))
        return x.select("entity_id", "period_end", "period_type", F.col("value").alias(value), base.alias(f"{value}_base"))

    both = side("as_reported", "reported").join(side("cpi_normalized", "normalized"), ["entity_id", "period_end", "period_type"], "full_outer")
    return both.select("entity_id", "period_end", "period_type", "reported", "normalized", F.col("normalized_base").alias("cpi_base_date"))


def single_series(canonical: DataFrame, code: str, basis: str) -> DataFrame:
    """One basis, by period; the other basis is null."""
    x = latest_mapping(canonical.where((F.col("canonical_code") == code) & (F.col("restatement_basis") == basis)), ["entity_id", "period_end", "period_type"])
    none = F.lit(None).cast("double")
    value = F.col("value")
    return x.select("entity_id", "period_end", "period_type", (value if basis == "as_reported" else none).alias("reported"), (none if basis == "as_reported" else value).alias("normalized"))


def ohlcv(prices: DataFrame, start: str, end: str, limit: int | None = None) -> DataFrame:
    """Long prices to a row per entity and date; the earliest ts of a date wins and null counts as 0.

    A limit counts long rows, newest first, before the pivot. The pivot's values are given, so no pass looks for them.
    """
    day = F.col("ts").cast("date")
    x = prices.where(day.between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if limit:
        x = x.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(min(limit, 2000))
    names = ["price_open", "price_high", "price_low", "price_close", "volume"]
    first = [F.min_by(F.coalesce("value", F.lit(0.0)), F.when(F.col("metric") == m, F.struct("ts", "event_id"))).alias(m) for m in names]
    return x.groupBy("entity_id", day.alias("day")).agg(*first)


def metric_series(prices: DataFrame, metric: str, limit: int) -> DataFrame:
    """The newest points of a metric per entity; nulls go after the limit."""
    w = Window.partitionBy("entity_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    x = prices.where(F.col("metric") == metric).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    return x.where("value is not null").select("entity_id", "ts", "value")


def fundamentals(prices: DataFrame, prefix: str = "price_") -> DataFrame:
    """The newest value of each metric whose name matches the prefix (_ is a wildcard); nulls go after the collapse."""
    x = first_per_key(prices.where(F.col("metric").like(f"{prefix}%")), ["entity_id", "metric"], F.col("ts").desc(), F.col("event_id").desc())
    return x.where("value is not null").select("entity_id", F.regexp_replace("metric", f"^{prefix}", "").alias("name"), "ts", "value")


def monthly_rollup(observations: DataFrame) -> DataFrame:
    """Last, mean, least, most and number of the non-null values of a series and month; every restatement counts."""
    month = F.date_trunc("month", "ts").cast("timestamp_ntz")
    x = observations.where("value is not null")
    return x.groupBy("series_id", month.alias("month")).agg(F.max_by("value", F.struct("ts", "as_of", "event_id")).alias("last_value"), F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n"))


def quality_history(scores: DataFrame, limit: int = 20) -> DataFrame:
    """The newest scores per entity with the checks reduced to their public fields; a check without a state is unknown."""
    allowed = "map<string,struct<state:string,delta_pct:double,coverage_pct:double>>"
    w = Window.partitionBy("entity_id").orderBy(F.col("period_end").desc(), F.col("as_of").desc(), F.col("row_no").desc())
    x = scores.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    checks = F.from_json(F.get_json_object("quality", "$.checks"), allowed)
    public = F.transform_values(checks, lambda _, c: F.struct(F.coalesce(c["state"], F.lit("unknown")).alias("state"), c["delta_pct"].alias("delta_pct"), c["coverage_pct"].alias("coverage_pct")))
    return x.select("entity_id", "period_end", "score", public.alias("checks"))


def entity_overview(entities: DataFrame, identifiers: DataFrame, canonical: DataFrame, scores: DataFrame, search: str | None = None, has_financials: bool = True) -> DataFrame:
    """Entities with ticker, newest period, number of lines and mean score. Tickers join without a validity filter, so an entity may repeat."""
    x = entities if search is None else entities.where(F.col("legal_name").ilike(f"%{search}%"))
    tickers = identifiers.where("namespace = 'ticker'").select("entity_id", F.col("value").alias("ticker")).distinct()
    lines = canonical.groupBy("entity_id").agg(F.max("period_end").alias("last_period"), F.count("*").alias("n_lines"))
    mean = scores.groupBy("entity_id").agg(F.round(F.avg("score")).cast("int").alias("avg_score"))
    out = x.join(tickers, "entity_id", "left").join(lines, "entity_id", "inner" if has_financials else "left").join(mean, "entity_id", "left")
    return out.select("entity_id", "legal_name", "ticker", "last_period", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "avg_score")


def entity_page(overview: DataFrame, limit: int = 50, offset: int = 0, search: str | None = None) -> DataFrame:
    """A page of the overview by name; equal names go by entity and ticker. Limits out of range are errors."""
    if not 1 <= limit <= 100 or not 0 <= offset <= 10_000:
        raise ValueError("limit must lie between 1 and 100, offset between 0 and 10000")
    if search is not None and len(search) > 100:
        raise ValueError("a search has at most 100 characters")
    x = overview if search is None else overview.where(F.col("legal_name").ilike(f"%{search}%"))
    return x.orderBy("legal_name", "entity_id", F.col("ticker").asc_nulls_last()).offset(offset).limit(limit)


def metric_points(canonical: DataFrame, entity_id: int, code: str, basis: str | None = None, period_type: str = "q", consolidation: str = "consolidated", limit: int = 40) -> DataFrame:
    """Points of one line of an entity: both bases newest first, or a single one oldest first; the limit follows that order."""
    x = canonical.where((F.col("entity_id") == entity_id) & (F.col("period_type") == period_type) & (F.col("consolidation") == consolidation))
    out = dual_series(x, code).orderBy(F.col("period_end").desc()) if basis is None else single_series(x, code, basis).orderBy("period_end")
    return out.limit(limit)


def series_by_code(observations: DataFrame, catalog: DataFrame, code: str, start: str | None = None, end: str | None = None, limit: int = 500) -> DataFrame:
    """The newest points of a series by its code, both days in; 2000 at most, and nulls go after the limit."""
    x = observations.join(catalog.where(F.col("series_code") == code).select("series_id"), "series_id", "left_semi")
    day = F.col("ts").cast("date")
    x = x if start is None else x.where(day >= F.lit(start).cast("date"))
    x = x if end is None else x.where(day <= F.lit(end).cast("date"))
    x = x.orderBy(F.col("ts").desc(), F.col("as_of").desc(), F.col("event_id").desc()).limit(min(limit, 2000))
    return x.where("value is not null").select(day.alias("day"), "value", "event_id")


def count_with(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """How many entities have financials: each counts once."""
    return entities.join(canonical.select("entity_id").distinct(), "entity_id", "left_semi").agg(F.count("*").alias("total"))


def snapshot(entities: DataFrame, identifiers: DataFrame, filings: DataFrame, today: str) -> DataFrame:
    """Per entity its ticker on a day (the end counts), its newest filing and the number of filings of 30 days."""
    day = F.lit(today).cast("date")
    valid = identifiers.where((F.col("namespace") == "ticker") & (F.lit(today).cast("date").between(F.col("valid_from"), F.col("valid_to"))))
    ticker = first_per_key(valid, ["entity_id"], F.col("is_primary").desc(), F.col("identifier_id").desc()).select("entity_id", F.col("value").alias("ticker"))
    recent = (F.col("published_at").cast("date") > F.date_sub(day, 30)) & (F.col("published_at").cast("date") <= day)
    filed = filings.groupBy("entity_id").agg(F.max("published_at").alias("last_filing"), F.count_if(recent).alias("filings_30d"))
    out = entities.join(ticker, "entity_id", "left").join(filed, "entity_id", "left")
    return out.select("entity_id", "legal_name", "ticker", "last_filing", F.coalesce("filings_30d", F.lit(0)).alias("filings_30d"))


def masked(payload: Column, keys: Sequence[str], allowed: bool = False) -> Column:
    """A JSON object of strings with the values of some keys redacted, unless the caller may see them."""
    if allowed:
        return payload
    values = F.from_json(payload, "map<string,string>")
    return F.to_json(F.transform_values(values, lambda k, v: F.when(k.isin(list(keys)), F.concat(F.lit("<REDACTED:"), k, F.lit(">"))).otherwise(v)))


def latency_percentiles(requests: DataFrame, by: str, value: str) -> DataFrame:
    """Exact continuous percentiles 50 and 99 per endpoint."""
    return requests.groupBy(by).agg(F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.99)).alias("p99"))
