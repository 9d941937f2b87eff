"""Operational aggregates. The clock is a parameter, so every figure can be repeated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.text import seconds_between
from chronofold.operators.temporal import moment


def overview(outbox: DataFrame, published: Column, now: str) -> DataFrame:
    """Pending messages, age of the oldest, messages of 15 minutes and 24 hours, events a minute of the last hour: one pass."""
    t = moment(now)
    since = lambda m: (F.col("produced_at") > t - F.expr(f"INTERVAL {m} MINUTES")) & (F.col("produced_at") <= t)
    oldest = F.min(F.when(~published, F.col("produced_at")))
    return outbox.agg(F.count_if(~published).alias("pending"), F.coalesce(seconds_between(oldest, t), F.lit(0.0)).alias("oldest_age_s"), F.count_if(since(15)).alias("last_15m"), F.count_if(since(1440)).alias("last_24h"), (F.count_if(since(60)) / 60.0).alias("per_minute"))


def dead_letters(log: DataFrame, index: DataFrame) -> DataFrame:
    """The dead-letter log with whether a physical copy is indexed."""
    have = index.select("message_id").distinct().withColumn("_has", F.lit(True))
    return log.join(have, "message_id", "left").withColumn("has_index", F.col("_has").isNotNull()).drop("_has")


def dead_letter_state(has_index: Column, message_id: Column, stream_length: Column, breaker_open: Column) -> Column:
    return F.when(~has_index | message_id.isNull(), "MISSING_INDEX").when(breaker_open | stream_length.isNull(), "UNKNOWN").when(stream_length == 0, "TRIMMED").otherwise("PRESENT")


def ingestion(runs: DataFrame) -> DataFrame:
    """Runs with duration (null until finished) and events (null unless positive)."""
    return runs.select("run_id", "job", "status", F.when(F.col("finished_at").isNotNull(), seconds_between(F.col("started_at"), F.col("finished_at"))).alias("duration_s"), F.when(F.col("n_events") > 0, F.col("n_events")).alias("n_events"))


def series_activity(catalog: DataFrame, observations: DataFrame, now: str) -> DataFrame:
    """Each series with its observations of 24 hours and the newest ts."""
    t = moment(now)
    recent = (F.col("as_of") > t - F.expr("INTERVAL 24 HOURS")) & (F.col("as_of") <= t)
    seen = observations.groupBy("series_id").agg(F.count_if(recent).alias("last_24h"), F.max("ts").alias("last_ts"))
    return catalog.join(seen, "series_id", "left").select("series_id", "series_code", F.coalesce("last_24h", F.lit(0)).alias("last_24h"), "last_ts")


def documents_with_copies(filings: DataFrame, copies: DataFrame) -> DataFrame:
    """Each filing with its number of copies, and of redacted ones."""
    n = copies.groupBy("offer_id").agg(F.count("*").alias("copies"), F.count("redacted_at").alias("redacted"))
    return filings.join(n, "offer_id", "left").select("offer_id", "source_id", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("redacted", F.lit(0)).alias("redacted"))


def outbox_page(state: DataFrame, limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the newest outbox rows, without what their errors say; how many are pending in all)."""
    rows = page(state.select("outbox_id", "stream_name", "event_id", "schema_version", "created_at", "published_at", "failures"), F.col("created_at").desc(), F.col("outbox_id").desc(), limit=limit, offset=offset)
    return rows, state.agg(F.count_if(F.col("published_at").isNull()).alias("pending"))


def redactions_page(registry: DataFrame, copies: DataFrame, limit: int = 50) -> DataFrame:
    """The newest redactions with hashes in place of payloads, and how many copies their event had and how many are deleted."""
    newest = page(registry.select("event_id", "redaction_reason", "original_stream", "redacted_at", "redacted_payload_hash", "original_payload_hash"), F.col("redacted_at").desc(), F.col("event_id"), limit=limit)
    n = copies.join(newest.select("event_id"), "event_id", "left_semi").groupBy("event_id").agg(F.count("*").alias("copies"), F.count("redacted_at").alias("deleted"))
    return newest.join(n, "event_id", "left").withColumns({"copies": F.coalesce("copies", F.lit(0)), "deleted": F.coalesce("deleted", F.lit(0))})


def documents_page(filings: DataFrame, attachments: DataFrame, limit: int = 50) -> DataFrame:
    """The newest filings with the number of their attachments."""
    newest = page(filings.select("offer_id", "source_id", "published_at"), F.col("published_at").desc(), F.col("offer_id"), limit=limit)
    n = attachments.withColumnRenamed("filing_id", "offer_id").join(newest.select("offer_id"), "offer_id", "left_semi").groupBy("offer_id").agg(F.count("*").alias("attachments"))
    return newest.join(n, "offer_id", "left").withColumn("attachments", F.coalesce("attachments", F.lit(0)))


def counts(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def rate_windows(requests: DataFrame, key: str, at: str, minutes: int) -> DataFrame:
    """Requests per key in tumbling windows."""
    w = F.window(F.col(at).cast("timestamp"), f"{minutes} minutes")
    return requests.groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def page(df: DataFrame, *order: Column, limit: int = 50, offset: int = 0) -> DataFrame:
    if not (1 <= limit <= 2000 and 0 <= offset <= 10_000):
        raise ValueError("limit or offset out of range")
    return df.orderBy(*order).offset(offset).limit(limit)
