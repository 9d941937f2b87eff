"""Stream processing with Structured Streaming: gate, dead letters, deduplication, redaction, rollup.

Checkpoints stand in for claims and leases; sinks are idempotent on their keys, so a replayed batch
changes nothing.
"""

from __future__ import annotations

import threading
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

BASE = "schema_version INT, event_id STRING, produced_at STRING, producer_run_id BIGINT, source_id STRING, actor_id STRING, actor_kind STRING, traceparent STRING, request_id STRING, kind STRING"
#: Fields that every event has, those it may leave out, the actors, and the fields of each kind beyond them.
REQUIRED = ("schema_version", "event_id", "produced_at", "producer_run_id", "source_id", "kind")
OPTIONAL = ("actor_id", "actor_kind", "traceparent", "request_id")
ACTORS = ("user", "service", "system")
KINDS = {
    "filing.new": ("filing_id", "entity_id", "filing_kind", "title", "published_at", "primary_object_key", "bucket", "is_revision", "revision_no"),
    "filing.amended": ("filing_id", "previous_filing_id", "entity_id", "revision_no", "title", "published_at"),
    "observation.batch": ("series_code", "series_id", "ts_min", "ts_max", "as_of_min", "as_of_max", "n_observations", "batch_payload_hash"),
    "entity.created": ("entity_id", "entity_type", "legal_name", "primary_identifier_namespace", "primary_identifier_value"),
    "stream.entry_redacted": ("target_event_id", "target_stream", "redaction_reason"),
}
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
ZONED = r"(Z|[+-]\d{2}:?\d{2})$"


def parse(payload: DataFrame, lowest: int = 1, highest: int = 1) -> DataFrame:
    """Columns message_id and payload (JSON) to typed events with ``error`` (null: fine).

    Unknown kinds, unknown or missing fields, versions out of range and base fields of the wrong form (ids, numbers,
    actors, times without a zone) are errors on sight.
    """
    base = F.from_json("payload", BASE)
    keys = F.json_object_keys("payload")
    x = payload.withColumn("e", base).withColumn("keys", keys).withColumn("fields", F.from_json("payload", "map<string,string>"))
    needed = F.lit(None).cast("array<string>")
    for kind, own in KINDS.items():
        needed = F.when(F.col("e.kind") == kind, F.array(*[F.lit(f) for f in (*REQUIRED, *own)])).otherwise(needed)
    x = x.withColumn("needed", needed)
    allowed = F.concat("needed", F.array(*[F.lit(f) for f in OPTIONAL]))
    produced = F.try_to_timestamp(F.col("e.produced_at"))
    fits = F.col("e.event_id").rlike(UUID) & produced.isNotNull() & F.col("e.produced_at").rlike(ZONED) & F.col("e.producer_run_id").isNotNull() & F.col("e.source_id").isNotNull()
    fits = fits & (F.col("e.actor_kind").isNull() | F.col("e.actor_kind").isin(*ACTORS)) & (F.col("e.request_id").isNull() | F.col("e.request_id").rlike(UUID))
    error = (
        F.when(F.col("keys").isNull(), "not_json").when(F.col("e.schema_version").isNull(), "no_version").when(F.col("e.schema_version") > highest, "too_new").when(F.col("e.schema_version") < lowest, "too_old")
        .when(F.col("needed").isNull(), "unknown_kind").when(F.size(F.array_except("keys", allowed)) > 0, "extra_fields").when(F.size(F.array_except("needed", "keys")) > 0, "missing_fields")
        .when(~F.coalesce(fits, F.lit(False)), "bad_value")
    )
    return x.select("message_id", "payload", "e.*", "fields", error.alias("error")).withColumn("produced_at", F.try_to_timestamp("produced_at"))


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, dead letters)."""
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("message_id", "payload", "error")


def once(events: DataFrame, window: str = "7 days") -> DataFrame:
    """Each event_id once within the window."""
    return events.withWatermark("produced_at", window).dropDuplicatesWithinWatermark(["event_id"])


def redacted(events: DataFrame, registry: DataFrame, strict: bool = False) -> DataFrame:
    """Events with the payload a registry (event_id, replacement, sha256) holds in place of theirs; a wrong hash is an error, and so is a replacement that names another event or, if ``strict``, names none."""
    r = registry.select("event_id", "replacement", F.col("sha256").alias("_sha"))
    x = events.join(r, "event_id", "left")
    broken = F.col("replacement").isNotNull() & (F.sha2("replacement", 256) != F.col("_sha"))
    named = F.get_json_object("replacement", "$.event_id")
    other = F.col("replacement").isNotNull() & ~F.coalesce(named == F.col("event_id"), F.lit(not strict))
    fail = lambda what: F.raise_error(F.concat(F.lit(what), "event_id"))
    checked = F.when(broken, fail("redaction hash mismatch: ")).when(other, fail("redacted payload of another event: ")).otherwise(F.coalesce("replacement", "payload"))
    return x.withColumn("payload", checked).withColumn("is_redacted", F.col("replacement").isNotNull()).drop("replacement", "_sha")


def append_new(batch: DataFrame, path: str, key: list[str], day: str | None = None) -> None:
    """Append the rows of a batch whose key the table at ``path`` doesn't hold: a replay writes nothing.

    With ``day``, a time that a key never changes, the table is kept by that day and only the days of the batch
    are read; without it the whole table is.
    """
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(key)
    try:
        held = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        held = None
    if not day:
        (fresh if held is None else fresh.join(held.select(*key), key, "left_anti")).write.mode("append").parquet(path)
        return
    # Kept while it is read twice, so that the state of a stream isn't computed again.
    fresh = fresh.withColumn("_day", F.coalesce(F.col(day).cast("date"), F.lit("1970-01-01").cast("date"))).persist()
    try:
        ends = fresh.agg(F.min("_day").alias("lo"), F.max("_day").alias("hi")).first()
        if ends["lo"] is not None:
            new = fresh if held is None else fresh.join(held.where(F.col("_day").between(ends["lo"], ends["hi"])).select(*key), key, "left_anti")
            new.write.mode("append").partitionBy("_day").parquet(path)
    finally:
        fresh.unpersist()


DEAD = ["stream", "consumer_group", "message_id"]


def dead_letters(bad: DataFrame, stream: str | Column, group: str) -> DataFrame:
    """Failed messages under the key of a dead letter (stream, group, message) and the id made of it; errors are cut to 8000 characters."""
    x = bad.withColumns({"stream": F.lit(stream), "consumer_group": F.lit(group), "error": F.left("error", F.lit(8000))})
    return x.withColumn("failure_id", F.sha2(F.to_json(F.array(*DEAD)), 256))


class Counters(StreamingQueryListener):
    """Sums of the metrics that streams observe, as ``name.metric``; complete for a query once it has ended and ``wait`` is over."""

    def __init__(self):
        self.totals: Counter[str] = Counter()
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.totals.update({f"{name}.{k}": v or 0 for k, v in row.asDict().items()})

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def wait(self, queries: list, seconds: float = 60) -> None:
        for q in queries:
            if not self._ended[str(q.runId)].wait(seconds):
                raise TimeoutError("a stream's last metrics have not come")


COUNTS = "run string, name string, n bigint"


def drain(spark: SparkSession, source: str, schema: str, sink: str, dead: str, checkpoint: str, registry: DataFrame | None = None, stream: str = "events", group: str = "default", counts: str | None = None) -> dict[str, int]:
    """All messages of a folder through gate, deduplication and redaction into ``sink`` and ``dead``, exactly once for the reader.

    Returns what the streams counted on their way, with no pass of its own: messages, those that the gate refused, events, those left after
    deduplication, redacted ones. ``counts`` is a table to append this to, by run.
    """
    parsed = parse(spark.readStream.schema(schema).parquet(source))
    refused = F.col("error").isNotNull()
    good, _ = split(parsed)
    _, bad = split(parsed.observe("gate", F.count("*").alias("messages"), F.count_if(refused).alias("refused")))
    good = once(good.observe("accepted", F.count("*").alias("events"))).observe("unique", F.count("*").alias("events"))
    if registry is not None:
        good = redacted(good, registry)
        good = good.observe("redaction", F.count_if("is_redacted").alias("events"))
    bad = dead_letters(bad, stream, group)
    counters = Counters()
    spark.streams.addListener(counters)
    try:
        queries = [
            good.writeStream.option("checkpointLocation", f"{checkpoint}/good").trigger(availableNow=True).foreachBatch(lambda b, _: append_new(b, sink, ["event_id"], "produced_at")).start(),
            bad.writeStream.option("checkpointLocation", f"{checkpoint}/dead").trigger(availableNow=True).foreachBatch(lambda b, _: append_new(b, dead, DEAD)).start(),
        ]
        for q in queries:
            q.awaitTermination()
        counters.wait(queries)
    finally:
        spark.streams.removeListener(counters)
    t = counters.totals
    found = {"messages": t["gate.messages"], "refused": t["gate.refused"], "events": t["accepted.events"], "duplicates": t["accepted.events"] - t["unique.events"], "redacted": t["redaction.events"]}
    if counts:
        spark.createDataFrame([(str(queries[0].runId), k, n) for k, n in found.items()], COUNTS).coalesce(1).write.mode("append").parquet(counts)
    return found


def indexed_letters(index: DataFrame, log: DataFrame, limit: int = 1000) -> DataFrame:
    """Copies of dead letters with the stream their log row names, by id."""
    return index.join(log.select("failure_id", "stream"), "failure_id").orderBy("failure_id").limit(limit)


def streams_with_letters(log: DataFrame) -> DataFrame:
    """Names of the streams that have dead letters."""
    return log.select("stream").distinct().orderBy("stream")


def monthly(observations: DataFrame) -> DataFrame:
    """Streaming monthly rollup for update mode; state older than a year goes. The last value is that of the newest ts, then as_of, then the greater value."""
    x = observations.withWatermark("ts", "366 days").where("value is not null")
    last = F.max_by("value", F.struct("ts", "as_of", "value")) if "as_of" in observations.columns else F.max_by("value", F.struct("ts", "value"))
    return x.groupBy("series_id", F.date_trunc("month", "ts").alias("month")).agg(last.alias("last_value"), F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.count("*").alias("n"))


LIMIT = 5


def failures(attempts: DataFrame, limit: int = LIMIT) -> DataFrame:
    """message_id and n as soon as a message has failed more than ``limit`` times; state counts across batches."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        n = before + sum(len(b) for b in batches)
        state.update((n,))
        if before <= limit < n:
            yield pd.DataFrame({"message_id": [key[0]], "n": [n]})

    return attempts.groupBy("message_id").applyInPandasWithState(run, "message_id string, n long", "n long", "append", "NoTimeout")


def reconcile(log: DataFrame, index: DataFrame, stream: DataFrame) -> DataFrame:
    """What a janitor must look at: log rows without a copy, copies without a log row, copies gone from the stream."""
    a = log.join(index, "message_id", "left_anti").select("message_id", F.lit("log_without_copy").alias("problem"))
    b = index.join(log, "message_id", "left_anti").select("message_id", F.lit("copy_without_log").alias("problem"))
    c = index.join(stream, "message_id", "left_anti").select("message_id", F.lit("copy_trimmed").alias("problem"))
    return a.unionByName(b).unionByName(c)


def lag(events: DataFrame, now: str) -> DataFrame:
    """Seconds between production and ``now``: mean and most per kind."""
    late = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("produced_at").cast("timestamp"))) / 1e6
    return events.groupBy("kind").agg(F.avg(late).alias("mean_lag_s"), F.max(late).alias("max_lag_s"))


def publish(rows: DataFrame, run_id: int, context_actor: str) -> tuple[DataFrame, DataFrame]:
    """(outbox rows, one audit row) of a batch of events; an event_id that comes twice is an error before anything is written."""
    if not rows.groupBy("event_id").count().where("count > 1").isEmpty():
        raise ValueError("an event_id comes twice in the batch")
    out = rows.withColumn("stream", F.concat(F.lit("events."), "kind")).withColumn("producer_run_id", F.lit(run_id)).withColumn("actor_id", F.lit(context_actor))
    audit = out.agg(F.count("*").alias("n_events"), F.array_sort(F.collect_set("stream")).alias("streams"), F.first("actor_id").alias("actor_id"))
    return out, audit


def between_ids(messages: DataFrame, after: str | None, upto: str, limit: int = 1000) -> DataFrame:
    """A page of messages after one id and up to another, by id."""
    from chronofold.functions.text import message_order

    at = message_order(F.col("message_id"))
    x = messages.where(at <= message_order(F.lit(upto)))
    x = x if after is None else x.where(at > message_order(F.lit(after)))
    return x.orderBy(at).limit(limit)


def copy_index(messages: DataFrame) -> DataFrame:
    """Every physical copy of an event: ids collide across streams, so the key is all three columns."""
    return messages.select("event_id", "stream", "message_id").distinct()


def pending(outbox: DataFrame, published: DataFrame) -> DataFrame:
    """Outbox rows not yet published, with how many there are per kind and the oldest."""
    return outbox.join(published.select("event_id"), "event_id", "left_anti").groupBy("kind").agg(F.count("*").alias("pending"), F.min("produced_at").alias("oldest"))


def retry(dead: DataFrame, message_ids: list[str]) -> DataFrame:
    """Messages of the dead-letter table to put back into the source."""
    return dead.where(F.col("message_id").isin(message_ids)).select("message_id", "payload")


def tail(messages: DataFrame, start: str | None = None, count: int = 10) -> DataFrame:
    """The first messages of a stream from an id on, by id; None is its beginning."""
    from chronofold.functions.text import message_order

    at = message_order(F.col("message_id"))
    x = messages if start is None else messages.where(at >= message_order(F.lit(start)))
    return x.orderBy(at).limit(count)


def group_lag(messages: DataFrame, deliveries: DataFrame) -> DataFrame:
    """For each stream and consumer group: lag, the messages after the last that was delivered; pending, those delivered and not acknowledged,
    with the least and the greatest; how many consumers; the last delivered id.

    ``messages`` has stream and message_id, ``deliveries`` stream, consumer_group, consumer, message_id and acked. A stream has a row for each of its groups.
    """
    from chronofold.functions.text import message_order

    at = message_order(F.col("message_id"))
    key = ["stream", "consumer_group"]
    pending = F.when(~F.col("acked"), F.struct(at.alias("at"), "message_id"))
    groups = deliveries.groupBy(*key).agg(
        F.max(F.struct(at.alias("at"), "message_id")).alias("last"),
        F.count_distinct(F.when(~F.col("acked"), F.col("message_id"))).alias("pending"),
        F.min(pending)["message_id"].alias("min_pending"),
        F.max(pending)["message_id"].alias("max_pending"),
        F.count_distinct("consumer").alias("consumers"),
    )
    # messages of a stream after a group's last, in one ordered pass: what stands above it
    marks = groups.select("stream", F.col("last.at").alias("at"), "consumer_group")
    both = messages.select("stream", at.alias("at"), F.lit(None).cast("string").alias("consumer_group")).unionByName(marks)
    upto = Window.partitionBy("stream").orderBy(F.col("at").desc(), F.col("consumer_group").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    lag = both.withColumn("lag", F.count_if(F.col("consumer_group").isNull()).over(upto)).where("consumer_group IS NOT NULL").select(*key, "lag")
    return groups.join(lag, key).select(*key, "lag", "pending", "min_pending", "max_pending", "consumers", F.col("last.message_id").alias("last_delivered_id"))


def letters_list(log: DataFrame, limit: int = 50, stream: str | None = None) -> DataFrame:
    """The newest dead letters, of one stream if asked, without their payloads."""
    x = log if stream is None else log.where(F.col("stream") == stream)
    return x.orderBy(F.col("failed_at").desc_nulls_last(), "failure_id").limit(limit).drop("payload")
