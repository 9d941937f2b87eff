"""The outbox: events that wait to be sent, with the outcome of every attempt.

Rows and attempts are tables of a store (see ``operators.store``). A drain takes what is pending, oldest first, sends it in one
distributed write and commits an outcome for each row: a message id, an error, or both where a message was accepted but
its confirmation failed. A row without a confirmed message stays pending and comes again, so consumers see it at least once; every
accepted copy is in the index, and a redaction finds them all. After more than ``LIMIT`` failures a row is in the dead letters
for an operator to look at; it is never dropped, and goes on being tried.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.store import Store
from chronofold.operators.temporal import moment
from chronofold.streaming.events import LIMIT, dead_letters

#: From pending rows to outbox_id, message_id (null: not accepted) and error (null: confirmed), one row each.
Send = Callable[[DataFrame], DataFrame]


def _utc() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


class Outbox(Store):
    ROW = "outbox_id bigint, stream_name string, event_id string, schema_version int, payload string, created_at timestamp_ntz"

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        attempt = "outbox_id bigint, run string, at timestamp_ntz, event_id string, stream_name string, message_id string, error string"
        super().__init__(spark, root, {"row": (self.ROW, ("outbox_id",)), "attempt": (attempt, ("outbox_id",))}, buckets)

    def add(self, batch_id: str, rows: DataFrame) -> bool:
        """Rows to send; a repeated batch adds nothing. An outbox_id that is there already is left out."""
        held = self.committed(batch_id)
        if held:
            return False
        one = rows.dropDuplicates(["outbox_id"])
        return self.commit(batch_id, {"row": one.join(self.read("row", self.touched(one, "outbox_id")).select("outbox_id"), "outbox_id", "left_anti")})

    def state(self) -> DataFrame:
        """Each row with published_at and message_id of its first confirmed attempt, the number of failures and the last error."""
        sent = F.col("error").isNull()
        done = self.read("attempt").groupBy("outbox_id").agg(
            F.min(F.when(sent, F.struct("at", "message_id"))).alias("first"),
            F.count_if(~sent).alias("failures"),
            F.max_by(F.when(~sent, F.col("error")), F.when(~sent, F.struct("at", "run"))).alias("last_error"),
        )
        x = self.read("row").join(done, "outbox_id", "left").withColumns({"published_at": F.col("first.at"), "message_id": F.col("first.message_id"), "failures": F.coalesce("failures", F.lit(0))})
        return x.drop("first")

    def pending(self, limit: int | None = None) -> DataFrame:
        """Rows without a confirmed message, oldest first."""
        rows = self.state().where("published_at IS NULL").orderBy("created_at", "outbox_id")
        return rows if limit is None else rows.limit(limit)

    def drain(self, run: str, send: Send, limit: int | None = None, now: dt.datetime | None = None) -> dict[str, float]:
        """Send what is pending and commit the outcomes; a run that is committed already does nothing again.

        Returns how many rows were sent and failed, and the ages of the oldest and newest in seconds.
        """
        at = now or _utc()
        if not self.committed(run):
            rows = self.pending(limit).select("outbox_id", "stream_name", "event_id", "schema_version", "payload", "created_at")
            named = rows.select("outbox_id", "event_id", "stream_name")
            outcomes = send(rows).select("outbox_id", F.col("message_id").cast("string").alias("message_id"), F.left(F.col("error").cast("string"), F.lit(4000)).alias("error"))
            tried = outcomes.join(named, "outbox_id").withColumns({"run": F.lit(run), "at": moment(at)})
            self.commit(run, {"attempt": tried})
        tried = self.read("attempt").where(F.col("run") == run).join(self.read("row").select("outbox_id", "created_at"), "outbox_id")
        age = lambda f: F.coalesce((F.unix_micros(moment(at).cast("timestamp")) - F.unix_micros(f("created_at").cast("timestamp"))) / 1e6, F.lit(0.0))
        r = tried.agg(F.count_if(F.col("error").isNull()).alias("drained"), F.count_if(F.col("error").isNotNull()).alias("failed"), age(F.min).alias("oldest_s"), age(F.max).alias("newest_s")).first()
        return r.asDict()

    def copies(self) -> DataFrame:
        """(event_id, stream_name, message_id) of every message that a stream accepted, confirmed or not."""
        return self.read("attempt").where("message_id IS NOT NULL").select("event_id", "stream_name", "message_id").distinct()

    def letters(self, group: str = "outbox", limit: int = LIMIT) -> DataFrame:
        """Dead letters: pending rows that have failed more than ``limit`` times, with the last error."""
        stuck = self.state().where(F.col("published_at").isNull() & (F.col("failures") > limit))
        x = stuck.select("stream_name", F.col("outbox_id").cast("string").alias("message_id"), "payload", F.col("last_error").alias("error"), "failures")
        return dead_letters(x, F.col("stream_name"), group).drop("stream_name")

    def follow(self, source: str, checkpoint: str, send: Send, name: str = "outbox", limit: int | None = None) -> None:
        """Take all new rows of a folder by a stream, and drain after each of its batches: what failed before goes along with what is new.

        Replayed batches are known by their number, so nothing is added or sent twice for them.
        """

        def batch(rows: DataFrame, number: int) -> None:
            self.add(f"{name}-{number}/rows", rows)
            self.drain(f"{name}-{number}/drain", send, limit)

        stream = self.spark.readStream.schema(self.ROW).parquet(source)
        stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start().awaitTermination()
