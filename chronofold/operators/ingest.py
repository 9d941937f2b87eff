"""Append-only ingest: validation, conflict detection, batch audit.

Parquet has neither transactions nor triggers: one writer per table is assumed, every check runs before the
single append, and keys make a repeated batch a no-op.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.operators.entities import Conflict


@dataclass(frozen=True)
class Outcome:
    attempted: int
    inserted: int
    unchanged: int
    duplicates: int
    updated: int = 0


def violations(rows: DataFrame) -> DataFrame:
    """Rows that break a rule, with its name: exactly one of value and value_text, both times present, a small non-negative flag."""
    rule = F.when(F.col("value").isNull() == F.col("value_text").isNull(), "one_value").when(F.col("ts").isNull() | F.col("as_of").isNull(), "times").when(F.col("quality_flag") < 0, "quality_flag")
    return rows.withColumn("rule", rule).where("rule is not null")


def batch_conflicts(batch: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Keys that come with different content within a batch."""
    return batch.groupBy(*key).agg(F.count_distinct("payload_hash").alias("n")).where("n > 1")


def compare(batch: DataFrame, stored: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """The distinct keys of a batch with what writing does: inserted, unchanged or conflict."""
    one = batch.groupBy(*key).agg(F.min("payload_hash").alias("payload_hash"))
    held = stored.select(*key, F.col("payload_hash").alias("_held"))
    action = F.when(F.col("_held").isNull(), "inserted").when(F.col("_held") == F.col("payload_hash"), "unchanged").otherwise("conflict")
    return one.join(held, list(key), "left").select(*key, "payload_hash", action.alias("action"))


def write(batch: DataFrame, stored: DataFrame, key: tuple[str, ...] = ("series_id", "ts", "as_of")) -> tuple[DataFrame, Outcome]:
    """(rows to append, outcome). Different content under one key, in the batch or in the store, aborts the whole batch."""
    if not batch_conflicts(batch, key).isEmpty():
        raise Conflict("a key comes twice with different content")
    done = compare(batch, stored, key)
    n = {r["action"]: r["n"] for r in done.groupBy("action").agg(F.count("*").alias("n")).collect()}
    if n.get("conflict"):
        raise Conflict(f"{n['conflict']} keys are stored with other content")
    attempted = batch.count()
    fresh = batch.dropDuplicates(list(key)).join(done.where("action = 'inserted'").select(*key), list(key), "left_semi")
    return fresh, Outcome(attempted, n.get("inserted", 0), n.get("unchanged", 0), attempted - sum(n.values()))


def _audit() -> list[Column]:
    times = [f(c).alias(f"{f.__name__}_{c}") for c in ("ts", "as_of") for f in (F.min, F.max)]
    return [F.count("*").alias("batch_size"), F.count_if(F.col("action") == "inserted").alias("inserted"), F.count_if(F.col("action") == "unchanged").alias("unchanged"), *times]


def batch_audit(done: DataFrame) -> DataFrame:
    """One row on a batch: size, actions, and the ranges of its times."""
    return done.agg(*_audit())


def batch_stats(batch: DataFrame, done: DataFrame, key: tuple[str, ...] = ("series_id", "ts", "as_of")) -> DataFrame:
    """``batch_audit`` with the rows that came (attempted) and those that repeat a key of the batch (duplicates)."""
    came = batch.groupBy(*key).agg(F.count("*").alias("n"))
    x = done.join(came, list(key)).agg(*_audit(), F.coalesce(F.sum("n"), F.lit(0)).alias("attempted"))
    return x.withColumn("duplicates", F.col("attempted") - F.col("batch_size"))


def batch_keys(done: DataFrame, batch_id: str, key: tuple[str, ...] = ("series_id", "ts", "as_of")) -> DataFrame:
    """One audit row per key of a batch, as many as its batch_size."""
    return done.select(F.lit(batch_id).alias("batch_id"), *key, "payload_hash", "action")
