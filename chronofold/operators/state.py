"""Small tables that outlive the process: watermarks, ingestion runs and audit records.

Each is an append-only Parquet log of versions; a read takes the newest version of a key, and filters on the key
reach the scan. One writer per table is assumed, as everywhere in this library: the check of a compare-and-set and
its append are two steps.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.audit import Context, Run, ingestion_run, stamp
from chronofold.operators.temporal import first_per_key


def _utc() -> dt.datetime:
    return dt.datetime.now(dt.UTC).replace(tzinfo=None)


class Log:
    """An append-only table at ``path``; empty while nothing was written."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def append(self, *rows: tuple) -> None:
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").parquet(self.path)


class Watermarks:
    """Source cursors by (job, key), advanced only from the value the caller saw."""

    def __init__(self, spark: SparkSession, path: str):
        self._log = Log(spark, path, "job string, key string, value string, version long, at timestamp_ntz")

    def _held(self, job: str, key: str) -> tuple[str | None, int]:
        one = self._log.rows().where((F.col("job") == job) & (F.col("key") == key)).agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version")).first()
        return one["value"], one["version"] or 0

    def get(self, job: str, key: str) -> str | None:
        return self._held(job, key)[0]

    def advance(self, job: str, key: str, new: str, expected: str | None) -> bool:
        """Whether it moved: ``expected`` None inserts where nothing is, else it must be what is held."""
        value, version = self._held(job, key)
        if value != expected:
            return False
        self._log.append((job, key, new, version + 1, _utc()))
        return True

    def set(self, job: str, key: str, value: str) -> None:
        """Moves whatever is held."""
        self._log.append((job, key, value, self._held(job, key)[1] + 1, _utc()))

    def table(self) -> DataFrame:
        return first_per_key(self._log.rows(), ["job", "key"], F.col("version").desc()).select("job", "key", "value", "at")

    def list_for_job(self, job: str) -> DataFrame:
        return self.table().where(F.col("job") == job).orderBy("key")


class Runs:
    """Ingestion runs: a row when one starts, another when it ends."""

    def __init__(self, spark: SparkSession, path: str):
        self._log = Log(spark, path, "run_id string, source_id string, job string, status string, started_at timestamp_ntz, finished_at timestamp_ntz, error string, counters map<string,bigint>, version long")

    def _write(self, run_id: str, run: Run, version: int) -> None:
        self._log.append((run_id, run.source_id, run.job, run.status, run.started_at, run.finished_at, run.error, dict(run.counters), version))

    @contextmanager
    def start(self, run_id: str, source_id: str, job: str, now=_utc) -> Iterator[Run]:
        """A stored run that ends as succeeded, or as failed with the error, which is raised on."""
        run = None
        try:
            with ingestion_run(source_id, job, now) as run:
                self._write(run_id, run, 1)
                yield run
        finally:
            if run is not None:
                self._write(run_id, run, 2)

    def table(self) -> DataFrame:
        return first_per_key(self._log.rows(), ["run_id"], F.col("version").desc()).drop("version")


class Audit:
    """Audit events, never changed: who did what to which row, with the content before and after."""

    def __init__(self, spark: SparkSession, path: str):
        self._columns = "event_id string, occurred_at timestamp_ntz, operation string, target_table string, target_pk string, before string, after string, metadata string"
        self._path, self._spark = path, spark
        self._log = Log(spark, path, self._columns + ", actor_id string, actor_kind string, client_ip string, user_agent string, request_id string")

    def record(self, event_id: str, operation: str, table: str, key: dict, context: Context, before: dict | None = None, after: dict | None = None, metadata: dict | None = None, strict: bool = False) -> None:
        text = lambda x: None if x is None else json.dumps(x, sort_keys=True, ensure_ascii=False)
        row = (event_id, _utc(), operation, table, text(key), text(before), text(after), text(metadata or {}))
        stamp(self._spark.createDataFrame([row], self._columns), context.resolved(strict)).coalesce(1).write.mode("append").parquet(self._path)

    def rows(self) -> DataFrame:
        return self._log.rows()
