"""Audit records, run lifecycles and append-only enforcement."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.functions.text import truncated_ip

STAMPS = ("actor_id", "actor_kind", "client_ip", "user_agent", "request_id")


@dataclass(frozen=True)
class Context:
    actor_id: str | None = None
    actor_kind: str | None = None
    client_ip: str | None = None
    user_agent: str | None = None
    request_id: str | None = None

    def resolved(self, strict: bool = False) -> Context:
        """Without an actor: an error if strict, else the unknown system actor."""
        if self.actor_id:
            return self
        if strict:
            raise PermissionError("an actor is required")
        return replace(self, actor_id="system:unknown", actor_kind="system")


def stamp(rows: DataFrame, context: Context) -> DataFrame:
    """``rows`` with the five audit columns of a context."""
    return rows.withColumns({c: F.lit(getattr(context, c)).cast("string") for c in STAMPS})


def recent(events: DataFrame, limit: int = 50) -> DataFrame:
    """Newest audit events with the address truncated and only the number of metadata keys."""
    keys = F.coalesce(F.size(F.json_object_keys("metadata")), F.lit(0))
    return events.orderBy(F.col("occurred_at").desc(), F.col("event_id").desc()).limit(limit).select("event_id", "occurred_at", truncated_ip(F.col("client_ip")).alias("client_net"), keys.alias("n_keys"))


class AppendOnly(ValueError):
    """A write would change what is stored."""


def append_only(stored: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows to append; an incoming row whose key is stored is an error."""
    if not incoming.join(stored.select(*key), list(key), "left_semi").isEmpty():
        raise AppendOnly("rows of this table can't be updated")
    return incoming


@dataclass
class Run:
    source_id: str
    job: str
    started_at: dt.datetime
    status: str = "running"
    finished_at: dt.datetime | None = None
    error: str | None = None
    counters: dict[str, int] = field(default_factory=dict)

    def count(self, name: str, n: int = 1) -> None:
        self.counters[name] = self.counters.get(name, 0) + n


@contextmanager
def ingestion_run(source_id: str, job: str, now=lambda: dt.datetime.now(dt.UTC)) -> Iterator[Run]:
    """A run that ends as succeeded, or as failed with the error, which is raised on."""
    run = Run(source_id, job, now())
    try:
        yield run
        run.status = "succeeded"
    except BaseException as e:
        run.status, run.error = "failed", str(e)[:4000]
        raise
    finally:
        run.finished_at = now()
