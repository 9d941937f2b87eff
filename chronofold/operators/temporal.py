"""Point-in-time and interval operators over facts with a knowledge time.

Every collapse is ``row_number() = 1`` per natural key, which Spark plans as a group limit before
and after the shuffle on the key, so a hot key sends one row a task. Filters on key columns
pass below the window; the point in time is always applied below it, so later
restatements vanish instead of merely losing.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.schemas import REGISTRY, Fact

MAX_SKEW = dt.timedelta(seconds=60)
MAX_WIDTH = dt.timedelta(days=5 * 365)
PAGE = 500


def _text(value: str | dt.datetime) -> str:
    """A time in UTC without zone; text that isn't a time is an error."""
    value = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    return (value.astimezone(dt.UTC) if value.tzinfo else value).strftime("%Y-%m-%d %H:%M:%S.%f")


def moment(value: str | dt.datetime | None) -> Column:
    """A literal timestamp without zone, as the tables store it in UTC."""
    return F.lit(None if value is None else _text(value)).cast("timestamp_ntz")


def first_per_key(df: DataFrame, key: Sequence[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order, which should be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def pit(df: DataFrame, fact: Fact | str, at: str | dt.datetime | None, *, hide_deleted: bool = False, keep_unknown: str | None = None) -> DataFrame:
    """The latest version of each key known at ``at`` (None: now, whatever is there).

    The fact's ``live`` filter holds before the collapse, so a deleted or superseded version lets the last
    live one surface; ``hide_deleted`` applies it after the collapse instead. ``keep_unknown`` is a
    condition for rows that count as known at any time and sort after all others.
    """
    fact = REGISTRY[fact] if isinstance(fact, str) else fact
    if at is not None:
        known = F.col(fact.as_of) <= moment(at)
        df = df.where(known | F.expr(keep_unknown) if keep_unknown else known)
    live = None
    if fact.live:
        now = f"TIMESTAMP_NTZ '{_text(at)}'" if at is not None else None
        live = F.expr(fact.live.replace(":p", now) if now else re.sub(r" OR [a-z_]+ > :p", "", fact.live))
        df = df if hide_deleted else df.where(live)
    df = first_per_key(df, fact.key, F.col(fact.as_of).desc_nulls_last(), *[F.col(c).desc_nulls_last() for c in fact.ties])
    return df.where(live) if hide_deleted and live is not None else df


def interval(df: DataFrame, fact: Fact | str, lo: str, hi: str) -> DataFrame:
    """All versions with lo <= as_of < hi: the version chains of each key, uncollapsed."""
    fact = REGISTRY[fact] if isinstance(fact, str) else fact
    return df.where((F.col(fact.as_of) >= moment(lo)) & (F.col(fact.as_of) < moment(hi)))


def chain_order(fact: Fact | str) -> list[Column]:
    fact = REGISTRY[fact] if isinstance(fact, str) else fact
    return [F.col(c).asc_nulls_last() for c in (*fact.key, fact.as_of, *fact.ties)]


def page(df: DataFrame, fact: Fact | str, limit: int = 50) -> DataFrame:
    """The first rows in the fact's reading order; beyond ``PAGE`` rows is an error."""
    fact = REGISTRY[fact] if isinstance(fact, str) else fact
    if not 1 <= limit <= PAGE:
        raise ValueError(f"limit must lie between 1 and {PAGE}")
    order = [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in fact.order]
    return df.orderBy(*order, *[F.col(c).asc_nulls_last() for c in (*fact.key, fact.as_of, *fact.ties)]).limit(limit)


def current(df: DataFrame, fact: Fact | str) -> DataFrame:
    """The latest row of each key that nothing supersedes."""
    fact = REGISTRY[fact] if isinstance(fact, str) else fact
    return pit(df.where("superseded_at IS NULL") if "superseded_at" in df.columns else df, fact, None)


def valid_at(df: DataFrame, day: str, start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Rows whose valid time holds the day; the end is exclusive, null is open."""
    d = F.lit(day).cast("date")
    return df.where((F.col(start) <= d) & (F.col(end).isNull() | (F.col(end) > d)))


def latest(df: DataFrame, at: str | None = None) -> DataFrame:
    """Per series the newest ts known at ``at``: a newer ts outranks an older one restated later."""
    df = df if at is None else df.where(F.col("as_of") <= moment(at))
    return first_per_key(df, ["series_id"], F.col("ts").desc_nulls_last(), F.col("as_of").desc_nulls_last(), F.col("event_id").desc_nulls_last())


def series_range(df: DataFrame, start: str, end: str, at: str | None = None, limit: int | None = None) -> DataFrame:
    """start <= ts < end as known at ``at``, by ts; the limit counts collapsed rows."""
    out = pit(df.where((F.col("ts") >= moment(start)) & (F.col("ts") < moment(end))), "observation", at)
    out = out.orderBy("series_id", "ts")
    return out if limit is None else out.limit(limit)


def lineage_as_of(versions: DataFrame, lineage: DataFrame) -> DataFrame:
    """(version columns, lineage columns): lineage of an entity as each version of it knew.

    Versions of an edge become ranges of knowledge time that don't overlap, so the join yields each known edge of
    a version once and nothing collapses after it. "From or into is the entity" is two equi-joins; an edge from an
    entity to itself counts once.
    """
    w = Window.partitionBy("event_kind", "from_entity_id", "into_entity_id", "event_at").orderBy("as_of", "row_no")
    until = lineage.where("as_of is not null").withColumn("until", F.lead("as_of").over(w)).where("until is null or until > as_of")
    edges = until.select(*[F.col(c).alias(f"l_{c}") for c in until.columns])
    known = (F.col("l_as_of") <= F.col("as_of")) & (F.col("l_until").isNull() | (F.col("as_of") < F.col("l_until")))
    on_from = versions.join(edges, (versions.entity_id == edges.l_from_entity_id) & known)
    on_into = versions.join(edges, (versions.entity_id == edges.l_into_entity_id) & ~F.col("l_from_entity_id").eqNullSafe(F.col("l_into_entity_id")) & known)
    return on_from.unionByName(on_into).drop("l_until")


def amended(df: DataFrame, fact: Fact | str, before: str, after: str, value: str = "value") -> DataFrame:
    """Keys whose value differs between two points in time, with both values."""
    fact = REGISTRY[fact] if isinstance(fact, str) else fact
    a = pit(df, fact, before).select(*fact.key, F.col(value).alias("before"))
    b = pit(df, fact, after).select(*fact.key, F.col(value).alias("after"))
    return a.join(b, list(fact.key)).where(~F.col("before").eqNullSafe(F.col("after")))


def capture(old: DataFrame, new: DataFrame, key: str, kind: Column, at: str) -> DataFrame:
    """History rows of the change from one snapshot to the next.

    ``kind`` names an update from columns old.* and new.*, or is null where nothing that
    matters changed; inserts are created, deletions deleted.
    """
    both = old.alias("old").join(new.alias("new"), F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    event = F.when(F.col(f"old.{key}").isNull(), "created").when(F.col(f"new.{key}").isNull(), "deleted").otherwise(kind)
    columns = [F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) if c == key else F.when(F.col(f"new.{key}").isNull(), F.col(f"old.{c}")).otherwise(F.col(f"new.{c}")).alias(c) for c in new.columns]
    return both.select(*columns, event.alias("event_kind"), moment(at).alias("as_of")).where("event_kind is not null")


def entity_kind() -> Column:
    """merged if the status becomes so, else renamed, else updated."""
    merged = (F.col("new.status") == "merged") & ~F.col("old.status").eqNullSafe(F.col("new.status"))
    renamed = ~F.col("old.legal_name").eqNullSafe(F.col("new.legal_name"))
    changed = ~F.col("old.status").eqNullSafe(F.col("new.status"))
    return F.when(merged, "merged").when(renamed, "renamed").when(changed, "updated")


def disclosure_kind() -> Column:
    """body_fetched when the body arrives, republished when the parent changes, else updated."""
    fetched = ~F.coalesce("old.has_body", F.lit(False)) & F.coalesce("new.has_body", F.lit(False))
    moved = ~F.col("old.parent_id").eqNullSafe(F.col("new.parent_id"))
    changed = ~F.col("old.title").eqNullSafe(F.col("new.title"))
    return F.when(fetched, "body_fetched").when(moved, "republished").when(changed, "updated")


def backfill(entities: DataFrame) -> DataFrame:
    """First history of a table that had none: created for each row, updated where it has changed since; created wins a tie."""
    created = entities.select("entity_id", "legal_name", F.lit("created").alias("event_kind"), F.col("created_at").alias("as_of"), F.lit(0).alias("rank"))
    updated = entities.where("updated_at > created_at").select("entity_id", "legal_name", F.lit("updated").alias("event_kind"), F.col("updated_at").alias("as_of"), F.lit(1).alias("rank"))
    return first_per_key(created.unionByName(updated), ["entity_id", "as_of"], F.col("rank")).drop("rank")


_BODY = ("body_fetched_at",)


def backfill_disclosures(disclosures: DataFrame, body: Sequence[str] = _BODY) -> DataFrame:
    """First history of disclosures: indexed for each, without its body columns, and body_fetched where a body came; indexed wins a tie.

    A disclosure without an index time has no knowledge time: its row says so and is never a tie.
    """
    index = F.col("index_fetched_at")
    empty = {c: F.lit(None).cast(dict(disclosures.dtypes)[c]) for c in body}
    indexed = disclosures.withColumns(empty).withColumns({"body_fetched": F.lit(False), "event_kind": F.lit("indexed"), "as_of": index, "provenance": F.when(index.isNotNull(), "index_fetched_at").otherwise("pre_bitemporal_unknown"), "_rank": F.lit(0)})
    fetched = disclosures.where("body_fetched AND body_fetched_at IS NOT NULL").withColumns({"event_kind": F.lit("body_fetched"), "as_of": F.col("body_fetched_at"), "provenance": F.lit("body_fetched_at"), "_rank": F.lit(1)})
    return first_per_key(indexed.unionByName(fetched), ["disclosure_id", "as_of"], F.col("_rank")).drop("_rank")


_ISO = re.compile(r"^\d{4}-\d\d-\d\dT\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:\d\d)$")


def parse_as_of(text: str | None, now: dt.datetime) -> dt.datetime:
    """A point in time with a zone; none means now; more than a minute ahead is an error."""
    if text is None:
        return now
    if not _ISO.match(text):
        raise ValueError("as_of needs a date, a time and a zone")
    at = dt.datetime.fromisoformat(text)
    if at > now + MAX_SKEW:
        raise ValueError("as_of lies in the future")
    return at


def parse_range(text: str | None, as_of: str | None = None) -> tuple[dt.datetime, dt.datetime] | None:
    """[T1,T2) with zones, T1 before T2, five years at most; not together with as_of."""
    if text is None:
        return None
    if as_of is not None:
        raise ValueError("as_of and as_of_range exclude each other")
    if not (text.startswith("[") and text.endswith(")") and text.count(",") == 1):
        raise ValueError("as_of_range must look like [T1,T2)")
    ends = [x.strip() for x in text[1:-1].split(",")]
    if not all(_ISO.match(x) for x in ends):
        raise ValueError("both ends need a date, a time and a zone")
    lo, hi = map(dt.datetime.fromisoformat, ends)
    if not lo < hi:
        raise ValueError("the range is empty")
    if hi - lo > MAX_WIDTH:
        raise ValueError("the range spans more than five years")
    return lo, hi
