"""What a read-only role may see: whole tables, or a list of columns of a table. Anything not listed is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame

_ACTOR = ("actor_id", "actor_kind")
_STAMPS = ("actor_id", "actor_kind", "client_ip", "user_agent", "request_id")

#: Tables that the role reads whole.
WHOLE = ("event_id_to_redis", "deadletter_redis_index", "deadletter_xadd_intent", "source", "series_catalog", "observation", "observation_batch_keys", "entity", "identifier", "currency", "sector", "filing_attachment")

#: The columns of the other tables that the role may read.
COLUMNS: dict[str, tuple[str, ...]] = {
    "outbox": ("outbox_id", "stream_name", "event_id", "schema_version", "producer_run_id", "source_id", "created_at", "published_at", "redis_message_id", "publish_attempts", "last_attempt_at", *_STAMPS),
    "deadletter_log": ("failure_id", "stream_name", "deadletter_stream", "event_id", "original_message_id", "group_name", "consumer_name", "failure_count", "routed_at", "routed_at_redis", "redis_message_id", *_ACTOR, "request_id"),
    "redaction_registry": ("event_id", "redaction_reason", "redacted_at", "original_stream", "redacted_payload_hash", "original_payload_hash", *_ACTOR, "request_id"),
    "ingestion_run": ("ingestion_run_id", "source_id", "job_name", "started_at", "finished_at", "status", "error_count", "rows_written", "docs_written", "bytes_written", "config_hash", "metadata", *_ACTOR),
    "filing": ("filing_id", "source_id", "source_filing_ref", "entity_id", "kind", "subkind", "language", "published_at", "period_start", "period_end", "source_url", "is_amendment", "previous_filing_id", "primary_object_key", "primary_mime", "primary_sha256", "primary_bytes", "extracted_text_key", "has_xbrl", "xbrl_object_key", "metadata", "ingestion_run_id", "discovered_at", "revision_no", *_STAMPS),
    "filing_body": ("filing_id", "body_lang", "extracted_at", *_STAMPS),
    "events": ("event_id", "occurred_at", *_STAMPS, "ingestion_run_id", "operation", "target_schema", "target_table", "target_pk"),
}


def visible(df: DataFrame, table: str) -> DataFrame:
    """The part of a table that the role may read; the scan reads no other column. Unlisted tables are an error."""
    if table in WHOLE:
        return df
    if table not in COLUMNS:
        raise PermissionError(f"{table} is not open to this role")
    return df.select(*[c for c in df.columns if c in COLUMNS[table]])
