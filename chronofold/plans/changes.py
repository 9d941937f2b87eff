"""Queries of what changes stored tables, of SQL table functions, and of joins by an index; part of the catalog."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import documents as docs
from chronofold.functions import nested
from chronofold.operators import analytics, dashboard, entities, mapping, quality, rollup, store
from chronofold.operators.temporal import first_per_key
from chronofold.plans import research, table_functions
from chronofold.plans.catalog import _BATCH, _BEST, _GRAMS, _INVARIANTS, _MANIFEST, _PICKED, _STORED, EVENT_PIT, PIT, _published, query
from chronofold.plans.views import collapsed
from chronofold.schemas import REGISTRY
from chronofold.session import scratch
from chronofold.sources import projections as P
from chronofold.streaming import events
from chronofold.streaming.outbox import Outbox

# Point-in-time reads as SQL table functions
_READ = {
    "observation": ("series_id, ts, as_of, value", EVENT_PIT),
    "financial_line_item": ("entity_id, filing_id, statement_type, line_code, consolidation, period_end, as_of, value", PIT),
    "canonical_financial": ("entity_id, canonical_code, period_end, currency_code, restatement_basis, mapping_version, as_of, value", PIT),
    "entity_quality_score": ("entity_id, period_end, restatement_basis, mapping_version, score, as_of", PIT),
    "entity_version": ("entity_id, legal_name, event_kind, as_of", PIT),
    "entity_lineage": ("event_kind, from_entity_id, into_entity_id, event_at, as_of", PIT),
    "filing_event": ("filing_id, event_type, event_seq, entity_id, as_of", PIT),
    "disclosures_version": ("disclosure_id, entity_id, event_kind, as_of", PIT),
}


def _function_query(table: str, columns: str, at: str) -> None:
    fact = REGISTRY[table]
    live = f" AND ({fact.live.replace(':p', f'TIMESTAMP {chr(39)}{at}{chr(39)}')})" if fact.live else ""

    def f(spark: SparkSession, d: str) -> DataFrame:
        table_functions.register(spark, {table: P.ALL[table](spark, d)})
        return spark.sql(f"SELECT {columns} FROM {table_functions.name(table)}(TIMESTAMP '{at}')")

    f.__name__ = f"function_{table_functions.name(table)}"
    query(collapsed(table, ", ".join(fact.key), ", ".join(f"{c} DESC" for c in (fact.as_of, *fact.ties)), f"as_of <= TIMESTAMP '{at}'{live}", columns))(f)


for _table, (_columns, _at) in _READ.items():
    _function_query(_table, _columns, _at)


@query("SELECT identifier_id, entity_id, namespace, value FROM identifier WHERE valid_from <= DATE '2000-06-15' AND valid_to > DATE '2000-06-15'")
def function_identifier_at(spark, d):
    table_functions.register(spark, {"identifier": P.identifier(spark, d)})
    return spark.sql(f"SELECT identifier_id, entity_id, namespace, value FROM identifier_at(TIMESTAMP '{PIT}')")


_CUTS = "VALUES (TIMESTAMP '2024-01-08 00:00:00'), (TIMESTAMP '2024-01-15 12:00:00'), (TIMESTAMP '2024-01-22 00:00:00')"


@query(f"SELECT cut, series_id, ts, value FROM (SELECT c.cut, o.*, row_number() OVER (PARTITION BY c.cut, series_id, ts ORDER BY as_of DESC, event_id DESC) AS rk FROM observation o JOIN ({_CUTS}) c(cut) ON o.as_of <= c.cut) WHERE rk = 1")
def function_observation_at_cuts(spark, d):
    table_functions.register(spark, {"observation": P.observation(spark, d)})
    return spark.sql(f"SELECT CAST(c.cut AS TIMESTAMP_NTZ) AS cut, o.series_id, o.ts, o.value FROM {_CUTS} AS c(cut), LATERAL observation_at(c.cut) AS o")


# Joins by an index
@query(f"WITH a AS (SELECT c_custkey AS left_id, {_GRAMS.format('c_name')} AS x FROM customer), b AS (SELECT s_suppkey AS right_id, {_GRAMS.format('s_name')} AS y FROM supplier) SELECT left_id, right_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) AS similarity FROM a, b WHERE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) >= 0.3")
def matched_names(spark, d):
    return entities.match_names(P.table(spark, d, "customer"), P.table(spark, d, "supplier"), 0.3, ("c_custkey", "s_suppkey"), ("c_name", "s_name"))


# Batches into a store
def _written(spark: SparkSession, d: str) -> store.Observations:
    """Two thirds of the observations as one batch, then the rest with some that are there and some that come twice, and that batch again."""
    x = P.observation(spark, d).select("series_id", "ts", "as_of", "value", F.lit(None).cast("string").alias("value_text"), F.lit(0).cast("smallint").alias("quality_flag"), F.sha2(F.round(F.col("value") * 100).cast("long").cast("string"), 256).alias("payload_hash"), "event_id")
    held = store.Observations(spark, scratch(spark, "observations"), buckets=8)
    held.write("b1", x.where("event_id % 3 <> 0").drop("event_id"))
    second = x.where("event_id % 3 = 0 OR event_id % 10 = 0").unionByName(x.where("event_id % 6 = 0")).drop("event_id")
    held.write("b2", second)
    held.write("b2", second)
    return held


@query(f"SELECT series_id, ts, as_of, value, payload_hash FROM ({_BATCH})")
def committed_observations(spark, d):
    return _written(spark, d).read("observation").select("series_id", "ts", "as_of", "value", "payload_hash")


_SIDE = "SELECT '{0}' AS batch_id, count(*) AS batch_size, count(*) FILTER ({2}) AS inserted, count(*) FILTER (NOT ({2})) AS unchanged, count(*) + count(*) FILTER ({3}) AS attempted, count(*) FILTER ({3}) AS duplicates, min(ts) AS min_ts, max(as_of) AS max_as_of FROM observation WHERE {1}"


@query(_SIDE.format("b1", "event_id % 3 <> 0", "TRUE", "FALSE") + " UNION ALL " + _SIDE.format("b2", "event_id % 3 = 0 OR event_id % 10 = 0", "event_id % 3 = 0", "event_id % 6 = 0"))
def committed_batches(spark, d):
    return _written(spark, d).read("batch").select("batch_id", "batch_size", "inserted", "unchanged", "attempted", "duplicates", "min_ts", "max_as_of")


@query("SELECT 'b1' AS batch_id, series_id, ts, as_of, 'inserted' AS action FROM observation WHERE event_id % 3 <> 0 UNION ALL SELECT 'b2', series_id, ts, as_of, CASE WHEN event_id % 3 = 0 THEN 'inserted' ELSE 'unchanged' END FROM observation WHERE event_id % 3 = 0 OR event_id % 10 = 0")
def committed_batch_keys(spark, d):
    return _written(spark, d).read("batch_key").select("batch_id", "series_id", "ts", "as_of", "action")


def _merged(spark: SparkSession, d: str) -> store.Filings:
    """All offers in three batches by their number, the second of them twice."""
    offers = P.filing(spark, d)
    held = store.Filings(spark, scratch(spark, "filings"), buckets=8)
    third = (offers.agg(F.max("offer_id")).first()[0] or 0) // 3
    blobs = lambda x: x.select("offer_id", F.concat_ws("/", "source_id", "sha256").alias("object_key"))
    for name, where in (("p1", F.col("offer_id") <= third), ("p2", F.col("offer_id").between(third + 1, 2 * third)), ("p2", F.col("offer_id").between(third + 1, 2 * third)), ("p3", F.col("offer_id") > 2 * third)):
        held.put(name, offers.where(where), blobs(offers.where(where)))
    return held


@query(f"SELECT offer_id, source_id, source_ref, sha256, revision_no, previous_id, revision_no > 1 AS is_amendment, coalesce(n, 0) AS n_aliases FROM {_STORED} LEFT JOIN (SELECT source_id, sha256, count(DISTINCT source_ref) AS n FROM filing f WHERE source_ref <> (SELECT arg_min(g.source_ref, g.offer_id) FROM filing g WHERE g.source_id = f.source_id AND g.sha256 = f.sha256) GROUP BY 1, 2) USING (source_id, sha256)")
def merged_filings(spark, d):
    return _merged(spark, d).stored().select("offer_id", "source_id", "source_ref", "sha256", "revision_no", "previous_id", "is_amendment", F.size("aliases").cast("long").alias("n_aliases"))


@query(f"SELECT offer_id, source_id, source_ref, revision_no FROM {_STORED} WHERE NOT (offer_id % 7 = 0 AND offer_id NOT IN (SELECT previous_id FROM {_STORED} WHERE previous_id IS NOT NULL) AND sha256 NOT LIKE 'a%')")
def released_filings(spark, d):
    """Every seventh filing is to go; blobs whose name begins with an a can't be deleted, so their filings stay."""
    held = _merged(spark, d)
    held.release("r1", held.read("filing").where("offer_id % 7 = 0").select("offer_id"), lambda key: not key.split("/")[1].startswith("a"))
    return held.read("filing").select("offer_id", "source_id", "source_ref", "revision_no")


# The kept monthly rollup
@query("SELECT series_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, arg_max(value, as_of) AS last_value, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM observation WHERE value IS NOT NULL GROUP BY 1, 2")
def refreshed_months(spark, d):
    """Kept from four fifths of the observations, then refreshed for the months that the late ones fall into."""
    x = P.observation(spark, d)
    late = F.col("event_id") % 5 == 0
    kept = rollup.Monthly(spark, scratch(spark, "months"))
    kept.refresh(x.where(~late), kept.changed(x.where(~late)))
    kept.refresh(x, kept.changed(x.where(late)))
    return kept.rows().withColumn("avg_value", F.round("avg_value", 6))


# Pages by cursor
def _page(df: DataFrame, name: str, asked: research.Read, limit: int, number: int) -> DataFrame:
    """A page by the cursors of those before it; empty after the last."""
    rows, cursor = research.page(df, name, asked, None, limit)
    for _ in range(number - 1):
        if cursor is None:
            return rows.limit(0)
        rows, cursor = research.page(df, name, asked, cursor, limit)
    return rows


@query("SELECT series_id, ts, as_of, value FROM (" + collapsed("observation", "series_id, ts", "as_of DESC, event_id DESC", f"as_of <= TIMESTAMP '{EVENT_PIT}' AND series_id >= 3") + ") WHERE value > 20 ORDER BY series_id, ts DESC LIMIT 300 OFFSET 300")
def research_second_page(spark, d):
    q = research.Read(as_of=EVENT_PIT, closed={"series_id": (3, None), "value": (20.001, None)})
    return _page(P.observation(spark, d), "observation", q, 300, 2).select("series_id", "ts", "as_of", "value")


@query("SELECT filing_id, event_type, event_seq, as_of FROM filing_event WHERE as_of >= TIMESTAMP '1996-01-01' AND as_of < TIMESTAMP '1996-02-01' ORDER BY filing_id, event_type, event_seq, as_of, row_no LIMIT 200 OFFSET 400")
def research_third_page_of_versions(spark, d):
    q = research.Read(between=("1996-01-01 00:00:00", "1996-02-01 00:00:00"))
    return _page(P.filing_event(spark, d), "filing_event", q, 200, 3).select("filing_id", "event_type", "event_seq", "as_of")


# Events with their lineage; entity financials with all filters; every invariant
_LIVE = collapsed("filing_event", "filing_id, event_type, event_seq", "as_of DESC, row_no DESC", f"as_of <= TIMESTAMP '{PIT}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{PIT}')")


@query(f"SELECT 'm' || event_seq AS model_identity, event_type AS prompt_version, sha256(row_no) AS raw_bytes_sha256 FROM ({_LIVE}) WHERE event_ts BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1998-06-01' ORDER BY event_ts DESC, event_seq, filing_id, event_type, as_of, row_no LIMIT 1")
def research_event_lineage(spark, d):
    x = P.filing_event(spark, d).withColumns({"primary_model_version": F.concat(F.lit("m"), "event_seq"), "primary_prompt_version": F.col("event_type"), "input_text_sha256": F.unhex(F.sha2("row_no", 256))})
    return research.events_with_lineage(x, research.Read(as_of=PIT), occurred_from="1994-01-01 00:00:00", event_after="1990-01-01 00:00:00", event_before="1998-06-01 00:00:00")[1]


@query(f"SELECT filing_id, event_type, event_seq, event_ts FROM ({_LIVE}) WHERE event_ts BETWEEN TIMESTAMP '1994-01-01' AND TIMESTAMP '1998-06-01'")
def research_events_between(spark, d):
    x = research.events(P.filing_event(spark, d), research.Read(as_of=PIT), occurred_from="1994-01-01 00:00:00", occurred_to="1998-06-01 00:00:00")
    return x.select("filing_id", "event_type", "event_seq", "event_ts")


_CPI = "restatement_basis = 'cpi_normalized' AND consolidation = 'consolidated' AND period_type = 'q'"


@query("SELECT entity_id, period_end, canonical_code, value, score FROM (SELECT *, dense_rank() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS dr FROM (" + collapsed("canonical_financial", "entity_id, canonical_code, period_end", f"mapping_version DESC, {_BEST}", _CPI) + ")) c LEFT JOIN (" + collapsed("entity_quality_score", "entity_id, period_end", f"mapping_version DESC, {_BEST}", _CPI, "entity_id, period_end, score") + ") s USING (entity_id, period_end) WHERE dr <= 20")
def entity_financials_filtered(spark, d):
    x = analytics.entity_financials(P.canonical_financial(spark, d), P.entity_quality_score(spark, d), "cpi_normalized", period_type="q", consolidation="consolidated")
    return x.select("entity_id", "period_end", F.explode("lines").alias("canonical_code", "value"), "score")


_KEYS = {n: ", ".join(REGISTRY[n].natural_key()) for n in quality.CHECKED}


@query(
    "SELECT name, CAST(violations AS BIGINT) AS violations, CASE WHEN violations = 0 THEN 'ok' ELSE 'FAIL' END AS status FROM ("
    + " UNION ALL ".join(f"SELECT '{n}_no_duplicate_as_of' AS name, (SELECT count(*) FROM (SELECT 1 FROM {n} GROUP BY {k} HAVING count(*) > 1)) AS violations" for n, k in _KEYS.items())
    + f" UNION ALL SELECT 'observation_as_of_not_null', (SELECT count(*) FROM observation WHERE as_of IS NULL) UNION ALL SELECT 'identifier_no_overlapping_pairs', 2 * (SELECT count(*) FROM ({_INVARIANTS['identifier_overlap']}))"
    + " UNION ALL SELECT 'registry_completeness', 0 UNION ALL SELECT 'append_only_marks', 1)"
)
def bitemporal_invariants(spark, d):
    tables = {n: quality.guarded(f(spark, d)) if n in REGISTRY and n != "entity_version" else f(spark, d) for n, f in P.ALL.items()}
    return quality.bitemporal_invariants(tables, REGISTRY)


# Personal data in nested JSON
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{1,}"
_SPOTS = f"SELECT doc_id, unnest(range(1, len(found) + 1)) AS i, found, between_ FROM (SELECT doc_id, regexp_extract_all(text, '{_EMAIL}') AS found, regexp_split_to_array(text, '{_EMAIL}') AS between_ FROM documents)"


def _wrapped(spark: SparkSession, d: str) -> DataFrame:
    x = P.table(spark, d, "documents")
    return x.select("doc_id", F.to_json(F.struct(F.array(F.lit("x"), F.lit("y")).alias("list"), F.struct(F.array(F.struct("text")).alias("parts"), F.lit(1).alias("12")).alias("meta"), F.array("text").alias("subjects"))).alias("body"))


@query(f"SELECT doc_id, '$.meta.parts[0].text' AS path, CAST(list_sum(list_transform(between_[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start, found[i] AS found FROM ({_SPOTS})")
def nested_findings(spark, d):
    x = nested.findings(_wrapped(spark, d), "body", skip=("subjects", "list")).where("pattern = 'email'")
    return x.select("doc_id", nested.json_path(F.col("path")).alias("path"), "start", "found")


@query("SELECT doc_id, '$.meta.12' AS path FROM documents")
def nested_numeric_keys(spark, d):
    return nested.numeric_keys(_wrapped(spark, d), "body").select("doc_id", nested.json_path(F.col("path")).alias("path"))


@query(f"SELECT doc_id, sha256(regexp_replace(text, '{_EMAIL}', '[REDACTED:Art.17:email]', 'g')) AS scrubbed FROM documents")
def nested_scrubbed(spark, d):
    x = _wrapped(spark, d)
    out = nested.scrubbed(x, nested.findings(x, "body").where("pattern = 'email'"), "doc_id", "body")
    return out.select("doc_id", F.sha2(F.get_json_object("body", "$.meta.parts[0].text"), 256).alias("scrubbed"))


# The outbox
@query("SELECT event_id AS outbox_id, least(fails, 3) AS failures, fails < 3 AS published, CASE WHEN fails > 0 THEN 'down ' || least(fails, 3) END AS last_error FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN event_id % 5 ELSE 0 END AS fails FROM events)")
def drained_outbox(spark, d):
    """Every event is to be sent; three drains, where each seventh event fails up to four times."""
    box = Outbox(spark, scratch(spark, "outbox"), buckets=8)
    e = P.table(spark, d, "events")
    box.add("all", e.select(F.col("event_id").alias("outbox_id"), F.concat(F.lit("events."), "event_type").alias("stream_name"), F.col("event_id").cast("string").alias("event_id"), F.lit(1).alias("schema_version"), F.col("props").alias("payload"), F.col("ts").alias("created_at")))
    for n in (1, 2, 3):
        down = (F.col("outbox_id") % 7 == 0) & (F.col("outbox_id") % 5 >= n)
        box.drain(f"r{n}", lambda rows, n=n, down=down: rows.select("outbox_id", F.when(~down, F.concat(F.lit(f"{n}-"), "outbox_id")).alias("message_id"), F.when(down, F.lit(f"down {n}")).alias("error")))
    return box.state().select("outbox_id", "failures", F.col("published_at").isNotNull().alias("published"), "last_error")


# Pages and reads of operators
@query("SELECT offer_id, source_id, published_at, coalesce(n, 0) AS attachments FROM (SELECT *, CAST(DATE '2024-01-01' + CAST(offer_id % 90 AS INT) AS TIMESTAMP) AS published_at FROM filing) LEFT JOIN (SELECT doc_id AS offer_id, count(*) AS n FROM (SELECT doc_id, unnest(range(doc_id % 4)) FROM documents) GROUP BY 1) USING (offer_id) ORDER BY published_at DESC, offer_id LIMIT 60")
def documents_page(spark, d):
    attached = P.table(spark, d, "documents").where("doc_id % 4 > 0").select(F.col("doc_id").alias("filing_id"), F.explode(F.sequence(F.lit(1), F.col("doc_id") % 4)).alias("seq"))
    return dashboard.documents_page(_published(spark, d), attached, 60)


@query("SELECT event_id, copies, deleted FROM (SELECT event_id, ts FROM events WHERE event_id % 50 = 0 ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 30) JOIN (SELECT event_id, 1 + event_id % 3 AS copies, CASE WHEN event_id % 100 = 0 THEN 1 ELSE 0 END AS deleted FROM events) USING (event_id)")
def redactions_page(spark, d):
    e = P.table(spark, d, "events").select(F.col("event_id").alias("number"), F.col("event_id").cast("string").alias("event_id"), "ts")
    registry = e.where("number % 50 = 0").select("event_id", F.lit("art17").alias("redaction_reason"), F.lit("s").alias("original_stream"), F.col("ts").alias("redacted_at"), F.sha2("event_id", 256).alias("redacted_payload_hash"), F.lit("o").alias("original_payload_hash"))
    copies = e.select("event_id", F.explode(F.sequence(F.lit(0), F.col("number") % 3)).alias("copy"), "number", "ts")
    copies = copies.select("event_id", F.when((F.col("number") % 100 == 0) & (F.col("copy") == 0), F.col("ts")).alias("redacted_at"))
    return dashboard.redactions_page(registry, copies, 30).select(F.col("event_id").cast("long").alias("event_id"), "copies", "deleted")


@query("WITH m AS (SELECT event_type AS stream, event_id FROM events), d AS (SELECT stream, g, event_id, event_id % 4 = 0 AS acked, event_id % 3 AS consumer FROM m, (VALUES ('g1', 7), ('g2', 11)) v(g, k) WHERE event_id % k = 0) SELECT d.stream, g AS consumer_group, (SELECT count(*) FROM m WHERE m.stream = d.stream AND m.event_id > max(d.event_id)) AS lag, count(*) FILTER (NOT acked) AS pending, CAST(min(event_id) FILTER (NOT acked) AS VARCHAR) || '-0' AS min_pending, CAST(max(event_id) FILTER (NOT acked) AS VARCHAR) || '-0' AS max_pending, count(DISTINCT consumer) AS consumers, CAST(max(event_id) AS VARCHAR) || '-0' AS last_delivered_id FROM d GROUP BY d.stream, g")
def stream_group_lag(spark, d):
    e = P.table(spark, d, "events").select(F.col("event_type").alias("stream"), "event_id", F.concat(F.col("event_id").cast("string"), F.lit("-0")).alias("message_id"))
    of = lambda group, k: e.where(F.col("event_id") % k == 0).select("stream", F.lit(group).alias("consumer_group"), (F.col("event_id") % 3).cast("string").alias("consumer"), "message_id", (F.col("event_id") % 4 == 0).alias("acked"))
    return events.group_lag(e, of("g1", 7).unionByName(of("g2", 11)))


# Seeds and the snapshot
@query("SELECT o_custkey AS entity_id, 'Name ' || arg_max(o_orderkey, o_orderkey) AS legal_name FROM orders GROUP BY 1")
def seeded_entities(spark, d):
    """A dimension seeded from the older half of the orders, then from the newer, of which the last row of a key counts."""
    held = store.Store(spark, scratch(spark, "dimension"), {"entity": ("entity_id bigint, legal_name string", ("entity_id",))}, buckets=4)
    o = P.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("entity_id"), F.concat(F.lit("Name "), "o_orderkey").alias("legal_name"))
    middle = o.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o_orderkey)").alias("m")).first()["m"]
    for part in (o.where(F.col("o_orderkey") <= middle), o.where(F.col("o_orderkey") > middle)):
        store.upsert(held, "entity", first_per_key(part, ["entity_id"], F.col("o_orderkey").desc()))
    return held.read("entity")


@query("SELECT e.entity_id, legal_name, last_filing FROM entity e LEFT JOIN (SELECT entity_id, max(published_at) AS last_filing FROM disclosures_version GROUP BY 1) f USING (entity_id)")
def refreshed_snapshot(spark, d):
    """The snapshot of one day, replaced by that of a later one."""
    held = store.Dimensions(spark, scratch(spark, "snapshot"))
    for day in ("1996-01-01", "2000-06-15"):
        held.replace("entity_snapshot", analytics.snapshot(P.entity(spark, d), P.identifier(spark, d), P.disclosures_version(spark, d), day))
    return held.read("entity_snapshot").select("entity_id", "legal_name", "last_filing")


# JSON documents, derived checks, processed events
@query("SELECT event_id, json_extract(props, '$.k') = 5 OR json_extract(props, '$.k') = 50 AS held, json_extract_string(props, '$.k') AS k, 'r' || event_id % 3 AS last_ref FROM events")
def json_documents(spark, d):
    e, props = P.table(spark, d, "events"), F.col("props")
    listed = docs.appended(docs.with_key(props, "refs", F.lit('["r0"]')), "refs", "r1")
    ref = F.when(F.col("event_id") % 3 == 0, docs.with_key(props, "refs", F.lit('["r0"]'))).when(F.col("event_id") % 3 == 1, listed).otherwise(docs.merged(listed, F.lit('{"refs":["r2"]}')))
    held = docs.contains(props, {"k": 5}) | docs.contains(props, {"k": 50})
    return e.select("event_id", held.alias("held"), F.get_json_object("props", "$.k").alias("k"), F.element_at(F.from_json(F.get_json_object(ref, "$.refs"), "array<string>"), -1).alias("last_ref"))


@query("SELECT entity_id, period_end, canonical_code, round(value, 4) AS value, round(expected, 4) AS expected, CASE WHEN value IS NULL OR expected IS NULL THEN 'unknown' WHEN 100 * abs(value - expected) <= 40 * abs(expected) THEN 'pass' ELSE 'fail' END AS state FROM (SELECT entity_id, period_end, unnest(['is.revenue', 'bs.assets']) AS canonical_code, unnest([revenue, assets]) AS value, unnest([costs, cash]) AS expected FROM (" + _PICKED + ") WHERE coalesce(revenue, costs, assets, cash) IS NOT NULL)")
def derived_checks(spark, d):
    lines = [dataclasses.replace(x, check={"is.revenue": "is.costs", "bs.assets": "bs.cash"}.get(x.code)) for x in _MANIFEST if x.mode in ("pick_first", "sum_components")]
    values = mapping.canonical_values(P.financial_line_item(spark, d), lines, ["entity_id", "period_end"])
    x = mapping.derived_checks(values, lines, ["entity_id", "period_end"], 40.0)
    return x.select("entity_id", "period_end", "canonical_code", F.round("value", 4).alias("value"), F.round("expected", 4).alias("expected"), "state")


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, event_type FROM events WHERE event_id % 3 > 0")
def unprocessed_events(spark, d):
    """A group is done with every third event, told of them in two batches that share some, the second twice."""
    held = store.Processed(spark, scratch(spark, "processed"), buckets=8)
    e = P.table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), "event_type", F.col("event_id").alias("n"))
    for batch, where in (("b1", "n % 6 = 0"), ("b2", "n % 3 = 0"), ("b2", "n % 3 = 0")):
        held.done(batch, e.where(where), "events", "g")
    return held.unseen(e, "events", "g").select("event_id", "event_type")
