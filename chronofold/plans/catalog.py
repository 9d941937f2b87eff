"""Every query of the library by name, with the SQL it is checked against.

A query is a thin composition of operators over the projections; points in time, clocks and bounds are literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.functions import hashing, personal, text
from chronofold.operators import analytics, audit, dashboard, documents, entities, ingest, mapping, quality, roles, series, temporal
from chronofold.plans import research
from chronofold.plans.views import collapsed, sql
from chronofold.schemas import REGISTRY
from chronofold.sources import projections as P

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

PIT = "2000-06-15 12:00:00"
EVENT_PIT = "2024-01-15 12:00:00"
NOW = "2024-01-20 00:00:00"


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _queries[f.__name__] = f
        if oracle:
            _oracles[f.__name__] = sql(oracle)
        return f

    return keep


def _more() -> None:
    """The queries of other modules, which need this one."""
    from chronofold.plans import changes  # noqa: F401


def queries() -> dict[str, Query]:
    _more()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _more()
    return dict(_oracles)


def _pit_query(name: str, columns: list[str], at: str, ties: str = "row_no DESC", live: str = "TRUE") -> None:
    fact = REGISTRY[name]

    def f(spark: SparkSession, d: str) -> DataFrame:
        return temporal.pit(P.ALL[name](spark, d), name, at).select(*columns)

    f.__name__ = f"pit_{name}"
    query(collapsed(name, ", ".join(fact.key), f"as_of DESC, {ties}", f"as_of <= TIMESTAMP '{at}' AND ({live})", ", ".join(columns)))(f)


# Point-in-time reads
_pit_query("observation", ["series_id", "ts", "as_of", "value"], EVENT_PIT, "event_id DESC")
_pit_query("financial_line_item", ["entity_id", "filing_id", "statement_type", "line_code", "consolidation", "period_end", "as_of", "value"], PIT)
_pit_query("canonical_financial", ["entity_id", "canonical_code", "period_end", "currency_code", "restatement_basis", "mapping_version", "as_of", "value"], PIT)
_pit_query("entity_quality_score", ["entity_id", "period_end", "restatement_basis", "mapping_version", "score", "as_of"], PIT)
_pit_query("entity_version", ["entity_id", "legal_name", "event_kind", "as_of"], PIT, live="event_kind <> 'deleted'")
_pit_query("entity_lineage", ["event_kind", "from_entity_id", "into_entity_id", "event_at", "as_of"], PIT)
_pit_query("filing_event", ["filing_id", "event_type", "event_seq", "entity_id", "as_of"], PIT, live=f"superseded_at IS NULL OR superseded_at > TIMESTAMP '{PIT}'")
_pit_query("disclosures_version", ["disclosure_id", "entity_id", "event_kind", "as_of"], PIT, live="event_kind <> 'deleted'")


@query(f"SELECT identifier_id, entity_id, namespace, value FROM identifier WHERE valid_from <= DATE '2000-06-15' AND valid_to > DATE '2000-06-15'")
def pit_identifier(spark, d):
    return temporal.valid_at(P.identifier(spark, d), "2000-06-15").select("identifier_id", "entity_id", "namespace", "value")


@query(collapsed("filing_event", "filing_id, event_type, event_seq", "as_of DESC, row_no DESC", "superseded_at IS NULL", "filing_id, event_type, event_seq, as_of"))
def filing_event_current(spark, d):
    return temporal.current(P.filing_event(spark, d), "filing_event").select("filing_id", "event_type", "event_seq", "as_of")


@query("SELECT * FROM (" + collapsed("entity_version", "entity_id", "as_of DESC, row_no DESC", f"as_of <= TIMESTAMP '{PIT}'", "entity_id, event_kind, as_of") + ") WHERE event_kind <> 'deleted'")
def pit_entity_hide_deleted(spark, d):
    return temporal.pit(P.entity_version(spark, d), "entity_version", PIT, hide_deleted=True).select("entity_id", "event_kind", "as_of")


@query("SELECT series_id, ts, as_of, value FROM observation WHERE as_of >= TIMESTAMP '2024-01-10 00:00:00' AND as_of < TIMESTAMP '2024-01-12 00:00:00'")
def interval_observation(spark, d):
    x = temporal.interval(P.observation(spark, d), "observation", "2024-01-10 00:00:00", "2024-01-12 00:00:00")
    return x.orderBy(*temporal.chain_order("observation")).select("series_id", "ts", "as_of", "value")


@query(collapsed("observation", "series_id", "ts DESC, as_of DESC, event_id DESC", f"as_of <= TIMESTAMP '{EVENT_PIT}'", "series_id, ts, as_of, value"))
def latest_observation(spark, d):
    return temporal.latest(P.observation(spark, d), EVENT_PIT).select("series_id", "ts", "as_of", "value")


@query(collapsed("observation", "series_id, ts", "as_of DESC, event_id DESC", f"as_of <= TIMESTAMP '{EVENT_PIT}' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-14 00:00:00'", "series_id, ts, value"))
def range_observation(spark, d):
    return temporal.series_range(P.observation(spark, d), "2024-01-05 00:00:00", "2024-01-14 00:00:00", EVENT_PIT).select("series_id", "ts", "value")


@query(collapsed("disclosures_version", "disclosure_id", "as_of DESC NULLS LAST, row_no DESC", f"(as_of <= TIMESTAMP '{PIT}' OR provenance = 'pre_bitemporal_unknown') AND event_kind <> 'deleted'", "disclosure_id, form_type, provenance, as_of"))
def pit_disclosures_pre_bitemporal(spark, d):
    return temporal.pit(P.disclosures_version(spark, d), "disclosures_version", PIT, keep_unknown="provenance = 'pre_bitemporal_unknown'").select("disclosure_id", "form_type", "provenance", "as_of")


@query("SELECT a.series_id, a.ts, a.value AS before, b.value AS after FROM (" + collapsed("observation", "series_id, ts", "as_of DESC, event_id DESC", "as_of <= TIMESTAMP '2024-01-15 09:00:00'") + ") a JOIN (" + collapsed("observation", "series_id, ts", "as_of DESC, event_id DESC", "as_of <= TIMESTAMP '2024-01-15 21:00:00'") + ") b USING (series_id, ts) WHERE a.value IS DISTINCT FROM b.value")
def amended_observations(spark, d):
    return temporal.amended(P.observation(spark, d), "observation", "2024-01-15 09:00:00", "2024-01-15 21:00:00").select("series_id", "ts", "before", "after")


@query("SELECT entity_id, row_no, l_event_kind, l_from_entity_id, l_into_entity_id, l_event_at, l_as_of FROM (SELECT v.entity_id, v.row_no, l.event_kind AS l_event_kind, l.from_entity_id AS l_from_entity_id, l.into_entity_id AS l_into_entity_id, l.event_at AS l_event_at, l.as_of AS l_as_of, row_number() OVER (PARTITION BY v.entity_id, v.as_of, v.row_no, l.event_kind, l.from_entity_id, l.into_entity_id, l.event_at ORDER BY l.as_of DESC, l.row_no DESC) AS rk FROM entity_version v JOIN entity_lineage l ON (l.from_entity_id = v.entity_id OR l.into_entity_id = v.entity_id) AND l.as_of <= v.as_of) WHERE rk = 1")
def lineage_as_of_versions(spark, d):
    return temporal.lineage_as_of(P.entity_version(spark, d), P.entity_lineage(spark, d)).select("entity_id", "row_no", "l_event_kind", "l_from_entity_id", "l_into_entity_id", "l_event_at", "l_as_of")


@query("SELECT coalesce(n.entity_id, o.entity_id) AS entity_id, CASE WHEN o.entity_id IS NULL THEN 'created' WHEN n.entity_id IS NULL THEN 'deleted' WHEN n.status = 'merged' AND o.status <> 'merged' THEN 'merged' WHEN n.legal_name <> o.legal_name THEN 'renamed' ELSE 'updated' END AS event_kind FROM (SELECT * FROM entity WHERE entity_id % 5 <> 0) o FULL JOIN (SELECT entity_id, CASE WHEN entity_id % 4 = 0 THEN legal_name || ' AS' ELSE legal_name END AS legal_name, CASE WHEN entity_id % 6 = 0 THEN 'merged' ELSE status END AS status FROM entity WHERE entity_id % 9 <> 0) n USING (entity_id) WHERE o.entity_id IS NULL OR n.entity_id IS NULL OR n.status <> o.status OR n.legal_name <> o.legal_name")
def capture_entity_changes(spark, d):
    e = P.entity(spark, d).select("entity_id", "legal_name", "status")
    new = e.where("entity_id % 9 <> 0").withColumn("legal_name", F.when(F.col("entity_id") % 4 == 0, F.concat("legal_name", F.lit(" AS"))).otherwise(F.col("legal_name"))).withColumn("status", F.when(F.col("entity_id") % 6 == 0, "merged").otherwise(F.col("status")))
    return temporal.capture(e.where("entity_id % 5 <> 0"), new, "entity_id", temporal.entity_kind(), NOW).select("entity_id", "event_kind")


@query("SELECT entity_id, legal_name, 'created' AS event_kind, created_at AS as_of FROM entity UNION ALL SELECT entity_id, legal_name, 'updated', updated_at FROM entity WHERE updated_at > created_at")
def backfill_entity_history(spark, d):
    return temporal.backfill(P.entity(spark, d))


# Analytics
_BEST = "as_of DESC, row_no DESC"
_CANON = "restatement_basis = 'as_reported'"


@query("SELECT entity_id, period_end, canonical_code, value, score FROM (SELECT *, dense_rank() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS dr FROM (" + collapsed("canonical_financial", "entity_id, canonical_code, period_end", f"mapping_version DESC, {_BEST}", f"{_CANON} AND canonical_code LIKE 'is.%'") + ")) c LEFT JOIN (" + collapsed("entity_quality_score", "entity_id, period_end", f"mapping_version DESC, {_BEST}", _CANON, "entity_id, period_end, score") + ") s USING (entity_id, period_end) WHERE dr <= 4")
def entity_financials(spark, d):
    x = analytics.entity_financials(P.canonical_financial(spark, d), P.entity_quality_score(spark, d), statement="is", limit=4)
    return x.select("entity_id", "period_end", F.explode("lines").alias("canonical_code", "value"), "score")


_ASKED = "SELECT unnest(CAST([1, 2, 3, 5, 999999] AS BIGINT[])) AS entity_id"


@query(f"SELECT a.entity_id, p.period_end, p.value FROM ({_ASKED}) a LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC) AS n FROM (" + collapsed("canonical_financial", "entity_id, period_end", f"mapping_version DESC, {_BEST}", f"{_CANON} AND canonical_code = 'is.1'") + ")) p ON p.entity_id = a.entity_id AND n <= 5")
def compare_metric(spark, d):
    x = analytics.compare_metric(P.canonical_financial(spark, d), [1, 2, 3, 5, 999999], "is.1", limit=5)
    return x.select("entity_id", F.explode_outer("points").alias("p")).select("entity_id", "p.period_end", "p.value")


def _side(basis: str) -> str:
    return collapsed("canonical_financial", "entity_id, period_end, period_type", f"mapping_version DESC, {_BEST}", f"restatement_basis = '{basis}' AND canonical_code = 'is.1'")


@query(f"SELECT entity_id, period_end, period_type, r.value AS reported, n.value AS normalized, CASE WHEN n.cpi_base_date <> DATE '9999-01-01' THEN n.cpi_base_date END AS cpi_base_date FROM ({_side('as_reported')}) r FULL JOIN ({_side('cpi_normalized')}) n USING (entity_id, period_end, period_type)")
def metric_dual_series(spark, d):
    return analytics.dual_series(P.canonical_financial(spark, d), "is.1")


@query(f"SELECT entity_id, period_end, period_type, CAST(NULL AS DOUBLE) AS reported, value AS normalized FROM ({_side('cpi_normalized')})")
def metric_single_series(spark, d):
    return analytics.single_series(P.canonical_financial(spark, d), "is.1", "cpi_normalized")


@query("SELECT entity_id, CAST(ts AS DATE) AS day, " + ", ".join(f"min_by(coalesce(value, 0), ts) FILTER (metric = '{m}') AS {m}" for m in ("price_open", "price_high", "price_low", "price_close", "volume")) + " FROM price WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' GROUP BY ALL")
def prices_ohlcv(spark, d):
    return analytics.ohlcv(P.price(spark, d), "2024-01-05", "2024-01-25")


@query("SELECT entity_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY ts DESC, event_id DESC) AS n FROM price WHERE metric = 'volume') WHERE n <= 50 AND value IS NOT NULL")
def nav_series(spark, d):
    return analytics.metric_series(P.price(spark, d), "volume", 50)


@query("SELECT entity_id, replace(metric, 'price_', '') AS name, ts, value FROM (" + collapsed("price", "entity_id, metric", "ts DESC, event_id DESC", "metric LIKE 'price_%'") + ") WHERE value IS NOT NULL")
def fundamentals_snapshot(spark, d):
    return analytics.fundamentals(P.price(spark, d))


@query("SELECT series_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS month, arg_max(value, as_of) AS last_value, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value, count(*) AS n FROM observation WHERE value IS NOT NULL GROUP BY 1, 2")
def monthly_rollup(spark, d):
    return analytics.monthly_rollup(P.observation(spark, d)).withColumn("avg_value", F.round("avg_value", 6))


@query("SELECT entity_id, period_end, score, unnest(['balance', 'coverage']) AS check_name, unnest([state, 'unknown']) AS state, unnest([CAST(delta AS DOUBLE), NULL]) AS delta_pct FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY period_end DESC, as_of DESC, row_no DESC) AS n FROM entity_quality_score) WHERE n <= 3")
def quality_history(spark, d):
    x = analytics.quality_history(P.entity_quality_score(spark, d), 3)
    return x.select("entity_id", "period_end", "score", F.explode("checks").alias("check_name", "c")).select("entity_id", "period_end", "score", "check_name", "c.state", "c.delta_pct")


@query("SELECT e.entity_id, legal_name, ticker, last_period, n_lines, avg_score FROM (SELECT * FROM entity WHERE legal_name ILIKE '%01%') e LEFT JOIN (SELECT DISTINCT entity_id, value AS ticker FROM identifier WHERE namespace = 'ticker') t USING (entity_id) JOIN (SELECT entity_id, max(period_end) AS last_period, count(*) AS n_lines FROM canonical_financial GROUP BY 1) c USING (entity_id) LEFT JOIN (SELECT entity_id, CAST(round(avg(score)) AS INT) AS avg_score FROM entity_quality_score GROUP BY 1) s USING (entity_id)")
def entity_list(spark, d):
    return analytics.entity_overview(P.entity(spark, d), P.identifier(spark, d), P.canonical_financial(spark, d), P.entity_quality_score(spark, d), search="01")


@query("SELECT count(*) AS total FROM entity WHERE entity_id IN (SELECT entity_id FROM canonical_financial)")
def entity_total(spark, d):
    return analytics.count_with(P.entity(spark, d), P.canonical_financial(spark, d))


@query("SELECT e.entity_id, legal_name, ticker, last_filing, coalesce(filings_30d, 0) AS filings_30d FROM entity e LEFT JOIN (" + collapsed("identifier", "entity_id", "is_primary DESC, identifier_id DESC", "namespace = 'ticker' AND DATE '2000-06-15' BETWEEN valid_from AND valid_to", "entity_id, value AS ticker") + ") t USING (entity_id) LEFT JOIN (SELECT entity_id, max(published_at) AS last_filing, count(*) FILTER (CAST(published_at AS DATE) > DATE '2000-06-15' - 30 AND CAST(published_at AS DATE) <= DATE '2000-06-15') AS filings_30d FROM disclosures_version GROUP BY 1) f USING (entity_id)")
def entity_snapshot(spark, d):
    return analytics.snapshot(P.entity(spark, d), P.identifier(spark, d), P.disclosures_version(spark, d), "2000-06-15")


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    return analytics.latency_percentiles(P.table(spark, d, "events"), "event_type", "value").select("event_type", F.round("p50", 6).alias("p50"), F.round("p99", 6).alias("p99"))


@query(f"SELECT filing_id, event_type, event_seq, '<REDACTED:counterparty>' AS counterparty, CAST(l_partkey AS VARCHAR) AS amount FROM (" + collapsed("filing_event", "filing_id, event_type, event_seq", "as_of DESC, row_no DESC", f"as_of <= TIMESTAMP '{PIT}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{PIT}')") + ")")
def events_masked(spark, d):
    x = temporal.pit(P.filing_event(spark, d), "filing_event", PIT).withColumn("p", analytics.masked(F.col("payload"), ["counterparty"]))
    return x.select("filing_id", "event_type", "event_seq", F.get_json_object("p", "$.counterparty").alias("counterparty"), F.get_json_object("p", "$.amount").alias("amount"))


# Registry
@query("SELECT a.namespace, a.value, a.identifier_id AS id_a, b.identifier_id AS id_b FROM identifier a JOIN identifier b ON a.namespace = b.namespace AND a.value = b.value AND a.identifier_id < b.identifier_id AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to WHERE a.valid_from < a.valid_to AND b.valid_from < b.valid_to")
def identifier_overlaps(spark, d):
    return entities.overlaps(P.identifier(spark, d))


@query("SELECT namespace, value, count(*) AS n FROM (SELECT *, max(valid_to) OVER (PARTITION BY namespace, value ORDER BY valid_from, identifier_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM identifier WHERE valid_from < valid_to) WHERE valid_from < reach GROUP BY 1, 2")
def identifier_shared_values(spark, d):
    return entities.overlapping_values(P.identifier(spark, d))


@query(collapsed("identifier", "namespace, value", "is_primary DESC, identifier_id DESC", "valid_from <= DATE '2000-06-15' AND valid_to > DATE '2000-06-15'", "namespace, value, entity_id, identifier_id"))
def resolve_identifiers(spark, d):
    return entities.resolve(P.identifier(spark, d), "2000-06-15")


@query(collapsed("identifier", "entity_id, namespace", "is_primary DESC, identifier_id DESC", "valid_from <= DATE '2000-06-15' AND valid_to > DATE '2000-06-15'", "entity_id, namespace, value"))
def entity_names_by_namespace(spark, d):
    return entities.names_by_namespace(P.identifier(spark, d), "2000-06-15")


_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(f"SELECT entity_id, legal_name, round(similarity, 6) AS similarity FROM (SELECT entity_id, legal_name, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS similarity FROM (SELECT entity_id, legal_name, {_GRAMS.format('legal_name')} AS a, {_GRAMS.format(chr(39) + 'customer 000000042' + chr(39))} AS b FROM entity)) WHERE round(similarity, 6) >= 0.3 ORDER BY round(similarity, 6) DESC, legal_name, entity_id LIMIT 20")
def entity_search(spark, d):
    return entities.search(P.entity(spark, d), "customer 000000042")


@query("SELECT entity_id, CASE WHEN o.entity_type IS NULL THEN 'created' WHEN o.entity_type = n.entity_type THEN 'unchanged' ELSE 'changed' END AS outcome FROM (SELECT entity_id, CASE WHEN entity_id % 4 = 0 THEN 'fund' ELSE entity_type END AS entity_type FROM entity) n LEFT JOIN (SELECT entity_id, entity_type FROM entity WHERE entity_id % 5 <> 0) o USING (entity_id)")
def upsert_outcomes(spark, d):
    e = P.entity(spark, d).select("entity_id", "entity_type")
    new = e.withColumn("entity_type", F.when(F.col("entity_id") % 4 == 0, "fund").otherwise(F.col("entity_type")))
    return entities.changes(e.where("entity_id % 5 <> 0"), new, ["entity_id"])


@query("SELECT offer_id, CASE WHEN n = 0 THEN 'insert' WHEN n = 1 AND NOT coalesce(foreign_held, FALSE) THEN 'existing' ELSE 'merge_required' END AS outcome, CASE WHEN n = 1 THEN entity_id END AS entity_id FROM (SELECT o.offer_id, count(DISTINCT i.entity_id) AS n, min(i.entity_id) AS entity_id, bool_or(i.held_by <> o.source_id) AS foreign_held FROM (SELECT c_custkey AS offer_id, 'src' || (c_custkey % 2) AS source_id, 'T' || (c_custkey % 500) AS value FROM customer) o LEFT JOIN (SELECT DISTINCT value, entity_id, 'src' || (entity_id % 2) AS held_by FROM identifier WHERE namespace = 'ticker' AND entity_id % 3 = 0) i USING (value) GROUP BY o.offer_id, o.source_id)")
def match_offered_entities(spark, d):
    offers = P.table(spark, d, "customer").select(F.col("c_custkey").alias("offer_id"), F.concat(F.lit("src"), F.col("c_custkey") % 2).alias("source_id"), F.lit("ticker").alias("namespace"), F.concat(F.lit("T"), F.col("c_custkey") % 500).alias("value"))
    known = P.identifier(spark, d).where("namespace = 'ticker' AND entity_id % 3 = 0").withColumn("source_id", F.concat(F.lit("src"), F.col("entity_id") % 2)).select("namespace", "value", "entity_id", "source_id")
    return entities.match_entities(offers, known)


# Quality and derivation
_INVARIANTS = {
    "duplicate_observation": "SELECT 1 FROM observation GROUP BY series_id, ts, as_of HAVING count(*) > 1",
    "duplicate_disclosures_version": "SELECT 1 FROM disclosures_version GROUP BY disclosure_id, as_of HAVING count(*) > 1",
    "duplicate_entity_version": "SELECT 1 FROM entity_version GROUP BY entity_id, as_of HAVING count(*) > 1",
    "identifier_overlap": "SELECT 1 FROM identifier a JOIN identifier b ON a.namespace = b.namespace AND a.value = b.value AND a.identifier_id < b.identifier_id AND a.valid_from < b.valid_to AND b.valid_from < a.valid_to WHERE a.valid_from < a.valid_to AND b.valid_from < b.valid_to",
}


@query("SELECT *, CASE WHEN violations = 0 THEN 'ok' ELSE 'FAIL' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, (SELECT count(*) FROM ({q})) AS violations" for n, q in _INVARIANTS.items()) + ")")
def invariant_report(spark, d):
    facts = {n: (P.ALL[n](spark, d), REGISTRY[n]) for n in ("observation", "disclosures_version", "entity_version")}
    return quality.invariants(facts, P.identifier(spark, d))


@query("SELECT entity_id, filing_id, line_code, row_no, measuring_unit_date, CASE WHEN ex THEN 'P0_exempt' WHEN mo THEN 'P1_monetary_line' WHEN inf THEN 'P2_inflation_tag' WHEN period_end >= DATE '2000-12-31' THEN 'P3_period' ELSE 'P4_no_evidence' END AS derivation_reason, CASE WHEN ex THEN 'as_reported' WHEN mo OR inf OR period_end >= DATE '2000-12-31' THEN 'cpi_normalized' ELSE 'as_reported' END AS restatement_basis FROM (SELECT *, entity_id % 50 = 0 AS ex, max(period_end) OVER w AS measuring_unit_date, bool_or(line_code = 'is.7') OVER w AS mo, bool_or(line_code LIKE 'cf.1%') OVER w AS inf FROM financial_line_item WINDOW w AS (PARTITION BY filing_id))")
def restatement_derivation(spark, d):
    exempt = P.entity(spark, d).where("entity_id % 50 = 0").select("entity_id")
    x = quality.derive_basis(P.financial_line_item(spark, d), exempt, "is.7", "cf.1%", "2000-12-31")
    return x.select("entity_id", "filing_id", "line_code", "row_no", "measuring_unit_date", "derivation_reason", "restatement_basis")


@query("SELECT DISTINCT user_id AS series_id FROM events WHERE user_id % 4 = 0")
def orphan_series(spark, d):
    child = P.observation(spark, d).select("series_id").distinct()
    return quality.orphans(child, P.series_catalog(spark, d).where("series_id % 4 <> 0"), ["series_id"])


# Ingest
_BATCH = "SELECT *, sha256(CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR)) AS payload_hash FROM observation"


@query(f"SELECT series_id, ts, as_of, CASE WHEN event_id % 3 = 0 THEN 'inserted' WHEN event_id % 7 = 0 THEN 'conflict' ELSE 'unchanged' END AS action FROM ({_BATCH})")
def ingest_actions(spark, d):
    batch, stored = _batch(spark, d)
    return ingest.compare(batch, stored, ("series_id", "ts", "as_of")).select("series_id", "ts", "as_of", "action")


def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    batch = P.observation(spark, d).withColumn("payload_hash", F.sha2(F.round(F.col("value") * 100).cast("long").cast("string"), 256))
    stored = batch.where("event_id % 3 <> 0").withColumn("payload_hash", F.when(F.col("event_id") % 7 == 0, F.lit("other")).otherwise(F.col("payload_hash")))
    return batch.unionByName(batch.where("event_id % 10 = 0")), stored


@query("SELECT count(*) AS batch_size, count(*) FILTER (event_id % 3 = 0) AS inserted, count(*) FILTER (event_id % 3 <> 0 AND event_id % 7 <> 0) AS unchanged, min(ts) AS min_ts, max(ts) AS max_ts, min(as_of) AS min_as_of, max(as_of) AS max_as_of FROM observation")
def ingest_audit(spark, d):
    batch, stored = _batch(spark, d)
    return ingest.batch_audit(ingest.compare(batch, stored, ("series_id", "ts", "as_of")))


# Documents
_STORED = "(SELECT *, row_number() OVER (PARTITION BY source_id, source_ref ORDER BY offer_id) AS revision_no, lag(offer_id) OVER (PARTITION BY source_id, source_ref ORDER BY offer_id) AS previous_id FROM (" + collapsed("filing", "source_id, sha256", "offer_id") + "))"


@query(f"SELECT offer_id, source_id, source_ref, sha256, revision_no, previous_id, revision_no > 1 AS is_amendment, coalesce(n, 0) AS n_aliases FROM {_STORED} LEFT JOIN (SELECT source_id, sha256, count(DISTINCT source_ref) AS n FROM filing f WHERE source_ref <> (SELECT arg_min(g.source_ref, g.offer_id) FROM filing g WHERE g.source_id = f.source_id AND g.sha256 = f.sha256) GROUP BY 1, 2) USING (source_id, sha256)")
def stored_filings(spark, d):
    x = documents.put_filings(P.filing(spark, d))
    return x.select("offer_id", "source_id", "source_ref", "sha256", "revision_no", "previous_id", "is_amendment", F.size("aliases").cast("long").alias("n_aliases"))


@query(f"SELECT source_id, source_ref AS ref, arg_max(offer_id, revision_no) AS offer_id FROM {_STORED} WHERE offer_id % 2 >= 0 GROUP BY 1, 2 UNION ALL SELECT source_id, ref, arg_max(offer_id, revision_no * 1000000000 + offer_id) FROM (SELECT DISTINCT f.source_id, f.source_ref AS ref, s.offer_id, s.revision_no FROM filing f JOIN {_STORED} s ON f.source_id = s.source_id AND f.sha256 = s.sha256 AND f.source_ref <> s.source_ref) WHERE (source_id, ref) NOT IN (SELECT (source_id, source_ref) FROM {_STORED}) GROUP BY 1, 2")
def filings_by_reference(spark, d):
    return documents.find_by_ref(documents.put_filings(P.filing(spark, d)))


@query(f"SELECT offer_id FROM {_STORED} WHERE offer_id NOT IN (SELECT previous_id FROM {_STORED} WHERE previous_id IS NOT NULL)")
def releasable_filings(spark, d):
    return documents.releasable(documents.put_filings(P.filing(spark, d))).select("offer_id")


# Text and personal data
@query(r"SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{1,}')) AS n_emails, sha256(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{1,}', '[REDACTED:Art.17:email]', 'g')) AS scrubbed FROM documents")
def scrubbed_documents(spark, d):
    x = P.table(spark, d, "documents")
    return x.select("doc_id", personal.n_emails(F.col("text")).cast("long").alias("n_emails"), F.sha2(personal.scrubbed_emails(F.col("text")), 256).alias("scrubbed"))


@query("SELECT c_custkey, CASE WHEN length(d) = 10 THEN d END AS tax, upper(trim(c_mktsegment)) AS ticker, CASE WHEN length(trim(c_mktsegment)) = 12 THEN upper(trim(c_mktsegment)) END AS isin FROM (SELECT *, regexp_replace(c_name || '9', '[^0-9]', '', 'g') AS d FROM customer)")
def normalized_identifiers(spark, d):
    x = P.table(spark, d, "customer")
    return x.select("c_custkey", text.tax_number(F.concat("c_name", F.lit("9"))).alias("tax"), text.ticker(F.col("c_mktsegment")).alias("ticker"), text.isin(F.col("c_mktsegment")).alias("isin"))


_AGE = "CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' END"
_SIZE = "CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END"


@query(f"SELECT event_id, {_AGE} AS age, {_SIZE} AS size, CASE WHEN event_type IN ('view', 'click') THEN event_type WHEN starts_with(event_type, 'pur') THEN 'sale' ELSE 'other' END AS label, '10.' || (user_id % 256) || '.' || (event_id % 256) || '.0/24' AS ip, CASE WHEN event_id % 3 = 0 THEN '2001:db8::/48' ELSE '2001:db8:' || (event_id % 3) || '::/48' END AS ip6, left(props, 12) AS props FROM (SELECT *, CAST(event_id * 37 AS BIGINT) AS s, CAST(event_id AS BIGINT) * event_id * 31 AS n FROM events)")
def formatted_events(spark, d):
    x = P.table(spark, d, "events")
    ip = F.concat(F.lit("10."), F.col("user_id") % 256, F.lit("."), F.col("event_id") % 256, F.lit(".7"))
    ip6 = F.when(F.col("event_id") % 3 == 0, "2001:DB8::7").otherwise(F.concat(F.lit("2001:0db8:"), F.col("event_id") % 3, F.lit(":2::5")))
    n = F.col("event_id") * F.col("event_id") * 31
    return x.select("event_id", text.age(F.col("event_id") * 37).alias("age"), text.size(n).alias("size"), text.label(F.col("event_type"), ["view", "click"], {"pur": "sale"}).alias("label"), text.truncated_ip(ip).alias("ip"), text.truncated_ip(ip6).alias("ip6"), text.shortened(F.col("props"), 12).alias("props"))


@query("SELECT k AS series_id, sha256(unhex(lpad(hex(k), 16, '0') || string_agg(printf('%08X', length(ts)) || hex(encode(ts)) || printf('%08X', length(as_of)) || hex(encode(as_of)) || printf('%08X', length(h)) || hex(encode(h)), '' ORDER BY ts, as_of))) AS digest FROM (SELECT user_id % 50 AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ts, lpad(CAST(event_id AS VARCHAR), 9, '0') AS as_of, sha256(props) AS h FROM events) GROUP BY 1")
def batch_digests(spark, d):
    x = P.table(spark, d, "events").select((F.col("user_id") % 50).alias("series_id"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("ts"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("as_of"), F.sha2("props", 256).alias("payload_hash"))
    return x.groupBy("series_id").agg(hashing.batch_digest(F.col("series_id"), F.collect_list(F.struct("ts", "as_of", "payload_hash"))).alias("digest"))


@query("SELECT event_id, (event_id * 7) || '-' || (event_id % 3 + 1) AS next_id FROM events")
def next_message_ids(spark, d):
    x = P.table(spark, d, "events")
    return x.select("event_id", text.next_message_id(F.concat_ws("-", (F.col("event_id") * 7).cast("string"), (F.col("event_id") % 3).cast("string"))).alias("next_id"))


# Dashboards
@query(f"SELECT count(*) FILTER (schema_version <> 1) AS pending, coalesce(date_diff('microsecond', min(produced_at) FILTER (schema_version <> 1), TIMESTAMP '{NOW}') / 1e6, 0) AS oldest_age_s, count(*) FILTER (produced_at > TIMESTAMP '{NOW}' - INTERVAL 15 MINUTE AND produced_at <= TIMESTAMP '{NOW}') AS last_15m, count(*) FILTER (produced_at > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND produced_at <= TIMESTAMP '{NOW}') AS last_24h, count(*) FILTER (produced_at > TIMESTAMP '{NOW}' - INTERVAL 60 MINUTE AND produced_at <= TIMESTAMP '{NOW}') / 60.0 AS per_minute FROM outbox")
def dashboard_overview(spark, d):
    return dashboard.overview(P.outbox(spark, d), F.col("schema_version") == 1, NOW)


@query(f"SELECT c.series_id, series_code, coalesce(last_24h, 0) AS last_24h, last_ts FROM series_catalog c LEFT JOIN (SELECT series_id, count(*) FILTER (as_of > TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND as_of <= TIMESTAMP '{NOW}') AS last_24h, max(ts) AS last_ts FROM observation GROUP BY 1) o USING (series_id)")
def dashboard_series(spark, d):
    return dashboard.series_activity(P.series_catalog(spark, d), P.observation(spark, d), NOW)


@query("SELECT message_id, has_index, CASE WHEN NOT has_index THEN 'MISSING_INDEX' WHEN breaker OR length IS NULL THEN 'UNKNOWN' WHEN length = 0 THEN 'TRIMMED' ELSE 'PRESENT' END AS state FROM (SELECT event_id AS message_id, event_id % 3 <> 0 AS has_index, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 4 END AS length, event_id % 11 = 0 AS breaker FROM events WHERE event_type = 'error')")
def dashboard_dead_letters(spark, d):
    e = P.table(spark, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("message_id"))
    x = dashboard.dead_letters(e, e.where("message_id % 3 <> 0"))
    length = F.when(F.col("message_id") % 5 != 0, F.col("message_id") % 4)
    return x.select("message_id", "has_index", dashboard.dead_letter_state(F.col("has_index"), F.col("message_id"), length, F.col("message_id") % 11 == 0).alias("state"))


@query("SELECT source_id, frequency, count(*) AS n FROM series_catalog GROUP BY 1, 2")
def catalog_counts(spark, d):
    return dashboard.counts(P.series_catalog(spark, d), "source_id", "frequency")


@query("SELECT user_id, time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2")
def rate_limit_windows(spark, d):
    return dashboard.rate_windows(P.table(spark, d, "events"), "user_id", "ts", 60)


@query("SELECT CAST(o_orderkey AS BIGINT) AS run_id, o_orderpriority AS job, o_orderstatus AS status, CASE WHEN o_orderstatus <> 'P' THEN CAST((o_orderkey % 500) * 60 AS DOUBLE) END AS duration_s, CASE WHEN o_custkey % 4 > 0 THEN o_custkey % 4 END AS n_events FROM orders")
def dashboard_ingestion(spark, d):
    o = P.table(spark, d, "orders")
    done = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 500).cast("int")))
    return dashboard.ingestion(o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("job"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("started_at"), done.alias("finished_at"), (F.col("o_custkey") % 4).alias("n_events")))


# Research reads
@query("SELECT series_id, series_code, ts, as_of, value FROM (" + collapsed("observation", "series_id, ts", "as_of DESC, event_id DESC", f"as_of <= TIMESTAMP '{EVENT_PIT}'") + ") JOIN series_catalog USING (series_id)")
def research_observations(spark, d):
    return research.observations(P.observation(spark, d), P.series_catalog(spark, d), research.Read(as_of=EVENT_PIT)).select("series_id", "series_code", "ts", "as_of", "value")


@query("SELECT entity_id, canonical_code, period_end, restatement_basis, value FROM (SELECT *, row_number() OVER (ORDER BY period_end DESC NULLS LAST, canonical_code, restatement_basis, entity_id, period_type, consolidation, currency_code, accounting_standard, cpi_base_date, mapping_version, as_of, row_no) AS n FROM (" + collapsed("canonical_financial", "entity_id, canonical_code, period_end, period_type, consolidation, currency_code, accounting_standard, restatement_basis, cpi_base_date, mapping_version", _BEST, f"as_of <= TIMESTAMP '{PIT}' AND entity_id = 7") + ")) WHERE n <= 50")
def research_canonical(spark, d):
    rows, _ = research.canonical(P.canonical_financial(spark, d), 7, research.Read(as_of=PIT, limit=50))
    return rows.select("entity_id", "canonical_code", "period_end", "restatement_basis", "value")


@query("SELECT entity_id, filing_id, line_code, as_of, value FROM financial_line_item WHERE as_of >= TIMESTAMP '1999-01-01' AND as_of < TIMESTAMP '1999-07-01' AND statement_type = 'bs' AND consolidation = 'solo' AND period_end >= DATE '1999-03-31'")
def research_line_item_versions(spark, d):
    q = research.Read(between=("1999-01-01 00:00:00", "1999-07-01 00:00:00"), equal={"statement_type": "bs", "consolidation": "solo", "filing_id": None}, closed={"period_end": ("1999-03-31", None)})
    return research.read(P.financial_line_item(spark, d), "financial_line_item", q).select("entity_id", "filing_id", "line_code", "as_of", "value")


def _lineage(kind: str, key: str, other: str, where: str) -> str:
    known = collapsed("entity_lineage", "event_kind, from_entity_id, into_entity_id, event_at", "as_of DESC, row_no DESC", f"as_of <= TIMESTAMP '{PIT}'")
    return collapsed(f"(SELECT * EXCLUDE rk FROM (SELECT *, 1 AS rk FROM ({known})) WHERE event_kind = '{kind}' AND {where})", key, "event_at DESC, row_no DESC", "TRUE", f"{key} AS entity_id, {other}")


@query("SELECT entity_id, event_kind, as_of, merged_into, split_from FROM (" + collapsed("entity_version", "entity_id", _BEST, f"as_of <= TIMESTAMP '{PIT}' AND event_kind <> 'deleted'") + f") LEFT JOIN ({_lineage('merged', 'from_entity_id', 'into_entity_id AS merged_into', 'TRUE')}) USING (entity_id) LEFT JOIN ({_lineage('split', 'into_entity_id', 'from_entity_id AS split_from', 'TRUE')}) USING (entity_id)")
def research_entities(spark, d):
    return research.entities_with_lineage(P.entity_version(spark, d), P.entity_lineage(spark, d), PIT).select("entity_id", "event_kind", "as_of", "merged_into", "split_from")


@query("SELECT offer_id, source_id, kind FROM filing JOIN (SELECT DISTINCT source_id, CASE WHEN length(source_id) = 4 THEN 'exchange' ELSE 'regulator' END AS kind FROM filing) USING (source_id) WHERE kind = 'exchange'")
def research_filings(spark, d):
    f = P.filing(spark, d)
    sources = f.select("source_id").distinct().withColumn("kind", F.when(F.length("source_id") == 4, "exchange").otherwise("regulator"))
    return research.filings(f, sources, "exchange").select("offer_id", "source_id", "kind")


@query("SELECT entity_id, period_end, restatement_basis, score FROM (" + collapsed("entity_quality_score", "entity_id, period_end, period_type, consolidation, currency_code, accounting_standard, restatement_basis, cpi_base_date, mapping_version", _BEST, f"as_of <= TIMESTAMP '{PIT}' AND period_end BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'") + ") WHERE restatement_basis = 'as_reported'")
def research_quality(spark, d):
    q = research.Read(as_of=PIT, equal={"restatement_basis": "as_reported"}, closed={"period_end": ("1997-01-01", "1999-12-31")})
    return research.read(P.entity_quality_score(spark, d), "entity_quality_score", q).select("entity_id", "period_end", "restatement_basis", "score")


@query("SELECT filing_id, event_type, event_seq, entity_id, '<REDACTED:counterparty>' AS counterparty FROM (" + collapsed("filing_event", "filing_id, event_type, event_seq", "as_of DESC, row_no DESC", f"as_of <= TIMESTAMP '{PIT}' AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '{PIT}')") + ")")
def research_events(spark, d):
    x = research.events(P.filing_event(spark, d), research.Read(as_of=PIT))
    return x.select("filing_id", "event_type", "event_seq", "entity_id", F.get_json_object("payload", "$.counterparty").alias("counterparty"))


# Streams, as batches
_GATE = "CASE WHEN schema_version > 1 THEN 'too_new' WHEN schema_version < 1 THEN 'too_old' WHEN kind = 'click' THEN 'unknown_kind' WHEN event_id % 7 = 0 THEN 'extra_fields' WHEN event_id % 11 = 0 THEN 'missing_fields' WHEN event_id % 13 = 0 THEN 'bad_value' ELSE 'ok' END"


@query(f"SELECT event_id, {_GATE} AS outcome, CASE WHEN {_GATE} = 'ok' AND kind = 'view' THEN event_id END AS filing FROM (SELECT DISTINCT event_id, kind, schema_version FROM outbox)")
def stream_gate(spark, d):
    from chronofold.streaming import events

    x = P.outbox(spark, d).dropDuplicates(["event_id"])
    own = {k: [F.lit("x").alias(f) for f in fields] for k, fields in events.KINDS.items()}
    uid = F.format_string("00000000-0000-0000-0000-%012d", F.col("event_id"))
    wrong = lambda n: F.col("event_id") % n == 0
    base = [
        "schema_version", F.when(wrong(13), "no id").otherwise(uid).alias("event_id"), F.date_format("produced_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("produced_at"), F.lit(1).alias("producer_run_id"),
        F.when(~wrong(11), "s").alias("source_id"), F.when(wrong(2), "system").alias("actor_kind"), F.when(wrong(7), "x").alias("more"),
    ]
    message = F.when(F.col("kind") == "view", F.to_json(F.struct(*base, F.lit("filing.new").alias("kind"), F.col("event_id").cast("string").alias("filing_id"), *own["filing.new"][1:])))
    message = message.when(F.col("kind") == "click", F.to_json(F.struct(*base, "kind"))).otherwise(F.to_json(F.struct(*base, F.lit("entity.created").alias("kind"), *own["entity.created"])))
    out = events.parse(x.select(F.col("event_id").alias("message_id"), message.alias("payload")))
    filing = F.when(F.col("error").isNull() & (F.col("kind") == "filing.new"), F.col("fields")["filing_id"].cast("long"))
    return out.select(F.col("message_id").alias("event_id"), F.coalesce("error", F.lit("ok")).alias("outcome"), filing.alias("filing"))


@query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '{\"redacted\":true}' ELSE props END AS payload, event_id % 50 = 0 AS is_redacted FROM events")
def stream_redaction(spark, d):
    from chronofold.streaming import events

    e = P.table(spark, d, "events").select("event_id", F.col("props").alias("payload"))
    put = F.lit('{"redacted":true}')
    return events.redacted(e, e.where("event_id % 50 = 0").select("event_id", put.alias("replacement"), F.sha2(put, 256).alias("sha256")))


@query(f"SELECT kind, round(avg(date_diff('microsecond', produced_at, TIMESTAMP '2024-02-01 00:00:00') / 1e6), 3) AS mean_lag_s, round(max(date_diff('microsecond', produced_at, TIMESTAMP '2024-02-01 00:00:00') / 1e6), 3) AS max_lag_s FROM outbox GROUP BY 1")
def stream_lag(spark, d):
    from chronofold.streaming import events

    return events.lag(P.outbox(spark, d), "2024-02-01 00:00:00").select("kind", F.round("mean_lag_s", 3).alias("mean_lag_s"), F.round("max_lag_s", 3).alias("max_lag_s"))


@query("SELECT event_id AS message_id, 'log_without_copy' AS problem FROM events WHERE event_id % 3 <> 0 AND event_id % 2 = 0 UNION ALL SELECT event_id, 'copy_without_log' FROM events WHERE event_id % 3 = 0 AND event_id % 2 <> 0 UNION ALL SELECT event_id, 'copy_trimmed' FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 0")
def stream_reconciliation(spark, d):
    from chronofold.streaming import events

    e = P.table(spark, d, "events").select(F.col("event_id").alias("message_id"))
    return events.reconcile(e.where("message_id % 2 = 0"), e.where("message_id % 3 = 0"), e.where("message_id % 5 = 0"))


@query("SELECT kind, count(*) AS pending, min(produced_at) AS oldest FROM outbox WHERE event_id % 4 <> 0 GROUP BY 1")
def stream_pending(spark, d):
    from chronofold.streaming import events

    x = P.outbox(spark, d)
    return events.pending(x, x.where("event_id % 4 = 0").select("event_id").distinct())


@query("SELECT message_id FROM (SELECT (event_id // 3) || '-' || (event_id % 3) AS message_id, event_id FROM events) WHERE event_id > 301 AND event_id <= 900 ORDER BY event_id LIMIT 100")
def stream_page(spark, d):
    from chronofold.streaming import events

    x = P.table(spark, d, "events").select(F.concat_ws("-", F.floor(F.col("event_id") / 3).cast("string"), (F.col("event_id") % 3).cast("string")).alias("message_id"))
    return events.between_ids(x, "100-1", "300-0", 100)


@query("SELECT DISTINCT event_id, 'events.' || kind AS stream, CAST(copy AS VARCHAR) AS message_id FROM outbox")
def stream_copy_index(spark, d):
    from chronofold.streaming import events

    return events.copy_index(P.outbox(spark, d).select("event_id", F.concat(F.lit("events."), "kind").alias("stream"), F.col("copy").cast("string").alias("message_id")))


# Catalog, audit, documents
@query("SELECT series_id, series_code, frequency FROM series_catalog WHERE source_id = 'bist' ORDER BY series_code LIMIT 30")
def series_listing(spark, d):
    return series.listing(P.series_catalog(spark, d), limit=30, source_id="bist", frequency=None).select("series_id", "series_code", "frequency")


@query("SELECT series_id, series_code, coalesce(n, 0) AS n_subjects, first_subject FROM series_catalog LEFT JOIN (SELECT user_id AS series_id, count(*) AS n, min(event_type) AS first_subject FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 90) GROUP BY 1) USING (series_id)")
def series_with_subjects(spark, d):
    subjects = P.table(spark, d, "events").where("value > 90").select(F.col("user_id").alias("series_id"), F.col("event_type").alias("subject_id"), F.lit("owner").alias("role")).distinct()
    x = series.with_subjects(P.series_catalog(spark, d), subjects)
    return x.select("series_id", "series_code", F.size("subjects").cast("long").alias("n_subjects"), F.get("subjects", F.lit(0))["subject_id"].alias("first_subject"))


@query("SELECT event_id, ts AS occurred_at, CASE WHEN event_id % 3 = 0 THEN '<no client_ip>' ELSE '10.0.' || (user_id % 256) || '.0/24' END AS client_net, len(json_keys(props)) AS n_keys FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def audit_recent(spark, d):
    e = P.table(spark, d, "events")
    ip = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("10.0."), F.col("user_id") % 256, F.lit(".9")))
    return audit.recent(e.select("event_id", F.col("ts").alias("occurred_at"), ip.alias("client_ip"), F.col("props").alias("metadata"))).withColumn("n_keys", F.col("n_keys").cast("long"))


@query("SELECT offer_id, source_id, offer_id % 4 AS copies, CASE WHEN offer_id % 4 = 0 THEN 0 ELSE (offer_id % 4 + 1) // 2 END AS redacted FROM filing")
def documents_with_copies(spark, d):
    f = P.filing(spark, d)
    copies = f.where("offer_id % 4 > 0").select("offer_id", F.explode(F.sequence(F.lit(1), F.col("offer_id") % 4)).alias("i")).select("offer_id", F.when(F.col("i") % 2 == 1, F.lit("x")).alias("redacted_at"))
    return dashboard.documents_with_copies(f, copies)


@query("SELECT source_ref AS filing_id, sha256, min(offer_id) AS seq FROM filing WHERE offer_id % 5 <> 0 OR TRUE GROUP BY 1, 2 HAVING (source_ref, sha256) NOT IN (SELECT (source_ref, sha256) FROM filing WHERE offer_id % 5 = 0)")
def new_attachments(spark, d):
    f = P.filing(spark, d).select(F.col("source_ref").alias("filing_id"), "sha256", F.col("offer_id").alias("seq"), F.col("source_id").alias("filename"))
    return documents.attach(f.where("seq % 5 = 0"), f).select("filing_id", "sha256", "seq")


@query("SELECT count(*) AS n, count(*) FILTER (rule = 'one_value') AS one_value, count(*) FILTER (rule = 'quality_flag') AS quality_flag FROM (SELECT CASE WHEN (event_id % 5 = 0) = (event_id % 7 <> 0) THEN 'one_value' WHEN event_id % 9 = 0 THEN 'quality_flag' END AS rule FROM events) WHERE rule IS NOT NULL")
def ingest_violations(spark, d):
    x = P.observation(spark, d).select("series_id", "ts", "as_of", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("value"), F.when(F.col("event_id") % 7 == 0, F.lit("x")).alias("value_text"), F.when(F.col("event_id") % 9 == 0, -1).otherwise(0).alias("quality_flag"))
    return ingest.violations(x).agg(F.count("*").alias("n"), F.count_if(F.col("rule") == "one_value").alias("one_value"), F.count_if(F.col("rule") == "quality_flag").alias("quality_flag"))


# Readers' pages
_OVERVIEW = "SELECT e.entity_id, legal_name, ticker, last_period, n_lines, avg_score FROM entity e LEFT JOIN (SELECT DISTINCT entity_id, value AS ticker FROM identifier WHERE namespace = 'ticker') t USING (entity_id) JOIN (SELECT entity_id, max(period_end) AS last_period, count(*) AS n_lines FROM canonical_financial GROUP BY 1) c USING (entity_id) LEFT JOIN (SELECT entity_id, CAST(round(avg(score)) AS INT) AS avg_score FROM entity_quality_score GROUP BY 1) s USING (entity_id)"


@query(f"SELECT * FROM ({_OVERVIEW}) WHERE legal_name ILIKE '%00%' ORDER BY legal_name, entity_id, ticker NULLS LAST LIMIT 20 OFFSET 5")
def entity_list_page(spark, d):
    x = analytics.entity_overview(P.entity(spark, d), P.identifier(spark, d), P.canonical_financial(spark, d), P.entity_quality_score(spark, d))
    return analytics.entity_page(x, 20, 5, "00")


_ENTITY_SIDE = "(SELECT * FROM ({0}) WHERE entity_id = 57)"


@query(f"SELECT entity_id, period_end, period_type, r.value AS reported, n.value AS normalized, CASE WHEN n.cpi_base_date <> DATE '9999-01-01' THEN n.cpi_base_date END AS cpi_base_date FROM {_ENTITY_SIDE.format(_side('as_reported'))} r FULL JOIN {_ENTITY_SIDE.format(_side('cpi_normalized'))} n USING (entity_id, period_end, period_type) ORDER BY period_end DESC LIMIT 40")
def metric_points_both(spark, d):
    return analytics.metric_points(P.canonical_financial(spark, d), 57, "is.1")


@query(f"SELECT entity_id, period_end, period_type, value AS reported, CAST(NULL AS DOUBLE) AS normalized FROM {_ENTITY_SIDE.format(_side('as_reported'))} ORDER BY period_end LIMIT 3")
def metric_points_single(spark, d):
    return analytics.metric_points(P.canonical_financial(spark, d), 57, "is.1", "as_reported", limit=3)


@query("SELECT day, value, event_id FROM (SELECT CAST(ts AS DATE) AS day, value, event_id FROM observation WHERE series_id = 7 AND CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' ORDER BY ts DESC, as_of DESC, event_id DESC LIMIT 500) WHERE value IS NOT NULL")
def series_points_by_code(spark, d):
    return analytics.series_by_code(P.observation(spark, d), P.series_catalog(spark, d), "S7", "2024-01-03", "2024-01-25")


@query("SELECT entity_id, CAST(ts AS DATE) AS day, " + ", ".join(f"min_by(coalesce(value, 0), ts) FILTER (metric = '{m}') AS {m}" for m in ("price_open", "price_high", "price_low", "price_close", "volume")) + " FROM (SELECT * FROM price WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 137) GROUP BY ALL")
def prices_ohlcv_limited(spark, d):
    return analytics.ohlcv(P.price(spark, d), "2024-01-05", "2024-01-25", 137)


# Research reads, continued
@query("SELECT disclosure_id, entity_id, form_type, provenance = 'pre_bitemporal_unknown' AS pre_bitemporal, as_of, published_at FROM (" + collapsed("disclosures_version", "disclosure_id", "as_of DESC NULLS LAST, row_no DESC", f"(as_of <= TIMESTAMP '{PIT}' OR provenance = 'pre_bitemporal_unknown') AND event_kind <> 'deleted'") + ") WHERE published_at >= TIMESTAMP '1996-01-01' AND published_at <= TIMESTAMP '1999-12-31' AND form_type = '1-URGENT'")
def research_disclosures(spark, d):
    q = research.Read(as_of=PIT, equal={"form_type": "1-URGENT", "entity_id": None})
    x = research.disclosures(P.disclosures_version(spark, d), q, published_from="1996-01-01 00:00:00", published_after="1990-01-01 00:00:00", published_before="1999-12-31 00:00:00", keep_unknown=True)
    return x.select("disclosure_id", "entity_id", "form_type", "pre_bitemporal", "as_of", "published_at")


@query("SELECT disclosure_id, event_kind, as_of FROM disclosures_version WHERE as_of >= TIMESTAMP '1999-01-01' AND as_of < TIMESTAMP '1999-07-01' AND published_at >= TIMESTAMP '1999-02-01'")
def research_disclosure_versions(spark, d):
    q = research.Read(between=("1999-01-01 00:00:00", "1999-07-01 00:00:00"))
    return research.disclosures(P.disclosures_version(spark, d), q, published_after="1999-02-01 00:00:00", keep_unknown=True).select("disclosure_id", "event_kind", "as_of")


@query("SELECT entity_id, row_no, event_kind, coalesce(n, 0) AS n_events, last_event FROM (SELECT * FROM entity_version WHERE as_of >= TIMESTAMP '1998-01-01' AND as_of < TIMESTAMP '1998-04-01') v LEFT JOIN (SELECT entity_id, row_no, count(*) AS n, max(event_at) AS last_event FROM (SELECT DISTINCT v.entity_id, v.row_no, l.event_kind, l.from_entity_id, l.into_entity_id, l.event_at FROM entity_version v JOIN entity_lineage l ON (l.from_entity_id = v.entity_id OR l.into_entity_id = v.entity_id) AND l.as_of <= v.as_of) GROUP BY 1, 2) USING (entity_id, row_no)")
def research_entity_versions(spark, d):
    x = research.entity_versions_with_lineage(P.entity_version(spark, d), P.entity_lineage(spark, d), ("1998-01-01 00:00:00", "1998-04-01 00:00:00"))
    return x.select("entity_id", "row_no", "event_kind", F.size("lineage_events").cast("long").alias("n_events"), F.array_max("lineage_events.event_at").alias("last_event"))


@query("SELECT entity_id, legal_name AS canonical_name, entity_type AS kind, status FROM entity")
def research_entity_surface(spark, d):
    return research.renamed(P.entity(spark, d), "entity").select("entity_id", "canonical_name", "kind", "status")


@query("SELECT offer_id, source_id, kind, published_at FROM (SELECT *, CASE WHEN length(source_id) = 4 THEN 'exchange' ELSE 'regulator' END AS kind, CAST(DATE '2024-01-01' + CAST(offer_id % 90 AS INT) AS TIMESTAMP) AS published_at FROM filing) WHERE kind = 'regulator' AND published_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-02-10'")
def research_filings_between(spark, d):
    f = _published(spark, d)
    sources = f.select("source_id").distinct().withColumn("kind", F.when(F.length("source_id") == 4, "exchange").otherwise("regulator"))
    return research.filings(f, sources, "regulator", "2024-01-10 00:00:00", "2024-02-10 00:00:00").select("offer_id", "source_id", "kind", "published_at")


def _published(spark: SparkSession, d: str) -> DataFrame:
    return P.filing(spark, d).withColumn("published_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("offer_id") % 90).cast("int")).cast("timestamp_ntz"))


@query("SELECT entity_id, identifier_id, CASE WHEN count(*) OVER () > 1 THEN 'ambiguous' ELSE 'found' END AS state FROM identifier WHERE namespace = 'ticker' AND value = 'T7' AND valid_from <= DATE '1997-06-15' AND valid_to > DATE '1997-06-15'")
def research_identifier(spark, d):
    return research.identifiers_at(P.identifier(spark, d), "ticker", "T7", "1997-06-15")


# History of disclosures
@query("SELECT id AS disclosure_id, CASE WHEN o.id IS NULL THEN 'created' WHEN n.id IS NULL THEN 'deleted' WHEN NOT o.has_body AND n.has_body THEN 'body_fetched' WHEN o.parent_id IS DISTINCT FROM n.parent_id THEN 'republished' ELSE 'updated' END AS event_kind FROM (SELECT o_orderkey AS id, o_orderpriority AS title, o_orderkey % 4 = 0 AS has_body, CAST(NULL AS BIGINT) AS parent_id FROM orders WHERE o_orderkey % 5 <> 0) o FULL JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'new' ELSE o_orderpriority END AS title, o_orderkey % 2 = 0 AS has_body, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS BIGINT) END AS parent_id FROM orders WHERE o_orderkey % 9 <> 0) n USING (id) WHERE o.id IS NULL OR n.id IS NULL OR (NOT o.has_body AND n.has_body) OR o.parent_id IS DISTINCT FROM n.parent_id OR o.title <> n.title")
def capture_disclosure_changes(spark, d):
    o, key = P.table(spark, d, "orders"), F.col("o_orderkey")
    old = o.where(key % 5 != 0).select(key.alias("disclosure_id"), F.col("o_orderpriority").alias("title"), (key % 4 == 0).alias("has_body"), F.lit(None).cast("long").alias("parent_id"))
    new = o.where(key % 9 != 0).select(key.alias("disclosure_id"), F.when(key % 7 == 0, "new").otherwise(F.col("o_orderpriority")).alias("title"), (key % 2 == 0).alias("has_body"), F.when(key % 3 == 0, F.col("o_custkey").cast("long")).alias("parent_id"))
    return temporal.capture(old, new, "disclosure_id", temporal.disclosure_kind(), NOW).select("disclosure_id", "event_kind")


@query("SELECT id AS disclosure_id, 'indexed' AS event_kind, indexed_at AS as_of, CASE WHEN indexed_at IS NULL THEN 'pre_bitemporal_unknown' ELSE 'index_fetched_at' END AS provenance, CAST(NULL AS TIMESTAMP) AS body_fetched_at FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 <> 0 THEN o_orderdate END AS indexed_at FROM orders) UNION ALL SELECT o_orderkey, 'body_fetched', o_orderdate + INTERVAL 2 DAY, 'body_fetched_at', o_orderdate + INTERVAL 2 DAY FROM orders WHERE o_orderkey % 4 = 0")
def backfill_disclosure_history(spark, d):
    key = F.col("o_orderkey")
    x = P.table(spark, d, "orders").select(key.alias("disclosure_id"), F.when(key % 6 != 0, F.col("o_orderdate")).alias("index_fetched_at"), (key % 2 == 0).alias("body_fetched"), F.when(key % 4 == 0, F.col("o_orderdate") + F.make_dt_interval(F.lit(2))).alias("body_fetched_at"))
    return temporal.backfill_disclosures(x).select("disclosure_id", "event_kind", "as_of", "provenance", "body_fetched_at")


# Canonical lines
_MANIFEST = [
    mapping.Line("is.revenue", "is", "pick_first", ("is.1", "is.2", "is.3")),
    mapping.Line("is.costs", "is", "sum_components", ("is.4", "is.5", "is.6")),
    mapping.Line("bs.assets", "bs", "pick_first", ("bs.1", "bs.2", "bs.3", "bs.4")),
    mapping.Line("bs.cash", "bs", "pick_first", ("bs.5", "bs.6")),
    mapping.Line("bs.other", "bs", "residual", parent="bs.assets", components=("bs.cash",)),
    mapping.Line("is.profit", "is", formula="is.revenue - is.costs"),
    mapping.Line("is.double", "is", formula="is.profit + is.profit"),
]
_SRC = "(SELECT entity_id, period_end, line_code, min(value) AS v FROM financial_line_item GROUP BY 1, 2, 3)"
_PICKED = "SELECT entity_id, period_end, " + ", ".join(f"coalesce({', '.join(f'max(v) FILTER (line_code = {chr(39)}{s}{chr(39)})' for s in x.sources)}) AS {x.code.split('.')[1]}" for x in _MANIFEST if x.mode == "pick_first") + f", sum(v) FILTER (line_code IN ('is.4', 'is.5', 'is.6')) AS costs FROM {_SRC} GROUP BY 1, 2"


@query(f"SELECT entity_id, period_end, canonical_code, round(value, 4) AS value FROM (SELECT entity_id, period_end, unnest(['is.revenue', 'is.costs', 'bs.assets', 'bs.cash', 'bs.other', 'is.profit', 'is.double']) AS canonical_code, unnest([revenue, costs, assets, cash, assets - coalesce(cash, 0), revenue - costs, 2 * (revenue - costs)]) AS value FROM ({_PICKED})) WHERE value IS NOT NULL")
def canonical_values(spark, d):
    x = mapping.canonical_values(P.financial_line_item(spark, d), _MANIFEST, ["entity_id", "period_end"])
    return x.select("entity_id", "period_end", "canonical_code", F.round("value", 4).alias("value"))


@query("SELECT DISTINCT line_code AS code, statement_type FROM financial_line_item WHERE statement_type = 'is'")
def canonical_lines(spark, d):
    x = P.financial_line_item(spark, d).select(F.col("line_code").alias("code"), "statement_type").distinct()
    return mapping.of_statement(x, "is")


# Roles, audit of batches, extracted texts
@query("SELECT event_id, schema_version, produced_at AS published_at FROM outbox")
def outbox_for_role(spark, d):
    return roles.visible(P.outbox(spark, d).withColumnRenamed("produced_at", "published_at"), "outbox")


@query(f"SELECT 'b1' AS batch_id, series_id, ts, as_of, payload_hash, CASE WHEN event_id % 3 = 0 THEN 'inserted' WHEN event_id % 7 = 0 THEN 'conflict' ELSE 'unchanged' END AS action FROM ({_BATCH})")
def ingest_audit_keys(spark, d):
    batch, stored = _batch(spark, d)
    return ingest.batch_keys(ingest.compare(batch, stored, ("series_id", "ts", "as_of")), "b1")


@query("SELECT count(*) AS batch_size, count(*) FILTER (event_id % 3 = 0) AS inserted, count(*) FILTER (event_id % 3 <> 0 AND event_id % 7 <> 0) AS unchanged, min(ts) AS min_ts, max(ts) AS max_ts, min(as_of) AS min_as_of, max(as_of) AS max_as_of, count(*) + count(*) FILTER (event_id % 10 = 0) AS attempted, count(*) FILTER (event_id % 10 = 0) AS duplicates FROM observation")
def ingest_batch_stats(spark, d):
    batch, stored = _batch(spark, d)
    return ingest.batch_stats(batch, ingest.compare(batch, stored, ("series_id", "ts", "as_of")))


@query("SELECT offer_id AS filing_id, CASE WHEN offer_id % 3 = 0 THEN 'filing_body.update' ELSE 'filing_body.create' END AS operation, 'tr' AS body_lang, length(sha256) * CASE WHEN offer_id % 4 = 0 THEN 2 ELSE 1 END AS body_size_chars FROM filing WHERE offer_id % 2 = 0")
def extracted_text_audit(spark, d):
    f = P.filing(spark, d).select(F.col("offer_id").alias("filing_id"), F.col("sha256").alias("body_text"), F.lit("tr").alias("body_lang"), F.lit("2024-01-01").cast("timestamp_ntz").alias("extracted_at"))
    later = f.where("filing_id % 4 = 0").withColumns({"body_text": F.concat("body_text", "body_text"), "extracted_at": F.lit("2024-01-02").cast("timestamp_ntz")})
    _, audited = documents.attach_text(f.where("filing_id % 3 = 0"), f.where("filing_id % 2 = 0").unionByName(later))
    return audited.withColumn("body_size_chars", F.col("body_size_chars").cast("long"))


@query("SELECT offer_id, source_id, source_ref FROM (SELECT *, CAST(DATE '2024-01-01' + CAST(offer_id % 90 AS INT) AS TIMESTAMP) AS published_at FROM filing) WHERE published_at >= TIMESTAMP '2024-01-20' ORDER BY published_at DESC, offer_id LIMIT 40")
def filing_listing(spark, d):
    return documents.listing(_published(spark, d), 40, since="2024-01-20", kind=None).select("offer_id", "source_id", "source_ref")


# Quality, continued
@query("SELECT namespace, value, CAST(count(*) AS BIGINT) AS n FROM (" + _INVARIANTS["identifier_overlap"].replace("SELECT 1", "SELECT a.namespace, a.value") + ") GROUP BY 1, 2")
def identifier_overlap_counts(spark, d):
    return entities.overlap_counts(P.identifier(spark, d))


@query("SELECT 'loose' AS name, 'unregistered' AS gap UNION ALL SELECT name, 'no_guard' FROM (VALUES ('filing_event')) t(name) UNION ALL SELECT 'entity_lineage', 'no_as_of'")
def registry_gaps(spark, d):
    names = sorted(REGISTRY)
    tables = [(n, n != "entity_lineage", n != "filing_event") for n in names] + [("loose", True, True), ("plain", False, False)]
    return quality.registry_gaps(spark.createDataFrame(tables, "name string, has_as_of boolean, guarded boolean"), spark.createDataFrame([(n,) for n in names], "name string"))


# Dead letters
_LETTERS = "SELECT event_id, 'events.' || event_type AS stream, 'f' || lpad(CAST(event_id AS VARCHAR), 9, '0') AS failure_id FROM events WHERE event_id % 6 = 0"


def _letters(spark: SparkSession, d: str) -> DataFrame:
    return P.table(spark, d, "events").where("event_id % 6 = 0").select("event_id", F.concat(F.lit("events."), "event_type").alias("stream"), F.concat(F.lit("f"), F.lpad(F.col("event_id").cast("string"), 9, "0")).alias("failure_id"))


@query(f"SELECT failure_id, stream, event_id AS message_id FROM ({_LETTERS}) WHERE event_id % 4 = 0 ORDER BY failure_id LIMIT 1000")
def indexed_letters(spark, d):
    from chronofold.streaming import events

    log = _letters(spark, d)
    return events.indexed_letters(log.where("event_id % 4 = 0").select("failure_id", F.col("event_id").alias("message_id")), log)


@query(f"SELECT DISTINCT stream FROM ({_LETTERS})")
def streams_with_letters(spark, d):
    from chronofold.streaming import events

    return events.streams_with_letters(_letters(spark, d))


@query("SELECT event_id, 'streams.redaction:' || event_id AS lock, 'streams:redaction_registry:' || event_id AS cache FROM events WHERE event_id % 50 = 0")
def redaction_keys(spark, d):
    x = P.table(spark, d, "events").where("event_id % 50 = 0")
    return x.select("event_id", text.redaction_keys(F.col("event_id").cast("string")).alias("k")).select("event_id", "k.lock", "k.cache")
