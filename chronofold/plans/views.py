"""The projections of ``sources.projections`` in SQL, as common table expressions for the oracle."""

from __future__ import annotations

import re

_QUARTER = "CAST(date_trunc('quarter', {0}) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)"
_NULL_SAFE = "9999-12-31"

VIEWS: dict[str, str] = {
    "observation": "SELECT user_id AS series_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, ts AS as_of, value, event_id FROM events",
    "series_catalog": "SELECT series_id, 'S' || series_id AS series_code, CASE series_id % 3 WHEN 0 THEN 'bist' WHEN 1 THEN 'tefas' ELSE 'evds' END AS source_id, CASE WHEN series_id % 2 = 0 THEN 'daily' ELSE 'monthly' END AS frequency FROM (SELECT DISTINCT user_id AS series_id FROM events)",
    "price": "SELECT user_id % 20 AS entity_id, CASE event_type WHEN 'click' THEN 'price_open' WHEN 'error' THEN 'price_high' WHEN 'purchase' THEN 'price_low' WHEN 'signup' THEN 'price_close' WHEN 'view' THEN 'volume' END AS metric, ts, CASE WHEN event_id % 17 <> 0 THEN value END AS value, event_id FROM events",
    "fin_lines": "SELECT l.*, o_custkey, CASE l_returnflag WHEN 'A' THEN 'bs' WHEN 'N' THEN 'is' ELSE 'cf' END AS statement_type, concat_ws('/', l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT), CAST(round(l_tax * 100) AS BIGINT), CAST(l_quantity AS BIGINT)) AS row_no, " + _QUARTER.format("l_shipdate") + " AS period_end FROM lineitem l JOIN orders ON l_orderkey = o_orderkey",
    "financial_line_item": "SELECT o_custkey AS entity_id, l_orderkey AS filing_id, statement_type, statement_type || '.' || (l_partkey % 20) AS line_code, CASE WHEN l_linestatus = 'O' THEN 'consolidated' ELSE 'solo' END AS consolidation, period_end, l_shipdate AS as_of, l_extendedprice AS value, row_no FROM fin_lines",
    "canonical_financial": "SELECT o_custkey AS entity_id, statement_type || '.' || (l_partkey % 5) AS canonical_code, period_end, 'q' AS period_type, 'consolidated' AS consolidation, CASE WHEN l_suppkey % 4 = 0 THEN 'USD' ELSE 'TRY' END AS currency_code, 'ifrs' AS accounting_standard, CASE WHEN l_linestatus = 'F' THEN 'cpi_normalized' ELSE 'as_reported' END AS restatement_basis, CASE WHEN l_linestatus = 'F' THEN DATE '2022-12-31' ELSE DATE '9999-01-01' END AS cpi_base_date, CAST(1000 + l_linenumber AS INT) AS mapping_version, l_extendedprice AS value, l_shipdate AS as_of, row_no FROM fin_lines",
    "entity_quality_score": "SELECT o_custkey AS entity_id, " + _QUARTER.format("o_orderdate") + " AS period_end, 'q' AS period_type, 'consolidated' AS consolidation, 'TRY' AS currency_code, 'ifrs' AS accounting_standard, CASE WHEN o_orderkey % 2 = 0 THEN 'as_reported' ELSE 'cpi_normalized' END AS restatement_basis, DATE '9999-01-01' AS cpi_base_date, CAST(1000 + o_orderkey % 3 AS INT) AS mapping_version, CAST(floor(o_totalprice % 101) AS INT) AS score, CASE o_orderstatus WHEN 'F' THEN 'pass' WHEN 'O' THEN 'warn' ELSE 'fail' END AS state, CAST(round(o_totalprice / 1000) AS INT) AS delta, o_orderdate AS as_of, o_orderkey AS row_no FROM orders",
    "entity": "SELECT c_custkey AS entity_id, c_name AS legal_name, lower(c_mktsegment) AS entity_type, CASE WHEN c_custkey % 11 = 0 THEN 'merged' WHEN c_custkey % 7 = 0 THEN 'inactive' ELSE 'active' END AS status, CAST(DATE '1990-01-01' + CAST(c_custkey % 1000 AS INT) AS TIMESTAMP) AS created_at, CAST(DATE '1990-01-01' + CAST(c_custkey % 1000 + c_custkey % 3 AS INT) AS TIMESTAMP) AS updated_at FROM customer",
    "entity_version": "SELECT o_custkey AS entity_id, 'Entity ' || o_orderpriority AS legal_name, CASE o_orderstatus WHEN 'F' THEN 'updated' WHEN 'O' THEN 'renamed' ELSE 'deleted' END AS event_kind, o_orderdate AS as_of, o_orderkey AS row_no FROM orders",
    "identifier": "SELECT o_orderkey AS identifier_id, o_custkey AS entity_id, CASE WHEN o_orderkey % 5 = 0 THEN 'isin' ELSE 'ticker' END AS namespace, 'T' || (o_custkey % 400) AS value, CAST(o_orderdate AS DATE) AS valid_from, coalesce(lead(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), DATE '9999-12-31') AS valid_to, o_orderkey % 2 = 0 AS is_primary FROM orders",
    "entity_lineage": "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'merged' ELSE 'split' END AS event_kind, o_custkey AS from_entity_id, o_custkey * 7 % 1000 AS into_entity_id, CAST(date_trunc('year', o_orderdate) AS DATE) AS event_at, o_orderdate AS as_of, o_orderkey AS row_no FROM orders WHERE o_orderkey % 3 = 0",
    "disclosures_version": "SELECT o_custkey || '-' || substr(o_orderpriority, 1, 1) AS disclosure_id, o_custkey AS entity_id, o_orderpriority AS form_type, CASE o_orderstatus WHEN 'P' THEN 'deleted' WHEN 'F' THEN 'indexed' ELSE 'republished' END AS event_kind, CASE WHEN o_orderkey % 13 = 0 THEN 'pre_bitemporal_unknown' ELSE 'observed' END AS provenance, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate END AS as_of, o_orderdate AS published_at, o_orderkey AS row_no FROM orders",
    "filing_event": "SELECT l_orderkey AS filing_id, l_returnflag AS event_type, CAST(l_linenumber AS INT) AS event_seq, o_custkey AS entity_id, l_shipdate AS event_ts, l_shipdate AS as_of, CASE WHEN l_partkey % 2 = 0 THEN lead(l_shipdate) OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate, row_no) END AS superseded_at, l_suppkey, l_partkey, row_no FROM fin_lines",
    "filing": "SELECT doc_id AS offer_id, source AS source_id, 'ref' || (doc_id % 600) AS source_ref, sha256(text) AS sha256, length(text) AS n_chars FROM documents",
    "outbox": "SELECT event_id, event_type AS kind, ts AS produced_at, CASE WHEN event_id % 29 = 0 THEN 3 WHEN event_id % 31 = 0 THEN 0 ELSE 1 END AS schema_version, user_id, value, props, unnest(CASE WHEN event_id % 10 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM events",
}


def sql(body: str) -> str:
    """``body`` with the expressions it names, and those they name, before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(VIEWS[name])
                needed.append(name)

    need(body)
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in needed) + " " if needed else "") + body


def collapsed(table: str, key: str, order: str, where: str = "TRUE", columns: str = "*") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rk FROM {table} WHERE {where}) WHERE rk = 1"
