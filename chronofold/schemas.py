"""The registry of append-only fact tables; it drives every point-in-time read.

A table is a natural key, a knowledge-time column and, where needed, a filter that holds before
versions collapse and columns that make the order of versions total.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Fact:
    name: str
    key: tuple[str, ...]
    as_of: str = "as_of"
    live: str | None = None
    ties: tuple[str, ...] = ()
    order: tuple[str, ...] = ()

    def natural_key(self) -> tuple[str, ...]:
        return (*self.key, self.as_of)


_CANONICAL = ("entity_id", "canonical_code", "period_end", "period_type", "consolidation", "currency_code", "accounting_standard", "restatement_basis", "cpi_base_date", "mapping_version")

#: Natural keys of the domain; ``live`` may name the point in time as :p.
REGISTRY: dict[str, Fact] = {
    f.name: f
    for f in (
        Fact("observation", ("series_id", "ts"), ties=("event_id",), order=("series_id", "-ts")),
        Fact("financial_line_item", ("entity_id", "filing_id", "statement_type", "line_code", "consolidation", "period_end"), ties=("row_no",)),
        Fact("canonical_financial", _CANONICAL, ties=("row_no",), order=("-period_end", "canonical_code", "restatement_basis")),
        Fact("entity_quality_score", tuple(c for c in _CANONICAL if c != "canonical_code"), ties=("row_no",), order=("-period_end",)),
        Fact("filing_event", ("filing_id", "event_type", "event_seq"), live="superseded_at IS NULL OR superseded_at > :p", ties=("row_no",), order=("-event_ts", "event_seq")),
        Fact("entity_version", ("entity_id",), live="event_kind <> 'deleted'", ties=("row_no",)),
        Fact("entity_lineage", ("event_kind", "from_entity_id", "into_entity_id", "event_at"), ties=("row_no",)),
        Fact("disclosures_version", ("disclosure_id",), live="event_kind <> 'deleted'", ties=("row_no",)),
    )
}
