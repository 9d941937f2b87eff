"""The research reads: filters, a point in time or an interval, the reading order and a page.

Filters on key columns are applied with the rest of the scan's; every other filter holds after the collapse,
since before it a version that fails would let an older one through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators import temporal
from chronofold.operators.temporal import PAGE, first_per_key, moment
from chronofold.schemas import REGISTRY
from chronofold.sources.files import after, beyond, decode_cursor, encode_cursor


@dataclass(frozen=True)
class Read:
    """``as_of`` or ``between`` (lo, hi), not both; neither is now. ``equal`` and ``closed`` (column: (from, to), both ends in) filter."""

    as_of: str | None = None
    between: tuple[str, str] | None = None
    equal: dict[str, object] = field(default_factory=dict)
    closed: dict[str, tuple] = field(default_factory=dict)
    limit: int | None = None

    def __post_init__(self):
        if self.as_of and self.between:
            raise ValueError("as_of and an interval exclude each other")


def _conditions(read: Read, df: DataFrame) -> list[tuple[str, Column]]:
    out = [(c, F.col(c) == F.lit(v)) for c, v in read.equal.items() if v is not None]
    types = dict(df.dtypes)
    for c, (lo, hi) in read.closed.items():
        out += [(c, F.col(c) >= F.lit(lo).cast(types[c]))] if lo is not None else []
        out += [(c, F.col(c) <= F.lit(hi).cast(types[c]))] if hi is not None else []
    return out


def read(df: DataFrame, name: str, query: Read, **options) -> DataFrame:
    """Rows of a fact table as the query asks for them."""
    fact = REGISTRY[name]
    conditions = _conditions(query, df)
    for c, condition in conditions:
        if c in fact.key:
            df = df.where(condition)
    out = temporal.interval(df, fact, *query.between) if query.between else temporal.pit(df, fact, query.as_of, **options)
    for c, condition in conditions:
        if c not in fact.key:
            out = out.where(condition)
    if query.limit is None:
        return out
    return out.orderBy(*temporal.chain_order(fact)).limit(query.limit) if query.between else temporal.page(out, fact, query.limit)


def _places(name: str, query: Read) -> list[str]:
    """The total order that a read is paged in, a leading - for descending: versions by key and knowledge time, a collapsed read in its reading order first."""
    fact = REGISTRY[name]
    rest = (*fact.key, fact.as_of, *fact.ties)
    first = () if query.between else fact.order
    return [*first, *[c for c in rest if c not in {f.lstrip("-") for f in first}]]


def _asked(query: Read) -> dict:
    """What a cursor belongs to: the filters and the point in time as they were asked for, so that pages of "now" go together."""
    closed = {c: [None if v is None else str(v) for v in ends] for c, ends in query.closed.items()}
    return {"as_of": query.as_of, "between": list(query.between) if query.between else None, "equal": {c: str(v) for c, v in query.equal.items() if v is not None}, "closed": closed}


def page(df: DataFrame, name: str, query: Read, cursor: str | None = None, limit: int = 50, **options) -> tuple[DataFrame, str | None]:
    """(rows, cursor of the next page or None): the rows of ``read`` after those that the cursor's pages had, in a total order.

    The seek holds after the collapse. What it says of the leading key columns holds for all versions of a key alike, so that part goes to
    the scan. A cursor of other filters, or of another time asked for, is an error. A page has ``PAGE`` rows at most.
    """
    if not 1 <= limit <= PAGE:
        raise ValueError(f"limit must lie between 1 and {PAGE}")
    fact, places = REGISTRY[name], _places(name, query)
    anchor = decode_cursor(cursor, _asked(query)) if cursor else None
    seek = df
    if anchor is not None:
        keys = next((i for i, c in enumerate(places) if c.lstrip("-") not in fact.key), len(places))
        types = dict(df.dtypes)
        if keys:
            same = F.lit(True)
            for c, v in zip(places[:keys], anchor, strict=False):
                same = same & F.col(c.lstrip("-")).eqNullSafe(F.lit(v).cast(types[c.lstrip("-")]))
            lead = places[0].lstrip("-")
            first, held = F.col(lead), F.lit(anchor[0]).cast(types[lead])
            # said of the first column alone as well, since readers take no condition on several
            rest = F.lit(True) if anchor[0] is None else (first <= held if places[0][0] == "-" else first >= held)
            seek = df.where((rest & F.lit(anchor[0] is not None)) | first.isNull()).where(beyond(df, places[:keys], anchor[:keys]) | same)
    unpaged = Read(query.as_of, query.between, query.equal, query.closed)
    rows = read(seek, name, unpaged, **options)
    rows = rows if anchor is None else after(rows, places, anchor)
    order = [F.col(c[1:]).desc_nulls_last() if c[0] == "-" else F.col(c).asc_nulls_last() for c in places]
    rows = rows.orderBy(*order).limit(limit)
    # one more row would tell a full last page apart; an empty page after it does as well
    held = rows.select(*[F.col(c.lstrip("-")).cast("string").alias(f"_{i}") for i, c in enumerate(places)]).collect()
    following = encode_cursor(list(held[-1]), query.as_of or "", _asked(query)) if len(held) == limit else None
    return rows, following


def observations(obs: DataFrame, catalog: DataFrame, query: Read, series_code: str | None = None) -> DataFrame:
    """Observations with their series; a code restricts the scan through the small catalog."""
    wanted = catalog if series_code is None else catalog.where(F.col("series_code") == series_code)
    kept = obs.join(wanted.select("series_id"), "series_id", "left_semi") if series_code else obs
    return read(kept, "observation", query).join(wanted, "series_id")


def canonical(df: DataFrame, entity_id: int, query: Read) -> tuple[DataFrame, DataFrame]:
    """(rows, warnings): how many restated rows the answer holds."""
    rows = read(df.where(F.col("entity_id") == entity_id), "canonical_financial", query)
    warning = rows.agg(F.count_if(F.col("restatement_basis") == "cpi_normalized").alias("n")).where("n > 0").select(F.lit("TAS29_PRESENT").alias("code"), "n")
    return rows, warning


def entities_with_lineage(versions: DataFrame, lineage: DataFrame, as_of: str, single: bool = False) -> DataFrame:
    """Entities at a point in time with what they merged into and split from; a single entity's lineage must also have happened by then."""
    live = temporal.pit(versions, "entity_version", as_of)
    known = temporal.pit(lineage, "entity_lineage", as_of)
    known = known.where(F.col("event_at") <= moment(as_of).cast("date")) if single else known
    merged = first_per_key(known.where("event_kind = 'merged'"), ["from_entity_id"], F.col("event_at").desc(), F.col("row_no").desc()).select(F.col("from_entity_id").alias("entity_id"), F.col("into_entity_id").alias("merged_into"))
    split = first_per_key(known.where("event_kind = 'split'"), ["into_entity_id"], F.col("event_at").desc(), F.col("row_no").desc()).select(F.col("into_entity_id").alias("entity_id"), F.col("from_entity_id").alias("split_from"))
    return live.join(merged, "entity_id", "left").join(split, "entity_id", "left")


#: Names on the surface by column of the table.
SURFACE = {
    "entity": {"legal_name": "canonical_name", "entity_type": "kind", "country_code": "country"},
    "disclosure": {"kap_id": "kap_company_id", "parent_disclosure_id": "republished_as"},
    "event": {"filing_event_id": "event_id", "event_ts": "occurred_at", "payload": "attributes"},
}


def renamed(df: DataFrame, surface: str) -> DataFrame:
    """Columns under the names that readers see; others keep theirs."""
    return df.withColumnsRenamed(SURFACE[surface])


def entity_versions_with_lineage(versions: DataFrame, lineage: DataFrame, between: tuple[str, str]) -> DataFrame:
    """Version chains of an interval, each version with the lineage events it knew, in order (an empty list without any)."""
    chain = temporal.interval(versions, "entity_version", *between)
    event = F.struct(F.col("l_event_at").alias("event_at"), F.col("l_event_kind").alias("event_kind"), F.col("l_from_entity_id").alias("from"), F.col("l_into_entity_id").alias("into"))
    known = temporal.lineage_as_of(chain.select("entity_id", "as_of", "row_no"), lineage)
    known = known.groupBy("entity_id", "as_of", "row_no").agg(F.array_sort(F.collect_list(event)).alias("lineage_events"))
    out = chain.join(known, ["entity_id", "as_of", "row_no"], "left")
    none = F.array().cast(known.schema["lineage_events"].dataType)
    return out.withColumn("lineage_events", F.coalesce("lineage_events", none)).orderBy(*temporal.chain_order("entity_version"))


def disclosures(df: DataFrame, query: Read, published_from: str | None = None, published_to: str | None = None, published_after: str | None = None, published_before: str | None = None, keep_unknown: bool = False) -> DataFrame:
    """Disclosures with the surface's names; filters hold after the collapse, both ends of the publication range are in.

    The older names of the range's ends count only where the newer ones aren't given. ``keep_unknown`` adds rows from
    before knowledge times were kept to a point in time; an interval has none.
    """
    ends = (published_from or published_after, published_to or published_before)
    asked = Read(query.as_of, query.between, query.equal, query.closed | ({"published_at": ends} if any(ends) else {}))
    options = {"keep_unknown": "provenance = 'pre_bitemporal_unknown'"} if keep_unknown and not query.between else {}
    out = read(df, "disclosures_version", asked, **options)
    key = [F.col("disclosure_id"), F.col("as_of")]
    order = [*key, F.col("row_no")] if query.between else [F.col("published_at").desc_nulls_first(), *key]
    out = renamed(out.withColumn("pre_bitemporal", F.col("provenance") == "pre_bitemporal_unknown"), "disclosure").orderBy(*order)
    return out if query.limit is None else out.limit(query.limit)


def filings(filed: DataFrame, sources: DataFrame, kind: str | None = None, filed_from: str | None = None, filed_to: str | None = None, entity_id: int | None = None) -> DataFrame:
    """Filings with the kind of their source; they have no knowledge time, so as_of does nothing here (see ``filings_warning``). Both ends of the range are in."""
    x = filed if entity_id is None else filed.where(F.col("entity_id") == entity_id)
    x = x if filed_from is None else x.where(F.col("published_at") >= moment(filed_from))
    x = x if filed_to is None else x.where(F.col("published_at") <= moment(filed_to))
    out = x.join(sources, "source_id")
    return out if kind is None else out.where(F.col("kind") == kind)


#: What every answer with filings says.
FILINGS_WARNING = {"code": "PRE_BITEMPORAL_TABLE", "table": "filing"}


def identifiers_at(df: DataFrame, namespace: str, value: str, day: str) -> DataFrame:
    """(entity_id, identifier_id, state): what an identifier leads to on a day; several rows are ambiguous."""
    hits = temporal.valid_at(df.where((F.col("namespace") == namespace) & (F.col("value") == value)), day)
    n = F.count("*").over(Window.partitionBy("namespace", "value"))
    return hits.select("entity_id", "identifier_id", F.when(n > 1, "ambiguous").otherwise("found").alias("state"))


def events(df: DataFrame, query: Read, keys: tuple[str, ...] = ("counterparty",), allowed: bool = False, occurred_from: str | None = None, occurred_to: str | None = None, event_after: str | None = None, event_before: str | None = None) -> DataFrame:
    """Events with personal keys of the payload masked; both ends of the range of event_ts are in, and the older names of its ends count only where the newer ones aren't given."""
    from chronofold.operators.analytics import masked

    ends = (occurred_from or event_after, occurred_to or event_before)
    asked = Read(query.as_of, query.between, query.equal, query.closed | ({"event_ts": ends} if any(ends) else {}), query.limit)
    return read(df, "filing_event", asked).withColumn("payload", masked(F.col("payload"), keys, allowed))


def events_with_lineage(df: DataFrame, query: Read, **options) -> tuple[DataFrame, DataFrame]:
    """(events, lineage): the events, and the model, prompt and input hash that the first of them in reading order came from (no row without events)."""
    rows = events(df, query, **options)
    order = temporal.chain_order("filing_event") if query.between else [F.col("event_ts").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in ("event_seq", "filing_id", "event_type", "as_of", "row_no")]]
    first = rows.orderBy(*order).limit(1)
    sha = F.col("input_text_sha256")
    hexed = F.lower(F.hex(sha)) if dict(df.dtypes)["input_text_sha256"] == "binary" else sha
    return rows, first.select(F.col("primary_model_version").alias("model_identity"), F.col("primary_prompt_version").alias("prompt_version"), hexed.alias("raw_bytes_sha256"))


def warned(rows: DataFrame, warnings: DataFrame) -> DataFrame:
    """``rows`` with the warnings (code, n) of the answer on each, as an array; empty without any. An answer has a handful of warnings, which are fetched."""
    held = [F.struct(F.lit(w["code"]).alias("code"), F.lit(w["n"]).cast("long").alias("n")) for w in warnings.orderBy("code").collect()]
    return rows.withColumn("warnings", F.array(*held).cast("array<struct<code:string,n:bigint>>"))
