"""Point-in-time reads as SQL table functions: ``SELECT * FROM observation_at(TIMESTAMP '...')``.

One generator writes the body of each function from the registry, so SQL and ``temporal.pit`` can't differ in keys, order or live
filters. Functions and the views they read are temporary, of the session that calls ``register``. The body is a plain query, which the optimizer sees
through: filters on key columns pass below the collapse to the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronofold.schemas import REGISTRY, Fact

#: Name of the function of each fact, less ``_at``, where it is not the fact's own.
_NAMES = {"entity_version": "entity", "disclosures_version": "disclosures"}
#: The argument in UTC without zone, as the tables hold times.
_POINT = "timestampadd(MICROSECOND, unix_micros(p_as_of), TIMESTAMP_NTZ '1970-01-01 00:00:00')"


def name(table: str) -> str:
    return _NAMES.get(table, table) + "_at"


def _quoted(*columns: str) -> str:
    return ", ".join(f"`{c}`" for c in columns)


def pit_body(fact: Fact, view: str, columns: list[str]) -> str:
    """The collapse of a fact at ``p_as_of``; a null point has no rows."""
    order = ", ".join(f"`{c}` DESC NULLS LAST" for c in (fact.as_of, *fact.ties))
    live = f" AND ({fact.live.replace(':p', _POINT)})" if fact.live else ""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {_quoted(*fact.key)} ORDER BY {order}) AS _rank FROM {view} WHERE `{fact.as_of}` <= {_POINT}{live}"
    return f"SELECT {_quoted(*columns)} FROM ({ranked}) WHERE _rank = 1"


def valid_body(view: str, columns: list[str]) -> str:
    """Rows whose valid time holds the day of ``p_as_of``; the end is exclusive, null is open."""
    day = f"CAST({_POINT} AS DATE)"
    return f"SELECT {_quoted(*columns)} FROM {view} WHERE valid_from <= {day} AND (valid_to IS NULL OR valid_to > {day})"


def register(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "") -> list[str]:
    """Create or replace the function of each table given; returns their names. Tables are those of the registry, and ``identifier``."""
    made = []
    for table, df in tables.items():
        if table != "identifier" and table not in REGISTRY:
            raise KeyError(f"{table} has no point-in-time read")
        view, function = f"{prefix}{table}_facts", prefix + name(table)
        df.createOrReplaceTempView(view)
        body = valid_body(view, df.columns) if table == "identifier" else pit_body(REGISTRY[table], view, df.columns)
        returns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {function}(p_as_of TIMESTAMP) RETURNS TABLE({returns}) RETURN {body}")
        made.append(function)
    return made
