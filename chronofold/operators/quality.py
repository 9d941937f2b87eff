"""Data-quality invariants and the derivation of restatement bases."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.entities import overlap_counts
from chronofold.schemas import Fact


def duplicates(df: DataFrame, fact: Fact) -> DataFrame:
    """Natural keys that occur more than once."""
    return df.groupBy(*fact.natural_key()).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> DataFrame:
    return child.join(parent.select(*keys), list(keys), "left_anti")


def registry_gaps(tables: DataFrame, registered: DataFrame) -> DataFrame:
    """(name, gap) of tables with a knowledge time that the registry lacks, and of registered tables without one or without a guard.

    ``tables`` has name, has_as_of and guarded; ``registered`` has name.
    """
    unknown = tables.where("has_as_of").join(registered, "name", "left_anti").select("name", F.lit("unregistered").alias("gap"))
    x = registered.join(tables, "name", "left")
    gap = F.when(~F.coalesce("has_as_of", F.lit(False)), "no_as_of").when(~F.coalesce("guarded", F.lit(False)), "no_guard")
    return unknown.unionByName(x.select("name", gap.alias("gap")).where("gap is not null"))


def report(checks: dict[str, DataFrame], weights: dict[str, str] | None = None) -> DataFrame:
    """(name, violations, status): one row per invariant; a weight names the column whose sum counts, else rows count."""
    count = lambda name: F.coalesce(F.sum(weights[name]), F.lit(0)) if name in (weights or {}) else F.count("*")
    parts = [df.agg(count(name).alias("violations")).select(F.lit(name).alias("name"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts).withColumn("status", F.when(F.col("violations") == 0, "ok").otherwise("FAIL"))


def invariants(facts: dict[str, tuple[DataFrame, Fact]], identifiers: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Duplicate natural keys per table, overlapping identifiers (pairs) and, where ``tables`` is given, gaps of the registry."""
    checks = {f"duplicate_{name}": duplicates(df, fact) for name, (df, fact) in facts.items()}
    if tables is not None:
        names = tables.sparkSession.createDataFrame([(n,) for n in facts], "name string")
        checks["registry_gaps"] = registry_gaps(tables, names)
    return report(checks | {"identifier_overlap": overlap_counts(identifiers)}, {"identifier_overlap": "n"})


#: In the metadata of a table's knowledge-time column: writers may only append. Parquet files keep it.
GUARD = "append_only"


def guarded(df: DataFrame, as_of: str = "as_of") -> DataFrame:
    """``df`` with the mark on its knowledge time."""
    return df.withMetadata(as_of, df.schema[as_of].metadata | {GUARD: True})


def described(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, has_as_of, guarded) of tables, from their own schemas."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        field = next((f for f in df.schema.fields if f.name == "as_of" and f.dataType.typeName().startswith("timestamp")), None)
        rows.append((name, field is not None, field is not None and bool(field.metadata.get(GUARD))))
    return spark.createDataFrame(rows, "name string, has_as_of boolean, guarded boolean")


#: The tables whose natural keys the invariants look at, and those whose knowledge time must be there.
CHECKED = ("observation", "financial_line_item", "canonical_financial", "filing_event")
TIMED = ("observation",)


def bitemporal_invariants(tables: dict[str, DataFrame], registry: dict[str, Fact]) -> DataFrame:
    """(name, violations, status) of every invariant: duplicates and missing knowledge times of the facts, overlapping identifiers (each pair
    from both sides), tables with a knowledge time that the registry lacks, registered tables without the mark of append-only ones."""
    checks = {f"{n}_no_duplicate_as_of": duplicates(tables[n], registry[n]) for n in CHECKED}
    checks |= {f"{n}_as_of_not_null": tables[n].where(F.col(registry[n].as_of).isNull()) for n in TIMED}
    checks["identifier_no_overlapping_pairs"] = overlap_counts(tables["identifier"]).withColumn("n", F.col("n") * 2)
    spark = tables["identifier"].sparkSession
    gaps = registry_gaps(described(tables), spark.createDataFrame([(n,) for n in registry], "name string"))
    checks["registry_completeness"] = gaps.where("gap = 'unregistered'")
    checks["append_only_marks"] = gaps.where("gap <> 'unregistered'")
    return report(checks, {"identifier_no_overlapping_pairs": "n"})


def derive_basis(lines: DataFrame, exempt: DataFrame, monetary: str, inflation: str, first_day: str = "2023-12-31") -> DataFrame:
    """Restatement basis of each line item by the first rule that holds for its filing.

    Exempt entity; a monetary gain or loss line; an inflation tag; a period from ``first_day`` on under ifrs; else no
    evidence. One window over the filing replaces the self-joins.
    """
    of_filing = Window.partitionBy("filing_id")
    x = lines.join(exempt.select("entity_id").distinct().withColumn("_exempt", F.lit(True)), "entity_id", "left")
    x = x.withColumn("measuring_unit_date", F.max("period_end").over(of_filing))
    x = x.withColumn("_monetary", F.max(F.col("line_code") == monetary).over(of_filing)).withColumn("_inflation", F.max(F.col("line_code").like(inflation)).over(of_filing))
    late = F.col("period_end") >= F.lit(first_day).cast("date")
    exempted = F.coalesce("_exempt", F.lit(False))
    reason = F.when(exempted, "P0_exempt").when(F.col("_monetary"), "P1_monetary_line").when(F.col("_inflation"), "P2_inflation_tag").when(late, "P3_period").otherwise("P4_no_evidence")
    basis = F.when(exempted | ~(F.col("_monetary") | F.col("_inflation") | late), "as_reported").otherwise("cpi_normalized")
    return x.withColumn("derivation_reason", reason).withColumn("restatement_basis", basis).drop("_exempt", "_monetary", "_inflation")
