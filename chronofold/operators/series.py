"""The series catalog: listing, lookup with subjects, upserts whose identity can't change, seeds and configurations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.operators.entities import Conflict, Missing, changes, upsert

FIXED = ("source_id", "frequency", "unit")


def listing(catalog: DataFrame, order: Sequence[str] = ("series_code",), limit: int = 50, **equal) -> DataFrame:
    """Catalog rows with the filters that are set, in order."""
    for column, value in equal.items():
        if value is not None:
            catalog = catalog.where(F.col(column) == value)
    return catalog.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(limit)


def with_subjects(catalog: DataFrame, subjects: DataFrame) -> DataFrame:
    """Each series with its subjects as a list in order of subject and role; empty where there are none."""
    held = subjects.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("subject_id", "role"))).alias("subjects"))
    none = F.array().cast(held.schema["subjects"].dataType)
    return catalog.join(held, "series_id", "left").withColumn("subjects", F.coalesce("subjects", none))


def get(catalog: DataFrame, series_code: str) -> dict:
    rows = catalog.where(F.col("series_code") == series_code).limit(1).collect()
    if not rows:
        raise Missing(series_code)
    return rows[0].asDict()


def upsert_series(catalog: DataFrame, incoming: DataFrame, observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog after, outcome per series_code). Source, frequency and unit of a series with observations can't change."""
    fixed = [c for c in FIXED if c in catalog.columns]
    old = catalog.select("series_code", "series_id", F.struct(*fixed).alias("_old"))
    moved = incoming.select("series_code", F.struct(*fixed).alias("_new")).join(old, "series_code").where(~F.col("_old").eqNullSafe(F.col("_new")))
    if not moved.join(observed.select("series_id").distinct(), "series_id", "left_semi").isEmpty():
        raise Conflict("a series with observations can't change its source, frequency or unit")
    return upsert(catalog, incoming, ["series_code"]), changes(catalog, incoming, ["series_code"])


def identifying_guard(rows: DataFrame, catalog: DataFrame, subjects: DataFrame) -> DataFrame:
    """Rows of identifying series that break a rule: clear text, metadata, or no subject."""
    marked = rows.join(catalog.where("pii_class = 'identifying'").select("series_id"), "series_id")
    known = subjects.select("series_id").distinct().withColumn("_known", F.lit(True))
    rule = F.when(F.col("value_text").isNotNull(), "clear_text").when(F.coalesce("metadata", F.lit("{}")) != "{}", "metadata").when(F.col("_known").isNull(), "no_subject")
    return marked.join(known, "series_id", "left").withColumn("rule", rule).where("rule is not null").drop("_known")


def upsert_configs(configs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Restatement configurations by name, each with a range it applies to and a method; a range that ends before it starts is an error."""
    if not incoming.where("applies_to < applies_from").isEmpty():
        raise ValueError("a configuration ends before it starts")
    return upsert(configs, incoming, ["name"]).orderBy("name")
