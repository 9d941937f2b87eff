"""The document store: content-addressed deduplication, revisions and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofold.operators.temporal import first_per_key


def put_filings(offers: DataFrame) -> DataFrame:
    """Stored filings after all offers, in order of offer_id: one per (source, content).

    The first offer of a content names its canonical reference; later references become aliases. Each further
    content under one canonical reference is a revision and names the one before.
    """
    content = Window.partitionBy("source_id", "sha256").orderBy("offer_id")
    first = offers.withColumn("n", F.row_number().over(content))
    stored = first.where("n = 1").drop("n")
    canonical = stored.select("source_id", "sha256", F.col("source_ref").alias("canonical"))
    others = offers.join(canonical, ["source_id", "sha256"]).where("source_ref <> canonical")
    aliases = others.groupBy("source_id", "sha256").agg(F.array_sort(F.collect_set("source_ref")).alias("aliases"))
    chain = Window.partitionBy("source_id", "source_ref").orderBy("offer_id")
    out = stored.withColumn("revision_no", F.row_number().over(chain).cast("long")).withColumn("previous_id", F.lag("offer_id").over(chain))
    out = out.join(aliases, ["source_id", "sha256"], "left")
    return out.withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>"))).withColumn("is_amendment", F.col("revision_no") > 1)


def find_by_ref(stored: DataFrame) -> DataFrame:
    """(source_id, ref, offer_id): what each reference finds: canonical before alias, then the highest revision."""
    own = stored.select("source_id", F.col("source_ref").alias("ref"), "offer_id", "revision_no", F.lit(1).alias("canonical"))
    other = stored.select("source_id", F.explode("aliases").alias("ref"), "offer_id", "revision_no", F.lit(0).alias("canonical"))
    best = first_per_key(own.unionByName(other), ["source_id", "ref"], F.col("canonical").desc(), F.col("revision_no").desc(), F.col("offer_id").desc())
    return best.select("source_id", "ref", "offer_id")


def amendment_chain(stored: DataFrame, offer_id: int) -> DataFrame:
    """All revisions under the reference of a filing."""
    key = stored.where(F.col("offer_id") == offer_id).select("source_id", "source_ref")
    return stored.join(key, ["source_id", "source_ref"], "left_semi").orderBy("revision_no")


def releasable(stored: DataFrame) -> DataFrame:
    """Filings that no later revision points at: only they may be deleted."""
    later = stored.where("previous_id is not null").select(F.col("previous_id").alias("offer_id"))
    return stored.join(later, "offer_id", "left_anti")


def attach_text(held: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bodies after, audit rows) of filing_id, body_text, body_lang, extracted_at: the latest extraction of a filing wins.

    Incoming rows outrank held ones; among themselves extracted_at, then the text, decides. Audit rows carry the length
    of a text, never the text.
    """
    best = first_per_key(new, ["filing_id"], F.col("extracted_at").desc_nulls_last(), F.col("body_text").desc_nulls_last(), F.col("body_lang").desc_nulls_last())
    known = held.select("filing_id", F.lit(True).alias("_held"))
    operation = F.when(F.col("_held"), "filing_body.update").otherwise("filing_body.create")
    audit = best.join(known, "filing_id", "left").select("filing_id", operation.alias("operation"), "body_lang", F.coalesce(F.length("body_text"), F.lit(0)).alias("body_size_chars"))
    return held.join(best.select("filing_id"), "filing_id", "left_anti").unionByName(best), audit


def listing(filings: DataFrame, limit: int = 50, since: str | None = None, **equal) -> DataFrame:
    """Newest filings with the filters that are set, then by id."""
    for column, value in equal.items():
        if value is not None:
            filings = filings.where(F.col(column) == value)
    x = filings if since is None else filings.where(F.col("published_at") >= F.lit(since).cast("timestamp_ntz"))
    return x.orderBy(F.col("published_at").desc(), "offer_id").limit(limit)


def attach(held: DataFrame, new: DataFrame) -> DataFrame:
    """Attachments to append: the first of each (filing, content) that isn't held."""
    one = first_per_key(new, ["filing_id", "sha256"], F.col("seq"), F.col("filename"))
    return one.join(held.select("filing_id", "sha256"), ["filing_id", "sha256"], "left_anti")
