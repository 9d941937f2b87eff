"""From raw documents to a training mixture: five stages, each one operator of ``chronofold.llm``.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the
last return the columns of ``docs``. The filters judge each row by itself, whatever its doc_id: null and repeated
ones too. Further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import decontaminate, line_dedup, mixing, near_dup, toxicity
from chronofold.llm.runtime import cut, one_of

#: No SQL expresses the stages; tests compare them with brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.7 or more go. Labels are learned as in op1, from the documents here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~one_of("doc_id", 3, 1))
    model = toxicity.learn(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    return toxicity.score(docs, model, score_col="_toxicity").where("_toxicity < 0.7").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an equal or almost equal earlier line are cut out of the texts; every document stays."""
    return line_dedup.drop_lines(docs, bound=3, min_equal=1)


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a row id, written, so that rows of null or repeated doc_id can be told apart."""
    return cut(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate rows (five-word shingles, similarity 0.8) the one of the least doc_id stays, null last, then of the least row id."""
    rows = _numbered(docs)
    found = cut(near_dup.near_duplicates(rows, words=5, percent=80, id_col="_row"), "pipeline-found")
    groups = found.where("not kept").select("component_id").distinct()
    members = found.join(groups.hint("merge"), "component_id").select("_row", "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    members = members.join(rows.select("_row", place.alias("place")).hint("merge"), "_row")
    stays = members.groupBy("component_id").agg(F.min("place").alias("best"))
    gone = members.join(stays.hint("merge"), "component_id").where("place <> best").select("_row")
    return rows.join(cut(gone, "pipeline-near").hint("merge"), "_row", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain a benchmark item, in whatever order of its passages, go."""
    rows = _numbered(docs)
    found = decontaminate.contaminated(rows.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.select(F.col("doc_id").alias("_row")).distinct()
    return rows.join(cut(gone, "pipeline-leaks").hint("merge"), "_row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies and words of each document in the mixture."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, f"pipeline-{i}")
    return docs
