"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Each source gets a target in words. Every document gets the whole copies that
``target / source size`` makes certain; what remains is drawn as one more copy of some documents.
The chance of that copy is proportional to the document's weight (its words, unless a column is named) and
normalised so that the expected words are those that remain; where it would reach 1 the copy is certain too.
The others are ranked by the odds of a random number divided by the odds of their inclusion,
and the ranking is taken up to the words that remain (Rosen's Pareto sampling with the
size fixed in words). A walk ends at the first document that doesn't fit; the next walk passes
over those too large for the rest. The document nearest in size to the last gap closes it.

A source may hold any share of the rows: prefix sums come from a histogram of the
ranking variable that is pre-aggregated before any shuffle, and only rows of the one
bucket where a source's sample ends are ordered. Weights are rounded down to steps of a
``STEPS``-th of an octave, so the sums by weight that the chances come from are few for any source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.runtime import cut

BUCKETS = 4096
ROUNDS = 3
STEPS = 64
#: Weights are taken to lie within 2 ** -OCTAVES and 2 ** OCTAVES.
OCTAVES = 30
BELOW_1 = 1 - 2.0**-40
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text_col: str = "text"):
    return F.coalesce(F.expr(f"regexp_count(`{text_col}`, r'{WORD}')"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target, capped) from (source, source_size).

    Weights go round the sources by code point, null last. A target is the least of
    ``most`` times its source's size and its weight times a level; the level gives the targets the
    sum of all sizes, which is where resharing the excess by weight ends. One row per
    source is ordered in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(n, F.lit(len(weights))) + 1).cast("int"))
    x = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).cast("double").alias("cap"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    x = x.withColumn("level", (F.sum("source_size").over(all_rows) - before) / rest)
    x = x.withColumn("level", F.max("level").over(all_rows))
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    return x.select("source", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"), capped.alias("capped"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 17, odds_col: str | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs``.

    ``odds_col`` (optional) holds the weights by which documents of a source are drawn, in place of their
    words; null, NaN and what is not above 0 count as 1. A null text has size 0 and takes nothing; null is a source of
    its own, the last; rows that repeat count each. Draws depend on the seed, the id and the text
    alone, so reruns agree; equal rows are exchangeable. Further columns are ignored.
    """
    col = lambda c: F.col(f"`{c}`")
    size = word_count(text_col)
    base = docs.select(col(id_col).alias("doc_id"), col(source_col).alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), col(id_col), col(text_col)).alias("h"), _level(col(odds_col) if odds_col else size).alias("level"))
    base = cut(base.withColumn("rid", F.monotonically_increasing_id()), "mix-base")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, most)
    ratio = F.when(F.col("source_size") > 0, F.when(F.col("capped"), F.lit(float(most))).otherwise(F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.least(F.floor(ratio), F.lit(most)).cast("long")).withColumn("open", ratio > F.col("whole"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("skey", _skey())
    plan = cut(plan, "mix-plan")
    # Written once more, so that the planner sees how few rows the next join meets.
    plan = cut(plan.join(_chances(base, plan), "skey", "left"), "mix-chances")
    rows = base.withColumn("skey", _skey()).drop("source").join(plan, "skey")
    certain = F.coalesce(F.col("open") & (F.col("level") > F.col("top")), F.lit(False))
    rows = rows.withColumn("p", F.when(F.col("open") & ~certain, F.coalesce(F.least(F.col("chance") * _weight("level"), F.lit(BELOW_1)), F.lit(0.0))).otherwise(0.0))
    rows = rows.withColumn("whole", F.col("whole") + certain.cast("long")).withColumn("left", F.col("rest") - F.coalesce("sure", F.lit(0)))
    u = (F.shiftrightunsigned("h", 11).cast("double") + 0.5) / float(1 << 53)
    q = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rows = rows.withColumn("z", F.when(F.col("p") > 0, q / (1 + q))).withColumn("bucket", F.least(F.floor(F.col("z") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    marked = rows.withColumn("drawn", F.lit(False))
    for _ in range(ROUNDS):
        marked = _draw(marked)
    closing = marked.where("p > 0 and not drawn and size > 0").where(F.abs(F.col("size") - F.col("left")) < F.col("left"))
    closing = closing.groupBy("skey").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("miss"), "z", "h", "rid")).alias("c")).select("skey", F.col("c.rid").alias("closer"))
    closing = cut(closing, "mix-closing")
    out = marked.join(closing, "skey", "left")
    copies = F.col("whole") + (F.col("drawn") | F.coalesce(F.col("rid") == F.col("closer"), F.lit(False))).cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _skey() -> Column:
    """A source as a key that is not null."""
    return F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))


def _level(weight: Column) -> Column:
    """The step of a weight on the scale of logarithms."""
    w = weight.cast("double")
    w = F.when(w.isNull() | F.isnan(w) | (w <= 0), 1.0).otherwise(F.greatest(F.lit(2.0**-OCTAVES), F.least(w, F.lit(2.0**OCTAVES))))
    return F.floor(F.log2(w) * STEPS).cast("int")


def _weight(level: str) -> Column:
    return F.pow(F.lit(2.0), F.col(level) / STEPS)


def _chances(base: DataFrame, plan: DataFrame) -> DataFrame:
    """(skey, top, sure, chance): levels above ``top`` are certain and hold ``sure`` words; ``chance`` times the weight is the chance of the others.

    From the heaviest level down, the first whose chance is below 1 once all heavier ones are certain is ``top``. The
    words that remain are fewer than the source's, so there is one. Sums are taken by source and level first.
    """
    words = base.where("size > 0").groupBy(_skey().alias("skey"), "level").agg(F.sum("size").alias("words"))
    words = words.join(plan.where("open").select("skey", "rest"), "skey").withColumn("mass", F.col("words") * _weight("level"))
    heavier = Window.partitionBy("skey").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    lighter = Window.partitionBy("skey").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("sure", F.coalesce(F.sum("words").over(heavier), F.lit(0))).withColumn("mass", F.sum("mass").over(lighter))
    left = F.col("rest") - F.col("sure")
    some = words.where(left * _weight("level") < F.col("mass")).withColumn("chance", left / F.col("mass"))
    best = some.groupBy("skey").agg(F.max(F.struct("level", "sure", "chance")).alias("best"))
    return best.select("skey", F.col("best.level").alias("top"), F.col("best.sure").alias("sure"), F.col("best.chance").alias("chance"))


def _draw(marked: DataFrame) -> DataFrame:
    """``marked`` after one walk along the ranking: rows are drawn until one doesn't fit into ``left`` words of its source."""
    able = F.coalesce((F.col("p") > 0) & ~F.col("drawn") & (F.col("size") <= F.col("left")), F.lit(False))
    rows = marked.where(able)
    histogram = rows.groupBy("skey", "left", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    histogram = histogram.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    ends = histogram.where(F.col("before") <= F.col("left")).groupBy("skey").agg(F.max("bucket").alias("last"), F.max_by("before", "bucket").alias("before"))
    ends = cut(ends, "mix-ends")
    order = Window.partitionBy("skey").orderBy("z", "h", "rid").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.join(ends.withColumnRenamed("last", "bucket"), ["skey", "bucket"]).withColumn("run", F.col("before") + F.sum("size").over(order))
    fits, at = F.col("run") <= F.col("left"), F.struct("z", "h", "rid")
    stops = inside.groupBy("skey").agg(F.max(F.when(fits, at)).alias("stop"), F.coalesce(F.max(F.when(fits, F.col("run"))), F.min("before")).alias("got"))
    stops = cut(ends.select("skey", "last").join(stops, "skey"), "mix-stops")
    out = marked.join(stops, "skey", "left")
    now = F.coalesce((F.col("bucket") < F.col("last")) | ((F.col("bucket") == F.col("last")) & (at <= F.col("stop"))), F.lit(False))
    return out.withColumn("drawn", F.col("drawn") | (able & now)).withColumn("left", F.col("left") - F.coalesce("got", F.lit(0))).drop("last", "stop", "got")
