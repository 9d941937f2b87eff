"""SimHash fingerprints, in DataFrame operations only.

Terms are a text's neighbouring word pairs, lower-cased (the first word pairs with nothing). Each
occurrence votes with a weight that grows with the length of its words: for a bit of the
fingerprint if its hash has that bit, against it otherwise. Votes are summed three bits to a number, so a
text costs 22 sums rather than 64; runs of ``RUN`` terms are summed apart, so no sum
overflows whatever the length.

Fingerprints within a Hamming radius are found by permuted block tables: with ``blocks`` blocks and
radius r, some ``blocks - r`` blocks of two such fingerprints agree, so one table for each choice of
blocks, keyed by their bits, finds all pairs.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm.runtime import cut

BITS = 64
LANES = (0, 22, 44)
STEP = 22
MASK = sum(1 << b for b in LANES)
RUN = 100_000
HEAVIEST = 8


def terms(text: Column) -> Column:
    """Array of term hashes, then a null; the low three bits hold the weight less one."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def term(before: Column, w: Column) -> Column:
        weight = F.least((F.length(before) + F.length(w)) / 2, F.lit(HEAVIEST)).cast("long")
        return F.when(w.isNotNull(), F.xxhash64(before, w).bitwiseAND(F.lit(-HEAVIEST)).bitwiseOR(F.greatest(weight, F.lit(1)) - 1))

    return F.zip_with(F.concat(F.array(F.lit("")), words), words, term)


def fingerprints(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, bits): the 64-bit fingerprint of each row as a long; 0 for texts without words. Keys tell the rows apart."""
    term = rows.select(*keys, F.posexplode(terms(F.col(text_col))).alias("pos", "t")).where("t is not null")
    h, w = F.xxhash64("t"), F.col("t").bitwiseAND(F.lit(HEAVIEST - 1)) + 1
    term = term.select(*keys, F.floor(F.col("pos") / RUN).alias("run"), h.alias("h"), w.alias("w"))
    lanes = [F.sum(F.shiftrightunsigned("h", g).bitwiseAND(F.lit(MASK)) * F.col("w")).alias(f"s{g}") for g in range(STEP)]
    sums = term.groupBy(*keys, "run").agg(F.sum("w").alias("all"), *lanes)

    def votes(bit: int) -> Column:
        at = bit // STEP
        lane = F.shiftrightunsigned(f"s{bit % STEP}", LANES[at])
        return lane.bitwiseAND(F.lit((1 << STEP) - 1)) if at < 2 else lane

    totals = sums.groupBy(*keys).agg(F.sum("all").alias("all"), *[F.sum(votes(b)).alias(f"v{b}") for b in range(BITS)])
    bit = [F.when(F.col(f"v{b}") * 2 > F.col("all"), F.lit((1 << b) - (1 << BITS if b == BITS - 1 else 0))).otherwise(F.lit(0)) for b in range(BITS)]
    bits = bit[0]
    for b in bit[1:]:
        bits = bits.bitwiseOR(b)
    return totals.select(*keys, bits.alias("bits"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def hexadecimal(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), BITS // 4, "0"))


def within(bits: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(a, b): all pairs a < b of distinct fingerprints (column ``bits``) at most ``radius`` bits apart."""
    distinct = bits.select("bits").distinct()
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    ones = [((1 << y) - 1) ^ ((1 << x) - 1) for x, y in itertools.pairwise(edges)]
    masks = [sum(ones[i] for i in chosen) for chosen in itertools.combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)]))
    keyed = cut(distinct, "sh-bits").select("bits", table.alias("t")).select("bits", "t.table", "t.key")
    a, b = keyed.withColumnRenamed("bits", "a"), keyed.withColumnRenamed("bits", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    return a.join(b, ["table", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, prev_id, prev_need) for each distinct doc_id, in ascending order, null first, the last before the first.

    ``prev_need`` is a quarter of the longest text of the previous doc_id. Ids are ordered within
    ranges; only the last of each range meets the others.
    """
    ids = docs.groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 4)).alias("need"))
    ids = cut(ids.repartitionByRange(F.col("doc_id").asc_nulls_first()).withColumn("part", F.spark_partition_id()), "sh-ids")
    own = F.struct("doc_id", "need")
    ends = ids.groupBy("part").agg(F.min(own).alias("first"), F.max(own).alias("last"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(order), F.last("last").over(whole)).alias("before"), F.coalesce(F.lead("first").over(order), F.first("first").over(whole)).alias("after"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first())
    rows = ids.join(cut(ends, "sh-ends"), "part").withColumn("prev", F.coalesce(F.lag(own).over(inside), F.col("before"))).withColumn("next", F.coalesce(F.lead(own).over(inside), F.col("after")))
    return cut(rows.select("doc_id", F.col("next.doc_id").alias("next_id"), F.col("prev.doc_id").alias("prev_id"), F.col("prev.need").alias("prev_need")), "sh-order")


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, next_id, text, edited) for rows (doc_id, text): the last quarter of each text replaced by as much of the next one's beginning.

    Where a doc_id has several texts, the least by hash stands for it as the next one.
    """
    order = neighbours(docs)
    heads = docs.join(order, docs.doc_id.eqNullSafe(order.doc_id)).select(F.col("prev_id").alias("_to"), F.xxhash64("text").alias("m"), F.expr("left(text, cast(prev_need as int))").alias("head"))
    heads = heads.groupBy("_to").agg(F.min_by("head", "m").alias("head")) if _repeats(docs) else heads.select("_to", "head")
    joined = docs.join(heads, docs.doc_id.eqNullSafe(F.col("_to")), "left").join(order.select(F.col("doc_id").alias("_id"), "next_id"), docs.doc_id.eqNullSafe(F.col("_id")), "left")
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 4) as int))"), F.substring(F.coalesce("head", F.lit("")), F.lit(1), quarter))
    return joined.select(docs.doc_id, F.xxhash64("text").alias("mark"), "next_id", "text", edited.alias("edited"))


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def compare(docs: DataFrame, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) for every row.

    A null text counts as empty; texts without words have fingerprint 0. ``n_near`` counts the other fingerprints of the table
    within ``radius`` bits. Equal texts have equal fingerprints; rows that repeat are returned each.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # Ids tell equal rows apart; two of them may trade ids without any effect.
    rows = edits(source).withColumn("rid", F.monotonically_increasing_id())
    both = rows.select("rid", "doc_id", "mark", "next_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"))
    both = both.select("rid", "doc_id", "mark", "next_id", "n_chars", "sha", "x.which", F.when(F.trim("x.t") == "", F.lit("\u0000")).otherwise(F.col("x.t")).alias("t"))
    made = fingerprints(both, ["rid", "doc_id", "mark", "next_id", "n_chars", "sha", "which"], "t")
    made = made.groupBy("rid", "doc_id", "mark", "next_id", "n_chars", "sha").agg(F.max(F.when(F.col("which") == 0, F.col("bits"))).alias("bits"), F.max(F.when(F.col("which") == 1, F.col("bits"))).alias("ebits"))
    made = cut(made, "sh-made")
    nexts = made.groupBy("doc_id").agg(F.min_by("bits", "mark").alias("nbits")).select(F.col("doc_id").alias("_next"), "nbits")
    pairs = within(made, radius)
    links = pairs.select(F.explode(F.array("a", "b")).alias("_bits")).groupBy("_bits").agg(F.count("*").alias("n_near"))
    out = made.join(nexts, F.col("next_id").eqNullSafe(F.col("_next")), "left").join(links, F.col("bits") == F.col("_bits"), "left")
    return out.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), hexadecimal(F.col("bits")).alias("fingerprint"), hexadecimal(F.col("ebits")).alias("edited_fingerprint"), likeness(F.col("bits"), F.col("ebits")).alias("near_edited"), likeness(F.col("bits"), F.col("nbits")).alias("near_next"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))
