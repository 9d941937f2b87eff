"""How filters act together: what each removes, repeats or alone catches, for every order of application.

Each document gets one bit for each filter that it fails. Four bits come from the text by itself; the fifth says that
the text equals that of a smaller doc_id. Equal texts are found by refining a partition: documents are
split by length in code points, then by the hashes of successive blocks, and classes of one document go after each split.
Only the full texts of what is left are compared, and all but the least doc_id of a text are
marked. Then nothing but counts of bit patterns is needed: every order is worked out from them.

Null texts count as empty, a null lang is the part ''. A null doc_id is neither smaller nor larger than another, and rows that repeat a doc_id
don't make each other fail. A document is good (toxic) if any of its labels says 1. An empty table has no parts and gives no rows.
Other columns are not read.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from chronofold.llm.runtime import cut, drop_cut, fresh

FILTERS = "ABCDE"
#: Code points of the successive blocks; the last goes to the end of the text.
BLOCKS = (64, 448, 3584, None)
KEYS = ["size", *(f"block{i}" for i in range(len(BLOCKS)))]
#: Bits of the filter that keeps most single texts out of the shuffle, whatever the size of the table: 8 MB.
BITS = 1 << 26
_WORD = r"[^\x20\x09-\x0D]+"


def _text(docs: DataFrame) -> DataFrame:
    return fresh(docs, "doc_id", "text", "lang").select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))


def failures(text: Column) -> Column:
    """Bits of the filters A to D: too few words, too few different ones, too many capitals, signs."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))

    def bits(words: Column) -> Column:
        few = F.size(words) < 200
        dull = 100 * F.size(F.array_distinct(words)) < 50 * F.size(words)
        loud = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text)
        signs = text.rlike("[#$%&*|]")
        return sum(F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate((few, dull, loud, signs)))

    return F.transform(F.array(words), bits)[0]


def _keys(text: Column) -> dict[str, Column]:
    """Length and block hashes by which the partition is refined, in their order."""
    out, at = [F.length(text)], 1
    for width in BLOCKS:
        out.append(F.xxhash64(F.substring(text, at, width or 1 << 30)))
        at += width or 0
    return dict(zip(KEYS, out, strict=True))


def classes(keyed: DataFrame) -> DataFrame:
    """The classes of two or more rows that the last split leaves, as their keys.

    Rows with the same keys throughout are one row with a count, so a large group of copies costs
    one row for each task. After each split, classes of one row are dropped.
    """
    left = cut(keyed.groupBy(*KEYS).agg(F.count("*").alias("rows")), "audit-classes")
    for i in range(1, len(KEYS)):
        many = left.groupBy(*KEYS[:i]).agg(F.sum("rows").alias("all")).where("all > 1").drop("all")
        done, left = left, cut(left.join(many, KEYS[:i], "left_semi"), "audit-classes")
        drop_cut(done)
    return left.where("rows > 1").select(*KEYS)


def _bit(rows: DataFrame) -> DataFrame:
    """``rows`` with the place of their keys in a bitmap of ``BITS`` bits: bucket and bit."""
    at = F.pmod(F.xxhash64(*KEYS), F.lit(BITS)) + 1
    return rows.withColumns({"bucket": F.bitmap_bucket_number(at), "bit": F.bitmap_bit_position(at)})


def repeated(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc_id, part, text) of the documents in the classes ``keys`` whose text is that of a smaller doc_id.

    A bitmap of the classes, of fixed size, lets their texts through and few others; what passes is compared in full.
    """
    texts = _text(docs)
    held = _bit(keys).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    octet = F.conv(F.hex(F.substring("bits", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = octet.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.col("bit") % 8 + 1).cast("int"))) != 0
    # BITS / 32768 rows of 4 KB at most
    found = _bit(texts.withColumns(_keys(F.col("text")))).join(F.broadcast(held), "bucket").where(there)
    found = cut(found.select("doc_id", "part", "text", *KEYS), "audit-texts")
    least = found.groupBy(*KEYS, "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    marked = found.join(least.hint("merge"), [*KEYS, "text"]).where("doc_id > least")
    return marked.select("doc_id", "part", "text")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    held = fresh(labels, "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id")
    flags = held.agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("bad"))
    joined = rows.join(flags, "doc_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "bad")})


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, bad, rows): how many documents fail which filters; bit i of mask is FILTERS[i].

    Documents that the fifth filter takes are counted with its bit, and as many go from the count without it.
    """
    text = F.col("text")
    texts = _text(docs)
    keyed = cut(texts.select("doc_id", "part", failures(text).alias("mask"), *[k.alias(c) for c, k in _keys(text).items()]), "audit-keys")
    keys = classes(keyed)
    again = repeated(docs, keys).select("doc_id", "part", failures(text).alias("mask"))
    again = cut(again, "audit-again")
    by = ["part", "mask", "good", "bad"]
    every = _labelled(keyed.select("doc_id", "part", "mask"), labels).groupBy(*by).agg(F.count("*").alias("rows"))
    moved = _labelled(again, labels).groupBy(*by).agg(F.count("*").alias("rows"))
    last = 1 << FILTERS.index("E")
    both = every.unionByName(moved.withColumn("rows", -F.col("rows"))).unionByName(moved.withColumn("mask", F.col("mask") + last))
    counted = cut(both.groupBy(*by).agg(F.sum("rows").alias("rows")), "audit-counts")
    drop_cut(keyed, again)
    return counted


def _orders() -> Column:
    """Every order and step as a literal: filter_order, step, the bit of its filter, and those before it."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    rows = [{"filter_order": "".join(o), "step": k + 1, "bit": bit[f], "before": sum(bit[x] for x in o[:k])} for o in permutations(FILTERS) for k, f in enumerate(o)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")


def interactions(counted: DataFrame) -> DataFrame:
    """One row for each part, order and step, from counts of bit patterns."""
    rows = counted.select("*", F.explode(_orders()).alias("o")).select("*", "o.*")
    mask, bit, before, n = F.col("mask"), F.col("bit"), F.col("before"), F.col("rows")
    fails, gone = mask.bitwiseAND(bit) != 0, mask.bitwiseAND(before) != 0
    total = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0)).cast("long")
    steps = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(mask == bit).alias("unique_fails"),
        total(fails & ~gone & F.col("good")).alias("good_lost"),
        total(fails & ~gone & F.col("bad")).alias("toxic_lost"),
    )
    # 120 rows for each part and filter, whatever the size of the table
    shapley = F.sum("removed").over(W.Window.partitionBy("part", "bit")).alias("shapley")
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The whole report; every part has all orders and steps, zeros included."""
    return interactions(patterns(docs, labels))
