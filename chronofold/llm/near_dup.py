"""MinHash near-duplicate detection with bottom-k sketches of one hash function.

1. One pass over the texts turns each into its set of word shingles (64-bit hashes)
   and keeps the size, a 128-bit signature of the whole set and the ``k`` least hashes.
2. Equal sets form a class; one row per class goes on, so exact copies never meet.
3. Retained values form inverted lists. Two sketches of sets at or above the
   threshold share at least ``t`` values, so lists over the rarest ``k - t + 1`` values
   of each sketch hold every such pair (prefix filtering); common lines, being the
   most frequent values, drop out.
4. Each list is linked as a star: members against one centre, the member with the
   fewest rare values. The sketch of the union estimates each pair's similarity; what may pass is
   verified by exact Jaccard on the full sets. Verified links give components.
5. What is left are lists whose members lie in more than one component; of lists with the same
   members one goes on. Pairs across components in lists of at most ``SMALL`` members are
   estimated and verified like those of step 4. Longer lists are compared in blocks of
   bounded size, exactly, and only links between components are kept. No partner is dropped.

The chance to lose a pair at the threshold lies in step 3 alone: ``t`` is five standard
deviations below the expected overlap; sets no larger than ``k`` are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import kernels as K
from chronofold.llm.runtime import components, cut, drop_cut, fresh

SMALL = 16
BLOCK = 1024
COLUMNS = 4096


def _sets(words: int):
    """Yields (rows, first, values): values[first[i]:first[i+1]] is the sorted shingle set of row i."""

    def run(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for rows, raw, offsets in K.chunks(batch, column):
            w = K.Words(raw, offsets)
            h, at = w.shingles(words)
            h, doc = h.view(np.int64), w.doc[at]
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            keep = np.ones(len(h), dtype=bool)
            keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h, doc = h[keep], doc[keep]
            yield rows, np.searchsorted(doc, np.arange(w.docs + 1)), h

    return run


def _lists(first: np.ndarray, values: np.ndarray, most: int | None = None) -> pa.Array:
    if most is not None:
        rank = np.arange(len(values)) - np.repeat(first[:-1], np.diff(first))
        values = values[rank < most]
        first = np.concatenate([[0], np.cumsum(np.minimum(np.diff(first), most))])
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))


def sketches(docs: DataFrame, words: int, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, s1, s2, sketch): set size, signature and the k least shingle hashes."""
    sets = _sets(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, first, values in sets(batch, text_col):
                n, u = np.diff(first), values.view(np.uint64)
                sums = []
                for salt in (0x1234567, 0xABCDEF1):
                    total = np.zeros(len(u) + 1, dtype=np.uint64)
                    np.cumsum(K.mix(u + np.uint64(salt)), out=total[1:])
                    sums.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), _lists(first, values, k)], ["id", "n", "s1", "s2", "sketch"])

    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias(text_col))
    return source.mapInArrow(run, "id long, n long, s1 long, s2 long, sketch array<long>")


def full_sets(docs: DataFrame, words: int, text_col: str = "text") -> DataFrame:
    """(cid, set) for rows (cid, text)."""
    sets = _sets(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, first, values in sets(batch, text_col):
                yield pa.RecordBatch.from_arrays([rows.column(0), _lists(first, values)], ["cid", "set"])

    return docs.select("cid", text_col).mapInArrow(run, "cid long, set array<long>")


def _across(comp: np.ndarray, left: np.ndarray, right: np.ndarray, first: np.ndarray, sets: np.ndarray, percent: int) -> np.ndarray:
    """Pairs of components that have a link between members ``left`` and ``right``, least first; sets[first[i]:first[i+1]] is a member's set."""
    n = np.diff(first)
    values, place = np.unique(sets, return_inverse=True)
    shared = np.flatnonzero(np.bincount(place) > 1)
    column = np.full(len(values), -1)
    column[shared] = np.arange(len(shared))
    place, row = column[place], np.repeat(np.arange(len(n)), n)
    row, place = row[place >= 0], place[place >= 0]
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(shared), COLUMNS):
        here = (place >= at) & (place < at + COLUMNS)
        m = np.zeros((len(n), min(COLUMNS, len(shared) - at)), dtype=np.float32)
        m[row[here], place[here] - at] = 1
        overlap += m[left] @ m[right].T
    union = n[left][:, None] + n[right][None, :] - overlap
    i, j = np.nonzero((100 * overlap >= percent * union) & (comp[left][:, None] != comp[right][None, :]))
    a, b = comp[left][i], comp[right][j]
    return np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)


def _block_links(placed: DataFrame, percent: int) -> DataFrame:
    """(a, b): linked components, from rows (v, b1, b2, b, comp, set) dealt and sorted by their block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        key = None

        def links() -> pa.RecordBatch:
            side, comp, n, sets = (np.concatenate(x) for x in zip(*held, strict=True))
            rows = np.arange(len(side))
            left, right = (rows, rows) if key[1] == key[2] else (np.flatnonzero(side == key[1]), np.flatnonzero(side == key[2]))
            found = _across(comp, left, right, np.concatenate([[0], np.cumsum(n)]), sets, percent)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)])
            side, comp, lists = batch.column(3).to_numpy(), batch.column(4).to_numpy(), batch.column(5)
            edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(edges[:-1], edges[1:], strict=True):
                if x == y:
                    continue
                if key != (now := tuple(keys[x].tolist())):
                    if held:
                        yield links()
                    held, key = [], now
                part = lists.slice(x, y - x)
                held.append((side[x:y], comp[x:y], part.value_lengths().to_numpy().astype(np.int64), part.flatten().to_numpy()))
        if held:
            yield links()

    return placed.select("v", "b1", "b2", "b", "comp", "set").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, k: int) -> DataFrame:
    """The rows of ``pairs`` (cid, other) at or above the threshold: estimated by the sketch of the union, then counted on the full sets."""
    share = percent / 100
    other = lambda df, *c: df.select(F.col("cid").alias("other"), *[F.col(x).alias(f"{x}2") for x in c])
    # Union sketch: of the k least values of both, the part that both retain.
    union = F.slice(F.array_sort(F.array_union("sketch", "sketch2")), 1, k)
    common = F.size(F.array_intersect(union, F.array_intersect("sketch", "sketch2")))
    slack = 5 * math.sqrt(share * (1 - share) / k)
    near = pairs.join(classes.select("cid", "sketch").hint("merge"), "cid").join(other(classes, "sketch").hint("merge"), "other")
    near = cut(near.where(common >= F.size(union) * (share - slack)).select("cid", "other"), "nd-near")
    both = near.join(sets.hint("merge"), "cid").join(other(sets, "set").hint("merge"), "other")
    inter = F.size(F.array_intersect("set", "set2"))
    linked = both.where(inter * 100 >= (F.size("set") + F.size("set2") - inter) * percent)
    linked = cut(linked.select("cid", "other"), "nd-links")
    drop_cut(near)
    return linked


def link_classes(classes: DataFrame, sets_of, percent: int, k: int) -> DataFrame:
    """(node, component) for the classes that have a link; ``classes``: cid, n, sketch.

    ``sets_of(cids)`` gives (cid, set), the full sets of the classes asked for.
    """
    share = percent / 100
    t = max(1, math.floor(k * share - 5 * math.sqrt(k * share * (1 - share))))
    # A set of at most k * share shingles meets only sets retained whole, so its overlap bound is exact.
    need = F.when(F.col("n") <= math.floor(k * share), F.floor((F.col("n") * percent + 99) / 100)).otherwise(F.lit(t))
    values = classes.select("cid", "n", F.explode("sketch").alias("v"))
    seen = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    # Values of one sketch only come first in the order and need no list: their number shortens the rest of the prefix.
    ranked = values.join(seen, "v").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("often"))
    kept = F.least("n", F.lit(k))
    length = (kept - need + 1) - (kept - F.size("often"))
    prefix = ranked.select("cid", "n", (kept - F.size("often")).alias("rare"), kept.alias("kept"), F.expr("often.v").alias("often"), length.cast("int").alias("length")).where("length > 0")
    index = cut(prefix.select("cid", "n", "rare", "kept", F.explode(F.slice("often", F.lit(1), F.col("length"))).alias("v")), "nd-index")
    rank = F.struct((F.col("rare") / F.col("kept")).alias("u"), F.xxhash64("cid").alias("h"), "cid", "n", "rare", "kept")
    centre = index.groupBy("v").agg(F.count("*").alias("size"), F.min(rank).alias("c")).where("size > 1")
    centre = centre.select("v", "size", F.col("c.cid").alias("centre"), F.col("c.n").alias("cn"))
    lists = cut(index.join(centre, "v"), "nd-lists")
    drop_cut(index)
    near = lists.where(f"cid <> centre and least(n, cn) * 100 >= greatest(n, cn) * {percent}").select("cid", "centre").distinct()
    sets = cut(sets_of(lists.select("cid").distinct()), "nd-sets")
    links = _verified(near.select("cid", F.col("centre").alias("other")), classes, sets, percent, k).select(F.col("cid").alias("a"), F.col("other").alias("b"))
    star = components(links)
    comp = F.coalesce("component", "cid").alias("comp")
    placed = lists.select("v", "cid", "n", "size").join(star.hint("merge"), F.col("cid") == F.col("node"), "left").select("v", "cid", "n", "size", comp)
    same = [F.count("*").alias("s0"), *[F.bit_xor(F.xxhash64(F.lit(i), "cid")).alias(f"s{i}") for i in (1, 2)]]
    split = placed.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), *same).where("x <> y")
    placed = cut(placed.join(split.groupBy("s0", "s1", "s2").agg(F.min("v").alias("v")).hint("merge"), "v").select("v", "cid", "n", "size", "comp"), "nd-split")
    drop_cut(lists)
    short = placed.where(F.col("size") <= SMALL)
    two = short.select("v", F.col("cid").alias("other"), F.col("n").alias("n2"), F.col("comp").alias("comp2"))
    pairs = short.join(two.hint("merge"), "v").where(f"cid < other and comp <> comp2 and least(n, n2) * 100 >= greatest(n, n2) * {percent}")
    few = _verified(pairs.select("cid", "other").distinct(), classes, sets, percent, k)
    places = placed.select("cid", "comp").distinct()
    few = few.join(places.hint("merge"), "cid").join(places.select(F.col("cid").alias("other"), F.col("comp").alias("comp2")).hint("merge"), "other").select(F.least("comp", "comp2").alias("a"), F.greatest("comp", "comp2").alias("b"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = placed.where(F.col("size") > SMALL).withColumn("b", F.pmod(F.xxhash64("cid"), blocks).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.join(sets.hint("merge"), "cid").select("v", F.least("b", "o").alias("b1"), F.greatest("b", "o").alias("b2"), "b", "comp", "set")
    key = ["v", "b1", "b2"]
    more = cut(few.union(_block_links(dealt.repartition(*key).sortWithinPartitions(*key), percent)).distinct(), "nd-more")
    drop_cut(sets, placed)
    joined = components(more)
    out = links.select(F.explode(F.array("a", "b")).alias("node")).union(more.select(F.explode(F.array("a", "b")))).distinct()
    out = out.join(star, "node", "left").select("node", F.coalesce("component", "node").alias("mid"))
    joined = joined.select(F.col("node").alias("mid"), F.col("component").alias("top"))
    return cut(out.join(joined, "mid", "left").select("node", F.coalesce("top", "mid").alias("component")), "nd-comp")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, k: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Links join documents whose shingle sets have Jaccard similarity of at least
    ``percent`` / 100. The component is the least id reachable. Null and empty texts and texts
    without words have an empty set and link with nothing. Rows that share an id count as one
    document and so link what each of them links with; every such row is returned, all with one component. A row with a null id gets a null
    component, is kept and links with nothing. Further columns are ignored.
    """
    source = fresh(docs, id_col, text_col)
    sk = cut(sketches(source, words, k, id_col, text_col), "nd-sketch")
    if _repeats(sk):
        return _of_rows(source, words, percent, k, id_col, text_col)
    live = sk.where("n > 0 and id is not null")
    classes = live.groupBy("n", "s1", "s2").agg(F.min("id").alias("cid"), F.min_by("sketch", "id").alias("sketch"))
    classes = cut(classes, "nd-classes")

    def sets_of(cids: DataFrame) -> DataFrame:
        rows = source.select(F.col(f"`{id_col}`").cast("long").alias("cid"), F.col(f"`{text_col}`").alias(text_col))
        return full_sets(rows.join(cids.hint("merge"), "cid"), words, text_col)

    comps = link_classes(classes.select("cid", "n", "sketch"), sets_of, percent, k)
    members = sk.select("id", "n", "s1", "s2").join(classes.select("n", "s1", "s2", "cid"), ["n", "s1", "s2"], "left")
    members = members.join(comps, F.col("cid") == F.col("node"), "left")
    top = F.when(F.col("id").isNotNull(), F.coalesce("component", "cid", "id"))
    return members.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), top.alias("component_id"), F.coalesce(F.col("id") == top, F.lit(True)).alias("kept"))


def _of_rows(source: DataFrame, words: int, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` where an id comes with several sets: rows are compared by ids of their own, then the groups that share an id join."""
    rows = cut(source.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")), "nd-rows")
    found = near_duplicates(rows.where("id is not null").select("row", "text"), words, percent, k, "row", "text")
    found = cut(found.join(rows.select("row", "id").hint("merge"), "row").select("id", "n_shingles", F.col("component_id").alias("comp")), "nd-of-rows")
    least = found.groupBy("id").agg(F.min("comp").alias("a"))
    joined = components(found.join(least.hint("merge"), "id").where("a <> comp").select("a", F.col("comp").alias("b")).distinct())
    found = found.join(joined.hint("merge"), found.comp == joined.node, "left").select("id", "n_shingles", F.coalesce("component", "comp").alias("comp"))
    top = found.groupBy("comp").agg(F.min("id").alias("top"))
    out = found.join(top.hint("merge"), "comp").select("id", "n_shingles", "top")
    nulls = sketches(rows.where("id is null"), words, k, "id", "text").select("id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("top"))
    return out.unionByName(nulls).select(F.col("id").alias(id_col), "n_shingles", F.col("top").alias("component_id"), F.coalesce(F.col("id") == F.col("top"), F.lit(True)).alias("kept"))


def _repeats(sk: DataFrame) -> bool:
    """Whether an id comes with more than one set."""
    return not sk.where("id is not null").groupBy("id").agg(F.min(F.struct("n", "s1", "s2")).alias("x"), F.max(F.struct("n", "s1", "s2")).alias("y")).where("x <> y").isEmpty()
