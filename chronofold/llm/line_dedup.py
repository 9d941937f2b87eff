"""Line deduplication by a deletion-neighbourhood join.

Two lines are near if one edit (insertion, deletion or substitution of one character)
turns one into the other. Both then have an equal variant with one character deleted:
at the same place for a substitution, and equal to the other line itself for an
insertion. Variants are emitted as hashed keys of those two kinds, so the members of a
key are near by construction and the earliest of them can be found by a
pre-aggregated minimum: no pair is emitted, however many lines share a key. The edit distance
to the earliest is verified on the texts.

To keep the variants few, lines are first compared with whole parts deleted (halves, sixteenths,
then finer ones): lines one edit apart agree in all parts but one. What shares no such key has no
near line and emits no variants.

For bounds of 2 and 3 whole parts are deleted instead of characters. All lines are compared by hashes of an end, or
of what stands beside it, so only the texts of lines that share one are fetched; few lines of one end are compared at once, many first told apart by two of d + 2 parts, which
d edits leave whole and move by no more than the edits before them. The join on a key verifies the edit
distance in its condition, so it makes links and no other pairs.
The edits allowed grow with the shorter line: one
for each ``CHARS_PER_EDIT`` characters, at least 1, at most the bound.
"""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronofold.llm import kernels as K
from chronofold.llm.runtime import cut, drop_cut

MIN_CHARS = 10
PARTS = (16, 128)
BOUND = 3
PLACE = ("doc_id", "mark", "line_no")
CHARS_PER_EDIT = 10
FEW = 16
#: Bytes of lines whose keys are made at once.
KEYED_BYTES = 1 << 20
#: White space that may stand at either end of a line.
BLANKS = " \t\r"
#: Characters that are counted before lines are compared.
COUNTED = " eantio"
COUNTED_TOO = "srldcum"


def _halves(line: Column) -> Column:
    """Hashes of the line without either half, as the shorter and as the longer of two lines."""
    n = F.length(line)

    def key(m: Column, more: int, first: bool) -> Column:
        h = F.floor(m / 2).cast("int")
        return F.xxhash64(m, F.substring(line, F.lit(1), h)) if first else F.xxhash64(m, F.lit(1), F.substring(line, h + 1 + more, F.lit(1 << 30)))

    return F.array(key(n, 0, True), key(n, 0, False), key(n - 1, 0, True), key(n - 1, 1, False))


def _part_keys(rows: DataFrame, parts: int) -> DataFrame:
    """(cid, k): hashes of each line without each of ``parts`` parts, as the shorter and as the longer of two lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = np.arange(parts)
        for batch in batches:
            for cid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums, inverse = _prefix(text)
                found = []
                for more in (0, 1):
                    m = len(sums) - 1 - more
                    a, b = m * part // parts, m * (part + 1) // parts + more
                    found.append(K.mix(sums[a] + (sums[-1] - sums[b]) * inverse[b - a] + part.astype(np.uint64)) ^ np.uint64(m))
                keys = np.unique(np.concatenate(found).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), cid)), pa.array(keys)], ["cid", "k"])

    return rows.select("cid", "line").mapInArrow(run, "cid long, k long")


def _prefix(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the polynomial hash of a line's code points, and the inverse powers of its base."""
    c = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
    power, inverse = K.powers(K.BASE, len(c) + 1)
    sums = np.zeros(len(c) + 1, dtype=np.uint64)
    np.cumsum(c * power[: len(c)], out=sums[1:])
    return sums, inverse


def _sharing(k: DataFrame) -> DataFrame:
    """(cid) of the lines of which a key is shared by another line, from (cid, k)."""
    shared = k.groupBy("k").agg(F.min("cid").alias("x"), F.max("cid").alias("y")).where("x <> y").select("k")
    return k.join(shared.hint("merge"), "k").select("cid").distinct()


def _variants(rows: DataFrame) -> DataFrame:
    """(k, cid): hashed variants of the lines; the two low bits of k are 0 and 1 for the sides of an insertion, 2 for a substitution."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums, inverse = _prefix(text)
                n = len(sums) - 1
                without = sums[:-1] + (sums[-1] - sums[1:]) * inverse[1]
                place = np.arange(n, dtype=np.uint64)
                insert = np.unique(K.mix(without + np.uint64(n - 1)))
                change = K.mix(without ^ K.mix(place * K.BASE2 + np.uint64(n)))
                own = K.mix(sums[-1:] + np.uint64(n))
                keys = np.concatenate([own, insert, change]) & ~np.uint64(3)
                keys[1 : 1 + len(insert)] |= np.uint64(1)
                keys[1 + len(insert) :] |= np.uint64(2)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), cid))], ["k", "cid"])

    return rows.select("cid", "line").mapInArrow(run, "k long, cid long")


def duplicate_lines(docs: DataFrame, bound: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", min_equal: int | None = None) -> DataFrame:
    """(doc_id, line_no, kept_doc_id, kept_line_no, distance) for each line to drop.

    Lines end at \\n and are compared without blanks (space, tab, carriage return) at either end; those of fewer than ``min_chars``
    characters are not compared by edits, and those of fewer than ``min_equal`` (``min_chars`` unless given)
    not at all. With ``min_equal``, lines of white space only are never dropped. A line is dropped if an earlier one, by doc_id (null first),
    hash of the text and line number, is equal or within the edits that ``bound`` (0 to 3) allows. ``distance`` counts the edits to the
    earliest such line; ``kept_*`` names the line that stays at the end of the chain of earliest lines, so it is never dropped itself.
    Equal rows have the same place and don't drop each other's lines. Null texts have no lines.
    """
    return _dropped(docs, bound, min_chars, id_col, text_col, min_equal).drop("mark")


def _dropped(docs: DataFrame, bound: int = 1, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", min_equal: int | None = None) -> DataFrame:
    """``duplicate_lines`` with the hash of the text (mark), which tells rows of one doc_id apart."""
    if bound not in range(BOUND + 1):
        raise ValueError(f"bound {bound} is not one of 0 to {BOUND}")
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    # Trimmed within the array: once for each line, not in every filter.
    lines = texts.select(*PLACE[:2], F.posexplode(F.transform(F.split("text", "\n"), _trimmed)).alias("line_no", "line"))
    lines = lines.where(F.length("line") >= (min_chars if min_equal is None else min(min_equal, min_chars)))
    if min_equal is not None:
        # What begins with a printing ASCII character needs no search.
        lines = lines.where(((F.col("line") >= "!") & (F.col("line") < "\x7f")) | F.col("line").rlike(r"[^\s\p{Z}]"))
    halves = F.when((F.length("line") >= min_chars) & F.lit(bound == 1), _halves(F.col("line")))
    keyed = lines.select(*PLACE, F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), *([halves.alias("keys")] if bound < 2 else ["line"]))
    keyed = cut(keyed if bound < 2 else _end_keys(keyed, bound, min_chars), "ld-keys")
    classes = keyed.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("pos"), F.count("*").alias("copies"), F.any_value("keys").alias("keys"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()), "ld-classes")
    hashed = cut(keyed.drop("keys"), "ld-lines")
    drop_cut(keyed)
    if bound == 0:
        known = classes.withColumns({"near": F.lit(None).cast(classes.schema["pos"].dataType), "edits": F.lit(None).cast("int")})
    elif bound == 1:
        known = classes.join(_near(texts, classes).withColumn("edits", F.lit(1)).hint("merge"), "cid", "left")
    else:
        known = classes.join(_near_by_parts(texts, classes, bound).hint("merge"), "cid", "left")
    known = known.where("copies > 1 or near < pos").select("h1", "h2", "pos", "near", "edits")
    if bound:
        ends = _survivors(known.where("near < pos").select("pos", "near"))
        known = known.drop("near").join(ends.hint("merge"), "pos", "left")
    known = known.withColumn("near", F.coalesce("near", "pos"))
    out = hashed.select(*PLACE, "h1", "h2").join(known.hint("merge"), ["h1", "h2"]).where(F.struct(*PLACE) > F.col("near"))
    distance = F.when(F.col("near") < F.col("pos"), F.col("edits")).otherwise(0)
    return out.select(*PLACE, F.col("near.doc_id").alias("kept_doc_id"), F.col("near.line_no").alias("kept_line_no"), distance.alias("distance"))


def _survivors(links: DataFrame) -> DataFrame:
    """(pos, near) of links to earlier lines, each moved to where its chain ends. Every round doubles the way."""
    links = cut(links, "ld-chains")
    while True:
        up = links.select(F.col("pos").alias("near"), F.col("near").alias("far"))
        moved = cut(links.join(up.hint("merge"), "near", "left").select("pos", F.coalesce("far", "near").alias("near"), F.col("far").isNotNull().alias("moved")), "ld-chains")
        links = moved.select("pos", "near")
        if moved.where("moved").isEmpty():
            return links


def _trimmed(raw: Column) -> Column:
    """``raw`` without blanks at either end; ``trim`` reads the whole line, so only lines with blanks there meet it."""
    blank = functools.reduce(Column.__or__, [f(raw, F.lit(c)) for c in BLANKS for f in (F.startswith, F.endswith)])
    return F.when(blank, F.trim(raw, F.lit(BLANKS))).otherwise(raw)


def _texts(docs: DataFrame, classes: DataFrame, some: DataFrame) -> DataFrame:
    """(*PLACE, cid, line) of the classes in ``some``; copies of a document may repeat them."""
    wanted = classes.join(some.hint("merge"), "cid").groupBy("pos.doc_id", "pos.mark").agg(F.collect_list(F.struct(F.col("pos.line_no").alias("line_no"), "cid")).alias("wanted"))
    texts = docs.join(wanted.hint("merge"), docs.doc_id.eqNullSafe(wanted.doc_id) & (docs.mark == wanted.mark)).select(docs.doc_id, docs.mark, F.split("text", "\n").alias("lines"), F.explode("wanted").alias("w"))
    return texts.select("doc_id", "mark", F.col("w.line_no").alias("line_no"), F.col("w.cid").alias("cid"), F.trim(F.get("lines", F.col("w.line_no")), F.lit(BLANKS)).alias("line")).dropDuplicates(["cid"])


def _near(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(cid, near): the place of the earliest line one edit away from the line of a class, if it comes before the class."""
    some = cut(_sharing(classes.select("cid", F.explode("keys").alias("k"))), "ld-halves")
    texts = cut(_texts(docs, classes, some), "ld-texts")
    for parts in PARTS:
        close = cut(_sharing(_part_keys(texts, parts)), "ld-parts")
        texts = cut(texts.join(close.hint("merge"), "cid"), "ld-close")
    # From here on ids follow the places of the lines, so the least id is the earliest line.
    placed = texts.repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
    texts = cut(placed.select(F.monotonically_increasing_id().alias("cid"), F.col("cid").alias("was"), *PLACE, "line"), "ld-placed")
    made = _variants(texts)
    first = made.groupBy("k").agg(F.min("cid").alias("near"))
    other_side = F.when(F.col("k").bitwiseAND(F.lit(2)) == 0, F.col("k").bitwiseXOR(F.lit(1))).otherwise(F.col("k"))
    first = first.select(other_side.alias("k"), "near")
    pairs = made.join(first.hint("merge"), "k").where("near < cid").groupBy("cid").agg(F.min("near").alias("near"))
    other = texts.select(F.col("cid").alias("near"), F.struct(*PLACE).alias("place"), F.col("line").alias("line2"))
    checked = pairs.join(texts.select("cid", "was", "line"), "cid").join(other, "near").where(F.levenshtein("line", "line2", 1) >= 0)
    return checked.select(F.col("was").alias("cid"), F.col("place").alias("near"))


def _allowed(n: Column, bound: int) -> Column:
    """Edits allowed between lines of which the shorter has ``n`` characters."""
    return F.least(F.lit(bound), F.greatest(F.lit(1), F.floor(n / CHARS_PER_EDIT).cast("int")))


def _moves(bound: int) -> list[list[list[int]]]:
    """For each number d of edits: (u, part, shift, part, shift), how a line longer by u than another can hold two of its d + 2 parts.

    The shifts cost edits: the first, what lies between the two, and what leads from the last to u.
    """
    out = []
    for d in range(1, bound + 1):
        shifts = range(-d, d + 1)
        parts = list(itertools.combinations(range(d + 2), 2))
        out.append([[u, i, s, j, t] for u in range(d + 1) for i, j in parts for s in shifts for t in shifts if abs(s) + abs(t - s) + abs(u - t) <= d])
    return out


def _longer(rows: DataFrame, bound: int) -> DataFrame:
    """``rows`` for each length m that a line in reach and no longer may have; u is what it lacks, d the edits it allows."""
    n = F.length("line")
    rows = rows.select("cid", "line", n.alias("n"), F.explode(F.sequence(F.lit(0), _allowed(n, bound))).alias("u"))
    return rows.withColumn("m", F.col("n") - F.col("u")).withColumn("d", _allowed(F.col("m"), bound)).where("m >= 0 and u <= d")


def _end_keys(rows: DataFrame, bound: int, min_chars: int) -> DataFrame:
    """``rows`` with keys in place of line: hashes of an end of each line of ``min_chars``, or of what stands beside a changed end.

    The low bit of a key is set where a shorter line has it so. Of up to three edits at most one lies in the first half or in
    the second, so its outer quarter is whole, or the inner one is and moved by one at most, seen from that end. Under 20
    characters one edit leaves a half whole. Lengths are rounded down, so lines in reach mostly have the same quarters;
    where a shorter line in reach is rounded to the length below, the keys of that length follow.
    """
    kept = [c for c in rows.columns if c != "line"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in K.chunks(batch, "line", KEYED_BYTES):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), _ends(raw, offsets, bound, min_chars)], [*kept, "keys"])

    return rows.mapInArrow(run, rows.select(*kept, F.array().cast("array<long>").alias("keys")).schema)


def _ends(raw: np.ndarray, offsets: np.ndarray, bound: int, min_chars: int) -> pa.ListArray:
    """The keys of each line of a chunk, by differences of the prefix sums of a polynomial hash of its bytes."""
    rounded = lambda m: m - m % np.select([m < 2 * CHARS_PER_EDIT, m < 64, m < 128], [1, 4, 16], 32)
    char = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    first = np.searchsorted(char, offsets)
    n = np.diff(first)
    power, inverse = K.powers(K.BASE, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    r = rounded(n)
    below = r - 1
    compared, reached = n >= min_chars, (below >= 0) & (n - below <= np.minimum(bound, np.maximum(1, below // CHARS_PER_EDIT)))
    own, lower = np.flatnonzero(compared), np.flatnonzero(compared & reached)
    line, r = np.concatenate([own, lower]), np.concatenate([r[own], rounded(below[lower])])
    shorter = (np.arange(len(line)) < len(own)).astype(np.uint64)
    q = np.where(r < 2 * CHARS_PER_EDIT, r // 2, r // 4)
    quartered = np.flatnonzero(r >= 2 * CHARS_PER_EDIT)
    lines, keys = [], []
    for left, inner, shift in [(left, inner, shift) for left in (1, 0) for inner, shift in ((0, 0), (1, -1), (1, 0), (1, 1))]:
        at = quartered if inner else np.arange(len(line))
        x, size = line[at], q[at]
        start = first[x] + inner * size + shift if left else first[x + 1] - size - inner * size + shift
        a, b = char[start], char[start + size]
        k = K.mix((sums[b] - sums[a]) * inverse[a] ^ K.mix(r[at].astype(np.uint64) * K.BASE2 + np.uint64(2 * inner + left)))
        lines.append(x)
        keys.append(k & ~np.uint64(1) | (shorter[at] if shift == 0 else np.uint64(0)))
    lines, keys = np.concatenate(lines), np.concatenate(keys)
    ends = np.concatenate([[0], np.cumsum(np.bincount(lines, minlength=len(n)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[np.argsort(lines, kind="stable")].view(np.int64)))


def _part_pair_keys(rows: DataFrame, bound: int) -> DataFrame:
    """(k, cid, own): hashes of two parts of each line; own where the parts are the line's and not where a shorter line's may be."""
    moves = F.from_json(F.lit(json.dumps(_moves(bound))), "array<array<array<int>>>")
    fits = F.filter(F.get(moves, F.col("d") - 1), lambda x: F.get(x, F.lit(0)) == F.col("u"))
    rows = _longer(rows, bound).select("cid", "line", "n", "m", "u", "d", F.explode(fits).alias("x"))
    at = lambda i: F.get("x", F.lit(i))

    def part(j: Column, t: Column) -> Column:
        start = F.floor(F.col("m") * j / (F.col("d") + 2)).cast("int")
        end = F.floor(F.col("m") * (j + 1) / (F.col("d") + 2)).cast("int")
        return F.when(start + t >= 0, F.substring("line", start + t + 1, end - start))

    own = (F.col("u") == 0) & (at(2) == 0) & (at(4) == 0)
    key = F.xxhash64("m", at(1), at(3), part(at(1), at(2)), part(at(3), at(4)))
    return rows.select(key.alias("k"), "cid", own.alias("own"))


def _shared(keys: DataFrame, name: str) -> DataFrame:
    """(k, cid, own, size) of the keys that a line has as its own and another has too; size counts a key's rows."""
    by_key = Window.partitionBy("k")
    over = [F.min("cid").over(by_key).alias("x"), F.max("cid").over(by_key).alias("y"), F.max("own").over(by_key).alias("any_own"), F.count("*").over(by_key).alias("size")]
    return cut(keys.select("*", *over).where("x <> y and any_own").drop("x", "y", "any_own"), name)


def _counts(line: Column, chars: str) -> Column:
    """How often each of at most seven characters occurs (255 for more), a byte each."""
    n = [F.least(F.length(line) - F.length(F.replace(line, F.lit(c), F.lit(""))), F.lit(255)).cast("long") for c in chars]
    return functools.reduce(lambda a, b: a * 256 + b, n)


def _apart(a: Column, b: Column) -> Column:
    """Sum of the differences of the counts: an edit makes 2 at most."""
    byte = lambda x, i: F.shiftright(x, 8 * i).bitwiseAND(F.lit(255))
    return functools.reduce(lambda x, y: x + y, [F.abs(byte(a, i) - byte(b, i)) for i in range(len(COUNTED))])


def _links(shared: DataFrame, texts: DataFrame, bound: int) -> DataFrame:
    """(a, b, edits): lines that share a key and are within the edits allowed."""
    rows = cut(shared.join(texts.select("cid", "line", "n", "counts", "more").hint("merge"), "cid"), "ld-keyed")
    side = lambda i: [F.col(c).alias(f"{c}{i}") for c in ("n", "line", "counts", "more", "own")]
    one = rows.where("own").select("k", F.col("cid").alias("a"), *side(1))
    two = rows.select("k", F.col("cid").alias("b"), *side(2))
    edits = F.levenshtein("line1", "line2", bound)
    apart = _apart(F.col("counts1"), F.col("counts2"))
    near = (F.abs(F.col("n1") - F.col("n2")) <= bound) & (apart <= 2 * bound) & (apart + _apart(F.col("more1"), F.col("more2")) <= 2 * bound) & (edits >= 0) & (edits <= _allowed(F.least("n1", "n2"), bound))
    # Where both lines have the key as their own, one of the two orders is enough.
    once = (F.col("a") < F.col("b")) | (~F.col("own2") & (F.col("a") != F.col("b")))
    linked = one.join(two.hint("merge"), (one.k == two.k) & once & near)
    linked = cut(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), edits.alias("edits")), "ld-links")
    drop_cut(rows)
    return linked


def _near_by_parts(docs: DataFrame, classes: DataFrame, bound: int) -> DataFrame:
    """(cid, near, edits): the place of the earliest earlier line within the edits allowed of the line of a class."""
    keys = classes.select("cid", F.explode("keys").alias("key"))
    ends = _shared(keys.select(F.shiftright("key", 1).alias("k"), "cid", (F.col("key").bitwiseAND(F.lit(1)) == 1).alias("own")), "ld-ends")
    texts = _texts(docs, classes, ends.select("cid").distinct())
    texts = texts.select("cid", F.struct(*PLACE).alias("place"), "line", F.length("line").alias("n"), _counts(F.col("line"), COUNTED).alias("counts"), _counts(F.col("line"), COUNTED_TOO).alias("more"))
    texts = cut(texts, "ld-near")
    # Lines of a common end are told apart by two parts at once before they are compared.
    often = texts.join(ends.where(F.col("size") > FEW).select("cid").distinct().hint("merge"), "cid")
    parts = _shared(_part_pair_keys(often, bound), "ld-parts")
    links = _links(ends.where(F.col("size") <= FEW), texts, bound).union(_links(parts, texts, bound)).distinct()
    one, two = texts.select(F.col("cid").alias("a"), F.col("place").alias("p1")), texts.select(F.col("cid").alias("b"), F.col("place").alias("p2"))
    checked = links.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(F.col("p1") != F.col("p2"))
    first = F.struct(F.least("p1", "p2").alias("near"), "edits")
    checked = checked.select(F.when(F.col("p1") < F.col("p2"), F.col("b")).otherwise(F.col("a")).alias("cid"), first.alias("first"))
    return checked.groupBy("cid").agg(F.min("first").alias("first")).select("cid", "first.near", "first.edits")


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the lines to drop; n_chars (if there is one) follows. Texts without such lines stay as they are."""
    gone = _dropped(docs, **options).groupBy("doc_id", "mark").agg(F.collect_set("line_no").alias("gone"))
    gone = cut(gone, "ld-gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    kept = F.filter(F.split("row.text", "\n"), lambda x, i: ~F.array_contains("gone", i))
    joined = rows.join(gone.hint("merge"), F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("mark")), "left")
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    out = joined.select("row", text.alias("text"))
    made = {"text": F.col("text")} | ({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
