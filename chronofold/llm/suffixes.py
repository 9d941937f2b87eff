"""Suffix-array deduplication by a depth-limited radix sort.

Bytes are covered if ``width`` bytes around them start anywhere else too. Suffixes need an order
only through ``width`` bytes, and only groups of two or more matter, so the passes go from the most
significant digits on and drop what stands alone:

1. Digit one is a run of ``SEED`` bytes. Not every suffix takes part: the window of ``width`` bytes
   at each start names the run of least hash inside it (the leftmost of several), its
   anchor. Equal windows have equal anchors at equal offsets, so one suffix in about
   seventy stands for its neighbours. Anchors that nothing equals end here.
2. Digit two is all bytes that the windows of one anchor span. Anchors equal in both digits
   have all their windows in common; those bytes are covered.
3. What remains are anchors of one first digit with different second ones: edges of repeats. One
   anchor of each such group (equal ones give equal windows) goes on with the bytes around it.
   Its windows are taken in blocks of ``BLOCK`` starts, at fixed distances from the anchor. Every
   window of a block holds the block's core; blocks whose core no other group has end here,
   and where all blocks of one core span equal bytes, those are covered.
4. The other blocks are spread into windows, and windows that two groups share are covered.

Digits are compared by 64-bit hashes of different bases, two of which stand for the full depth.
Counts are pre-aggregated; no group is ever gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import kernels as K
from chronofold.llm.runtime import cut

SEED = 64
BLOCK = 8


def _anchors(raw: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor, hash of digit one, hash of digit two) of each anchor; places count in the chunk."""
    none = np.zeros(0, dtype=np.int64)
    nothing = (none,) * 6
    seed = min(SEED, width)
    if len(raw) < width:
        return nothing
    h = K.windows(raw, seed)
    keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    anchor = (K.sliding_min(keyed, width - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)[: len(anchor)]
    start = np.flatnonzero(np.arange(len(anchor)) + width <= offsets[row + 1])
    if not len(start):
        return nothing
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[start[1:]] != anchor[start[:-1]]) | (row[start[1:]] != row[start[:-1]])
    lo = start[new]
    hi = start[np.append(np.flatnonzero(new)[1:], len(start)) - 1]
    sums = K.prefix_hash(raw, K.BASE2)
    two = K.mix(K.span_hash(sums, K.BASE2, lo, hi + width) + (anchor[lo] - lo).astype(np.uint64))
    return row[lo], lo, hi, anchor[lo], h[anchor[lo]].view(np.int64), two.view(np.int64)


def anchors(docs: DataFrame, width: int) -> DataFrame:
    """(one, two, doc_id, mark, lo, n, ahead): both digits, the text, the run of window starts lo .. lo + n and how far from lo the anchor is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in K.chunks(batch, "text"):
                row, lo, hi, anchor, one, two = _anchors(raw, offsets, width)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), rows.column(0).take(at), rows.column(1).take(at), pa.array((lo - offsets[row]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array((anchor - lo).astype(np.int32))], ["one", "two", "doc_id", "mark", "lo", "n", "ahead"])

    return docs.select("doc_id", "mark", "text").mapInArrow(run, "one long, two long, doc_id long, mark long, lo int, n int, ahead int")


def _contexts(rows: DataFrame, width: int) -> DataFrame:
    """(gid, c, lo, n, ahead, doc_id, mark, bytes) with the bytes that the windows of each wanted run span; rows: doc_id, mark, text, wanted."""
    fields = "gid long, c long, lo int, n int, ahead int"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw, _ = K.buffers(batch.column(2).slice(i, 1))
                data, runs = raw.tobytes(), batch.column(3)[i].values
                lo, n = runs.field("lo").to_pylist(), runs.field("n").to_pylist()
                part = [data[a : a + b + width] for a, b in zip(lo, n, strict=True)]
                same = [pa.repeat(batch.column(c)[i], len(lo)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(runs.field(f) for f in names), *same, pa.array(part, pa.binary())], [*names, "doc_id", "mark", "bytes"])

    return rows.select("doc_id", "mark", "text", "wanted").mapInArrow(run, f"{fields}, doc_id long, mark long, bytes binary")


PART = 512


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]]:
    """Runs of contexts with where the bytes of each begin, and prefix sums of all their bytes by both bases."""
    for batch in batches:
        for a in range(0, batch.num_rows, PART):
            part = batch.slice(a, PART)
            data = part.column(part.num_columns - 1).cast(pa.large_binary())
            _, off, raw = data.buffers()
            offsets = np.frombuffer(off, dtype=np.int64)[data.offset : data.offset + len(data) + 1]
            held = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]
            yield part, offsets[:-1] - offsets[0], [K.prefix_hash(held, b) for b in (K.BASE, K.BASE2)]


ROWS = 1 << 16


def _gathered(parts: Iterator[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    size = 0
    for p in parts:
        held.append(p)
        size += len(p[0])
        if size >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names)


def _blocks(edges: DataFrame, width: int) -> DataFrame:
    """(gid, block, core, whole): blocks of windows by their distance from the anchor; whole is 0 where windows are missing, else a hash of all bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for part, begin, (a, b) in _parts(batches):
            gid, n, ahead = (part.column(c).to_numpy().astype(np.int64) for c in range(3))
            first = (ahead - n) // BLOCK
            count = ahead // BLOCK - first + 1
            row = np.repeat(np.arange(len(gid)), count)
            block = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(row))
            near = ahead[row] - block * BLOCK
            far, at, last = near - (BLOCK - 1), begin[row], n[row]
            core = K.mix(K.span_hash(a, K.BASE, at + near, at + far + width) + block.astype(np.uint64)) ^ K.span_hash(b, K.BASE2, at + near, at + far + width)
            full = (far >= 0) & (near <= last)
            whole = K.span_hash(b, K.BASE2, at + np.maximum(far, 0), at + np.minimum(near, last) + width)
            yield [gid[row], block.astype(np.int32), core.view(np.int64), np.where(full, whole.view(np.int64), 0)]

    names = ["gid", "block", "core", "whole"]
    return edges.select("gid", "n", "ahead", "bytes").mapInArrow(lambda b: _gathered(made(b), names), "gid long, block int, core long, whole long")


def _windows(rows: DataFrame, width: int) -> DataFrame:
    """(w1, w2, gid, start) for each window of the wanted blocks; rows: gid, lo, n, ahead, blocks, bytes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for part, begin, (a, b) in _parts(batches):
            gid, lo, n, ahead = (part.column(c).to_numpy().astype(np.int64) for c in range(4))
            lists = part.column(4)
            row = np.repeat(np.arange(len(gid)), lists.value_lengths().to_numpy().astype(np.int64))
            start = (ahead[row] - lists.flatten().to_numpy().astype(np.int64) * BLOCK)[:, None] - np.arange(BLOCK)[None, :]
            row, start = np.repeat(row, BLOCK), start.ravel()
            keep = (start >= 0) & (start <= n[row])
            row, start = row[keep], start[keep]
            at = begin[row] + start
            digits = [K.span_hash(s, base, at, at + width).view(np.int64) for s, base in ((a, K.BASE), (b, K.BASE2))]
            yield [*digits, gid[row], (start + lo[row]).astype(np.int32)]

    names = ["w1", "w2", "gid", "start"]
    return rows.select("gid", "lo", "n", "ahead", "blocks", "bytes").mapInArrow(lambda b: _gathered(made(b), names), "w1 long, w2 long, gid long, start int")


def covered(docs: DataFrame, width: int = 200) -> DataFrame:
    """(doc_id, mark, lo, n): runs of window starts whose windows occur elsewhere; docs: doc_id, mark, text."""
    found = anchors(docs, width)
    often = found.groupBy("one").agg(F.count("*").alias("c")).where("c > 1").select("one")
    hits = cut(found.join(often, "one"), "sx-hits")
    groups = hits.groupBy("one", "two").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "mark", "lo", "n", "ahead")).alias("at"))
    groups = cut(groups.withColumn("gid", F.monotonically_increasing_id()), "sx-groups")
    spans = hits.join(groups.where("c > 1").select("one", "two"), ["one", "two"]).select("doc_id", "mark", "lo", "n")
    mixed = groups.groupBy("one").agg(F.count("*").alias("k")).where("k > 1").select("one")
    wanted = groups.join(mixed, "one").groupBy("at.doc_id", "at.mark").agg(F.collect_list(F.struct("gid", "c", "at.lo", "at.n", "at.ahead")).alias("wanted"))
    wanted = wanted.withColumnRenamed("doc_id", "_id").withColumnRenamed("mark", "_mark")
    texts = docs.dropDuplicates(["doc_id", "mark"]) if _repeats(docs) else docs
    edges = cut(_contexts(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark"))), width), "sx-edges")
    blocks = cut(_blocks(edges, width), "sx-blocks")
    cores = blocks.groupBy("core").agg(F.count("*").alias("k"), F.min("whole").alias("x"), F.max("whole").alias("y")).where("k > 1")
    met = cut(blocks.join(cores.select("core", ((F.col("x") == F.col("y")) & (F.col("x") != 0)).alias("equal")), "core").select("gid", "block", "equal"), "sx-met")
    alone = edges.where("c = 1")
    first = F.col("lo") + F.col("ahead") - F.col("block") * BLOCK - (BLOCK - 1)
    equal = met.where("equal").join(alone.select("gid", "doc_id", "mark", "lo", "ahead"), "gid").select("doc_id", "mark", first.cast("int").alias("lo"), F.lit(BLOCK - 1).alias("n"))
    open_blocks = met.where("not equal").groupBy("gid").agg(F.collect_list("block").alias("blocks"))
    spread = cut(_windows(edges.join(open_blocks, "gid"), width), "sx-windows")
    shared = spread.groupBy("w1", "w2").agg(F.count("*").alias("k")).where("k > 1").select("w1", "w2")
    single = spread.join(shared, ["w1", "w2"]).select("gid", "start").join(alone.select("gid", "doc_id", "mark"), "gid")
    return spans.unionByName(equal).unionByName(single.select("doc_id", "mark", F.col("start").alias("lo"), F.lit(0).alias("n")))


def _repeats(docs: DataFrame) -> bool:
    return not docs.groupBy("doc_id", "mark").agg(F.count("*").alias("c")).where("c > 1").isEmpty()


def remove_repeats(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, kept, spans) for every row: the bytes left and the removed runs (start, end), ends exclusive.

    Texts are UTF-8 bytes, null counts as empty. A window repeated within a text counts, with overlaps, and
    so do equal rows. Texts shorter than ``width`` bytes stay whole. ``kept`` is binary, as a cut may
    fall within a character. Further columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    runs = covered(source, width).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))
    runs = cut(runs, "sx-runs").select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), "runs")
    joined = source.join(runs, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left").select("doc_id", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                raw, _ = K.buffers(batch.column(1).slice(i, 1))
                runs = batch.column(2)[i].values
                if runs is None or not len(runs):
                    out.append((len(raw), raw.tobytes(), []))
                    continue
                lo, n = runs.field("lo").to_numpy().astype(np.int64), runs.field("n").to_numpy().astype(np.int64)
                depth = np.bincount(lo, minlength=len(raw) + 1) - np.bincount(lo + n + width, minlength=len(raw) + 1)
                gone = np.cumsum(depth[: len(raw)]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)
                out.append((len(raw), raw[~gone].tobytes(), [{"start": a, "end": b} for a, b in edges.tolist()]))
            cols = zip(*out, strict=True) if out else ([], [], [])
            types = [pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "kept", "spans"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, kept binary, spans array<struct<start:long,end:long>>")


def digest(removed: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what ``remove_repeats`` gives."""
    return removed.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
