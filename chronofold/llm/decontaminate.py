"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased. A document and a benchmark item that share a
run of ``least`` words (found by rolling hash of all such runs) are tiled: the longest
match of words that no tile covers yet becomes a tile, again and again, until none
of ``least`` words is left. Tiles may stand in any order, so reordered passages count. A
document is contaminated by an item if its tiles cover ``percent`` of the item's words.

The benchmark is held by every task. Where it has more than ``block_words`` words, it is
taken in blocks of items, each a pass over the documents, so what is sent stays bounded.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm import kernels as K
from chronofold.llm.mixing import word_count

FILTER_BITS = 22
#: Pairs of equal runs that one text and one item may list at once; beyond them matches are searched for by length.
PAIRS = 2_000_000
SCHEMA = "doc_id long, item_id long, item_words long, covered_words long, tiles long, longest long"


def tiles(text: np.ndarray, item: np.ndarray, text_runs: np.ndarray, item_runs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(start in the item, start in the text, length) of the tiles, longest first, then by place.

    ``*_runs`` are the hashes of the runs of ``least`` words. Runs on one diagonal merge into the
    maximal matches; a match that an earlier tile cuts is put back as what is left of it.
    """
    order = np.argsort(item_runs, kind="stable")
    low = np.searchsorted(item_runs, text_runs, side="left", sorter=order)
    high = np.searchsorted(item_runs, text_runs, side="right", sorter=order)
    at = np.flatnonzero(high > low)
    if not len(at):
        return []
    reps = (high - low)[at]
    if reps.sum() > PAIRS:
        return _tiles_by_length(text, item, least)
    t = np.repeat(at, reps)
    i = order[np.repeat(low[at], reps) + np.arange(len(t)) - np.repeat(np.cumsum(reps) - reps, reps)]
    by = np.lexsort((t, t - i))
    t, i = t[by], i[by]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] - i[1:] != t[:-1] - i[:-1]) | (t[1:] != t[:-1] + 1)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(t))) + least - 1
    heap = list(zip((-length).tolist(), i[first].tolist(), t[first].tolist(), strict=True))
    heapq.heapify(heap)
    in_item, in_text = np.zeros(len(item), dtype=bool), np.zeros(len(text), dtype=bool)
    out = []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        free = ~(in_item[a : a + n] | in_text[b : b + n])
        if free.all():
            in_item[a : a + n] = in_text[b : b + n] = True
            out.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for x, y in edges.reshape(-1, 2).tolist():
            if y - x >= least:
                heapq.heappush(heap, (x - y, a + x, b + x))
    return out


def _tiles_by_length(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """What ``tiles`` gives, in memory that grows with the words alone, whatever repeats in them.

    The greatest length of a match of uncovered words is found by bisection over rolling hashes; matches only get shorter.
    """
    free_item, free_text = np.ones(len(item), dtype=bool), np.ones(len(text), dtype=bool)

    def rolling(words: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * K.powers(K.BASE2, len(words) + 1)[0][: len(words)], out=sums[1:])
        return sums

    def open_windows(sums: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the windows of n uncovered words."""
        taken = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(taken[n:] == taken[:-n]) if len(free) >= n else np.zeros(0, dtype=np.int64)
        return at, K.mix((sums[at + n] - sums[at]) * K.powers(K.BASE2, len(free) + 1)[1][at])

    in_item, in_text = rolling(item), rolling(text)

    def first(n: int) -> tuple[int, int] | None:
        a, ha = open_windows(in_item, free_item, n)
        b, hb = open_windows(in_text, free_text, n)
        seen, where = np.unique(hb, return_index=True)
        for i in np.flatnonzero(np.isin(ha, seen)).tolist():
            j = int(b[where[np.searchsorted(seen, ha[i])]])
            if (item[a[i] : a[i] + n] == text[j : j + n]).all():
                return int(a[i]), j
        return None

    out, most = [], min(len(item), len(text))
    while most >= least:
        low, high = least - 1, most
        found = None
        while low < high:
            n = (low + high + 1) // 2
            if hit := first(n):
                low, found = n, hit
            else:
                high = n - 1
        if found is None:
            break
        (a, b), most = found, low
        free_item[a : a + low] = free_text[b : b + low] = False
        out.append((a, b, low))
    return out


def _index(items: list[tuple[int, str]], least: int) -> dict:
    """What a task needs of a block of items: word hashes, run hashes and the items of each run hash."""
    raw, offsets = K.buffers(pa.array([t or "" for _, t in items], pa.large_string()))
    w = K.Words(raw, offsets, K.PUNCT)
    words = [w.hash[w.first[i] : w.first[i + 1]] for i in range(len(items))]
    need = [min(least, len(x)) for x in words]
    runs = [_runs(x, n) for x, n in zip(words, need, strict=True)]
    of = np.repeat(np.arange(len(items)), [len(r) for r in runs])
    flat = np.concatenate([*runs, np.zeros(0, np.uint64)])
    order = np.lexsort((of, flat))
    flat, of = flat[order], of[order]
    seen = np.zeros(1 << FILTER_BITS, dtype=bool)
    seen[(flat >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return {"ids": [i for i, _ in items], "words": words, "runs": runs, "need": need, "hash": flat, "of": of, "seen": seen}


def _runs(words: np.ndarray, n: int) -> np.ndarray:
    if n == 0 or len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    factor, out = K.powers(K.BASE2, n + 2)[0], np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        out += words[j : len(words) - n + 1 + j] * factor[j + 1]
    return K.mix(out + np.uint64(n) * factor[n + 1 : n + 2])


def _search(docs: DataFrame, items: list[tuple[int, str]], least: int, percent: int) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(_index(items, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = held.value
        widths = sorted({n for n in x["need"] if n})
        for batch in batches:
            found = []
            for rows, raw, offsets in K.chunks(batch, "text"):
                w = K.Words(raw, offsets, K.PUNCT)
                pairs: set[tuple[int, int]] = set()
                for n in widths:
                    h = _runs(w.hash, n)
                    at = np.flatnonzero(x["seen"][(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    at = at[w.doc[at] == w.doc[at + n - 1]] if len(at) else at
                    low, high = (np.searchsorted(x["hash"], h[at], side=s) for s in ("left", "right"))
                    for d, a, b in {*zip(w.doc[at].tolist(), low.tolist(), high.tolist(), strict=True)}:
                        pairs.update((d, i) for i in x["of"][a:b].tolist())
                for d, i in sorted(pairs):
                    text, n = w.hash[w.first[d] : w.first[d + 1]], x["need"][i]
                    got = tiles(text, x["words"][i], _runs(text, n), x["runs"][i], n)
                    covered, whole = sum(t[2] for t in got), len(x["words"][i])
                    if covered * 100 >= whole * percent and whole:
                        found.append((rows.column(0)[d].as_py(), x["ids"][i], whole, covered, len(got), got[0][2]))
            cols = zip(*found, strict=True) if found else [[]] * 6
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names)

    return docs.mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = 5, percent: int = 80, block_words: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, tiles, longest) for each contaminated pair.

    An item of fewer words than ``least`` must be matched whole. Null texts and texts without words
    neither match nor contaminate. Rows that repeat give a row each; further columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(word_count("text") + F.length("text") / 8), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(float(total) / block_words))
    parts = []
    for b in range(blocks):
        held = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        parts.append(_search(source, sorted((r["item_id"], r["text"]) for r in held.collect() if r["item_id"] is not None), least, percent))
    return functools.reduce(DataFrame.union, parts)
