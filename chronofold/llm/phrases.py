"""Phrases whose words occur together more often than their parts do, by contiguous pattern growth.

Words of one language are counted first. Each occurrence of a frequent word is then projected to the words that follow it
in its piece, as far as they are frequent and no longer than the longest phrase. Occurrences go to
tasks by their prefix, and within its task a prefix grows to the right, depth first, over the pointers of its occurrences: a range of the ordered
projections, of which each frequent next word takes a part. A prefix with more occurrences than a task should hold is dealt by its
next words instead, so it is counted in several tasks, whose counts are added. Equal projections of a chunk are one row
with a weight.

Words travel as numbers: the most frequent ``dictionary`` words of all languages are numbered by rank, any others by a 63-bit hash, below 0.
Counts are exact but for collisions of such hashes. A sample of at most about ``sample`` documents says which prefixes to deal by longer ones; it has no
bearing on the result.

Null texts count as empty and a null lang as ``und``. doc_id and other columns are not read; repeated rows count again. No words, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronofold.llm.kernels import chunks, mix
from chronofold.llm.runtime import cut, drop_cut, fresh

LONGEST = 5
CHUNK = 1 << 21
#: What a cut of a phrase is scored by, as the phrase is scored by its worst one.
SCALE = 1000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _ENDS.copy()
_GAP[[0x20, 0x09]] = True


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The words of a chunk in order, the text of each, and the number of its piece, pieces of all texts counted on."""
    low, n = _LOWER[raw], len(raw)
    inside = ~_GAP[raw]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends[:-1] &= ~inside[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    held = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(low[inside])))
    piece = np.cumsum(_ENDS[raw] | first[:n])[start]
    return held.dictionary_encode(), np.searchsorted(offsets, start, side="right") - 1, piece


def _counted(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(lang, word, f) for each chunk."""
    for batch in batches:
        for rows, raw, offsets in chunks(batch, "text", CHUNK):
            words, doc, _ = _words(raw, offsets)
            langs = rows.column(0).dictionary_encode()
            many = len(words.dictionary)
            if not many:
                continue
            code = np.asarray(langs.indices).astype(np.int64)[doc] * many + np.asarray(words.indices)
            f = np.bincount(code, minlength=many)
            there = np.flatnonzero(f)
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(there // many), words.dictionary.take(there % many).cast(pa.string()), pa.array(f[there], pa.int64())], schema=schema)


def _texts(docs: DataFrame) -> DataFrame:
    return fresh(docs, "lang", "text").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f) of all words."""
    kind = StructType.fromDDL("lang string, word string, f bigint")
    arrow = to_arrow_schema(kind)
    return _texts(docs).mapInArrow(lambda batches: _counted(batches, arrow), kind).groupBy("lang", "word").agg(F.sum("f").alias("f"))


class Dictionary:
    """Numbers of words by language: from 1 on for those it holds; a hash below 0 for others, or 0 if it holds all that matter."""

    def __init__(self, rows: list[tuple[str, str]], whole: bool):
        self.whole, self.words, self.ids = whole, {}, {}
        for lang in {lang for lang, _ in rows}:
            held = [(w, i) for i, (x, w) in enumerate(rows, 1) if x == lang]
            self.words[lang] = pa.array([w for w, _ in held], pa.large_string())
            self.ids[lang] = np.array([0, *[i for _, i in held]], dtype=np.int64)

    def numbers(self, lang: str, words: pa.Array) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.int64)
        if lang in self.words:
            at = pc.fill_null(pc.index_in(words, value_set=self.words[lang]), -1)
            out = self.ids[lang][np.asarray(at).astype(np.int64) + 1]
        if not self.whole:
            key = lang.encode() + b"\n"
            for i in np.flatnonzero(out == 0).tolist():
                out[i] = -1 - (xxhash.xxh64_intdigest(key + words[i].as_py().encode(), 42) >> 1)
        return out


def _hashed(lang: Column, word: Column) -> Column:
    """The number below 0 of a word that the dictionary doesn't hold."""
    return -1 - F.shiftrightunsigned(F.xxhash64(F.concat(lang, F.lit("\n"), word)), 1)


def _projections(batch: pa.RecordBatch, known: Dictionary) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, weights) of the different projections of each chunk: a row of LONGEST numbers, 0 after the last, the first two not 0; in order."""
    for rows, raw, offsets in chunks(batch, "text", CHUNK):
        words, doc, piece = _words(raw, offsets)
        langs = rows.column(0).dictionary_encode()
        of, place = np.asarray(langs.indices)[doc], np.asarray(words.indices)
        ids = np.zeros(len(place), dtype=np.int64)
        for i, lang in enumerate(langs.dictionary.to_pylist()):
            there = of == i
            ids[there] = known.numbers(lang, words.dictionary)[place[there]] if known.whole else _only(known, lang, words.dictionary, place[there])
        begins = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0) & (piece[:-1] == piece[1:]))
        out = np.zeros((len(begins), LONGEST), dtype=np.int64)
        out[:, 0] = ids[begins]
        for k in range(1, LONGEST):
            at = np.minimum(begins + k, len(ids) - 1)
            goes_on = (begins + k < len(ids)) & (piece[at] == piece[begins]) & (out[:, k - 1] != 0)
            out[:, k] = np.where(goes_on, ids[at], 0)
        if len(out):
            yield _merged(out, np.ones(len(out), dtype=np.int64))


def _only(known: Dictionary, lang: str, words: pa.Array, place: np.ndarray) -> np.ndarray:
    there, back = np.unique(place, return_inverse=True)
    return known.numbers(lang, words.take(pa.array(there)))[back]


def _coded(rows: np.ndarray) -> np.ndarray:
    """Numbers in the same order, as small as they can be had."""
    return rows if rows.min() >= 0 and rows.max() < 1 << 21 else np.unique(rows, return_inverse=True)[1].reshape(rows.shape)


def _merged(rows: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in order, and the sums of their weights."""
    code = _coded(rows)
    if code.max() < 1 << 21:
        order = np.lexsort((code[:, 3] << 21 | code[:, 4], code[:, 0] << 42 | code[:, 1] << 21 | code[:, 2]))
    else:
        order = np.lexsort(code.T[::-1])
    rows = rows[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return rows[at], np.add.reduceat(weights[order], at)


def _prefix_hash(rows: np.ndarray, k: int) -> np.ndarray:
    """Hash of the first k words of each row; never 0."""
    h = np.full(len(rows), k, dtype=np.uint64)
    for j in range(k):
        h = mix(h ^ rows[:, j].view(np.uint64)) + np.uint64(j + 1)
    return h | np.uint64(1)


def _parts(rows: np.ndarray, heavy: np.ndarray, parts: int) -> np.ndarray:
    """The task of each row: by its shortest prefix that is not heavy, or else the whole."""
    out = np.zeros(len(rows), dtype=np.uint64)
    left = np.arange(len(rows))
    for k in range(1, LONGEST + 1):
        h = _prefix_hash(rows[left], k)
        out[left] = h
        left = left[np.isin(h, heavy)]
        if not len(left):
            break
    return (mix(out) % np.uint64(parts)).astype(np.int64)


def _pack(rows: np.ndarray, weights: np.ndarray) -> tuple[int, bytes]:
    """Ordered rows as compressed bytes: weights, then numbers column by column, in the least width that holds all."""
    kind = next((k for k in (np.uint16, np.uint32) if rows.min() >= 0 and rows.max() <= np.iinfo(k).max), np.int64)
    raw = np.array([len(rows), np.dtype(kind).itemsize], dtype=np.int64).tobytes() + weights.astype(np.int64).tobytes() + np.ascontiguousarray(rows.T.astype(kind)).tobytes()
    return len(raw), pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(size: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True)
    n, item = np.frombuffer(raw, dtype=np.int64, count=2).tolist()
    kind = {2: np.uint16, 4: np.uint32, 8: np.int64}[item]
    return np.frombuffer(raw, dtype=kind, offset=16 + 8 * n).reshape(LONGEST, n).T.astype(np.int64), np.frombuffer(raw, dtype=np.int64, count=n, offset=16)


def _dealt(batches: Iterator[pa.RecordBatch], schema: pa.Schema, known: Dictionary, heavy: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, size, packed): the projections of each chunk by task."""
    for batch in batches:
        for rows, weights in _projections(batch, known):
            part = _parts(rows, heavy, parts)
            order = np.argsort(part, kind="stable")
            at = np.flatnonzero(np.diff(part[order], prepend=-1))
            held = [(int(part[own[0]]), *_pack(rows[own], weights[own])) for own in np.split(order, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def grow(rows: np.ndarray, weights: np.ndarray, least: int, heavy: np.ndarray) -> list[tuple[list[int], int]]:
    """(phrase, count) of the prefixes of two words or more with ``least`` occurrences, depth first; heavy ones with any number, since other tasks have the rest.

    Rows are ordered; the occurrences of a prefix are a range of them.
    """
    sums = np.concatenate([[0], np.cumsum(weights)])
    opened = [np.isin(_prefix_hash(rows, k), heavy) for k in range(1, LONGEST + 1)]
    found: list[tuple[list[int], int]] = []
    todo = [((), 0, len(rows))]
    while todo:
        prefix, a, b = todo.pop()
        k = len(prefix)
        column = rows[a:b, k]
        at = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [b - a]])
        f = sums[a + at[1:]] - sums[a + at[:-1]]
        for i in np.flatnonzero((column[at[:-1]] != 0) & ((f >= least) | opened[k][a + at[:-1]])).tolist():
            longer = (*prefix, int(column[at[i]]))
            if k:
                found.append((list(longer), int(f[i])))
            if k + 1 < LONGEST:
                todo.append((longer, a + int(at[i]), a + int(at[i + 1])))
    return found


def _heavy(docs: DataFrame, known: Dictionary, documents: int, sample: int) -> np.ndarray:
    """Hashes of the prefixes that hold more than a 1024th of a sample's projections: at most 1024 of each length."""
    kind = StructType.fromDDL("h bigint, f bigint")
    arrow = to_arrow_schema(kind)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, weights in _projections(batch, known):
                for k in range(1, LONGEST):
                    h, back = np.unique(_prefix_hash(rows[rows[:, k - 1] != 0], k), return_inverse=True)
                    f = np.bincount(back, weights=weights[rows[:, k - 1] != 0]).astype(np.int64)
                    top = f * 1024 > weights.sum() // 8  # what is rarer in each chunk is so in all
                    all_ = [0] if k == 1 else []
                    yield pa.RecordBatch.from_arrays([pa.array([*h[top].view(np.int64), *all_], arrow[0].type), pa.array([*f[top], *([weights.sum()] * len(all_))], arrow[1].type)], schema=arrow)

    rows = _texts(docs if documents <= sample else docs.sample(sample / documents, seed=13)).mapInArrow(hashes, kind)
    sums = rows.groupBy("h").agg(F.sum("f").alias("f"))
    top = sums.orderBy(F.desc("f"), "h").limit(1 + 1024 * (LONGEST - 1)).collect()
    total = max([r["f"] for r in top if r["h"] == 0], default=0)
    return np.array(sorted(r["h"] for r in top if r["h"] != 0 and r["f"] * 1024 > total), dtype=np.int64).view(np.uint64)


def frequent(docs: DataFrame, least: int = 100, dictionary: int = 1 << 20, per_task: int = 1 << 18, sample: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frequent words (lang, word, f, id), the frequent phrases of 2 to LONGEST words (ids, f), and all words of each language (lang, n)."""
    spark = docs.sparkSession
    counts = cut(word_counts(docs), "phrase-words")
    often = counts.where(F.col("f") >= least)
    head = often.orderBy(F.desc("f"), "lang", "word").limit(dictionary).select("lang", "word", "f").toArrow()
    rows = list(zip(head["lang"].to_pylist(), head["word"].to_pylist(), strict=True))
    known = Dictionary(rows, len(rows) < dictionary)
    named = spark.createDataFrame(head.append_column("id", pa.array(range(1, len(rows) + 1), pa.int64()))) if rows else often.select("lang", "word", "f", F.lit(0).cast("long").alias("id")).limit(0)
    if not known.whole:
        tail = often.join(named.select("lang", "word").hint("merge"), ["lang", "word"], "left_anti")
        named = named.unionByName(tail.withColumn("id", _hashed(F.col("lang"), F.col("word"))))
    named = cut(named, "phrase-named")
    totals = cut(counts.groupBy("lang").agg(F.sum("f").alias("n")), "phrase-totals")
    drop_cut(counts)

    parts = 1 + int(named.agg(F.sum("f")).first()[0] or 0) // per_task
    heavy = _heavy(docs, known, docs.count(), sample)
    kind = StructType.fromDDL("part bigint, size bigint, packed binary")
    arrow = to_arrow_schema(kind)
    dealt = _texts(docs).mapInArrow(lambda batches: _dealt(batches, arrow, known, heavy, parts), kind)

    out = StructType.fromDDL("ids array<bigint>, f bigint")
    out_arrow = to_arrow_schema(out)

    def task(table: pa.Table) -> pa.Table:
        blobs = [_unpack(s.as_py(), p.as_py()) for s, p in zip(table["size"], table["packed"], strict=True)]
        found = grow(*_merged(np.concatenate([r for r, _ in blobs]), np.concatenate([w for _, w in blobs])), least, heavy)
        return pa.Table.from_arrays([pa.array([p for p, _ in found], out_arrow[0].type), pa.array([f for _, f in found], out_arrow[1].type)], schema=out_arrow)

    grown = dealt.groupBy("part").applyInArrow(task, out)
    phrases = grown.groupBy("ids").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    return named, cut(phrases, "phrase-found"), totals


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, **options: int) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A cut after k words scores floor(1000 a n / (l r)), in decimals of 38 digits; the lowest cut counts, ties to the smallest k. Phrases inside
    a longer one that occurs as often are dropped. Order: score, a, phrase.
    """
    named, phrases, totals = frequent(docs, least, **options)
    words = named.select(F.array("id").alias("ids"), "f")
    parts = phrases.union(words)
    ends = named.join(totals.hint("merge"), "lang").select(F.col("id").alias("head"), "lang", "n")

    longer = phrases.where("size(ids) > 2")
    around = longer.select(F.slice("ids", 1, F.size("ids") - 1).alias("ids"), "f").union(longer.select(F.slice("ids", 2, F.size("ids")).alias("ids"), "f"))
    around = around.groupBy("ids").agg(F.max("f").alias("most"))
    own = phrases.join(around.hint("merge"), "ids", "left").where("most IS NULL OR most < f").select("ids", F.col("f").alias("a"))
    own = own.withColumn("head", F.col("ids")[0]).join(ends.hint("merge"), "head").drop("head")

    cuts = own.select("*", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    left = parts.select(F.col("ids").alias("left_ids"), F.col("f").alias("l"))
    right = parts.select(F.col("ids").alias("right_ids"), F.col("f").alias("r"))
    cuts = cuts.withColumns({"left_ids": F.slice("ids", F.lit(1), F.col("k")), "right_ids": F.slice("ids", F.col("k") + 1, F.size("ids"))})
    cuts = cuts.join(left.hint("merge"), "left_ids").join(right.hint("merge"), "right_ids")
    d = {c: f"CAST({c} AS DECIMAL(19, 0))" for c in "anlr"}
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(4, 0)) * {d['a']} * {d['n']}) DIV ({d['l']} * {d['r']})")
    scored = cuts.withColumn("score", score).groupBy("lang", "ids", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("worst"))
    scored = scored.select("lang", "ids", "a", "n", "worst.score", "worst.l", "worst.r")

    spelt = scored.select("ids", F.posexplode("ids").alias("at", "id")).join(named.select("id", "word").hint("merge"), "id")
    spelt = spelt.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    found = scored.join(spelt.hint("merge"), "ids").drop("ids")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each share of a language first, so that no task orders all of its phrases
    salt = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = W.Window.partitionBy("lang", "salt").orderBy(*order)
    found = found.withColumn("salt", salt).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).drop("salt")
    found = found.withColumn("rank", F.row_number().over(W.Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
