"""Byte-level BPE: encoding by ranked merges and decoding.

Texts fall into the pieces of ``PATTERN``, found for whole chunks of texts at once from the classes of
their code points. Each chunk hands on its distinct pieces only
(those of a fixed list of frequent ones apart), and Spark's higher-order functions
encode them: a literal map of ranks names the tokens within the bytes of a piece, and a fold over them in
the order of rank, then place, takes each whose two halves are parts at that time. For the vocabulary of a byte pair
encoding this one pass is the usual loop: a token of a lower rank can't become possible by a later merge, since
within its bytes nothing has happened that does not happen in the token alone. ``Vocabulary`` proves that of
every token and refuses other lists. Pieces of more than ``SHORT`` bytes are strings of one character
for each token, and a round replaces all pairs of the least rank. Nothing is shuffled.

Null texts count as empty and have no tokens; null and repeated ids stay, a row of output for each row.
A text is never divided, whatever its length.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import sys
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from chronofold.llm.kernels import buffers, chunks
from chronofold.llm.runtime import fresh

#: The pieces that ``pieces`` finds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text whose distinct pieces are encoded together (a longer text is a chunk of its own).
CHUNK = 1 << 22
#: Bytes of text that are cut into pieces at once.
STEP = 1 << 21
#: Bytes of a piece whose boundaries fit the bits of a long.
SHORT = 56
#: Documents that the frequent pieces are taken from, and how many of these pieces tasks hold.
SAMPLE, HEAD = 1 << 15, 1 << 18
BUCKETS = 1 << 16
#: Places in each half of the table of ranks.
SLOTS = 1 << 16
#: First of the characters that stand for tokens in long pieces; the planes from here on have no surrogates.
FIRST = 0x10000


class Vocabulary:
    """Tokens (bytes) by rank, which is their id."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([i]) not in ranks for i in range(256)) or len(set(ranks.values())) != len(ranks):
            raise ValueError("every byte must be a token, and ranks must differ")
        if max(ranks.values()) >= sys.maxunicode - FIRST:
            raise ValueError("too many tokens")
        self.ranks = ranks
        for token in ranks:
            if not self._own(token):
                raise ValueError(f"{token!r} is not reached by merges of rising rank: not a byte pair encoding")

    @classmethod
    def read(cls, lines: str) -> Vocabulary:
        """From lines of base64 token, blank, rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(str.split, lines.splitlines()) if a})

    def _own(self, token: bytes) -> bool:
        parts, last = [token[i : i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            rank, i = min((self.ranks.get(a + b, sys.maxsize), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank < last or rank == sys.maxsize:
                return False
            last = rank
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return last <= self.ranks[token]

    @functools.cached_property
    def tokens(self) -> pa.LargeBinaryArray:
        """Bytes by id; ids that no token has are empty."""
        held = [b""] * (max(self.ranks.values()) + 1)
        for token, i in self.ranks.items():
            held[i] = token
        return pa.array(held, pa.large_binary())

    def spans(self, n: int) -> list[tuple[int, int]]:
        """(start, length) of the spans of a piece of n bytes that may be tokens of two bytes or more."""
        most = max(map(len, self.ranks))
        return [(i, size) for i in range(n) for size in range(2, min(most, n - i) + 1)]


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: 0 other, 1 letter, 2 number, 3 white space."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for i in range(sys.maxunicode + 1):
        if (c := unicodedata.category(chr(i))[0]) in "LN":
            out[i] = 1 if c == "L" else 2
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
    return out


def pieces(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts raw[offsets[i] : offsets[i + 1]] begin (bytes)."""
    place = np.flatnonzero((raw & 0xC0) != 0x80)
    point = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    n = len(point)
    if not n:
        return place
    kind = _classes()[point]
    first = np.zeros(n + 1, dtype=bool)
    first[np.searchsorted(place, offsets)] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last of the white space before other text stands alone, or is the blank that leads the next piece
    after = np.flatnonzero(start[1:] & ~first[1:n] & (kind[:-1] == 3)) + 1
    start[after - 1] = True
    start[after[point[after - 1] == 0x20]] = False
    # an apostrophe that begins a piece takes s, t, m, d, re, ve or ll with it
    q = np.flatnonzero(start[:-1] & (point[:-1] == 0x27) & (kind[1:] == 1) & ~first[1:n])
    one = np.isin(point[q + 1], [ord(c) for c in "stmd"])
    follows = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], point[np.minimum(q + 2, n - 1)], 0)
    two = np.zeros(len(q), dtype=bool)
    for a, b in ("re", "ve", "ll"):
        two |= (point[q + 1] == ord(a)) & (follows == ord(b))
    start[q[one | two] + 1] = False
    rest = np.concatenate([q[one] + 2, q[two] + 3])
    start[rest[rest < n]] = True
    return place[start]


def _split(rows: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Pieces of each text, and all of them; found some texts at a time."""
    begins, at = [], 0
    while at < len(offsets) - 1:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + STEP, side="right")) - 1)
        begins.append(pieces(raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]) + offsets[at])
        at = end
    bounds = np.append(np.concatenate(begins), len(raw)).astype(np.int64)
    held = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw)))
    return np.diff(np.searchsorted(bounds[:-1], offsets)), held.dictionary_encode()


def _distinct(batches: Iterator[pa.RecordBatch], schema: pa.Schema, head: pa.Array) -> Iterator[pa.RecordBatch]:
    """A row for each chunk: ids, pieces of each text, places of the pieces among the distinct ones (those of ``head``, then short, then long), and the last two."""
    for batch in batches:
        for rows, raw, offsets in chunks(batch, "text", CHUNK):
            counts, held = _split(rows, raw, offsets)
            known = np.asarray(pc.fill_null(pc.index_in(held.dictionary, value_set=head), -1)).astype(np.int32)
            long = np.asarray(pc.binary_length(held.dictionary)) > SHORT
            new = np.argsort(np.where(known >= 0, 2, long), kind="stable")[: int((known < 0).sum())]
            known[new] = len(head) + np.arange(len(new), dtype=np.int32)
            words, few = held.dictionary.take(pa.array(new)).cast(pa.string()), len(new) - int(long[new].sum())
            row = [rows.column(0), pa.array(counts, pa.int64()), pa.array(known[np.asarray(held.indices)], pa.int32()), words[:few], words[few:]]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x).cast(f.type) for x, f in zip(row, schema, strict=True)], schema=schema)


def _sampled(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, raw, offsets in chunks(batch, "text", CHUNK):
            held = _split(rows, raw, offsets)[1]
            f = np.bincount(np.asarray(held.indices), minlength=len(held.dictionary))
            yield pa.RecordBatch.from_arrays([held.dictionary.cast(pa.string()), pa.array(f, pa.int64())], schema=schema)


def _let(x: Column, f) -> Column:
    """f(x), with x evaluated once."""
    return F.transform(F.array(x), f)[0]


def _placed(keys: dict[int, int]) -> tuple[list[int | None], list[int | None]]:
    """Keys, and what they stand for, in places of a table: each in one of the two that ``_sought`` looks at. Keys that find none move others on to their second place."""
    held: list[int | None] = [None] * (2 * SLOTS)
    for key in keys:
        at, moves = key % SLOTS, 0
        while key is not None:
            held[at], key = key, held[at]
            if key is not None:
                first, second = key % SLOTS, SLOTS + (key >> 17) % SLOTS
                at = second if at == first else first
                if (moves := moves + 1) > 1000:
                    raise ValueError("too many tokens for the table")
    return held, [None if key is None else keys[key] for key in held]


def _literal(vocabulary: Vocabulary) -> Column:
    """The ranks as one literal: ``keys`` and ``ranks`` are a map by the 64-bit hash of a token, laid out in places since Spark searches a map from its front.

    For pieces of n bytes there are ``spans[n]`` (start and length), ``ends[n]`` and ``inner[n]``, bits of the boundaries at and inside each span, and ``all[n]``.
    Two texts of one hash would give a part that is no token, which ``_tokens`` refuses.
    """
    hashed = lambda token: (xxhash.xxh64_intdigest(token.decode("latin-1").encode(), 42) ^ 1 << 63) - (1 << 63)
    by_hash = {hashed(t): r for t, r in vocabulary.ranks.items() if len(t) > 1}
    if len(by_hash) + 256 != len(vocabulary.ranks):
        raise ValueError("two tokens have one hash")
    keys, ranks = _placed(by_hash)
    spans = [vocabulary.spans(n) for n in range(SHORT + 1)]
    held = {
        "keys": keys,
        "ranks": ranks,
        "spans": [[{"s": i + 1, "l": size} for i, size in s] for s in spans],
        "ends": [[1 << i | 1 << i + size for i, size in s] for s in spans],
        "inner": [[(1 << i + size) - (2 << i) for i, size in s] for s in spans],
        "all": [(2 << n) - 1 for n in range(SHORT + 1)],
    }
    kind = "keys array<bigint>, ranks array<bigint>, spans array<array<struct<s:int,l:int>>>, ends array<array<bigint>>, inner array<array<bigint>>, all array<bigint>"
    return F.from_json(F.lit(json.dumps(held, separators=(",", ":"))), kind)


def _bytes(word: Column) -> Column:
    """A string of one character for each byte of the UTF-8 form."""
    return F.decode(F.encode(word, "utf-8"), "iso-8859-1")


def _sought(held: Column, key: Column) -> Column:
    """The rank of a token by its hash, null for other bytes."""
    first, second = key.bitwiseAND(SLOTS - 1).cast("int"), F.shiftright(key, 17).bitwiseAND(SLOTS - 1).cast("int") + SLOTS
    return F.when(F.get(held["keys"], first) == key, F.get(held["ranks"], first)).when(F.get(held["keys"], second) == key, F.get(held["ranks"], second))


def boundaries(held: Column, word: Column) -> Column:
    """Bits of the boundaries between the tokens of a piece of at most ``SHORT`` bytes: bit i is set where a token begins or ends at byte i."""
    n = F.octet_length(word)
    many = 1 << 12

    def of(text: Column) -> Column:
        hashes = F.transform(F.get(held["spans"], n), lambda s: F.xxhash64(F.substring(text, s["s"], s["l"])))
        merges = F.sort_array(F.array_compact(F.transform(hashes, lambda h, at: _sought(held, h) * many + at)))

        def fold(masks: Column) -> Column:
            def merge(parts: Column, m: Column) -> Column:
                at = m.bitwiseAND(many - 1).cast("int")
                ends, inner = F.get(masks["ends"], at), F.get(masks["inner"], at)
                whole = (parts.bitwiseAND(ends) == ends) & (F.bit_count(parts.bitwiseAND(inner)) == 1)
                return F.when(whole, parts.bitwiseAND(F.bitwise_not(inner))).otherwise(parts)

            return F.aggregate(merges, F.get(held["all"], n), merge)

        return _let(F.struct(F.get(held["ends"], n).alias("ends"), F.get(held["inner"], n).alias("inner")), fold)

    return _let(_bytes(word), of)


def _rounds(held: Column, word: Column, vocabulary: Vocabulary) -> Column:
    """A long piece as a string of one character, FIRST + id, for each token: rounds that replace the pairs of the least rank."""
    one = "".join(chr(FIRST + vocabulary.ranks[bytes([i])]) for i in range(256))
    start = F.translate(_bytes(word), "".join(map(chr, range(256))), one)
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(word)), F.struct(start.alias("s"), F.lit(True).alias("more")), lambda acc, _: F.when(acc["more"], _round(held, acc["s"])).otherwise(acc), lambda acc: acc["s"])


def _round(held: Column, s: Column) -> Column:
    def of(parts: Column) -> Column:
        n = F.size(parts)
        pairs = F.zip_with(F.slice(parts, 1, F.greatest(n - 1, F.lit(0))), F.slice(parts, 2, n), lambda a, b: F.concat(a, b))

        def best(pairs: Column) -> Column:
            found = F.array_compact(F.transform(F.array_distinct(pairs), lambda p: _let(F.element_at(F.get(held["pairs"], F.crc32(p).bitwiseAND(BUCKETS - 1).cast("int")), p), lambda to: F.when(to.isNotNull(), F.struct(to.alias("to"), p.alias("p"))))))
            return _let(F.array_min(found), lambda b: F.when(b.isNull(), F.struct(s.alias("s"), F.lit(False).alias("more"))).otherwise(F.struct(F.replace(s, b["p"], b["to"]).alias("s"), F.lit(True).alias("more"))))

        return _let(pairs, best)

    return _let(F.split(s, F.lit("")), of)


def _pairs(vocabulary: Vocabulary) -> Column:
    """Every pair of tokens that together are a token, as two characters, with the character of that token; in buckets as the ranks are."""
    buckets: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for token, rank in vocabulary.ranks.items():
        for k in range(1, len(token)):
            a, b = vocabulary.ranks.get(token[:k]), vocabulary.ranks.get(token[k:])
            if a is not None and b is not None:
                key = chr(FIRST + a) + chr(FIRST + b)
                buckets[zlib.crc32(key.encode()) % BUCKETS][key] = chr(FIRST + rank)
    return F.from_json(F.lit(json.dumps({"pairs": [b or None for b in buckets]}, ensure_ascii=False, separators=(",", ":"))), "pairs array<map<string,string>>")


def _tokens(words: pa.Array, cuts: pa.Array, long: pa.Array, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all pieces, one after another, and how many each has."""
    data, base = buffers(words)
    bits = np.unpackbits(np.asarray(cuts).astype(np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    word, at = np.nonzero(bits)
    inside = at < np.diff(base)[word]
    word, at = word[inside], at[inside]
    bounds = np.append(base[word] + at, base[-1]).astype(np.int64)
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(word), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    more = [np.frombuffer(x.encode("utf-32-le"), dtype=np.uint32).astype(np.int32) - FIRST for x in long.to_pylist()]
    ids = pc.index_in(parts, value_set=tokens)
    if ids.null_count:
        raise ValueError("a part is no token: two texts have one hash")
    flat = np.concatenate([np.asarray(ids).astype(np.int32), *more])
    return flat, np.concatenate([np.bincount(word, minlength=len(words)), [len(m) for m in more]]).astype(np.int64)


def _assembled(batches: Iterator[pa.RecordBatch], tokens: pa.Array, head: tuple[np.ndarray, np.ndarray], finish) -> Iterator[pa.RecordBatch]:
    """finish(ids, lists of token ids) for each chunk's texts, the token ids in the order of the pieces."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids, counts, places, *words = (batch.column(i)[r].values for i in range(6))
            flat, number = (np.concatenate(x) for x in zip(head, _tokens(words[0], words[2], words[1], tokens), strict=True))
            first, text, places = np.cumsum(number) - number, np.concatenate([[0], np.cumsum(np.asarray(counts))]), np.asarray(places)
            size = number[places]
            ends = np.concatenate([[0], np.cumsum(size)])
            out = flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - first[places], size)]
            yield finish(ids, pa.LargeListArray.from_arrays(pa.array(ends[text], pa.int64()), pa.array(out, pa.int32())))


def _folded(found: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``found`` with the boundaries in each of ``words`` as ``cuts``, and with each of ``long`` in characters of its tokens."""
    cuts = _let(_literal(vocabulary), lambda held: F.transform(F.col("words"), lambda w: boundaries(held, w)))
    long = F.when(F.size("long") > 0, _let(_pairs(vocabulary), lambda held: F.transform(F.col("long"), lambda w: _rounds(held, w, vocabulary)))).otherwise(F.array().cast("array<string>"))
    return found.withColumns({"cuts": cuts, "long": long})


def _head(rows: DataFrame, vocabulary: Vocabulary, sample: int, most: int) -> tuple[pa.Array, tuple[np.ndarray, np.ndarray]]:
    """The most frequent short pieces of a sample, and their ids."""
    kind = StructType.fromDDL("word string, f bigint")
    arrow, documents = to_arrow_schema(kind), rows.count()
    some = rows if documents <= sample else rows.sample(sample / documents, seed=11)
    counts = some.mapInArrow(lambda batches: _sampled(batches, arrow), kind).groupBy("word").agg(F.sum("f").alias("f"))
    often = counts.where((F.col("f") > 1) & (F.octet_length("word") <= SHORT)).orderBy(F.desc("f"), "word").limit(most).repartition(64, "word")
    held = _folded(often.select(F.array("word").alias("words"), F.array().cast("array<string>").alias("long")), vocabulary).select(F.col("words")[0].alias("word"), F.col("cuts")[0].alias("cut")).toArrow()
    words = held["word"].combine_chunks().cast(pa.large_string())
    return words, _tokens(words, held["cut"].combine_chunks(), pa.array([], pa.string()), vocabulary.tokens)


def _encoded(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str, columns: str, finish, sample: int, head: int) -> DataFrame:
    rows = fresh(docs, id_col, text_col).toDF("id", "text")
    kind = rows.schema["id"].dataType.simpleString()
    first = StructType.fromDDL(f"ids array<{kind}>, counts array<bigint>, places array<int>, words array<string>, long array<string>")
    last = StructType.fromDDL(f"id {kind}, {columns}")
    first_arrow, last_arrow, tokens = to_arrow_schema(first), to_arrow_schema(last), vocabulary.tokens
    known, encoded = _head(rows, vocabulary, sample, head)
    found = rows.mapInArrow(lambda batches: _distinct(batches, first_arrow, known), first)
    found = _folded(found, vocabulary).select("ids", "counts", "places", "words", "long", "cuts")
    done = lambda ids, lists: pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip((ids, *finish(lists)), last_arrow, strict=True)], schema=last_arrow)
    return found.mapInArrow(lambda batches: _assembled(batches, tokens, encoded, done), last).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, head: int = HEAD) -> DataFrame:
    """(id, ids array<int>) for each row: the token ids of its text, without special tokens. Other columns of ``docs`` are not read.

    The ``head`` most frequent pieces of about ``sample`` documents are encoded once and sent to all tasks; they only save work.
    """
    return _encoded(docs, vocabulary, id_col, text_col, "ids array<int>", lambda lists: [lists], sample, head)


def joined(lists: pa.Array, pieces: pa.Array) -> pa.LargeBinaryArray:
    """For each list of ids their binary pieces, concatenated; null for null."""
    held = pieces.take(lists.flatten())
    data = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8)
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.binary_length(held)))])
    sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
    text = ends[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int64)
    out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(text), pa.py_buffer(np.ascontiguousarray(data))])
    return pc.if_else(lists.is_null(), None, out) if lists.null_count else out


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that its ids stand for: their binary pieces, concatenated. Null ids give null."""
    tokens = vocabulary.tokens

    @F.arrow_udf("binary")
    def of(ids: pa.Array) -> pa.Array:
        return joined(ids.cast(pa.large_list(pa.int64())), tokens).cast(pa.binary())

    return encoded.withColumn(out_col, of(ids_col))


def digests(docs: DataFrame, vocabulary: Vocabulary, sample: int = SAMPLE, head: int = HEAD) -> DataFrame:
    """doc_id, number of ids, SHA-256 of the ids in decimal joined by commas, and of the bytes that they decode to.

    The same as of ``decode(encode(docs))``, taken in the task that encodes, so that the ids needn't travel.
    """
    tokens = vocabulary.tokens
    decimal = pa.array([f"{i},".encode() for i in range(len(tokens))], pa.large_binary())

    def finish(lists: pa.Array) -> list[pa.Array]:
        sha = lambda held, cut: pa.array([hashlib.sha256(b[: max(0, len(b) - cut)]).hexdigest() for b in held.to_pylist()], pa.string())
        return [pc.list_value_length(lists), sha(joined(lists, decimal), 1), sha(joined(lists, tokens), 0)]

    return _encoded(docs, vocabulary, "doc_id", "text", "n_tokens bigint, ids_sha256 string, decoded_sha256 string", finish, sample, head)
