"""Vectorised text kernels over Arrow string buffers.

A chunk of texts is one byte buffer with offsets, as Arrow holds it. Words, word
hashes, shingles and rolling window hashes of all texts in a chunk are computed
with a fixed number of NumPy passes, so cost per text is small and memory is a
constant number of bytes per byte of the chunk. Chunks are cut by bytes
(``chunks``); a text is never divided, whatever its length.

Words are hashed in blocks of eight bytes, each followed by a 64-bit mixer; long words
by BLAKE2. Rolling hashes of byte windows are polynomials modulo 2**64 with an odd base: fit for
windows of a few hundred bytes, not for spans of a thousand and more, where regular
(Thue-Morse) texts are equal under every base. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of plain words: space and the ASCII white space 0x09 to 0x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Separators of bare words: every ASCII byte that is neither a letter nor a digit.
PUNCT = np.zeros(256, dtype=bool)
PUNCT[:128] = True
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = False

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, i < n at least, modulo 2**64."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for b in (int(base), pow(int(base), -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = _powers[int(base)] = (out[0], out[1])
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls become empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``limit`` bytes of text each: (rows, bytes, offsets)."""
    raw, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, len(offsets) - 1
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at), raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


LONG = 64
_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], dtype=np.uint64)


def _hashed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of raw[start:end] for each span."""
    held = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    eight = np.ndarray((len(raw) + 1,), dtype="<u8", buffer=held, strides=(1,))
    length = end - start
    out = mix(length.astype(np.uint64) * BASE)
    for at in range(0, LONG, 8):
        there = np.flatnonzero((length > at) & (length <= LONG))
        if not len(there):
            break
        block = eight[start[there] + at] & _BYTES[np.minimum(length[there] - at, 8)]
        out[there] = mix(out[there] ^ block)
    for i in np.flatnonzero(length > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """Words of a chunk: start, end (bytes), doc (row of the chunk) and hash of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        n = len(raw)
        self.docs = len(offsets) - 1
        low = _LOWER[raw]
        inside = ~separators[raw]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | first[1:n]
        ends = inside
        ends[:-1] &= ~inside[1:] | first[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = _hashed(low, self.start, self.end)
        self.first = np.searchsorted(self.doc, np.arange(self.docs + 1))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of k words, with the word each begins at; a text of fewer words (but one) gives its whole run."""
        h, n = self.hash, len(self.hash)
        out = np.zeros(n, dtype=np.uint64)
        width = np.minimum(self.first[self.doc + 1] - np.arange(n), k)
        factor = powers(BASE2, k + 2)[0]
        for j in range(k):
            there = np.flatnonzero(width > j)
            out[there] += h[there + j] * factor[j + 1]
        count = np.diff(self.first)
        whole = (width == k) | ((np.arange(n) == self.first[self.doc]) & (count[self.doc] < k))
        at = np.flatnonzero(whole)
        return mix(out[at] + width[at].astype(np.uint64) * factor[k + 1]), at


def windows(raw: np.ndarray, width: int, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of raw[i : i + width] for each i; empty if raw is shorter."""
    n = len(raw)
    if n < width:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = powers(base, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    return mix((sums[width:] - sums[: n - width + 1]) * inverse[: n - width + 1])


def prefix_hash(raw: np.ndarray, base: np.uint64) -> np.ndarray:
    """Prefix sums from which ``span_hash`` takes the hash of any span."""
    power, _ = powers(base, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, base: np.uint64, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(base, len(sums) + 1)
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """min(x[i : i + w]) for each i with a full window, in linear time."""
    n = len(x)
    if n < w:
        return x[:0]
    pad = (-n) % w
    top = np.iinfo(x.dtype).max
    y = np.concatenate([x, np.full(pad, top, dtype=x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])
