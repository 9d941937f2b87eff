"""Content hashes with a fixed byte layout.

The bytes of a double can't be had from a cast, so they come from an Arrow-batched function; the text hashes
stay in expressions.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DOMAIN = b"obs:v1"


def canonical_json(value) -> str:
    """Sorted keys, NFC strings, no blanks, finite numbers only."""

    def norm(x):
        if isinstance(x, str):
            return unicodedata.normalize("NFC", x)
        if isinstance(x, dict):
            return {norm(str(k)): norm(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [norm(v) for v in x]
        return x

    return json.dumps(norm(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def payload_digest(value: float | None, text: str | None, flag: int, metadata: str | None) -> str:
    """SHA-256 of the tagged fields: the exact bits of the value, the NFC text, the flag and canonical metadata."""
    h = hashlib.sha256(DOMAIN)
    h.update(b"v" if value is None else b"V" + struct.pack(">d", value))
    if text is None:
        h.update(b"t")
    else:
        raw = unicodedata.normalize("NFC", text).encode()
        h.update(b"T" + struct.pack(">I", len(raw)) + raw)
    h.update(b"Q" + struct.pack(">i", flag))
    raw = canonical_json(json.loads(metadata) if metadata else {}).encode()
    h.update(b"M" + struct.pack(">I", len(raw)) + raw)
    return h.hexdigest()


def payload_hash(value: Column, text: Column, flag: Column, metadata: Column) -> Column:
    # Whether a value is there travels apart: a series of doubles can't tell null from NaN.
    def run(there: pd.Series, bits: pd.Series, text: pd.Series, flag: pd.Series, metadata: pd.Series) -> pd.Series:
        return pd.Series([payload_digest(v if ok else None, t, int(q), m) for ok, v, t, q, m in zip(there, bits, text, flag, metadata, strict=True)])

    return F.pandas_udf(run, "string")(value.isNotNull(), F.coalesce(value, F.lit(0.0)), text, flag, metadata)


def value_bits(value: Column) -> Column:
    """The eight bytes of a double, which Parquet would not keep for every NaN."""

    def run(there: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([struct.pack(">d", v) if ok else None for ok, v in zip(there, x, strict=True)])

    return F.pandas_udf(run, "binary")(value.isNotNull(), F.coalesce(value, F.lit(0.0)))


def batch_hash(series_id: int, rows: list[tuple[str, str, str]]) -> str:
    """SHA-256 of (ts, as_of, payload hash) by ts and as_of, each part with its length, after the eight bytes of the series id."""
    h = hashlib.sha256(struct.pack(">Q", series_id))
    for row in sorted(rows, key=lambda r: r[:2]):
        for part in row:
            raw = part.encode()
            h.update(struct.pack(">I", len(raw)) + raw)
    return h.hexdigest()


def batch_digest(series_id: Column, rows: Column) -> Column:
    """``batch_hash`` of an array of (ts, as_of, payload hash) texts, as a column; a batch is bounded by its writer."""
    part = lambda x: F.concat(F.lpad(F.hex(F.octet_length(x)), 8, "0"), F.hex(F.encode(x, "utf-8")))
    body = F.array_join(F.transform(F.array_sort(rows), lambda r: F.concat(part(r["ts"]), part(r["as_of"]), part(r["payload_hash"]))), "")
    return F.sha2(F.unhex(F.concat(F.lpad(F.hex(series_id.cast("long")), 16, "0"), body)), 256)


def filters_hash(filters: dict) -> str:
    return hashlib.sha256(canonical_json(filters).encode()).hexdigest()[:32]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
