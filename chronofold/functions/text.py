"""Scalar functions as column expressions: search, normalizers, labels, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words, each padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of both; 0 without any."""
    x, y = trigrams(a), trigrams(b)
    n = F.size(F.array_union(x, y))
    return F.when(n > 0, F.size(F.array_intersect(x, y)) / n).otherwise(F.lit(0.0))


def tax_number(text: Column) -> Column:
    """Ten digits, or null."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(F.length(digits) == 10, digits)


def ticker(text: Column) -> Column:
    return F.upper(F.trim(text))


def isin(text: Column) -> Column:
    out = F.upper(F.trim(text))
    return F.when(F.length(out) == 12, out)


def truncated_ip(ip: Column) -> Column:
    """The /24 of an IPv4 and the /48 of an IPv6 address, zero groups at its end left out; a mark where there is none."""
    v4 = F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))
    groups = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":"))
    left, right = groups(F.substring_index(ip, "::", 1)), groups(F.substring_index(ip, "::", -1))
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right))), right)
    three = F.slice(F.when(ip.contains("::"), filled).otherwise(F.split(ip, ":")), 1, 3)
    bare = F.transform(three, lambda g: F.coalesce(F.nullif(F.ltrim(F.lower(g), F.lit("0")), F.lit("")), F.lit("0")))
    v6 = F.concat(F.regexp_replace(F.array_join(bare, ":"), "(^|:)0(:0)*$", ""), F.lit("::/48"))
    return F.when(ip.isNull(), F.lit("<no client_ip>")).when(ip.contains(":"), v6).otherwise(v4)


def age(seconds: Column) -> Column:
    """12s, 3m 12s, 2h 14m or 7d 3h; 0s below zero."""
    s = F.floor(F.greatest(seconds, F.lit(0))).cast("long")
    two = lambda unit, mark, part, small: F.format_string(f"%d{mark} %d{small}", F.floor(s / unit).cast("long"), F.floor(s % unit / part).cast("long"))
    return F.when(s < 60, F.format_string("%ds", s)).when(s < 3600, two(60, "m", 1, "s")).when(s < 86400, two(3600, "h", 60, "m")).otherwise(two(86400, "d", 3600, "h"))


def size(n: Column) -> Column:
    """Bytes, or KB, MB and GB of 1024 each with one decimal (a tie goes to the even digit)."""
    unit = lambda scale, mark: F.concat(F.format_string("%.1f", F.bround(n / float(scale), 1)), F.lit(mark))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, unit(1024, " KB")).when(n < 1024**3, unit(1024**2, " MB")).otherwise(unit(1024**3, " GB"))


def id_prefix(text: Column, width: int = 8) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("…"))).otherwise(text)


def label(text: Column, closed: list[str], prefixes: dict[str, str] | None = None) -> Column:
    """A bounded label: a member of the closed set, the label of a prefix, or other."""
    out = F.when(text.isin(closed), text)
    for p, name in (prefixes or {}).items():
        out = out.when(text.startswith(p), F.lit(name))
    return out.otherwise(F.lit("other"))


def message_order(message_id: Column) -> Column:
    """A sortable struct of a ``ms-seq`` message id; both parts are unsigned 64-bit numbers."""
    part = lambda i: F.split(message_id, "-")[i].cast("decimal(20,0)")
    return F.struct(part(0).alias("ms"), part(1).alias("seq"))


def next_message_id(message_id: Column) -> Column:
    """The least id after one; the sequence wraps into the next millisecond."""
    at = message_order(message_id)
    full = at["seq"] == F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    ms = F.when(full, at["ms"] + 1).otherwise(at["ms"]).cast("decimal(20,0)").cast("string")
    seq = F.when(full, F.lit(0).cast("decimal(20,0)")).otherwise((at["seq"] + 1).cast("decimal(20,0)")).cast("string")
    return F.concat_ws("-", ms, seq)


def as_json(text: Column) -> Column:
    """Text that is JSON, or the text as a JSON string; null for an empty text."""
    wrapped = F.regexp_extract(F.to_json(F.struct(text.alias("x"))), r'^\{"x":(.*)\}$', 1)
    return F.when(F.trim(text) == "", F.lit("null")).when(F.try_parse_json(text).isNotNull(), text).otherwise(wrapped)


def shortened(text: Column, most: int = 4000) -> Column:
    """At most so many characters of a text."""
    return F.left(text, F.lit(most))


def redaction_keys(event_id: Column) -> Column:
    """The names of an event's redaction lock and cache entry."""
    return F.struct(F.concat(F.lit("streams.redaction:"), event_id).alias("lock"), F.concat(F.lit("streams:redaction_registry:"), event_id).alias("cache"))


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6
