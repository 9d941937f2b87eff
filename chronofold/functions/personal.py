"""Personal data in text and nested JSON: detection with spans and paths, scrubbing, key checks."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: An email address; two title-case words, Turkish letters included, with a middle initial or without.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{1,}"
NAME = r"\b[A-ZÇĞİÖŞÜ][a-zçğıöşü]+(?:\s+[A-ZÇĞİÖŞÜ]\.?)?\s+[A-ZÇĞİÖŞÜ][a-zçğıöşü]+\b"
PATTERNS = {"email": EMAIL, "name": NAME}
_COMPILED = {k: re.compile(p) for k, p in PATTERNS.items()}


def matches(text: str) -> list[tuple[str, int, int]]:
    """(pattern, start, end) of all non-overlapping matches of each pattern."""
    return [(k, m.start(), m.end()) for k, p in _COMPILED.items() for m in p.finditer(text)]


def walk(value, path: tuple = ()) -> Iterator[tuple[tuple, str]]:
    """(path, text) of every string in nested JSON, but for a top-level ``subjects``."""
    if isinstance(value, str):
        yield path, value
    elif isinstance(value, dict):
        for k, v in value.items():
            if path or k != "subjects":
                yield from walk(v, (*path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from walk(v, (*path, i))


def json_path(path: tuple) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else f".{p}" for p in path)


def concerns(text: str, subjects: list[str]) -> bool:
    """Whether a match and a subject contain each other, NFC and case-folded."""
    fold = lambda x: unicodedata.normalize("NFC", x).casefold()
    return any(fold(s) in fold(text) or fold(text) in fold(s) for s in subjects if s)


def scrub(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span replaced by a mark, from the last on, so the others keep their places."""
    for kind, a, b in sorted(spans, key=lambda s: -s[1]):
        text = f"{text[:a]}[REDACTED:Art.17:{kind}]{text[b:]}"
    return text


def numeric_keys(value) -> bool:
    """Whether an object in nested JSON has a key of digits only."""
    if isinstance(value, dict):
        return any(re.fullmatch(r"\d+", k) or numeric_keys(v) for k, v in value.items())
    return isinstance(value, list) and any(map(numeric_keys, value))


def redact(value, dotted: str):
    """``value`` with what a dotted path names replaced; number parts index lists, missing paths change nothing."""
    head, _, rest = dotted.partition(".")
    put = lambda v: redact(v, rest) if rest else "<redacted>"
    if isinstance(value, dict) and head in value:
        return {k: put(v) if k == head else v for k, v in value.items()}
    if isinstance(value, list) and head.isdigit() and int(head) < len(value):
        return [put(v) if i == int(head) else v for i, v in enumerate(value)]
    return value


@udtf(returnType="path string, pattern string, start int, end int, found string")
class ScanJson:
    """Table function: every match in a JSON text."""

    def eval(self, text: str):
        try:
            value = json.loads(text) if text else None
        except ValueError:
            return
        for path, leaf in walk(value):
            for kind, a, b in matches(leaf):
                yield json_path(path), kind, a, b, leaf[a:b]


def n_emails(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(EMAIL)), F.lit(0))


def scrubbed_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[REDACTED:Art.17:email]")


def scrub_json(text: Column, dotted: list[str]) -> Column:
    """JSON with the values at dotted paths redacted; what isn't JSON stays."""

    def one(x: str | None) -> str | None:
        try:
            value = json.loads(x) if x else None
        except ValueError:
            return x
        for p in dotted:
            value = redact(value, p)
        return json.dumps(value, ensure_ascii=False) if x else x

    def run(x: pd.Series) -> pd.Series:
        return x.map(one)

    return F.pandas_udf(run, "string")(text)
