"""Personal data within nested JSON: where it is, whose it is, and scrubbing it there.

JSON is walked by Spark as variants: one level a step, so every string comes with its structured path. Steps beyond ``DEPTH`` levels raise rather
than leave something unseen. Paths are arrays of structs, with a key for objects or an index for lists, so a key of digits
can't be taken for an index. What isn't JSON has no findings.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.functions.personal import PATTERNS, concerns

DEPTH = 12
STEP = "struct<key:string,index:int>"
#: Top-level keys that hold references to persons by design.
SKIPPED = ("subjects",)


_MEMBERS, _ITEMS = "try_cast(value AS MAP<STRING, VARIANT>)", "try_cast(value AS ARRAY<VARIANT>)"
_HAS_MEMBERS, _HAS_ITEMS = f"coalesce(cardinality({_MEMBERS}), 0) > 0", f"coalesce(cardinality({_ITEMS}), 0) > 0"


def _children() -> Column:
    """(path, value) of what the object or list in ``value`` holds; of itself for anything else and for empty ones."""
    path, row = F.col("path"), lambda p, v: F.struct(p.alias("path"), v.alias("value"))
    step = lambda key, index: F.array(F.struct(key.cast("string").alias("key"), index.cast("int").alias("index")))
    of_map = F.transform(F.map_entries(F.expr(_MEMBERS)), lambda e: row(F.concat(path, step(e["key"], F.lit(None))), e["value"]))
    of_list = F.transform(F.expr(_ITEMS), lambda v, i: row(F.concat(path, step(F.lit(None), i)), v))
    return F.when(F.expr(_HAS_MEMBERS), of_map).when(F.expr(_HAS_ITEMS), of_list).otherwise(F.array(row(path, F.col("value"))))


def leaves(df: DataFrame, json_col: str, depth: int = DEPTH) -> DataFrame:
    """``df``, without the JSON, with a row for each value in it that holds no others: path and value (a variant)."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != json_col]
    x = df.select(*keep, F.array().cast(f"array<{STEP}>").alias("path"), F.try_parse_json(F.col(f"`{json_col}`")).alias("value")).where("value IS NOT NULL")
    for _ in range(depth):
        x = x.select(*keep, F.explode(_children()).alias("_n")).select(*keep, "_n.path", "_n.value")
    deeper = F.expr(f"{_HAS_MEMBERS} OR {_HAS_ITEMS}")
    return x.withColumn("value", F.when(deeper, F.raise_error(F.lit(f"JSON of more than {depth} levels")).cast("variant")).otherwise(F.col("value")))


def spans(text: Column, pattern: str) -> Column:
    """(start, end, found) of the non-overlapping matches of a pattern without groups, from the left; ends are exclusive."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = lambda i: F.aggregate(F.slice(between, 1, i + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice(found, 1, i), F.lit(0), lambda n, x: n + F.length(x))
    return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), (start(i) + F.length(m)).alias("end"), m.alias("found")))


def findings(df: DataFrame, json_col: str, subjects: list[str] | None = None, skip: tuple[str, ...] = SKIPPED, depth: int = DEPTH) -> DataFrame:
    """A row for each match in a string of the JSON: path, pattern, start, end, found; below the top-level keys ``skip`` nothing is looked at.

    With ``subjects`` only matches that contain one of these names, or lie in one, whatever their case; an empty list finds nothing.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != json_col]
    x = leaves(df, json_col, depth).withColumn("text", F.when(F.schema_of_variant("value") == "STRING", F.expr("CAST(value AS STRING)"))).where("text IS NOT NULL")
    x = x.where(~F.coalesce(F.get("path", F.lit(0))["key"].isin(list(skip)), F.lit(False))) if skip else x
    named = lambda name: lambda s: F.struct(F.lit(name).alias("pattern"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"))
    each = [F.transform(spans(F.col("text"), f"(?U){p}" if name == "name" else p), named(name)) for name, p in PATTERNS.items()]
    out = x.select(*keep, "path", F.explode(F.concat(*each)).alias("_f")).select(*keep, "path", "_f.*")
    if subjects is None:
        return out
    mine = F.pandas_udf(lambda found: found.map(lambda t: concerns(t, subjects)), "boolean")
    return out.where(mine("found"))


def json_path(path: Column) -> Column:
    """``$.a[0].b``."""
    return F.concat(F.lit("$"), F.array_join(F.transform(path, lambda s: F.when(s["key"].isNotNull(), F.concat(F.lit("."), s["key"])).otherwise(F.concat(F.lit("["), s["index"].cast("string"), F.lit("]")))), ""))


def numeric_keys(df: DataFrame, json_col: str, depth: int = DEPTH) -> DataFrame:
    """A row for each object key of digits only, wherever it is: its path."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != json_col]
    named = keep + [F.col("path")]
    heads = F.transform(F.sequence(F.lit(1), F.size("path")), lambda n: F.slice("path", 1, n))
    x = leaves(df, json_col, depth).where(F.size("path") > 0).select(*keep, F.explode(heads).alias("path"))
    return x.where(F.try_element_at("path", F.lit(-1))["key"].rlike("^[0-9]+$")).select(*named).distinct()


def _scrubbed(text: str | None, found) -> str | None:
    if text is None or found is None or not len(found):
        return text
    value = json.loads(text)
    for f in sorted(found, key=lambda f: -f["start"]):  # from the last on, so the others keep their places
        at, steps = value, [s["key"] if s["key"] is not None else int(s["index"]) for s in f["path"]]
        mark = lambda t, f=f: f"{t[: f['start']]}[REDACTED:Art.17:{f['pattern']}]{t[f['end'] :]}"
        if not steps:
            value = mark(value)
            continue
        for s in steps[:-1]:
            at = at[s]
        at[steps[-1]] = mark(at[steps[-1]])
    return json.dumps(value, ensure_ascii=False)


def scrubbed(df: DataFrame, found: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """``df`` with the findings (as ``findings`` gives them, with the id) marked in its JSON, by path and from the last of a string on; rows without any stay as they are.

    Ids must be unique. Findings of one pattern never overlap; of two that do, the later is marked first.
    """
    per = found.groupBy(id_col).agg(F.collect_list(F.struct("path", "pattern", "start", "end")).alias("_found"))
    run = F.pandas_udf(lambda text, fs: pd.Series([_scrubbed(t, f) for t, f in zip(text, fs, strict=True)], dtype=object), "string")
    return df.join(per, id_col, "left").withColumn(json_col, run(F.col(json_col), F.col("_found"))).drop("_found").select(*df.columns)
