"""Canonical lines from source lines, as a manifest declares them: picks, sums, residuals and formulas.

The manifest is data: one ``Line`` per canonical code. Its rules become one small table, so each source line is
read once whatever the number of codes; formulas and residuals are column expressions over the codes of a key.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = ("pick_first", "sum_components", "residual")
_TERM = re.compile(r"\s*([+-]?)\s*([A-Za-z][\w.]*)")


@dataclass(frozen=True)
class Line:
    """``sources`` in order of preference; a residual is ``parent`` less the ``components`` that are there. ``check`` is a sum that the value should equal."""

    code: str
    statement_type: str
    mode: str | None = None
    sources: tuple[str, ...] = ()
    formula: str | None = None
    parent: str | None = None
    components: tuple[str, ...] = ()
    check: str | None = None

    def __post_init__(self):
        if self.formula is None and self.mode not in MODES:
            raise ValueError(f"{self.code} needs a formula or a mode of {', '.join(MODES)}")
        if self.mode == "residual" and not self.parent:
            raise ValueError(f"{self.code} needs a parent")


def of_statement(lines: DataFrame, statement_type: str | None = None) -> DataFrame:
    """Canonical lines of a statement, or all."""
    return lines if statement_type is None else lines.where(F.col("statement_type") == statement_type)


def terms(formula: str) -> list[tuple[int, str]]:
    """Signed codes of a sum such as ``a.x + a.y - b.z``; anything else is an error."""
    out, at = [], 0
    while at < len(formula.rstrip()):
        m = _TERM.match(formula, at)
        if not m or (out and not m[1]):
            raise ValueError(f"not a sum of codes: {formula}")
        out.append((-1 if m[1] == "-" else 1, m[2]))
        at = m.end()
    return out


def _formula(values: Column, formula: str) -> Column:
    """Null where a code is missing."""
    out = None
    for sign, code in terms(formula):
        x = values[code] * F.lit(sign)
        out = x if out is None else out + x
    return out


def _residual(values: Column, line: Line) -> Column:
    """Null without the parent; components that aren't there take nothing off."""
    out = values[line.parent]
    for code in line.components:
        out = out - F.coalesce(values[code], F.lit(0.0))
    return out


def canonical_values(rows: DataFrame, lines: Sequence[Line], key: Sequence[str], source_col: str = "line_code", value_col: str = "value") -> DataFrame:
    """(key, canonical_code, value, n_sources) of source rows.

    A null value is no value. Of several values of one source the least is taken, so reruns agree. Residuals see picks
    and sums; formulas also see residuals and the formulas listed before them.
    """
    rules = [(x.code, x.mode, s, i) for x in lines for i, s in enumerate(x.sources) if x.formula is None and x.mode != "residual"]
    table = rows.sparkSession.createDataFrame(rules, "canonical_code string, mode string, _source string, _place int")
    x = rows.where(F.col(value_col).isNotNull()).groupBy(*key, F.col(source_col).alias("_source")).agg(F.min(value_col).alias("_value"))
    x = x.join(table, "_source").groupBy(*key, "canonical_code").agg(
        F.when(F.first("mode") == "pick_first", F.min_by("_value", "_place")).otherwise(F.sum("_value")).alias("value"), F.count("*").alias("n_sources")
    )
    got = x.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("canonical_code", "value"))).alias("_values"), F.map_from_entries(F.collect_list(F.struct("canonical_code", "n_sources"))).alias("_n"))
    for line in [x for x in lines if x.mode == "residual"] + [x for x in lines if x.formula]:
        value = _residual(F.col("_values"), line) if line.mode == "residual" else _formula(F.col("_values"), line.formula)
        more = F.map_concat("_values", F.create_map(F.lit(line.code), value))
        got = got.withColumn("_values", F.when(value.isNotNull(), more).otherwise(F.col("_values")))
    out = got.select(*key, "_n", F.explode("_values").alias("canonical_code", "value"))
    return out.select(*key, "canonical_code", "value", F.coalesce(F.col("_n")[F.col("canonical_code")], F.lit(0)).alias("n_sources"))


def from_manifest(manifest: dict) -> list[Line]:
    """Lines of a parsed manifest (see ``sources.files.parse_yaml``), in its order."""
    out = []
    for code, x in (manifest.get("lines") or manifest).items():
        out.append(Line(code, x["statement_type"], x.get("aggregation_mode"), tuple(x.get("sources") or ()), x.get("formula"), x.get("parent"), tuple(x.get("components") or ()), x.get("derived_check")))
    return out


def derived_checks(values: DataFrame, lines: Sequence[Line], key: Sequence[str], tolerance_pct: float = 1.0) -> DataFrame:
    """(key, canonical_code, value, expected, delta_pct, state) of the lines that have a check and the keys that have any value.

    State is unknown where the line or a code of its check is missing, pass within the tolerance (in per cent of what is expected, or none if that is 0), else fail.
    """
    held = values.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("canonical_code", "value"))).alias("_values"))
    checks = [F.struct(F.lit(x.code).alias("canonical_code"), F.col("_values")[x.code].alias("value"), _formula(F.col("_values"), x.check).alias("expected")) for x in lines if x.check]
    if not checks:
        return held.select(*key, F.lit(None).cast("string").alias("canonical_code"), *[F.lit(None).cast(t).alias(c) for c, t in (("value", "double"), ("expected", "double"), ("delta_pct", "double"), ("state", "string"))]).limit(0)
    x = held.select(*key, F.explode(F.array(*checks)).alias("c")).select(*key, "c.*")
    gap = F.abs(F.col("value") - F.col("expected"))
    delta = F.when(F.col("expected") != 0, 100 * gap / F.abs("expected"))
    within = F.when(F.col("expected") != 0, delta <= tolerance_pct).otherwise(gap == 0)
    return x.withColumns({"delta_pct": delta, "state": F.when(gap.isNull(), "unknown").when(within, "pass").otherwise("fail")})
