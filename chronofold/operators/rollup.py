"""The monthly rollup as a kept table: only months that changed are computed again.

A refresh reads the observations of its months, which the scan prunes by ts, computes them whole and exchanges them for what was kept, in one commit
(see ``store``). So each kept month equals the rollup over all observations, late restatements included, and a repeated or broken-off refresh does no harm.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.operators.analytics import monthly_rollup
from chronofold.operators.store import Store
from chronofold.operators.temporal import moment


def _first(day: dt.datetime) -> dt.datetime:
    return day.replace(day=1, hour=0, minute=0, second=0, microsecond=0)


def _next(month: dt.datetime) -> dt.datetime:
    return (month + dt.timedelta(days=32)).replace(day=1)


def window_months(now: dt.datetime, oldest: dt.timedelta = dt.timedelta(days=365), newest: dt.timedelta = dt.timedelta(days=1)) -> list[dt.datetime]:
    """The months that lie wholly between ``oldest`` and ``newest`` before ``now``: what a scheduled refresh looks at."""
    lo, hi = now - oldest, now - newest
    month = _first(lo) if _first(lo) == lo else _next(_first(lo))
    out = []
    while _next(month) <= hi:
        out.append(month)
        month = _next(month)
    return out


class Monthly(Store):
    """One row for each series and month: last value, mean, least, most and number."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        super().__init__(spark, root, {"month": ("series_id bigint, month timestamp_ntz, last_value double, avg_value double, min_value double, max_value double, n bigint", ("month",))}, buckets)

    def rows(self) -> DataFrame:
        return self.read("month")

    def changed(self, arrived: DataFrame, within: list[dt.datetime] | None = None) -> list[dt.datetime]:
        """The months that newly arrived observations fall into, of those in ``within`` if given. A month is one row here, however many observations it has."""
        found = sorted(r[0] for r in arrived.where("ts IS NOT NULL").select(F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).distinct().collect())
        return found if within is None else [m for m in found if m in within]

    def refresh(self, observations: DataFrame, months: list[dt.datetime]) -> int:
        """Compute ``months`` again from all observations; the number of rows they have now. Other months aren't read or written, but for those that share a bucket."""
        if not months:
            return 0
        spans = F.lit(False)
        for m in months:
            spans = spans | ((F.col("ts") >= moment(m)) & (F.col("ts") < moment(_next(m))))
        new = monthly_rollup(observations.where(spans)).persist()
        try:
            asked = self.spark.createDataFrame([(m,) for m in months], "month timestamp_ntz")
            buckets = self.touched(asked, "month")
            others = self.read("month", buckets).join(asked, "month", "left_anti")
            self.commit(uuid.uuid4().hex, {"month": new.unionByName(others)}, remove=self.files("month", buckets))
            return new.count()
        finally:
            new.unpersist()
