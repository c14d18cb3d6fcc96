"""What several findings read of one table, each gathered once.

A ``TableFacts`` computes a part when an operator first asks for it and keeps it: one row per
column on the driver, anything that grows with the data (segments, periods, pairs) as a written
frame. Operators that share the object share its scans, so a dashboard of a dozen findings
reads the table six times: values per column and row, moments with a rank sketch, exact
quartiles, cells beyond the limits, column pairs, and segments together with periods.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Row, functions as F

from tabulyze.functions.columns import number_sql, numeric_columns, quoted
from tabulyze.functions.storage import discard, written
from tabulyze.operators import anomalies, correlation, segments, timeseries
from tabulyze.operators.kernel import numeric_cells, outside_fences
from tabulyze.operators.quantiles import exact_quantiles, fences_of
from tabulyze.operators.typing import Detection, detect, promote_datetime_hint


class TableFacts:
    """Facts of ``df`` with the time hints of its text columns applied; ``found`` hands in roles
    that were detected with ``whole=True`` before."""

    def __init__(self, df: DataFrame, found: Detection | None = None):
        self.df = promote_datetime_hint(df)
        self._found = found

    @cached_property
    def found(self) -> Detection:
        """Roles, metric and segment with one row of facts per column (two scans)."""
        return detect(self.df, whole=True) if self._found is None else self._found

    @cached_property
    def columns(self) -> dict[str, Row]:
        return self.found.facts

    @property
    def numeric(self) -> list[str]:
        return self.found.of("numeric")

    @cached_property
    def n_rows(self) -> int:
        return next(iter(self.columns.values()))["n_rows"]

    @property
    def distinct_rows(self) -> int:
        return self.found.distinct_rows

    @cached_property
    def fences(self) -> dict:
        """Quartiles and outlier fences of the numeric columns (one scan; their sketch is there)."""
        sketches = {c: self.columns[c] for c in self.numeric if self.columns[c]["sketch"] is not None}
        sizes = {c: self.columns[c]["n"] for c in self.numeric}
        return fences_of(exact_quantiles(self.df, self.numeric, [0.25, 0.75], sizes=sizes, sketches=sketches))

    @cached_property
    def beyond(self) -> dict[str, Row]:
        """Per numeric column: ``outside`` its fences, and ``over`` three deviations (one scan)."""
        open_ = {c: f for c, f in self.fences.items() if f and f[1] > f[0] and self.columns[c]["n"] >= 4}
        cells = numeric_cells(self.df, self.numeric, outside_fences(open_), anomalies.over_threshold(self.columns))
        rows = cells.groupBy("ordinal").agg(F.sum("outside").alias("outside"), F.sum("over").alias("over")).collect()
        return {self.numeric[r["ordinal"]]: r for r in rows}   # one row per column

    @cached_property
    def pairs(self) -> DataFrame:
        """Moments of every pair of number columns, written once (one scan)."""
        every = numeric_columns(self.df)
        means = {c: self.columns[c]["mean"] for c in every}
        return written(correlation.pair_moments(self.df, every, means), "pairs")

    def correlations(self, columns: list[str] | None = None) -> DataFrame:
        """(a, b, a_ordinal, b_ordinal, n, r) of the pairs among ``columns``, the numeric ones by default."""
        columns = self.numeric if columns is None else columns
        own = self.pairs.filter(F.col("a").isin(columns) & F.col("b").isin(columns))
        return correlation.with_r(own)

    def pairs_of(self, target: str) -> DataFrame:
        """The moments of the target's pairs, with the target on side ``a``."""
        turned = {"a": "b", "b": "a", "a_ordinal": "b_ordinal", "b_ordinal": "a_ordinal", "xx": "yy", "yy": "xx",
                  "raw_xx": "raw_yy", "raw_yy": "raw_xx"}
        other = self.pairs.filter(F.col("b") == target)
        other = other.select(*[F.col(turned.get(c, c)).alias(c) for c in other.columns])
        return self.pairs.filter(F.col("a") == target).unionAll(other)

    @cached_property
    def _grouped(self) -> DataFrame:
        """Segments and days of the metric from one scan, written: a day keeps what periods are made of."""
        metric = number_sql(self.df, self.found.metric)
        parts = []
        segment, time = self.found.segment, self.found.time
        kinds = [self.df.schema[segment].dataType.simpleString() if segment else "string",
                 self.df.schema[time].dataType.simpleString() if time else "timestamp"]
        empty = [f"cast(null as {k})" for k in kinds]
        fields = "struct({part} as part, {segment} as segment, {day} as day, {ts} as ts, {v} as v)"
        if segment:
            parts.append(f"if({quoted(segment)} is null, null, " + fields.format(
                part=0, segment=quoted(segment), day="cast(null as date)", ts=empty[1], v=metric) + ")")
        if time:
            parts.append(f"if({quoted(time)} is null or {metric} is null, null, " + fields.format(
                part=1, segment=empty[0], day=f"cast({quoted(time)} as date)", ts=quoted(time), v=metric) + ")")
        cells = self.df.selectExpr(f"inline(array({', '.join(parts)}))").filter("part is not null")
        return written(cells.groupBy("part", "segment", "day").agg(
            F.sum("v").alias("value"), F.count("v").alias("n"), F.min("ts").alias("low"), F.max("ts").alias("high")), "grouped")

    @cached_property
    def segment_sums(self) -> DataFrame | None:
        """(segment, value) of the metric, as ``segments.segment_sums``."""
        if not (self.found.metric and self.found.segment):
            return None
        return self._grouped.filter("part = 0").select("segment", F.coalesce("value", F.lit(0.0)).alias("value"))

    @cached_property
    def trend(self) -> DataFrame | None:
        """The metric over time, as ``timeseries.time_trend``."""
        if not (self.found.metric and self.found.time):
            return None
        return timeseries.trend_of_days(self._grouped.filter("part = 1").select("day", "value", "n", "low", "high"))

    @cached_property
    def concentration(self) -> Row | None:
        """Concentration over the segments and the share of the largest."""
        return None if self.segment_sums is None else segments.concentration_of(self.segment_sums).first()

    @cached_property
    def change(self) -> Row | None:
        """First and last value of the trend with its direction."""
        return None if self.trend is None else timeseries.trend_direction(self.trend).first()

    @cached_property
    def high_pairs(self) -> int:
        """Pairs of numeric columns that correlate at 0.75 or more."""
        return self.correlations().filter("abs(r) >= 0.75").count() if len(self.numeric) >= 2 else 0

    @cached_property
    def ends(self) -> tuple[Row | None, Row | None]:
        """The largest and the smallest segment with value and share."""
        if self.segment_sums is None:
            return None, None
        return tuple(segments.ranked_sums(self.segment_sums, 1, bottom).first() for bottom in (False, True))

    def row(self, **values: str) -> DataFrame:
        """One row of SQL expressions over what the driver holds."""
        return self.df.sparkSession.range(0, 1, 1, 1).selectExpr(*[f"{text} as {name}" for name, text in values.items()])

    def close(self) -> None:
        """Delete the written parts once nothing will read them any more."""
        discard(*[frame for name, frame in vars(self).items() if name in ("pairs", "_grouped")])
