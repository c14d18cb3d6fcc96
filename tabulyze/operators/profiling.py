"""Structure, missingness, cardinality and quality scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulyze.functions.columns import (
    columns_of, kind, numeric_columns, percent, pick, rounded, side_by_side, string_columns)
from tabulyze.operators.kernel import (
    distinct_profile, null_counts, numeric_profile, row_counts, top_values)
from tabulyze.operators.quantiles import iqr_fences

# Storage bytes per value of fixed-width types; text counts its UTF-8 bytes.
FIXED_WIDTH = {"boolean": 1, "byte": 1, "short": 2, "integer": 4, "float": 4, "date": 4}


def _bytes(df: DataFrame, field: T.StructField) -> Column:
    if kind(field) == "string":
        return F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0)).cast("long")
    if kind(field) == "other":
        return F.coalesce(F.octet_length(F.to_json(F.struct(f"`{field.name}`"))), F.lit(0)).cast("long")
    return F.lit(FIXED_WIDTH.get(field.dataType.typeName(), 8)).cast("long")


def schema_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, column names per class, memory in MB (booleans count as numeric)."""
    total = sum((_bytes(df, f) for f in df.schema.fields), F.lit(0).cast("long"))
    names = {"numeric_columns": numeric_columns(df, bool_is_numeric=True),
             "categorical_columns": columns_of(df, "string", "other"),
             "datetime_columns": columns_of(df, "datetime")}
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(total).alias("bytes")).select(
        "rows", F.lit(len(df.columns)).alias("columns"),
        *[F.lit(",".join(v)).alias(k) for k, v in names.items()],
        rounded(F.col("bytes") / F.lit(1024.0 * 1024.0), 4).alias("memory_usage_mb"))


def structure_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, number of columns per class, memory in MB."""
    profile = schema_profile(df)
    return profile.select(
        "rows", "columns",
        F.lit(len(numeric_columns(df, bool_is_numeric=True))).alias("numeric_columns"),
        F.lit(len(columns_of(df, "string", "other"))).alias("categorical_columns"),
        F.lit(len(columns_of(df, "datetime"))).alias("datetime_columns"),
        "memory_usage_mb")


def missing_by_column(df: DataFrame, only_missing: bool = False, top: int | None = None) -> DataFrame:
    """Missing count and percent per column, in column order or the worst first."""
    out = null_counts(df).select(
        "column", "ordinal", (F.col("n_rows") - F.col("n")).alias("missing_count"),
        rounded(percent(F.col("n_rows") - F.col("n"), F.col("n_rows")), 2).alias("missing_pct"))
    if only_missing:
        out = out.filter(F.col("missing_count") > 0)
    if top is not None:
        out = out.orderBy(F.col("missing_pct").desc(), "ordinal").limit(top)
    return out


def cardinality(df: DataFrame, count_null: bool = True) -> DataFrame:
    """Distinct values per scalar column, with or without NULL as a value."""
    extra = (F.col("n") < F.col("n_rows")).cast("long") if count_null else F.lit(0)
    return distinct_profile(df).select("column", "ordinal", (F.col("n_distinct") + extra).alias("cardinality"))


def dtype_summary(df: DataFrame) -> DataFrame:
    """Type string per column, next to its number of filled cells."""
    names = [t for _, t in df.dtypes]
    return null_counts(df).select("column", "ordinal", pick(names).alias("dtype"),
                                  F.col("n").alias("filled"))


def missing_cells(df: DataFrame) -> DataFrame:
    """One row: missing_cells, cells."""
    return null_counts(df).agg(F.sum(F.col("n_rows") - F.col("n")).alias("missing_cells"),
                               F.sum("n_rows").alias("cells"))


def metadata_summary(df: DataFrame) -> DataFrame:
    """One row: mean cardinality (1 dp) and missing density (2 dp)."""
    mean = cardinality(df, count_null=False).agg(
        rounded(F.avg("cardinality"), 1).alias("avg_cardinality"))
    density = missing_cells(df).select(
        rounded(percent(F.col("missing_cells"), F.col("cells")), 2).alias("missing_density"))
    return side_by_side(mean, density)


def quality_missing(df: DataFrame) -> DataFrame:
    """One row: missing_pct over all cells."""
    return missing_cells(df).select(percent(F.col("missing_cells"), F.col("cells")).alias("missing_pct"))


def quality_duplicates(df: DataFrame) -> DataFrame:
    """One row: duplicate_pct, rows beyond the first of each full-row group."""
    return row_counts(df).select(
        percent(F.col("n_rows") - F.col("distinct_rows"), F.col("n_rows")).alias("duplicate_pct"))


def outlier_cells(df: DataFrame) -> DataFrame:
    """One row: IQR outliers and the three cell bases the scores divide by."""
    columns = numeric_columns(df)
    if not columns:
        zero = F.lit(0).cast("long")
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            *[zero.alias(n) for n in ("outliers", "cells", "cells_n4", "cells_spread", "outliers_spread")])
    fences = iqr_fences(df, columns)
    spread = [bool(fences[c] and fences[c][1] - fences[c][0] > 0) for c in columns]
    wide = F.col("n") >= 4
    open_ = wide & pick(spread)
    return numeric_profile(df, columns, fences, shape=False).agg(
        F.sum("outliers").alias("outliers"), F.sum("n_rows").alias("cells"),
        F.coalesce(F.sum(F.when(wide, F.col("n"))), F.lit(0)).alias("cells_n4"),
        F.coalesce(F.sum(F.when(open_, F.col("n"))), F.lit(0)).alias("cells_spread"),
        F.coalesce(F.sum(F.when(open_, F.col("outliers"))), F.lit(0)).alias("outliers_spread"))


def quality_outliers(df: DataFrame) -> DataFrame:
    """One row: outlier_pct over all numeric cells, empty ones included."""
    return outlier_cells(df).select(percent(F.col("outliers"), F.col("cells")).alias("outlier_pct"))


def quality_score_weighted(df: DataFrame) -> DataFrame:
    """One row: the three percentages and 100 - (.5 missing + .3 duplicate + .2 outlier)."""
    return side_by_side(quality_missing(df), quality_duplicates(df), quality_outliers(df)).select(
        "missing_pct", "duplicate_pct", "outlier_pct",
        F.greatest(F.lit(0.0), 100 - (0.5 * F.col("missing_pct") + 0.3 * F.col("duplicate_pct")
                                      + 0.2 * F.col("outlier_pct"))).alias("quality_score"))


def quality_score_app(df: DataFrame) -> DataFrame:
    """One row, 2 dp: outliers over filled cells of columns with a spread;
    score 100 - missing - .5 duplicate - .3 outlier."""
    outliers = outlier_cells(df).select(
        percent(F.col("outliers_spread"), F.col("cells_spread")).alias("outlier_pct"))
    parts = side_by_side(quality_missing(df), quality_duplicates(df), outliers)
    score = F.greatest(F.lit(0.0), 100 - F.col("missing_pct") - F.col("duplicate_pct") * 0.5
                       - F.col("outlier_pct") * 0.3)
    return parts.select(rounded("missing_pct", 2).alias("missing_pct"),
                        rounded("duplicate_pct", 2).alias("duplicate_pct"),
                        rounded("outlier_pct", 2).alias("outlier_pct"),
                        rounded(score, 2).alias("quality_score"))


def quality_report(df: DataFrame, numeric: list[str] | None = None) -> DataFrame:
    """One row: the quality section of the exploratory report.

    Outliers are counted in columns with at least four values and a spread,
    over the filled cells of all columns with at least four values.
    """
    columns = numeric_columns(df) if numeric is None else numeric
    kept = [f.name for f in df.schema.fields if kind(f) != "numeric"] + columns
    missing = null_counts(df)
    means = missing.agg(
        F.max("n_rows").alias("row_count"),
        rounded(F.avg((F.col("n_rows") - F.col("n")) / F.col("n_rows")) * 100, 2).alias("missing_pct"),
        F.count(F.when(F.col("n") < F.col("n_rows"), 1)).alias("columns_with_missing"))
    duplicates = quality_duplicates(df).select(rounded("duplicate_pct", 2).alias("duplicate_pct"))
    outliers = outlier_cells(df.select(*[c for c in df.columns if c in kept])).select(
        rounded(percent(F.col("outliers_spread"), F.col("cells_n4")), 2).alias("outlier_pct"))
    return side_by_side(means, duplicates, outliers).select(
        "row_count", F.lit(len(df.columns)).alias("col_count"), "missing_pct", "duplicate_pct",
        "outlier_pct", rounded(100 - F.col("missing_pct"), 2).alias("completeness_score"),
        "columns_with_missing")


def dataset_profile(df: DataFrame, numeric_cap: int | None = None, string_cap: int | None = None) -> DataFrame:
    """(section, column, metric, value) rows: shape, missing and duplicate shares,
    moments of the numeric columns, cardinality of the text columns; the caps keep the first ones."""
    numeric, strings = numeric_columns(df), string_columns(df)
    shape = row_counts(df).select(F.inline(F.array(
        _entry("shape", None, "rows", F.col("n_rows")),
        _entry("shape", None, "columns", F.lit(len(df.columns))),
        _entry("shape", None, "duplicate_pct",
               rounded(percent(F.col("n_rows") - F.col("distinct_rows"), F.col("n_rows")), 2)))))
    missing = null_counts(df).agg(
        rounded(F.avg((F.col("n_rows") - F.col("n")) / F.col("n_rows")) * 100, 2).alias("m")).select(
        F.inline(F.array(_entry("shape", None, "missing_pct", F.col("m")))))
    frames = [shape, missing]
    if numeric:
        profile = numeric_profile(df, numeric)
        frames.append(profile.filter(F.col("ordinal") < len(numeric[:numeric_cap])).select(F.inline(F.array(*[
            _entry("descriptive", F.col("column"), m, rounded(F.col(source), 4))
            for m, source in (("mean", "mean"), ("std", "std"), ("min", "min"), ("max", "max"),
                              ("skew", "skewness"))]))))
        frames.append(profile.agg(F.max_by("column", F.struct(
            F.coalesce("variance", F.lit(0.0)), -F.col("ordinal"))).alias("c"),
            F.max("variance").alias("v")).select(F.inline(F.array(
                _entry("primary_metric", F.col("c"), "variance", rounded("v", 4))))))
    if strings:
        frames.append(top_values(df, strings[:string_cap]).select(F.inline(F.array(
            _entry("cardinality", F.col("column"), "n_distinct", F.col("n_distinct"))))))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _entry(section: str, column, metric: str, measure) -> Column:
    return F.struct(F.lit(section).alias("section"),
                    (F.lit(None) if column is None else column).cast("string").alias("column"),
                    F.lit(metric).alias("metric"), measure.cast("double").alias("value"))


def mini_profile(df: DataFrame, top: int | None = None) -> DataFrame:
    """Means of the numeric columns, or of the first ``top``, with the table's shape."""
    return numeric_profile(df, numeric_columns(df)[:top], shape=False).select(
        "column", F.col("n_rows").alias("rows"), F.lit(len(df.columns)).alias("columns"),
        rounded("mean", 4).alias("mean"))


def dataset_digest(df: DataFrame, numeric_cap: int | None = None, text_cap: int | None = None) -> DataFrame:
    """Text lines (line_no, line): size, column lists, worst gaps, means and deviations, strongest
    pairs, commonest value of every other column, dates and booleans too; the caps keep the first columns."""
    from tabulyze.operators.correlation import correlation_pairs

    numeric = numeric_columns(df)
    other = [c for c in df.columns if c not in numeric]
    listed = lambda names: ", ".join(names) if names else "none"
    missing = (null_counts(df).filter(F.col("n") < F.col("n_rows"))
               .select("column", "ordinal", "n_rows", (F.col("n_rows") - F.col("n")).alias("m"))
               .orderBy(F.col("m").desc(), "ordinal").limit(4))
    shape = df.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(
        _line(1, F.format_string(f"Table of %,d rows and {len(df.columns)} columns", "n")),
        _line(2, F.lit(f"{len(numeric)} number columns: {listed(numeric)}")),
        _line(3, F.lit(f"{len(other)} other columns: {listed(other)}")))))
    frames = [shape, _joined(missing.select(
        F.struct((-F.col("m")).alias("a"), F.col("ordinal").alias("b"), F.lit("").alias("c"),
                 F.format_string("%s lacks %d (%.1f%%)", "column", "m",
                                 F.col("m") / F.col("n_rows") * 100).alias("text")).alias("part")),
        4, "Gaps: ", "Gaps: none")]
    if numeric:
        frames.append(_joined(numeric_profile(df, numeric[:numeric_cap], shape=False).select(
            F.struct(F.col("ordinal").cast("long").alias("a"), F.col("ordinal").alias("b"), F.lit("").alias("c"),
                     F.when(F.col("mean").isNull(), F.format_string("%s without values", "column"))
                     .when(F.col("std").isNull(), F.format_string("%s about %.2f", "column", "mean"))
                     .otherwise(F.format_string("%s about %.2f, deviation %.2f", "column", "mean", "std"))
                     .alias("text")).alias("part")), 5, "Numbers: "))
    if len(numeric) >= 2:
        pairs = correlation_pairs(df, numeric).orderBy(F.abs("r").desc(), "a_ordinal", "b_ordinal").limit(4)
        frames.append(_joined(pairs.select(
            F.struct((-F.round(F.abs("r") * 1e12).cast("long")).alias("a"), F.col("a_ordinal").alias("b"),
                     F.col("b").alias("c"),
                     F.format_string("%s with %s %.2f", "a", "b", F.abs("r")).alias("text")).alias("part")),
            6, "Strongest pairs: "))
    told = [c for c in other if kind(df.schema[c]) != "other"][:text_cap]
    if told:
        texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in told])
        frames.append(_joined(top_values(texts, told).filter(F.col("top_value").isNotNull()).select(
            F.struct(F.col("ordinal").cast("long").alias("a"), F.col("ordinal").alias("b"), F.lit("").alias("c"),
                     F.format_string("%s is most often '%s', %,d times", "column", "top_value", "top_n")
                     .alias("text")).alias("part")), 7, "Values: "))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.filter(F.col("line").isNotNull())


def _line(number: int, text: Column) -> Column:
    return F.struct(F.lit(number).alias("line_no"), text.alias("line"))


def _joined(parts: DataFrame, number: int, lead: str, empty: str | None = None) -> DataFrame:
    """Join a handful of per-column parts into one line."""
    texts = F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"])
    line = F.when(F.count("part") > 0, F.concat(F.lit(lead), F.array_join(texts, "; "))).otherwise(F.lit(empty))
    return parts.agg(line.alias("line")).select(F.lit(number).alias("line_no"), "line")
