"""Feature columns: calendar parts, z-scores, logs and frequency encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulyze.functions import lookup
from tabulyze.functions.columns import (
    col, columns_of, compact_sql, datetime_columns, number, numeric_columns, pick)
from tabulyze.functions.storage import written
from tabulyze.operators.kernel import null_counts, numeric_profile

PARTS = {"year": F.year, "month": F.month, "weekday": F.weekday, "quarter": F.quarter}


def datetime_parts(df: DataFrame) -> DataFrame:
    """year, month, weekday (Monday 0) and quarter of every datetime column."""
    return df.select("*", *[f(col(c)).alias(f"{c}_{part}")
                            for c in datetime_columns(df) for part, f in PARTS.items()])


def _facts(df: DataFrame) -> dict:
    return {r["column"]: r for r in numeric_profile(df, shape=False).collect()}   # one row per column


def _zscore(df: DataFrame, c: str, fact):
    if fact["std"] is not None and fact["std"] > 0:
        return [((number(df, c) - F.lit(fact["mean"])) / F.lit(fact["std"])).alias(f"{c}_zscore")]
    return []


def _log(df: DataFrame, c: str, fact):
    # one missing or non-positive cell rules the log out
    if fact["n"] == fact["n_rows"] and fact["n"] > 0 and fact["min"] > 0:
        return [F.log1p(number(df, c)).alias(f"{c}_log")]
    return []


def zscores(df: DataFrame) -> DataFrame:
    """(x - mean) / sample std of every numeric column with a spread."""
    facts = _facts(df)
    return df.select("*", *[e for c in numeric_columns(df) for e in _zscore(df, c, facts[c])])


def log1p_columns(df: DataFrame) -> DataFrame:
    """log(1 + x) of numeric columns that are positive in every row."""
    facts = _facts(df)
    return df.select("*", *[e for c in numeric_columns(df) for e in _log(df, c, facts[c])])


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(ordinal, key, n) for every value of every column, written once from one scan.

    A key is the cell's compact text; a task adds up equal cells before it sends them.
    """
    cells = [f"struct({i} as ordinal, cast({compact_sql(df, c)} as string) as key)" for i, c in enumerate(columns)]
    counts = df.selectExpr(f"inline(array({', '.join(cells)}))").filter("key is not null")
    return written(counts.groupBy("ordinal", "key").agg(F.count("*").alias("n")), "dictionary")


def frequency_encode(df: DataFrame) -> DataFrame:
    """Share of each categorical value among the filled cells of its column.

    One dictionary holds the values of all columns. The smallest columns, as many as fit into
    ``BROADCAST_ROWS`` values together, are looked up in place; the cells of all others
    go through one salted join, so a wide row is shuffled once at most.
    """
    columns = columns_of(df, "string", "boolean", "other")
    if not columns:
        return df
    counted = dictionary(df, columns)
    sizes = {r["ordinal"]: r for r in counted.groupBy("ordinal").agg(
        F.count("*").alias("d"), F.sum("n").alias("n")).collect()}   # one row per column
    totals = [float(sizes[i]["n"]) if i in sizes else 1.0 for i in range(len(columns))]
    shares = counted.select("ordinal", "key", "n", (F.col("n") / pick(totals)).alias("share"))
    small, packed = [], 0
    for i in sorted(range(len(columns)), key=lambda i: sizes[i]["d"] if i in sizes else 0):
        packed += sizes[i]["d"] if i in sizes else 0
        if packed <= lookup.BROADCAST_ROWS:
            small.append(i)
    large = [i for i in range(len(columns)) if i not in small]
    names = {i: f"{c}_freq_enc" for i, c in enumerate(columns)}
    out = _looked_up(df, columns, shares, large, sizes) if large else df
    for i in small:
        own = shares.filter(F.col("ordinal") == i).select(F.col("key").alias(f"__k{i}"), F.col("share").alias(names[i]))
        out = out.withColumn(f"__k{i}", F.expr(f"cast({compact_sql(df, columns[i])} as string)"))
        out = out.join(F.broadcast(own), f"__k{i}", "left").drop(f"__k{i}")   # within the packed size
    return out.select(*map(col, df.columns), *[col(names[i]) for i in range(len(columns))])


def _looked_up(df: DataFrame, columns: list[str], shares: DataFrame, large: list[int], sizes: dict) -> DataFrame:
    """The rows with the shares of the ``large`` columns, whose cells are joined all together."""
    rows = written(df.withColumn("__row", F.monotonically_increasing_id()), "numbered_rows")
    tagged = lambda i, key: f"concat('{i}:', {key})"
    cells = rows.select("__row", F.expr("inline(array(" + ", ".join(
        f"struct({i} as ordinal, {tagged(i, f'cast({compact_sql(df, columns[i])} as string)')} as cell)" for i in large) + "))"))
    own = shares.filter(F.col("ordinal").isin(large)).select(
        F.concat(F.col("ordinal").cast("string"), F.lit(":"), "key").alias("cell"), "n", "share")
    size, total = (sum(sizes[i][k] for i in large) for k in ("d", "n"))
    found = lookup.attach(cells.filter("cell is not null"), own, "cell", size, total)
    wide = found.groupBy("__row").agg(*[F.max(F.when(F.col("ordinal") == i, F.col("share"))).alias(f"{columns[i]}_freq_enc")
                                        for i in large])
    return rows.join(wide, "__row", "left").drop("__row")


def all_features(df: DataFrame) -> DataFrame:
    """Calendar parts, then z-scores and logs of all numeric columns (parts included), then frequencies."""
    parts = datetime_parts(df)
    facts = _facts(parts)
    numeric = parts.select("*", *[e for c in numeric_columns(parts)
                                  for e in _zscore(parts, c, facts[c]) + _log(parts, c, facts[c])])
    return frequency_encode(numeric)


def feature_plan(df: DataFrame) -> DataFrame:
    """(column, transform, applies) for every transform considered, from the column's data."""
    considered = {"numeric": ["z-score", "log transform"], "datetime": list(PARTS)}
    names = {c: considered.get(k, ["frequency encoding"])
             for k in ("numeric", "datetime", "string", "boolean", "other") for c in columns_of(df, k)}
    filled = null_counts(df).select("column", "ordinal", F.explode(
        pick_arrays([names[c] for c in df.columns], F.col("ordinal"))).alias("transform"))
    facts = numeric_profile(df, shape=False).select("column", "n", "n_rows", "std", "min")
    return filled.join(F.broadcast(facts), "column", "left").select(   # one row per column
        "column", "ordinal", "transform",
        F.when(F.col("transform") == "z-score", F.coalesce(F.col("std") > 0, F.lit(False)))
        .when(F.col("transform") == "log transform",
              F.coalesce((F.col("n") == F.col("n_rows")) & (F.col("min") > 0), F.lit(False)))
        .otherwise(True).alias("applies"))


def pick_arrays(lists: list[list[str]], ordinal):
    return F.element_at(F.array(*[F.array(*[F.lit(x) for x in xs]) for xs in lists]), ordinal + 1)
