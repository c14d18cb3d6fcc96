"""Row filters and outlier reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tabulyze.functions.columns import col, literal, number, number_sql, numeric_columns, percent, pick, rounded
from tabulyze.operators.kernel import numeric_cells, numeric_profile
from tabulyze.operators.quantiles import iqr_fences


def non_null_rows(df: DataFrame, name: str) -> DataFrame:
    """The column without its missing cells."""
    return df.select(number(df, name).alias(name) if name in numeric_columns(df) else col(name)).dropna()


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with every named column filled."""
    return df.dropna(subset=columns)


def iqr_outlier_rows(df: DataFrame, name: str, multiplier: float = 1.5) -> DataFrame:
    """Rows outside the IQR fences; the fences are literals the scan can push down."""
    fence = iqr_fences(df, [name], multiplier)[name]
    if fence is None:
        return df.limit(0)
    c = col(name)
    return df.filter(((c < F.lit(fence[2])) | (c > F.lit(fence[3]))) & number(df, name).isNotNull())


def _facts(df: DataFrame, columns: list[str]) -> dict:
    rows = numeric_profile(df, columns, shape=False).collect()   # one row per column
    return {r["column"]: r for r in rows}


def zscore_outlier_rows(df: DataFrame, name: str, threshold: float = 3.0, ddof: int = 0) -> DataFrame:
    """Rows more than ``threshold`` deviations from the mean, with their ``z``."""
    fact = _facts(df, [name])[name]
    std = fact["std_pop"] if ddof == 0 else fact["std"]
    if not std:
        return df.limit(0).withColumn("z", F.lit(None).cast("double"))
    z = F.abs(number(df, name) - F.lit(fact["mean"])) / F.lit(std)
    return df.withColumn("z", z).filter(F.col("z") > threshold)


def _flagged(df: DataFrame, columns: list[str], key: str, test) -> DataFrame:
    """(key, column, value, z) of cells where ``test(name, v)`` gives (flag, z); no other cell is emitted."""
    structs, tests = [], []
    for i, c in enumerate(columns):
        v = number_sql(df, c)
        flag, z = test(c, v)
        tests.append(f"({flag})")
        structs.append(f"if({flag}, struct({i} as ordinal, {v} as value, cast({z} as double) as z), null)")
    # rows without a flagged cell are gone before any is unfolded
    return (df.filter(" or ".join(tests)).select(col(key).alias("key"), F.expr(f"inline(array({', '.join(structs)}))"))
            .filter("ordinal is not null").select("key", pick(columns).alias("column"), "ordinal", "value", "z"))


def _z(v: str, fact, std: str) -> str:
    return f"abs({v} - {literal(fact['mean'])}) / {literal(fact[std])}"


def anomaly_rows(df: DataFrame, key: str, columns: list[str] | None = None, threshold: float = 3.0,
                 min_n: int = 10) -> DataFrame:
    """Cells beyond ``threshold`` population deviations in columns with more than ``min_n`` values."""
    columns = numeric_columns(df) if columns is None else columns
    facts = _facts(df, columns)
    columns = [c for c in columns if facts[c]["n"] > min_n and facts[c]["std_pop"]]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value double, z double").withColumn("key", F.lit(None))
    def test(c, v):
        z = _z(v, facts[c], "std_pop")
        return f"{z} > {threshold}", z
    return _flagged(df, columns, key, test).drop("ordinal")


def over_threshold(facts: dict, threshold: float = 3.0, min_n: int = 10):
    """Cell flag: 1 beyond ``threshold`` population deviations of a column with more than ``min_n`` values."""
    def flag(c, v):
        usable = facts[c]["n"] > min_n and facts[c]["std_pop"]
        test = f"{_z(v, facts[c], 'std_pop')} > {threshold}" if usable else "false"
        return f"if({test}, 1, 0) as over"
    return flag


def anomaly_counts(df: DataFrame, columns: list[str] | None = None, threshold: float = 3.0,
                   min_n: int = 10, facts: dict | None = None) -> DataFrame:
    """(column, ordinal, count, n_rows) of the cells ``anomaly_rows`` would list.

    ``facts`` hands in column statistics already gathered.
    """
    columns = numeric_columns(df) if columns is None else columns
    facts = _facts(df, columns) if facts is None else facts
    return (numeric_cells(df, columns, over_threshold(facts, threshold, min_n)).groupBy("ordinal")
            .agg(F.sum("over").alias("count"), F.count("*").alias("n_rows"))
            .select(pick(columns).alias("column"), "ordinal", "count", "n_rows"))


def anomaly_summary(df: DataFrame, key: str, method: str = "zscore", samples: int = 5) -> DataFrame:
    """Per column with flagged cells: count, first samples by ``key``, mean, std and percent."""
    columns = numeric_columns(df)
    facts = _facts(df, columns)
    columns = [c for c in columns if facts[c]["n"] >= 4]
    if method == "zscore":
        columns = [c for c in columns if facts[c]["std"]]
        def test(c, v):
            z = _z(v, facts[c], "std")
            return f"{z} > 3", z
    else:
        fences = iqr_fences(df, columns)
        def test(c, v):
            return f"{v} < {literal(fences[c][2])} or {v} > {literal(fences[c][3])}", "null"
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, count long, sample_values array<double>, column_mean double, "
                                                   "column_std double, pct_anomalous double")
    hits = _flagged(df, columns, key, test)
    counts = hits.groupBy("column").agg(F.count("*").alias("count"))
    # row_number() <= k is cut to k rows per task before the shuffle
    first = (hits.withColumn("rn", F.row_number().over(Window.partitionBy("column").orderBy("key")))
             .filter(F.col("rn") <= samples).groupBy("column")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "value"))),
                              lambda s: rounded(s["value"], 4)).alias("sample_values")))
    fact = lambda name: F.create_map(*[x for c in columns for x in (F.lit(c), F.lit(facts[c][name]))])[F.col("column")]
    return counts.join(F.broadcast(first), "column").select(   # one row per column
        "column", "count", "sample_values", rounded(fact("mean"), 4).alias("column_mean"),
        rounded(fact("std"), 4).alias("column_std"), rounded(percent(F.col("count"), fact("n")), 2).alias("pct_anomalous"))


def anomaly_totals(summary: DataFrame, method: str) -> DataFrame:
    return summary.agg(F.lit(method).alias("method"),
                       F.coalesce(F.sum("count"), F.lit(0)).alias("total_anomalous_values"),
                       F.count("*").alias("columns_with_anomalies"))


def anomaly_bands(df: DataFrame, name: str, key: str, threshold: float = 3.0) -> DataFrame:
    """Every filled value with its flag (population z) and the control limits (sample std)."""
    fact = _facts(df, [name])[name]
    v = number(df, name)
    if not fact["n"]:
        return df.sparkSession.createDataFrame(
            [], "value double, is_anomaly boolean, lower_limit double, upper_limit double").select(
            F.lit(None).cast(df.schema[key].dataType).alias("key"), "*")
    z = F.abs(v - F.lit(fact["mean"])) / F.lit(fact["std_pop"]) if fact["std_pop"] else F.lit(0.0)
    std = fact["std"] or 0.0
    return df.filter(v.isNotNull()).select(
        col(key).alias("key"), v.alias("value"), (z > threshold).alias("is_anomaly"),
        F.lit(fact["mean"] - threshold * std).alias("lower_limit"),
        F.lit(fact["mean"] + threshold * std).alias("upper_limit"))


def anomaly_pressure(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: flagged cells over rows, at most 1."""
    return anomaly_counts(df, columns).agg(F.least(
        F.try_divide(F.sum("count").cast("double"), F.max("n_rows")), F.lit(1.0)).alias("anomaly_pressure"))


def two_sigma_share(df: DataFrame, name: str) -> DataFrame:
    """One row: share of filled values beyond two population deviations."""
    fact = _facts(df, [name])[name]
    v = number(df, name)
    if not fact["n"]:
        return df.sparkSession.createDataFrame([(None,)], "share double")
    far = F.abs(v - F.lit(fact["mean"])) > F.lit(2 * (fact["std_pop"] + 1e-9))
    return df.filter(v.isNotNull()).agg(F.avg(far.cast("double")).alias("share"))


def anomaly_watch(df: DataFrame) -> DataFrame:
    """Per column: values beyond three sample deviations, their percent and the largest z."""
    columns = numeric_columns(df)
    facts = _facts(df, columns)
    columns = [c for c in columns if facts[c]["n"] >= 4 and facts[c]["std"]]
    def z(c, v):
        return f"{_z(v, facts[c], 'std')} as z"
    def far(c, v):
        return f"if(abs({v} - {literal(facts[c]['mean'])}) > {literal(3 * facts[c]['std'])}, 1, 0) as far"
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n_anomalies long, pct double, max_z double")
    out = numeric_cells(df, columns, z, far).groupBy("ordinal").agg(
        F.sum("far").alias("n_anomalies"), F.count("v").alias("n"), F.max("z").alias("max_z"))
    return out.filter(F.col("n_anomalies") > 0).select(
        pick(columns).alias("column"), "n_anomalies",
        rounded(percent(F.col("n_anomalies"), F.col("n")), 2).alias("pct"), rounded("max_z", 1).alias("max_z"))
