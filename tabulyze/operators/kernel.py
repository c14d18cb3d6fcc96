"""Column statistics every operator reads.

Numeric columns go through long form, ``(ordinal, v)`` cells grouped by
ordinal: one scan, one hash aggregate inside whole-stage code generation, and
one partial row per column and task in the shuffle, however wide the table is.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabulyze.functions import lookup
from tabulyze.functions.columns import (
    FLOAT_TYPES, INTEGER_TYPES, col, compact_sql, kind, literal, number_sql, numeric_columns, pick, string_columns, value, value_sql)
from tabulyze.functions.moments import adjusted_kurtosis_sql, adjusted_skewness_sql
from tabulyze.functions.storage import written


WIDE = 64   # columns unfolded per scan; wider tables take several scans of disjoint columns


def in_batches(columns: list[str], profile) -> DataFrame:
    """Union of ``profile(batch)`` over batches of columns, with ordinals counted through."""
    out = None
    for start in range(0, len(columns), WIDE):
        part = profile(columns[start:start + WIDE]).withColumn("ordinal", F.expr(f"ordinal + {start}"))
        out = part if out is None else out.unionByName(part)
    return out


def numeric_cells(df: DataFrame, columns: list[str], *extra) -> DataFrame:
    """(ordinal, v, …) for every row and column; ``extra(name, v)`` gives SQL text of more fields."""
    structs = []
    for i, c in enumerate(columns):
        v = number_sql(df, c)
        structs.append("struct(" + ", ".join([f"{i} as ordinal", f"{v} as v", *[e(c, v) for e in extra]]) + ")")
    return df.selectExpr(f"inline(array({', '.join(structs)}))")


def outside_fences(fences: dict):
    """Cell flag: 1 beyond the column's fences."""
    def flag(name, v):
        f = fences.get(name)
        test = "false" if f is None else f"{v} < {literal(f[2])} or {v} > {literal(f[3])}"
        return f"if({test}, 1, 0) as outside"
    return flag


def numeric_profile(df: DataFrame, columns: list[str] | None = None, fences: dict | None = None,
                    shape: bool = True, sketch: str | None = None) -> DataFrame:
    """One row per numeric column: counts, moments, extremes and missing share.

    ``fences`` (from ``iqr_fences``) adds ``outliers``, the number of values
    outside them. ``shape=False`` leaves out skewness and kurtosis. ``sketch`` is SQL text of an
    aggregate of ``v`` that is kept under this name.
    """
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return df.sparkSession.createDataFrame([], _PROFILE_SCHEMA)
    if len(columns) > WIDE:
        return in_batches(columns, lambda batch: numeric_profile(df, batch, fences, shape, sketch))
    stats = ["count(1) as n_rows", "count(v) as n", "avg(v) as mean", "var_samp(v) as variance",
             "min(v) as min", "max(v) as max"]
    out = ["ordinal", "n_rows", "n", "mean", "sqrt(variance) as std", "variance",
           "sqrt(variance * (n - 1) / n) as std_pop", "min", "max"]
    if shape:
        stats += ["skewness(v) as g1", "kurtosis(v) as g2"]
        out += [f"{adjusted_skewness_sql('n', 'g1', 'min', 'max')} as skewness",
                f"{adjusted_kurtosis_sql('n', 'g2', 'min', 'max')} as kurtosis"]
    out.append("(n_rows - n) * 100.0D / n_rows as missing_pct")
    if fences is not None:
        stats.append("sum(outside) as outliers")
        out.append("outliers")
    if sketch is not None:
        stats.append(f"{sketch} as sketch")
        out.append("sketch")
    cells = numeric_cells(df, columns, *([outside_fences(fences)] if fences is not None else []))
    long = cells.groupBy("ordinal").agg(*[F.expr(e) for e in stats])
    return long.select(pick(columns).alias("column"), *[F.expr(e) for e in out])


_PROFILE_SCHEMA = (
    "column string, ordinal int, n_rows long, n long, mean double, std double, variance double, "
    "std_pop double, min double, max double, skewness double, kurtosis double, missing_pct double, "
    "outliers long, sketch array<double>")


def with_quantiles(profile: DataFrame, quantiles: dict[str, list], names: list[str]) -> DataFrame:
    """Attach driver-held quantiles (one list per column) to a profile."""
    def lookup(i):
        pairs = ", ".join(f"{literal(c)}, cast({literal(q[i])} as double)" for c, q in quantiles.items())
        return f"element_at(map({pairs}), column)" if quantiles else "cast(null as double)"
    return profile.selectExpr("*", *[f"{lookup(i)} as {name}" for i, name in enumerate(names)])


def null_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: n_rows and non-null n, from one scan of cheap counters."""
    columns = df.columns if columns is None else columns
    wide = df.selectExpr("count(1) as n_rows", *[f"count({value_sql(df, c)}) as n{i}" for i, c in enumerate(columns)])
    listed = ", ".join(f"n{i}" for i in range(len(columns)))
    return (wide.selectExpr("n_rows", f"posexplode(array({listed})) as (ordinal, n)")
            .select(pick(columns).alias("column"), "ordinal", "n_rows", "n"))


PREFIX = 64   # letters of a text that its group carries; a shorter text is its own key


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(ordinal, key, value, n) over string columns, counted in one shuffle by compact key.

    ``value`` is the text up to ``PREFIX`` letters, so long texts are not shuffled.
    """
    columns = string_columns(df) if columns is None else columns
    structs = [f"struct({i} as ordinal, {compact_sql(df, c)} as key, left({value_sql(df, c)}, {PREFIX}) as value)"
               for i, c in enumerate(columns)]
    return df.selectExpr(f"inline(array({', '.join(structs)}))").groupBy("ordinal", "key", "value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, columns: list[str] | None = None,
               include_null: bool = False) -> DataFrame:
    """Per string column: n, n_distinct, top_value (smallest on a tie), top_n.

    The table is counted once and its counts are written. The winner is a hash aggregate with
    map-side partials, not a sort of all distinct values of a column in one task. Where the
    winner of some column is a long text, the few texts that share its count and its first letters are
    fetched in one more scan of these columns.
    """
    columns = string_columns(df) if columns is None else columns
    if len(columns) > WIDE:
        return in_batches(columns, lambda batch: top_values(df, batch, include_null))
    counts = written(value_counts(df, columns), "value_counts")
    eligible = F.lit(True) if include_null else F.col("key").isNotNull()
    # a text of PREFIX letters comes before the longer ones that begin with it
    is_long = F.coalesce(F.length("key") > PREFIX, F.lit(False))
    facts = (counts.groupBy("ordinal")
             .agg(F.sum("n").alias("n_rows"),
                  F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("n"),
                  F.count("key").alias("n_distinct"), F.coalesce(F.max(F.when(eligible, F.col("n"))), F.lit(0)).alias("top_n"),
                  F.min(F.when(eligible, F.struct((-F.col("n")).alias("neg"), "value", is_long.alias("long")))).alias("top")))
    out = facts.select(pick(columns).alias("column"), "ordinal", "n_rows", "n", "n_distinct",
                       F.col("top.value").alias("top_value"), "top_n", F.col("top.long").alias("is_long"))
    undecided = out.filter("is_long").select("ordinal", "top_value", "top_n").collect()   # one row per column
    if not undecided:
        return out.drop("is_long")
    tied = counts.filter(is_long & functools.reduce(lambda a, b: a | b, [
        (F.col("ordinal") == r["ordinal"]) & (F.col("value") == r["top_value"]) & (F.col("n") == r["top_n"]) for r in undecided]))
    tied = tied.select("ordinal", "key")
    if tied.count() <= lookup.BROADCAST_ROWS:
        tied = F.broadcast(tied)
    cells = df.selectExpr("inline(array(" + ", ".join(
        f"struct({i} as ordinal, {compact_sql(df, columns[i])} as key, {value_sql(df, columns[i])} as text)"
        for i in (r["ordinal"] for r in undecided)) + "))")
    texts = cells.join(tied, ["ordinal", "key"], "left_semi").groupBy("ordinal").agg(F.min("text").alias("long_value"))
    joined = out.join(F.broadcast(texts), "ordinal", "left")   # one row per column
    return joined.select("column", "ordinal", "n_rows", "n", "n_distinct",
                         F.coalesce("long_value", "top_value").alias("top_value"), "top_n")


# Spellings that make a two-valued column a boolean.
TRUTHY = ("0", "1", "yes", "no", "true", "false", "Yes", "No", "True", "False")


def distinct_profile(df: DataFrame, columns: list[str] | None = None, rows: bool = False) -> DataFrame:
    """Per scalar column: n_rows, n, n_distinct, avg_len, all_truthy.

    Cells are grouped by (ordinal, typed key) so numbers never pass through
    text. A value that fills most of a column collapses in the map-side combine. ``rows`` adds
    a row without column name, behind the columns, whose distinct values are the table's rows.
    """
    columns = [f.name for f in df.schema.fields if kind(f) != "other"] if columns is None else columns
    if len(columns) > WIDE:   # ordinals are table positions already
        parts = [distinct_profile(df, columns[i:i + WIDE], rows and i == 0) for i in range(0, len(columns), WIDE)]
        return functools.reduce(DataFrame.unionByName, parts)
    truthy_words = ", ".join(map(literal, TRUTHY))
    structs = []
    for i, c in enumerate(columns):
        k, dtype = kind(df.schema[c]), df.schema[c].dataType
        cell = value_sql(df, c)
        whole = real = text = length = "null"
        truthy = "false"
        if isinstance(dtype, INTEGER_TYPES):
            whole, truthy = cell, f"{cell} in (0, 1)"
        elif isinstance(dtype, T.DecimalType):
            text, truthy = f"cast({cell} as string)", f"{cell} in (0, 1)"
        elif k == "numeric":
            real, truthy = cell, f"{cell} in (0, 1)"
        elif k == "boolean":
            whole, truthy = f"cast({cell} as int)", "true"
        elif isinstance(dtype, T.DateType):
            whole = f"unix_date({cell})"
        elif isinstance(dtype, T.TimestampNTZType):
            text = f"cast({cell} as string)"   # a zone's clock change must not merge two wall times
        elif k == "datetime":
            whole = f"unix_micros({cell})"
        else:
            text, length, truthy = compact_sql(df, c), f"length({cell})", f"{cell} in ({truthy_words})"
        structs.append(f"struct({i} as ordinal, cast({whole} as long) as whole, cast({real} as double) as real, "
                       f"cast({text} as string) as text, cast({length} as long) as len, "
                       f"coalesce({truthy}, false) as truthy)")
    names, places = list(columns), [df.columns.index(c) for c in columns]
    if rows:
        whole, text = row_fingerprint_sql(df)
        structs.append(f"struct({len(columns)} as ordinal, {whole} as whole, cast(null as double) as real, "
                       f"cast({text} as string) as text, cast(null as long) as len, false as truthy)")
        names, places = [*names, None], [*places, len(df.columns)]
    cells = df.selectExpr(f"inline(array({', '.join(structs)}))")
    # a typed null is a group of its own, so it has no key
    present = (F.col("whole").isNotNull() | F.col("real").isNotNull() | F.col("text").isNotNull())
    keys = cells.groupBy("ordinal", "whole", "real", "text", "len", "truthy").agg(F.count("*").alias("n"))
    return (keys.groupBy("ordinal")
            .agg(F.sum("n").alias("n_rows"),
                 F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("n"),
                 F.count(F.when(present, 1)).alias("n_distinct"),
                 F.try_divide(F.sum(F.when(present, F.col("n") * F.col("len"))).cast("double"),
                              F.sum(F.when(F.col("len").isNotNull(), F.col("n")))).alias("avg_len"),
                 F.coalesce(F.bool_and(F.when(present, F.col("truthy"))), F.lit(True)).alias("all_truthy"))
            .select(pick(names).alias("column"), pick(places).alias("ordinal"),
                    "n_rows", "n", "n_distinct", "avg_len", "all_truthy"))


def row_fingerprint_sql(df: DataFrame) -> list[str]:
    """SQL text of two 64-bit hashes of a row; nulls, and NaN as a null, equal each other.

    Rows that differ share both with a chance of one in 2**128, so that even a million
    million rows hold such a pair with a chance below 1e-14.
    """
    cells = []
    for f in df.schema.fields:
        cell = compact_sql(df, f.name) if kind(f) == "other" else value_sql(df, f.name)
        cells += [cell, f"isnull({cell})"]       # a null alone would leave the hash as it is
    return [f"xxhash64({', '.join([str(seed), *cells])})" for seed in (1, 2)]


def row_counts(df: DataFrame) -> DataFrame:
    """One row: n_rows and distinct_rows, nulls comparing equal; 16 bytes a row are shuffled."""
    keys = df.selectExpr(*[f"{h} as h{i}" for i, h in enumerate(row_fingerprint_sql(df), 1)])
    return (keys.groupBy("h1", "h2").agg(F.count("*").alias("n"))
            .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("distinct_rows")))


def edge_values(df: DataFrame, columns: list[str], order: list[str], k: int,
                last: bool = False, probe_rows: int = 500) -> DataFrame:
    """(column, ordinal, rn, v): the first (or last) ``k`` non-null values per column by ``order``.

    A top-n probe of the table answers most columns. The columns too sparse for the probe
    share one more scan, so the answer is always exact. Of equal places the smaller text counts first.
    """
    keys = [col(c).desc() if last else col(c).asc() for c in order]
    head = df.orderBy(*keys).limit(probe_rows)
    seen = head.agg(*[F.count(value(df, c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    frames = []
    dense = [(i, c) for i, c in enumerate(columns) if seen[i] >= k]
    sparse = [(i, c) for i, c in enumerate(columns) if seen[i] < k]
    if dense:
        frames.append(head.select(
            *[col(c).alias(f"o{j}") for j, c in enumerate(order)],
            F.inline(F.array(*[F.struct(F.lit(i).alias("ordinal"), value(df, c).cast("string").alias("v"))
                               for i, c in dense]))).filter(F.col("v").isNotNull()))
    if sparse:
        frames.append(_edges_per_task(df, sparse, order, k, last))
    rows = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    names = [f"o{j}" for j in range(len(order))]
    # at most probe_rows rows per column, or k per column and task, reach this window
    window = Window.partitionBy("ordinal").orderBy(*[F.col(o).desc() if last else F.col(o) for o in names], "v")
    return (rows.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= k)
            .select(pick(columns).alias("column"), "ordinal", "rn", "v"))


def _edges_per_task(df: DataFrame, columns: list[tuple[int, str]], order: list[str], k: int, last: bool) -> DataFrame:
    """(o0, …, ordinal, v): the outermost ``k`` filled cells of every column in each task, from one scan."""
    places = [col(c).alias(f"o{j}") for j, c in enumerate(order)]
    # Spark sorts NaN behind all numbers, Arrow next to the nulls
    ranks = [r for j, c in enumerate(order) for r in (
        [F.isnan(col(c)).cast("int").alias(f"s{j}n"), value(df, c).alias(f"s{j}")]
        if isinstance(df.schema[c].dataType, FLOAT_TYPES) else [col(c).alias(f"s{j}")])]
    filled = functools.reduce(lambda a, b: a | b, [value(df, c).isNotNull() for _, c in columns])
    cells = df.filter(filled).select(*places, *ranks, *[value(df, c).cast("string").alias(f"v{i}") for i, c in columns])
    kept = [n for n in cells.columns if n[0] in "os"]
    by = [(n, "descending" if last else "ascending") for n in kept if n[0] == "s"] + [("v", "ascending")]

    def outermost(table: pa.Table) -> pa.Table:
        at = pc.sort_indices(table, sort_keys=by, null_placement="at_end" if last else "at_start")
        return table.take(at[:k])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, pa.Table] = {}
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for i, _ in columns:
                own = table.select([*kept, f"v{i}"]).rename_columns([*kept, "v"]).filter(table.column(f"v{i}").is_valid())
                if own.num_rows:
                    held[i] = outermost(pa.concat_tables([held[i], own]) if i in held else own)
        for i, table in held.items():
            table = table.select([n for n in kept if n[0] == "o"] + ["v"])
            yield from table.append_column("ordinal", pa.array([i] * table.num_rows, pa.int32())).combine_chunks().to_batches()
    kinds = dict(cells.dtypes)
    schema = ", ".join([*[f"o{j} {kinds[f'o{j}']}" for j in range(len(order))], "v string", "ordinal int"])
    return cells.mapInArrow(searched, schema)
