"""Query registry shared by the plan modules.

Doubles are rounded at this boundary, on both engines, because partial sums
arrive in any order: 6 decimals below 10, 4 below a million, then 9 digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulyze.sources.tables import DERIVED, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# the same without the rounding that only comparing two engines needs
OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_NUDGE = "1.0000000000002"   # settles exact ties the same way on both engines


def _settled(name: str) -> str:
    q = f"`{name}`"
    size = f"abs({q}) * {_NUDGE}D"
    unit = f"pow(10.0D, floor(log10(abs({q}))))"
    near = lambda x, scale: f"sign({q}) * floor({x} * {scale}D + 0.5D) / {scale}D"
    return (f"case when {q} is null then null when abs({q}) < 10 then {near(size, '1e6')} + 0.0D "
            f"when abs({q}) < 1e6 then {near(size, '1e4')} "
            f"else {near(f'({size}) / {unit}', '1e8')} * {unit} end as {q}")


def settle(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[F.expr(_settled(c)) if kinds[c] == "double" else F.col(f"`{c}`")
                       for c in df.columns])


def _settled_sql(name: str) -> str:
    q = f'"{name}"::DOUBLE'
    size = f"abs({q}) * {_NUDGE}::DOUBLE"
    unit = f"pow(10.0::DOUBLE, floor(log10(abs({q}))))"
    near = lambda x, scale: f"sign({q}) * floor({x} * {scale}::DOUBLE + 0.5::DOUBLE) / {scale}::DOUBLE"
    return (f"case when {q} is null then null when abs({q}) < 10 then {near(size, '1e6')} + 0.0::DOUBLE "
            f"when abs({q}) < 1e6 then {near(size, '1e4')} "
            f'else {near(f"({size}) / {unit}", "1e8")} * {unit} end as "{name}"')


def register(name: str, sql: str | None = None, floats: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``floats`` names the SQL's double columns."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return settle(fn(Tables(spark, sf_dir)))
        assert name not in QUERIES, name
        QUERIES[name] = run
        OPERATORS[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            text = sql
            names = floats.split()
            if names:
                text = f"select * replace ({', '.join(_settled_sql(f) for f in names)}) from ({text}) settled"
            used = [d for d in DERIVED if d in text]
            if used:
                text = "with " + ", ".join(f"{d} as ({DERIVED[d]})" for d in used) + f" {text}"
            ORACLES[name] = text
        return fn
    return add


# --- SQL text helpers for the oracles -------------------------------------------------

LINEITEM_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax"]
DOC_LABEL_NUMERIC = ["doc_id", "n_chars", "quality", "toxic"]


def per_column(table: str, columns: list[str], body: str) -> str:
    """UNION ALL of ``body`` with {c}, {i} and {t} filled in per column."""
    return " union all ".join(
        "(" + body.format(c=c, i=i, t=table) + ")" for i, c in enumerate(columns))


def long_form(table: str, columns: list[str], extra: str = "") -> str:
    """(ordinal, col, v) rows of the numeric columns."""
    return per_column(table, columns,
                      "select {i} as ordinal, '{c}' as col, cast({c} as double) as v" + extra + " from {t}")
