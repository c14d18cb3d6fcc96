"""Parquet tables and the null-bearing frames derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


# Derived frames, in SQL that Spark and DuckDB read alike.
DERIVED = {
    "doc_labels": (
        "select d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
        "from documents d left join labels l on d.doc_id = l.doc_id"),
    "doc_scores": (
        "select d.lang, d.source, cast(d.n_chars as double) as n_chars, l.quality, l.toxic "
        "from documents d left join labels l on d.doc_id = l.doc_id"),
    "events_null": (
        "select event_id, ts, case when event_id % 7 = 0 then null else value end as value, "
        "case when event_id % 11 = 0 then null else event_type end as event_type from events"),
    "events_dup": (
        "select event_type, user_id % 10 as bucket, cast(floor(value / 50) as int) as band "
        "from events"),
    "orders_text": (
        "select o_orderkey, cast(o_custkey as varchar(20)) as custkey_s, "
        "case when o_orderkey % 5 = 0 then 'n/a' "
        "else cast(cast(o_totalprice as decimal(12,2)) as varchar(20)) end as price_s, "
        "case when o_orderkey % 10 = 0 then 'unknown' "
        "else substr(cast(o_orderdate as varchar(30)),1,10) end as order_date from orders"),
    "events_dirty": (
        "select case when event_id % 9 = 0 then null else cast(user_id % 50 as varchar(20)) end as user_s, "
        "case when event_id % 11 = 0 then null else event_type end as event_type, "
        "cast(floor(value / 20) as int) as band, "
        "substr(cast(ts as varchar(30)),1,10) as event_date from events"),
}


class Tables:
    """Lazy access to a folder of ``{name}.parquet`` tables by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def parquet(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in DERIVED:
            return self.parquet(name)
        text = DERIVED[name]
        sources = [t for t in ("documents", "labels", "events", "orders") if f" {t}" in text]
        for t in sources:
            text = text.replace(f"from {t}", f"from {{{t}}}").replace(f"join {t}", f"join {{{t}}}")
        return self.spark.sql(text, **{t: self.parquet(t) for t in sources})
