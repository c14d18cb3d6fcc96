"""The registered queries of this subpackage and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabulyze.llm import (chat, decontaminate, html_extract, jaccard_join, language_id, mixing, quality, sharding, simhash, spelling,
                          suffix_dedup, toxicity, vector_codes)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_line_quality", quality.QUALITY_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.line_quality(_table(spark, sf_dir, "documents")).drop("clean_text")


@query("op2_rendezvous_shards", sharding.SHARDING_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), [1.0] * 16)


@query("op3_pareto_mix", mixing.MIXING_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_copies(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_chat_format", chat.CHAT_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.sql(f"select -1L as conv_id, turn, role, '{chat.PLANTED}' as text from values (0L, 'user'), (1L, 'assistant') "
                        "as t(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    done = chat.format_chat(chat.canonical_turns(chat.as_records(rows)))
    read = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"),
                       chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    text = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def _remainder(parts: int):
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


@query("op9_language_centroids")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learned = docs.where((_remainder(3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = language_id.fit_languages(learned.select("doc_id", "text", "lang"))
    return language_id.predict_languages(docs, model).select(
        "doc_id", F.coalesce(_remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "cosine", "rejected")


@query("op10_toxic_segments")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("segments").alias("n_segments"))


@query("op8_html_min_cut")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op7_item_containment", decontaminate.DECONTAMINATION_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query("op5_jaccard_classes")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op6_repeated_strings")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


@query("op11_vector_codes", vector_codes.VECTOR_CODES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress_vectors(_table(spark, sf_dir, "embeddings")).drop("label")


@query("op12_simhash_classes")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(_table(spark, sf_dir, "documents"))


@query("op13_spelling_forms")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_table(spark, sf_dir, "documents"))
