"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

BUCKETS = 4096


def record_key(doc_id: Column, text: Column) -> Column:
    """The key that places a row: its id, or the hash of its text where the id is null."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _number(digest: Column, first: int, digits: int) -> Column:
    return F.conv(F.substring(digest, first, digits), 16, 10).cast("long")


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard with the earliest of independent exponential arrivals at rates ``weights``.

    A shard's arrival depends on the key and its own number only, so a further shard can
    take rows but never moves one between the others.
    """
    def arrival(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat_ws(":", key, F.lit(str(shard))).cast("binary"))
        u = (_number(digest, 1, 13).cast("double") + 0.5) / F.lit(float(1 << 52))
        return F.struct((-F.log(u) / F.lit(float(weight))).alias("at"), F.lit(shard).alias("shard"))
    return F.array_min(F.array(*[arrival(k, w) for k, w in enumerate(weights) if w > 0]))["shard"]


def shard_rows(docs: DataFrame, weights: list[float], doc_id: str = "doc_id", text: str = "text",
               grown_weight: float = 1.0, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row.

    ``slot`` numbers a shard's rows without gaps: rows are counted in ``buckets`` parts of
    each shard, so no task orders a whole shard. Null texts have size 1 and the checksum of
    the empty text; rows with a null id are placed by their text; repeated rows share the
    shard and have slots of their own; an empty table gives no rows; other columns are not
    read.
    """
    id_, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    data = F.coalesce(body, F.lit("")).cast("binary")
    rows = docs.select(id_.alias("doc_id"), (F.octet_length(data) + F.lit(1)).cast("long").alias("size"),
                       F.crc32(data).alias("text_crc32"), record_key(id_, body).alias("key"))
    rows = rows.select("doc_id", "size", "text_crc32", shard_of(F.col("key"), weights).alias("shard"),
                       shard_of(F.col("key"), [*weights, grown_weight]).alias("grown_shard"),
                       (_number(F.md5(F.col("key").cast("binary")), 1, 8) % buckets).alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # at most shards x buckets rows
    first = F.broadcast(counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    own = Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
    placed = rows.select("*", (F.row_number().over(own) - 1).alias("place")).join(first, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                         (F.col("first") + F.col("place")).cast("long").alias("slot"), "grown_shard")


def _arrivals_sql(n: int) -> str:
    one = ("struct_pack(at := -ln((('0x' || substr(md5(key || ':{k}'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496), "
           "shard := {k})")
    return "list_sort([" + ", ".join(one.format(k=k) for k in range(n)) + "])[1].shard"


# CRC-32 from its rule: the table is eight shifts of each byte value by the reflected polynomial
_CRC_SQL = """table_ as (select list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k:
    case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n)) as t),
crc as (select key, doc_id, size, xor(list_reduce(list_transform(range(1, 2 * size - 1, 2), lambda i: ('0x' || substr(hex, i, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) as text_crc32
    from sized, table_)"""

SHARDING_SQL = f"""
with base as (select doc_id, coalesce(text, '') as body, coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) as key,
    text from documents),
sized as (select doc_id, key, strlen(body) + 1 as size, hex(encode(body)) as hex from base),
{_CRC_SQL},
placed as (select doc_id, size, text_crc32, {_arrivals_sql(16)} as shard, {_arrivals_sql(17)} as grown_shard,
  ('0x' || substr(md5(key), 1, 8))::BIGINT % {BUCKETS} as bucket from crc)
select doc_id, size::BIGINT as size, text_crc32::BIGINT as text_crc32, 'key' as law, shard::INTEGER as shard,
  (row_number() over (partition by shard order by bucket, doc_id nulls first, size, text_crc32) - 1)::BIGINT as slot,
  grown_shard::INTEGER as grown_shard from placed"""


def with_shard(docs: DataFrame, weights: list[float], doc_id: str = "doc_id", text: str = "text", name: str = "shard") -> DataFrame:
    """All columns and the row's shard; a column of that name is replaced. Nothing is shuffled."""
    return docs.withColumn(name, shard_of(record_key(F.col(f"`{doc_id}`"), F.col(f"`{text}`")), weights))
