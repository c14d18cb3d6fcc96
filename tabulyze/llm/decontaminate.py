"""Short benchmark items inside long documents, with built-in expressions only.

Items are partitioned by their number of shingles. In each partition an item's sketch holds
its smallest min-wise hashes, as many as a document that contains enough of the item can
miss, plus one: such a document then holds at least one of them, whatever its length. The
documents' own shingles are looked up among the sketches, and what is found is verified by
counting the item's shingles in the document. No document row is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tabulyze.llm.jaccard_join import record_key
from tabulyze.llm.quality import NOT_SPACE, words_of

BROADCAST_ROWS = 200_000   # sketch rows in one block; a row is about a kilobyte at most


def _grams(words: Column, width: int, make) -> Column:
    """``make(list of words)`` of every window; of all words where there are fewer."""
    last = F.size(words) - width
    windows = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make([F.get(words, i + k) for k in range(width)]))
    whole = F.array(make([F.array_join(words, " ")]))
    return F.when(last >= 0, windows).when(F.size(words) > 0, whole).otherwise(F.slice(whole, 1, 0))


def shingle_hashes(words: Column, width: int) -> Column:
    return F.array_distinct(_grams(words, width, lambda w: F.xxhash64(*w)))


def shingle_texts(words: Column, width: int) -> Column:
    return F.array_distinct(_grams(words, width, lambda w: F.concat_ws(" ", *w)))


def item_sketches(items: DataFrame, threshold: float, width: int, item_id: str, text: str) -> DataFrame:
    """(hash, item_id, n_item, item_shingles, earlier): one row per sketch entry. ``earlier``
    are the item's entries before it, so that a document reports an item once."""
    rows = items.select(F.col(f"`{item_id}`").alias("item_id"), words_of(F.lower(F.col(f"`{text}`"))).alias("w"))
    rows = rows.select("item_id", shingle_texts(F.col("w"), width).alias("item_shingles"),
                       shingle_hashes(F.col("w"), width).alias("hashes"))
    rows = rows.select("*", F.size("item_shingles").alias("n_item"))
    # partitions by size: below 16 shingles, then doubling; the largest item sets the depth
    part = F.greatest(F.lit(4), F.ceil(F.log2(F.col("n_item") + F.lit(1.0)))).cast("int")
    upper = F.max("n_item").over(Window.partitionBy(part))
    depth = (F.floor(upper * F.lit(1 - threshold) + F.lit(1e-9)) + 1).cast("int")
    ranked = F.array_sort(F.transform("hashes", lambda h: F.struct(F.xxhash64(F.lit("minwise"), h).alias("rank"), h.alias("h"))))
    rows = rows.select("item_id", "item_shingles", "n_item", F.slice(F.transform(ranked, lambda x: x["h"]), F.lit(1), depth).alias("s"))
    rows = rows.select("item_id", "item_shingles", "n_item", "s", F.posexplode_outer("s").alias("place", "hash"))
    return rows.where("hash is not null").select(
        "hash", "item_id", "n_item", "item_shingles", F.slice("s", F.lit(1), F.col("place")).alias("earlier"))


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.8, width: int = 5, doc_id: str = "doc_id",
                    text: str = "text", item_id: str = "item_id", item_text: str = "text",
                    block_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) for every document row and item with
    at least ``threshold`` of the item's distinct shingles in the document. Letter case does
    not count.

    Null, empty and wordless texts contain nothing and are contained nowhere; a text with
    fewer words than ``width`` is one shingle; repeated rows report again; other columns are
    not read. The sketches are broadcast in blocks of at most about ``block_rows`` rows, one
    pass over the documents for each block.
    """
    sketches = item_sketches(items, threshold, width, item_id, item_text)
    blocks = max(1, -(-sketches.count() // block_rows))
    body = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), words_of(F.lower(F.col(f"`{text}`"))).alias("w"))
    hashed = body.select("doc_id", "w", shingle_hashes(F.col("w"), width).alias("hashes"))
    # the outer form keeps the optimizer from copying the shingling into a filter below it
    seen = hashed.select("doc_id", "w", "hashes", F.explode_outer("hashes").alias("hash"))
    found = []
    for block in range(blocks):
        some = sketches if blocks == 1 else sketches.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        # a numbered row keeps the tests below out of the join, where every shingle would
        # carry its document's arrays to them; only matching shingles do
        hit = seen.join(F.broadcast(some), "hash").select("*", F.monotonically_increasing_id().alias("place"))
        hit = hit.where((F.col("place") >= 0) & (~F.arrays_overlap("earlier", "hashes") | (F.size("earlier") == 0)))
        shared = F.size(F.array_intersect("item_shingles", shingle_texts(F.col("w"), width)))
        counted = hit.select("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item"), shared.cast("long").alias("n_shared"))
        found.append(counted.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - F.lit(1e-9)))
    return reduce(DataFrame.unionAll, found).select("*", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def _side(table: str, key: str) -> str:
    return f"""{table}_words as (select row_number() over () as r, {key},
  regexp_extract_all(lower(coalesce(text, '')), '{NOT_SPACE}+') as w from {table}),
{table}_grams as (select distinct r, {key}, array_to_string(g, ' ') as g from (select r, {key},
  case when len(w) < 5 then w else w[i:i+4] end as g from (
  select r, {key}, w, unnest(case when len(w) >= 5 then range(1, len(w) - 3) when len(w) > 0 then [1] else [] end) as i
  from {table}_words)))"""


DECONTAMINATION_SQL = f"""
with {_side('documents', 'doc_id')}, {_side('benchmark', 'item_id')},
sizes as (select r, count(*) as n from benchmark_grams group by r)
select doc_id, item_id, any_value(n)::BIGINT as n_item, count(*)::BIGINT as n_shared, count(*)::DOUBLE / any_value(n) as containment
from documents_grams d join benchmark_grams b using (g) join sizes s on s.r = b.r
group by d.r, b.r, doc_id, item_id having count(*) >= 0.8 * any_value(n) - 1e-9"""


def without_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The rows that contain no item, with all their columns."""
    # rows may share an id: each goes by its own text
    body = F.col(f"`{text}`")
    key = F.struct(record_key(F.col(f"`{doc_id}`"), body).alias("id"), F.xxhash64(F.coalesce(body, F.lit(""))).alias("text"))
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"))
    found = contained_items(docs.select(key.alias("doc_id"), F.col(f"`{text}`").alias("text")), items, **rules)
    return rows.join(found.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti").select("row.*")
