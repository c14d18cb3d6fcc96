"""Product codes of vectors: tries over distinct parts find the nearest codebook entries."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulyze.functions.lookup import attach
from tabulyze.llm.stores import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
MOST = 1 << 24      # larger components are read as this: squared distances then fit 64 bits
LEAVES = 2048       # leaves walked at a time


def nearest_entries(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of ``book`` and its squared distance for each of the distinct
    ``parts``, which are in lexicographic order.

    The sorted parts are the leaves of a trie whose level d holds the distinct prefixes of d
    numbers. It is walked depth first, a block of neighbouring leaves at a time: a prefix's
    distances to all entries are those of its parent plus one squared difference, computed
    once for all leaves below; a leaf takes the least, the lower index on ties.
    """
    entry, distance = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for first in range(0, len(parts), LEAVES):
        block = parts[first:first + LEAVES]
        parent = np.zeros(len(block), np.int64)
        reached = np.zeros((1, len(book)), np.int64)
        fresh = np.zeros(len(block), bool)
        fresh[0] = True
        for d in range(parts.shape[1]):
            fresh[1:] |= block[1:, d] != block[:-1, d]
            heads = np.flatnonzero(fresh)
            reached = reached[parent[heads]] + (block[heads, d, None] - book[:, d]) ** 2
            parent = np.cumsum(fresh) - 1
        nearest = reached.argmin(1)
        entry[first:first + LEAVES] = nearest[parent]
        distance[first:first + LEAVES] = reached[np.arange(len(nearest)), nearest][parent]
    return entry, distance


def distinct_parts(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in lexicographic order, how often each occurs, and each row's place."""
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    new = np.ones(len(parts), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(1)
    place = np.empty(len(parts), np.int64)
    place[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    return ordered[heads], np.diff(np.append(heads, len(parts))), place


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Integer lists as rows of ``width`` numbers, the shorter ones followed by zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def integer_vectors(df: DataFrame, vec_id: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, v): the rows whose vector is whole and finite, as integers."""
    numbers = F.col(vector).cast("array<double>")
    whole = F.forall(numbers, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    scaled = F.transform(numbers, lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(MOST))), F.lit(-float(MOST)))).cast("int"))
    return df.where(whole).select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), scaled.alias("v"))


def part_sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(slot, place, total) over all vectors: ``slot`` counts the entries of all parts, place -1
    is the number of parts an entry is nearest to, the others are sums by position. A task
    sends one row per slot and place."""
    parts, entries, size = books.shape

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((parts, entries, size + 1), np.int64)
        for batch in batches:
            rows = matrix(batch.column("v"), parts * size)
            for p in range(parts):
                leaves, times, _ = distinct_parts(rows[:, p * size:(p + 1) * size])
                entry, _ = nearest_entries(leaves, books[p])
                weighted = np.column_stack((times, leaves * times[:, None]))
                order = np.argsort(entry, kind="stable")
                heads = np.flatnonzero(np.diff(entry[order], prepend=-1))
                if len(heads):
                    totals[p, entry[order][heads]] += np.add.reduceat(weighted[order], heads, axis=0)
        used = totals.reshape(parts * entries, size + 1)
        slots = np.flatnonzero(used[:, 0])
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(np.repeat(slots, size + 1).astype(np.int32)),
            "place": pa.array(np.tile(np.arange(-1, size, dtype=np.int32), len(slots))),
            "total": pa.array(used[slots].reshape(-1))})
    sums = vectors.select("v").mapInArrow(summed, "slot int, place int, total long")
    return sums.groupBy("slot", "place").agg(F.sum("total").alias("total"))


def moved(books: np.ndarray, sums: list) -> np.ndarray:
    """Each entry at the floor of the mean of its parts; entries without parts stay."""
    parts, entries, size = books.shape
    totals = np.zeros((parts * entries, size + 1), np.int64)
    for slot, place, total in sums:
        totals[slot, place + 1] = total
    count = totals[:, :1]
    means = totals[:, 1:] // np.maximum(count, 1)
    return np.where(count > 0, means, books.reshape(parts * entries, size)).reshape(books.shape)


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def train_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, position) of ``integer_vectors``; None for an empty table. One
    scan a round; the driver holds ``entries`` vectors and as many sums."""
    width = vectors.agg(F.max(F.size("v"))).first()[0]
    if width is None:
        return None
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((len(first), -(-max(width, 1) // parts) * parts), np.int64)
    for row, r in enumerate(first):
        books[row, :len(r.v)] = r.v
    books = np.ascontiguousarray(books.reshape(len(first), parts, -1).swapaxes(0, 1))
    for _ in range(rounds):
        books = moved(books, part_sums(vectors, books).collect())
    return books


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error) of ``integer_vectors``: two hex digits per part."""
    parts, _, size = books.shape

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("v"), parts * size)
            codes, error = np.zeros((len(rows), parts), np.uint8), np.zeros(len(rows), np.int64)
            for p in range(parts):
                leaves, _, place = distinct_parts(rows[:, p * size:(p + 1) * size])
                entry, distance = nearest_entries(leaves, books[p])
                codes[:, p] = entry[place]
                error += distance[place]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"),
                                              pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)],
                                             ["vec_id", "label", "code", "error"])
    fields = vectors.schema
    schema = f"vec_id {fields['vec_id'].dataType.simpleString()}, label {fields['label'].dataType.simpleString()}, code string, error long"
    return vectors.select("vec_id", "label", "v").mapInArrow(coded, schema)


def compress_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                     parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256), one row per kept vector.

    A vector that is null or holds null, NaN or an infinity is dropped. Components are
    ``floor(256 * x)``, beyond 2**24 read as that. The longest vector decides the width,
    rounded up to a multiple of ``parts``; shorter vectors, empty ones too, are followed by
    zeros. The first entries are the vectors of the smallest ids, null ids last, repeated ids
    by vector; with fewer vectors there are fewer entries. Rows that share an id are coded one
    by one; null labels form one group; an empty table gives no rows; other columns are not
    read. A task walks one trie per batch and part, so no vector is shuffled. At most 256 entries.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    vectors = stored(integer_vectors(df, vec_id, vector, label), "vectors")
    books = train_codebooks(vectors, parts, entries, rounds)
    if books is None:
        return vectors.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                              F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = stored(encode(vectors, books), "codes")
    # nulls together, apart from every label
    keyed = codes.withColumn("group", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null")))
    sums = stored(keyed.groupBy("group").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_sums")
    size, total = sums.agg(F.count(F.lit(1)), F.sum("n")).first()
    return attach(keyed, sums, "group", size, total or 0).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))


# The same steps over one row per number; distances and indexes are packed into one integer, so
# that the least of them is the nearest entry with the lowest index.
_CELLS = f"""select r, (pos - 1) // w as p, (pos - 1) % w as i, v[pos] as x
from (select r, v, len(v) // {PARTS} as w, unnest(range(1, len(v) + 1)) as pos from kept)"""


def _sql() -> str:
    steps = [f"""kept as materialized (select row_number() over (order by vec_id, embedding) - 1 as r, vec_id, label,
    [cast(floor(cast(x as double) * {SCALE}) as bigint) for x in embedding] as v
    from embeddings where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0)""",
             f"cells as materialized ({_CELLS})",
             f"book0 as (select p, r as e, i, x from cells where r < {ENTRIES})"]
    for k in range(ROUNDS + 1):
        steps.append(f"""near{k} as materialized (select r, p, min(d * {ENTRIES} + e) // {ENTRIES} as d, min(d * {ENTRIES} + e) % {ENTRIES} as e
    from (select c.r, c.p, b.e, cast(sum((c.x - b.x) * (c.x - b.x)) as bigint) as d
          from cells c join book{k} b on c.p = b.p and c.i = b.i group by c.r, c.p, b.e) group by r, p)""")
        if k < ROUNDS:
            steps.append(f"""book{k + 1} as materialized (select b.p, b.e, b.i, coalesce(m.x, b.x) as x from book{k} b left join (
    select n.p, n.e, c.i, cast(floor(sum(c.x) / cast(count(*) as double)) as bigint) as x
    from near{k} n join cells c on n.r = c.r and n.p = c.p group by n.p, n.e, c.i) m on b.p = m.p and b.e = m.e and b.i = m.i)""")
    return "with " + ",\n".join(steps) + f""",
codes as (select r, string_agg(printf('%02x', e), '' order by p) as code, cast(sum(d) as bigint) as error from near{ROUNDS} group by r)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
    (select sha256(string_agg(cast(x as varchar), ',' order by p, e, i)) from book{ROUNDS}) as codebooks_sha256
from kept join codes using (r)"""


VECTOR_CODES_SQL = _sql()
