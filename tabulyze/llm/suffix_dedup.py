"""Byte strings that occur more than once, found column by column.

Inserting one symbol per whole document and round takes as many rounds as the longest
document has bytes, each over everything inserted so far. Documents are therefore cut into
short aligned strings first: minimal k-mers of every 200-byte window are its anchors, the
same in each of its copies, and a window can only be repeated among the strings cut round
equal anchors. Those strings are written to shared files sorted by anchor; every task reads
its files in sequence and inserts the strings' symbols from the last column to the first,
updating the order of all suffixes (whose preceding symbols are the transform) and the
common prefixes of neighbours. A window is repeated where a common prefix reaches 200.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabulyze.llm.jaccard_join import key_filter, keyed_rows
from tabulyze.llm.stores import drop_stored, stored
from tabulyze.llm.words import bytes_of, mix, powers, prefix_sums, row_chunks

KMER = 64
PIECE = 4 << 20        # a longer document is searched in pieces of so many bytes
STRINGS = 20_000       # strings ordered at once in a task
HOT_STRINGS = 50_000   # anchors with more different strings are counted by window instead; so many take 50 MB
PAD = 256              # a symbol no byte has, outside the document


def _sliding(values: np.ndarray, width: int, join) -> np.ndarray:
    """``join`` (minimum or maximum) over every ``width`` neighbours, by doubling."""
    done, out = 1, values
    while done * 2 <= width:
        out = join(out[:-done], out[done:])
        done *= 2
    return join(out[:len(out) - (width - done)], out[width - done:]) if done < width else out


def anchors(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(place, hash, hash of the string round it, bytes it lacks on the left) of every anchor
    in the concatenated documents that end at ``ends``."""
    n, span = len(data), length - KMER + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    sums = prefix_sums(data)
    _, down = powers(n + 1)
    kmers = mix((sums[KMER:] - sums[:-KMER]) * down[:n - KMER + 1])
    lows = _sliding(kmers, span, np.minimum)
    begins = np.concatenate(([0], ends[:-1]))
    sizes = ends - begins
    end_of = np.repeat(ends, sizes)
    lows[end_of[:n - length + 1] < np.arange(length, n + 1)] = 0
    room = np.zeros(span - 1, np.uint64)
    place = np.flatnonzero((kmers == _sliding(np.concatenate((room, lows, room)), span, np.maximum)) & (kmers > 0))
    begin = np.repeat(begins, sizes)[place]
    first, last = np.maximum(place - span + 1, begin), np.minimum(place + length, end_of[place])
    lacking = first - (place - span + 1)
    shape = (lacking * 1024 + (place + length - last)).astype(np.uint64)
    text = mix(mix((sums[last] - sums[first]) * down[first], 4) + shape, 5)
    return place, kmers[place].view(np.int64), text.view(np.int64), lacking


def anchor_rows(rows: DataFrame, length: int) -> DataFrame:
    """(a, s, k, pos) of every anchor of every document."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = bytes_of(batch.column("text"))
            keys = batch.column("k").to_numpy()
            for a, b in row_chunks(offsets):
                part, own = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
                margin = 2 * length
                for lo in range(0, max(len(part), 1), PIECE):
                    # pieces overlap by more than a string; each reports the anchors that begin in it
                    hi = min(len(part), lo + PIECE)
                    left, right = max(0, lo - margin), min(len(part), hi + margin)
                    inner = own[(own > left) & (own < right)]
                    place, kmer, text, _ = anchors(part[left:right], np.append(inner, right) - left, length)
                    mine = (place + left >= lo) & (place + left < hi)
                    place, kmer, text = place[mine] + left, kmer[mine], text[mine]
                    row = np.searchsorted(own, place, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(kmer), pa.array(text), pa.array(keys[a + row]),
                                                      pa.array(place - own[row])], ["a", "s", "k", "pos"])
    return rows.select("k", "text").mapInArrow(found, "a long, s long, k long, pos long")


def _passing(rows: DataFrame, wanted: np.ndarray, keep: bool) -> DataFrame:
    """Rows whose key the filter lets through, or the others."""
    bits = len(wanted) * 32
    marked = rows.select("k", "id", "text", F.pmod(F.xxhash64("k"), F.lit(bits)).alias("place"))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            hit = (wanted[place // 32] >> (place % 32).astype(np.uint32) & np.uint32(1)).astype(bool)
            yield batch.select(["k", "id", "text"]).take(pa.array(np.flatnonzero(hit == keep)))
    return marked.mapInArrow(passed, "k long, id long, text string")


def cut_strings(texts: DataFrame, length: int) -> DataFrame:
    """(a, n, k, pos, lacking, string) from (text, cuts): the strings round some anchors."""
    span = length - KMER + 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, cells = batch.column("cuts").offsets.to_numpy(), batch.column("cuts").values
            pos = cells.field("pos").to_numpy()
            for start in range(0, batch.num_rows, 256):
                strings = []
                for row, text in enumerate(batch.column("text").slice(start, 256), start):
                    data = (text.as_py() or "").encode()
                    strings += [data[max(0, p - span + 1):p + length] for p in pos[ends[row]:ends[row + 1]]]
                lo, hi = ends[start], ends[min(start + 256, batch.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [cells.field(c).slice(lo, hi - lo) for c in ("a", "n", "k", "pos")]
                    + [pa.array(np.maximum(0, span - 1 - pos[lo:hi])), pa.array(strings, pa.binary())],
                    ["a", "n", "k", "pos", "lacking", "string"])
    return texts.mapInArrow(cut, "a long, n long, k long, pos long, lacking long, string binary")


def repeated_columns(group: np.ndarray, strings: list[bytes], lacking: np.ndarray, length: int) -> np.ndarray:
    """For each column and string, whether the window that begins there occurs in another
    string of its group at the same column.

    ``group`` ascends. One round per column, from the last to the first: the new symbol
    goes in front of every suffix, a stable sort by symbol gives their new order, and the
    common prefix of two neighbours is one more than the least between them before.
    """
    span = length - KMER + 1
    width, m = span - 1 + length, len(strings)
    columns = np.full((width, m), PAD, np.int16)
    for k, s in enumerate(strings):
        columns[lacking[k]:lacking[k] + len(s), k] = np.frombuffer(s, np.uint8)
    until = lacking + np.array([len(s) for s in strings])
    order, common = np.arange(m), np.zeros(m + 1, np.int32)
    out = np.zeros((span, m), bool)
    base = group.astype(np.int64) * (PAD + 1)
    for c in range(width - 1, -1, -1):
        key = base[order] + columns[c][order]
        perm = np.argsort(key, kind="stable")
        key = key[perm]
        order = order[perm]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        low, high = perm[same - 1] + 1, perm[same] + 1
        least = common[high - 1]
        far = np.flatnonzero(high > low + 1)
        if len(far):
            bounds = np.stack([low[far], high[far]], axis=1).ravel()
            least[far] = np.minimum.reduceat(common, bounds)[::2]
        common = np.zeros(m + 1, np.int32)
        common[same] = least + 1
        if c < span:
            hit = common[:m] >= length
            hit[:-1] |= hit[1:]
            inside = (lacking <= c) & (c + length <= until)
            out[c, order] = hit
            out[c] &= inside
    return out


def column_spans(strings: DataFrame, length: int) -> DataFrame:
    """(k, first, last): begins of repeated windows, from strings sorted by anchor."""
    span = length - KMER + 1

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(part: list[tuple]) -> pa.RecordBatch:
            a = np.array([r[0] for r in part])
            group = np.concatenate(([0], np.cumsum(a[1:] != a[:-1])))
            found = repeated_columns(group, [r[5] for r in part], np.array([r[4] for r in part]), length)
            k, first, last = [], [], []
            for j, (_, n, key, pos, _, _) in enumerate(part):
                if n == 1 and found[:, j].any():     # the others are repeated as a whole
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], found[:, j].astype(np.int8), [0]))))
                    for lo, hi in zip(edge[::2], edge[1::2], strict=True):
                        k.append(key)
                        first.append(pos - span + 1 + int(lo))
                        last.append(pos - span + int(hi))
            return pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int64()), "first": pa.array(first, pa.int64()),
                                               "last": pa.array(last, pa.int64())})
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "n", "k", "pos", "lacking", "string")), strict=True):
                if len(held) >= STRINGS and held[-1][0] != row[0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)
    return strings.mapInArrow(searched, "k long, first long, last long")


def counted_spans(strings: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many strings: windows are hashed and counted, so that
    no task needs all strings of an anchor.

    A window may cover several anchors, or one at several places, and is in a string of each.
    It is therefore counted at one column of one anchor, as in ``repeated_columns``, where
    every occurrence is met once.
    """
    span = length - KMER + 1

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, k, pos, lacking, s in zip(*(batch.column(c).to_pylist() for c in ("a", "n", "k", "pos", "lacking", "string")), strict=True):
                data = np.frombuffer(s, np.uint8)
                starts = np.arange(len(data) - length + 1)
                starts = starts[starts + lacking < span]
                sums, (_, down) = prefix_sums(data), powers(len(data) + 1)
                raw = (sums[starts + length] - sums[starts]) * down[starts]
                digest = [hashlib.blake2b(s[i:i + length], digest_size=8).digest() for i in starts]
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(np.full(len(starts), a)), "column": pa.array(lacking + starts),
                    "w1": pa.array(mix(raw, 6).view(np.int64)), "w2": pa.array(np.frombuffer(b"".join(digest), np.int64)),
                    "n": pa.array(np.full(len(starts), n)), "k": pa.array(np.full(len(starts), k)),
                    "first": pa.array(pos - span + 1 + lacking + starts)})
    rows = strings.mapInArrow(windows, "a long, column long, w1 long, w2 long, n long, k long, first long")
    window = ["a", "column", "w1", "w2"]
    often = rows.groupBy(*window).agg(F.sum("n").alias("all")).where("all > 1").select(*window)
    return rows.where("n = 1").join(often, window).select("k", "first", F.col("first").alias("last"))


def _kept(data: bytes, first: np.ndarray, last: np.ndarray, length: int) -> tuple[int, int, bytes]:
    """Removed bytes, runs, and what is left; windows begin from ``first`` to ``last``."""
    first, last = np.maximum(first, 0), np.minimum(last, len(data) - length)
    real = first <= last
    order = np.argsort(first[real], kind="stable")
    begin, end = first[real][order], np.maximum.accumulate(last[real][order] + length) if real.any() else last[:0]
    if not len(begin):
        return 0, 0, data
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    edges = np.concatenate(([0], np.stack([begin, end], axis=1).ravel(), [len(data)]))
    return int((end - begin).sum()), len(begin), b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))


def repeated_spans(rows: DataFrame, length: int, hot: int = HOT_STRINGS) -> DataFrame:
    """(k, spans): the begins of all repeated windows of each document that has any."""
    span = length - KMER + 1
    found = stored(anchor_rows(rows, length), "anchors")
    counts = found.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("lo"), F.max("s").alias("hi")).where("n > 1")
    again = stored(found.join(counts, "a").select("a", "s", "k", "pos", (F.col("lo") == F.col("hi")).alias("one")), "again")
    drop_stored(found)
    whole = lambda df: df.select("k", (F.col("pos") - (span - 1)).alias("first"), F.col("pos").alias("last"))
    mixed = again.where("not one")
    kinds = stored(mixed.groupBy("a", "s").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "pos")).alias("at")), "kinds")
    copies = mixed.join(kinds.where("n > 1").select("a", "s"), ["a", "s"])
    cuts = kinds.select(F.col("at.k").alias("k"), F.struct("a", "n", F.col("at.k").alias("k"), F.col("at.pos").alias("pos")).alias("cut"))
    cuts = cuts.groupBy("k").agg(F.collect_list("cut").alias("cuts"))
    texts = _passing(rows, key_filter(kinds.select(F.col("at.k").alias("k"))), True).join(cuts, "k").select("text", "cuts")
    crowds = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("kinds"))
    strings = cut_strings(texts, length).join(crowds.where(F.col("kinds") > hot).select("a", F.lit(True).alias("hot")), "a", "left")
    # repeated rows give a string twice; it still counts once
    strings = stored(strings.repartition("a").sortWithinPartitions("a", "k", "pos"), "strings")
    cold = strings.where("hot is null").repartition("a").sortWithinPartitions("a", "k", "pos")
    parts = [whole(again.where("one")), whole(copies), column_spans(cold, length), counted_spans(strings.where("hot"), length)]
    spans = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return stored(spans.groupBy("k").agg(F.collect_list(F.struct("first", "last")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, length: int = 200, doc_id: str = "doc_id", text: str = "text", hot: int = HOT_STRINGS) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans, kept_sha256) for every row; ``kept`` are the
    bytes outside all strings of ``length`` bytes that also begin elsewhere.

    Null and empty texts have no bytes; texts shorter than ``length`` lose nothing; repeated
    rows are copies of each other, so at ``length`` or more they lose all; rows that share
    an id but not a text are documents of their own; ids are whole numbers below 2**62, and
    null ids stay null; an empty table gives no rows; other columns are not read. ``length``
    is at least 100.
    """
    rows = keyed_rows(docs, doc_id, text).select("k", "id", F.coalesce("text", F.lit("")).alias("text"))
    spans = repeated_spans(rows, length, hot)
    wanted = key_filter(spans.select("k"))
    schema = "id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, cells = batch.column("spans").offsets.to_numpy(), batch.column("spans").values
            first, last = cells.field("first").to_numpy(), cells.field("last").to_numpy()
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                done = []
                for row, text in enumerate(part.column("text"), start):
                    data = text.as_py().encode()
                    removed, runs, left = _kept(data, first[ends[row]:ends[row + 1]], last[ends[row]:ends[row + 1]], length)
                    done.append((left, len(data), removed, runs, hashlib.sha256(left).hexdigest()))
                kept, n, removed, runs, digest = zip(*done, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(kept, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(runs, pa.int64()), pa.array(digest, pa.string())],
                    ["id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"])
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    some = _passing(rows, wanted, True).join(spans, "k", "left").select("id", "text", F.coalesce("spans", none).alias("spans"))
    data = F.col("text").cast("binary")
    rest = _passing(rows, wanted, False).select("id", data.alias("kept"), F.octet_length(data).cast("long").alias("n_bytes"),
                                                F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
                                                F.sha2(data, 256).alias("kept_sha256"))
    out = some.mapInArrow(cleaned, schema).unionAll(rest)
    return out.select(F.when(F.col("id") < F.lit(1 << 62), F.col("id")).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
