"""Near copies by SimHash: a hierarchical index over fingerprints in Gray order."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.lookup import attach
from tabulyze.llm.graph import components
from tabulyze.llm.stores import stored

WIDTH, SEED, BITS = 3, 42, 3
CHUNK = 1 << 20         # bytes of a text split at a time
FAN = 8                 # nodes below a node of the index
PAIRS = 1 << 16         # (query, node) pairs widened at a time
LINKS = 1 << 18         # links held before they are merged
BUFFER = 1 << 18        # fingerprints whose groups are searched together
GROUP = 1 << 18         # a larger group is split by more bits
DEPTH = 4               # at most: 21 bits are free then, so a group has 2**21 fingerprints at most
SPACE = re.compile(rb"[\x20\x09-\x0D]")
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The 64-bit SimHash of a text: each bit is what over half of its shingles' hashes have.
    A text is read in chunks, so its length does not matter."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    text, ones, n, words, at = text.lower(), np.zeros(64, np.int64), 0, [], 0
    while at < len(text):
        cut = SPACE.search(text, at + CHUNK)
        end = cut.start() if cut else len(text)
        words = words[len(words) - width + 1 if len(words) >= width else 0:] + text[at:end].split()
        at = end
        if len(words) < width:
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1:].tolist())], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(hashes)
    if n == 0:
        return digest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` holds the 64 bits as a signed long."""
    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py() or b"", width) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(printed, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit code in the reflected Gray sequence, ordered as a signed long."""
    rank = fp
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def finer_masks(mask: int, bits: int = BITS) -> list[int]:
    """Masks of ``mask`` and one of ``bits + 1`` runs of the other bits: two codes that agree on
    ``mask`` and differ in at most ``bits`` of the others agree on one of these."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * k // (bits + 1) for k in range(bits + 2)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:])]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def top_nodes(prints: DataFrame, bits: int = BITS, most: int = GROUP) -> DataFrame:
    """(node, fp): every fingerprint below the topmost nodes of the index, one per mask.

    A node is a mask and the pattern its fingerprints share there. The first masks are the
    ``bits + 1`` runs of the 64 bits. A node with more than ``most`` fingerprints gives way to
    nodes of finer masks, ``DEPTH`` times at most: so few bits are free then that a node is
    small whatever the table holds. Every linked pair meets below one node at least.
    """
    done, rows, masks = [], prints.select("fp", F.lit(0).cast("long").alias("mask")), [0]
    for depth in range(DEPTH):
        finer = {m: finer_masks(m, bits) for m in masks}
        choice = F.lit(None).cast("array<long>")
        for m, below in finer.items():
            choice = F.when(F.col("mask") == _signed(m), F.array(*[F.lit(_signed(b)) for b in below])).otherwise(choice)
        masks = [b for below in finer.values() for b in below]
        rows = rows.select("fp", F.explode(choice).alias("mask"))
        rows = rows.withColumn("node", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))
        size = 0
        if depth < DEPTH - 1:
            large = stored(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most), "large_nodes")
            size, total = large.agg(F.count(F.lit(1)), F.sum("n")).first()
        if size == 0:
            done.append(rows.select("node", "fp"))
            break
        told = stored(attach(rows, large, "node", size, total), "nodes")
        done.append(told.where("n is null").select("node", "fp"))
        rows = told.where("n is not null").select("fp", "mask")
    return reduce(DataFrame.unionAll, done)


class GrayIndex:
    """Groups of fingerprints in Gray order below nodes that hold what their members share.

    Level 0 are the fingerprints. A node of the next level stands for up to ``FAN`` neighbours
    of its group and keeps the bits in which they agree; its members keep the other bits only.
    Neighbours in Gray order agree in most bits, so upper nodes hold long patterns. The
    differences of a query add up on its way down, and a node beyond ``bits`` of them is passed
    over with everything below it.
    """

    def __init__(self, prints: np.ndarray, sizes: np.ndarray):
        self.prints, self.label = prints, np.arange(len(prints))
        masks, patterns = [np.full(len(prints), FULL)], [prints]
        self.first_child, self.children, self.last = [None], [None], [np.arange(len(prints))]
        parents = []
        self.sizes = sizes
        while sizes.max(initial=1) > 1:
            above = -(-sizes // FAN)
            starts = np.cumsum(sizes) - sizes
            heads = np.repeat(starts - FAN * (np.cumsum(above) - above), above) + FAN * np.arange(above.sum())
            count = np.diff(np.append(heads, sizes.sum()))
            parents.append(np.repeat(np.arange(len(heads)), count))
            pattern, mask = patterns[-1], masks[-1]
            unlike = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[heads], count), heads)
            shared = np.bitwise_and.reduceat(mask, heads) & ~unlike
            masks.append(shared)
            patterns.append(pattern[heads] & shared)
            self.first_child.append(heads)
            self.children.append(count)
            self.last.append(self.last[-1][heads + count - 1])
            sizes = above
        self.patterns = patterns
        # what a node adds to its parent
        self.own = [m & ~masks[k + 1][parents[k]] for k, m in enumerate(masks[:-1])] + [masks[-1]]
        self.parents = parents
        self._relabel()

    def _relabel(self) -> None:
        """The least and greatest class below each node."""
        self.low, self.high = [self.label], [self.label]
        for heads in self.first_child[1:]:
            self.low.append(np.minimum.reduceat(self.low[-1], heads))
            self.high.append(np.maximum.reduceat(self.high[-1], heads))

    def _merge(self, links: list[tuple[np.ndarray, np.ndarray]]) -> None:
        a, b = (np.concatenate(side) for side in zip(*links, strict=True))
        while True:
            x, y = self.label[a], self.label[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            up = np.arange(len(self.label))
            np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
            while True:
                further = up[up]
                if np.array_equal(further, up):
                    break
                up = further
            self.label = up[self.label]
        self._relabel()

    def classes(self, bits: int = BITS) -> np.ndarray:
        """For each fingerprint the place of the first one that links of up to ``bits`` bits
        within its group reach. Pairs already known to be of one class are not searched."""
        top = len(self.patterns) - 1
        alone = np.repeat(self.sizes, self.sizes) < 2
        query = np.flatnonzero(~alone)
        root = np.repeat(np.arange(len(self.sizes)), self.sizes)[query]
        stack = [(top, query[k:k + PAIRS], root[k:k + PAIRS], np.zeros(len(query[k:k + PAIRS]), np.int64))
                 for k in range(0, len(query), PAIRS)] if top else []
        links, held = [], 0
        while stack:
            level, q, node, apart = stack.pop()
            mine = self.label[q]
            open_ = (self.low[level][node] != mine) | (self.high[level][node] != mine)
            q, node, apart = q[open_], node[open_], apart[open_]
            count = self.children[level][node]
            place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            child = np.repeat(self.first_child[level][node], count) + place
            q, below = np.repeat(q, count), level - 1
            apart = np.repeat(apart, count) + np.bitwise_count(
                (self.prints[q] ^ self.patterns[below][child]) & self.own[below][child])
            near = (apart <= bits) & (self.last[below][child] > q)
            q, child, apart = q[near], child[near], apart[near]
            if below:
                stack.extend((below, q[k:k + PAIRS], child[k:k + PAIRS], apart[k:k + PAIRS]) for k in range(0, len(q), PAIRS))
            elif len(q):
                links.append((q, child))
                held += len(q)
            if links and (held >= LINKS or not stack):
                self._merge(links)
                links, held = [], 0
        return self.label


def close_prints(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links that hold together whatever is within ``bits`` bits below a top node, one
    per fingerprint at most. A task reads its groups in Gray order and searches many at once."""
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def searched(node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            sizes = np.diff(np.append(starts, len(node)))
            label = GrayIndex(prints, sizes).classes(bits)
            moved = np.flatnonzero(label != np.arange(len(label)))
            return pa.RecordBatch.from_pydict({"a": pa.array(prints[moved].view(np.int64)),
                                               "b": pa.array(prints[label[moved]].view(np.int64))})
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            waiting.append((batch.column("node").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)))
            rows += batch.num_rows
            if rows < BUFFER or waiting[0][0][0] == waiting[-1][0][-1]:
                continue
            node, prints = (np.concatenate(side) for side in zip(*waiting, strict=True))
            cut = int(np.flatnonzero(node != node[-1])[-1]) + 1       # the last group may go on
            yield searched(node[:cut], prints[:cut])
            waiting, rows = [(node[cut:], prints[cut:])], len(node) - cut
        if rows:
            node, prints = (np.concatenate(side) for side in zip(*waiting, strict=True))
            yield searched(node, prints)
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = nodes.repartition(partitions, "node").sortWithinPartitions("node", gray_rank(F.col("fp")))
    return ordered.select("node", "fp").mapInArrow(linked, "a long, b long")


def simhash_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, bits: int = BITS,
                    most: int = GROUP) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row.

    A fingerprint is over the lower-cased word shingles of the whole text; with fewer words
    than ``width`` over the word sequence as one; null, empty and wordless texts have the
    fingerprint zero and are linked like any other. Rows are linked when their fingerprints
    differ in at most ``bits`` bits, so repeated rows are. ``component_id`` is the smallest id
    of the rows that links reach; null ids do not count, and a class of null ids has none. Rows
    that share an id but no class keep their own. An empty table gives no rows; other columns
    are not read.
    """
    prints = stored(fingerprints(docs, doc_id, text, width), "prints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct_prints")
    # read once, by a job that writes them in few files; written here they would be a small file per partition
    edges = close_prints(top_nodes(distinct, bits, most), bits)
    joined = components(edges).join(distinct.select(F.col("fp").alias("node"), "least"), "node")
    joined = stored(joined, "print_classes")
    first = stored(joined.groupBy("component").agg(F.min("least").alias("first"), F.count(F.lit(1)).alias("members")), "first_ids")
    size, total = first.agg(F.count(F.lit(1)), F.sum("members")).first()
    classes = attach(joined, first, "component", size, total or 0, "members").select(F.col("node").alias("fp"), "first")
    lookup = stored(distinct.join(classes, "fp", "left").select("fp", "n", F.coalesce("first", "least").alias("component_id")), "named_prints")
    size, total = lookup.agg(F.count(F.lit(1)), F.sum("n")).first()
    return attach(prints, lookup, "fp", size, total or 0).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
