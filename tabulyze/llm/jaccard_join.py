"""Documents whose shingle sets are similar, joined exactly through several token orders.

Two sets with similarity t share at least l of the first |x| - ceil(t |x|) + l tokens of
each, whatever the order of all tokens. One order filters documents, then pairs, by such
prefixes in Spark; a second order is intersected with it next to the sets themselves, where
the remaining pairs are verified. Documents with equal sets count as one throughout.
Families too large for one comparison are searched again in a third order, common tokens last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from tabulyze.llm.graph import components
from tabulyze.llm.quality import NOT_SPACE
from tabulyze.llm.stores import drop_stored, shuffles_dropped, stored
from tabulyze.llm.words import mix, shingle_rows

SMALL = 16                  # tokens of at most so many sets give pairs, others join families
BLOCK_SHINGLES = 1_000_000  # sets compared in one task hold about twice as many
FILTER_BITS = 1 << 26       # size of the broadcast filter of set keys, whatever the input
LEVEL_BITS = 24             # size of the broadcast table of common tokens, as a power of 2, whatever the input


@dataclass(frozen=True)
class Rule:
    percent: int = 80
    width: int = 5
    spare: int = 4          # percent of a set added to its prefix, which as many shared tokens must repay

    def need(self, n):
        return -(-self.percent * n // 100)

    def shared(self, n):
        return -(-self.spare * n // 100)

    def prefix(self, n):
        return n - self.need(n) + self.shared(n)

    def shared_column(self, n: Column) -> Column:
        return F.ceil(n * self.spare / F.lit(100.0))

    def least_column(self, n: Column) -> Column:
        """Shared tokens that the smallest possible partner still asks for."""
        return F.ceil(F.ceil(n * self.percent / F.lit(100.0)) * self.spare / F.lit(100.0))


def record_key(doc_id: Column, text: Column) -> Column:
    """The id, or a key from the text where the id is null; such keys are above other ids."""
    mixed = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1))
    return F.coalesce(doc_id.cast("long"), mixed.bitwiseOR(F.lit(1 << 62)))


def keyed_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(k, id, text, row) of every row. ``id`` is the row's ``record_key``; ``k`` is the same,
    but made from id and text where several rows have the id, so that no two texts share it."""
    id_, body = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    ids = docs.where(id_.isNotNull()).groupBy(id_.cast("long").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    often = stored(ids.where("n > 1").select("id", F.lit(True).alias("often")), "often")
    rows = docs.select(record_key(id_, body).alias("id"), body.alias("text"), F.struct("*").alias("row"))
    if often.isEmpty():
        return rows.select(F.col("id").alias("k"), "id", "text", "row")
    own = F.xxhash64("id", F.coalesce("text", F.lit(""))).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return rows.join(often, "id", "left").select(F.when(F.col("often"), own).otherwise(F.col("id")).alias("k"), "id", "text", "row")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def signatures(rows: DataFrame, rule: Rule) -> DataFrame:
    """(k, id, n, g1, g2, prefix): size and hash of each set, and its prefix in the first order."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, g1, g2, prefix = [], [], [], []
            for _, own in shingle_rows(batch.column("text"), rule.width):
                n.append(len(own))
                g1.append(int(_signed(np.array([np.sum(mix(own, 1))], np.uint64))[0]))
                g2.append(int(_signed(np.array([np.bitwise_xor.reduce(mix(own, 2))], np.uint64))[0]) if len(own) else 0)
                prefix.append(_signed(own[:rule.prefix(len(own))]))
            sizes = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("id"), pa.array(n, pa.int64()), pa.array(g1, pa.int64()),
                                              pa.array(g2, pa.int64()), lists], ["k", "id", "n", "g1", "g2", "prefix"])
    return rows.mapInArrow(signed, "k long, id long, n long, g1 long, g2 long, prefix array<long>")


def matched_tokens(tokens: DataFrame, name: str) -> DataFrame:
    """(k, token, sets): tokens that several keys have, counted before they are shuffled."""
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1")
    return stored(tokens.join(counts, "token").select("k", "token", "sets"), name)


def living(matched: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """(k, n) of the sets that have enough matched tokens for any partner."""
    held = matched.groupBy("k").agg(F.count(F.lit(1)).alias("hits")).join(sizes, "k")
    return held.where(F.col("hits") >= rule.least_column(F.col("n"))).select("k", "n")


def candidate_edges(matched: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) that connect every two sets which may be similar.

    Tokens of few sets give pairs with the number of tokens they share; a pair needs as many
    as the smaller set asks for, less the frequent tokens both may share besides. Frequent
    tokens connect in a star those sets that could be similar by frequent tokens alone.
    """
    frequent = matched.where(F.col("sets") > SMALL)
    extra = frequent.groupBy("k").agg(F.count(F.lit(1)).alias("frequent"))
    facts = sizes.join(extra, "k", "left").select("k", "n", F.coalesce("frequent", F.lit(0)).alias("frequent"))
    lists = matched.where(F.col("sets") <= SMALL).groupBy("token").agg(F.array_sort(F.collect_list("k")).alias("ks"))
    pairs = F.flatten(F.transform("ks", lambda x, i: F.transform(
        F.slice("ks", i + 2, F.lit(SMALL)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    counted = lists.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("c")).where("a <> b")
    x, y = (facts.select(F.col("k").alias(s), F.col("n").alias(f"n_{s}"), F.col("frequent").alias(f"f_{s}")) for s in "ab")
    joined = counted.join(x, "a").join(y, "b")
    asked = F.least(rule.shared_column(F.col("n_a")), rule.shared_column(F.col("n_b")))
    near = (100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b"))
    kept = joined.where(near & (F.col("c") + F.least("f_a", "f_b") >= asked)).select("a", "b")
    # a set with fewer frequent tokens than any partner asks for is linked through others, which the pairs have
    crowd = facts.where(F.col("frequent") >= rule.least_column(F.col("n"))).select("k")
    frequent = frequent.join(crowd, "k", "left_semi")
    leaders = frequent.groupBy("token").agg(F.min("k").alias("a"))
    stars = frequent.join(leaders, "token").select("a", F.col("k").alias("b")).where("a <> b")
    return kept.unionAll(stars.distinct())


def families_of(once: DataFrame, sizes: DataFrame, rule: Rule) -> DataFrame:
    """(k, n, family) from the stored tokens (k, token, sets) that prefixes share, which are
    deleted. Two similar sets are of one family."""
    alive = living(once, sizes, rule)
    twice = matched_tokens(once.join(alive, "k", "left_semi").select("k", "token"), "matched")
    drop_stored(once)
    alive = stored(living(twice, sizes, rule), "alive")
    last = matched_tokens(twice.join(alive, "k", "left_semi").select("k", "token"), "matched")
    drop_stored(twice)
    found = components(candidate_edges(last, alive, rule)).select(F.col("node").alias("k"), F.col("component").alias("family"))
    found = stored(found.join(alive, "k").select("k", "n", "family"), "families")
    drop_stored(last, alive)
    return found


def token_levels(tokens: DataFrame, bits: int = LEVEL_BITS) -> np.ndarray:
    """How common tokens are, by their last bits: 0 for tokens of at most ``SMALL`` sets, one
    more for each doubling. Tokens that share a place have the level of the most common one;
    whatever the levels are, they put tokens in an order, and any order does."""
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > SMALL)
    level = F.least(F.lit(15), F.floor(F.log2(F.col("sets") / F.lit(float(SMALL)))) + 1).cast("long")
    places = common.groupBy(F.col("token").bitwiseAND(F.lit((1 << bits) - 1)).alias("place")).agg(F.max(level).alias("level"))
    places = stored(places, "levels")
    words = places.select(F.expr("place div 8").alias("word"), F.expr("shiftleft(level, cast(place % 8 as int) * 4)").alias("levels"))
    table = words.groupBy("word").agg(F.bit_or("levels").alias("levels")).toArrow()      # at most 2**bits / 8 rows
    drop_stored(places)
    out = np.zeros(1 << bits - 3, np.uint32)
    out[table.column("word").to_numpy()] = table.column("levels").to_numpy().astype(np.uint32)
    return out


def level_of(tokens: np.ndarray, levels: np.ndarray) -> np.ndarray:
    place = tokens & np.uint64(len(levels) * 8 - 1)
    return levels[place >> np.uint64(3)] >> ((place & np.uint64(7)) * np.uint64(4)).astype(np.uint32) & np.uint32(15)


def common_last(sets: DataFrame, levels: np.ndarray, rule: Rule) -> DataFrame:
    """(k, prefix) of sets (k, tokens) in the order of level and token."""
    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, prefix = batch.column("tokens"), []
            ends, values = tokens.offsets.to_numpy(), tokens.values.to_numpy().view(np.uint64)
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                own = values[a:b]                         # in the order of tokens
                prefix.append(_signed(own[np.argsort(level_of(own, levels), kind="stable")[:rule.prefix(len(own))]]))
            sizes = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("k"), lists], ["k", "prefix"])
    return sets.mapInArrow(ordered, "k long, prefix array<long>")


def in_parts(members: DataFrame, block_shingles: int) -> DataFrame:
    """The members (k, n, family) with the number of parts that their family is compared in."""
    parts = members.groupBy("family").agg(F.ceil(F.sum("n") / F.lit(float(block_shingles))).cast("int").alias("parts"))
    return members.join(parts, "family").select("k", "n", "family", "parts")


def split_families(members: DataFrame, rows: DataFrame, rule: Rule, block_shingles: int) -> DataFrame:
    """The members (k, n, family, parts), with smaller families in place of those of several parts.

    What many documents have, as a licence, connects documents that are not similar, so such a
    family grows with the input, and comparing its parts with each other grows with the square.
    With common tokens last, they are in the prefix of those sets only that hold little else.
    """
    members = stored(in_parts(members, block_shingles), "members")
    large = members.where("parts > 1").select("k", "n")
    if large.isEmpty():
        return members
    sets = sets_of(rows, key_filter(large.select("k")), rule)
    levels = token_levels(sets.select(F.explode("tokens").alias("token")))
    prefixes = stored(common_last(sets, levels, rule), "prefixes")
    once = matched_tokens(prefixes.select("k", F.explode("prefix").alias("token")), "matched")
    drop_stored(prefixes)
    split = in_parts(families_of(once, large, rule), block_shingles)
    return stored(members.where("parts = 1").unionAll(split), "members")


def key_filter(keys: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit set of hashed keys. Its size is fixed, so it may be sent to every task; it lets
    all keys of the table through, and few others while the table is much smaller."""
    place = F.pmod(F.xxhash64("k"), F.lit(bits))
    words = keys.select(place.alias("place")).select(F.expr("place div 32").alias("word"), F.expr("shiftleft(1L, cast(place % 32 as int))").alias("bit"))
    table = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()   # at most bits / 32 rows
    out = np.zeros(bits // 32, np.uint32)
    out[table.column("word").to_numpy()] = table.column("bit").to_numpy().astype(np.uint32)
    return out


def sets_of(rows: DataFrame, wanted: np.ndarray, rule: Rule) -> DataFrame:
    """(k, tokens) of rows whose key the filter lets through."""
    bits = len(wanted) * 32
    marked = rows.select("k", "text", F.pmod(F.xxhash64("k"), F.lit(bits)).alias("place"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            chosen = np.flatnonzero(wanted[place // 32] >> (place % 32).astype(np.uint32) & np.uint32(1))
            part = batch.take(pa.array(chosen))
            for first in range(0, len(chosen), 512):
                some = part.slice(first, 512)
                own = [_signed(s) for _, s in shingle_rows(some.column("text"), rule.width)]
                ends = np.concatenate(([0], np.cumsum([len(s) for s in own]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([some.column("k"), pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(np.concatenate(own) if own else np.zeros(0, np.int64)))], ["k", "tokens"])
    return marked.mapInArrow(listed, "k long, tokens array<long>")


class Postings:
    """Which sets have a token."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        ends = np.cumsum([len(s) for s in sets])
        tokens = np.concatenate(sets)
        order = np.argsort(tokens, kind="stable")
        self.owner = np.repeat(np.arange(self.n), [len(s) for s in sets])[order]
        counts = np.unique(tokens[order], return_counts=True)[1]
        self.first = np.concatenate(([0], np.cumsum(counts)))
        # where each token of each set is listed, so that no lookup is needed later
        self.code = np.empty(len(tokens), np.int64)
        self.code[order] = np.repeat(np.arange(len(counts)), counts)
        self.place = np.concatenate(([0], ends))
        self.counts = counts

    def shared(self, x: int) -> np.ndarray:
        """How many tokens of set ``x`` each set has."""
        code = self.code[self.place[x]:self.place[x + 1]]
        code = code[self.counts[code] > 1]
        if not len(code):
            return np.zeros(self.n, np.int64)
        return np.bincount(np.concatenate([self.owner[self.first[k]:self.first[k + 1]] for k in code]), minlength=self.n)


def links_of(keys: np.ndarray, sets: list[np.ndarray], side: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that connect what all similar pairs connect: pairs of one side, or across two.

    A pair is verified if its sizes fit and both orders' prefixes share enough tokens; pairs
    that earlier links already connect are left out.
    """
    n = np.array([len(s) for s in sets])
    asked = rule.shared(n)
    first = [s[:rule.prefix(len(s))] for s in sets]
    second = []
    for s in sets:
        other, size = mix(s, 3), rule.prefix(len(s))
        second.append(np.partition(other, size - 1)[:size])
    orders, whole = (Postings(first), Postings(second)), Postings(sets)
    group = np.arange(len(sets))
    across = side.min() != side.max()
    found = []
    for x in range(len(sets) - 1):
        open_ = (group != group[x]) & (100 * np.minimum(n, n[x]) >= rule.percent * np.maximum(n, n[x]))
        open_[:x + 1] = False
        if across:
            open_ &= side != side[x]
        for postings in orders:
            if not open_.any():
                break
            open_ &= postings.shared(x) >= np.minimum(asked, asked[x])
        if not open_.any():
            continue
        both = whole.shared(x)
        for y in np.flatnonzero(open_ & (100 * both >= rule.percent * (n + n[x] - both))):
            if group[y] != group[x]:
                found.append((int(keys[x]), int(keys[y])))
                group[group == group[y]] = group[x]
    return found


def verified_links(sets: DataFrame, rule: Rule, partitions: int) -> DataFrame:
    """(a, b) from rows (family, i, j, side, k, tokens): one comparison for each family and
    pair of its slices."""
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, held, sides = None, [], [], []

        def ended() -> pa.RecordBatch:
            links = links_of(np.array(keys), held, np.array(sides), rule) if len(keys) > 1 else []
            return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()),
                                               "b": pa.array([b for _, b in links], pa.int64())})
        for batch in batches:
            ids = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j")), strict=True))
            k, side, tokens = batch.column("k").to_numpy(), batch.column("side").to_numpy(), batch.column("tokens")
            ends, values = tokens.offsets.to_numpy(), tokens.values.to_numpy().view(np.uint64)
            for row, group in enumerate(ids):
                if group != now:
                    if now is not None:
                        yield ended()
                    now, keys, held, sides = group, [], [], []
                own = values[ends[row]:ends[row + 1]]
                if keys and keys[-1] == k[row] and sides[-1] == side[row] and np.array_equal(held[-1], own):
                    continue                      # a repeated row
                keys.append(k[row])
                sides.append(side[row])
                held.append(own.copy())
        if now is not None:
            yield ended()
    grouped = sets.repartition(partitions, "family", "i", "j").sortWithinPartitions("family", "i", "j", "side", "k")
    return grouped.select("family", "i", "j", "side", "k", "tokens").mapInArrow(compared, "a long, b long")


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(k, doc_id, n_shingles, component_id, stay) for every row; ``k`` is the key of id and text.

    ``component_id`` is the smallest id reachable by links, ``stay`` the key of a row that has
    it, which tells apart what is not linked but shares an id. Null, empty and wordless texts
    have no shingles and are linked with nothing; a text with fewer words than ``width`` has
    its word sequence as its one shingle; equal sets are linked, so repeated rows are; ids are
    expected to be whole numbers below 2**62, and rows that share one but not a text are
    compared as any others; a null id gets a key from its text; an empty table gives no
    rows; other columns are not read.
    """
    rule = Rule(percent, width)
    spark = docs.sparkSession
    with shuffles_dropped(spark):
        rows = keyed_rows(docs, doc_id, text).select("k", "id", "text")
        signed = stored(signatures(rows, rule), "signatures")
        classes = signed.where("n > 0").groupBy("g1", "g2").agg(F.min(F.struct("id", "k")).alias("at"), F.min("n").alias("n"))
        classes = stored(classes.select("g1", "g2", F.col("at.k").alias("rep"), F.col("at.id").alias("least"), "n"), "classes")
        sizes = classes.select(F.col("rep").alias("k"), "n")
        copies = signed.where("n > 0").join(classes.select("g1", "g2", "rep"), ["g1", "g2"]).where("k <> rep").select("k")
        single = signed.join(stored(copies, "copies"), "k", "left_anti")
        once = matched_tokens(single.select("k", F.explode("prefix").alias("token")), "matched")
        whole, signed = signed, stored(signed.select("k", "id", "n", "g1", "g2"), "signatures")
        drop_stored(whole)                            # the prefixes are the most of it
        members = split_families(families_of(once, sizes, rule), rows, rule, block_shingles)
        sets = sets_of(rows, key_filter(members.select("k")), rule)
        members = members.select("k", "family", "parts", F.pmod(F.xxhash64("k"), "parts").cast("int").alias("own"))
        # the set of a slice goes to the comparison with every slice of its family
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
        placed = sets.join(members, "k").select("k", "tokens", "family", "own", other)
        placed = placed.select("k", "tokens", "family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                               F.col("own").alias("side"))
        links = stored(verified_links(placed, rule, int(spark.conf.get("spark.sql.shuffle.partitions"))), "links")
        joined = components(links).select(F.col("node").alias("rep"), "component").join(classes.select("rep", "least"), "rep")
        first = joined.groupBy("component").agg(F.min(F.struct("least", "rep")).alias("at"))
        joined = joined.join(first, "component").select("rep", "at")
        named = classes.join(joined, "rep", "left").select("g1", "g2", F.coalesce("at", F.struct("least", "rep")).alias("at"))
        out = signed.join(named, ["g1", "g2"], "left")
        return out.select("k", F.when(F.col("id") < F.lit(1 << 62), F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"),
                          F.coalesce("at.least", "id").alias("component_id"), F.coalesce("at.rep", "k").alias("stay"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """The rows that stay, with all their columns: of every group of linked documents the one
    with the smallest id, and every row that is linked with nothing, as those without words."""
    found = similar_classes(docs, doc_id, text, **rules)
    stay = found.where("k = stay and n_shingles > 0").select(F.col("k").alias("key")).distinct()
    keyed = keyed_rows(docs, doc_id, text)
    words = F.coalesce("text", F.lit("")).rlike(NOT_SPACE)
    rows = keyed.where(words).select("row", F.col("k").alias("key"))
    # repeated rows have one key: the join has already brought them together
    first = Window.partitionBy("key").orderBy(F.xxhash64(F.col("row")[text]))
    kept = rows.join(stay, "key", "left_semi").select("row", F.row_number().over(first).alias("place")).where("place = 1")
    return kept.select("row.*").unionAll(keyed.where(~words).select("row.*"))
