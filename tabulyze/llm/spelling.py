"""Spelling variants: a bit-sliced index by position and letter finds words one edit apart."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.llm.stores import drop_stored, stored

# runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
TYPO = 199              # one (document, word) in so many loses a letter
LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
BLOCK = 4096            # words of one index, so bits of its sets
GROUP = 20_000          # words that share a part before they must share more
COUNTED = 100_000       # different words a task counts before it sends them


def typed_words(doc_id: object, text: bytes) -> Iterator[tuple[str, int]]:
    """(word, count) of one text: its runs of letters, A-Z lower-cased; by the crc32 of id and
    run, one run in ``TYPO`` loses the letter that the crc32 names."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower())).items():
        h = zlib.crc32(run, start)
        word = run.decode()
        if h % TYPO == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        yield word, n


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS,
               count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of at least ``letters`` letters and ``count`` occurrences overall.
    A task adds up what it reads before it sends it."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        for batch in batches:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for word, n in typed_words(i, t.as_py() or b""):
                    if len(word) >= letters:
                        held[word] += n
                if len(held) >= COUNTED:
                    yield sent()
                    held.clear()
        yield sent()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    words = rows.mapInArrow(counted, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


class PositionIndex:
    """Bit k of every set stands for word k: one set per (position, letter), one per length.

    A query reads its letters once and keeps four sets of words, all advanced by a few word-wide
    operations a letter: those that match so far without an error, and those that match with
    one replaced letter, with one letter more than the query (read at positions shifted up) and
    with one letter less (shifted down).
    """

    def __init__(self, words: list[str]):
        self.words, self.at, self.length = words, {}, {}
        bits: dict[tuple[int, str], list[int]] = {}
        for k, word in enumerate(words):
            self.length[len(word)] = self.length.get(len(word), 0) | 1 << k
            for place, letter in enumerate(word):
                bits.setdefault((place, letter), []).append(k)
        size = (len(words) + 7) // 8
        for key, members in bits.items():
            row = bytearray(size)
            for k in members:
                row[k >> 3] |= 1 << (k & 7)
            self.at[key] = int.from_bytes(row, "little")

    def near(self, query: str) -> list[str]:
        """The words exactly one inserted, deleted or replaced letter away."""
        at, get = self.at, self.length.get
        none = (1 << len(self.words)) - 1
        replaced = longer = shorter = 0
        for place, letter in enumerate(query):
            here = at.get((place, letter), 0)
            replaced = (replaced & here) | none
            longer = (longer | none) & at.get((place + 1, letter), 0)
            shorter = (shorter & at.get((place - 1, letter), 0)) | none
            none &= here
            if not (replaced or longer or shorter):
                return []
        m = len(query)
        found = (replaced & ~none & get(m, 0)) | ((longer | none) & get(m + 1, 0)) | (shorter & get(m - 1, 0))
        out = []
        while found:
            low = found & -found
            out.append(self.words[low.bit_length() - 1])
            found ^= low
        return out


def near_in_groups(rows: DataFrame) -> DataFrame:
    """(word, near) within each ``key``: words with ``asks`` 0 are indexed, in blocks, and each
    word with ``asks`` 1 is looked up in all blocks. Queries pass one at a time."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, index = None, [], None
        for batch in batches:
            left, right = [], []
            for k, asks, word in zip(*(batch.column(c).to_pylist() for c in ("key", "asks", "word")), strict=True):
                if k != key:
                    key, words, index = k, [], None
                if not asks:
                    words.append(word)
                elif words and words != [word]:
                    if index is None:
                        index = [PositionIndex(words[b:b + BLOCK]) for b in range(0, len(words), BLOCK)]
                    for block in index:
                        for near in block.near(word):
                            left.append(word)
                            right.append(near)
            yield pa.RecordBatch.from_pydict({"word": pa.array(left, pa.string()), "near": pa.array(right, pa.string())})
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(partitions, "key").sortWithinPartitions("key", "asks")
    return ordered.select("key", "asks", "word").mapInArrow(found, "word string, near string")


def _split(length: Column, front: Column, back: Column) -> Column:
    """The two finer frames of a frame: one edit leaves one half of what is free untouched."""
    half = F.floor((length - front - back) / 2).cast("int")
    return F.array(F.struct((front + half).alias("front"), back.alias("back")),
                   F.struct(front.alias("front"), (length - front - half).alias("back")))


def near_words(words: DataFrame, most: int = GROUP) -> DataFrame:
    """(word, near): all ordered pairs of words one edit apart, each once.

    A frame (length, front, back) brings together the indexed words of one length and the
    queries, one letter shorter to one longer, that begin with the same ``front`` letters and
    end with the same ``back`` letters. The first frames share half of the word. A frame of
    more than ``most`` rows gives way to frames that share half of what was free, down to
    one free letter, which only an alphabet of words can fill.
    """
    size = F.length("word")
    asked = words.select("word", F.lit(1).alias("asks"), F.explode(F.sequence(size - 1, size + 1)).alias("length"))
    rows = words.select("word", F.lit(0).alias("asks"), size.alias("length")).unionAll(asked)
    rows = rows.select("*", F.lit(0).alias("front"), F.lit(0).alias("back"))
    pairs = []
    while True:
        rows = rows.select("word", "asks", "length", F.explode(_split(F.col("length"), F.col("front"), F.col("back"))).alias("f"))
        rows = rows.select("word", "asks", "length", "f.*").where(F.col("front") + F.col("back") <= F.length("word"))
        ends = [F.col("word").substr(F.lit(1), F.col("front")), F.right("word", F.col("back"))]
        rows = rows.withColumn("key", F.xxhash64("length", "front", "back", *ends))
        large = rows.where("length - front - back > 1").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        large = stored(large, "large_frames")
        many = large.count()
        if many == 0:
            pairs.append(stored(near_in_groups(rows), "near"))
            break
        # so many frames of more than ``most`` rows are few; beyond that they are shuffled
        marked = rows.join(F.broadcast(large) if many <= 100_000 else large, "key", "left")
        told = stored(marked, "frames")
        pairs.append(stored(near_in_groups(told.where("n is null")), "near"))
        rows = told.where("n is not null").select("word", "asks", "length", "front", "back")
    out = pairs[0]
    for more in pairs[1:]:
        out = out.unionAll(more)
    return out.distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following the forms ends. Every round doubles the
    way that is known, and an occurrence count grows along it, so a few rounds do."""
    now = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further")).where("further <> root")
        later = stored(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                             F.col("further").isNotNull().alias("moved")), "roots")
        drop_stored(now)
        now = later
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_forms(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LEAST_LETTERS,
                   count: int = LEAST_COUNT, ratio: int = RATIO, most: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of the vocabulary.

    ``form`` is the near word with the largest count (ties: the first in code-point order) if
    it has at least ``ratio`` times the word's own; ``root`` is where forms lead. Null, empty
    and letterless texts add no words; a null id is read as an empty one; repeated rows count
    again; a run of any length is one word; an empty table gives no rows; other columns are
    not read. Counts cover every text; all that follows has the size of the vocabulary.
    """
    words = stored(vocabulary(docs, doc_id, text, letters, count), "vocabulary")
    pairs = near_words(words.select("word"), most)
    counted = pairs.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    # the largest count first, then the smallest word: the least of (-n, word)
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct(-F.col("near_n"), "near")).alias("best"))
    near = words.join(best, "word", "left")
    enough = -F.col("best.col1") >= ratio * F.col("n")
    found = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"),
                        F.when(enough, -F.col("best.col1")).alias("form_n"))
    found = stored(found, "forms")
    return found.join(with_roots(found), "word").select("word", "form", "root", "n", "n_near", "form_n")
