"""Vector codes, SimHash classes and spelling forms: brute force, edge cases and split groups."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulyze.functions import storage
from tabulyze.llm import simhash, spelling, vector_codes
from tabulyze.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
DOCS = "doc_id long, text string, n long, word string, node long, fp long, key string, least long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "w", 2, 3, "k", 4) for i, t in rows], DOCS)


# ---------------------------------------------------------------- vector codes

def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    kept = [(i, label, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v, label in rows
            if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max([1, *(len(v) for _, _, v in kept)])
    width = -(-width // parts) * parts
    size = width // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    kept = [(i, label, v + [0] * (width - len(v))) for i, label, v in kept]
    first = [v + [0] * (width - len(v)) for _, _, v in first]

    def cut(v, p):
        return v[p * size:(p + 1) * size]
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            own = collections.defaultdict(list)
            for _, _, v in kept:
                own[nearest(cut(v, p), book)[1]].append(cut(v, p))
            new.append([[sum(x) // len(own[e]) for x in zip(*own[e])] if own[e] else c for e, c in enumerate(book)])
        books = new
    out = []
    for i, label, v in kept:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)))
    sums = collections.Counter()
    for _, label, _, error in out:
        sums[label] += error
    return sorted([(i, code, error, sums[label]) for i, label, code, error in out], key=str)


VECTORS = "vec_id long, embedding array<float>, label int, v string, code string, slot int, group string"


def test_vector_edges(spark):
    rng = random.Random(5)
    rows = [(k, [round(rng.uniform(-0.4, 0.4), 1) for _ in range(32)], rng.choice([1, 2, None])) for k in range(150)]
    rows += [(200, None, 1), (201, [None] + [0.1] * 31, 1), (202, [float("nan")] * 32, 1), (203, [float("inf")] * 32, None),
             (None, [0.5] * 32, 7), (3, rows[3][1], 2), (3, [0.25] * 32, 2), (204, [], 9), (205, [0.1] * 5, 9), (206, [-0.001] * 32, 9)]
    frame = spark.createDataFrame([(*r, "x", "y", 1, "g") for r in rows], VECTORS)
    got = vector_codes.compress_vectors(frame).collect()
    assert sorted([(r.vec_id, r.code, r.error, r.label_error) for r in got], key=str) == codes_by_hand(rows)
    assert len({r.codebooks_sha256 for r in got}) == 1
    empty = vector_codes.compress_vectors(spark.createDataFrame([], VECTORS))
    assert empty.count() == 0 and "codebooks_sha256" in empty.columns
    few = vector_codes.compress_vectors(frame.where("vec_id < 3")).collect()
    assert all(r.error == 0 for r in few)
    huge = spark.createDataFrame([(1, [1e38] * 16, 1), (2, [-1e38] * 16, 1)], "vec_id long, embedding array<float>, label int")
    assert [r.error for r in vector_codes.compress_vectors(huge).collect()] == [0, 0]


def test_trie_equals_full_search():
    rng = np.random.default_rng(1)
    parts = rng.integers(-9, 9, (5000, 3))
    book = rng.integers(-9, 9, (64, 3))
    leaves, times, place = vector_codes.distinct_parts(parts)
    assert times.sum() == 5000 and (leaves[place] == parts).all()
    entry, distance = vector_codes.nearest_entries(leaves, book)
    full = ((leaves[:, None] - book) ** 2).sum(2)
    assert (entry == full.argmin(1)).all() and (distance == full.min(1)).all()


# ---------------------------------------------------------------- SimHash

def print_by_hand(text):
    w = WORD.findall((text or "").translate(LOWER))
    grams = [" ".join(w[k:k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_by_hand(rows):
    prints = [(i, print_by_hand(t)) for i, t in rows]
    values = np.array(sorted({p for _, p in prints}), np.uint64)
    up = list(range(len(values)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values[a + 1:] ^ values[a]) <= 3) + a + 1:
            up[top(int(b))] = top(a)
    at = {int(v): k for k, v in enumerate(values)}
    least = {}
    for i, p in prints:
        if i is not None:
            least[top(at[p])] = min(i, least.get(top(at[p]), i))
    return sorted([(i, f"{p:016x}", least.get(top(at[p]))) for i, p in prints], key=str)


def test_simhash_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = QUERIES["op12_simhash_classes"](spark, sf_dir).collect()
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == simhash_by_hand(rows)


def test_simhash_edges(spark, monkeypatch):
    rng = random.Random(3)
    long_ = " ".join(rng.choice("ab cd ef gh ij kl".split()) + str(rng.randrange(99)) for _ in range(5000))
    rows = [(1, None), (2, ""), (3, " \t "), (4, "One"), (5, "one"), (6, "one two"), (7, long_), (8, long_ + " tail"), (None, long_),
            (None, "alone here now"), (9, "x" * 5000), (1, long_), (10, "A b\nc d"), (10, "a B c\td")]
    monkeypatch.setattr(simhash, "CHUNK", 50)
    assert simhash.fingerprint(long_.encode()) == print_by_hand(long_)
    got = simhash.simhash_classes(docs(spark, rows)).collect()
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == simhash_by_hand(rows)
    assert simhash.simhash_classes(docs(spark, rows).where("false")).count() == 0


def close_values(n, seed):
    """Random codes, chains of close ones and a dense family."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    near = base[: n // 3] ^ (np.uint64(1) << rng.integers(0, 64, n // 3).astype(np.uint64))
    dense = np.uint64(0xABCDEF0123456789) ^ rng.integers(0, 1 << 11, n // 2).astype(np.uint64) << np.uint64(7)
    return np.unique(np.concatenate((base, near, near ^ np.uint64(5), dense)))


def classes_by_hand(values, bits=3):
    label = np.arange(len(values))
    for a in range(len(values)):
        hit = np.flatnonzero(np.bitwise_count(values ^ values[a]) <= bits)
        label[np.isin(label, label[hit])] = label[hit].min()
    return label


@pytest.mark.parametrize("links", [50, 1 << 18])
def test_index_equals_all_pairs(monkeypatch, links):
    monkeypatch.setattr(simhash, "LINKS", links)
    monkeypatch.setattr(simhash, "PAIRS", 200)
    values = close_values(900, 2)
    index = simhash.GrayIndex(values, np.array([len(values)]))
    assert (index.classes() == classes_by_hand(values)).all()
    sizes = np.array([1, 700, 1, 2, len(values) - 704])
    want = np.concatenate([classes_by_hand(part) + at for part, at in
                           zip(np.split(values, np.cumsum(sizes)[:-1]), np.cumsum(sizes) - sizes)])
    assert (simhash.GrayIndex(values, sizes).classes() == want).all()


@pytest.mark.parametrize("most", [8, 100, 1 << 18])
def test_split_nodes_lose_no_link(spark, most, monkeypatch):
    monkeypatch.setattr(simhash, "BUFFER", 64)
    values = close_values(600, 4)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = simhash.close_prints(simhash.top_nodes(frame, most=most)).collect()
    at = {int(v): k for k, v in enumerate(values.view(np.int64))}
    label = np.arange(len(values))
    for r in links:
        a, b = sorted((label[at[r.a]], label[at[r.b]]))
        label[label == b] = a
    assert (label == classes_by_hand(values)).all()


def test_links_are_not_written_by_partition(spark, monkeypatch, tmp_path):
    values = close_values(600, 4)
    rows = [(k, int(v)) for k, v in enumerate(values.view(np.int64))]
    monkeypatch.setattr(simhash, "fingerprints", lambda *_: spark.createDataFrame(rows, "doc_id long, fp long").coalesce(1))
    monkeypatch.setattr(storage, "shared_folder", lambda _: str(tmp_path))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "24")
        got = {r.doc_id: r.component_id for r in simhash.simhash_classes(docs(spark, [])).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert [got[k] for k in range(len(values))] == classes_by_hand(values).tolist()
    # every file costs an executor two forked commands; a table of a thousand rows needs no file per partition
    files = {path.name: len(list(path.glob("part-*"))) for path in tmp_path.iterdir()}
    assert files and max(files.values()) <= 8, files


def test_gray_rank(spark):
    codes = [k ^ k >> 1 for k in (0, 1, 2, 3, 1000, (1 << 64) - 1)]
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "fp long")
    got = [r[0] + (1 << 63) for r in frame.select(simhash.gray_rank(F.col("fp"))).collect()]
    assert got == [0, 1, 2, 3, 1000, (1 << 64) - 1]


# ---------------------------------------------------------------- spelling

def variants(word, letters):
    """All that one edit makes of a word."""
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    out = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in letters}
    return (out | {a + c + b[1:] for a, b in cuts if b for c in letters}) - {word}


def forms_by_hand(rows, letters=6, count=5):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= letters and n >= count}
    alphabet = {c for w in words for c in w}
    near = {w: [v for v in variants(w, alphabet) if v in words] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted([(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()], key=str)


def rows_of(df):
    return sorted([(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()], key=str)


def test_spelling_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = forms_by_hand(rows)
    assert any(r[1] for r in want)
    assert rows_of(QUERIES["op13_spelling_forms"](spark, sf_dir)) == want


@pytest.mark.parametrize("most", [10, 20_000])
def test_spelling_edges(spark, most, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK", 7)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    rng = random.Random(9)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(6, 9))) for _ in range(400)]
    words += ["Straßen", "abcabcabc", "Études", "études", "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    rows = [(k, " ".join(rng.choices(words, k=60)) + ", " + "aaaaaaa " * 30 + "abcabcab-" * (k % 3)) for k in range(60)]
    rows += [(1, rows[1][1]), (None, None), (2, None), (3, ""), (4, "!? 12"), (None, "abcabcabc " * 9), (5, "z" * 5000 + " " + "y" * 6)]
    got = rows_of(spelling.spelling_forms(docs(spark, rows), most=most))
    assert got == forms_by_hand(rows)
    assert len({r[2] for r in got}) < len(got)
    assert spelling.spelling_forms(docs(spark, rows).where("false")).count() == 0


def test_position_index_equals_edit_sets():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    index = spelling.PositionIndex(words)
    for w in itertools.islice(words, 0, None, 3):
        assert sorted(index.near(w)) == sorted(variants(w, "abc") & set(words))
