"""Registered queries against DuckDB or brute force on whole tables."""

import collections
import hashlib
import re

import duckdb
import pytest

import corpus_pipeline
from tabulyze.llm.queries import ORACLES, QUERIES

NEEDED = ("documents", "benchmark", "conversations", "embeddings")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in NEEDED:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    want = sorted(str([r[names.index(c)] for c in sorted(names)]) for r in result.fetchall())
    assert sorted(names) == sorted(df.columns)
    assert sorted(str([r[c] for c in sorted(names)]) for r in df.collect()) == want


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(rows):
    """{id: (set size, smallest linked id)} by comparing all pairs."""
    sets = [(i, shingles(t)) for i, t in rows]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t) and top(i) != top(j):
                up[max(top(i), top(j))] = min(top(i), top(j))
    return {i: (len(s), top(i)) for i, s in sets}


def repeats(rows, length=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(t[p:p + length] for _, t in texts for p in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if seen[t[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not h for g, h in zip(gone, [False, *gone]))
        out.append((i, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_jaccard_classes(spark, duck, sf_dir):
    want = classes(duck.execute("select doc_id, text from documents").fetchall())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_jaccard_classes"](spark, sf_dir).collect()}
    assert got == want


def test_repeated_strings(spark, duck, sf_dir):
    want = repeats(duck.execute("select doc_id, text from documents").fetchall())
    got = QUERIES["op6_repeated_strings"](spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == want


def test_language_held_out(spark, duck, sf_dir):
    got = QUERIES["op9_language_centroids"](spark, sf_dir).where("held_out").collect()
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) >= 0.95 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_held_out(spark):
    # the smallest table has too few held-out labels to tell anything
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null")
    got = QUERIES["op10_toxic_segments"](spark, folder).where("held_out").join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.toxic for r in got) >= 0.85 * len(got)


def test_pages_lose_menus_and_keep_articles(spark, sf_dir):
    for r in QUERIES["op8_html_min_cut"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        import html as h
        blocks = [" ".join(h.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_pipeline_against_brute_force(spark, duck, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, sf_dir)
    rows = {r.doc_id: r.text for r in clean.collect()}
    one = stages["jaccard_join"](spark, clean, sf_dir)
    assert one.columns == docs.columns
    first = {c for _, c in classes(list(rows.items())).values()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(first)
    items = [shingles(t.lower()) for (t,) in duck.execute("select text from benchmark").fetchall()]
    kept = [i for i in first if not any(len(s & shingles(rows[i].lower())) >= 0.8 * len(s) - 1e-9 for s in items)]
    free = stages["decontamination"](spark, one, sf_dir)
    assert sorted(r.doc_id for r in free.collect()) == sorted(kept)
    mixed = stages["mixing"](spark, free, sf_dir)
    again = sorted(map(str, mixed.collect()))
    assert again == sorted(map(str, stages["mixing"](spark, free, sf_dir).collect()))
    assert max(collections.Counter(again).values()) <= 2
    done = stages["sharding"](spark, mixed, sf_dir)
    assert done.count() == len(again) and done.where("shard between 0 and 15").count() == len(again)
