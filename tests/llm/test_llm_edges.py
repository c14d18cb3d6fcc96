"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulyze.llm import (chat, decontaminate, graph, html_extract, jaccard_join, language_id, mixing, quality, sharding, suffix_dedup,
                          toxicity)
from test_llm_oracles import classes, repeats

SCHEMA = "doc_id long, text string, source string, n long, k long, a long, token long, place long, row string, shard string, size string"


def sentence(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("bad cat dog ear fox gnu hen ibis jay koi lynx mole newt owl pig ram".split()) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    base, long_ = sentence(1, 120), sentence(2, 40_000)
    texts = [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "ONE two"), (None, base),
             (None, None), (9, long_), (10, long_ + " more words at the end"), (11, "x" * 1000), (12, "ab" * 300 + base), (13, "é" * 150),
             (14, sentence(3, 90) + " " + base), (15, sentence(4, 90) + " " + base), (1, base), (16, "=- " * 400)]
    rows = [(i, t, None if n % 5 == 0 else f"s{n % 3}", 1, 2, 3, 4, 5, "r", "s", "z") for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_edges(awkward, nothing):
    rows = quality.line_quality(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (4, 5, 6):
        assert by[i].n_words == 0 and by[i].base_failed and not by[i].kept
    assert by[16].n_repeat_words == 400 and by[16].base_failed
    assert quality.line_quality(nothing).count() == 0


def test_quality_drops_failing_lines(spark):
    text = "Home | News | Shop | About\nA good line with several words in it ends here.\n### $$$ &&&.\nAll rights reserved."
    row = quality.line_quality(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.clean_text == "A good line with several words in it ends here."
    assert not row.kept and not row.base_failed


def test_sharding_edges(awkward, nothing):
    rows = sharding.shard_rows(awkward, [1.0, 2.0, 0.5]).collect()
    assert len(rows) == awkward.count()
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert all(r.grown_shard in (r.shard, 3) for r in rows)
    assert {r.size for r in rows if r.doc_id == 4} == {1}
    assert sharding.shard_rows(nothing, [1.0]).count() == 0
    assert sharding.with_shard(awkward, [1.0] * 4).columns.count("shard") == 1


def test_weights_decide_shares(spark):
    shards = spark.range(20_000).select(sharding.shard_of(F.col("id").cast("string"), [1.0, 3.0]).alias("s")).groupBy("s").count()
    n = {r.s: r["count"] for r in shards.collect()}
    assert abs(n[1] / 20_000 - 0.75) < 0.02


def test_mixing_edges(awkward, nothing):
    rows = mixing.mix_copies(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r.copies <= 2 for r in rows)
    assert mixing.mix_copies(nothing).count() == 0
    assert mixing.mixed_rows(awkward).columns == awkward.columns


def test_targets_fill_level_by_level(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    total, weight = 1.5 * 1160, {"a": 5.0, "b": 2.0, "c": 1.0, None: 5.0}
    size = {"a": 10, "b": 100, "c": 1000, None: 50}
    full = {}
    while True:      # reshare the excess until none is above
        left = [s for s in weight if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * size[s]]
        if not over:
            break
        full |= {s: 2.0 * size[s] for s in over}
    assert got == pytest.approx(full | {s: level * weight[s] for s in left})


def test_mix_hits_targets(spark):
    rows = [(i, " ".join("w" * (i % 37 + 1)), f"s{i % 4}") for i in range(4000)]
    got = mixing.mix_copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) <= 37


def test_inclusion_follows_the_wanted_probabilities(spark):
    # each source draws the same 60 lengths with keys of its own: 400 draws in one job
    lengths = [3 + 7 * k for k in range(60)]
    rows = [(s * 100 + k, " ".join("w" * n), f"s{s}") for s in range(400) for k, n in enumerate(lengths)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8)
    got = mixing.mix_copies(docs, cycle=(1.0,), share=0.4).collect()
    n, wanted = collections.Counter(), {}
    for r in got:
        n[r.size] += r.copies
        wanted[r.size] = r.expected
    assert all(abs(n[k] / 400 - wanted[k]) < 0.11 for k in lengths)
    assert abs(sum(n[k] / 400 - wanted[k] for k in lengths)) < 0.6
    assert sum(wanted[k] * k for k in lengths) == pytest.approx(0.4 * sum(lengths))
    assert wanted[lengths[-1]] / wanted[3] == pytest.approx(9 / 2)       # binary digits of 416 and of 3
    assert n[lengths[-1]] / 400 > 2 * n[10] / 400
    # the probabilities decide, not the random numbers alone
    one = [r for r in got if r.source == "s7"]
    u = {r.doc_id: u for r, u in zip(one, (x.u for x in spark.createDataFrame([(str(r.doc_id),) for r in one], "k string").select(
        mixing.uniform(F.col("k"), 42).alias("u")).collect()))}
    taken = [u[r.doc_id] for r in one if r.copies]
    assert max(taken) > min(u[r.doc_id] for r in one if not r.copies)


@pytest.mark.parametrize("share", [1e-4, 0.001, 0.5, 0.999])
def test_rank_buckets_are_even(spark, share):
    docs = spark.range(40_000).select(F.col("id").cast("string").alias("key"), F.lit("s").alias("source"),
                                      (F.col("id") % 500 + 1).alias("size"))
    docs = docs.select("*", mixing.weight_of(F.col("size")).alias("weight"))
    ranked = mixing.drawn(docs, mixing.expected_copies(docs, share=share), 42, 100)
    counts = [r["count"] for r in ranked.groupBy("bucket").count().collect()]
    assert len(counts) == 100 and max(counts) < 520       # 400 each


def test_heaviest_weights_fill_first(spark):
    docs = spark.createDataFrame([("a", 1, 1.0), ("a", 100, 7.0), ("a", 1000, 10.0), ("b", 0, 1.0), (None, 8, 4.0)],
                                 "source string, size long, weight double")
    got = {(r.source, r.weight): r.expected for r in mixing.expected_copies(docs, cycle=(1.0,), share=1.95).collect()}
    # 1.95 x 1109 words: the null source is full with 16, source a gets 2146.55 of at most 2202
    level = (2146.55 - 2000) / (100 * 7 + 1)
    assert got[("a", 10.0)] == 2.0 and got[(None, 4.0)] == 2.0 and got[("b", 1.0)] == 0.0
    assert got[("a", 7.0)] == pytest.approx(level * 7) and got[("a", 1.0)] == pytest.approx(level)


LAYOUTS = [('{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "yo"}]}', [("user", "hi"), ("assistant", "yo")]),
           ('{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}', [("user", "hi"), ("assistant", "yo")]),
           ('{"completion": "yo", "prompt": "hi"}', [("user", "hi"), ("assistant", "yo")]),
           ('{"instruction": "do", "input": "", "output": "done"}', [("user", "do"), ("assistant", "done")]),
           ('{"instruction": "do", "input": "this", "output": "done"}', [("user", "do"), ("user", "this"), ("assistant", "done")]),
           ('{"system": "be", "prompt": "hi", "response": null}', [("system", "be"), ("user", "hi"), ("assistant", "")]),
           ('{"unheard": "of"}', [(None, None)])]


def test_layouts_become_turns(spark):
    rows = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(LAYOUTS)], "conv_id long, j string")
    got = collections.defaultdict(list)
    for r in chat.canonical_turns(rows.select("conv_id", F.parse_json("j").alias("record"))).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert [got[k] for k in range(len(LAYOUTS))] == [want for _, want in LAYOUTS]


MORE_FIELDS = [
    ('{"id": 7, "messages": [{"role": "user", "content": "hi", "name": "x"}, {"role": "assistant", "content": "yo"}], "source": {"a": {"b": 1}}}',
     [("user", "hi"), ("assistant", "yo")], True),
    ('{"conversations": [{"from": "human", "value": "hi"}], "id": "k"}', [("user", "hi")], True),
    ('{"prompt": "hi", "response": "yo"}', [("user", "hi"), ("assistant", "yo")], False),
    ('{"completion": "yo", "prompt": "hi", "system": "be"}', [(None, None)], True),
    ('{"messages": ["hi", {"role": "user", "content": "yo"}]}', [(None, None)], True),
    ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "hi"}]}]}', None, False),
    ('["hi"]', [(None, None)], True)]


TURNS_BESIDE_FIELDS = [
    ('{"system": "be", "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}]}', [("system", "be"), ("user", "hi"), ("assistant", "yo")], False),
    ('{"prompt": "p", "messages": [{"role": "human", "content": "hi"}]}', [("human", "hi")], True),
    ('{"system": "", "prompt": "hi", "response": "yo"}', [("user", "hi"), ("assistant", "yo")], False),
    ('{"messages": [{"role": null, "content": null}]}', [("", "")], False),
    ('{"messages": []}', [(None, None)], True), ('[1, 2]', [(None, None)], True), ('"text"', [(None, None)], True)]


def test_turns_beside_other_fields(spark):
    rows = spark.createDataFrame([(k, r[0]) for k, r in enumerate(TURNS_BESIDE_FIELDS)], "conv_id long, j string")
    turns = chat.canonical_turns(rows.select("conv_id", F.parse_json("j").alias("record"))).cache()
    done = {r.conv_id: r for r in chat.format_chat(turns).collect()}
    for k, (text, want, carried) in enumerate(TURNS_BESIDE_FIELDS):
        assert [(r.role, r.text) for r in turns.where(F.col("conv_id") == k).orderBy("turn").collect()] == want
        assert [json.loads(r) for r in done[k].raw] == ([json.loads(text)] if carried else [])
        assert (done[k].formatted == "") == (want == [(None, None)])


def test_conversations_go_through_every_layout(spark):
    shapes = [("user", "assistant"), ("user", "user", "assistant"), ("system", "user", "assistant"), ("system", "user", "assistant", "user"),
              ("human", "gpt"), ("user",), ("system",), ("user,assistant",), (None, "tool"), ("system", "model", "user")]
    rows = [(k, t, role, ("", None, chat.PLANTED, f"said {k}")[(k // 10 + t) % 4]) for k in range(800) for t, role in enumerate(shapes[k % 10])]
    records = chat.as_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).cache()
    kinds = {tuple(r.p) for r in records.select(F.array_sort(chat.field_paths(F.col("record"))).alias("p")).distinct().collect()}
    assert len(kinds) == 9       # ten layouts, two of which differ in an empty input only
    got = collections.defaultdict(list)
    turns = chat.canonical_turns(records)
    for r in turns.orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
        assert r.raw is None or '"id"' in r.raw
    want = collections.defaultdict(list)
    for k, _, role, text in rows:
        want[k].append((role or "", text or ""))
    assert got == want


def test_no_field_of_a_record_is_lost(spark):
    rows = spark.createDataFrame([(k, r[0]) for k, r in enumerate(MORE_FIELDS)], "conv_id long, j string")
    turns = chat.canonical_turns(rows.select("conv_id", F.parse_json("j").alias("record"))).cache()
    raw = {r.conv_id: r.raw for r in chat.format_chat(turns).collect()}
    for k, (text, want, carried) in enumerate(MORE_FIELDS):
        got = [(r.role, r.text) for r in turns.where(F.col("conv_id") == k).orderBy("turn").collect()]
        if want is None:
            assert len(got) == 1 and "hi" in got[0][1]
        else:
            assert got == want
        assert [json.loads(r) for r in raw[k]] == ([json.loads(text)] if carried else [])


def test_chat_round_trip(spark):
    texts = [chat.PLANTED, "100% <|x|> %7C %25 <%7C", "", None, "a\nb\\n<", "<|", "ünïcode <|im_end|>\n"]
    rows = [(1, k, ("user", "assistant", None, "odd\nrole %0A")[k % 4], t) for k, t in enumerate(texts)] + [(None, 0, "assistant", "x"), (2, 0, "user", "q")]
    df = chat.format_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: r for r in df.select("conv_id", chat.read_turns(F.col("formatted")).alias("t"),
                                          chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [(r[2] or "", r[3] or "") for r in rows[:len(texts)]]
    assert got[1].loss == "".join(r[3] or "" for r in rows[:len(texts)] if r[2] == "assistant")
    assert got[None].loss == "x" and got[2].loss == ""
    assert chat.format_chat(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 1000 + i) for i in range(50)]
    up = {}
    top = lambda x: x if up.setdefault(x, x) == x else top(up[x])
    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_jaccard_edges(awkward, nothing):
    got = jaccard_join.similar_classes(awkward).collect()
    assert len(got) == awkward.count()
    named = {(r.doc_id, r.text) for r in awkward.collect() if r.doc_id is not None}
    want = classes(sorted(named, key=lambda x: x[0]))
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    assert {r.component_id for r in got if r.doc_id is None and r.n_shingles} == {1}
    assert jaccard_join.similar_classes(nothing).count() == 0
    stay = jaccard_join.one_of_each(awkward)
    assert stay.columns == awkward.columns
    assert [r.doc_id for r in stay.collect()].count(1) == 1


def test_rows_that_share_an_id(spark):
    a, b, c = sentence(31, 80), sentence(32, 300), sentence(33, 30)
    rows = [(5, a), (5, b), (5, a), (7, a + " tail"), (8, c), (8, c + " tail"), (9, b), (10, c), (None, None), (None, ""), (None, " "), (6, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similar_classes(docs)
    linked = {(r.doc_id, r.n_shingles, r.component_id) for r in got.where("n_shingles > 0").collect()}
    assert linked == {(5, 76, 5), (5, 296, 5), (7, 77, 5), (8, 26, 8), (8, 27, 8), (9, 296, 5), (10, 26, 8)}
    stay = sorted(((r.doc_id, r.text) for r in jaccard_join.one_of_each(docs).collect()), key=str)
    assert len(stay) == 8 and {(5, a), (5, b)} < set(stay)
    assert sum(i == 8 for i, _ in stay) == 1 and sum(not (t or "").strip() for _, t in stay) == 5
    items = spark.createDataFrame([(1, sentence(31, 40))], "item_id long, text string")
    free = decontaminate.without_items(docs, items).collect()
    assert sorted(map(str, free)) == sorted(str(r) for r in docs.collect() if not (r.text or "").startswith(a))


def test_large_families_in_slices(spark):
    """Near copies of a few texts, with frequent tokens, many verdicts near the limit, and blocks
    far smaller than the family."""
    rng = random.Random(11)
    rows = []
    for base in range(3):
        words = sentence(100 + base, 60).split()
        for copy in range(60):
            own = list(words)
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(60)] = f"new{rng.randrange(10_000)}"
            rows.append((base * 1000 + copy, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (400, 2_000_000):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_classes(df, block_shingles=block).collect()}
        assert got == classes(rows)


def test_containment_edges(spark, awkward, nothing):
    items = spark.createDataFrame([(1, sentence(1, 30)), (2, None), (3, ""), (4, "one TWO"), (5, sentence(3, 90)), (None, sentence(9, 20))],
                                  "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(awkward, items).collect()}
    assert got >= {(1, 1), (3, 1), (7, 4), (8, 4), (14, 5), (None, 1)}
    assert not any(i in (2, 3, None) for _, i in got) and not any(d in (4, 5, 6) for d, _ in got)
    many = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(awkward, items, block_rows=10).collect()}
    assert many == got
    assert decontaminate.contained_items(nothing, items).count() == 0
    assert decontaminate.contained_items(awkward, nothing, item_id="doc_id").count() == 0
    assert decontaminate.without_items(awkward, items).columns == awkward.columns


def test_repeat_edges(awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    for hot in (50_000, 1):      # 1 sends every anchor with several strings to the counted path
        got = suffix_dedup.remove_repeats(awkward, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == repeats(rows)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_windows_over_two_hot_anchors_occur_once(spark):
    """A passage shorter than a window with two anchors, in otherwise different documents, and
    one anchor at many places of a run."""
    passage = sentence(5240, 60)[:165]
    rows = [(d, sentence(9000 + 2 * d, 60) + passage + sentence(9001 + 2 * d, 60)) for d in range(12)]
    rows += [(20 + d, sentence(7000 + d, 40) + "-" * (150 + d) + sentence(7100 + d, 40)) for d in range(6)]
    want = repeats(rows)
    assert all(removed == 0 for _, _, removed, _, _ in want)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (50_000, 1):
        got = suffix_dedup.remove_repeats(docs, hot=hot).drop("kept").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    text = sentence(7, 3000)
    rows = [(1, text), (2, text[5000:5700] + sentence(8, 50)), (3, "ab" * 2000)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == repeats(rows)


@pytest.mark.parametrize("seed", range(4))
def test_columns_against_brute_force(seed):
    rng = random.Random(seed)
    group, strings, lacking = [], [], []
    for g in range(6):
        base = bytes(rng.randrange(97, 101) for _ in range(336))
        for _ in range(rng.randrange(1, 9)):
            own = bytearray(base)
            for _ in range(rng.randrange(0, 3)):
                own[rng.randrange(336)] = rng.randrange(256)
            cut, end = (rng.randrange(0, 60) if rng.random() < 0.3 else 0), (rng.randrange(0, 60) if rng.random() < 0.3 else 0)
            group.append(g)
            lacking.append(cut)
            strings.append(bytes(own[cut:336 - end]))
    got = suffix_dedup.repeated_columns(np.array(group), strings, np.array(lacking), 200)
    seen = collections.Counter()
    for g, s, n in zip(group, strings, lacking):
        seen.update((g, c, s[c - n:c - n + 200]) for c in range(n, min(137, n + len(s) - 199)))
    for j, (g, s, n) in enumerate(zip(group, strings, lacking)):
        assert [bool(x) for x in got[:, j]] == [n <= c and c - n + 200 <= len(s) and seen[(g, c, s[c - n:c - n + 200])] > 1 for c in range(137)]


def test_pages(spark):
    page = ("<html><head><title>T</title></head><body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies. Accept.</div>"
            "<div id=content><h1>Big title here</h1><p>First para &amp; more text. With&nbsp;sentences.<p>Second, with <a href=x>link</a>. Fine."
            "<div class='ad'>Buy now.</div><form><label>Name</label></form></div><aside><p>Related stuff, long enough to look like content.</p>"
            "</aside><h2>Comments</h2><div><p>Great article! I loved it very much and will tell all of my friends.</p></div>"
            "<footer>c 2020</footer><script>var x = '<p>no</p>';</script><!-- <p>hidden words here.</p> --></body></html>")
    rows = [(1, None, page), (2, "u", None), (3, "u", ""), (4, "u", "<p>broken <b text > here & there. <"), (5, "u", "<" * 3000), (6, "u", "plain words only.")]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows + rows[:1], "page_id long, url string, html string")).collect()}
    assert got[1] == "Big title here\n\nFirst para & more text. With sentences.\n\nSecond, with link. Fine."
    assert got[2] == got[3] == ""
    assert len(got) == 6
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_names_that_articles_have_too():
    long_ = "This paragraph tells a story in plain words, and it goes on for a while, so that nobody takes it for a menu. " * 2
    body = f"<h1>A title</h1><p>{long_}</p><p>{long_}</p>"
    want = "\n\n".join(["A title", long_.strip(), long_.strip()])
    menu = "<nav><a href=x>Home</a></nav><div class=sidebar><p>Read also this one. It is short.</p></div><footer>c 2020</footer>"
    ads = "<div class='ad'>Buy now.</div><form><label>Name</label></form>"
    plain = html_extract.extract(f"<html><body><div>{body}{menu}</div></body></html>")      # as without the name
    assert plain.count(long_.strip()) == 2
    for page in (f"<div class='page has-sidebar'>{body}{menu}</div>", f"<form action=y>{body}{menu}</form>"):
        assert html_extract.extract(f"<html><body>{page}</body></html>") == plain
    for page in (f"<article class='post tags-x'>{body}</article>{menu}", f"<div id=content>{body}{ads}</div>{menu}",
                 f"<main><div class=social>{body}</div></main>{menu}"):
        assert html_extract.extract(f"<html><body>{page}</body></html>") == want
    post = f"<article class='post tags-x'>{body}</article>"      # none holds most of the page
    assert html_extract.extract(post * 3) == "\n\n".join([want] * 3)
    readers = f"<div class='comments'><article class='comment'><p>{long_}</p></article></div><div class='comment-list'><p>{long_}</p></div>"
    assert html_extract.extract(f"<article>{body}{body}{ads}{readers}</article><div class=sidebar><p>{long_}</p></div>{menu}") == "\n\n".join([want] * 2)


def test_minimum_cut_is_minimal():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 8)
        gain, loss = [rng.randrange(20) for _ in range(n)], [rng.randrange(20) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randrange(9)) for _ in range(rng.randrange(10))]
        edges = [e for e in edges if e[0] != e[1]]

        def cost(side):
            return sum(g for g, s in zip(gain, side) if not s) + sum(x for x, s in zip(loss, side) if s) + sum(c for a, b, c in edges if side[a] != side[b])
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(html_extract.minimum_cut(gain, loss, edges)) == best


def test_segments_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randrange(1, 40)
        hits = [(i, rng.choice([0.6, 1.5, 2.5])) for i in range(n) if rng.random() < 0.4]
        values = [dict(hits).get(i, -0.5) for i in range(n)]

        def maximal(lo, hi):      # the definition: take the best span, then both sides of it
            spans = [(sum(values[a:b]), -(b - a), -a, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)]
            if not spans or max(spans)[0] <= 0:
                return []
            _, _, _, a, b = max(spans)
            return maximal(lo, a) + [(a, b - 1)] + maximal(b, hi)
        got = toxicity.segments(hits, 0.5)
        assert sum(s for _, _, s in got) == pytest.approx(sum(sum(values[a:b + 1]) for a, b in maximal(0, n)))


def test_toxicity_edges(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(awkward.select("doc_id", "text"), labels)
    rows = toxicity.score_toxicity(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows)
    empty = toxicity.fit_toxicity(nothing.select("doc_id", "text"), labels)
    assert toxicity.score_toxicity(nothing, empty).count() == 0
    assert toxicity.without_toxic(awkward, empty).count() == awkward.count()


def test_language_edges(spark, awkward, nothing):
    docs = awkward.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "aa").otherwise("bb"))
    model = language_id.fit_languages(docs.where("text is not null").select("doc_id", "text", "lang"))
    rows = {r.doc_id: r for r in language_id.predict_languages(awkward, model).collect() if r.doc_id is not None}
    assert {rows[i].lang_pred for i in (4, 5, 6, 16)} == {"und"} and rows[4].score == 0
    assert rows[1].lang_pred in ("aa", "bb") and 0 < rows[1].score <= 1
    blank = language_id.fit_languages(nothing.select("doc_id", "text", F.lit("x").alias("lang")))
    assert {r.lang_pred for r in language_id.predict_languages(awkward, blank).collect()} == {"und"}
    assert language_id.predict_languages(nothing, model).count() == 0


@pytest.mark.parametrize("hot", [1, 50_000])
def test_rows_that_share_an_id_keep_their_own_bytes(spark, hot):
    passage = sentence(31, 60)
    rows = [(1, sentence(32, 40) + passage), (1, sentence(33, 120)), (2, passage + sentence(34, 30)), (2, sentence(35, 90)), (None, passage),
            (None, sentence(36, 80)), (2, sentence(35, 90)), (3, sentence(37, 70)), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.remove_repeats(docs, hot=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == repeats(rows)
    assert {r.n_removed for r in got if r.doc_id == 3} == {0}


@pytest.mark.parametrize("unit", ['<a title="', "<a ", "<ab", '<a ">" ', "<select>", "<select </select ", "<div></p>", "<a \"'> <b '\"> ", "<p>x</div>", "< "])
def test_time_grows_with_broken_markup_only_linearly(unit):
    import time
    def seconds(size):
        start = time.process_time()
        html_extract.extract(unit * (size // len(unit)))
        return time.process_time() - start
    seconds(1000)
    small, large = seconds(60_000), seconds(480_000)
    assert large < 8 * 3 * small + 0.5


def test_tags_end_where_a_plain_scan_says():
    rng = random.Random(6)
    for _ in range(300):
        page = "".join(rng.choice("a>\"'") for _ in range(rng.randrange(30)))
        places, ends = html_extract.tag_ends(page)
        for k, place in enumerate(places):
            at, quote = place, ""
            while at < len(page) and (quote or page[at] != ">"):
                quote = "" if page[at] == quote else page[at] if not quote and page[at] in "\"'" else quote
                at += 1
            assert ends[k] == (at if at < len(page) else -1)


def test_broken_tags_keep_the_text_round_them():
    assert html_extract.blocks_of('<p>one <b title="x>two</p><p>three')[0].text == "one two"
    assert [b.text for b in html_extract.blocks_of("<p>1 < 2 <a")] == ["1 < 2 <a"]
    assert [b.text for b in html_extract.blocks_of("<div>a</p>b</div></div>c")] == ["a", "b", "c"]
