"""Families that what many documents share would make large, and what their search leaves on disk."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from tabulyze.llm import jaccard_join, stores
from test_llm_edges import sentence
from test_llm_oracles import classes


def test_common_lines_do_not_make_slices(spark, monkeypatch):
    """Unlike documents with one licence go to no comparison, copies give no tokens."""
    rng = random.Random(17)
    licence, rows = sentence(200, 40), []
    for base in range(120):
        own = sentence(300 + base, 60).split()
        rows.append((base, licence + " " + " ".join(own)))
        if base % 10 == 0:
            own[rng.randrange(60)] = "changed"
            rows += [(1000 + base, licence + " " + " ".join(own)), (2000 + base, licence + " " + " ".join(own))]
    rows += [(3000 + i, licence + f" number {i}") for i in range(40)]
    compared, counted = [], []
    links, tokens = jaccard_join.verified_links, jaccard_join.matched_tokens
    monkeypatch.setattr(jaccard_join, "verified_links", lambda sets, *a: compared.append(sets.count()) or links(sets, *a))
    monkeypatch.setattr(jaccard_join, "matched_tokens", lambda some, *a: counted.append(some.select("k").distinct().count()) or tokens(some, *a))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_classes(df, block_shingles=4000).collect()}
    assert got == classes(rows)
    # by the licence alone, 172 different sets would be one family of four parts, each compared with each
    assert counted[0] == len(rows) - 12
    assert 64 <= compared[0] <= 200


def test_levels_of_common_tokens(spark):
    rng = random.Random(3)
    sets = {rng.getrandbits(63): n for n in (1, 16, 17, 31, 32, 33, 64, 600, 1_000)}
    tokens = spark.createDataFrame([(t,) for t, n in sets.items() for _ in range(n)], "token long")
    levels = jaccard_join.token_levels(tokens, 10)
    got = jaccard_join.level_of(np.array(list(sets), np.uint64), levels)
    assert len({t % 1024 for t in sets}) == len(sets) and list(got) == [0, 0, 1, 1, 2, 2, 3, 6, 6]


def test_shuffles_go_with_the_write(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for i in range(found.size()) if (n := found.apply(i).getName()).startswith("shuffle_")}

    before, held = files(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    with stores.shuffles_dropped(spark):
        grouped = spark.range(1000).groupBy((F.col("id") % 10).alias("x")).count()
        assert stores.stored(grouped, "grouped").count() == 10
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == held
    for _ in range(50):
        if files() <= before:
            return
        time.sleep(0.2)
    raise AssertionError(files() - before)
