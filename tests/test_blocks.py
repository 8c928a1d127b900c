"""Similarity joins over blocks of sets against all pairs, and what they bring together."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from textloom.operators import blocks as B
from textloom.operators import similarity as M
from textloom.plans import matching
from textloom.session import Workspace


def sets_of(spark, sets):
    rows = [(k, [str(x) for x in s]) for k, s in enumerate(sets)]
    return spark.createDataFrame(rows, "id long, members array<string>").select("id", M.hashed(F.col("members")).alias("members"))


def alike(sets, threshold):
    return {(x, y) for (x, a), (y, b) in itertools.combinations(enumerate(sets), 2) if a and b and len(a & b) >= threshold * len(a | b) - 1e-9}


@pytest.fixture(scope="module")
def made():
    """Sets of 0 to 40 of common and rare elements, many with one or a few changed."""
    r = random.Random(7)
    sets = [set(), {1}, {1, 2}]
    for _ in range(250):
        s = {int(r.paretovariate(0.4)) % 400 for _ in range(r.choice((2, 4, 6, 8, 12, 20, 24, 40)))}
        sets.append(s)
        for _ in range(r.choice((0, 1, 2))):
            sets.append((s - {x for x in s if r.random() < 0.2}) | {r.randrange(1000) for _ in range(len(s) // 5)})
    return list(map(set, {frozenset(s) for s in sets}))


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_no_pair_is_missed(spark, made, threshold):
    want = alike(made, threshold)
    shared = Workspace(spark, "test").put(B.shared_sets(sets_of(spark, made), threshold), "shared")
    one = {(r.a, r.b) for r in M.met(B.prefixes(shared, threshold), None, threshold, "element").collect()}
    assert want <= one
    several = {(r.a, r.b) for r in B.met_together(shared, threshold).collect()}
    need = {(x, y): -(-threshold / (1 + threshold) * (len(made[x]) + len(made[y])) // 1) for x, y in want}
    assert {p for p in want if need[p] <= B.MOST - 1} <= several and want - several <= {p for p in want if need[p] >= B.MOST - 1}
    assert {(r.a, r.b) for r in B.met_together(shared, threshold).union(M.met(B.prefixes(shared.where(F.col("n") > B.MOST), threshold), None, threshold, "element")).collect()} >= want


def test_common_words_bring_no_pairs_together(spark, tmp_path):
    """Titles that share an article and one word of two are far apart, so that not even those of the same word meet."""
    titles = [f"der {w} {v} und die nummer{i}x{j}" for i, w in enumerate("rot blau gelb alt neu".split()) for j, v in enumerate("hut turm wald berg".split() * 25)]
    sets = [set(t.split()) for t in titles]
    shared = Workspace(spark, "test").put(B.shared_sets(sets_of(spark, sets), 0.8), "shared")
    assert B.met_together(shared, 0.8).distinct().count() == len(alike(sets, 0.8)) == 0
    spark.createDataFrame([(k, t, f"{k}.md") for k, t in enumerate(titles)], "chapter_id long, title string, source_file string").withColumn("content", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/chapters.parquet")
    pairs = matching.cross_source_pairs(spark, str(tmp_path))
    assert {(r.a, r.b) for r in pairs.collect()} == alike(sets, 0.5)
    assert pairs.count() == len(alike(sets, 0.5))


def test_equal_contents_and_repeated_rows_count_once(spark, tmp_path):
    long = " ".join(f"wort{k}" for k in range(40))
    rows = [(k, f"titel{k}", long if k % 2 else long + " noch ein ende", f"{k % 3}.md") for k in range(12)]
    df = spark.createDataFrame(rows + rows[:5], "chapter_id long, title string, content string, source_file string")
    df.write.parquet(f"{tmp_path}/chapters.parquet")
    got = [(r.kind, r.a, r.b) for r in matching.cross_source_pairs(spark, str(tmp_path)).collect()]
    assert got == [("content", 0, 1)]
    other = spark.createDataFrame([(0, "a", "ein", None), (0, "b", "zwei", None), (None, "c", "drei", None), (None, "d", "vier", None), (1, "e", "", None)], df.schema)
    assert sorted(r.chapter_id for r in M.chapter_sets(other).collect() if r.chapter_id is not None) == [0, 1]
    assert M.chapter_sets(other).count() == 3


def test_packed_integers_come_back():
    import numpy as np

    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (B.unpack_sorted(B.pack_sorted(x)) == x).all() and len(B.unpack_sorted(B.pack_sorted(x[:0]))) == 0
    assert (B.unpack(B.pack(x.astype(np.uint32)), np.uint32) == x.astype(np.uint32)).all()
