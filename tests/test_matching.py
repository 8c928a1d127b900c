"""Links between chapters against the reference's rule over all pairs, on small made tables."""

import itertools

import pytest

from textloom.functions import text as T
from textloom.plans import matching

LONG = [" ".join(f"{w}{k}" for k in range(30)) for w in ("hut", "turm", "wald")]
CHAPTERS = [
    (1, "Der Hut", None, "a.md", 0),
    (2, "Ein Turm", " \n", "a.md", 1),
    (3, "Der Hut", "", "b.md", 0),
    (4, "Wald", "und der", "c.md", 0),
    (5, "Der Hut", LONG[0], "a.md", 2),
    (6, "Der Hut", LONG[1], "a.md", 3),
    (7, "Der Hut", LONG[2], "b.md", 1),
    (8, "Der Hut", LONG[0] + " mehr", "c.md", 1),
    (9, "Der rote Hut", LONG[1] + " noch", "a.md", 4),
    (10, "Der rote Hut", LONG[2] + " eins", "c.md", 2),
    (11, "", "nichts davon steht anderswo geschrieben", "a.md", 5),
    (12, None, "ganz andere worte stehen hier drin", "a.md", 6),
    (13, "...", "wieder etwas ganz neues kommt dran", "b.md", 2),
    (14, "Ein Turm", None, "a.md", 7),
]
SCHEMA = "chapter_id long, title string, content string, source_file string, chapter_index int"


def jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("matching"))
    spark.createDataFrame(CHAPTERS, SCHEMA).write.parquet(f"{d}/chapters.parquet")
    return d


@pytest.fixture(scope="module")
def sims(spark, folder):
    """Both similarities of all pairs of chapters of different sources."""
    c = spark.read.parquet(f"{folder}/chapters.parquet").select("chapter_id", "source_file", T.title_words(T.F.col("title")).alias("t"), T.shingles(T.F.col("content"), stopwords=T.STOPWORDS).alias("c")).collect()
    pairs = itertools.combinations(sorted(c), 2)
    return {(x[0], y[0]): (jaccard(set(x.t), set(y.t)), jaccard(set(x.c), set(y.c))) for x, y in pairs if x.source_file != y.source_file}


def between_chapters(spark, folder, pairs, *kinds):
    """The links between chapters that pairs of classes and class_members stand for."""
    source = {r[0]: r[3] for r in CHAPTERS}
    members = {kind: {} for kind in kinds}
    for r in matching.class_members(spark, folder).collect():
        for kind in kinds:
            members[kind].setdefault(r[f"{kind}_id"], []).append(r.chapter_id)
    both = [(r["kind"] if "kind" in pairs.columns else kinds[0], r.a, r.b) for r in pairs.collect()]
    assert len(both) == len(set(both))
    both += [(kind, k, k) for kind in kinds for k in members[kind]]
    return {(min(x, y), max(x, y)) for kind, a, b in both for x in members[kind][a] for y in members[kind][b] if source[x] != source[y]}


def test_strict_pairs_with_empty_contents(spark, folder, sims):
    want = {p for p, (t, c) in sims.items() if c >= 0.4 or (t >= 0.8 and c >= 0.15) or (t >= 0.99 and c >= 0.1)}
    assert {(1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (3, 14)} <= want
    assert between_chapters(spark, folder, matching.strict_pairs(spark, folder), "class") == want


def test_components_with_empty_contents(spark, folder):
    got = {r.chapter_id: r.component for r in matching.components(spark, folder).collect()}
    assert {k: got.get(k) for k in (1, 2, 3, 4, 14)} == {1: 1, 2: 1, 3: 1, 4: 1, 14: 1}
    winners = {r.component: r.n_members for r in matching.merge_winners(spark, folder).collect()}
    assert winners[1] == 5
    order = [r.chapter_id for r in matching.merge_order(spark, folder).collect()]
    assert len(order) == len(set(order)) and len(set(order) & {1, 2, 3, 4, 14}) == 1


def test_empty_contents_of_one_source(spark, tmp_path):
    spark.createDataFrame([r for r in CHAPTERS if r[3] == "a.md"], SCHEMA).write.parquet(f"{tmp_path}/chapters.parquet")
    assert matching.components(spark, str(tmp_path)).count() == 0


def test_cross_source_pairs_are_whole(spark, folder, sims):
    want = {p for p, (t, c) in sims.items() if t >= 0.5 or c >= 0.3}
    assert {(1, 3), (5, 7), (6, 7), (6, 8), (8, 9), (5, 10), (11, 13), (12, 13), (2, 4)} <= want
    pairs = matching.cross_source_pairs(spark, folder)
    assert between_chapters(spark, folder, pairs, "title", "content") == want
    assert all(sims[r.a, r.b][r.kind == "content"] == pytest.approx(r.sim) for r in pairs.collect() if (r.a, r.b) in sims)
