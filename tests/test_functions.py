"""Column functions on literal fixtures, with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import graph
from textloom.operators.numbering import number_rows
from textloom.operators.vectors import top_k


def one(spark, f, *values):
    """f of the values' columns, in one row."""
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values)))
    return df.select(f(*map(F.col, names)).alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [([], [], 1.0), ([], ["a"], 0.0), (["a", "b"], ["a", "b"], 1.0), (["a", "b", "c"], ["b", "c", "d"], 0.5)])
def test_jaccard_edges(spark, a, b, want):
    assert one(spark, T.jaccard, a, b) == want
    assert one(spark, T.jaccard, b, a) == want


@pytest.mark.parametrize(
    ("text", "whole", "words"),
    [
        (None, 0, 0), ("", 0, 0), ("der die das", 0, 0), ("ab cd", 0, 0), ("Lampe", 1, 1), ("Lampe Regen Turm Salz", 1, 4),
        ("Lampe Regen Turm Salz Hut", 1, 1), ("Lampe Regen Turm Salz Hut Bach", 2, 2), ("eins " * 9, 1, 1),
    ],
)
def test_short_texts(spark, text, whole, words):
    assert one(spark, lambda c: F.size(T.shingles(c)), text) == whole
    assert one(spark, lambda c: F.size(T.shingles(c, short="words")), text) == words


@pytest.mark.parametrize(("sim", "want"), [(0.19999, "NEW"), (0.20, "NEAR"), (0.49999, "NEAR"), (0.50, "EXACT"), (0.0, "NEW")])
def test_status_thresholds(spark, sim, want):
    assert spark.range(1).select(T.similarity_class(F.lit(sim)).alias("x")).first()["x"] == want


@pytest.mark.parametrize(
    ("title", "normal", "display", "name"),
    [
        ("12. Die Lampe | brw", "die lampe brw", "Die Lampe", "Die_Lampe"), ("12. Die Lampe|brw", "die lampe", "Die Lampe", "Die_Lampe"),
        ("12\\. Über Äpfel", "12 über äpfel", "12\\. Über Äpfel", "12_Über_Äpfel"), ("", "", "", "untitled"), ("?!", "", "?!", "untitled"), ("  A   b ", "a b", "A   b", "A_b"),
    ],
)
def test_titles(spark, title, normal, display, name):
    assert one(spark, T.normal_title, title) == normal
    assert one(spark, T.display_title, title) == display
    assert one(spark, T.file_name, title) == name


def test_one_line_title_keeps_an_escaped_number(spark):
    assert one(spark, lambda c: T.display_title(c, one_line=True), "15\\. Der\n Hut") == "15. Der Hut"


@pytest.mark.parametrize(
    ("text", "title", "body"),
    [
        ("no front", None, "no front"), ("---\ntitle: x", None, "---\ntitle: x"), ('---\ntitle: "A b"\nk: v\n---\n\nBody', "A b", "Body"),
        ("---\ntitle: it's here\n---\nB", None, "B"), ("---\nk: v\n---\nB", None, "B"),
    ],
)
def test_front_matter(spark, text, title, body):
    x = one(spark, T.front_matter, text)
    assert (x["title"], x["body"]) == (title, body)


def test_heading_stands_in(spark):
    assert one(spark, T.first_heading, "x\n# Der Titel \ny") == "Der Titel"
    assert one(spark, T.first_heading, "## Kein Titel") is None


def test_signals(spark):
    text = "a b\tc\n\n    d  \n        e – — “q” ‘r’ … &nbsp; &#39; &copy;"
    s = one(spark, T.signals, text)
    assert (s["n_lines"], s["empty_lines"], s["empty_ratio"]) == (4, 1, 0.25)
    assert (s["ws_4plus"], s["ws_8plus"], s["ws_16plus"], s["tabs"], s["nbsp_unicode"]) == (2, 1, 0, 1, 1)
    assert (s["em_dashes"], s["en_dashes"], s["smart_quotes_d"], s["smart_quotes_s"], s["ellipsis"], s["html_entities"]) == (1, 1, 2, 2, 1, 2)
    assert (s["n_chars"], s["unique_chars"]) == (len(text), len(set(text)))


@pytest.mark.parametrize(("ratio", "want"), [(0.0, 2.0), (0.05, 5.0), (0.10, 10.0), (0.40, 10.0), (0.41, 5.0), (0.55, 5.0), (0.56, 2.0)])
def test_structure_bands(spark, ratio, want):
    s = F.struct(*(F.lit(0).alias(n) for n in "n_words ws_4plus ws_8plus ws_16plus tabs em_dashes en_dashes smart_quotes_d smart_quotes_s nbsp_unicode ellipsis html_entities".split()), F.lit(ratio).alias("empty_ratio"))
    assert spark.range(1).select(T.score_parts(s).getField("structure_fidelity").alias("x")).first()["x"] == want


@pytest.mark.parametrize(("text", "want"), [("Das ist wunderbar", "euphorisch"), ("nichts", "neutral"), (None, "neutral"), ("Mist im Nebel", "gereizt"), ("Schatten und Echo, Nebel", "kryptisch")])
def test_moods(spark, text, want):
    assert one(spark, T.mood, text) == want


def test_search(spark):
    assert one(spark, lambda c: T.occurrences(c, ["aa"]), "aaaaa") == 2
    assert one(spark, lambda c: T.occurrences(c, ["ab", "ab"]), "abab") == 4
    assert one(spark, lambda c: T.snippet(c, ["y"]), "x" * 400 + "y" + "z" * 400) == "..." + "x" * 150 + "y" + "z" * 149 + "..."
    assert one(spark, T.search_query, "Kurz. Wo ist denn der Hut? Ja.") == "Wo ist denn der Hut?"
    assert one(spark, T.search_query, "wort " * 60) == ("wort " * 30).strip()
    assert one(spark, T.guard, "ab " * 200) == ("ab " * 100).strip()


def test_pages(spark):
    page = "<html><head><title>T</title><style>p {margin-left: 1px}</style></head><body><h1>Ein <b>Kopf</b></h1><p>Text &amp; mehr</p><script>x</script></body></html>"
    assert one(spark, T.page_title, page) == "Ein Kopf"
    assert one(spark, T.page_text, page) == "Ein Kopf\nText & mehr"
    assert one(spark, T.page_title, "<p>ab</p><p>Kurzer Satz</p>") == "Kurzer Satz"
    assert one(spark, T.page_title, "<title> Nur das </title>") == "Nur das"
    assert one(spark, T.upload_path, "https://a.example/wp/uploads/2020/01/b%20c+d.png?x=1") == "2020/01/b c+d.png"


def test_components(spark):
    rows = [(1, 2), (2, 3), (2, 3), (3, 2), (9, 9), (None, 4), (7, 8), (8, 5)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200 + i) for i in range(1, 30)]
    got = {r["vertex"]: r["component"] for r in graph.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert {v: got[v] for v in (1, 2, 3, 5, 7, 8)} == {1: 1, 2: 1, 3: 1, 5: 5, 7: 5, 8: 5}
    assert all(got[100 + i] == 100 for i in range(41)) and all(got[200 + i] == 200 for i in range(30)) and 9 not in got and 4 not in got
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_numbers(spark):
    df = spark.createDataFrame([(i * 7 % 50, "x") for i in range(50)], "k long, s string")
    got = sorted((r["number"], r["k"]) for r in number_rows(df, F.desc("k")).collect())
    assert got == [(i + 1, 49 - i) for i in range(50)]
    assert number_rows(df.limit(0), F.desc("k")).count() == 0


def test_nearest(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in top_k(v.where("vec_id = 1"), v, 3).collect())
    assert got == [(1, 1, 0.0), (1, 2, 1.0), (1, 3, 0.0)]
    assert top_k(v.limit(0), v, 3).count() == 0


def test_front_matter_fields(spark):
    texts = ["---\ntitle: \"Der 'Hut'\"\ndate: 2020-01-02: x\nleer\ntitle: zwei\n---\nKörper", "ohne", None, "---\nnie zu", "---\n---\nx"]
    got = [r[0] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").orderBy("k").select(T.front_matter_fields(F.col("t"))).collect()]
    assert got == [{"date": "2020-01-02: x", "title": "zwei"}, {}, {}, {}, {}]


def test_small_rules(spark):
    row = spark.createDataFrame([("a|b\nc\x07\u200b ", 0, 31)], "t string, a int, b int").select(
        T.cell(F.col("t"), 4).alias("cell"), T.printable(F.col("t")).alias("printable"), T.clamp(F.col("a"), 1, 480).alias("a"), T.pause_seconds(F.col("b")).alias("b"), T.route_tiers(F.lit("Eine ANALYSE")).alias("r"), T.route_two(F.lit("nichts")).alias("s"),
        T.log_parts(F.lit("Kopf\n### 2020-01-02 10:00\nx\n### kein Datum\n### 2021-01-01\n")).alias("l"), T.page_title(F.lit("<i>x</i>"), F.lit(3)).alias("p"),
    ).first()
    assert (row["cell"], row["printable"], row["a"], row["b"], row["r"], row["s"], row["p"]) == ("a\\|b ", "a|b\nc", 1, 300, "good", "standard", "(Datei 3)")
    assert row["l"] == ["Kopf", "### 2020-01-02 10:00\nx\n### kein Datum", "### 2021-01-01\n"]


def test_numbers_by_value(spark):
    from textloom.operators.numbering import number_rows

    rows = [(k, "x" if k % 3 else None if k % 2 else "y") for k in range(200)]
    got = number_rows(spark.createDataFrame(rows, "k long, g string"), F.desc("k"), by="g").collect()
    for g in ("x", "y", None):
        assert [r["number"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: -r["k"])] == list(range(1, sum(r[1] == g for r in rows) + 1))
