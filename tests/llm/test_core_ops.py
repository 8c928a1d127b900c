"""The operators against brute force and on edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import random
import re
import unicodedata

import numpy as np
import pytest
from compare import connect, spark_rows, sql_rows
from pyspark.sql import functions as F

from textloom.llm import components, forms, history, leaks, markup, mixture, oracle, pieces, quality, queries, subjects, survivors
from textloom.llm.words import distinct_sets, hash_words, runs, window_minima

WORDS = "hut regen laterne garten salz turm bach wolke zettel stempel knopf fenster".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) for _ in range(n))


def grams(text, n):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_against_sql(spark, data, name):
    assert spark_rows(queries.queries()[name](spark, data)) == sql_rows(connect(data), oracle.oracle_sql()[name])


# words


def test_word_runs():
    import pyarrow as pa

    texts = ["Der Hut, der  HUT!", None, "", "eins", "a b c d e f"]
    hashes, starts = hash_words(pa.array(texts))
    assert list(np.diff(starts)) == [4, 0, 0, 1, 6] and hashes[0] == hashes[2] and hashes[1] == hashes[3]
    r, at = runs(hashes, starts, 2)
    assert list(np.diff(at)) == [3, 0, 0, 0, 5] and r[0] == r[2]
    d, on = distinct_sets(r, at)
    assert list(np.diff(on)) == [2, 0, 0, 0, 5]
    m, by = window_minima(r, at, 3)
    assert list(np.diff(by)) == [1, 0, 0, 0, 3] and m[0] == min(r[:3]) and m[1] == min(r[3:6])
    assert len(hash_words(pa.array([None], pa.string()))[0]) == 0 and len(runs(*hash_words(pa.array([], pa.string())))[0]) == 0


# p1


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("Der Hut liegt in dem Garten, und der Regen fällt.", "prose"), ("– Warum ist der Hut so nass?", "prose"), ("- der nasse Hut schon wieder", "list"),
        ("12. der alte Turm", "list"), ("c) die Laterne, Salz", "list"), ("der Turm .......... 12", "list"), ("Hut: der Regen,", "list"), ("https://hut.example/3", "list"),
        ("| Hut | 3 | 4,5 |", "table"), ("|---|---|", "table"), ("Hut;3;4,5;Turm", "table"), ("Hut\t3\t4", "table"), ("Hut        3,10      4,2", "table"),
        ("0a ff 3c 9e 11 20", "junk"), (".hut {margin: 3px; color: #fff}", "junk"), ("r| e1 . u! n  d. ı", "junk"), ("Ã¤Ã¶Ã¼ xÃ¶ Ã¼r", "junk"), ("H�t ¤der Re¤en #f#l�", "junk"),
        ("Start | Hut << zurück | weiter >> Turm", "junk"), ("ab3452_f1 cd99::a2 ef10-22", "junk"), ("qwöx jjzu plömq wwrt zuqq", "junk"), ("Gk3Jd92kLmnQ83kdLwP0vXs7Zt4Rb6Yc1Hn", "junk"),
    ],
)
def test_line_classes(line, want):
    assert quality.line_class(line) == want


def test_line_over_and_over():
    assert quality.shares("Der Hut ist nass und der Turm ist alt.\n" * 9)["junk"] == 1.0
    assert quality.shares("") == {} and quality.shares(" \n\t") == {}


def test_exact_ranks(spark):
    from textloom.session import Workspace

    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice(["s", "t"]), float(rng.choice([0, 0, 0, 1, 2, rng.randint(0, 90)]))) for _ in range(600)]
    got = quality.exact_ranks(spark.createDataFrame(rows, "part string, statistic string, value double"), Workspace(spark, "t"), 5).collect()
    assert len(got) == len(set(rows))
    for r in got:
        same = [v for p, s, v in rows if (p, s) == (r["part"], r["statistic"])]
        assert (r["below"], r["at_most"], r["n"]) == (sum(v < r["value"] for v in same), sum(v <= r["value"] for v in same), len(same))


def test_classes_of_texts(spark):
    rng = random.Random(1)
    sentence = lambda: f"Der {rng.choice(WORDS)} liegt in dem {rng.choice(WORDS)}, und das {rng.choice(WORDS)} ist nicht so alt wie die {rng.choice(WORDS)}."
    rows = [(i, "\n".join(sentence() for _ in range(rng.randint(2, 9)))) for i in range(60)]
    rows += [(100, "\n".join(f"- der {rng.choice(WORDS)} {i}" for i in range(30))), (101, "\n".join(f"{w};3;4,5;x" for w in WORDS)), (102, "0a ff 3c 9e 11 20\n" * 3 + "1b 2c 3d 4e"), (103, None), (104, " \n "), (100, "\n".join("x"))]
    rows = [r for r in rows if r != (100, "x")]
    df = spark.createDataFrame(rows + rows[:5], "source_id long, text string").withColumn("language", F.lit("clash")).withColumn("score", F.lit(1))
    got = {r["source_id"]: r["text_class"] for r in quality.classify(df).collect()}  # one sentence over and over on one line is junk too
    assert quality.shares("Der Hut ist nass. " * 6)["junk"] > 0.9 and quality.shares("Hut\u2028nasser Turm")["list?"] == 1.0
    assert len(got) == 63 and {k: v for k, v in got.items() if v != "prose"} == {100: "list", 101: "table", 102: "junk"}
    assert quality.classify(df.limit(0)).count() == 0


def test_common_cases_are_found(spark):
    """Copies of one list and lists of their own as most texts of a language, whatever the ranks say."""
    rng = random.Random(3)
    sentence = lambda: f"Der {rng.choice(WORDS)} liegt in dem {rng.choice(WORDS)}, und das {rng.choice(WORDS)} ist nicht so alt wie die {rng.choice(WORDS)}."
    entries = lambda: "\n".join(f"- der {rng.choice(WORDS)} und die {rng.choice(WORDS)} {i}" for i in range(20))
    copied = entries()
    rows = [(i, "\n".join(sentence() for _ in range(5))) for i in range(20)] + [(100 + i, copied) for i in range(60)] + [(200 + i, entries()) for i in range(20)]
    got = quality.classify(spark.createDataFrame(rows, "source_id long, text string")).collect()
    assert {r["source_id"]: r["text_class"] for r in got} == {i: "prose" if i < 100 else "list" for i, _ in rows}
    # one row or many of a text: its copies change no score
    once = quality.classify(spark.createDataFrame([r for r in rows if not 100 < r[0] < 200], "source_id long, text string")).collect()
    scores = {r["source_id"]: r["score"] for r in got}
    assert all(abs(scores[r["source_id"]] - r["score"]) < 1e-9 for r in once)


def test_doubtful_lines_need_an_outlier(spark, monkeypatch):
    """Short lines without a sign are a list's only in texts that lie far from the prose of their language."""
    rng = random.Random(5)
    word = lambda: rng.choice(WORDS).title()
    poem = lambda n: "\n".join(f"{word()} und {word()} in der {word()}.\nroter {word()}\nalter {word()}" + ("" if k >= n else f"\nleiser {word()}") for k in range(8))
    wordy = lambda: "\n".join(f"Der {word()} ist nass. Die {word()} ist da.\n{word()}\n{word()}\n{word()}" for _ in range(8))
    long = lambda: "\n".join(f"{word()} und {word()} in der " + " ".join(word() for _ in range(7)) + f".\n{word()}\n{word()}\n{word()}" for _ in range(8))
    rows = [(i, (wordy(), poem(0), long())[i % 3]) for i in range(60)] + [(100, poem(8)), (101, "\n".join(f"{word()}: {word()} {k}" for k in range(30)))]
    df = spark.createDataFrame(rows, "source_id long, text string")

    def found():
        return {r["source_id"]: r["text_class"] for r in quality.classify(df).collect() if r["text_class"] != "prose"}

    assert quality.shares(poem(8)).get("list?", 0) > 0.5 > quality.shares(wordy())["list?"]
    assert found() == {101: "list"}
    monkeypatch.setattr(quality, "OUTLIER_RATE", 1)
    assert found() == {100: "list", 101: "list"}


# p2


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Der <b>Hut</b>", ["html"]), ("nur ein </p> blieb", ["html"]), ("Hut &amp; Turm", ["html"]), ("x <!-- y --> z", ["html"]), ("## Hut\nText", ["markdown"]), ("ein **fetter** Hut", ["markdown"]),
        ("[Hut](https://a.b/c)", ["markdown"]), ("Hut\n====\n\nText", ["markdown"]), ("| a | b |\n| --- | --- |", ["markdown"]), ("```\n<b>x</b> [[y]] \\emph{z} &amp;\n```", ["markdown"]),
        ("ein '''Hut'''", ["wiki"]), ("[[Hut|der Hut]]", ["wiki"]), ("== Hut ==\nText", ["wiki"]), ("{| class=\"x\"\n|-\n| a || b\n|}", ["wiki"]), ("{{Kasten|a=1}}", ["wiki"]),
        ("\\emph{Hut}", ["latex"]), ("\\item Hut", ["latex"]), ("die Formel $x^{2} + y_{1}$ gilt", ["latex"]), ("\\[ a \\leq b \\]", ["latex"]), ("<p>\\section{x}</p>", ["html", "latex"]),
        ("3 < 5 und 7 > 4", []), ("Das kostet 5 $ oder 6 $.", []), ("He paid $40 and got $3 back", []), ("5 * 3 * 2", []), ("C:\\Ablage\\alt", []), ("#ohnezettel, #später", []), ("x = y == z", []),
        ("alt_neu_final", []), ("[sic] see (2) and [4], not * below", []), ("Kreide & Söhne", []), ("1. Akt, 2. Szene", []), ("{siehe oben}", []), ("* * *", []), ("", []), ("&copy und AT&T", []),
    ],
)
def test_markup_kinds(text, kinds):
    assert markup.read(text, clean=False)[0] == kinds


def test_clean_text():
    page = "<h2>Kopf</h2>\n<ul>\n<li>eins</li>\n<li>zwei &amp; drei</li>\n</ul>\n<pre><code>a &lt; b</code></pre>\n<table><tr><td>1</td><td>2</td></tr></table>\nDer Hut ist nass."
    got = markup.read(page)[1]
    assert "## Kopf" in got and "- eins\n- zwei & drei" in got and "```\na < b\n```" in got and "1 | 2" in got and "Der Hut ist nass." in got and "<" not in got.replace("a < b", "")
    got = markup.read("\\section{Kopf}\nEin \\emph{alter} Hut~\\cite{x}, $x^{2}$.\n\\begin{itemize}\n\\item eins\n\\end{itemize}")[1]
    assert got == "# Kopf\nEin alter Hut, $x^{2}$.\n- eins"
    got = markup.read("== Kopf ==\nDer '''alte''' [[Hut|Filzhut]] und [[Turm]].{{x|y}}\n{|\n|-\n| a || b\n|}")[1]
    assert got == "## Kopf\nDer alte Filzhut und Turm.\na | b"
    got = markup.read("Kopf\n====\n\n+ eins\n+ zwei\n\n**Der** [Hut](u) `x`\n\n```\n**a**\n```")[1]
    assert got == "# Kopf\n\n- eins\n- zwei\n\nDer Hut x\n\n```\n**a**\n```"
    assert markup.content_lines([]) == [] and markup.content_lines([90.0, 80.0, 85.0, 1.0, 1.0, 1.0])[:2] == [True, True]


def test_structure_is_kept():
    assert markup.read("<h1>\n Der alte\n Titel \n</h1><p>Text hier.</p>")[1] == "# Der alte Titel\nText hier."
    assert markup.read("{| class=\"x\"\n! Kopf !! Wert\n|-\n| a || b\n|}")[1] == "Kopf | Wert\na | b"
    assert markup.read("[[Hut]]:\n* eins\n** zwei\n*** drei")[1] == "Hut:\n- eins\n  - zwei\n    - drei"
    page = "<nav><a href=x>Start</a> <a href=y>Kontakt</a></nav>\n<p>Ein langer Satz über den <b>Hut</b> ohne Ende und noch mehr Worte dazu</p>"
    assert markup.read(page)[1] == "Ein langer Satz über den Hut ohne Ende und noch mehr Worte dazu"
    assert "Hut" in markup.read("<nav> Hut")[1]


def test_kinds_come_from_regions_first():
    lines = ["Ein langer Absatz über den Garten und den Regen und den Turm am Bach, und noch mehr Worte dazu."] * 8
    text = "\n".join([*lines, "**Hut** `Turm` **Bach**", *lines])
    region = markup.marked_regions(text)
    assert "**Hut**" in region and region.count("Garten") < 8 and markup.read(region, clean=False)[0] == ["markdown"]
    # one sign in a line like all others lies in no region, and is found by the exact check
    lone = "\n".join([*lines, "**Hut** `Turm` **Bach**", *lines, (lines[0] * 3).replace("Turm", "'''Turm'''", 1), *lines])
    assert "'''" not in markup.marked_regions(lone) and markup.read(lone, clean=False)[0] == ["markdown", "wiki"]


def test_regions_by_clusters():
    menu = "".join(f"<a href=x{i}>Seite {i}</a> <a href=y>mehr zu {i}</a>\n" for i in range(6))
    body = "\n".join("Ein langer Absatz über den Garten und den Regen und den Turm am Bach. " * 4 for _ in range(6))
    got = markup.read(f"{menu}{body}\n{menu}")[1]
    assert "Seite" not in got.replace("Seite 5", "").replace("Seite 0", "") and got.count("Garten") == 24
    assert markup.clusters(np.array([5.0, 5.0, 6.0])) is None and 1 < markup.clusters(np.array([1.0, 1.0, 9.0, 9.0])) < 9


def test_markup_rows(spark):
    long = "wort " * 60000
    df = spark.createDataFrame([("a", 1, "x <b>y</b>"), ("a", 2, None), ("a", 3, ""), ("a", 4, long + "**fett**"), ("a", 1, "x <b>y</b>")], "origin string, item_id long, text string").withColumn("markup", F.lit(1))
    got = sorted((r["item_id"], tuple(r["markup"]), r["text"] and r["text"][-6:]) for r in markup.read_markup(df).collect())
    assert got[0] == got[1] == (1, ("html",), "x y") and got[2:4] == [(2, (), None), (3, (), "")] and got[4][1] == ("markdown",)
    assert markup.read_markup(df.limit(0)).count() == 0


# p3


def test_cut_properties():
    rng = random.Random(5)
    for _ in range(400):
        n = rng.choice([0, 1, 50, 3999, 4000, 4001, 4100, 7801, 12000, 30000])
        text = "x" * n if rng.random() < 0.2 else "".join(rng.choice(["a", "b ", "\n", ". ", "\n\n", "é", "\n# K\n"]) for _ in range(n))[:n]
        got = pieces.cut(text)
        assert got[0][0] == 0 and got[-1][1] == len(text) and all(e - s <= 4000 for s, e, _, _ in got)
        for a, b in zip(got, got[1:]):
            assert b[1] > a[1] and a[1] - b[0] == b[2] and 150 <= b[2] <= 250
    with pytest.raises(ValueError):
        pieces.cut("x", 100, 60)


def test_natural_boundaries():
    text = "\n\n".join("Satz eins über den Hut. Satz zwei. " * 20 for _ in range(12))
    got = pieces.cut(text)
    assert len(got) == 3 and all(text[:e].endswith("\n\n") for _, e, _, _ in got[:-1])


@pytest.mark.parametrize("size", [7400, 7519, 7525, 7560, 7599, 7700, 11285, 11330, 11399, 15100, 15199])
def test_boundaries_at_any_size(size):
    text = "\n\n".join("Ein Satz über den Hut steht hier. " * 7 for _ in range(80))[:size]
    got = pieces.cut(text)
    assert all(text[:e].endswith("\n\n") for _, e, _, _ in got[:-1]) and all(e - s <= 4000 for s, e, _, _ in got)


def test_only_boundary_off_the_target():
    assert [(e, w > 0) for _, e, _, w in pieces.cut("x" * 3790 + " " + "x" * 3750)] == [(3791, True), (7541, True)]


def test_pieces_by_table(spark):
    df = spark.createDataFrame([("c", 1, 0, "x" * 4000), ("c", 2, None, "y " * 3000), ("c", 3, 1, None), ("c", 4, 2, "")], "origin string, item_id long, chapter_index int, content string")
    got = pieces.split_long(df.withColumn("text", F.lit("clash"))).collect()
    by = {}
    for r in got:
        by.setdefault(r["item_id"], []).append(r)
    assert {k: len(v) for k, v in by.items()} == {1: 1, 2: 2, 4: 1} and by[2][0]["chapter_index"] is None
    whole = sorted(by[2], key=lambda r: r["piece_no"])
    assert "".join(r["text"][r["overlap"] :] for r in whole) == "y " * 3000
    assert pieces.split_long(df.limit(0)).count() == 0


# p4


def test_history_against_brute_force(spark):
    rng = random.Random(9)
    shared = prose(rng, 40)
    bodies, rows = [], []
    for i in range(160):
        old = rng.choice(bodies) if bodies and rng.random() < 0.5 else None
        if old:
            w = old.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "neu"
            body = " ".join(w) if rng.random() < 0.7 else old.upper().replace(" ", " <i>\n</i>", 1)
        else:
            body = (shared + " " if rng.random() < 0.3 else "") + prose(rng, rng.randint(30, 90))
        bodies.append(re.sub(r"<[^>]*>", " ", body).lower())
        rows.append((i, body))
    rows += [(200, None), (201, " \n"), (202, "zu kurz"), (203, rows[150][1])]
    frame = lambda rs: spark.createDataFrame(rs, "age long, body string").withColumn("match", F.lit(0))
    sets = {i: grams(re.sub(history.TAGS, " ", b or ""), 5) for i, b in rows}
    want, sims = {}, {}
    for i, s in sets.items():
        for j in sorted(sets):
            if j < i and s and sets[j]:
                sim = len(s & sets[j]) / len(s | sets[j])
                sims[i, j] = sim
                if sim >= 0.5 and i not in want:
                    want[i] = j
    h = history.History(spark)
    got = {}
    for batch in (rows[:60], rows[60:61] * 2 + rows[61:110], rows[110:]):
        h = history.History(spark, h.root)  # as another job opens it
        got |= {r["age"]: r["match"] for r in h.add(frame(batch)).collect()}
        if batch is not rows[:60]:
            h.compact()
    assert got == want and len(want) > 50
    assert len(h.state["runs"]) == 1 and h.add(frame(rows[:0])).count() == 0
    # a known record again finds what its first copy found
    again = h.add(frame([(300 + i, b) for i, b in rows if i < 160])).collect()
    assert {r["age"] - 300: r["match"] for r in again} == {i: want.get(i, min(j for j in sets if sets[j] == sets[i])) for i in range(160)}


def test_only_touched_ranges_are_read(spark, monkeypatch):
    """A small batch reads the few ranges its keys fall into, and merged runs are gone from the disk."""
    rng = random.Random(2)
    h = history.History(spark, ranges=64, slots=64)
    frame = lambda rs: spark.createDataFrame(rs, "age long, body string")
    for k in range(2):
        h.add(frame([(100 * k + i, prose(rng, 40)) for i in range(50)]))
    seen = []
    table = history.History._table
    monkeypatch.setattr(history.History, "_table", lambda self, kind, schema, parts=None: (seen.append((kind, parts)), table(self, kind, schema, parts))[1])
    assert h.add(frame([(900, prose(rng, 40))])).count() == 0
    assert all(parts is not None and len(parts) <= history.KEYS for _, parts in seen[:2])
    h.compact()
    fs, path = h._fs(), h._path("keys")
    assert [s.getPath().getName() for s in fs.listStatus(path)] == [f"run={h.state['runs'][0]}"]


def test_crowded_stretches(spark):
    """More records that share a long passage than a window holds: the windows widen, and the oldest is found."""
    rng = random.Random(6)
    shared = prose(rng, 60)
    own = [prose(rng, 25) for _ in range(60)]
    rows = [(i, f"{shared} {o}") for i, o in enumerate(own)] + [(100 + i, f"{own[i]} {shared} {prose(rng, 3)}") for i in range(60)]
    sets = {i: grams(b, 5) for i, b in rows}
    want = {i: j for i in sets for j in [next((j for j in sorted(sets) if j < i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5), None)] if j is not None}
    got = {r["age"]: r["match"] for r in history.History(spark).add(spark.createDataFrame(rows, "age long, body string")).collect()}
    assert got == want and len(want) == 119


def test_recall_near_the_threshold(spark):
    """Pairs of a similarity from 0.50 to 0.60, each beside records that are like no other."""
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(1500):
        n = rng.randint(40, 90)
        words = prose(rng, n).split()
        changed = list(words)
        for at in rng.sample(range(0, n - 4, 5), max(1, round(n * rng.uniform(0.055, 0.07)))):
            changed[at] = f"neu{rng.random()}"
        a, b = " ".join(words), " ".join(changed)
        sim = len(grams(a, 5) & grams(b, 5)) / len(grams(a, 5) | grams(b, 5))
        if 0.5 <= sim <= 0.6:
            want[100000 + i] = i
            rows += [(i, a), (100000 + i, b)]
    got = {r["age"]: r["match"] for r in history.History(spark).add(spark.createDataFrame(rows, "age long, body string")).collect()}
    assert len(want) > 300 and not set(got) - set(want)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.995 * len(want)


def test_repeated_files(spark):
    text = "der alte hut liegt im garten und der regen fällt auf die laterne am turm"
    kb = spark.createDataFrame([(7, text), (3, text), (9, None)], "kb_id long, body string")
    new = spark.createDataFrame([(1, text.upper(), 1), (2, "ganz andere worte stehen hier in diesem text den niemand kennt", 1), (3, "ganz andere worte stehen hier in diesem text den niemand kennt", 2), (3, "ganz andere worte stehen hier in diesem text den niemand kennt", 2), (4, "", None)], "file_id long, body string, batch_no int")
    assert sorted(tuple(r) for r in history.repeated_files(kb, new).collect()) == [(1, "kb_entries", 3), (3, "incoming_files", 2)]
    assert history.repeated_files(kb.limit(0), new.limit(0)).count() == 0


def test_batch_by_batch(spark, data):
    """Twelve steps with compaction between them give what one step gives."""
    kb, new = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("kb_entries", "incoming_files"))
    one, many = (sorted(tuple(r) for r in history.repeated_files(kb, new, together=k).collect()) for k in (10**9, 1))
    assert one == many and one


# p5


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("Ａ１", ["fullwidth"]), ("e\u0301", ["combining"]), ("ha\u00adus", ["invisible"]), ("a\u200bb", ["invisible"]), ("a\u00a0b", ["space"]), ("a\u3000b\u2009c", ["space"]), ("р\u0430ypal", ["lookalike"]), ("Βιβλία und вода", []),
        ("👩\u200d🚀 ☺️", []), ("👩\u200d🚀 a\u200db", ["invisible"]), ("Über Äpfel – „so“ … ½ m² № 7 'x'", []), ("5 µm", []), ("h\u00ad\u0430us", ["invisible", "lookalike"]), ("", []), ("a\tb\nc", []), ("x\u0335", []),
    ],
)
def test_char_kinds(text, kinds):
    assert forms.kinds_of(text) == kinds


def test_one_form():
    rng = random.Random(4)
    pool = "aAeéE\u0301\u0308ß ſﬁ\u00a0\u200b\u00adＡ１аορ²½…İıΣς\u1e9e\u3000\ufe0f가\u1100"
    for _ in range(2000):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert forms.one_form(forms.one_form(t)) == forms.one_form(t), t
        t = "".join(rng.choice(pool + "   \n") for _ in range(rng.randint(0, 40)))
        assert forms._form(t, {}) == forms.one_form(t), t
    same = ["Café Straße 12", "ＣＡＦÉ STRASSE 12", "Cafe\u0301\u00a0Stra\u00adße １２", "Саfé Straße 12"]
    assert len({forms.one_form(t) for t in same}) == 1


def test_kinds_are_what_the_form_changes(monkeypatch):
    """A step that is left out changes nothing, and its kind is gone."""
    text = "\uff21 e\u0301 a\u00a0b ha\u00adus h\u0430us"
    assert forms.kinds_of(text) == list(forms.KINDS)
    for step, kind in (("FULLWIDTH", "fullwidth"), ("MARKED", "combining"), ("SPACES", "space"), ("INVISIBLE", "invisible")):
        with monkeypatch.context() as m:
            m.setattr(forms, step, re.compile("(?!)"))
            assert forms.kinds_of(text) == [k for k in forms.KINDS if k != kind]


def test_forms_by_table(spark):
    plain = ["Der Hut – „ja“", "STRASSE ß", "", "É\tx\ny"]
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([*plain, None, "Ａ", "Ａ" * 50000])], "origin string, item_id long, text string").withColumn("form", F.lit(3))
    got = {r["item_id"]: (r["char_kinds"], r["form"]) for r in forms.normalise(df).collect()}
    assert all(got[i] == ([], forms.one_form(t)) for i, t in enumerate(plain)) and got[4] == ([], None) and got[5] == (["fullwidth"], "a") and len(got[6][1]) == 50000
    more = df.unionByName(spark.createDataFrame([("b", 1, "e\u0301 a\u00a0b \uff21"), ("b", 2, "\uff21 " * 9), ("b", 3, "– nichts")], "origin string, item_id long, text string").withColumn("form", F.lit(3)))
    rows = sorted(tuple(r) for r in forms.affected(more.union(more)).collect())
    assert rows == [("a", 5, "fullwidth"), ("a", 6, "fullwidth"), ("b", 1, "combining"), ("b", 1, "fullwidth"), ("b", 1, "space"), ("b", 2, "fullwidth")] and forms.affected(df.limit(0)).count() == 0
    assert forms.normalise(df.limit(0)).count() == 0 and unicodedata.is_normalized("NFC", got[3][1])


# p6


def test_survivors(spark):
    chapters = spark.createDataFrame(
        [
            (1, "Der Hut", "kurz", "a.TXT", 5.0, "2020-01-01 00:00:00"), (2, "1. Der Hut|brw", "viel länger", "b.md", None, "2022-01-01 00:00:00"), (3, "Anders", "viel längeR", "c.DOCX", 7.0, "2021-01-01 00:00:00"),
            (4, None, None, None, None, None), (5, None, "", "x", None, None), (1, "Der Hut", "kurz", "a.TXT", 5.0, "2020-01-01 00:00:00"), (6, "Allein", "y", "z.md", 1.0, None),
        ],
        "chapter_id long, title string, content string, source_file string, score double, at string",
    ).withColumn("scored_at", F.to_timestamp("at")).withColumn("group_id", F.lit(-1)).withColumn("rank", F.lit(0))
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "chapter_id long, group_id long")
    trust = spark.createDataFrame([("docx", 1), ("md", 2), ("txt", 5)], "source_type string, trust_rank int")
    got = {r["group_id"]: r for r in survivors.survivors(chapters, groups, trust).collect()}
    assert [got[1][c] for c in ("content_from", "score_from", "source_from")] == [2, 3, 3] and [got[4][c] for c in ("content_from", "score_from", "source_from")] == [5, None, 4]
    whole = {r["group_id"]: r for r in survivors.records(chapters, groups, trust).collect()}
    assert (whole[1]["content"], whole[1]["score"], whole[1]["source_file"]) == ("viel länger", 7.0, "c.DOCX")
    assert "der hut" in whole[1]["titles"] and whole[4]["titles"] is None and whole[4]["score_p"] is None and all(0 < whole[1][p] < 1 for p in ("content_p", "score_p", "source_p"))
    assert survivors.records(chapters.limit(0), groups.limit(0), trust).count() == 0
    assert survivors.survivors(chapters.limit(0), groups.limit(0), trust).count() == 0


def test_judge_finds_the_liar(spark):
    rng = random.Random(1)
    claims = []
    for item in range(120):
        for s in ("gut1", "gut2", "gut3"):
            claims += [(item, f"wahr{item}", s)] * (rng.random() < 0.95) + [(item, f"auch{item}", s)] * (rng.random() < 0.9)
        claims.append((item, f"falsch{item}", "schlecht"))
    facts, sources = survivors.judge(spark.createDataFrame(claims, "item long, value string, source string"))
    by = {r["source"]: r for r in sources.collect()}
    assert by["gut1"]["specificity"] > 0.9 > 0.3 > by["schlecht"]["sensitivity"] and by["gut2"]["sensitivity"] > 0.85
    p = facts.collect()
    assert all(r["p"] > 0.5 for r in p if r["value"].startswith("wahr")) and all(r["p"] < 0.5 for r in p if r["value"].startswith("falsch"))


def test_judged_choices(spark, monkeypatch):
    """A source that contradicts the others everywhere is chosen by the rules and not by the model; without the model's verdict both are the same."""
    rows = []
    for g in range(0, 400, 10):
        rows += [(g + i, g, f"Hut {g}", f"der Hut {g}", f"gut{i}.md", 5.0, f"2020-01-0{i} 00:00:00") for i in (1, 2, 3)]
        rows.append((g + 4, g, f"Turm {g}", f"ein viel längerer Turm {g}", "schlecht.docx", 9.0 + g, "2021-01-01 00:00:00"))
    rows += [(1000, 1000, None, None, None, None, None), (1001, 1000, None, "", "x", None, None), (1002, 1000, None, None, None, float("nan"), None), *rows[:2]]
    chapters = spark.createDataFrame(rows, "chapter_id long, group_id long, title string, content string, source_file string, score double, at string").withColumn("scored_at", F.to_timestamp("at"))
    groups = chapters.select("chapter_id", "group_id").distinct()
    trust = spark.createDataFrame([("docx", 1), ("md", 2)], "source_type string, trust_rank int")

    def by_group(df):
        return {r["group_id"]: (r["content_from"], r["score_from"], r["source_from"]) for r in df.collect()}

    fixed = by_group(survivors.survivors(chapters, groups, trust))
    assert fixed == {g: (g + 4,) * 3 for g in range(0, 400, 10)} | {1000: (1001, None, 1000)}
    assert by_group(survivors.judged(chapters, groups, trust)) == {g: (g + 1, g + 3, g + 1) for g in range(0, 400, 10)} | {1000: (1001, None, 1000)}
    assert survivors.judged(chapters.limit(0), groups.limit(0), trust).count() == 0
    real = survivors.judge
    monkeypatch.setattr(survivors, "judge", lambda claims: (real(claims)[0].withColumn("p", F.lit(1.0)), None))
    assert by_group(survivors.judged(chapters, groups, trust)) == fixed


# p7


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(120)] + [(2000, 2000 + i) for i in range(1, 90)] + [(5, 5), (None, 3), (4, None)]
    edges += edges[:40] + [(b, a) for a, b in edges[40:80]]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    df = spark.createDataFrame(edges, "a long, b long").withColumn("c", F.lit(1))
    got = {r["vertex"]: r["group_id"] for r in components.connected_components(df).collect()}
    assert got == {v: find(v) for v in root}
    assert components.connected_components(df.limit(0)).count() == 0


def test_chapter_groups(spark):
    chapters = spark.createDataFrame([(10, "a", 0), (10, "a", 0), (11, "b", 0), (12, "b", 1), (13, None, 0), (14, "c", None)], "chapter_id long, source_file string, chapter_index int")
    matches = spark.createDataFrame([("a", 0, "b", 0), ("b", 0, "a", 0), ("b", 1, "b", 1), ("b", 1, "zz", 9), (None, 0, "b", 1)], "source_a string, index_a int, source_b string, index_b int")
    assert sorted(tuple(r) for r in components.chapter_groups(matches, chapters).collect()) == [(10, 10), (11, 10)]


# p8


@pytest.mark.parametrize("most", [leaks.MAX_WINDOWS, 1])
def test_leaks_against_brute_force(spark, most):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randint(5, 60))) for i in range(30)] + [(90, None), (91, "zu kurz"), (92, " ")]
    items.append((93, items[4][1]))
    docs = []
    for d in range(150):
        w = prose(rng, rng.randint(0, 120)).split()
        for _ in range(rng.randint(0, 2)):
            src = (items[rng.randrange(30)][1]).split()
            n = rng.choice([11, 13, 14, 15, 30])
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + "," for x in src[:n]]
        docs.append((d, " \n".join(w)))
    docs += [(900, None), (901, ""), docs[3], (902, items[2][1] * 1 + " " + "x " * 50000)]
    want = {(d, i) for d, t in docs for i, s in items if grams(t, 14) & grams(s, 14)}
    frame = lambda rows, k: spark.createDataFrame(rows, f"{k} long, text string").withColumn("hash", F.lit(1))
    found = [tuple(r) for r in leaks.find_leaks(frame(docs, "doc_id"), frame(items, "item_id"), max_windows=most).collect()]
    assert set(found) == want and len(found) == len(want) > 20
    assert leaks.find_leaks(frame(docs[:1], "doc_id").limit(0), frame(items, "item_id"), max_windows=most).count() == 0
    assert leaks.find_leaks(frame(docs, "doc_id"), frame(items, "item_id").limit(0), max_windows=most).count() == 0


def test_windows_of_leaks(spark):
    """Windows next to each other mostly share a signature, the least of their shingles."""
    rng = random.Random(3)
    item = prose(rng, 30)
    docs = spark.createDataFrame([(1, "vorab " + item + " danach"), (2, prose(rng, 30))], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [tuple(r) for r in leaks.find_leaks(docs, items).collect()] == [(1, 7)]
    w = leaks.Windows(__import__("pyarrow").array([item]), 14)
    assert len(w.signatures) == 17 > len(set(w.signatures)) and (w.sets(np.arange(17)).min(axis=1) == w.signatures).all()


# p9


def test_apportionment():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 8))
        w, seats, caps = rng.choice([0, 0.1, 0.2, 0.3, 0.05, 1], n), int(rng.integers(0, 60)), rng.integers(0, 40, n)
        got = mixture.apportion(w, seats, caps)
        assert got.sum() == min(seats, caps[w > 0].sum()) and (got <= caps).all() and not got[w == 0].any()
        given = [w[i] / (2 * got[i] - 1) for i in range(n) if got[i]]
        open_ = [w[i] / (2 * got[i] + 1) for i in range(n) if got[i] < caps[i] and w[i] > 0]
        assert min(given, default=9) >= max(open_, default=0) - 1e-12


def test_shard_quotas():
    rng = np.random.default_rng(2)
    for _ in range(200):
        tokens = rng.integers(1, 900, int(rng.integers(1, 9)))
        repeats, block = int(rng.integers(1, 4)), int(rng.choice([16, 64]))
        blocks = int(rng.integers(0, repeats * tokens.sum() // block + 1))
        got = mixture.shard_quotas(tokens, blocks, repeats, block)
        assert got.sum() == blocks * block and (got <= repeats * tokens).all() and (got >= 0).all()


def test_mixture(spark):
    rng = random.Random(6)
    docs = [(i, prose(rng, rng.randint(20, 80)), rng.choice(["groß"] * 6 + ["klein", "mittel", "ungenannt", None])) for i in range(900)]
    docs += [(1000, docs[0][1], "klein"), (1001, None, "klein"), (1002, " ", "groß"), docs[5]]
    targets = spark.createDataFrame([("groß", 0.5, 1), ("klein", 0.3, 3), ("mittel", 0.2, 2), ("leer", 0.1, 4), ("null", 0.0, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    used, report = mixture.mix(spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("uses", F.lit(9)), targets, block=64, shard=5000)
    by = {r["source"]: r for r in report.collect()}
    assert set(by) == {"groß", "klein", "mittel", "leer", "null"} and by["leer"]["used_tokens"] == by["null"]["used_tokens"] == 0
    assert all(abs(by[s]["actual_share"] - by[s]["attainable_share"]) < 0.02 for s in by) and abs(sum(r["actual_share"] for r in by.values()) - 1) < 1e-9
    rows = used.collect()
    texts = {d: t for d, t, _ in docs}
    assert len({texts[r["doc_id"]] for r in rows}) == len(rows) and all(r["uses"] <= by[r["source"]]["max_repeats"] for r in rows)
    used, report = mixture.mix(spark.createDataFrame([], "doc_id long, text string, source string"), targets)
    assert used.count() == 0 and report.count() == 5


# p10


def test_subjects(spark):
    rng = random.Random(2)
    terms = {"law": ["gericht", "klage", "urteil", "zeuge"], "sport": ["tor", "pokal", "trainer", "staffel"], "music": ["geige", "akkord", "takt", "bass"]}
    plain = lambda: "Der alte Hut findet " + rng.choice(["den Turm", "den Bach", "die Wolke", "den Zettel"]) + " am " + rng.choice(["Morgen", "Abend"]) + "."
    about = lambda s: f"Der {rng.choice(terms[s])} sucht {rng.choice(['den', 'das'])} {rng.choice(terms[s])} am {rng.choice(['Morgen', 'Abend'])}."
    samples = [(k, s, " ".join(about(s) if rng.random() < 0.7 else plain() for _ in range(5))) for k in range(20) for s in terms]
    docs, want = [], set()
    for d in range(300):
        chosen = rng.sample(sorted(terms), rng.choice([0, 1, 1, 2]))
        body = [about(s) for s in chosen for _ in range(6)] + [plain() for _ in range(12 - 6 * len(chosen))]
        if rng.random() < 0.3 and not chosen:
            body[3] = about(rng.choice(sorted(terms)))
        docs.append((d, " ".join(body)))
        want |= {(d, s) for s in chosen}
    docs += [(900, None), (901, " "), (902, "---\ntitle: gericht klage\n---\n" + " ".join(plain() for _ in range(5))), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("subject", F.lit("clash"))
    sm = spark.createDataFrame([*samples, (99, "unknown", "x y z"), (98, "law", None)], "sample_id long, subject string, text string")
    areas = spark.createDataFrame([(s, "") for s in terms], "subject string, description string")
    got = [tuple(r) for r in subjects.subject_areas(df, sm, areas).collect()]
    assert len(got) == len(set(got)) and len(set(got) ^ want) <= 0.01 * len(want)
    assert subjects.subject_areas(df, sm.limit(0), areas).count() == 0 and subjects.subject_areas(df.limit(0), sm, areas).count() == 0


def test_terms_of_distinct_texts(spark):
    """Copies of a text make no terms of its words; terms joined give what terms sent give."""
    rng = random.Random(4)
    names, first = ["law", "sport"], {"gericht": 0, "klage": 0, "tor": 1, "pokal": 1}
    law = [f"Das Gericht prüft die Klage {w}. Die Klage ruht, Zeuge kommt. Das Gericht wartet." for w in ("heute", "bald", "nie", "oft")]
    copied = "Das Gericht prüft die Klage. Die Klage nennt Zylinder und Walnuss. Das Gericht wartet."
    docs = [*law, *[copied] * 30, "Der Zylinder liegt im Schrank. Dort ist es dunkel."]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    found = subjects.corpus_terms(df, names, first)
    terms = found if isinstance(found, dict) else {r["word"]: r["label"] for r in found.collect()}
    assert terms.get("zeuge") == 0 and not {"zylinder", "walnuss", "nennt"} & set(terms)

    samples = [(s, f"Der {a} sucht den {b}. Der alte Hut ist nass.") for s, ws in (("law", ["gericht", "klage"]), ("sport", ["tor", "pokal"]), ("music", ["geige", "akkord"])) for a in ws for b in ws]
    sm = spark.createDataFrame(samples, "subject string, text string")
    areas = spark.createDataFrame([("law",), ("sport",), ("music",)], "subject string")
    more = [f"Das Tor und der Pokal {rng.random()}. Ein Pokal steht am Tor. Der alte Hut ist nass." for _ in range(5)]
    df = spark.createDataFrame(list(enumerate(docs + more + [None, ""])), "doc_id long, text string")
    df = df.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string"))).withColumn("odds", F.lit("clash"))
    sent, joined = ({tuple(r) for r in subjects.subject_areas(df, sm, areas, most=k, most_sources=k).collect()} for k in (50_000, 0))
    assert sent == joined and {(k, "law") for k in range(4)} <= sent


def test_source_odds(spark, monkeypatch):
    """A source whose documents deal with one subject makes that likelier where the text leaves it open; joined odds give what sent ones give."""
    counts = spark.createDataFrame([(1, "recht", 0, 90), (1, "recht", 2, 100), (1, "sport", 1, 90), (1, "sport", 2, 100), (0, "wort", 0, 5)], "kind int, word string, label int, n long")
    got = {r["source"]: r for r in subjects.source_odds(counts, 2).collect()}
    assert got["recht"]["n"] == 100 and got["recht"]["odds"][0] > 1 > -1 > got["recht"]["odds"][1] and got["sport"]["odds"][1] > 1
    labels = np.array([[True, False], [False, True]] * 200)
    drawn = subjects.draw_sources(labels, [(r["n"], r["shares"], r["odds"]) for r in got.values()], np.random.default_rng(1))
    assert (np.sign(drawn[:, 0]) == np.where(labels[:, 0], 1, -1)).mean() > 0.9 and subjects.draw_sources(labels, [], None) is None
    features, count = np.zeros((400, 2, 4)), np.full(400, 8)
    features[:, :, 0], features[:, :, 1], features[:, :, 3] = 0.25, 2, 2
    chain = subjects.Chain(2).fit(subjects.with_odds(features, drawn), count, labels, np.arange(400) % 3 == 0)
    assert (chain.decode(subjects.with_odds(features, drawn), count) == labels).mean() > 0.9
    assert (chain.decode(subjects.with_odds(features, None), count) == labels).mean() < 0.8


def test_held_out_accuracy(spark, data):
    rows = [(r["subject"], r["text"]) for r in spark.read.parquet(f"{data}/subject_samples.parquet").orderBy("sample_id").collect()]
    names, terms = subjects.sample_terms(rows[::2])
    f, c, y = subjects.compose(rows[::2], names, terms)
    chain = subjects.Chain(len(names)).fit(f, c, y, np.arange(len(y)) % 3 == 0)
    f, c, y = subjects.compose(rows[1::2], names, terms, n=1000, seed=5)
    assert (chain.decode(f, c) == y).mean() > 0.93
