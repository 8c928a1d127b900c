"""Queries over conversations against plain Python over all rows, on small made tables."""

from textloom.functions import text as T
from textloom.plans import chat


def test_needles_anywhere_in_the_notes(spark, tmp_path):
    texts = [
        ("blog", "Vorab ein Satz. Warum ist der alte Turm am Bach so krumm geworden? Und danach noch mehr."),
        ("blog", "Kurz: der Hut! Danach kommt ein langer Rest über Wolken und den Wald am Bach."),
        ("letter", "WARUM ist der alte Turm am Bach so krumm geworden?"),
        ("letter", "Hut"),
        ("letter", "der hut! danach"),
        ("letter", "olken und den Wald am B"),
        ("letter", "Wer hat denn nun den neuen Turm am Bach gebaut?"),
        ("letter", "der Hut, danach"),
        ("letter", "Schal"),
        ("letter", "Ein Satz. Warum ist der alte Turm am Bach so gerade"),
        ("letter", None),
        ("blog", None),
    ]
    rows = [(k, f"s{k}", kind, text) for k, (kind, text) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, source string, doc_kind string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    needles = {r.doc_id: r.q[:50].lower().strip() for r in df.select("doc_id", T.search_query(T.F.col("text")).alias("q")).collect()}
    notes = [(text or "").lower() for kind, text in texts if kind == "blog"]
    want = [k for k, n in needles.items() if n and not any(n in note for note in notes)]
    assert sorted(want) == [6, 7, 8, 9]
    assert sorted(r.doc_id for r in chat.not_researched(spark, str(tmp_path)).collect()) == want


def test_copies_are_near_duplicates(spark, tmp_path):
    text = lambda w: " ".join(f"{w}{k}" for k in range(12))
    bodies = {1: text("hut"), 2: text("turm"), 3: text("hut"), 4: text("hut") + " und mehr", 5: text("hut").upper() + "  ", 6: text("turm"), 7: text("bach"), 8: None, 9: None, 10: " ", 11: text("hut") + " und mehr"}
    rows = [(k, body) for k, body in bodies.items()]
    spark.createDataFrame(rows + rows[2:4], "file_id long, body string").write.parquet(f"{tmp_path}/incoming_files.parquet")
    sets = {r.file_id: set(r.s) for r in spark.createDataFrame(rows, "file_id long, body string").select("file_id", T.plain_shingles(T.F.col("body")).alias("s")).collect() if r.s}
    like = {k: [j for j in sets if j < k and len(sets[j] & sets[k]) / len(sets[j] | sets[k]) >= 0.4] for k in sets}
    want = {k: (len(found), min(found)) for k, found in like.items() if found}
    assert want == {3: (1, 1), 4: (2, 1), 5: (3, 1), 6: (1, 2), 11: (4, 1)}
    got = chat.near_dup_messages(spark, str(tmp_path)).collect()
    assert len(got) == len(want) and {r.file_id: (r.n_links, r.first_id) for r in got} == want
