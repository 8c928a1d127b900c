"""Segmenters, readers, writers and streams on files made here."""

import io
import json
import random
import tarfile
import zipfile

from pyspark.sql import functions as F

from textloom import streaming
from textloom.sources import chapters, files, segment, sinks
from textloom.sources.html import to_markdown

FILLER = "Ein Satz über den Garten und den Regen. " * 3


def test_headings_need_five():
    four = "".join(f"# T{i}\n{FILLER}\n" for i in range(4))
    assert segment.segment_markdown(four, "f.md")[1] == "monolith"
    got, how = segment.segment_markdown(four + f"# T4\n{FILLER}", "f.md")
    assert how == "headings" and [t for _, t, _ in got] == [f"T{i}" for i in range(5)] and got[0][2] == FILLER.strip()


def test_anchors_need_twenty_links():
    def doc(n):
        return "".join(f"[Kapitel {i}](#a{i})\n" for i in range(n)) + "[Noch einmal](#a0)\n" + "".join(f'<a name="a{i}"></a>{FILLER}\n' for i in range(n) if i != 3)

    assert segment.segment_markdown(doc(18), "f.md")[1] == "monolith"
    got, how = segment.segment_markdown(doc(20), "f.md")
    assert how == "anchors" and len(got) == 19 and got[0][1] == "Kapitel 0" and [k for k, _, _ in got][3] == 4
    few = "".join(f"[K](#a{i})\n" for i in range(20))
    assert segment.segment_markdown(few, "f.md", anchor_least=0) == ([], "anchors")


def test_numbers_and_rules():
    numbered = "".join(f"{i}. Titel {i}|brw\n{FILLER}\n" for i in range(1, 6))
    got, how = segment.segment_markdown(numbered, "f.md")
    assert how == "numbers" and got[2][1] == "Titel 3|brw"
    ruled = "\n---\n".join([f"Abschnitt {i}\n{FILLER}" for i in range(5)] + ["kurz"])
    got, how = segment.segment_markdown(ruled, "f.md")
    assert how == "rules" and len(got) == 5 and got[4][1] == "Abschnitt 4"
    assert segment.segment_markdown("", "f.md") == ([(0, "(gesamt: f.md)", "")], "monolith")


def test_chunks():
    assert segment.chunk("") == [] and segment.chunk("kurz") == ["kurz"]
    random.seed(3)
    text = "\n\n".join(" ".join(random.choice(["Hut", "Regen", "Laterne"]) for _ in range(random.randint(5, 120))) + "." for _ in range(40)) + "x" * 2000
    got = segment.chunk(text)
    assert all(0 < len(c) <= 800 for c in got)
    left = text
    for c in got:
        assert c in text
    assert sum(map(len, got)) >= len("".join(left.split())) * 0.9


def test_segments_and_chunks_by_table(spark):
    df = spark.createDataFrame([("a.md", "# x\ny"), ("b.md", None)], "filename string, text string")
    assert [(r["source_file"], r["strategy"]) for r in segment.segments(df).collect()] == [("a.md", "monolith")]
    assert [(r["id"], r["total_chunks"]) for r in segment.chunks(df, "filename", "text").collect()] == [("a.md_chunk000", 1)]


def test_page_markdown():
    page = "<head><title>weg</title></head><h2>Kopf</h2><p>Ein <b>fetter</b> Satz.</p><ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr></table><pre>x  = 1\ny</pre><script>weg</script><hr><img src='p.png' alt='Bild'>"
    got = to_markdown(page)
    assert "## Kopf" in got and "Ein **fetter** Satz." in got and "- a\n- b" in got and "1 | 2" in got and "```\nx  = 1\ny\n```" in got and "---" in got and "![Bild](p.png)" in got and "weg" not in got


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>' if s else f"<w:p><w:r><w:t>{t}</w:t><w:tab/></w:r></w:p>" for s, t in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_docx(spark, tmp_path):
    (tmp_path / "d.docx").write_bytes(docx(("", "Vorab"), *[p for i in range(5) for p in (("Heading1", f"K{i}"), ("", "Text"), ("", "mehr"))]))
    (tmp_path / "n.docx").write_bytes(docx(*[p for i in range(5) for p in (("", f"{i}. Titel {i}"), ("", "Text"))]))
    (tmp_path / "m.docx").write_bytes(docx(("Heading1", "K"), ("", "Text")))
    (tmp_path / "x.docx").write_bytes(b"kaputt")
    paragraphs = chapters.read_paragraphs(spark, str(tmp_path))
    assert [r["filename"] for r in paragraphs.where("error is not null").collect()] == ["x.docx"]
    got = {}
    for r in chapters.paragraph_chapters(paragraphs, most=7).orderBy("chapter_index").collect():
        got.setdefault((r["source_file"], r["strategy"]), []).append((r["chapter_index"], r["title"], r["content"]))
    assert got["d.docx", "heading1"] == [(i, f"K{i}", "Text\t\nmehr\t") for i in range(5)]
    assert got["n.docx", "numbered"] == [(i, f"{i}. Tite", "Text\t") for i in range(5)]
    assert got["m.docx", "monolith"] == [(0, "(gesamt: m.docx)", "K\nText\t")] and len(got) == 3
    assert {r["strategy"] for r in chapters.paragraph_chapters(paragraphs.where("filename = 'n.docx'"), numbered=False).collect()} == {"monolith"}


def test_book_chapters(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("OEBPS/index_split_001.html", f"<h2>Eins &amp;lt; zwei</h2><p>{FILLER}</p>")
        z.writestr("OEBPS/about.xhtml", f"<p>{FILLER}</p>")
        z.writestr("OEBPS/index_split_002.html", "<p>kurz</p>")
        z.writestr("OEBPS/index_split_003.html", f"<p>{FILLER * 2}</p>")
        z.writestr("OEBPS/index_split_004.html", f"<div>{FILLER}</div>")
    (tmp_path / "x.epub").write_bytes(b"kaputt")
    got = [(r["chapter_index"], r["title"]) for r in chapters.read_book_chapters(spark, str(tmp_path)).orderBy("chapter_index").collect()]
    assert got == [(0, "Eins &lt; zwei"), (1, (FILLER * 2)[:80].strip()), (2, "(Datei 2)")]


def test_preserved_page():
    page = (
        '<html><body><div class="calibreToc">Menü</div><div class="calibreMeta"><div class="calibreMetaAuthor"> Ein\n Autor </div></div>'
        '<div class="x calibreEbookContent"><h1>Band <span class="title">Der <b>Hut</b></span></h1><div class="calibreEbNav">weiter</div><p>Ein <em>Satz</em><br>hier.</p></div>Fuß</body></html>'
    )
    got = chapters.preserved_page(page)
    assert (got["title"], got["author"]) == ("Der Hut", "Ein Autor") and "Ein *Satz*" in got["text"] and not any(w in got["text"] for w in ("weiter", "Menü", "Fuß"))
    assert chapters.preserved_page("<p>ohne</p>") == {"title": None, "author": None, "text": None} and chapters.preserved_page("<body><p>offen")["text"] == "offen"


def test_readers_can_be_added(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("neues Format mit genug Zeichen")
    (tmp_path / "b.abc").write_text("x")
    got = {r["filename"]: (r["text"], r["error"]) for r in files.read_documents(spark, str(tmp_path), readers={"xyz": lambda content: [("", content.decode().upper(), None)]}).collect()}
    assert got["a.xyz"] == ("NEUES FORMAT MIT GENUG ZEICHEN", None) and "no reader" in got["b.abc"][1]


def test_readers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("---\ntitle: Der Hut\n---\nKörper &amp; Geist")
    (tmp_path / "2020-01-02_b.md").write_text("# Kopf\nText")
    (tmp_path / "README.md").write_text("weg")
    (tmp_path / "_c.md").write_text("weg")
    (tmp_path / "sub" / "d.md").write_text("tief")
    kb = {r["filename"]: (r["kb_kind"], r["title"], r["body"]) for r in files.read_kb(spark, str(tmp_path)).collect()}
    assert kb == {"a.md": ("other", "Der Hut", "Körper & Geist"), "2020-01-02_b.md": ("blog", "Kopf", "# Kopf\nText")}
    deep = {r["filename"]: r["bucket"] for r in files.read_markdown(spark, str(tmp_path), recursive=True).collect()}
    assert deep == {"a.md": "root", "2020-01-02_b.md": "root", "d.md": "sub"}


def test_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(("", "Ein Absatz mit Inhalt")))
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("OEBPS/c1.xhtml", f"<body><h1>Eins</h1><p>{FILLER}</p></body>")
        z.writestr("OEBPS/nav.xhtml", f"<body>{FILLER}</body>")
        z.writestr("OEBPS/c2.xhtml", "<body>kurz</body>")
    (tmp_path / "c.docx").write_bytes(b"kaputt")
    (tmp_path / "d.html").write_text("<title>Seite</title><p>Hallo &ouml;ffentliche Welt da</p>")
    got = {(r["filename"], r["part"]): r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {("a.docx", ""), ("b.epub", "OEBPS/c1.xhtml"), ("c.docx", ""), ("d.html", "")}
    assert got["b.epub", "OEBPS/c1.xhtml"]["title"] == "Eins" and "BadZipFile" in got["c.docx", ""]["error"] and got["c.docx", ""]["text"] is None
    assert "öffentliche" in got["d.html", ""]["text"]


def test_posts_and_media(spark, tmp_path):
    item = lambda kind, n, more: f"<item><title>T{n}</title><wp:post_id>{n}</wp:post_id><wp:post_type>{kind}</wp:post_type>{more}</item>"
    (tmp_path / "x.xml").write_text(
        '<rss xmlns:wp="w" xmlns:content="c"><channel>'
        + item("post", 1, '<wp:post_date>2020-01-01 10:00:00</wp:post_date><category domain="category">Hut</category><category domain="post_tag">rot</category><content:encoded>&lt;img src="https://a.example/uploads/2020/01/p.png"&gt;</content:encoded>')
        + item("attachment", 2, "<wp:attachment_url>https://a.example/uploads/2020/01/p.png</wp:attachment_url><wp:post_parent>1</wp:post_parent>")
        + item("page", 3, "") + "</channel></rss>"
    )
    posts, attachments = files.read_posts(spark, str(tmp_path / "x.xml"))
    p = posts.collect()
    assert [(r["id"], r["status"], r["categories"], r["tags"]) for r in p] == [(1, "draft", ["Hut"], ["rot"])]
    assert [(r["post_id"], r["parent_id"]) for r in attachments.collect()] == [(2, 1)]
    with tarfile.open(tmp_path / "m.tar", "w") as t:
        info = tarfile.TarInfo("media/2020/01/p.png")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
        info = tarfile.TarInfo("media/2020/01/q.png")
        t.addfile(info)
    media = files.list_media(spark, str(tmp_path / "m.tar"))
    more = spark.createDataFrame([(3, "https://a.example/uploads/2020/01/q.png", 1, "Q"), (2, "https://a.example/uploads/2020/01/p.png", 1, "P"), (4, "https://a.example/x.png", 1, "X"), (5, "https://a.example/uploads/2020/01/q.png", 0, "Q")], "post_id long, url string, parent_id long, title string")
    assert files.with_attachments(files.local_images(posts, media), more, media).first()["media"] == ["media/2020/01/p.png", "media/2020/01/q.png"]
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.write(tmp_path / "x.xml", "x.xml")
    zipped, others = files.read_posts(spark, str(tmp_path / "x.zip"))
    assert [tuple(r) for r in zipped.collect()] == [tuple(r) for r in p] and [tuple(r) for r in others.collect()] == [tuple(r) for r in attachments.collect()]
    done = files.local_images(posts, media).first()
    assert done["content_html"] == '<img src="media/2020/01/p.png">' and done["media"] == ["media/2020/01/p.png"]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'Ein "Hut"', "2020-01-02 03:04", "publish", "B"), (2, "Ein Hut", "2020-01-02", None, None)], "id long, title string, date string, status string, body string")
    sinks.write_posts(df, str(tmp_path / "p"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "p")).collect())
    assert [g[0] for g in got] == ["2020-01-02_Ein-Hut.md", "2020-01-02_Ein-Hut_2.md"] and 'title: "Ein \\"Hut\\""' in got[0][1] and "status" not in got[1][1]
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "bucket string, n int")
    sinks.write_by_bucket(rows, str(tmp_path / "b"))
    sinks.write_by_bucket(spark.createDataFrame([("b", 3)], "bucket string, n int"), str(tmp_path / "b"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "b")).select("bucket", "n").collect()) == [("a", 1), ("b", 3)]


def test_posts_with_lists(spark, tmp_path):
    df = spark.createDataFrame([(1, "T", "2020-01-02", "draft", "B", "t", ["Hut", 'ro"t'], [])], "id long, title string, date string, status string, body string, slug string, categories array<string>, tags array<string>")
    sinks.write_posts(df, str(tmp_path / "p"))
    text = spark.read.parquet(str(tmp_path / "p")).first()["text"]
    assert 'slug: "t"\ncategories: ["Hut", "ro\\"t"]\n---' in text and "tags" not in text and "wordpress_id: 1\n" in text


def test_merged_essence_manifest_and_report(spark, tmp_path):
    row = (1, "1. Der Hut", "Text", "a.md", 7, 2.5, [("b.md", "Hut", 3, 1.0), ("c.md", "Der Hut", 4, 2.0)])
    df = spark.createDataFrame([row, (2, "Turm", None, "a.md", 1, 0.0, None)], "number long, title string, content string, source_file string, word_count int, score double, alternates array<struct<source_file:string,title:string,word_count:int,score:double>>")
    sinks.write_merged(df, str(tmp_path / "m"))
    got = {r["name"]: r["text"] for r in spark.read.parquet(str(tmp_path / "m")).collect()}
    assert set(got) == {"m0001_Der_Hut.md", "m0002_Turm.md"} and 'title: "Der Hut"\noriginal_title_in_source: "1. Der Hut"' in got["m0001_Der_Hut.md"]
    assert '  - file: b.md\n    title_in_source: "Hut"\n    words: 3\n    score: 1.00\n  - file: c.md\n    words: 4' in got["m0001_Der_Hut.md"] and got["m0001_Der_Hut.md"].endswith("# Der Hut\n\nText\n") and "alternate" not in got["m0002_Turm.md"]
    e = spark.createDataFrame([("neu", 3, "2. Der Hut", "Text", "a.md", 4, 7, "NEAR", 0.256, "k.md"), ("alt", 1, "Turm", "x", "b.md", 0, 1, "NEW", 0.0, None)], "bucket string, number long, title string, content string, source_file string, chapter_index int, word_count int, status string, sim double, best_match string")
    sinks.write_essence(e, str(tmp_path / "e"))
    got = {(r["bucket"], r["name"]): r["text"] for r in spark.read.parquet(str(tmp_path / "e")).collect()}
    assert 'source_index: 4\nword_count: 7\nkb_match_status: "NEAR"\nkb_best_sim: 0.26\nkb_best_match: "k.md"\noriginal_title_in_source: "2. Der Hut"\n---' in got["neu", "0003_Der_Hut.md"]
    assert "best_match" not in got["alt", "0001_Turm.md"] and "original" not in got["alt", "0001_Turm.md"]
    sinks.write_manifest(spark.createDataFrame([("neu", "NEAR", 7), ("neu", "NEAR", 2)], "bucket string, kb_status string, word_count int"), str(tmp_path / "f"))
    assert spark.read.json(str(tmp_path / "f" / "manifest")).count() == 2 and [(r["n"], r["words"]) for r in spark.read.json(str(tmp_path / "f" / "counts")).collect()] == [(2, 9)]
    lines = sinks.report_lines(e, "Neues", {"Titel": F.col("title"), "Treffer": F.col("best_match")}, F.desc("word_count"))
    sinks.write_report(lines, str(tmp_path / "r"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "r")).collect()].count("| 1 | 2. Der Hut | k.md |") == 1
    assert [r["line"] for r in lines.orderBy("place").collect()] == ["# Neues", "", "| # | Titel | Treffer |", "|---|---|---|", "| 1 | 2. Der Hut | k.md |", "| 2 | Turm | - |"]


def test_logs_and_collections(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "a"), ("s2", "b")], "session string, entry string")
    for _ in range(2):
        sinks.append_log(rows, str(tmp_path / "l"), "session")
    assert spark.read.parquet(str(tmp_path / "l")).where("session = 's1'").count() == 2
    for n in (3, 2):
        sinks.replace_chunks(spark.range(n), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    events = spark.createDataFrame([(f"2020-01-01 10:00:{k % 60:02d}", "user", str(k)) for k in range(700)], "t string, role string, message string").select(F.to_timestamp("t").alias("timestamp"), "role", "message")
    assert streaming.kept_events(events).count() == 500 and streaming.kept_events(events, 11).agg(F.min("timestamp")).first()[0].second == 59
    windows = spark.createDataFrame([("2020-01-01 10:10:00", "a", 1.0), ("2020-01-01 10:50:00", "a", 2.0), ("2020-01-01 11:10:00", "b", 3.0)], "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert sorted((r["event_type"], r["n"], r["total"]) for r in streaming.type_windows(windows).collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_search_falls_back_to_words(spark):
    from textloom.operators.vectors import mapped
    from textloom.plans.retrieval import search_library

    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [0.9, 0.1])], "vec_id long, embedding array<double>")
    texts = spark.createDataFrame([(5, "der Hut und der Hut"), (6, "ein Hut"), (7, None)], "doc_id long, text string")
    assert [(r["query"], r["id"]) for r in search_library(spark, vectors, asked, texts, {"9": ["hut"]}, 1).collect()] == [("9", 1)]
    assert sorted((r["id"], round(r["distance"], 3)) for r in search_library(spark, vectors.limit(0), asked, texts, {"9": ["hut"]}).collect()) == [(5, 0.333), (6, 0.5)]
    assert [r["n"] for r in mapped(texts.select("doc_id"), lambda frames: (f.assign(n=f["doc_id"] * 2)[["n"]] for f in frames), "n long").orderBy("n").collect()] == [10, 12, 14]


def test_chat_log_and_stream(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    events = [{"timestamp": f"2020-01-01T10:0{k}:00", "role": "user", "message": m} for k, m in enumerate(["wunderbar", "wunderbar", "nichts"])]
    (log / "a.json").write_text(json.dumps(events))
    (log / "b.json").write_text("[{kaputt")
    assert files.read_chat(spark, str(log)).count() == 3
    stream = tmp_path / "in"
    stream.mkdir()
    (stream / "a.json").write_text("\n".join(json.dumps(e) for e in [*events, events[0]]))
    source = spark.readStream.schema(streaming.EVENT).json(str(stream))
    q = streaming.append_events(source, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["mood"] for r in got.collect()) == ["euphorisch", "euphorisch", "neutral"]
    assert streaming.sessions(spark.read.schema(streaming.EVENT).json(str(stream))).count() == 1


def test_watch_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = " ".join(f"wort{i}" for i in range(40))
    (tmp_path / "in" / "a.md").write_text(f"---\ntitle: x\n---\n{text}")
    (tmp_path / "in" / "b.md").write_text("ganz etwas anderes steht in diesem Dokument hier")
    kb = spark.createDataFrame([(1, text), (2, "leer")], "kb_id long, body string")
    streaming.watch_folder(spark, str(tmp_path / "in"), kb, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {r["path"].rsplit("/", 1)[-1]: (r["best_kb"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a.md": (1, "EXACT"), "b.md": (None, "NEW")}
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("best_sim") > 0).count() == 1
