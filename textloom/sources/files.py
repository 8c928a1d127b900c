"""Readers of the formats that texts come in. Each gives a DataFrame; a file that can't be read
gives a row with an error and no text, and the job goes on."""

from __future__ import annotations

import html
import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from textloom.functions import text as T
from textloom.session import ship
from textloom.sources.html import to_markdown

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCUMENT = "path string, filename string, source_type string, size_bytes long, part string, title string, text string, error string"
#: Parts of a book that hold no chapter.
SKIPPED = re.compile(r"titlepage|title_page|toc|nav|cover|copyright|about", re.I)


@F.pandas_udf(StringType())
def unescape(s: pd.Series) -> pd.Series:
    """Entities decoded; the JVM has no function for it."""
    return s.map(lambda x: html.unescape(x) if x is not None else None)


def read_markdown(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Markdown files: path, filename, bucket (directory below the path, or root) and text. README.md
    and files that begin with an underscore are left out."""
    ship(spark)
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.md").withColumns({"path": F.col("_metadata.file_path"), "filename": F.url_decode("_metadata.file_name")})
    bucket = F.regexp_extract("path", rf"{re.escape(path.rstrip('/'))}/(.+)/[^/]+$", 1)
    return files.where("filename <> 'README.md' and filename not like '\\_%'").select("path", "filename", F.when(bucket == "", "root").otherwise(bucket).alias("bucket"), unescape("value").alias("text"))


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a knowledge base: filename, kb_kind, title (front matter, first heading or name) and body."""
    f = read_markdown(spark, path).withColumn("x", T.front_matter(F.col("text")))
    stem = F.regexp_replace("filename", r"\.md$", "")
    kind = F.when(F.col("filename").rlike("^[^_]*Essenz_"), "essenz").when(F.col("filename").rlike(r"^\d{4}-\d{2}-\d{2}_"), "blog").otherwise("other")
    return f.select("filename", kind.alias("kb_kind"), F.coalesce("x.title", T.first_heading(F.col("x.body")), stem).alias("title"), F.col("x.body").alias("body"))


def docx_paragraphs(content: bytes) -> list[tuple[str, str]]:
    """Paragraphs (style, text) of a word processor's file, tabs and breaks kept."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    out = []
    for p in root.iter(f"{_W}p"):
        style = p.find(f"{_W}pPr/{_W}pStyle")
        signs = {f"{_W}tab": "\t", f"{_W}br": "\n"}
        text = "".join((e.text or "") if e.tag == f"{_W}t" else signs.get(e.tag, "") for e in p.iter() if not (e.tag == f"{_W}tab" and e.attrib))
        out.append((style.get(f"{_W}val") or "" if style is not None else "", text))
    return out


def zip_pages(content: bytes, inside: str = "") -> list[tuple[str, str]]:
    """Pages (name, source) of a book in a zip, by name; with ``inside`` the ones below it, if there are any."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = sorted(n for n in z.namelist() if re.search(r"\.x?html?$", n, re.I))
        below = [n for n in names if inside and inside in f"/{n}"]
        return [(n, z.read(n).decode("utf-8", errors="replace")) for n in below or names]


Part = tuple[str, str | None, str | None]


def _book(content: bytes, inside: str, skip: bool) -> Iterator[Part]:
    for part, page in zip_pages(content, inside):
        if not (skip and SKIPPED.search(part.rsplit("/", 1)[-1])):
            yield part, None, page


#: What reads a file by its ending: its parts as (name, text) or (name, source of a page). Others can be added.
READERS: dict[str, Callable[[bytes], Iterable[Part]]] = {
    "docx": lambda content: [("", "\n".join(t for _, t in docx_paragraphs(content)), None)],
    "epub": lambda content: _book(content, "", True),
    "zip": lambda content: _book(content, "/OEBPS", False),
    "html": lambda content: [("", None, content.decode("utf-8", errors="replace"))],
    "md": lambda content: [("", html.unescape(content.decode("utf-8", errors="replace")), None)],
    "txt": lambda content: [("", html.unescape(content.decode("utf-8", errors="replace")), None)],
}


def _parts(name: str, content: bytes, readers: dict[str, Callable[[bytes], Iterable[Part]]]) -> Iterable[Part]:
    kind = name.rsplit(".", 1)[-1].lower()
    if kind not in readers:
        raise ValueError(f"no reader for .{kind}")
    return readers[kind](content)


def read_documents(spark: SparkSession, path: str, recursive: bool = False, shortest: int = 20, readers: dict[str, Callable[[bytes], Iterable[Part]]] | None = None) -> DataFrame:
    """Documents of all formats by their ending: md, txt, html, docx one row each, epub and zip one a page.

    ``readers`` adds to READERS or replaces some. Pages of fewer than ``shortest`` characters are left out. A file that can't be read has an
    error and no text.
    """
    ship(spark)
    known = {**READERS, **(readers or {})}
    schema = "path string, filename string, source_type string, size_bytes long, part string, text string, page string, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                base = {"path": r.path, "filename": r.filename, "source_type": r.filename.rsplit(".", 1)[-1].lower(), "size_bytes": r.length}
                try:
                    rows += [{**base, "part": part, "text": text, "page": page, "error": None} for part, text, page in _parts(r.filename, bytes(r.content), known)]
                except Exception as e:  # noqa: BLE001
                    rows.append({**base, "part": "", "text": None, "page": None, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["path", "filename", "source_type", "size_bytes", "part", "text", "page", "error"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    files = files.where(~F.col("path").rlike(r"/(README\.md|[._][^/]*)$")).select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "length", "content")
    parts = files.mapInPandas(run, schema)
    text = F.when(F.col("page").isNotNull(), unescape(T.page_text(F.col("page"), decode=False))).otherwise(F.col("text"))
    out = parts.select("path", "filename", "source_type", "size_bytes", "part", unescape(T.page_title(F.col("page"))).alias("title"), text.alias("text"), "error")
    return out.where((F.length("text") >= shortest) | F.col("error").isNotNull() | (F.col("part") == ""))


_ITEM = "title string, content string, category array<struct<value:string,domain:string>>, id long, date string, slug string, status string, parent long, kind string, url string"


def _export_items(source: io.BufferedIOBase) -> Iterator[tuple]:
    """Items of an export, one at a time; elements are told by their local names, whatever version of the format."""
    for _, e in ElementTree.iterparse(source):
        if e.tag != "item":
            continue
        own = {c.tag.rsplit("}", 1)[-1] if "}" in c.tag else c.tag: c.text for c in e if not ("excerpt" in c.tag and c.tag.endswith("encoded"))}
        number = lambda name: int(own[name]) if (own.get(name) or "").strip().isdigit() else None
        labels = [(c.text, c.get("domain")) for c in e if c.tag == "category"]
        yield own.get("title"), own.get("encoded"), [{"value": v, "domain": d} for v, d in labels], number("post_id"), own.get("post_date"), own.get("post_name"), own.get("status"), number("post_parent"), own.get("post_type"), own.get("attachment_url")
        e.clear()


def read_posts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Posts and attachments of a blog's export: its XML files, or zip archives of them.

    Plain files are cut at their items by Spark's reader; archives are streamed item by item,
    an archive a task.
    """
    if path.lower().endswith(".zip"):
        ship(spark)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = ["title", "content", "category", "id", "date", "slug", "status", "parent", "kind", "url"]
            for frame in frames:
                for content in frame["content"]:
                    with zipfile.ZipFile(io.BytesIO(bytes(content))) as z:
                        for name in sorted(n for n in z.namelist() if n.lower().endswith(".xml")):
                            with z.open(name) as f:
                                yield pd.DataFrame(list(_export_items(f)), columns=names)

        items = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, _ITEM)
    else:
        item = (
            "title string, `content:encoded` string, category array<struct<_VALUE:string,_domain:string,_nicename:string>>, `wp:post_id` long, `wp:post_date` string, "
            "`wp:post_name` string, `wp:status` string, `wp:post_parent` long, `wp:post_type` string, `wp:attachment_url` string"
        )
        raw = spark.read.format("xml").option("rowTag", "item").option("valueTag", "_VALUE").schema(item).load(path)
        items = raw.select(
            "title", F.col("`content:encoded`").alias("content"), F.transform("category", lambda c: F.struct(c["_VALUE"].alias("value"), c["_domain"].alias("domain"))).alias("category"), F.col("`wp:post_id`").alias("id"), F.col("`wp:post_date`").alias("date"),
            F.col("`wp:post_name`").alias("slug"), F.col("`wp:status`").alias("status"), F.col("`wp:post_parent`").alias("parent"), F.col("`wp:post_type`").alias("kind"), F.col("`wp:attachment_url`").alias("url"),
        )
    labels = lambda domain: F.transform(F.filter(F.coalesce("category", F.array().cast("array<struct<value:string,domain:string>>")), lambda c: c["domain"] == domain), lambda c: c["value"])
    posts = items.where("kind = 'post'").select("id", "title", "slug", "date", F.coalesce("status", F.lit("draft")).alias("status"), F.col("content").alias("content_html"), labels("category").alias("categories"), labels("post_tag").alias("tags"))
    return posts, items.where("kind = 'attachment'").select(F.col("id").alias("post_id"), "url", F.col("parent").alias("parent_id"), "title")


def with_attachments(posts: DataFrame, attachments: DataFrame, media: DataFrame) -> DataFrame:
    """Adds to ``media`` of each post (see local_images) the local names of its attachments that the archives hold, each once, the ones in its text first.

    Posts without attachments stay as they are.
    """
    held = attachments.where("parent_id > 0").select(F.col("parent_id").alias("id"), "post_id", T.upload_path(F.col("url")).alias("url_path")).join(media.select("url_path", "name").dropDuplicates(["url_path"]), "url_path")
    own = held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("post_id", "name"))).alias("own"))
    names = F.transform(F.coalesce("own", F.array().cast(own.schema["own"].dataType)), lambda x: x["name"])
    return posts.join(own, "id", "left").withColumn("media", F.array_distinct(F.concat("media", names))).drop("own")


def list_media(spark: SparkSession, path: str) -> DataFrame:
    """Files in tar archives: archive, name and url_path (year, month and name, where it has them)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(r.path, m.name, m.size) for r in frame.itertuples(index=False) for m in tarfile.open(fileobj=io.BytesIO(bytes(r.content))) if m.isfile()]
            yield pd.DataFrame(rows, columns=["archive", "name", "size"])

    names = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, name string, size long")
    return names.withColumn("url_path", F.nullif(F.regexp_extract("name", r"(\d{4}/\d{2}/.+)$", 1), F.lit("")))


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """Conversation logs, arrays in JSON; what is damaged gives no row."""
    return spark.read.schema("timestamp timestamp, role string, message string, mood string, model string").json(path, multiLine=True, mode="DROPMALFORMED").where("role is not null")


@F.pandas_udf(StringType())
def html_to_markdown(s: pd.Series) -> pd.Series:
    return s.map(lambda x: to_markdown(x) if x is not None else None)


def local_images(posts: DataFrame, media: DataFrame, text: str = "content_html") -> DataFrame:
    """Replaces links to uploads by local names where the media have them, and lists the ones used.

    ``posts`` has id, ``media`` url_path and name. A join, not a map on the driver.
    """
    found = posts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>)]+/uploads/\d{4}/\d{2}/[^\s\"'<>)]+)"), 1))).alias("url")).withColumn("url_path", T.upload_path(F.col("url")))
    used = found.join(media.select("url_path", "name").dropDuplicates(["url_path"]), "url_path").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.length("url")).alias("k"), "url", "name"))).alias("used"))
    joined = posts.join(used, "id", "left")
    replaced = F.aggregate(F.coalesce("used", F.array().cast(used.schema["used"].dataType)), F.col(text), lambda t, u: F.replace(t, u.url, u["name"]))
    return joined.withColumn(text, replaced).withColumn("media", F.array_distinct(F.transform(F.coalesce("used", F.array().cast(used.schema["used"].dataType)), lambda u: u["name"]))).drop("used")
