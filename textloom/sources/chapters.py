"""Chapters of word processors' files, of books' pages and of saved web pages, as tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from textloom.functions import text as T
from textloom.session import ship
from textloom.sources import files
from textloom.sources.html import to_markdown

# Names of the style of first-level headings.
HEADING_STYLES = ("Heading 1", "Heading1", "berschrift1")


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of docx files: filename, place, style, text and error; a file that can't be read has one row with an error."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                try:
                    rows = [(r.filename, k, style, text, None) for k, (style, text) in enumerate(files.docx_paragraphs(bytes(r.content)))]
                except Exception as e:  # noqa: BLE001
                    rows = [(r.filename, None, None, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["filename", "place", "style", "text", "error"])

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content").mapInPandas(run, "filename string, place int, style string, text string, error string")


def paragraph_chapters(paragraphs: DataFrame, most: int = 100, numbered: bool = True, least: int = 5) -> DataFrame:
    """Rows source_file, strategy, chapter_index, title, content of paragraphs (filename, place, style, text).

    A file is cut at its first-level headings where it has ``least`` of them, else (with
    ``numbered``) at numbered lines where it has as many, else it is one chapter. What stands
    before the first cut is left out; titles keep ``most`` characters. Null texts count as empty.
    """
    p = paragraphs.where("place is not null").select("filename", "place", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("style", F.lit("")).alias("style"))
    head = F.col("style").isin(*HEADING_STYLES)
    line = F.col("text").rlike(r"^\d+\.\s+.{3,200}$") & F.lit(numbered)
    whole = Window.partitionBy("filename")
    marked = p.withColumns({"heads": F.sum(head.cast("int")).over(whole), "lines": F.sum(line.cast("int")).over(whole)})
    strategy = F.when(F.col("heads") >= least, "heading1").when(F.col("lines") >= least, "numbered").otherwise("monolith")
    marked = marked.withColumn("strategy", strategy).withColumn("cut", F.when(F.col("strategy") == "heading1", head).when(F.col("strategy") == "numbered", line).otherwise(False))
    placed = marked.withColumn("chapter_index", F.sum(F.col("cut").cast("int")).over(whole.orderBy("place")) - F.when(F.col("strategy") == "monolith", 0).otherwise(1)).where("chapter_index >= 0")
    body = F.sort_array(F.collect_list(F.when(~F.col("cut") & (F.col("text") != ""), F.struct("place", "text"))))
    out = placed.groupBy("filename", "strategy", "chapter_index").agg(F.max(F.when(F.col("cut"), F.col("text"))).alias("title"), body.alias("body"))
    return out.select(
        F.col("filename").alias("source_file"), "strategy", F.col("chapter_index").cast("int").alias("chapter_index"),
        F.coalesce(F.substring("title", 1, most), F.format_string("(gesamt: %s)", "filename")).alias("title"), F.array_join(F.transform("body", lambda x: x["text"]), "\n").alias("content"),
    )


def short_title(page: Column) -> Column:
    """The first heading or title element of a page, else the beginning of its first paragraph; null without."""
    tags = "|".join(f"<{t}[^>]*>([^<]+)</{t}>" for t in ("h1", "h2", "h3", "title"))
    heading = F.coalesce(*(F.nullif(F.regexp_extract(page, f"(?i){tags}", k), F.lit("")) for k in range(1, 5)))
    return F.coalesce(heading, F.substring(F.nullif(F.regexp_extract(page, r"(?i)<p[^>]*>([^<]+)</p>", 1), F.lit("")), 1, 80))


def page_chapters(pages: DataFrame, decode: Callable[[Column], Column], shortest: int = 20, most: int = 100) -> DataFrame:
    """Rows source_file, chapter_index, title, content of pages (book, name, page): one chapter a page, in the order of their names.

    Pages whose name tells that they hold no chapter, and those of under ``shortest``
    characters, are left out, and the numbers have no gaps. ``decode`` decodes entities.
    """
    t = F.regexp_replace(F.regexp_replace("page", r"(?i)</(p|div|h[1-6]|li|br)>", "\n"), r"(?i)<br\s*/?>", "\n")
    text = T.strip(decode(F.regexp_replace(t, r"<[^>]+>", "")))
    own = pages.where(~F.lower(F.regexp_extract("name", r"([^/]*)$", 1)).rlike(files.SKIPPED.pattern) & F.col("page").isNotNull())
    kept = own.select("book", "name", T.strip(decode(short_title(F.col("page")))).alias("title"), text.alias("content")).where(F.length("content") >= shortest)
    # the pages of one book
    numbered = kept.withColumn("chapter_index", F.row_number().over(Window.partitionBy("book").orderBy("name")) - 1)
    title = F.coalesce(F.col("title"), F.format_string("(Datei %d)", "chapter_index"))
    return numbered.select(F.col("book").alias("source_file"), "chapter_index", F.substring(title, 1, most).alias("title"), "content")


def read_book_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapters of epub files; books that can't be read give no row."""
    ship(spark)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                try:
                    rows = [(r.book, name, page) for name, page in files.zip_pages(bytes(r.content))]
                except Exception:  # noqa: BLE001
                    rows = []
                yield pd.DataFrame(rows, columns=["book", "name", "page"])

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").load(path)
    pages = books.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("book"), "content").mapInPandas(run, "book string, name string, page string")
    return page_chapters(pages, files.unescape)


class _Blocks(HTMLParser):
    """Where elements of given classes begin and end."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.starts = [0]
        for m in re.finditer("\n", page):
            self.starts.append(m.end())
        self.open: list[tuple[str, frozenset, int, int]] = []
        self.found: list[tuple[str, frozenset, int, int, int, int]] = []
        self.page = page
        self.feed(page)
        self.close()
        while self.open:
            self._end(len(page), len(page))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def _end(self, stop: int, after: int) -> None:
        tag, classes, begin, inside = self.open.pop()
        self.found.append((tag, classes, begin, inside, stop, after))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in self.VOID:
            at = self._at()
            self.open.append((tag, frozenset((dict(attrs).get("class") or "").split()), at, at + len(self.get_starttag_text() or "")))

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, *_ in self.open):
            at = self._at()
            after = self.page.find(">", at) + 1 or len(self.page)
            while self.open[-1][0] != tag:
                self._end(at, at)
            self._end(at, after)

    def first(self, tag: str, name: str | None = None) -> tuple[int, int, int, int] | None:
        rows = sorted(f[2:] for f in self.found if f[0] == tag and (name is None or name in f[1]))
        return rows[0] if rows else None


# Classes that a common converter of books gives its pages.
META, AUTHOR, CONTENT, MENUS = "calibreMeta", "calibreMetaAuthor", ("calibreEbookContent", "calibreMain"), ("calibreToc", "calibreEbNav", "calibreEbNavTop", "calibreMeta")


def preserved_page(page: str) -> dict[str, str | None]:
    """Title, author and Markdown text of a saved page of a book: of its content block, without menus; all null without a body."""
    blocks = _Blocks(page)
    body = blocks.first("body")
    if body is None:
        return {"title": None, "author": None, "text": None}
    plain = lambda span: re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", page[span[1] : span[2]])).strip() if span else None
    author = plain(blocks.first("div", AUTHOR))
    content = next((b for b in (blocks.first("div", c) for c in CONTENT) if b), body)
    menus = sorted(f[2:] for f in blocks.found if f[0] == "div" and f[1] & set(MENUS))
    parts, at = [], content[1]
    for begin, _, _, after in menus:
        if content[1] <= begin < content[2] and begin >= at:
            parts.append(page[at:begin])
            at = after
    inner = "".join([*parts, page[at : content[2]]])
    heading = re.search(r"(?is)<h1[^>]*>(.*?)</h1>", inner)
    title = None
    if heading:
        span = re.search(r'(?is)<span[^>]*class="[^"]*\btitle\b[^"]*"[^>]*>(.*?)</span>', heading[1])
        title = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", "", (span or heading)[1])).strip() or None
    return {"title": title, "author": author or None, "text": to_markdown(inner)}


@F.pandas_udf(StructType([StructField(n, StringType()) for n in ("title", "author", "text")]))
def preserved(s: pd.Series) -> pd.DataFrame:
    """Struct of title, author and text of a saved page."""
    return pd.DataFrame([preserved_page(x) if x is not None else {"title": None, "author": None, "text": None} for x in s], columns=["title", "author", "text"])
