"""Markup residue in text documents: what kinds a text holds, and the clean text.

A text is read once, as a stream of events: Markdown fences first, as what stands in them
is quoted; then the events of the standard library's HTML parser; then, in the text that
these leave, Markdown, wiki and LaTeX constructs. The clean text keeps headings (``# ``),
list items (``- ``), table cells, code (in fences) and formulas.

In texts with HTML, each line has a ratio of text to tags, inline ones aside. The ratios are
smoothed with a Gaussian over neighbouring lines and fall into two clusters, content and
the rest; of the rest, lines stay that hold structure or end a sentence, so that menus,
link lists and empty shells go.

The kinds are found in the same way, in the regions of the lower cluster of text to signs.
As one construct left behind counts wherever it stands, an exact check follows: a kind
that no region shows is searched in the whole text.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("html", "markdown", "wiki", "latex")

# Element names of HTML.
ELEMENTS = frozenset(
    "a abbr acronym address area article aside audio b base bdi bdo big blink blockquote body br button canvas caption center "
    "cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer "
    "form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark menu "
    "meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script section "
    "select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title "
    "tr track tt u ul var video wbr".split()
)
#: Elements inside a line of text, which say nothing about what the line is.
INLINE = frozenset("b i em strong u s sub sup small big code kbd samp var q cite abbr acronym mark font span tt del ins strike dfn br wbr bdi bdo time data".split())
BLOCKS = frozenset("address article aside blockquote body caption dd div dl dt fieldset figcaption figure footer form header hr html li main nav ol p pre section table tbody tfoot thead title tr ul".split())

# LaTeX commands that stand without braces.
BARE = (
    "alpha|beta|gamma|delta|epsilon|zeta|eta|theta|iota|kappa|lambda|mu|nu|xi|pi|rho|sigma|tau|phi|chi|psi|omega|Gamma|Delta|Theta|Lambda|Sigma|Phi|Psi|Omega|"
    "cdot|cdots|ldots|dots|times|div|pm|mp|leq|geq|neq|approx|equiv|sim|infty|partial|nabla|sum|prod|int|oint|lim|log|ln|sin|cos|tan|exp|max|min|"
    "in|notin|subset|cup|cap|forall|exists|to|rightarrow|leftarrow|Rightarrow|left|right|quad|qquad|item|maketitle|tableofcontents|newpage|clearpage|noindent|centering|hline|par|bigskip|medskip|smallskip|LaTeX|TeX"
)

FENCE = re.compile(r"^(```+|~~~+)[^\n`]*$(?:.*?^\1[`~]*[ \t]*$|.*\Z)", re.M | re.S)
ENTITY = re.compile(r"&(#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
WIKI = re.compile(r"'''|(?<![\w'])''[^\s']|\[\[|\]\]|(?<![}\w^_])\{\{|(?<!\})\}\}(?!\$)(?=\s|$)|^\{\|[ \t]*(?:\w+=|$)|^\|\}[ \t]*$|^\|-+[ \t]*$|^(={1,6})[ \t]*[^=\s](?:[^\n]*[^=\s])?[ \t]*\1[ \t]*$", re.M)
MARKDOWN = re.compile(
    r"^ {0,3}#{1,6}[ \t]+\S|\*\*(?=[^\s*])|(?<=[^\s*])\*\*|!?\[[^\[\]\n]*\]\([^()\s]*(?:\([^()\s]*\))?[^()\n]*\)|^\|?[ \t]*:?-{3,}:?[ \t]*\|[ \t|:-]*$|^\|[ \t]+[^|\n]+(?:\|[^|\n]*)*\|[ \t]*$"
    r"|^>[ \t]+\S|^(?=[^\n]*\w)[^\n]+\n(?:={3,}|-{3,})[ \t]*$|(?<!`)`[^`\n]+`(?!`)|^```|^(?:[-*+][ \t]+\S[^\n]*\n){2,}",
    re.M,
)
LATEX = re.compile(rf"(?<![\w:\\/])\\(?:(?:[a-zA-Z]+\*?(?:\[[^\]\n]*\])?\{{)|(?:(?:{BARE})(?![A-Za-z])))|\$\$|\\\[|\\\]|\\\(|\\\)|(?<![\\$\w])\$(?=[^\s$])[^$\n]*(?:\\[a-zA-Z]|[\^_]\{{)[^$\n]*\$|[A-Za-z0-9)\]}}][\^_]\{{")

#: Texts without any of these hold no markup.
SUSPECT = r"[<&*`\[\]{}\\$^|]|''|(?m)^#|(?m)^>|(?m)^={1,6}|(?m)^-{3}|~~~|(?m)^[-+] "


class _Events(HTMLParser):
    """Collects text and, per line of output, the number of tags."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.found = False
        self.tags: dict[int, int] = {}
        self.line = 0
        self.quiet = 0
        self.pre = 0
        self.cells = 0
        self.heading = 0
        self.lead = False
        self.menus = 0

    def _put(self, s: str) -> None:
        if s and not self.quiet:
            self.out.append(s)
            self.line += s.count("\n")

    def _line(self, s: str = "") -> None:
        """Text at the start of a line."""
        if self.out and not self.out[-1].endswith("\n"):
            s = "\n" + s
        self._put(s)

    def _tag(self, name: str = "") -> None:
        self.found = True
        if name not in INLINE:
            self.tags[self.line] = self.tags.get(self.line, 0) + 1

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in ELEMENTS:
            self._put(self.get_starttag_text() or "")
            return
        self._tag(tag)
        if tag in ("script", "style"):
            self.quiet += 1
        elif tag == "nav":
            self._line()
            if self.menus:  # a menu that is closed again; of one left open the rest isn't menu
                self.menus -= 1
                self.quiet += 1
        elif tag == "br":
            self._put("\n")
        elif tag == "hr":
            self._put("\n\n")
        elif tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self._line("#" * int(tag[1]) + " ")
            self.heading += 1
            self.lead = True
        elif tag == "li":
            self._line("- ")
            self.lead = True
        elif tag == "pre":
            self.pre += 1
            self._line("```\n")
        elif tag in ("td", "th"):
            self._put(" | " if self.cells else "")
            self.cells += 1
        elif tag == "img":
            self._put(dict(attrs).get("alt") or "")
        elif tag in BLOCKS:
            self.cells = 0
            self._line()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("script", "style"):
            self.quiet = max(0, self.quiet - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag not in ELEMENTS:
            self._put(f"</{tag}>")
            return
        self._tag(tag)
        if tag in ("script", "style", "nav"):
            self.quiet = max(0, self.quiet - 1)
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self._line("```\n")
        elif tag in BLOCKS or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            self.heading = max(0, self.heading - (tag not in BLOCKS))
            self.lead = False
            self._line()

    def handle_data(self, data: str) -> None:
        if self.heading:
            data = re.sub(r"\s+", " ", data)
        if self.lead:
            data = data.lstrip()
            self.lead = not data
        if not self.pre and data.isspace() and self.out and self.out[-1].endswith("\n"):
            data = "\n" * min(1, max(0, data.count("\n") - 1))  # the line has ended already
        self._put(data)

    def _reference(self, raw: str) -> None:
        decoded = html.unescape(raw)
        if decoded != raw:
            self.found = True
        self._put(decoded)

    def handle_entityref(self, name: str) -> None:
        raw = f"&{name};"
        if raw in self.source:
            self._reference(raw)
        else:
            self._put(f"&{name}")

    def handle_charref(self, name: str) -> None:
        raw = f"&#{name};"
        if raw in self.source:
            self._reference(raw)
        else:
            self._put(f"&#{name}")

    def handle_comment(self, data: str) -> None:
        self._tag()

    def handle_decl(self, decl: str) -> None:
        if decl[:7].lower() == "doctype":
            self._tag()
        else:
            self._put(f"<!{decl}>")

    def unknown_decl(self, data: str) -> None:
        self._put(f"<![{data}]>")

    def handle_pi(self, data: str) -> None:
        self._tag()

    def run(self, text: str) -> str:
        self.source = text
        self.menus = len(re.findall(r"(?is)<nav\b(?:(?!<nav\b).)*?</nav", text)) if "<nav" in text.lower() else 0
        self.feed(text)
        self.close()
        return "".join(self.out)


def clusters(values: np.ndarray) -> float | None:
    """The boundary between two clusters of values, by means; none where the higher isn't a quarter above the lower."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        above = values >= (low + high) / 2
        n = int(above.sum())
        if not n or n == len(values):
            break
        total = float(values[above].sum())
        new = (float(values.sum()) - total) / (len(values) - n), total / n
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2 if high >= 1.25 * low and high > 0 else None


def content_lines(ratios: list[float], radius: int = 2, sigma: float = 1.0) -> list[bool]:
    """Lines whose smoothed ratio of text to tags falls into the higher of two clusters; all where there is one cluster only."""
    if not ratios:
        return []
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma * sigma))
    n = len(ratios)
    # beyond the first and the last line there is nothing to weigh
    smooth = np.convolve(ratios, kernel)[radius : radius + n] / np.convolve(np.ones(n), kernel)[radius : radius + n]
    boundary = clusters(smooth)
    return [True] * n if boundary is None else (smooth >= boundary).tolist()


def _regions(text: str, tags: dict[int, int]) -> str:
    lines = text.split("\n")
    keep = content_lines([len(line.strip()) / max(1, tags.get(i, 0)) for i, line in enumerate(lines)])
    code = False
    out = []
    for i, (line, good) in enumerate(zip(lines, keep)):
        bare = line.strip()
        fence = bare.startswith("```")
        code ^= fence
        if good or fence or code or not tags.get(i) or re.match(r"#{1,6} \S|- \S|.* \| |.*\$|.*\\[(\[]", bare) or re.search(r"[.!?…;:][\"'»“”’)]*$", bare) or not bare:
            out.append(line)
    return "\n".join(out)


#: Signs that the constructs of Markdown, wikis and LaTeX are made of.
SIGNS = re.compile(r"[*`\[\]{}\\$^|#>]|''|={2,}|-{3,}|^[-+] ")
PATTERNS = {"markdown": MARKDOWN, "wiki": WIKI, "latex": LATEX}


def marked_regions(source: str) -> str:
    """The lines whose smoothed ratio of text to signs falls into the lower of two clusters, a blank line between regions.

    A text without signs has none, one with a single cluster is one region.
    """
    lines = source.split("\n")
    marks = [len(SIGNS.findall(line)) for line in lines]
    if not any(marks):
        return ""
    keep = content_lines([len(line.strip()) / max(1, m) if m else len(line) for line, m in zip(lines, marks)])
    if all(keep):
        return source
    return "\n".join("" if good else line for line, good in zip(lines, keep))


_INLINE = (
    (re.compile(r"!?\[\[(?:Datei|File|Image|Bild|Fichier|Archivo|Kategorie|Category):[^\]\n]*\]\]"), ""),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"'''+|(?<![\w'])''(?=[^\s'])|(?<=[^\s'])''(?![\w'])"), ""),
    (re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*[^=\s])?)[ \t]*\1[ \t]*$", re.M), lambda m: f"{'#' * len(m[1])} {m[2]}"),
    (re.compile(r"^\{\|[^\n]*$\n?|^\|\}[ \t]*$\n?|^\|-[^\n]*$\n?", re.M), ""),
    (re.compile(r"^\|[ \t]*:?-{3,}[ \t|:-]*$\n?", re.M), ""),
    (re.compile(r"^![ \t]*([^\n]*)$", re.M), lambda m: " | ".join(c.strip() for c in re.split(r"!!|\|\|", m[1])) if "!!" in m[1] or "||" in m[1] else m[0]),
    (re.compile(r"^[|!][ \t]*([^|\n]*\|\|[^\n]*)$", re.M), lambda m: " | ".join(c.strip() for c in m[1].split("||"))),
    (re.compile(r"^(\*{2,})[ \t]+(?=\S)", re.M), lambda m: "  " * (len(m[1]) - 1) + "- "),
    (re.compile(r"^\|[ \t]*([^\n]*?)[ \t]*\|[ \t]*$", re.M), lambda m: " | ".join(c.strip() for c in m[1].split("|"))),
    (re.compile(r"!\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    (re.compile(r"\[([^\[\]\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)"), r"\1"),
    (re.compile(r"\*\*(?=[^\s*])|(?<=[^\s*])\*\*"), ""),
    (re.compile(r"^(?=[^\n]*\w)([^\n]+)\n={3,}[ \t]*$", re.M), r"# \1"),
    (re.compile(r"^(?=[^\n]*\w)([^\n]+)\n-{3,}[ \t]*$", re.M), r"## \1"),
    (re.compile(r"^[*+] (?=\S)", re.M), "- "),
    (re.compile(r"^> ?", re.M), ""),
    (re.compile(r"(?<!`)`([^`\n]+)`(?!`)"), r"\1"),
)
_TEX = (
    (re.compile(r"\\(?:chapter|section)\*?\{([^{}]*)\}"), r"# \1"),
    (re.compile(r"\\subsection\*?\{([^{}]*)\}"), r"## \1"),
    (re.compile(r"\\(?:subsubsection|paragraph)\*?\{([^{}]*)\}"), r"### \1"),
    (re.compile(r"\\begin\{(?:equation|align|displaymath)\*?\}|\\end\{(?:equation|align|displaymath)\*?\}"), "$$"),
    (re.compile(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\])?[ \t]*\n?"), ""),
    (re.compile(r"^[ \t]*\\item(?:\[([^\]\n]*)\])?[ \t]*", re.M), r"- \1"),
    (re.compile(r"~?\\(?:cite|ref|label|pageref|eqref)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}"), ""),
    (re.compile(r"\\footnote\{([^{}]*)\}"), r" (\1)"),
    (re.compile(r"\\(?:emph|text[a-z]{2}|underline|title|author|mbox|url)\{([^{}]*)\}"), r"\1"),
    (re.compile(r"\\ldots\b(?:\{\})?"), "…"),
    (re.compile(r"(?<=\w)~(?=\w)"), " "),
)
_FORMULA = re.compile(r"(\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|(?<![\\$\w])\$(?=[^\s$])[^$\n]*\$|```.*?```)", re.S)


def read(text: str, clean: bool = True) -> tuple[list[str], str]:
    """The kinds of markup in a text and, if asked for, its clean form."""
    kinds: set[str] = set()
    saved: list[str] = []

    def save(m: re.Match) -> str:
        saved.append(m[0])
        return f"\x00{len(saved) - 1}\x00"

    if "```" in text or "~~~" in text:
        masked = FENCE.sub(save, text.replace("\x00", ""))
    else:
        masked = text
    if saved:
        kinds.add("markdown")
    tags: dict[int, int] = {}
    if "<" in masked or "&" in masked:
        events = _Events()
        plain = events.run(masked)
        if events.found:
            kinds.add("html")
            tags = events.tags
        else:
            plain = masked
    else:
        plain = masked
    source = masked if "html" not in kinds else _outside_tags(masked)
    for part in (marked_regions(source), source):
        kinds |= {kind for kind, pattern in PATTERNS.items() if kind not in kinds and pattern.search(part)}
    if not clean:
        return sorted(kinds), ""
    if not kinds:
        return [], text
    out = _regions(plain, tags) if tags else plain
    parts = _FORMULA.split(out) if "$" in out or "\\" in out or "```" in out else [out]
    for i in range(0, len(parts), 2):
        for pattern, to in _INLINE:
            parts[i] = pattern.sub(to, parts[i])
        if "latex" in kinds:
            for pattern, to in _TEX:
                parts[i] = pattern.sub(to, parts[i])
    out = "".join(parts)
    if saved:
        out = re.sub("\x00(\\d+)\x00", lambda m: saved[int(m[1])], out)
    out = re.sub(r"[ \t\u00a0]+\n", "\n", out)
    return sorted(kinds), re.sub(r"\n{3,}", "\n\n", out).strip()


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>", re.S)
_PRE = re.compile(r"<pre\b.*?(?:</pre\s*>|\Z)", re.S | re.I)


def _outside_tags(text: str) -> str:
    """The source text without HTML tags, preformatted code and entities, for the other kinds."""
    return ENTITY.sub(" ", _TAG.sub("", _PRE.sub(" ", text)))


def text_items(chapters: DataFrame, kb: DataFrame) -> DataFrame:
    return chapters.select(F.lit("chapters").alias("origin"), F.col("chapter_id").alias("item_id"), F.col("content").alias("text")).unionByName(
        kb.select(F.lit("kb_entries").alias("origin"), F.col("kb_id").alias("item_id"), F.col("body").alias("text"))
    )


def suspect(text: Column) -> Column:
    return text.rlike(SUSPECT)


def read_markup(items: DataFrame, clean: bool = True) -> DataFrame:
    """Columns origin, item_id, markup (sorted array of kinds) and, with ``clean``, text.

    ``items`` has origin, item_id and text. A null text gives a null text and no kinds, an
    empty or blank one passes as it is. Texts that hold none of the signs pass in the JVM;
    the others go to Python in Arrow batches, where each distinct text is read once.
    """
    base = items.select("origin", "item_id", "text")
    schema = "origin string, item_id long, markup array<string>" + (", text string" if clean else "")
    fields = [("origin", pa.string()), ("item_id", pa.int64()), ("markup", pa.list_(pa.string()))] + ([("text", pa.string())] if clean else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("text").dictionary_encode()
            got = [read(t, clean) for t in codes.dictionary.to_pylist()]
            columns = [batch.column("origin").cast(pa.string()), batch.column("item_id"), pa.array([g[0] for g in got], pa.list_(pa.string())).take(codes.indices)]
            if clean:
                columns.append(pa.array([g[1] for g in got], pa.string()).take(codes.indices))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    plain = base.where(~F.coalesce(suspect(F.col("text")), F.lit(False))).select("origin", "item_id", F.array().cast("array<string>").alias("markup"), *(["text"] if clean else []))
    return base.where(suspect(F.col("text"))).mapInArrow(run, schema).unionByName(plain)
