"""Pages as Markdown, on the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser


class _Page(HTMLParser):
    INLINE = {"b": "**", "strong": "**", "em": "*", "i": "*"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[str] = [""]
        self.hidden = 0
        self.pre = 0
        self.row: list[str] | None = None

    def put(self, s: str) -> None:
        if not self.hidden:
            if self.row is not None:
                self.row[-1:] = [(self.row[-1] if self.row else "") + s.replace("\n", " ")]
            else:
                self.lines[-1] += s

    def line(self, n: int = 1) -> None:
        if self.row is None:
            self.lines += [""] * (n if self.lines[-1].strip() or self.pre else 0)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in ("script", "style", "head", "nav"):
            self.hidden += 1
        elif tag in self.INLINE:
            self.put(self.INLINE[tag])
        elif re.fullmatch(r"h[1-6]", tag):
            self.line(2)
            self.put("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.line()
            self.put("- ")
        elif tag == "tr":
            self.line()
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.row.append("")
        elif tag == "pre":
            self.line()
            self.pre += 1
            self.lines += ["```", ""] if self.lines[-1] else []
            if self.lines[-1] == "":
                self.lines[-1:] = ["```", ""] if len(self.lines) < 2 or self.lines[-2] != "```" else [""]
        elif tag == "br":
            self.lines.append("") if self.row is None else self.put(" ")
        elif tag == "hr":
            self.line()
            self.lines += ["---", ""]
        elif tag == "img":
            self.put(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("p", "div", "ul", "ol", "table", "blockquote"):
            self.line(2 if tag == "p" else 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "head", "nav"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in self.INLINE:
            self.put(self.INLINE[tag])
        elif tag == "tr" and self.row is not None:
            cells, self.row = self.row, None
            self.put(" | ".join(c.strip() for c in cells))
            self.line()
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.lines += ["```", ""]
        elif tag in ("p", "div", "ul", "ol", "table", "blockquote", "li") or re.fullmatch(r"h[1-6]", tag):
            self.line(2 if tag == "p" or tag[0] == "h" else 1)

    def handle_data(self, data: str) -> None:
        if self.pre:
            first, *more = data.split("\n")
            self.put(first)
            for m in more:
                self.lines.append("")
                self.put(m)
        else:
            self.put(re.sub(r"\s+", " ", data))


def to_markdown(page: str) -> str:
    """Headings, lists, tables, code, emphasis, pictures and rules; script, style, head and menus go."""
    p = _Page()
    p.feed(page)
    p.close()
    text = "\n".join(line if line.startswith(" ") and "```" in p.lines else line.strip() for line in p.lines)
    return re.sub(r"\n{3,}", "\n\n", text).strip()
