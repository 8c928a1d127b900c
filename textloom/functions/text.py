"""Column functions over text. All are JVM expressions but for the few that say otherwise.

Word and space classes are spelled out, as the JVM's own are ASCII or leave out letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"

# The short list of function words, for matching chapters with each other.
STOPWORDS = (
    "der die das und oder ist in zu den ein eine einen dem des mit auf fuer von im am es sich an als wie auch aber nicht "
    "was dass so nur noch schon sehr aus"
).split()
# The long list, for matching with the knowledge base.
STOPWORDS_LONG = [*STOPWORDS, "bei", "nach", "durch", "ohne", "ueber", "unter", "vor"]

#: Suffix that sources put behind their titles after a bar.
SUFFIX = "brw"

# Words that tell a mood, in the order that decides ties.
MOODS = {
    "euphorisch": ["!", "fantastisch", "wunderbar", "geil", "hammer", "liebe", "freude", "endlich"],
    "gereizt": ["scheisse", "mist", "verdammt", "nerv", "wut", "ärger", "kotzt", "idiot"],
    "nachdenklich": ["vielleicht", "moeglicherweise", "frage mich", "warum", "bedeut", "sinn", "gruebl"],
    "kryptisch": ["steinchen", "fragment", "echo", "spiegel", "verschlung", "nebel", "mutter erde"],
    "melancholisch": ["traurig", "verloren", "einsam", "sehnsucht", "vermiss", "dunkel", "schatten"],
    "sachlich": ["also", "demnach", "folglich", "zusammenfass", "ergebnis", "fakten"],
}
# Phrases of encyclopedic style.
FACTUAL = [
    "ist ein", "bezeichnet man", "wird definiert als", "handelt es sich um", "im allgemeinen", "laut definition",
    "wissenschaftlich betrachtet", "objektiv gesehen", "zusammenfassend laesst sich sagen", "im folgenden",
]
# Words that call for the best model.
EXCELLENT = ["essenz", "gesamtwerk", "identitaets-update", "grosse synthese", "abschluss-reflexion", "tief kreativ"]
# Word stems that call for a good model, in the rules with three tiers.
GOOD = [
    "analyse", "essay", "reflekti", "interpret", "deute", "philosoph", "identitaet", "kreativ", "dicht", "schreib",
    "widerspruch", "korrektur", "kommentier", "zusammenfass", "tiefgehend", "komplex",
]
# Phrases of an answer that isn't one.
UNSURE = ["weiss ich nicht", "kann ich nicht", "keine ahnung", "muesste ich", "unsicher", "nicht sicher", "unklar"]


def bind(value: Column, use) -> Column:  # noqa: ANN001
    """use(value) with the value computed once: a plain column would be inlined at each use."""
    return F.transform(F.array(value), use)[0]


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, SPACE + "+", " ")


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column, stopwords: list[str] = STOPWORDS_LONG) -> Column:
    """Words of three characters and more that are no function words, in order."""
    not_stop = rf"(?!(?:{'|'.join(stopwords)})(?![\p{{L}}\p{{N}}_]))" if stopwords else ""
    # one pattern rather than a filter over all words: a lambda would run interpreted for each
    return F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_]){not_stop}[\p{{L}}\p{{N}}_]{{3,}}"), 0)


def runs(words: Column, k: int, short: str = "whole") -> Column:
    """Distinct runs of k words; of fewer words one run of all, or (short="words") each word."""

    def build(w: Column) -> Column:
        less = F.array(F.array_join(w, " ")) if short == "whole" else F.array_distinct(w)
        many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " ")))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, less).otherwise(many)

    return bind(words, build)


def shingles(text: Column, k: int = 5, stopwords: list[str] = STOPWORDS_LONG, short: str = "whole") -> Column:
    """Set of word runs; null and empty texts have none."""
    return runs(tokens(F.coalesce(text, F.lit("")), stopwords), k, short)


def plain_shingles(text: Column, k: int = 3) -> Column:
    """Runs of words between white space, function words included; short texts are one run."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE + "+"), lambda w: w != "")
    return runs(words, k)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets: 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def similarity_class(similarity: Column, near: float = 0.20, exact: float = 0.50) -> Column:
    return F.when(similarity >= exact, "EXACT").when(similarity >= near, "NEAR").otherwise("NEW")


def word_count(text: Column) -> Column:
    """Words between white space; 0 of a null text."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != ""))


def normal_title(title: Column, suffix: str = SUFFIX) -> Column:
    t = F.regexp_replace(title, rf"(?i)\|[a-z]*{suffix}[a-z]*", "")
    t = F.regexp_replace(t, rf"^{SPACE}*[0-9]+\.{SPACE}*", "")
    t = F.regexp_replace(t, r"[^a-zA-Z0-9\x{00c0}-\x{017f}\s\p{Z}\x1c-\x1f\x85]", " ")
    return F.lower(F.trim(squeeze(t)))


def title_words(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normal_title(F.coalesce(title, F.lit(""))), " "), lambda w: w != ""))


def display_title(title: Column, suffix: str = SUFFIX, one_line: bool = False) -> Column:
    """Without number and suffix; ``one_line`` also squeezes blanks and unescapes points, after the number."""
    t = F.regexp_replace(title, rf"(?i){SPACE}*\|{SPACE}*[a-z]*{suffix}[a-z]*", "")
    t = F.regexp_replace(t, rf"^{SPACE}*[0-9]+\.{SPACE}+", "")
    if one_line:
        t = F.regexp_replace(squeeze(t), r"\\\.", ".")
    return strip(t)


def file_name(title: Column, most: int = 60) -> Column:
    """Safe name of a title; untitled where nothing is left."""
    s = F.regexp_replace(display_title(title), r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85-]", "")
    s = F.substring(F.regexp_replace(strip(s), SPACE + "+", "_"), 1, most)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("untitled"))


def slug(title: Column, number: Column, day: Column, most: int = 80) -> Column:
    """Name of a post's file: day, title with hyphens, or post and its number."""
    s = F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x85-]", "")
    s = F.substring(F.regexp_replace(strip(s), SPACE + "+", "-"), 1, most)
    name = F.when(s != "", s).otherwise(F.concat(F.lit("post-"), number.cast("string")))
    return F.concat(F.coalesce(F.nullif(F.substring(day, 1, 10), F.lit("")), F.lit("0000-00-00")), F.lit("_"), name, F.lit(".md"))


def import_title(title: Column, most: int = 80) -> Column:
    s = F.regexp_replace(F.coalesce(title, F.lit("")), r"[^a-zA-Z0-9\x{00c0}-\x{017f}\s\p{Z}\x1c-\x1f\x85-]", "")
    s = F.regexp_replace(F.regexp_replace(s, SPACE + "+", "-"), r"^-+|-+$", "")
    return F.substring(s, 1, most)


def fingerprint(title: Column, content: Column) -> Column:
    words = F.filter(F.split(F.coalesce(content, F.lit("")), SPACE + "+"), lambda w: w != "")
    first = F.lower(F.array_join(F.slice(words, 1, 30), " "))
    return F.concat(F.substring(normal_title(F.coalesce(title, F.lit(""))), 1, 60), F.lit(" | "), F.substring(first, 1, 200))


def front_matter(text: Column) -> Column:
    """Struct (title, body) of a text that may begin with front matter closed by a line of ``---``.

    A title with a quote or apostrophe in it isn't taken; then, and where there is none, title is null.
    """
    end = F.locate("\n---", text, 4)
    has = text.startswith("---") & (end > 0)
    head = F.when(has, F.substring(text, F.lit(4), end - 4))
    title = F.regexp_extract(head, r"(?m)^[ \t]*title:[ \t]*['\"]?([^'\"\n]+?)['\"]?[ \t]*$", 1)
    body = F.when(has, F.regexp_replace(F.substring(text, end + 4, F.length(text)), r"^\n+", "")).otherwise(text)
    return F.struct(F.nullif(F.trim(title), F.lit("")).alias("title"), body.alias("body"))


def first_heading(body: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.+)$", 1)), F.lit(""))


def times(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def signals(text: Column, characters: bool = True) -> Column:
    """Struct of the typographic signals of a text; a null text counts as empty.

    ``characters=False`` leaves out the number of different characters, the dearest of them.
    """
    t = F.coalesce(text, F.lit(""))

    def build(t: Column) -> Column:
        lines = F.split(t, "\n")
        some = lambda p: F.size(F.filter(lines, lambda line: line.rlike(p)))
        return F.struct(
            F.size(lines).alias("n_lines"),
            F.length(t).alias("n_chars"),
            word_count(t).alias("n_words"),
            *([F.size(F.array_distinct(F.regexp_extract_all(t, F.lit("(?s)."), 0))).alias("unique_chars")] if characters else []),
            some(SPACE + r"{4,}[^\s\p{Z}\x1c-\x1f\x85]").alias("ws_4plus"),
            some(SPACE + "{8,}").alias("ws_8plus"),
            some(SPACE + "{16,}").alias("ws_16plus"),
            some(f"^{SPACE}*$").alias("empty_lines"),
            F.round(some(f"^{SPACE}*$") / F.size(lines), 3).alias("empty_ratio"),
            F.size(F.regexp_extract_all(t, F.lit(r"(&(?:nbsp|amp|lt|gt|quot|#[0-9]+);)"), 1)).alias("html_entities"),
            times(t, "—").alias("em_dashes"),
            times(t, "–").alias("en_dashes"),
            (times(t, "“") + times(t, "”")).alias("smart_quotes_d"),
            (times(t, "‘") + times(t, "’")).alias("smart_quotes_s"),
            times(t, " ").alias("nbsp_unicode"),
            times(t, "…").alias("ellipsis"),
            times(t, "\t").alias("tabs"),
        )

    return bind(t, build)


def score_parts(s: Column, volume: bool = False) -> Column:
    """Struct of the score's parts, per thousand words; ``volume`` adds up to 5 for length."""
    norm = F.lit(1000.0) / F.greatest(s.getField("n_words"), F.lit(1))
    f = s.getField
    ws = (f("ws_16plus") * 5.0 + f("ws_8plus") * 2.0 + f("ws_4plus") * 0.3 + f("tabs") * 0.5) * norm
    uni = (f("em_dashes") * 0.5 + f("en_dashes") * 0.3 + f("smart_quotes_d") * 0.2 + f("smart_quotes_s") * 0.2 + f("nbsp_unicode") * 0.5 + f("ellipsis") * 0.3) * norm
    er = f("empty_ratio")
    structure = F.when(er.between(0.10, 0.40), 10.0).when(er.between(0.05, 0.55), 5.0).otherwise(2.0)
    penalty = f("html_entities") * 0.3 * norm
    total = ws + uni + structure - penalty
    if volume:
        total = total + F.least(F.lit(5.0), f("n_words") / 200.0)
    return F.struct(ws.alias("ws_fidelity"), uni.alias("uni_fidelity"), structure.alias("structure_fidelity"), penalty.alias("penalty"), total.alias("aggregate"))


def mood(text: Column) -> Column:
    """The mood with most of its words in the text, of equals the first; neutral without any."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def build(low: Column) -> Column:
        score = {m: sum((low.contains(w).cast("int") for w in words[1:]), low.contains(words[0]).cast("int")) for m, words in MOODS.items()}
        most = F.greatest(*score.values())
        out = F.when(most == 0, "neutral")
        for m, s in score.items():
            out = out.when(s == most, m)
        return out

    return bind(low, build)


def too_factual(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    marks = sum((low.contains(m).cast("int") for m in FACTUAL[1:]), low.contains(FACTUAL[0]).cast("int"))
    dots = (F.length(t) - F.length(F.replace(t, F.lit("..."), F.lit("")))) / 3
    dashes = (F.length(t) - F.length(F.replace(t, F.lit("---"), F.lit("")))) / 3
    spaced = F.size(F.regexp_extract_all(t, F.lit(r"([A-Z]\s[A-Z]\s[A-Z])"), 1))
    return (marks >= 2) & (dots + dashes + times(t, "*") + spaced < 3)


def route(text: Column, best: bool = True, any_model: bool = True) -> Column:
    """Tier of a prompt: excellent if it asks for it, else standard; fallback without the better models."""
    low = F.lower(F.coalesce(text, F.lit("")))
    asks = low.rlike("|".join(EXCELLENT))
    return F.when(asks, "excellent").otherwise("standard") if best else F.lit("fallback" if any_model else "none")


def route_tiers(text: Column) -> Column:
    """The rules with three tiers: excellent, else good if it asks for that, else standard."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.when(low.rlike("|".join(EXCELLENT)), "excellent").when(low.rlike("|".join(GOOD)), "good").otherwise("standard")


def route_two(text: Column) -> Column:
    """The oldest rules, with two tiers: good if it asks for that, else standard."""
    return F.when(F.lower(F.coalesce(text, F.lit(""))).rlike("|".join(GOOD)), "good").otherwise("standard")


def printable(text: Column) -> Column:
    """Without control characters but tabs and line ends, and without invisible ones."""
    return strip(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200f}\x{feff}]", ""))


def cell(text: Column, most: int) -> Column:
    """The beginning of a text for a table's cell: bars escaped, lines joined."""
    return F.replace(F.replace(F.substring(F.coalesce(text, F.lit("")), 1, most), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def clamp(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def pause_seconds(minutes: Column) -> Column:
    return F.when(minutes <= 5, 60).when(minutes <= 30, 180).otherwise(300)


def log_parts(text: Column) -> Column:
    """A log's parts: what stands before the first heading with a date, and each entry."""
    return F.split(text, r"\n(?=### \d{4}-\d{2}-\d{2})")


def front_matter_fields(text: Column) -> Column:
    """Map of the fields of front matter that ends at the next three hyphens wherever they stand; quotes around values go, the last of equal keys counts."""
    end = F.locate("---", text, 4)
    head = F.when(text.startswith("---") & (end > 0), F.substring(text, F.lit(4), end - 4))
    lines = F.filter(F.split(strip(F.coalesce(head, F.lit(""))), "\n"), lambda x: x.contains(":"))
    fields = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), F.regexp_replace(F.regexp_replace(strip(F.substr(x, F.locate(":", x) + 1)), '^"+|"+$', ""), "^'+|'+$", "").alias("value")))
    keys = F.transform(fields, lambda x: x["key"])
    # the last of equal keys
    return F.map_from_entries(F.filter(fields, lambda x, i: F.array_position(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), x["key"]) == 0))


def sentences(text: Column) -> Column:
    return F.split(strip(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")


def search_query(text: Column, most: int = 150) -> Column:
    """First question of 11 to ``most`` characters, else the beginning cut at a blank."""
    t = F.coalesce(text, F.lit(""))
    asked = F.filter(F.transform(sentences(t), strip), lambda s: s.contains("?") & (F.length(s) > 10) & (F.length(s) <= most))
    start = F.substring(t, 1, most)
    cut = F.when(F.length(t) <= most, strip(t)).otherwise(strip(F.regexp_replace(start, r"(?s) [^ ]*$", "")))
    return F.coalesce(F.try_element_at(asked, F.lit(1)), cut)


def guard(text: Column, most: int = 300) -> Column:
    """A query no longer than ``most``, cut at a blank."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) <= most, t).otherwise(F.regexp_replace(F.substring(t, 1, most), r"(?s) [^ ]*$", ""))


def snippet(text: Column, terms: list[str], window: int = 300) -> Column:
    """The text around the earliest term, with dots where it is cut."""
    low = F.lower(text)
    n = F.length(text)
    at = F.least(*(F.when(F.locate(t, low) > 0, F.locate(t, low) - 1).otherwise(n) for t in terms), n)

    def build(at: Column) -> Column:
        start, end = F.greatest(at - window // 2, F.lit(0)), F.least(n, at + window // 2)
        return F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < n, "...").otherwise(""))

    return bind(at, build)


def occurrences(text: Column, terms: list[str]) -> Column:
    """How often the terms occur, a term named twice counting twice, overlaps not."""
    low = F.lower(F.coalesce(text, F.lit("")))
    one = [(F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / F.lit(len(t)) for t in terms]
    return sum(one[1:], one[0]).cast("int")


# The entities that a page's plain text decodes, in this order.
BASIC_ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#160;", " "))


def page_basic(html: Column, decode: bool = True) -> Column:
    """Text of a page: ends of blocks become line ends, tags go, the seven basic entities are decoded."""
    t = F.regexp_replace(html, r"(?i)</(p|div|h[1-6]|li|br|pre)>", "\n")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)<br\s*/?>", "\n"), r"<[^>]+>", "")
    for entity, sign in BASIC_ENTITIES if decode else ():
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return t


def page_text(html: Column, decode: bool = True) -> Column:
    """As ``page_basic`` but for head, style and script, rules of style sheets, and many blank lines.

    ``decode=False`` leaves the entities as they are, for a reader that decodes all of them once.
    """
    t = html
    for tag in ("head", "style", "script"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
    body = F.regexp_extract(t, r"(?is)<body[^>]*>(.*?)</body>", 1)
    t = page_basic(F.when(t.rlike(r"(?is)<body[^>]*>.*?</body>"), body).otherwise(t), decode)
    lines = F.filter(F.split(t, "\n"), lambda x: ~x.rlike(r"^\s*(@(page|media|font|import)|[{}])|margin-|padding-|font-size:|font-family:|color:\s*#"))
    return strip(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def page_title(html: Column, number: Column | None = None) -> Column:
    """First heading of 3 to 200 characters, else first short paragraph, else the title; else a name with the number, null without one."""
    def plain(c: Column) -> Column:
        return strip(F.regexp_replace(c, r"<[^>]+>", ""))

    heading = plain(F.regexp_extract(html, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1))
    ok = lambda c, most: (F.length(c) >= 3) & (F.length(c) <= most)
    paragraphs = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), 1), plain)
    short = F.filter(paragraphs, lambda p: ok(p, 150) & ~p.rlike("@page|margin-|font-"))
    return F.coalesce(F.when(ok(heading, 200), heading), F.try_element_at(short, F.lit(1)), F.nullif(strip(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1)), F.lit("")), *([] if number is None else [F.format_string("(Datei %d)", number)]))


def clean_lines(text: Column) -> Column:
    """Without lines of navigation and more than two blank lines in a row."""
    t = F.regexp_replace(text, r"\n{4,}", "\n\n\n")
    return strip(F.regexp_replace(t, r"(?m)^(Vorherige Seite|Nächste Seite|Start|Inhaltsverzeichnis)[ \t]*$", ""))


def yaml_value(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit(" "))


def upload_path(url: Column) -> Column:
    """Path below uploads of a URL, year and month first, percent signs decoded; null without one."""
    return F.nullif(F.regexp_extract(F.url_decode(F.replace(F.parse_url(url, F.lit("PATH")), F.lit("+"), F.lit("%2B"))), r"uploads/([0-9]{4}/[0-9]{2}/.+)$", 1), F.lit(""))
