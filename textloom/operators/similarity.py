"""Exact similarity joins on sets of strings, without comparing all pairs.

Two sets of a similarity of t or more share an element among the rarest of each: of n
elements, rarest first, the first n - ceil(t n) + 1 suffice. Only these meet in the join,
so that elements which many sets have, such as passages of boilerplate, bring no pairs
together by themselves. An element that one set alone has brings no pair at all: it keeps
its place among the rarest, but no row.

Elements are 64-bit hashes of the strings. Two strings of one set pair with the same hash
would count as one; for two sets of a thousand elements each the chance is below 1e-13.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import blocks as B
from textloom.session import Workspace, spread

#: So many ids are sent to all executors, so that the rows which they choose stay where they are.
SENT = 1_000_000


def hashed(members: Column) -> Column:
    """The set's elements as ascending 64-bit hashes."""
    return F.array_sort(F.transform(members, lambda x: F.xxhash64(x)))


def shared_elements(*sides: DataFrame) -> list[DataFrame]:
    """For each table (id, members): rows id, n, element, often of the elements that more than one set has.

    n is the size of the whole set, often the number of sets of all the tables with the element.
    """
    flat = [s.select("id", F.size("members").alias("n"), F.explode("members").alias("element")) for s in sides]
    both = flat[0].select("element")
    for f in flat[1:]:
        both = both.union(f.select("element"))
    often = both.groupBy("element").agg(F.count("*").alias("often")).where("often > 1")
    return [f.join(often, "element").select("id", "n", "element", "often") for f in flat]


def prefix(shared: DataFrame, threshold: float) -> DataFrame:
    """Rows id, n, element, rank: of each set's elements the rarest that a join at the threshold needs, the rarest first."""
    own = Window.partitionBy("id")
    ranked = shared.withColumn("rank", F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "element")))
    return ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("id", "n", "element", "rank")


def met(left: DataFrame, right: DataFrame | None, threshold: float, *keys: str) -> DataFrame:
    """Pairs (a, b) of prefixes that share the keys, and with sizes and ranks that the threshold allows; of one table, a < b.

    At the rarest element that two sets share, all they share stands at that rank or behind
    it in both, so what is left behind it bounds the similarity.
    """
    x = left.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("rank").alias("ra"), *keys)
    y = (left if right is None else right).select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("rank").alias("rb"), *keys)
    least = F.lit(threshold / (1 + threshold)) * (F.col("na") + F.col("nb")) - 1e-6
    near = (F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb") - 1e-9) & (1 + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= least)
    pairs = x.join(y, list(keys)).where(near)
    return (pairs.where("a < b") if right is None else pairs).select("a", "b").distinct()


def compared(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Adds sim, the exact similarity, to pairs (a, b) of sets (id, members)."""
    both = pairs.join(left.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(right.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    return both.select(*pairs.columns, T.jaccard(F.col("ma"), F.col("mb")).alias("sim"))


def self_similar(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, sim), a < b, of the sets (id, members) at or above the threshold; empty sets have none."""
    (shared,) = shared_elements(sets)
    return compared(met(prefix(shared, threshold), None, threshold, "element"), sets, sets).where(F.col("sim") >= threshold)


def kb_overlaps(incoming: DataFrame, kb: DataFrame) -> DataFrame:
    """Shared elements of each incoming set and each entry's: id, kb_id, overlap. Sets in ``members``."""
    x = incoming.select("id", F.explode("members").alias("element"))
    y = kb.select("kb_id", F.explode("members").alias("element"))
    return x.join(y, "element").groupBy("id", "kb_id").agg(F.count("*").alias("overlap"))


def kb_similar(incoming: DataFrame, kb: DataFrame) -> DataFrame:
    """Overlapping pairs with their similarity; ``incoming`` and ``kb`` hold each id once."""
    sizes = kb.select("kb_id", F.size("members").alias("nb"))
    return (
        kb_overlaps(incoming, kb)
        .join(incoming.select("id", F.size("members").alias("na")), "id")
        .join(sizes, "kb_id")
        .select("id", "kb_id", "overlap", (F.col("overlap") / (F.col("na") + F.col("nb") - F.col("overlap"))).alias("sim"))
    )


def kb_above(incoming: DataFrame, kb: DataFrame, threshold: float) -> DataFrame:
    """Pairs of a similarity of the threshold or more: id, kb_id, sim. Both hold id or kb_id, and members."""
    entries = kb.select(F.col("kb_id").alias("id"), "members")
    x, y = (prefix(s, threshold) for s in shared_elements(incoming.select("id", "members"), entries))
    return compared(met(x, y, threshold, "element"), incoming, entries).where(F.col("sim") >= threshold).select(F.col("a").alias("id"), F.col("b").alias("kb_id"), "sim")


def representatives(sets: DataFrame, id: str) -> DataFrame:
    """Rows id, set, members: each distinct set once, under its lowest id. ``sets`` has the id, set and members."""
    first = sets.groupBy("set").agg(F.min(id).alias(id))
    return sets.join(first, ["set", id]).dropDuplicates([id]).select(id, "set", "members")


def set_key(*columns: str) -> Column:
    """128 bits of hash for the values of the columns; null values count as absent ones do."""
    return F.concat(F.hex(F.xxhash64(F.lit(1), *columns)), F.lit("-"), F.hex(F.xxhash64(F.lit(2), *columns)))


def chosen(rows: DataFrame, id: str, ids: DataFrame, how: str) -> DataFrame:
    """The rows of the ids (how: left_semi), or of all others (left_anti); they move only where the ids, a written table, are many."""
    other = ids.select(F.col(ids.columns[0]).alias("_chosen"))
    return rows.join(F.broadcast(other) if ids.count() <= SENT else other, F.col(id).eqNullSafe(F.col("_chosen")), how)


def once(rows: DataFrame, id: str) -> DataFrame:
    """A row of each id; only the rows of repeated ids move."""
    repeated = Workspace(rows.sparkSession, "once").put(rows.groupBy(id).agg(F.count("*").alias("n")).where("n > 1").select(id), "repeated")
    return chosen(rows, id, repeated, "left_anti").unionByName(chosen(rows, id, repeated, "left_semi").dropDuplicates([id]))


def chapter_sets(chapters: DataFrame) -> DataFrame:
    """Each chapter once: chapter_id, source, words (title), members (content), and the keys title and content."""
    c = spread(once(chapters.select("chapter_id", "title", "content", "source_file"), "chapter_id"))
    sets = c.select(
        "chapter_id", F.coalesce("source_file", F.lit("")).alias("source"),
        F.array_sort(T.title_words(F.col("title"))).alias("words"), hashed(T.shingles(F.col("content"), stopwords=T.STOPWORDS)).alias("members"),
    )
    return sets.withColumn("title", set_key("words")).withColumn("content", set_key("members"))


def _class_key() -> Column:
    """Chapters of the same title words and shingles; all without words of content are one class."""
    return F.when(F.size("members") > 0, F.concat("title", F.lit("|"), "content")).otherwise(F.lit("empty"))


def classes(sets: DataFrame) -> DataFrame:
    """Classes of equal chapters under their lowest chapter_id: id, words, members, n_members, low and high source."""
    keyed = sets.withColumn("class", _class_key())
    kept = keyed.groupBy("class").agg(F.min("chapter_id").alias("chapter_id"), F.count("*").alias("n_members"), F.min("source").alias("low"), F.max("source").alias("high"))
    return kept.drop("class").join(sets.select("chapter_id", "words", "members"), "chapter_id").withColumnRenamed("chapter_id", "id")


def class_membership(sets: DataFrame) -> DataFrame:
    """Rows chapter_id, class_id, title_id and content_id: the lowest chapter of the same class, title words and shingles."""
    keyed = sets.select("chapter_id", "title", "content", _class_key().alias("class"))
    for key in ("class", "title", "content"):
        # a class of a third of all rows is reduced to one row before the join, and its rows stay where they are if that is small
        keyed = keyed.join(keyed.groupBy(key).agg(F.min("chapter_id").alias(f"{key}_id")), key).drop(key)
    return keyed.select("chapter_id", "class_id", "title_id", "content_id")


def _apart(x: str = "a", y: str = "b") -> Column:
    """The classes aren't all from one source."""
    return ~((F.col(f"low_{x}") == F.col(f"high_{x}")) & (F.col(f"low_{y}") == F.col(f"high_{y}")) & (F.col(f"low_{x}") == F.col(f"low_{y}")))


def _sides(table: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    return tuple(table.select(F.col("id").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in columns)) for s in "ab")


def _joined(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """Pairs (a, b) with the table's columns for either."""
    for s in "ab":
        pairs = pairs.join(table.withColumnsRenamed({c: s if c == "id" else f"{c}_{s}" for c in table.columns}), s)
    return pairs


def strict_pairs(known: DataFrame, ws: Workspace) -> DataFrame:
    """Content alone, or a similar title with less content, or the same title with little, between classes.

    Classes that are all from one source have no pair. Chapters without words of content have
    equal contents: they are one class, and so linked across sources by their membership.
    Pairs that need a title meet by an element of both sets at once, so that neither passages
    of boilerplate nor common titles bring pairs together by themselves; chapters without a
    title count as of one title.
    """
    some = known.where(F.size("members") > 0)
    shared = ws.put(shared_elements(some.select("id", "members"))[0], "shared")
    by_content = met(prefix(shared, 0.40), None, 0.40, "element")
    titled = some.where(F.size("words") > 0).select("id", hashed(F.col("words")).alias("members"))
    words = prefix(shared_elements(titled)[0], 0.80).select("id", F.col("element").alias("word")).union(some.where(F.size("words") == 0).select("id", F.lit(0).cast("long").alias("word")))
    keyed = prefix(shared, 0.10).join(words, "id")
    pairs = by_content.union(met(keyed, None, 0.10, "element", "word")).distinct()
    few = shared.groupBy("id").agg(F.collect_list("element").alias("few"))
    # classes without shared elements meet nobody
    side = _sides(some.join(few, "id").withColumn("n", F.size("members")), "words", "few", "n", "low", "high")
    both = F.size(F.array_intersect("few_a", "few_b"))
    scored = pairs.join(side[0], "a").join(side[1], "b").where(_apart()).select(
        "a", "b", T.jaccard(F.col("words_a"), F.col("words_b")).alias("title_sim"), (both / (F.col("n_a") + F.col("n_b") - both)).alias("content_sim")
    )
    c, t = F.col("content_sim"), F.col("title_sim")
    return scored.where((c >= 0.40) | ((t >= 0.80) & (c >= 0.15)) | ((t >= 0.99) & (c >= 0.10)))


def loose_pairs(sets: DataFrame, ws: Workspace, title: float = 0.5, content: float = 0.3) -> DataFrame:
    """Similar titles or similar contents of different sources: kind, a, b, sim.

    Rows of kind title are pairs of different title_id, those of kind content of different
    content_id (see class_membership). A row stands for all pairs of their members of
    different sources, and so does each title and each content that several sources have.
    Pairs whose members are all from one source are left out. So the rows grow with the
    texts that are similar without being equal, not with the chapters that share a title.
    The rows read tables that are written down here, no longer the written ``sets``.
    """

    def similar(kind: str, column: Column, threshold: float, short: bool) -> DataFrame:
        # each distinct set stands under its lowest chapter; where most sets are distinct, the others are the fewer to name
        kept = ws.put(sets.groupBy(kind).agg(F.min("chapter_id").alias("id"), F.min("source").alias("low"), F.max("source").alias("high")).where("id is not null").drop(kind), f"{kind}_kept")
        rows = sets.select(F.col("chapter_id").alias("id"), column.alias("members"))
        if 2 * kept.count() > sets.count():
            rows = chosen(rows, "id", ws.put(sets.select(F.col("chapter_id").alias("id")).join(kept, "id", "left_anti"), f"{kind}_others"), "left_anti")
        else:
            rows = chosen(rows, "id", kept, "left_semi")
        shared = ws.put(B.shared_sets(rows.where(F.size("members") > 0), threshold), f"{kind}_shared")
        if short:
            pairs = B.met_together(shared, threshold).union(met(B.prefixes(shared.where(F.col("n") > B.MOST), threshold), None, threshold, "element")).distinct()
        else:
            pairs = met(B.prefixes(shared, threshold), None, threshold, "element")
        own = kept.select("id", F.when(F.col("low") == F.col("high"), F.col("low")).alias("own"))
        # sets of a few words come along with their sources, larger ones only for pairs of different sources
        apart = F.coalesce(F.col("own_a") != F.col("own_b"), F.lit(True))
        if short:
            pairs = _joined(pairs, ws.put(shared.join(own, "id"), f"{kind}_sides")).where(apart)
        else:
            pairs = _joined(_joined(pairs, own).where(apart), shared)
        both = F.size(F.array_intersect("few_a", "few_b"))
        return pairs.select(F.lit(kind).alias("kind"), "a", "b", (both / (F.col("n_a") + F.col("n_b") - both)).alias("sim")).where(F.col("sim") >= threshold)

    return similar("title", hashed(F.col("words")), title, True).unionByName(similar("content", F.col("members"), content, False))
