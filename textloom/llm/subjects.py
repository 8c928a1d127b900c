"""Subject areas of documents by classifier chains.

Terms come first: words that the labelled samples have almost only under one subject give
a first guess of each document's subjects, and counts over all documents then tell which
words keep to documents of one subject: these become the term features, and words that
only chance put into one subject's samples drop out. A sentence deals with a subject if
it has one of its terms.

Structure and source come second: a document is described, per subject, by the share of
its text in such sentences, their number, the share between the first and the last of
them, the number of its terms, the document's length, and the log odds of the subject
among the documents of its source, by the first guess over all texts. A chain of logistic classifiers, one per subject, sees these and the labels before it in the
chain, so that subjects that occur together, or rule each other out, are modelled. The
chains are trained on documents composed of the samples' sentences, whose shares are known
and whose sources are drawn as likely as such documents come from them,
calibrated on others that were held out, and decoded with a beam of label combinations.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.tables import filled
from textloom.session import Workspace

#: Bound of the labelled rows that the classifier is fitted on, by hash of the text beyond it.
MAX_SAMPLES = 20_000
#: So many terms are sent to the tasks; more are joined to the documents' words instead.
SENT_TERMS = 50_000
#: A term occurs at least so often, and so purely, under its subject: in the samples, in the documents.
SAMPLE_COUNT, SAMPLE_PURITY, CORPUS_COUNT, CORPUS_PURITY = 2, 0.9, 3, 0.6
#: First guess: so much of the text, and so many sentences.
GUESS_SHARE, GUESS_SENTENCES = 0.3, 2
COMPOSED = 6000
#: So many sources' odds are sent to the tasks (more are joined), and the largest so many are drawn from in training.
SENT_SOURCES, DRAWN_SOURCES = 50_000, 1_000
#: Documents that a source is given beside its own, as the whole corpus has them.
SOURCE_PRIOR = 20.0
BEAM = 4
QUARTER = 0.25
FRONT = r"^---[ \t]*\n(?s:.*?)\n---[ \t]*(?:\n|$)"
_END = ".!?…"


class Tokens:
    """Words of a batch with their sentences; one pass over the text, all else by distinct word."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern_regex(pc.utf8_lower(texts.cast(pa.large_string())), rf"[^\p{{L}}\p{{N}}{_END}]+")
        flat = lists.flatten().dictionary_encode()
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        raw = flat.dictionary.to_pylist()
        codes = flat.indices.to_numpy(zero_copy_only=False)
        bare = [w.strip(_END) for w in raw]
        self.words = sorted(set(bare))
        at = {w: i for i, w in enumerate(self.words)}
        self.code = np.array([at[w] for w in bare], np.int64)[codes] if len(raw) else np.zeros(0, np.int64)
        ends = np.array([w.endswith(tuple(_END)) for w in raw], bool)[codes] if len(raw) else np.zeros(0, bool)
        sizes = np.array([len(w) + 1 if w else 0 for w in bare], np.int64)[codes] if len(raw) else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(lists)), np.diff(offsets - offsets[0]))
        self.docs = len(lists)
        # a sentence begins with a document and behind a sentence's end
        begins = np.ones(len(self.code), bool)
        if len(begins) > 1:
            begins[1:] = ends[:-1] | (self.doc[1:] != self.doc[:-1])
        sentence = np.cumsum(begins) - 1
        n = int(sentence[-1]) + 1 if len(sentence) else 0
        size = np.bincount(sentence, weights=sizes, minlength=n)
        some = size > 0
        number = np.cumsum(some) - 1
        self.sentence = np.where(some[sentence], number[sentence], -1) if n else sentence
        self.size = size[some]
        self.of = self.doc[begins][some] if n else np.zeros(0, np.int64)

    def evidence(self, terms: dict[str, int], subjects: int) -> np.ndarray:
        """Sentences by subjects: how many terms of the subject the sentence has."""
        by = np.array([terms.get(w, -1) for w in self.words], np.int64)
        n = len(self.size)
        if not len(self.code):
            return np.zeros((n, subjects), np.int64)
        hit = by[self.code]
        ok = (hit >= 0) & (self.sentence >= 0)
        return np.bincount(self.sentence[ok] * subjects + hit[ok], minlength=n * subjects).reshape(n, subjects)

    def describe(self, evidence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return describe(evidence, self.size, self.of, self.docs)


def describe(evidence: np.ndarray, size: np.ndarray, of: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Features by document and subject (share, sentences, extent, terms), and the number of sentences."""
    total = np.maximum(np.bincount(of, weights=size, minlength=docs), 1e-9)
    count = np.bincount(of, minlength=docs)
    k = evidence.shape[1]
    ends = np.cumsum(size)
    first_of = np.searchsorted(of, np.arange(docs))
    base = np.concatenate([[0.0], ends])[first_of] if len(size) else np.zeros(docs)
    out = np.zeros((docs, k, 4))
    for j in range(k):
        on = np.flatnonzero(evidence[:, j])
        if not len(on):
            continue
        out[:, j, 0] = np.bincount(of[on], weights=size[on], minlength=docs) / total
        out[:, j, 1] = np.bincount(of[on], minlength=docs)
        out[:, j, 3] = np.bincount(of[on], weights=evidence[on, j], minlength=docs)
        first = np.full(docs, np.inf)
        last = np.full(docs, -np.inf)
        np.minimum.at(first, of[on], ends[on] - size[on])
        np.maximum.at(last, of[on], ends[on])
        has = out[:, j, 1] > 0
        out[has, j, 2] = (last[has] - first[has]) / total[has]
    return out, count


def sample_terms(samples: list[tuple[str, str]]) -> tuple[list[str], dict[str, int]]:
    """The subjects, sorted, and the words that the samples have under one of them."""
    subjects = sorted({s for s, _ in samples})
    counts: dict[str, Counter] = defaultdict(Counter)
    for s, text in samples:
        for w in re.findall(r"[^\W_]+", text.lower()):
            counts[w][s] += 1
    terms = {}
    for w, c in counts.items():
        s, n = max(c.items(), key=lambda x: (x[1], x[0]))
        if n >= SAMPLE_COUNT and n >= SAMPLE_PURITY * sum(c.values()):
            terms[w] = subjects.index(s)
    return subjects, terms


def distinct_texts(documents: DataFrame) -> DataFrame:
    """Columns key and text, each text once; copies are reduced before they are shuffled."""
    return documents.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"))


def corpus_counts(documents: DataFrame, subjects: list[str], first: dict[str, int]) -> DataFrame:
    """Rows kind, word, label, n over all distinct texts: how many guessed to be of the label have the word (kind 0), or come from the source (kind 1).

    The label beyond the subjects is that of texts of none; texts of several give no words, but count for their source once each.
    """
    k = len(subjects)
    sent = documents.sparkSession.sparkContext.broadcast(first)
    source = F.min("source") if "source" in documents.columns else F.lit(None).cast("string")
    texts = documents.groupBy(F.md5("text").alias("key")).agg(F.first("text").alias("text"), source.alias("source")).select("text", "source")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Tokens(batch.column("text"))
            features, _ = t.describe(t.evidence(sent.value, k))
            guess = (features[:, :, 0] >= GUESS_SHARE) & (features[:, :, 1] >= GUESS_SENTENCES)
            n = guess.sum(axis=1)
            label = np.where(n == 1, guess.argmax(axis=1), np.where(n == 0, k, -1))
            pair = np.unique(t.code * np.int64(t.docs) + t.doc)  # each word once a document
            word, doc = pair // max(1, t.docs), pair % max(1, t.docs)
            ok = label[doc] >= 0
            cell, count = np.unique(word[ok] * (k + 1) + label[doc[ok]], return_counts=True)
            words = pa.array(t.words, pa.string()).take(pa.array(cell // (k + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(cell), np.int32)), words, pa.array((cell % (k + 1)).astype(np.int32)), pa.array(count.astype(np.int64))], names=["kind", "word", "label", "n"])
            sources = batch.column("source").dictionary_encode()
            code = sources.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            d, j = np.nonzero(np.column_stack([guess, np.ones(len(guess), bool)]) & (code >= 0)[:, None])
            cell, count = np.unique(code[d].astype(np.int64) * (k + 1) + j, return_counts=True)  # under the last label all its texts
            names = sources.dictionary.cast(pa.string()).take(pa.array(cell // (k + 1)))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(cell), np.int32)), names, pa.array((cell % (k + 1)).astype(np.int32)), pa.array(count.astype(np.int64))], names=["kind", "word", "label", "n"])

    rows = texts.mapInArrow(run, "kind int, word string, label int, n long").where((F.col("kind") == 1) | (~F.col("word").rlike(r"\p{N}") & (F.length("word") > 0)))
    return rows.groupBy("kind", "word", "label").agg(F.sum("n").alias("n"))


def term_labels(counts: DataFrame, k: int) -> DataFrame:
    """Rows word, label: words that keep to texts of one subject."""
    best = counts.where("kind = 0").groupBy("word").agg(F.sum("n").alias("all"), F.max(F.when(F.col("label") < k, F.struct("n", "label"))).alias("best"))
    return best.where((F.col("best.n") >= CORPUS_COUNT) & (F.col("best.n") >= CORPUS_PURITY * F.col("all"))).select("word", "best.label")


def corpus_terms(documents: DataFrame, subjects: list[str], first: dict[str, int]) -> DataFrame:
    """Rows word, label by counts over all distinct texts."""
    return term_labels(corpus_counts(documents, subjects, first), len(subjects))


def source_odds(counts: DataFrame, k: int) -> DataFrame:
    """Rows source, n, shares and odds by subject: the share of the source's texts that deal with it, and its log odds against the whole corpus."""
    s = counts.where("kind = 1")
    by = s.groupBy(F.col("word").alias("source")).agg(*(F.sum(F.when(F.col("label") == j, F.col("n")).otherwise(0)).alias(f"c{j}") for j in range(k + 1)))
    whole = by.agg(*(F.sum(f"c{j}").alias(f"w{j}") for j in range(k + 1)))  # one row
    base = [(F.col(f"w{j}") + 1) / (F.col(f"w{k}") + 2) for j in range(k)]
    share = [(F.col(f"c{j}") + SOURCE_PRIOR * base[j]) / (F.col(f"c{k}") + SOURCE_PRIOR) for j in range(k)]
    logit = lambda p: F.log(p) - F.log1p(-p)
    return by.join(F.broadcast(whole)).select("source", F.col(f"c{k}").alias("n"), F.array(*share).alias("shares"), F.array(*(logit(p) - logit(b) for p, b in zip(share, base))).alias("odds"))


def with_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The rows of ``texts`` that have a term, with their terms as an array of word and label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = Tokens(batch.column("text"))
            pair = np.unique(t.code * np.int64(t.docs) + t.doc)
            word, doc = pair // max(1, t.docs), pair % max(1, t.docs)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(doc)), pa.array(t.words, pa.string()).take(pa.array(word))], names=["key", "word"])

    words = distinct_texts(texts).mapInArrow(run, "key string, word string")
    found = words.join(terms, "word").groupBy("key").agg(F.collect_list(F.struct("word", "label")).alias("terms"))
    return texts.withColumn("key", F.md5("text")).join(found, "key").drop("key")


class Chain:
    """Logistic classifiers in a row; each sees its subject's features and the labels before it."""

    def __init__(self, subjects: int):
        self.k = subjects
        self.weights = np.zeros((subjects, 0))
        self.scale = np.ones(subjects)
        self.shift = np.zeros(subjects)

    @staticmethod
    def inputs(features: np.ndarray, count: np.ndarray, labels: np.ndarray, j: int) -> np.ndarray:
        """Columns for link j, given the labels of the links before it (documents by j)."""
        own = features[:, j]
        before = labels[:, :j]
        shares = features[:, :j, 0] * before
        return np.column_stack([
            np.ones(len(own)),
            8 * own[:, 0],
            np.minimum(own[:, 1], 6) / 3,
            4 * own[:, 2],
            np.log1p(count),
            4 * own[:, 1] / np.maximum(count, 1),
            np.log1p(own[:, 3]),
            np.clip(own[:, 4], -4, 4),
            before.sum(axis=1),
            shares.sum(axis=1),
        ])

    def fit(self, features: np.ndarray, count: np.ndarray, labels: np.ndarray, held: np.ndarray) -> "Chain":
        """Newton steps on a ridge-penalised likelihood; scale and shift from the held-out rows."""
        weights = []
        for j in range(self.k):
            x, y = self.inputs(features, count, labels, j), labels[:, j].astype(float)
            w = np.zeros(x.shape[1])
            for _ in range(40):
                p = 1 / (1 + np.exp(-np.clip(x[~held] @ w, -30, 30)))
                g = x[~held].T @ (y[~held] - p) - 0.05 * w
                h = (x[~held] * (p * (1 - p))[:, None]).T @ x[~held] + 0.05 * np.eye(len(w))
                step = np.linalg.solve(h, g)
                w += np.clip(step, -4, 4)
                if np.abs(step).max() < 1e-6:
                    break
            weights.append(w)
            z = x[held] @ w
            a, b = 1.0, 0.0
            for _ in range(60):
                p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
                r = p - y[held]
                ga, gb = (r * z).sum() + 1.0 * (a - 1), r.sum() + 1.0 * b
                v = p * (1 - p)
                haa, hab, hbb = (v * z * z).sum() + 1.0, (v * z).sum(), v.sum() + 1.0
                det = haa * hbb - hab * hab
                da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
                a, b = a - np.clip(da, -0.5, 0.5), b - np.clip(db, -1, 1)
            self.scale[j], self.shift[j] = max(a, 1e-3), b
        self.weights = np.array(weights)
        return self

    def decode(self, features: np.ndarray, count: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The likeliest combination of labels that a beam search over the chain finds."""
        n = len(features)
        labels = np.zeros((n, 1, self.k), bool)
        score = np.zeros((n, 1))
        for j in range(self.k):
            width = labels.shape[1]
            x = self.inputs(np.repeat(features, width, axis=0), np.repeat(count, width), labels.reshape(n * width, self.k), j)
            z = np.clip(self.scale[j] * (x @ self.weights[j]) + self.shift[j], -30, 30).reshape(n, width)
            yes, no = score - np.log1p(np.exp(-z)), score - np.log1p(np.exp(z))
            both = np.concatenate([yes, no], axis=1)
            keep = np.argsort(-both, axis=1, kind="stable")[:, :beam]
            labels = np.take_along_axis(np.concatenate([labels, labels], axis=1), keep[:, :, None], axis=1)
            labels[:, :, j] = keep < width
            score = np.take_along_axis(both, keep, axis=1)
        return labels[:, 0, :]


def with_odds(features: np.ndarray, odds: np.ndarray | None) -> np.ndarray:
    """Adds the log odds of the documents' sources to their features; without sources they are nought."""
    return np.concatenate([features, (np.zeros(features.shape[:2]) if odds is None else odds)[:, :, None]], axis=2)


def draw_sources(labels: np.ndarray, sources: list[tuple[int, list[float], list[float]]], rng: np.random.Generator) -> np.ndarray | None:
    """Log odds of a source for each composed document, drawn as likely as a document of these labels comes from it."""
    if not sources:
        return None
    shares, odds = np.array([x[1] for x in sources]), np.array([x[2] for x in sources])
    weight = np.log([x[0] for x in sources])[None, :] + labels @ np.log(shares).T + ~labels @ np.log1p(-shares).T
    weight = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    return odds[(rng.random(len(labels))[:, None] * weight[:, -1:] > weight).sum(axis=1)]


def compose(samples: list[tuple[str, str]], subjects: list[str], terms: dict[str, int], n: int = COMPOSED, seed: int = 7, sources: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, sentence counts and labels of documents made of the samples' sentences.

    A document has no to three sections of one subject each, at least a quarter of the text,
    beside plain sentences, and in longer ones passing remarks of a sentence.
    """
    rng = np.random.default_rng(seed)
    k = len(subjects)
    t = Tokens(pa.array([text for _, text in samples], pa.string()))
    found = t.evidence(terms, k)
    own = np.array([subjects.index(s) for s, _ in samples])[t.of] if len(t.of) else np.zeros(0, int)
    on = [np.flatnonzero(own == j) for j in range(k)]
    sure = [np.flatnonzero((own == j) & (found[np.arange(len(own)), own] > 0)) for j in range(k)]
    plain = np.flatnonzero(~found.any(axis=1))
    if not len(plain):
        plain = np.arange(len(own))
    picks, of, labels = [], [], np.zeros((n, k), bool)
    for d in range(n):
        sections = int(rng.choice([0, 1, 2, 3], p=[0.2, 0.4, 0.3, 0.1]))
        length = int(rng.integers(max(2, 3 * sections), 22))
        chosen = rng.choice(k, sections, replace=False)
        shares = np.array([]) if not sections else QUARTER + 0.03 + rng.dirichlet(np.ones(sections + 1))[:sections] * max(0.0, 0.97 - sections * (QUARTER + 0.03))
        rows: list[int] = []
        for s, share in zip(chosen, shares):
            m = max(1, math.ceil(share * length))
            source = on[s] if m > 1 else sure[s]
            rows += list(rng.choice(source if len(source) else on[s], m))
            labels[d, s] = True
        rest = max(0, length - len(rows))
        rows += list(rng.choice(plain, rest))
        if length >= 7:
            for _ in range(int(rng.integers(0, 3)) if length >= 14 else int(rng.integers(0, 2))):
                s = int(rng.integers(k))
                if not labels[d, s] and rest:
                    rows[len(rows) - 1 - int(rng.integers(rest))] = int(rng.choice(sure[s] if len(sure[s]) else on[s]))
        picks += rows
        of += [d] * len(rows)
    picks, of = np.array(picks, int), np.array(of, int)
    features, count = describe(found[picks], t.size[picks], of, n)
    return with_odds(features, draw_sources(labels, sources or [], rng)), count, labels


def subject_areas(documents: DataFrame, samples: DataFrame, areas: DataFrame, most: int = SENT_TERMS, most_sources: int = SENT_SOURCES) -> DataFrame:
    """Rows doc_id, subject, each once: the subjects of each document, for many of them none.

    ``samples`` has subject and text; those whose subject isn't among ``areas`` count for
    nothing, as null and blank ones do. Null, empty and blank documents have no subject;
    without samples no document has. A null source, or none, says nothing. More than
    ``most`` terms, or ``most_sources`` sources, are joined, not sent.
    """
    spark = documents.sparkSession
    known = samples.where(filled("text")).join(areas.select("subject").distinct(), "subject", "left_semi").select("subject", "text").distinct()
    rows = sorted((r["subject"], r["text"]) for r in known.orderBy(F.xxhash64("text"), "subject").limit(MAX_SAMPLES).collect())
    if not rows:
        return spark.createDataFrame([], "doc_id long, subject string")
    texts = documents.where(filled("text") & F.col("doc_id").isNotNull()).select("doc_id", F.regexp_replace("text", FRONT, "").alias("text"), F.col("source") if "source" in documents.columns else F.lit(None).cast("string").alias("source"))
    subjects, first = sample_terms(rows)
    ws = Workspace(spark, "subjects")
    counts = ws.put(corpus_counts(texts, subjects, first), "counts")
    vocabulary = ws.put(term_labels(counts, len(subjects)), "terms")
    odds = ws.put(source_odds(counts, len(subjects)), "sources")
    drawn = [(r["n"], r["shares"], r["odds"]) for r in odds.orderBy(F.desc("n"), "source").limit(DRAWN_SOURCES).collect()]
    looked_up = odds.count() > most_sources
    if looked_up:
        texts = texts.join(odds.select("source", "odds"), "source", "left")
    by_source = {} if looked_up else {r["source"]: r["odds"] for r in odds.select("source", "odds").collect()}
    joined = vocabulary.count() > most
    if joined:  # the samples need the terms among their own words only
        own = spark.createDataFrame([(w,) for w in Tokens(pa.array([text for _, text in rows], pa.string())).words], "word string")
        texts = with_terms(texts, vocabulary)
    terms = {r["word"]: r["label"] for r in (vocabulary.join(own, "word") if joined else vocabulary).collect()}
    if not joined and not terms:  # terms that no document shows are as good as the samples make them
        terms = first
    features, count, labels = compose(rows, subjects, terms, sources=drawn)
    held = np.arange(len(labels)) % 3 == 0
    chain = Chain(len(subjects)).fit(features, count, labels, held)
    sent = spark.sparkContext.broadcast((subjects, {} if joined else terms, chain, by_source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subjects, terms, chain, by_source = sent.value
        nothing = [0.0] * len(subjects)
        for batch in batches:
            t = Tokens(batch.column("text"))
            if joined:
                flat = batch.column("terms").flatten()
                terms = dict(zip(flat.field("word").to_pylist(), flat.field("label").to_pylist()))
            features, count = t.describe(t.evidence(terms, len(subjects)))
            known = batch.column("odds").to_pylist() if looked_up else map(by_source.get, batch.column("source").to_pylist())
            features = with_odds(features, np.array([o or nothing for o in known], float).reshape(t.docs, len(subjects)))
            some = features[:, :, 0].any(axis=1)
            out = np.zeros((t.docs, len(subjects)), bool)
            if some.any():
                out[some] = chain.decode(features[some], count[some])
            out &= features[:, :, 0] > 0
            doc, subject = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(subjects, pa.string()).take(pa.array(subject))], names=["doc_id", "subject"])

    return texts.mapInArrow(run, "doc_id long, subject string").distinct()


def composition(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents and characters by subject and source; a document of two subjects counts for both."""
    sizes = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max("source").alias("source"), F.max(F.length("text")).alias("chars"))
    return found.join(sizes, "doc_id").groupBy("subject", "source").agg(F.count("*").alias("n_documents"), F.sum("chars").alias("n_chars"))
