"""Deduplicating new batches against all history by multi-key sorted neighbourhoods.

Every record has KEYS sort keys. A key is made of three minima of the record's set of
five-word runs under hash functions of its own, the first in the highest bits, so that in
the order of a key records with the same first minimum stand together, those that share
the second too next to each other. The orders of all accepted records are kept on disk as
runs, each cut into the same ranges of the order; a new batch reads only the ranges that
its own keys fall into, merges with the stretches around them, and compares each new record
with its WINDOW neighbours on both sides. Where more records than a window holds agree in
the first two minima, the new ones are compared with the oldest of them, and those that
may still find an older match with all the others that came before: the window widens to
the whole stretch, and nothing is cut off. Runs are merged into one when there are many,
and the merged ones deleted.

A pair of similarity s meets in a window unless all KEYS first minima differ, (1 - s) **
KEYS, which is 2e-5 at one half; in crowded stretches the second minimum has to agree too,
(1 - s * s) ** KEYS, 1 % at one half and 2e-5 at 0.7, unless a window helps. Pairs that
meet are told apart by sketches of SKETCH bits, which lose 5e-4 of the pairs of one half,
and compared exactly by their sets.

Records with equal sets form a class, for which its oldest record stands in the orders; so
a class that holds a third of all rows costs no more than a single record. A class keeps
the oldest record that it repeats, so that later copies of it are answered by lookup.

The folder holds ``manifest`` (the runs that count), ``keys/run=/range=`` and
``sets/run=/slot=``. A batch counts once the manifest names its run, so a job that dies
leaves the history as it was, and a new one opens the same folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.llm.tables import filled
from textloom.llm.words import distinct_sets, hash_words, mix, runs
from textloom.session import Workspace

KEYS = 16
MINIMA = 3
SKETCH = 128
#: So many bits of the sketches must agree; unlike texts agree in a half.
AGREE = 80
WINDOW = 4
SIMILARITY = 0.5
MAX_RUNS = 6
#: Ranges of the orders and slots of the sets; more of them let a small batch read less of a large history.
RANGES, SLOTS = 8, 8
TAGS = r"<[/!]?[A-Za-z\-][^<>]*>"

_FACTORS = mix(np.arange(1, SKETCH + 1, dtype=np.uint64)) | np.uint64(1)
_FEATURES = "age long, h1 long, h2 long, size int, keys array<long>, b0 long, b1 long, members array<long>"


def features(records: DataFrame) -> DataFrame:
    """Columns age, h1 and h2 (hashes of the whole set), size, keys, b0 and b1 (a sketch) and members (the set's hashes, ascending).

    ``records`` has age and body; records without a five-word run have no row, repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = distinct_sets(*runs(*hash_words(batch.column("body"))))
            sizes = np.diff(offsets)
            some = np.flatnonzero(sizes)
            n = len(some)
            begins = offsets[:-1][some]
            keys = np.zeros((n, KEYS), np.uint64)
            bits = np.zeros((n, 2), np.uint64)
            h1 = h2 = np.zeros(0, np.uint64)
            if n:
                with np.errstate(over="ignore"):
                    h1 = np.add.reduceat(mix(values), begins)
                    h2 = np.add.reduceat(mix(values ^ _FACTORS[0]), begins)
                    for f in range(SKETCH):
                        least = mix(np.minimum.reduceat(values * _FACTORS[f], begins) ^ _FACTORS[f])
                        bits[:, f // 64] |= (least & np.uint64(1)) << np.uint64(f % 64)
                        key, place = divmod(f, MINIMA)
                        if key < KEYS:  # 22, 21 and 21 bits, the first the highest
                            keys[:, key] |= (least >> np.uint64(42) << np.uint64(42)) if not place else least >> np.uint64(43) << np.uint64(21 * (MINIMA - 1 - place))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("age").take(pa.array(some)),
                    pa.array(h1.view(np.int64)),
                    pa.array(h2.view(np.int64)),
                    pa.array(sizes[some], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * KEYS, pa.int32()), pa.array(keys.view(np.int64).ravel())),
                    pa.array(bits[:, 0].view(np.int64)),
                    pa.array(bits[:, 1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.append(begins, len(values)), pa.int32()), pa.array(values.view(np.int64))),
                ],
                names=["age", "h1", "h2", "size", "keys", "b0", "b1", "members"],
            )

    body = F.regexp_replace("body", TAGS, " ")
    return records.where(filled("body") & F.col("age").isNotNull()).select("age", body.alias("body")).mapInArrow(run, _FEATURES)


def _alike(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1)) <= SKETCH - AGREE


class History:
    """Everything accepted so far, in a folder that driver and executors share; an existing one is opened."""

    KEY_ROWS = "no int, key long, age long, slot int, b0 long, b1 long, run int, range int"
    SET_ROWS = "age long, h1 long, h2 long, size int, members array<long>, match long, run int, slot int"

    def __init__(self, spark: SparkSession, folder: str | None = None, ranges: int = RANGES, slots: int = SLOTS):
        self.spark = spark
        self.ws = Workspace(spark, "history")
        self.root = folder.rstrip("/") if folder else f"{self.ws.root}/state"
        self.state = {"runs": [], "next": 1, "ranges": ranges, "slots": slots}
        path = self._path("manifest")
        fs = self._fs()
        if fs.exists(path):
            stream = fs.open(path)
            try:
                self.state = json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):  # noqa: ANN202
        return self._path("").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, live: list[int]) -> None:
        """Makes the runs the ones that count; what was written for others is deleted afterwards."""
        dead = [r for r in self.state["runs"] if r not in live]
        self.state = {**self.state, "runs": live, "next": self.state["next"] + 1}
        fs, new = self._fs(), self._path("manifest.new")
        out = fs.create(new, True)
        try:
            out.write(bytearray(json.dumps(self.state).encode()))
        finally:
            out.close()
        fs.delete(self._path("manifest"), False)
        fs.rename(new, self._path("manifest"))
        for r in dead:
            for kind in ("keys", "sets"):
                fs.delete(self._path(f"{kind}/run={r}"), True)

    def _table(self, kind: str, schema: str, parts: list[int] | None = None) -> DataFrame:
        live = self.state["runs"]
        if not live:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.root}/{kind}").where(F.col("run").isin(live))
        column, n = ("range", self.state["ranges"]) if kind == "keys" else ("slot", self.state["slots"])
        return df if parts is None or len(parts) == n else df.where(F.col(column).isin(parts))

    def _write(self, kind: str, df: DataFrame, n: int) -> DataFrame:
        """Rows of a run, each once, a file a range, in order within it."""
        column, order, schema = ("range", ("no", "key", "age"), self.KEY_ROWS) if kind == "keys" else ("slot", ("age",), self.SET_ROWS)
        path = f"{self.root}/{kind}/run={n}"
        df.drop("run").repartition(self.state[f"{column}s"], column).dropDuplicates([column, *order]).sortWithinPartitions(column, *order).write.mode("overwrite").partitionBy(column).parquet(path)
        return self.spark.read.schema(schema.replace(" run int,", "")).parquet(path)

    def _slot(self) -> Column:
        return F.pmod(F.col("h1"), F.lit(self.state["slots"])).cast("int")

    def _range(self, no: Column, key: Column) -> Column:
        """The place of (no, key) in all orders one after the other, in equal ranges; keys are uniform."""
        return F.floor((no * (1 << 20) + F.shiftrightunsigned(key, 44)) * self.state["ranges"] / (KEYS * (1 << 20))).cast("int")

    def compact(self) -> None:
        """Merges the runs into one and deletes them."""
        n = self.state["next"]
        if len(self.state["runs"]) > 1:
            self._write("keys", self._table("keys", self.KEY_ROWS), n)
            self._write("sets", self._table("sets", self.SET_ROWS), n)
            self._commit([n])

    def add(self, records: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
        """Takes in records (age, body) and returns age and match: the oldest record that each repeats.

        The lower age came first; ages of later batches may not be below those before. Rows
        repeated with the same age count once; extra columns don't count. Null, empty and blank
        bodies, null ages and bodies of under five words are no records. Records that repeat nothing have no row.
        """
        n, ws = self.state["next"], self.ws
        new = ws.put(features(records), f"features-{n}")
        key = ["h1", "h2", "size"]
        # at most as many as there are ranges and slots
        ranges = F.explode(F.transform("keys", lambda k, no: self._range(no, k)))
        touched = new.select(self._slot().alias("slot"), ranges.alias("range")).agg(F.collect_set("slot").alias("slots"), F.collect_set("range").alias("ranges")).first()
        first = new.groupBy(*key).agg(F.min("age").alias("age"))
        heads = self._table("sets", self.SET_ROWS, touched["slots"] or [0]).select(*key, F.col("age").alias("earlier"), F.col("match").alias("known"))
        classes = ws.put(first.join(heads, key, "left").select(*key, F.coalesce("earlier", "age").alias("rep"), F.col("earlier").isNull().alias("fresh"), "known"), f"classes-{n}")
        reps = new.join(classes.where("fresh").select(F.col("rep").alias("age")), "age", "left_semi")
        rows = reps.select("age", self._slot().alias("slot"), "b0", "b1", F.posexplode("keys").alias("no", "key"))
        own = self._write("keys", rows.withColumn("range", self._range(F.col("no"), F.col("key"))), n)
        best = self._neighbours(own, new, touched["ranges"], similarity)
        self._write("sets", reps.join(best, "age", "left").select("age", *key, "members", "match", self._slot().alias("slot")), n)
        self._commit([*self.state["runs"], n])
        if len(self.state["runs"]) > MAX_RUNS:
            self.compact()
        found = (
            new.select("age", *key).distinct().join(classes, key).join(best.select(F.col("age").alias("rep"), "match"), "rep", "left")
            .select("age", F.coalesce("match", "known", F.when(F.col("rep") != F.col("age"), F.col("rep"))).alias("match")).where("match is not null")
        )
        found = ws.put(found, f"found-{n}")
        for name in ("features", "classes", "pairs", "best", "crowded", "later", "rest"):
            ws.drop(f"{name}-{n}")
        return found

    def _neighbours(self, own: DataFrame, new: DataFrame, ranges: list[int], similarity: float) -> DataFrame:
        """Rows age, match: for each new class the oldest similar one of those in the windows around its keys."""
        n, ws = self.state["next"], self.ws
        columns = ["no", "key", "age", "slot", "b0", "b1"]
        block, prefix = F.shiftrightunsigned("key", 42).alias("block"), F.shiftrightunsigned("key", 21).alias("prefix")
        near = own.select(*columns, block, F.lit(True).alias("fresh"))
        if self.state["runs"]:
            old = self._table("keys", self.KEY_ROWS, ranges).select(*columns, block).join(own.select("no", block).distinct(), ["no", "block"], "left_semi")
            near = near.unionByName(old.withColumn("fresh", F.lit(False)))
        order = Window.partitionBy("no", "block").orderBy("key", "age")
        before = F.array_compact(F.array(*(F.lag(F.struct("age", "slot", "b0", "b1", "fresh"), k).over(order) for k in range(1, WINDOW + 1))))
        # more rows that agree in two minima than a window holds
        deep = F.coalesce(F.shiftrightunsigned(F.lag("key", WINDOW + 1).over(order), 21) == F.shiftrightunsigned("key", 21), F.lit(False))
        around = near.withColumns({"before": before, "deep": deep}).where(F.size("before") > 0).select("age", "slot", "b0", "b1", "fresh", F.posexplode("before").alias("k", "o"), "no", prefix, "deep")
        alike = (F.col("fresh") | F.col("o.fresh")) & _alike(F.col("b0"), F.col("b1"), F.col("o.b0"), F.col("o.b1"))
        met = around.withColumn("crowded", F.col("deep") & (F.col("k") == 0)).withColumn("alike", F.coalesce(alike, F.lit(False))).where("alike or crowded")
        later = F.col("age") > F.col("o.age")
        met = ws.put(
            met.select(F.greatest("age", "o.age").alias("age"), F.least("age", "o.age").alias("older"), F.when(later, F.col("o.slot")).otherwise(F.col("slot")).alias("slot"), "alike", "crowded", "no", "prefix"),
            f"pairs-{n}",
        )
        slots, full = met.agg(F.collect_set(F.when(F.col("alike"), F.col("slot"))), F.max("crowded")).first()
        best = self._similar(met.where("alike").select("age", "older", "slot").distinct(), new, slots, similarity)
        if not full:
            return ws.put(best, f"best-{n}")
        best = ws.put(best, f"later-{n}")
        stretch = near.select(*columns, "fresh", prefix).join(met.where("crowded").select("no", "prefix").distinct(), ["no", "prefix"], "left_semi")
        stretch = ws.put(stretch, f"crowded-{n}")
        heads = stretch.groupBy("no", "prefix").agg(F.min(F.struct("age", "slot", "b0", "b1")).alias("head"))
        fresh = stretch.where("fresh").join(heads, ["no", "prefix"]).where("age > head.age")
        first = fresh.where(_alike(F.col("b0"), F.col("b1"), F.col("head.b0"), F.col("head.b1"))).select("age", F.col("head.age").alias("older"), F.col("head.slot").alias("slot"))
        every = list(range(self.state["slots"]))
        best = ws.put(best.unionByName(self._similar(first.distinct(), new, every, similarity)).groupBy("age").agg(F.min("match").alias("match")), f"heads-{n}")
        known = fresh.join(best, "age", "left").where("match is null or match > head.age").select("no", "prefix", "age", "b0", "b1", F.coalesce("match", "age").alias("bound"))
        others = stretch.select("no", "prefix", F.col("age").alias("older"), "slot", F.col("b0").alias("o0"), F.col("b1").alias("o1"))
        rest = known.join(others, ["no", "prefix"]).where("older < bound").where(_alike(F.col("b0"), F.col("b1"), F.col("o0"), F.col("o1"))).select("age", "older", "slot")
        more = self._similar(ws.put(rest.distinct(), f"rest-{n}"), new, every, similarity)
        best = ws.put(best.unionByName(more).groupBy("age").agg(F.min("match").alias("match")), f"best-{n}")
        ws.drop(f"heads-{n}")
        return best

    def _similar(self, pairs: DataFrame, new: DataFrame, slots: list[int], similarity: float) -> DataFrame:
        """The oldest of each record's partners that is similar by the sets themselves."""
        here = new.select("age", "size", "members")
        there = here
        if self.state["runs"]:
            there = there.unionByName(self._table("sets", self.SET_ROWS, slots).select("age", "size", "members"))
        # only the sets that pairs name are moved
        there = there.select(F.col("age").alias("older"), F.col("size").alias("nb"), F.col("members").alias("mb")).join(pairs.select("older").distinct(), "older", "left_semi")
        both = pairs.join(here.select("age", F.col("size").alias("na"), F.col("members").alias("ma")), "age").join(there, "older")
        common = F.size(F.array_intersect("ma", "mb"))
        return (
            both.where(F.least("na", "nb") >= F.lit(similarity) * F.greatest("na", "nb")).select("age", "older", common.alias("common"), (F.col("na") + F.col("nb")).alias("n"))
            .where(F.col("common") >= F.lit(similarity) * (F.col("n") - F.col("common"))).groupBy("age").agg(F.min("older").alias("match"))
        )


#: Added to the ids of incoming files, which come after all entries of the knowledge base.
LATER = 1 << 61


#: Batches in a row are taken in together until they have so many files; the result is the same, but a batch has a dozen jobs.
TOGETHER = 40_000


def batches_in_order(incoming: DataFrame, together: int = TOGETHER) -> list[tuple[int, int]]:
    """Lowest and highest file_id of each step, in order; batches whose files lie among each other are one."""
    spans = incoming.where("file_id is not null").groupBy("batch_no").agg(F.min("file_id").alias("a"), F.max("file_id").alias("b"), F.count("*").alias("n")).orderBy("a").collect()  # a row a batch
    out: list[tuple[int, int, int]] = []
    for s in spans:
        if out and (s["a"] <= out[-1][1] or out[-1][2] < together):
            out[-1] = (out[-1][0], max(out[-1][1], s["b"]), out[-1][2] + s["n"])
        else:
            out.append((s["a"], s["b"], s["n"]))
    return [(a, b) for a, b, _ in out]


def repeated_files(kb: DataFrame, incoming: DataFrame, history: History | None = None, together: int = TOGETHER) -> DataFrame:
    """Columns file_id, match_origin, match_id: for each file that is not new the oldest record it repeats.

    The entries come first, then batch after batch of the files. ``history`` may hold both already.
    """
    spark = kb.sparkSession
    history = history or History(spark)
    history.add(kb.select(F.col("kb_id").alias("age"), "body"))
    found = spark.createDataFrame([], "age long, match long")
    for a, b in batches_in_order(incoming, together):
        batch = incoming.where(F.col("file_id").between(a, b))
        found = found.unionByName(history.add(batch.select((F.col("file_id") + F.lit(LATER)).alias("age"), "body")))
    ours = F.col("match") >= LATER
    return found.select(
        (F.col("age") - F.lit(LATER)).alias("file_id"),
        F.when(ours, "incoming_files").otherwise("kb_entries").alias("match_origin"),
        F.when(ours, F.col("match") - F.lit(LATER)).otherwise(F.col("match")).alias("match_id"),
    )
