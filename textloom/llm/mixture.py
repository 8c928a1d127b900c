"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The total is the largest at which every source with texts can have its share without using
a text more often than allowed. It is cut into blocks of equal tokens, which go to the
sources by the highest quotients share / (2 n + 1), and each source's blocks to its shards
in the same way by the shards' tokens. A shard uses all its texts as often as its blocks
last, and for what is left over takes texts in a seeded order.

A shard holds texts by a hash, about SHARD_TOKENS of their tokens whatever the source's size, so
a source with a third of all rows only has more shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.tables import filled
from textloom.session import Workspace

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BLOCK_TOKENS = 1024
SHARD_TOKENS = 200_000
SEED = 11


@lru_cache(maxsize=4)
def _encoding(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(texts: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Adds n_tokens to rows (doc_id, source, text) and a digest in the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path).encode_to_numpy
        for batch in batches:
            codes = batch.column("text").dictionary_encode()
            n = pa.array([len(encode(t, disallowed_special=())) for t in codes.dictionary.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), batch.column("digest"), n.take(codes.indices)], names=["doc_id", "source", "digest", "n_tokens"])

    return texts.select("doc_id", "source", F.md5("text").alias("digest"), "text").mapInArrow(run, "doc_id long, source string, digest string, n_tokens long")


def apportion(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by the highest quotients weight / (2 n + 1), none beyond its cap; ties go to the first.

    Fewer seats than asked for are given only where all caps are reached or weights are nought.
    """
    weights = np.asarray(weights, float)
    caps = np.full(len(weights), seats) if caps is None else np.minimum(np.asarray(caps), seats)
    caps = np.where(weights > 0, caps, 0).astype(np.int64)
    seats = int(min(seats, caps.sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)

    def given(level: float) -> np.ndarray:
        """Seats whose quotient is above the level."""
        return np.minimum(np.maximum(np.ceil((weights / level - 1) / 2), 0), caps).astype(np.int64)

    low, high = 1e-300, float(weights.max()) * 2
    while given(low).sum() < seats and low > 0:
        low /= 1e10
    for _ in range(2000):
        middle = (low * high) ** 0.5
        if middle <= low or middle >= high:
            break
        if given(middle).sum() > seats:
            low = middle
        else:
            high = middle
    got = given(high)
    while got.sum() < seats:  # the rest are ties at this level
        quotient = np.where(got < caps, weights / (2 * got + 1), -1.0)
        got[int(quotient.argmax())] += 1
    return got


class Plan:
    """Blocks by source: a row for each source that is listed, no more."""

    def __init__(self, sources: list[dict], have: dict[str, int], block: int):
        usable = [r for r in sources if have.get(r["source"], 0) > 0 and r["share"] > 0 and r["repeats"] > 0]
        total_share = sum(r["share"] for r in usable)
        self.total = int(min((r["repeats"] * have[r["source"]] * total_share / r["share"] for r in usable), default=0))
        caps = np.array([r["repeats"] * have[r["source"]] // block for r in usable], np.int64)
        blocks = apportion(np.array([r["share"] for r in usable]), self.total // block, caps) if usable else np.zeros(0, np.int64)
        self.blocks = {r["source"]: int(b) for r, b in zip(usable, blocks)}
        self.repeats = {r["source"]: r["repeats"] for r in usable}


def shard_quotas(tokens: np.ndarray, blocks: int, repeats: int, block: int) -> np.ndarray:
    """Tokens that each shard of a source has to give: its blocks, and of what is less than a block everywhere the first ones as much as they have."""
    got = apportion(tokens, blocks, repeats * tokens // block)
    left = repeats * tokens - got * block
    before = np.cumsum(left) - left
    return got * block + np.clip((blocks - int(got.sum())) * block - before, 0, left)


def _counted(documents: DataFrame, targets: DataFrame, tokenizer: str, ws: Workspace) -> tuple[DataFrame, list[dict]]:
    """Each distinct text of a listed source once, under its lowest doc_id, and the targets."""
    rows = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    sources = [{"source": r["source"], "share": max(0.0, r["share"] or 0.0), "repeats": max(0, r["repeats"] or 0)} for r in rows.orderBy("source").collect()]
    listed = documents.where(filled("text") & F.col("doc_id").isNotNull()).join(F.broadcast(rows.select("source")), "source", "left_semi")
    counted = count_tokens(listed, tokenizer)
    one = counted.groupBy("digest").agg(F.min(F.struct("doc_id", "source", "n_tokens")).alias("x")).select("x.doc_id", "x.source", "x.n_tokens")
    return ws.put(one.where("n_tokens > 0"), "texts"), sources


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK_TOKENS, shard: int = SHARD_TOKENS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The texts used with how often, and the report of shares by listed source.

    Texts equal in full count as one, under the lowest doc_id and that one's source; null and
    blank texts, and those of no listed source, aren't used. Shares are relative to the sum
    of the shares of the sources that have texts; one without texts, or with a share or a cap
    of nought, gets nothing and is reported with that. The tokenizer is a parameter.
    """
    spark = documents.sparkSession
    ws = Workspace(spark, "mixture")
    texts, sources = _counted(documents, targets, tokenizer, ws)
    sizes = {r["source"]: r["t"] for r in texts.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # listed sources only
    plan = Plan(sources, sizes, block)
    counts = spark.createDataFrame([(s, max(1, -(-t // shard)), plan.blocks.get(s, 0), plan.repeats.get(s, 0)) for s, t in sizes.items()] or [], "source string, shards long, blocks long, repeats int")
    placed = ws.put(texts.join(F.broadcast(counts.select("source", "shards")), "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards"))).drop("shards"), "placed")
    held = placed.groupBy("source", "shard").agg(F.sum("n_tokens").alias("held")).join(F.broadcast(counts.where("blocks > 0").select("source", "blocks", "repeats")), "source")

    def share_out(shards: pd.DataFrame) -> pd.DataFrame:
        """The shards of one source: of SHARD_TOKENS tokens each, so that even 10^12 tokens are five million numbers."""
        shards = shards.sort_values("shard")
        return shards[["source", "shard", "held"]].assign(quota=shard_quotas(shards["held"].to_numpy(), int(shards["blocks"].iloc[0]), int(shards["repeats"].iloc[0]), block))

    quotas = ws.put(held.groupBy("source").applyInPandas(share_out, "source string, shard long, held long, quota long"), "quotas")
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    ran = placed.join(quotas, ["source", "shard"]).withColumn("upto", F.sum("n_tokens").over(order))
    passes = F.floor(F.col("quota") / F.col("held"))
    rest = F.col("quota") - passes * F.col("held")
    used = ran.withColumn("uses", (passes + F.when(F.col("upto") - F.col("n_tokens") / 2 <= rest, 1).otherwise(0)).cast("int")).where("uses > 0").select("doc_id", "source", "n_tokens", "uses")
    used = ws.put(used, "used")
    sums = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("used_tokens"), F.count("*").alias("n_texts"), F.max("uses").alias("most_uses"))
    told = spark.createDataFrame(
        [(r["source"], r["share"], r["repeats"], sizes.get(r["source"], 0), plan.blocks.get(r["source"], 0), r["source"] in plan.blocks) for r in sources],
        "source string, listed_share double, max_repeats int, available_tokens long, blocks long, usable boolean",
    )
    whole, usable = sum(r["share"] for r in sources) or 1.0, sum(r["share"] for r in sources if r["source"] in plan.blocks) or 1.0
    report = told.join(F.broadcast(sums), "source", "left").na.fill({"used_tokens": 0, "n_texts": 0, "most_uses": 0})
    # at most as many rows as sources are listed
    total = sums.agg(F.sum("used_tokens").alias("total_tokens"))
    report = report.join(F.broadcast(total), how="left").select(
        "source",
        (F.col("listed_share") / whole).alias("target_share"),
        F.when(F.col("usable"), F.col("listed_share") / usable).otherwise(0.0).alias("attainable_share"),
        (F.col("used_tokens") / F.col("total_tokens")).alias("actual_share"),
        "max_repeats", "most_uses", "available_tokens", "used_tokens", "n_texts", "blocks",
    )
    return used, report
