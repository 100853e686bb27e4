"""Operator 1: exact dedup of batches against immutable snapshots.

A snapshot holds the distinct texts kept so far by digest, cut into buckets of the digest, and one static binary fuse
filter per bucket. The distinct digests of a new batch (duplicates inside the batch are grouped apart, with partial
aggregation, so a hot text is one row here) meet the filters bucket by bucket. What a filter denies is new. What it lets
pass joins the exact bucket by digest, and the two texts are compared byte by byte.

Texts are equal when identical after replacing each run of ASCII white space by one space; null counts as empty. The
smallest id stays. Rows without an id are grouped with equal texts and stay only if no equal text has an id. Rows that
repeat an id share its decision. Ties cannot occur otherwise. Texts of any length are hashed and compared whole; only the id
and the text are read, whatever other columns are called. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.blocks import mix
from wavepanel.llm.store import BROADCAST_ROWS, keep, shuffle_width

#: Digests per bucket on average; a filter takes about 1.2 bytes a digest.
BUCKET_DIGESTS = 16_384


# --- binary fuse filters: three places per key, eight-bit fingerprints ---

def _layout(n: int) -> tuple[int, int, int]:
    """Segment length, number of first segments, number of places for n keys."""
    segment = 1 << max(2, min(18, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25))))
    capacity = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 32
    firsts = max(1, -(-capacity // segment) - 2)
    return segment, firsts, (firsts + 2) * segment


def _places(keys: np.ndarray, seed: int, segment: int, firsts: int) -> tuple[np.ndarray, np.ndarray]:
    """The three places of each key (3 x n) and its fingerprint."""
    with np.errstate(over="ignore"):
        h = mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15))
    low = np.uint64(segment - 1)
    zero = ((h >> np.uint64(32)) * np.uint64(firsts * segment)) >> np.uint64(32)
    one = (zero + np.uint64(segment)) ^ ((h >> np.uint64(18)) & low)
    two = (zero + np.uint64(2 * segment)) ^ (h & low)
    fingerprint = (mix(h) >> np.uint64(56)).astype(np.uint8)
    return np.stack([zero, one, two]).astype(np.int64), fingerprint


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A filter of distinct uint64 keys: seed, segment length, first segments, fingerprints."""
    keys = np.unique(keys)
    n = len(keys)
    segment, firsts, size = _layout(n)
    seed = 0
    while True:
        places, fingerprint = _places(keys, seed, segment, firsts)
        count = np.bincount(places.ravel(), minlength=size)
        which = np.zeros(size, np.int64)
        for row in places:
            np.bitwise_xor.at(which, row, np.arange(n))
        rounds, peeled = [], 0
        single = np.flatnonzero(count == 1)
        while len(single):
            own, at = np.unique(which[single], return_index=True)
            rounds.append((own, single[at]))
            peeled += len(own)
            gone = places[:, own]
            np.subtract.at(count, gone.ravel(), 1)
            np.bitwise_xor.at(which, gone.ravel(), np.tile(own, 3))
            near = np.unique(gone.ravel())
            single = near[count[near] == 1]
        if peeled == n:
            break
        seed += 1                                                # rare: other places
        if seed % 8 == 0:
            firsts += max(1, firsts // 8)
            size = (firsts + 2) * segment
    table = np.zeros(size, np.uint8)
    for own, slot in reversed(rounds):
        table[slot] = 0
        table[slot] = fingerprint[own] ^ table[places[0, own]] ^ table[places[1, own]] ^ table[places[2, own]]
    return seed, segment, firsts, table.tobytes()


def fuse_contains(keys: np.ndarray, seed: int, segment: int, firsts: int, table: bytes) -> np.ndarray:
    """True for every key of the filter, and for about one other key in 256."""
    places, fingerprint = _places(keys, seed, segment, firsts)
    t = np.frombuffer(table, np.uint8)
    return fingerprint == t[places[0]] ^ t[places[1]] ^ t[places[2]]


# --- batches and snapshots ---

def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


@dataclass(frozen=True)
class Snapshot:
    members: DataFrame      # sha, doc_id (null: only rows without id), key, bucket: one row per distinct text
    filters: DataFrame      # bucket, seed, segment, firsts, table
    buckets: int


def representatives(digests: DataFrame) -> DataFrame:
    """One row per distinct text of a batch: sha, key, smallest doc_id, number of rows."""
    return (digests.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
            .withColumn("key", F.xxhash64("sha")))


def snapshot(members: DataFrame) -> Snapshot:
    """Freeze distinct texts (sha, key, doc_id; kept, they are read twice) with one filter per bucket."""
    spark = members.sparkSession
    buckets = max(shuffle_width(spark), -(-members.count() // BUCKET_DIGESTS))
    members = members.select("sha", "doc_id", "key", F.pmod("key", F.lit(buckets)).alias("bucket"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seed, segment, firsts, table = fuse_build(rows["key"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "segment": [segment], "firsts": [firsts], "table": [table]})

    filters = members.select("bucket", "key").groupBy("bucket").applyInPandas(
        build, "bucket bigint, seed bigint, segment bigint, firsts bigint, table binary")
    return Snapshot(members, keep(filters), buckets)


def screen(batch: DataFrame, against: Snapshot) -> DataFrame:
    """batch (sha, key, doc_id, n) with `maybe`: false where the snapshot surely lacks the text."""
    def ask(key: tuple, rows: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        rows = rows.copy()
        rows["maybe"] = False
        for f in filters.itertuples():
            rows["maybe"] |= fuse_contains(rows["key"].to_numpy(np.int64).view(np.uint64), f.seed, f.segment, f.firsts, f.table)
        return rows.drop(columns="bucket")

    batch = batch.withColumn("bucket", F.pmod("key", F.lit(against.buckets)))
    return batch.groupBy("bucket").cogroup(against.filters.groupBy("bucket")).applyInPandas(
        ask, "sha string, doc_id bigint, n bigint, key bigint, maybe boolean")


def confirm(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, by_digest: bool = False) -> DataFrame:
    """The pairs (sha, old_id, new_id) whose texts agree byte for byte. Only the texts of the pairs move.

    by_digest: sha is the digest of the texts, which are then fetched by id and digest, as ids may repeat with other texts or be null.
    """
    needed = pairs.select(F.col("sha").alias("__sha"), F.explode(F.array("old_id", "new_id")).alias("__id")).distinct()
    if pairs.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    source = docs.select(F.col(doc_id).cast("bigint").alias("__own"), normal_text(F.col(text)).alias("__text"))
    fits = F.col("__own") == F.col("__id")
    if by_digest:
        fits = F.col("__own").eqNullSafe(F.col("__id")) & (F.sha2("__text", 256) == F.col("__sha"))
    texts = source.join(needed, fits)
    same = texts.groupBy("__sha").agg((F.min("__text") == F.max("__text")).alias("same"))
    return pairs.join(same, F.col("sha") == F.col("__sha")).where("same").drop("same", "__sha")


def dedup_batches(docs: DataFrame, cuts: list[int], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Take docs in batches of ascending ids, cut after the ids in cuts, each against the snapshots of those before.

    Returns doc_id, keep_id, group_size, kept, text_sha256 for every row.
    """
    digests = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.sha2(normal_text(F.col(text)), 256).alias("sha"))
    batch = F.lit(0)
    for c in cuts:
        batch = batch + F.coalesce(F.col("doc_id") > F.lit(c), F.lit(True)).cast("int")
    digests = keep(digests.withColumn("batch", batch))
    snapshots: list[Snapshot] = []
    kept: list[DataFrame] = []                                   # sha, keep_id, n per batch
    for b in range(len(cuts) + 1):
        new = keep(representatives(digests.where(F.col("batch") == b)))
        known = None
        for old in snapshots:
            asked = keep(screen(new, old))
            pairs = asked.where("maybe").join(old.members.select("sha", F.col("doc_id").alias("old_id")), "sha") \
                .select("sha", "old_id", F.col("doc_id").alias("new_id"))
            same = confirm(keep(pairs), docs, doc_id, text, by_digest=True).select("sha", F.col("old_id").alias("keep_id"))
            known = same if known is None else known.unionByName(same)
        if known is None:
            kept.append(new.select("sha", F.col("doc_id").alias("keep_id"), "n", F.lit(b).alias("batch")))
            fresh = new
        else:
            known = keep(known.withColumn("__known", F.lit(True)))
            joined = new.join(known, "sha", "left")
            kept.append(joined.select("sha", F.when(F.col("__known"), F.coalesce("keep_id", "doc_id")).otherwise(F.col("doc_id"))
                                      .alias("keep_id"), "n", F.lit(b).alias("batch")))
            fresh = new.join(known, "sha", "left_anti")
        if b < len(cuts):
            snapshots.append(snapshot(keep(fresh) if known is not None else fresh))
    decided = kept[0]
    for d in kept[1:]:
        decided = decided.unionByName(d)
    decided = keep(decided)
    sizes = decided.groupBy("sha", "keep_id").agg(F.sum("n").alias("group_size"))
    decided = keep(decided.drop("n").join(sizes.withColumnRenamed("sha", "__s").withColumnRenamed("keep_id", "__k"),
                                          (F.col("sha") == F.col("__s")) & F.col("keep_id").eqNullSafe(F.col("__k"))).drop("__s", "__k"))
    return (digests.join(decided, ["sha", "batch"])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("sha").alias("text_sha256")))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Decide every row of docs: the lower half of the ids makes a snapshot, the upper half comes as a new batch."""
    middle = docs.agg(F.percentile_approx(F.col(doc_id).cast("bigint"), 0.5)).first()[0]
    return dedup_batches(docs, [] if middle is None else [middle], doc_id, text)


__all__ = ["Snapshot", "dedup_batches", "exact_dedup", "fuse_build", "fuse_contains", "normal_text", "screen", "snapshot"]
