"""Operator 3: pack token sequences into windows of a fixed size with little padding.

Documents are cut at every full window; what is left over is shorter than a window. The histogram of those lengths
(never more entries than the window has places) goes to the driver. There, shallow combinations of two, three or four
lengths that fill a window exactly are enumerated, a non-negative least squares fit gives their repeat counts against
the histogram, the counts are rounded down to what the histogram holds, and the residual lengths are packed greedily
(largest first, then the largest that still fits). The plan names ranges of ranks within a length, so its size depends
on the window alone. Every piece finds its sequence by its length and its rank among the pieces of that length; ranks come
from one count per (length, bucket of documents) and a rank inside the bucket, so a length that a third of all pieces
share is never sorted in one task.

Null and empty texts hold the end token alone. Rows that repeat a document id, or have none, are packed as they are, each for itself.
Texts of any length are encoded whole; only the id and the text are read, whatever other columns are called.
An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavepanel.llm.blocks import text_blocks
from wavepanel.llm.bpe import ENCODE_BLOCK, checked_encode, vocabulary
from wavepanel.llm.store import keep, shuffle_width

#: Most combinations of three and of four lengths in the fit, those of the most frequent lengths first.
TRIPLES, QUADS = 6000, 3000
SWEEPS = 60
#: Pieces that a bucket of one length holds on average.
BUCKET_ROWS = 50_000


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, doc_tokens, start, length, ids_crc32, and with_ids the ids themselves."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids array<int>" if with_ids else "")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for rows, data, offsets in text_blocks(batches, "__text", ENCODE_BLOCK):
            ids, at, _, _ = checked_encode(data, offsets, vocab)
            n_docs = len(offsets) - 1
            whole = np.insert(ids, at[1:], end_id).astype("<u4")      # the end token after each text
            at = at + np.arange(n_docs + 1)
            sizes = np.diff(at)
            pieces = -(-sizes // window)
            doc = np.repeat(np.arange(n_docs), pieces)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
            length = np.minimum(window, sizes[doc] - start)
            begin = at[doc] + start
            view = memoryview(whole).cast("B")
            crc = [zlib.crc32(view[4 * a:4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
            arrays = [rows.column(0).take(pa.array(doc)), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                      pa.array(crc, pa.int64()), pa.array(sizes[doc], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                arrays.append(pa.ListArray.from_arrays(pa.array(np.append(begin, at[-1]), pa.int32()), pa.array(whole.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("__text")).mapInArrow(cut, schema)


def combinations(histogram: np.ndarray) -> list[tuple[int, ...]]:
    """Shallow combinations of occurring lengths that fill the window; histogram[l] counts the pieces of length l."""
    window = len(histogram) - 1
    have = np.flatnonzero(histogram[:window])
    there = histogram > 0
    found: list[tuple[int, ...]] = [(int(a), int(window - a)) for a in have if a <= window - a and there[window - a]]
    often = have[np.argsort(-histogram[have], kind="stable")]

    def add(depth: int, most: int) -> None:
        got: set[tuple[int, ...]] = set()
        reach = 2 * int(most ** 0.5) + 8
        if depth == 3:
            for i, a in enumerate(often[:reach]):
                for b in often[i:reach]:
                    c = window - a - b
                    if c > 0 and there[c]:
                        got.add(tuple(sorted((int(a), int(b), int(c)))))
                if len(got) >= most:
                    break
        else:
            short = often[often < window // 2][:reach]
            for i, a in enumerate(short):
                for j, b in enumerate(short[i::3]):
                    c = short[(i + 7 * j) % len(short)]
                    d = window - a - b - c
                    if d > 0 and there[d]:
                        got.add(tuple(sorted((int(a), int(b), int(c), int(d)))))
                if len(got) >= most:
                    break
        found.extend(sorted(got)[:most])

    add(3, TRIPLES)
    add(4, QUADS)
    return found


def solve_counts(patterns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = SWEEPS) -> np.ndarray:
    """Non-negative least squares by coordinate descent: repeat counts x >= 0 with the least |sum x_p * p - histogram|."""
    x = np.zeros(len(patterns))
    rest = histogram.astype(float).tolist()
    use = [tuple(Counter(p).items()) for p in patterns]
    norm = [sum(k * k for _, k in u) for u in use]
    scale = max(1.0, float(histogram.sum()))
    for _ in range(sweeps):
        moved = 0.0
        for i, u in enumerate(use):
            step = max(-x[i], sum(rest[a] * k for a, k in u) / norm[i])
            if step:
                x[i] += step
                moved += abs(step)
                for a, k in u:
                    rest[a] -= step * k
        if moved < 1e-4 * scale:
            break
    return x


def plan(histogram: np.ndarray) -> pd.DataFrame:
    """Where the pieces go: rows (length, rank_from, rank_to, sequence_from, step offset).

    Ranks rank_from <= r < rank_to of a length go to the sequences sequence_from + (r - rank_from), at that offset.
    """
    window = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    used = np.zeros_like(left)
    rows: list[tuple[int, int, int, int, int]] = []
    sequence = 0

    def emit(pattern: Iterable[int], times: int) -> None:
        nonlocal sequence
        offset = 0
        for a in pattern:
            rows.append((a, int(used[a]), int(used[a]) + times, sequence, offset))
            used[a] += times
            left[a] -= times
            offset += a
        sequence += times

    if left[window]:
        emit((window,), int(left[window]))
    patterns = combinations(histogram)
    for x, p in zip(solve_counts(patterns, histogram), patterns, strict=True):
        times = min([int(x + 1e-6), *(int(left[a]) // k for a, k in Counter(p).items())])
        if times > 0:
            emit(p, times)
    # the residual: the largest length that still fits, repeated while every length of the pattern lasts
    while left.any():
        room, pattern, taken = window, [], Counter()
        while room:
            fits = [a for a in np.flatnonzero(left[:room + 1])[::-1] if left[a] > taken[a]]
            if not fits:
                break
            a = int(fits[0])
            pattern.append(a)
            taken[a] += 1
            room -= a
        emit(pattern, min(int(left[a]) // k for a, k in taken.items()))
    return pd.DataFrame(rows, columns=["length", "rank_from", "rank_to", "sequence_from", "offset"])


def ranked(pieces: DataFrame, by: str, rows: int) -> DataFrame:
    """pieces with `rank`, 0.. within each value of `by`, without sorting a value in one task.

    Documents fall into buckets by a hash of their ids; (value, bucket) counts give the first rank of each bucket.
    """
    spark = pieces.sparkSession
    buckets = max(shuffle_width(spark), rows // BUCKET_ROWS)
    pieces = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    inside = Window.partitionBy(by, "__bucket").orderBy("doc_id", "start", "ids_crc32")
    counts = pieces.groupBy(by, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(by, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return (pieces.withColumn("__nth", F.row_number().over(inside) - 1).join(firsts, [by, "__bucket"])
            .withColumn("rank", F.col("__first") + F.col("__nth")).drop("__first", "__nth", "__bucket"))


def pack(pieces: DataFrame, window: int = 2048) -> DataFrame:
    """pieces (doc_id, start, length <= window, ids_crc32, ...) with sequence_id and offset. Reads pieces twice: keep them first."""
    spark: SparkSession = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()      # at most window rows
    histogram = np.zeros(window + 1, np.int64)
    for r in counted:
        histogram[r.length] = r.n
    where = plan(histogram)
    if where.empty:
        return pieces.select("*", F.lit(0).cast("bigint").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    where = where.sort_values(["length", "rank_from"]).to_numpy(np.int64)
    chart = spark.sparkContext.broadcast(where)                                         # bounded by the window
    columns = pieces.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema] + ["sequence_id bigint", "offset bigint"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chart.value
        stride = int(histogram.max()) + 1
        keys = rows[:, 0] * stride + rows[:, 1]
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            row = rows[np.searchsorted(keys, length * stride + rank, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in columns),
                 pa.array(row[:, 3] + rank - row[:, 1]), pa.array(row[:, 4])], names=[*columns, "sequence_id", "offset"])

    return ranked(pieces, "length", int(histogram.sum())).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1,
                   with_ids: bool = False) -> DataFrame:
    """Cut, plan and place all documents; one row per piece. The pieces are written once, the texts are read once."""
    return pack(keep(token_pieces(docs, path, doc_id, text, window, end_id, with_ids)), window)


__all__ = ["pack", "pack_documents", "plan", "token_pieces"]
