"""Operator 7: exact top-k by distributed histogram selection.

Vectors are cut into blocks; every block of rows meets every block of queries, keyed by (query block, slice), so neither side
is held whole by a task. Each round scores everything and sums a histogram of the scores per query, inside the interval that
still holds its kth best score; the bin of the kth value is the next interval. After a few rounds the interval is one
integer, the kth score. A last pass keeps scores above it and, of the ties, the smallest ids of each block; ties end by id.

Components become floor(256 * x), x as double; the score is the integer inner product. Vectors that are null or hold null or
non-finite components take no part, and neither do vectors of another length than the query's. A query's own id is no candidate, also where rows repeat it (the query is
then the smallest of their vectors). Queries with fewer
candidates than k return all. Empty tables give an empty result. Scores beyond 2^53 are refused with an error.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wavepanel.llm.store import keep, shuffle_width

#: Rows in a block, queries in a block, bins of a histogram.
ROWS, QUERIES, BINS = 1024, 256, 256
#: Query blocks whose histograms a task holds at a time.
HELD = 32


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _numbers(n: int) -> Column:
    return F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))


def _blocks(rows_per_block: int):
    """Rows (id, vector) to blocks (dim, ids, matrix, reach): matrix as int64 bytes, reach its largest Euclidean length."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                for at in range(0, len(own), rows_per_block):
                    some = own[at:at + rows_per_block]
                    matrix = flat[starts[some][:, None] + np.arange(dim)].astype(np.int64)
                    reach = float(np.sqrt((matrix.astype(float) ** 2).sum(1)).max())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(dim)], pa.int64()), pa.array([ids[some].tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()),
                         pa.array([reach], pa.float64())], names=["dim", "ids", "matrix", "reach"])
    return run


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]]:
    """Per row of joined blocks: row ids, query ids, the state of the queries, and all scores (queries x rows)."""
    for row in batch.to_pylist():
        ids = np.frombuffer(row["ids"], np.int64)
        q_ids = np.array([q["query_id"] for q in row["queries"]], np.int64)
        state = {c: np.array([q[c] for q in row["queries"]], np.int64) for c in ("low", "width", "above")}
        left = np.array([q["vector"] for q in row["queries"]], np.float64)
        scores = left @ np.frombuffer(row["matrix"], np.int64).reshape(len(ids), -1).astype(np.float64).T
        yield ids, q_ids, state, scores.astype(np.int64)


def _histograms(bins: int):
    def told(q_ids: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(counts)
        return pa.RecordBatch.from_arrays([pa.array(q_ids[some // bins]), pa.array(some % bins), pa.array(counts[some], pa.int64())],
                                          names=["query_id", "bin", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}    # one histogram per query block, summed over the row blocks of the task
        for batch in batches:
            for ids, q_ids, state, scores in _pairs(batch):
                place = (scores - state["low"][:, None]) // state["width"][:, None]
                inside = (place >= 0) & (place < bins) & (ids[None, :] != q_ids[:, None])
                cell = (np.arange(len(q_ids))[:, None] * bins + place)[inside]
                key = q_ids.tobytes()
                if key not in held:
                    if len(held) >= HELD:
                        yield told(*held.pop(next(iter(held))))
                    held[key] = q_ids, np.zeros(len(q_ids) * bins, np.int64)
                held[key][1][:] += np.bincount(cell, minlength=len(q_ids) * bins)
        for q_ids, counts in held.values():
            yield told(q_ids, counts)
    return run


def _winners(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, q_ids, state, scores in _pairs(batch):
                order = np.argsort(ids, kind="stable")
                ids, scores = ids[order], scores[:, order]
                other = ids[None, :] != q_ids[:, None]
                ties = (scores == state["low"][:, None]) & other
                found = ((scores > state["low"][:, None]) & other) | (ties & (np.cumsum(ties, axis=1) <= k))
                q, r = np.nonzero(found)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[q]), pa.array(ids[r]), pa.array(scores[q, r])],
                                                 names=["query_id", "vec_id", "score"])
    return run


def top_k(vectors: DataFrame, queries: Column, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row of vectors where queries holds, its k best other rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    clean = vectors.where(F.col(vec_id).isNotNull() & usable(F.col(vector))) \
        .select(F.col(vec_id).cast("bigint").alias("id"), quantised(F.col(vector)).alias("vector"), queries.alias("asked"))
    blocks = keep(clean.select("id", "vector").mapInArrow(_blocks(ROWS), "dim bigint, ids binary, matrix binary, reach double"))
    asked = clean.where("asked").groupBy(F.col("id").alias("query_id")).agg(F.min("vector").alias("vector"))
    size = asked.count()
    reach = blocks.agg(F.max("reach")).first()[0]
    out = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not size or reach is None:
        return spark.createDataFrame([], out)
    bound = int(reach * reach) + 1                               # no inner product is larger
    if bound >= 2**53:
        raise ValueError("scores beyond 2^53 are not exact")
    n_blocks = -(-size // QUERIES)
    slices = max(1, -(-2 * shuffle_width(spark) // n_blocks))
    asked = keep(asked.withColumn("qblock", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))).withColumn("dim", F.size("vector").cast("bigint")))
    width = 1
    while width * BINS < 2 * bound + 1:
        width *= BINS
    state = asked.select("query_id", F.lit(-bound).cast("bigint").alias("low"), F.lit(width).cast("bigint").alias("width"),
                         F.lit(0).cast("bigint").alias("above"))
    every = blocks.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices))) \
        .withColumn("qblock", F.explode(_numbers(n_blocks))).repartition("qblock", "slice", "dim")

    def meet(state: DataFrame) -> DataFrame:
        packed = (asked.join(state, "query_id").groupBy("qblock", "dim")
                  .agg(F.collect_list(F.struct("query_id", "vector", "low", "width", "above")).alias("queries"))
                  .withColumn("slice", F.explode(_numbers(slices))))
        return every.join(packed, ["qblock", "slice", "dim"]).select("ids", "matrix", "queries")

    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))
    while True:
        counts = meet(state).mapInArrow(_histograms(BINS), "query_id bigint, bin bigint, n bigint") \
            .groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        best = (counts.withColumn("sum", F.sum("n").over(down)).withColumn("last", F.lead("bin").over(down))
                .join(state, "query_id").where((F.col("above") + F.col("sum") >= k) | F.col("last").isNull())
                .groupBy("query_id").agg(F.max_by(F.struct("bin", "n", "sum", "low", "width", "above"), "bin").alias("b")))
        state = keep(best.select("query_id", (F.col("b.low") + F.col("b.bin") * F.col("b.width")).alias("low"),
                                 F.greatest(F.lit(1), F.col("b.width") / BINS).cast("bigint").alias("width"),
                                 (F.col("b.above") + F.col("b.sum") - F.col("b.n")).alias("above")))
        if width == 1:
            break
        width //= BINS
    found = meet(state).mapInArrow(_winners(k), "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
