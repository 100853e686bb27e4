"""Operator 6: language identification by nearest centroid.

A text becomes a vector of letter n-grams (1 to 3, words bounded): 1 + log of each count, times the inverse document frequency, scaled to length 1. Each
language has several centroids from spherical k-means over its sample, each for a share of it, so that single odd texts make none. A text takes the
language of the centroid with the largest cosine; it is rejected where its distance passes the middle between a high quantile of the language's training
distances and no likeness at all.

The fit reads about SAMPLE texts per language (a hashed share of the ids), however many languages there are; each language is clustered in a task of its own,
so only centroids reach the driver. Prediction reads every whole text. Null, empty and letterless texts are `und`, with score 0, and rejected. Texts under MIN_LETTERS n-grams say
too little about distance and are never rejected for it. Rows without an id are predicted, not learned from; rows that repeat are predicted alike, and are learned
from as often as they stand in the sample. Without learnable rows every text is `und`. An empty table gives an empty result. Ties go to the language that sorts first.
A prediction depends on its text alone, not on the texts around it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.bounded import hash_share
from wavepanel.llm.letters import letter_stream, strings
from wavepanel.llm.names import carried, ddl, quoted, unused
from wavepanel.llm.store import keep

#: Texts per language in the fit, about.
SAMPLE = 600
#: Counted languages up to which their shares are sent to all tasks.
SENT_LANGUAGES = 100_000
BUCKETS, CENTROIDS, ROUNDS = 4096, 4, 12
#: Where a next start is taken among the distances from the starts so far, the least share of a cluster, the quantile of the training distances.
SPREAD, SHARE, REACH = 0.75, 0.05, 0.98
#: Where between that quantile of the training distances (0) and distance 1 (1) rejection begins, for texts of so many n-grams on.
MARGIN, MIN_LETTERS = 0.5, 60
ROWS = 256


def feature_counts(texts: list[str]) -> np.ndarray:
    """n-gram counts per text, hashed into BUCKETS columns."""
    stream, place = letter_stream(texts)
    stream, place = np.append(stream, 0), np.append(place, max(0, len(texts) - 1))          # the last word ends, too
    n = len(texts)
    out = np.zeros(n * BUCKETS, np.float32)
    if len(stream) < 3:
        return out.reshape(n, BUCKETS)
    a, b, c = (stream[i:len(stream) - 2 + i].astype(np.uint32) for i in range(3))
    row = place[1:-1] * BUCKETS
    real = b != 0
    one = (b * np.uint32(2654435761)) >> np.uint32(20)
    two = ((a * np.uint32(40503) + b) * np.uint32(2246822519) + np.uint32(1)) >> np.uint32(20)
    three = (((a * np.uint32(40503) + b) * np.uint32(69069) + c) * np.uint32(3266489917) + np.uint32(2)) >> np.uint32(20)
    for gram in (one, two, three):
        out += np.bincount((row + gram)[real], minlength=n * BUCKETS)
    return out.reshape(n, BUCKETS)


@dataclass(frozen=True)
class Model:
    languages: list[str]            # of each centroid
    idf: np.ndarray
    centroids: np.ndarray           # rows of length 1
    radius: np.ndarray              # quantile REACH of the training distances of the language of each centroid

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return _scaled(np.log1p(counts), self.idf)

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        counts = feature_counts(texts)
        grams = counts.sum(1) / 3
        if not len(self.languages):
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = self.vectors(counts) @ self.centroids.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0, 1).astype(float)
        blank = grams == 0
        far = (1 - score > self.radius[best] + MARGIN * (1 - self.radius[best])) & (grams >= MIN_LETTERS)
        names = ["und" if e else self.languages[k] for e, k in zip(blank, best, strict=True)]
        return names, np.where(blank, 0.0, score), blank | far


def _scaled(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = tf * idf
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def _mean_directions(x: np.ndarray, centers: np.ndarray, rounds: int) -> np.ndarray:
    centers = centers.copy()
    for _ in range(rounds):
        own = (x @ centers.T).argmax(1)
        for i in range(len(centers)):
            if (own == i).any():
                mean = x[own == i].mean(0)
                centers[i] = mean / max(np.linalg.norm(mean), 1e-12)
    return centers


def spherical_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Up to k centroids of unit rows: spread but not extreme starts, then mean directions.

    Clusters under SHARE of the rows are dropped, the smallest first, and their rows go to the others.
    """
    middle = x.mean(0)
    chosen = [int((x @ middle).argmax())]
    while len(chosen) < min(k, len(x)):
        near = (x @ x[chosen].T).max(1)
        others = np.flatnonzero(near <= 1 - 1e-6)
        if not len(others):
            break
        chosen.append(int(others[np.argsort(-near[others], kind="stable")[int(SPREAD * (len(others) - 1))]]))
    centers = _mean_directions(x, x[chosen], rounds)
    while len(centers) > 1:
        size = np.bincount((x @ centers.T).argmax(1), minlength=len(centers))
        if size.min() >= SHARE * len(x):
            break
        centers = _mean_directions(x, np.delete(centers, size.argmin(), 0), rounds)
    return centers


def _vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            counts = feature_counts(strings(part.column(0)))
            places = [np.flatnonzero(r).astype(np.int32) for r in counts]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(places, pa.list_(pa.int32())),
                                              pa.array([r[p] for r, p in zip(counts, places, strict=True)], pa.list_(pa.float32()))],
                                             names=["lang", "places", "counts"])


def fit(docs: DataFrame, learnable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Learn from the rows where learnable holds and the language is known."""
    rows = docs.where(learnable & F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    share = keep(rows.groupBy(F.col(lang).alias("lang")).agg((F.lit(SAMPLE) / F.count(F.lit(1))).alias("share")))
    if share.count() <= SENT_LANGUAGES:                          # texts are not dealt by language
        share = F.broadcast(share)
    chosen = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(doc_id).alias("id")).join(share, "lang").where(hash_share(F.col("id"), F.col("share")))
    found = keep(chosen.select("text", "lang").mapInArrow(_vectors, "lang string, places array<int>, counts array<float>").where("size(places) > 0"))
    n = found.count()
    seen = found.select(F.explode("places").alias("place")).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()          # BUCKETS rows at most
    held = np.zeros(BUCKETS)
    held[[r.place for r in seen]] = [r.n for r in seen]
    idf = (np.log((1 + n) / (1 + held)) + 0.05).astype(np.float32)

    def cluster(own: pd.DataFrame) -> pd.DataFrame:
        """The centroids of one language and the reach of its texts; about SAMPLE rows."""
        order = sorted(range(len(own)), key=lambda i: (own["places"].iloc[i].tolist(), own["counts"].iloc[i].tolist()))
        x = np.zeros((len(own), BUCKETS), np.float32)
        for row, i in enumerate(order):
            x[row, own["places"].iloc[i]] = own["counts"].iloc[i]
        enough = x.sum(1) / 3 >= MIN_LETTERS
        x = _scaled(np.log1p(x), idf)
        c = spherical_means(x, CENTROIDS)
        cosine = (x @ c.T).max(1)[enough]
        reach = float(np.quantile(1 - cosine, REACH)) if len(cosine) else 1.0
        return pd.DataFrame({"lang": own["lang"].iloc[0], "number": range(len(c)), "center": list(c), "radius": reach})

    rows = sorted(found.groupBy("lang").applyInPandas(cluster, "lang string, number int, center array<float>, radius double").collect(), key=lambda r: (r.lang, r.number))
    languages, centers, radius = [r.lang for r in rows], [np.array(r.center, np.float32) for r in rows], [r.radius for r in rows]
    if not centers:
        return Model([], idf, np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    return Model(languages, idf, np.stack(centers), np.array(radius))


def identify(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """The columns of docs with lang_pred, score and rejected (after prefix); they replace columns of their names."""
    outputs = {prefix + "lang_pred": "string", prefix + "score": "double", prefix + "rejected": "boolean"}
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = carried(docs, outputs)
    schema = ddl(docs, columns, outputs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                names, score, rejected = shared.value.predict(strings(part.column(len(columns))))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score, pa.float64()),
                                                  pa.array(rejected)], names=[*columns, *outputs])

    return docs.select(*[docs[quoted(c)] for c in columns], docs[quoted(text)].alias(unused(docs) + "text")).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
