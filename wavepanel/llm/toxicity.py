"""Operator 9: toxicity, with noisy-channel deobfuscation.

A character language model (up to 4 signs) is counted over all texts; all its counts stay in a table. Words that look disguised (signs for letters,
letters spaced out, letters repeated) become a lattice of readings, and Viterbi finds the likeliest path under the model: the distinct disguised words are
dealt to blocks, the runs that the lattices of a block can ask for are joined with the counts, and each block is read with its own counts. The restored
words and their beginnings are the features of a logistic regression, learned from a bounded sample of labelled rows.

Every whole text is scored, tokens and spaced runs of any length; keys in hexadecimal, addresses of web pages and runs of bare digits are no words by their form. Null and empty texts get the score of no feature at all; an empty table gives an empty result. Outputs replace columns of their names. Labels that contradict each other for one id count
as toxic. Rows without an id are scored, not learned from; rows that repeat are scored alike. Without labels of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.bounded import hash_share
from wavepanel.llm.letters import letter_stream, strings
from wavepanel.llm.names import carried, ddl, quoted, unused
from wavepanel.llm.store import keep

#: Labelled rows in the fit at most, toxic and not.
TOXIC_ROWS, CLEAN_ROWS = 6_000, 18_000
#: Toxic sample texts that a feature needs.
SUPPORT = 3
#: Bytes of disguised units with features up to which they are sent to every executor.
SENT_BYTES = 16 << 20
ORDER = 4
PREFIXES = (3, 4, 5, 6)
#: Distinct words remembered in a task.
MEMO = 300_000
#: Disguised words that are read together, at most about.
UNITS = 10_000

#: What a sign may stand for, besides itself or nothing. Fixed values.
READINGS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li",
            "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "aeiou"}
_SEPARATED = re.compile(r"(?<!\S)(?:[^\W_]|[@$!|+€£])(?:\s+(?:[^\W_]|[@$!|+€£])){2,}(?!\S)")
_INNER = re.compile(r"^(?:[^\W_][.\-_*·~]+){2,}[^\W_]$")
_JOINT = re.compile(r"[^\w@$!|+€£(*#]+|_+")
_KEY = re.compile(r"[0-9a-f]{16,}$")
_REPEAT = re.compile(r"(.)\1\1")
_EDGES = re.compile(r"^[^\w@$€£|(+]+|[^\w@$€£|+]+$")
_NOISE = re.compile(r"^([@$€£|(+])\1{2,}|([@$€£|+])\2{2,}$")


# --- language model ---

def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the runs of ORDER signs (0: word boundary) from each place of each text on; after its end come boundaries."""
    for batch in batches:
        for start in range(0, batch.num_rows, 250):
            stream, place = letter_stream(strings(batch.column(0).slice(start, 250)))
            n = len(stream)
            if not n:
                continue
            padded = np.concatenate([stream.astype(np.int64), np.zeros(ORDER - 1, np.int64)])
            owner = np.concatenate([place, np.full(ORDER - 1, -1)])
            b, c, d = (np.where(owner[i:i + n] == place, padded[i:i + n], 0) for i in range(1, ORDER))
            left, lefts = pd.factorize((padded[:n] << 21) | b)
            right, rights = pd.factorize((c << 21) | d)
            del stream, place, padded, owner, b, c, d
            codes, found = pd.factorize((left << 32) | right)
            pairs = lefts[found >> 32], rights[found & 0xFFFFFFFF]
            signs = np.stack([half for x in pairs for half in (x >> 21, x & ((1 << 21) - 1))], 1).astype("<u4")
            text = signs.tobytes().decode("utf-32-le")
            yield pa.RecordBatch.from_arrays([pa.array([text[i:i + ORDER] for i in range(0, len(text), ORDER)], pa.string()),
                                              pa.array(np.bincount(codes, minlength=len(found)))], names=["g", "n"])


@dataclass(frozen=True)
class CharModel:
    """Counts by string; \\0 is the word boundary."""
    counts: dict[str, int]
    total: int

    def cost(self, history: str, sign: str) -> float:
        """-log of the probability of sign after history (up to ORDER - 1 signs), backing off with a penalty."""
        penalty = 0.0
        for start in range(len(history) + 1):
            context = history[start:]
            n = self.counts.get(context + sign, 0)
            if n:
                whole = self.counts.get(context, 0) if context else self.total
                return penalty - log(n / max(whole, n))
            penalty += 0.9
        return penalty + log(self.total + 2) + 1

    def covering(self, token: str, spaced: bool) -> CharModel:
        return self


@dataclass(frozen=True)
class CharTable:
    """All counts as a kept table (g, n); \\0 is the word boundary."""
    counts: DataFrame
    total: int

    def covering(self, token: str, spaced: bool) -> CharModel:
        """The counts that one token needs."""
        asked = self.counts.sparkSession.createDataFrame([(g,) for g in asked_runs(token, spaced)], "g string")
        return CharModel({r.g: r.n for r in self.counts.join(F.broadcast(asked), "g").collect()}, self.total)


def fit_char_model(docs: DataFrame, text: str = "text") -> CharTable:
    """Count all runs of 1 to ORDER signs over all texts; no count reaches the driver."""
    runs = keep(docs.select(text).mapInArrow(_grams, "g string, n bigint").groupBy("g").agg(F.sum("n").alias("n")))
    total = runs.agg(F.sum("n")).first()[0] or 0
    begins = F.explode(F.array(*[F.substring("g", 1, k) for k in range(1, ORDER + 1)])).alias("g")
    return CharTable(keep(runs.select(begins, "n").groupBy("g").agg(F.sum("n").alias("n"))), total)


# --- channel ---

def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """Readings (letters, channel cost) of each place of a disguised token. Three or more equal signs are one or two; spaced signs may end a word."""
    places: list[list[tuple[str, float]]] = []
    i = 0
    while i < len(token):
        sign = token[i]
        j = i
        while j < len(token) and token[j] == sign:
            j += 1
        run = j - i
        letters = [(sign, 0.0)] if sign.isalpha() else [(x, 0.7) for x in READINGS.get(sign, "")] + [("", 3.0)]
        if run >= 3:
            places.append([(x, c) for x, c in letters] + [(x + x, c + 0.5) for x, c in letters if x])
        else:
            places.extend([letters] * run)
        if spaced and j < len(token):
            places.append([("", 0.0), ("\0", 2.0)])
        i = j
    return places


def asked_runs(token: str, spaced: bool = False) -> set[str]:
    """The runs whose counts restore may ask for."""
    whole: set[str] = set()
    states = {"\0"}
    for readings in [*lattice(token, spaced), [("\0", 0.0)]]:
        new: set[str] = set()
        for history in states:
            for letters, _ in readings:
                h = history
                for x in letters:
                    whole.add(h + x)
                    h = (h + x)[-(ORDER - 1):]
                new.add(h)
        states = new
    return {part for run in whole for start in range(len(run)) for part in (run[start:], run[start:-1]) if part}


def restore(token: str, model: CharModel | CharTable, spaced: bool = False) -> list[str]:
    """The likeliest words behind a token: Viterbi over the lattice, with the last ORDER - 1 signs as state."""
    model = model.covering(token, spaced)
    states: dict[str, tuple[float, str]] = {"\0": (0.0, "")}
    for readings in [*lattice(token, spaced), [("\0", 0.0)]]:
        new: dict[str, tuple[float, str]] = {}
        for history, (cost, said) in states.items():
            for letters, channel in readings:
                c, h = cost + channel, history
                for x in letters:
                    c += model.cost(h, x)
                    h = (h + x)[-(ORDER - 1):]
                if h not in new or c < new[h][0]:
                    new[h] = (c, said + letters)
        states = new
    best = min(states.values())[1]
    return [w for w in best.split("\0") if w]


def _disguised(part: str) -> bool:
    return (any(c.isalpha() for c in part) and any(c in READINGS for c in part) and not _KEY.match(part)) or bool(part.isalpha() and _REPEAT.search(part))


def parse(token: str) -> tuple[list[str], list[str]]:
    """The plain words of one lower-case token without white space, and what is to be restored: the whole, and the parts that joints separate."""
    if not token.isalpha():
        if token[:-1].isalpha() and token[-1] in ".,;:!?":       # the most frequent case by far
            token = token[:-1]
        else:
            token = _NOISE.sub("", _EDGES.sub("", token))
            if not token:
                return [], []
            if not token.isalpha():
                if _INNER.match(token):
                    return [], [re.sub(r"[.\-_*·~]+", "", token)]
                parts = [x for x in _JOINT.split(token) if x]
                if "://" in token:
                    return [x for x in parts if x.isalpha()], []
                units = [x for x in parts if _disguised(x)]
                if len(parts) > 1 and units and not any(_KEY.match(x) for x in parts):
                    units.append(token)
                return [w for x in parts if x not in units for w in re.split(r"[^\w]+|_", x) if w.isalpha()], units
    return ([], [token]) if _REPEAT.search(token) else ([token], [])


def read_token(token: str, model: CharModel | CharTable) -> list[str]:
    """Words of one lower-case token without white space; a plain word is itself."""
    words, units = parse(token)
    return [*words, *(w for unit in units for w in restore(unit, model))]


def _features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


def read_text(text: str) -> tuple[set[str], list[str]]:
    """Distinct tokens of a text, and the runs of letters that stand spaced out."""
    spaced: list[str] = []
    low = text.lower()
    for m in _SEPARATED.finditer(low):
        run = "".join(m.group().split())
        if len(set(run)) > 1 and not run.isdigit():              # not one sign again and again, and no numbers
            spaced.append(run)
    return set(low.split()), spaced


# --- disguised units of a table: (unit, spaced), a token or a spaced run ---

def _new_units(text: str, seen: set) -> Iterator[tuple[str, bool]]:
    tokens, runs = read_text(text)
    if len(seen) >= MEMO:
        seen.clear()
    for token in tokens - seen:
        seen.add(token)
        for unit in parse(token)[1]:
            yield unit, False
    for run in runs:
        if (run, True) not in seen:
            seen.add((run, True))
            yield run, True


def _units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        found = {u for t in strings(batch.column(0)) for u in _new_units(t, seen)}
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([s for _, s in found], pa.bool_())], names=["unit", "spaced"])


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, g): the runs that the units of a block ask for, mostly once."""
    for batch in batches:
        found: dict[int, set[str]] = {}
        for unit, spaced, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found.setdefault(block, set()).update(asked_runs(unit, spaced))
        for block, runs in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(runs), pa.int64()), pa.array(list(runs), pa.string())], names=["block", "g"])


def restored(texts: DataFrame, chars: CharTable) -> DataFrame:
    """(unit, spaced, words) of every distinct disguised unit in a table of one text column."""
    units = keep(texts.mapInArrow(_units, "unit string, spaced boolean").distinct())
    n, total = units.count(), chars.total
    blocks = max(1, -(-n // UNITS), min(-(-n // 200), 4 * texts.sparkSession.sparkContext.defaultParallelism))
    units = units.withColumn("block", F.pmod(F.xxhash64("unit", "spaced"), F.lit(blocks).cast("bigint"))).repartition("block")
    asked = units.mapInArrow(_asked, "block bigint, g string").distinct()

    def read(key: tuple, units: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        model = CharModel(dict(zip(counts["g"], counts["n"].tolist(), strict=True)), total)
        words = [restore(u, model, bool(s)) for u, s in zip(units["unit"], units["spaced"], strict=True)]
        return pd.DataFrame({"unit": units["unit"], "spaced": units["spaced"], "words": pd.Series(words, index=units.index, dtype=object)})

    return keep(units.groupBy("block").cogroup(asked.join(chars.counts, "g").groupBy("block")).applyInPandas(
        read, "unit string, spaced boolean, words array<string>"))


# --- classifier ---

def _string_features(words: list[str]) -> tuple:
    return tuple({f for w in words for f in _features(w)})


@dataclass(frozen=True)
class Weights:
    places: dict[str, int]          # of features
    weights: np.ndarray
    bias: float
    trained: bool

    def of_words(self, words: list[str]) -> tuple:
        return tuple({self.places[f] for w in words for f in _features(w) if f in self.places})

    def score(self, found: set[int]) -> float:
        if not self.trained:
            return 0.0
        z = self.bias + float(self.weights[sorted(found)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


@dataclass(frozen=True)
class Classifier:
    chars: CharTable
    weights: Weights


def gather(text: str, of_words: Callable[[list[str]], tuple], known: dict[tuple[str, bool], tuple], memo: dict[str, tuple]) -> set:
    """Features of a text: of its plain words, and the known ones of its disguised units."""
    tokens, runs = read_text(text)
    out: set = set()
    for t in tokens:
        hit = memo.get(t)
        if hit is None:
            if len(memo) >= MEMO:
                memo.clear()
            words, units = parse(t)
            hit = of_words(words) if words else ()
            for unit in units:
                hit += known.get((unit, False), ())
            memo[t] = hit
        if hit:
            out.update(hit)
    for run in runs:
        out.update(known.get((run, True), ()))
    return out


def logistic(rows: list[np.ndarray], y: np.ndarray, size: int, penalty: float = 0.004, steps: int = 400) -> tuple[np.ndarray, float]:
    """L2-penalised logistic regression on sets of features, by accelerated gradient steps."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    feature = np.concatenate(rows).astype(np.int64) if rows else np.zeros(0, np.int64)
    w, b = np.zeros(size), float(log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    v, u, momentum = w.copy(), b, 0.0
    widest = max(1, max((len(r) for r in rows), default=1))
    rate = 4.0 / (widest / 8 + 1)
    n = len(y)
    scale = np.sqrt(np.maximum(np.bincount(feature, minlength=size), 1) / n)     # rare features move as easily
    for step in range(steps):
        z = u + np.bincount(at, v[feature] / scale[feature], minlength=n)
        r = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - y
        g = np.bincount(feature, r[at] / scale[feature], minlength=size) / n + penalty * v / 10
        new_w, new_b = v - rate * g, u - rate * r.mean()
        following = (step + 1) / (step + 4)
        v, u = new_w + following * (new_w - w), new_b + following * (new_b - b)
        w, b = new_w, new_b
    return w / scale, float(b)


def sample_labels(labels: DataFrame, learnable: Column, doc_id: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """(id, y) of about TOXIC_ROWS and CLEAN_ROWS labelled ids at most, a hashed share of each class."""
    rows = labels.where(learnable & F.col(doc_id).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.max(F.col(toxic).cast("int")).alias("y"))
    have = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("y") == 1, F.lit(TOXIC_ROWS / have.get(1, 1))).otherwise(F.lit(CLEAN_ROWS / have.get(0, 1)))
    return rows.where(hash_share(F.col("id"), share))


def fit(docs: DataFrame, labels: DataFrame, learnable: Column, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Classifier:
    spark = docs.sparkSession
    chars = fit_char_model(docs, text)
    rows = keep(docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(
        F.broadcast(sample_labels(labels, learnable, doc_id, toxic)), "id"))                # about TOXIC_ROWS + CLEAN_ROWS
    classes = {r.y: r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = classes.get(1, 0), classes.get(0, 0)
    if not n1 or not n0:
        return Classifier(chars, Weights({}, np.zeros(0), 0.0, False))
    known = spark.sparkContext.broadcast({(r.unit, r.spaced): _string_features(r.words) for r in restored(rows.select("text"), chars).collect()})

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            for t, y in zip(strings(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                found = sorted(gather(t, _string_features, known.value, memo))
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(np.full(len(found), y, np.int32))], names=["f", "y"])

    counts = rows.select("text", "y").mapInArrow(words, "f string, y int").groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    a, b = F.col("a"), F.col("b")
    p, q = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
    best = counts.where((a >= SUPPORT) & (p > 2 * q)).select("f").collect()               # from the bounded sample of texts
    places = {f: i for i, f in enumerate(sorted(r.f for r in best))}

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for batch in batches:
            found = [sorted(places[f] for f in gather(t, _string_features, known.value, memo) if f in places) for t in strings(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32())), batch.column(2)], names=["y", "found", "id"])

    data = rows.select("text", "y", "id").mapInArrow(vectors, "y int, found array<int>, id bigint").toPandas().sort_values("id")
    weights, bias = logistic([np.asarray(f, np.int64) for f in data["found"]], data["y"].to_numpy(float), len(places))
    return Classifier(chars, Weights(places, weights, bias, True))


def score(docs: DataFrame, model: Classifier, text: str = "text", output: str = "score") -> DataFrame:
    """The columns of docs with their score, which replaces a column of its name.

    The disguised units with features reach every executor if they are few, and the texts by a join on the text's digest otherwise.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model.weights)
    columns = carried(docs, [output])
    schema = ddl(docs, columns, {output: "double"})
    own = unused(docs)
    rows = docs.select(*[docs[quoted(c)] for c in columns], docs[quoted(text)].alias(own + "text"))
    texts = rows.select(F.col(own + "text").alias("text"))

    def unit_features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shared.value.of_words(w) for w in batch.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), found], names=["unit", "spaced", "found"])

    def text_units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                found = set(_new_units(t, set()))
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.string()), pa.array([u for u, _ in found], pa.string()),
                                                  pa.array([s for _, s in found], pa.bool_())], names=["key", "unit", "spaced"])

    known, extra = context.broadcast({}), F.lit(None).cast("array<int>")
    if model.weights.trained:
        units = keep(restored(texts, model.chars).mapInArrow(unit_features, "unit string, spaced boolean, found array<int>").where("size(found) > 0"))
        bytes_ = units.agg(F.sum(F.octet_length("unit") + 8 * F.size("found") + 100)).first()[0] or 0
        if bytes_ <= SENT_BYTES:
            known = context.broadcast({(r.unit, r.spaced): tuple(r.found) for r in units.collect()})
        else:
            pairs = texts.select(F.sha2("text", 256).alias("key"), "text").where("text is not null").mapInArrow(
                text_units, "key string, unit string, spaced boolean").distinct()
            found = (pairs.join(units, ["unit", "spaced"]).groupBy(F.col("key").alias(own + "key"))
                     .agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias(own + "found")))
            rows = rows.join(found, F.sha2(own + "text", 256) == F.col(own + "key"), "left")
            extra = F.col(own + "found")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        weights = shared.value
        for batch in batches:
            scores = [weights.score(gather(t, weights.of_words, known.value, memo).union(more or ()))
                      for t, more in zip(strings(batch.column(len(columns))), batch.column(len(columns) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(columns)], pa.array(scores, pa.float64())], names=[*columns, output])

    return rows.select(*map(quoted, columns), own + "text", extra.alias(own + "more")).mapInArrow(run, schema)
