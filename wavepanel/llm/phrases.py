"""Operator 13: phrase collocations by best-first branch and bound over word prefixes.

A phrase grows to the right from its first word. With n words in a language, cutting a phrase q of count a behind its first word w gives
1000 a n / (f(w) f(rest)), and f(rest) is at least a, so no phrase that begins with w scores above 1000 n / f(w). That bound is admissible,
and words are expanded best bound first:

1. All words are counted once, then all pairs of frequent words into a table of BUCKETS counters, which tells for a pair that it may be frequent or that it is not.
2. Each language opens its words in the order of their bounds, the rarest first, until they make up a share of its occurrences; a stage grows every open
   word into phrases whose words and neighbouring pairs may all be frequent, and drops those below the least count. Where the table of pairs is too full to tell, and in
   the last stage, where the commonest words open, phrases grow word by word instead, each level from the frequent prefixes.
3. One more pass counts the ends of the found phrases, which need not begin with an open word, and sees whether all occurrences of a phrase stand behind
   the same word or before the same word. If so the phrase is part of a longer one of equal count and is dropped.
4. A language is settled when the limit of surviving phrases scores above the bound of its best unopened word: whatever begins there scores no more, so ties at the
   last place are complete. Languages that are not settled open all their other words in a second stage.

A pass reads whole texts and counts phrases in blocks before anything is shuffled. What to count is sent as bitmaps of hashes of at most MAP_BITS bits: a
false hit costs a counted phrase that the least count or a join removes, a miss cannot happen. Counts belong to phrases as strings; within a block, and for
neighbours, words are equal if their 64-bit hashes are. Scores are computed in decimals.

A-Z count as a-z; pieces end at [.,;:!?\\x0A-\\x0D] and words are [^\\x20\\x09]+ within them. Null languages count as und, null and empty texts have no words,
rows count as often as they stand in the table, other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.llm.blocks import LOWER, mix, ragged, run_hashes, span_hashes, text_blocks
from wavepanel.llm.store import keep

#: Words of the longest phrase, least count of a candidate, phrases reported per language.
LONGEST, LEAST, LIMIT = 5, 100, 2000
#: Shares of a language's word occurrences that the opened words make up, stage by stage.
SHARES = (0.25, 1.0)
#: Bits of a bitmap at most (16 MB); counters of pairs and the parts in which they are added up.
MAP_BITS, BUCKET_BITS, SLICES = 27, 22, 64
#: Place of the second probe in a hash.
SECOND = 27
#: Share of pair counters that may be frequent up to which all lengths are grown at once.
FULL = 0.25
#: Bytes of texts worked on at once, words of a task merged together.
BLOCK_BYTES, MERGED = 1 << 20, 400_000
#: The languages still open are sent to all tasks if they are so many at most.
SENT_LANGUAGES = 10_000

_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".,;:!?"] + list(range(10, 14))] = True
_SOLID = ~_BREAK
_SOLID[[9, 32]] = False
_PLAIN = LOWER.copy()
_PLAIN[9] = 32

COUNTED = "lang string, phrase string, h bigint, n bigint"
_SEEN = ("left", "right")
WATCHED = COUNTED + "".join(f", {c}_low bigint, {c}_high bigint" for c in _SEEN)
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


class Block:
    """The words of some texts: places in the lower-case bytes, hashes, the piece and the language of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: list[str]):
        self.data = _PLAIN[np.insert(data, offsets[1:-1], 10)]              # a line break between two texts
        edge = np.diff(_SOLID[self.data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.size = len(self.starts)
        self.piece = np.searchsorted(np.flatnonzero(_BREAK[self.data]), self.starts)
        self.names, code = np.unique(np.array(langs, object).astype(str), return_inverse=True) if langs else (np.zeros(0, str), np.zeros(0, np.int64))
        self.lang = code[np.searchsorted(offsets[:-1] + np.arange(len(langs)), self.starts, "right") - 1] if self.size else np.zeros(0, np.int64)
        salt = np.array([int.from_bytes(md5(x.encode()).digest()[:8], "little") for x in self.names.tolist()], np.uint64)
        self.salt = salt[self.lang]
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        self._windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether the run of so many words at each place lies in one piece, and its hash within its language."""
        if words not in self._windows:
            n = self.size - words + 1
            self._windows[words] = ((np.zeros(0, bool), np.zeros(0, np.uint64)) if n <= 0 else
                                    (self.piece[:n] == self.piece[words - 1:], mix(run_hashes(self.hashes, words) ^ self.salt[:n])))
        return self._windows[words]

    def groups(self, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs at these places: a first place of each distinct one, its count, and the group of each place."""
        group, distinct = pd.factorize(self.windows(words)[1][at])
        first = np.empty(len(distinct), np.int64)
        first[group[::-1]] = at[::-1]
        return first, np.bincount(group, minlength=len(distinct)), group

    def columns(self, at: np.ndarray, words: int, n: np.ndarray) -> list[pa.Array]:
        """lang, phrase, h and n of the runs at these places."""
        begin, end = self.starts[at], self.ends[at + words - 1]
        single = np.ones(len(at), bool)
        for k in range(words - 1):
            single &= self.starts[at + k + 1] - self.ends[at + k] == 1
        bounds = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
        text = self.data[ragged(begin, end - begin)]
        phrase = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(text)).cast(pa.string())
        if not single.all():                                                # several blanks between two words
            phrase = pa.array([x if one else self._spelt(i, words) for x, one, i in zip(phrase.to_pylist(), single.tolist(), at.tolist(), strict=True)], pa.string())
        return [pa.array(self.names[self.lang[at]].tolist(), pa.string()), phrase, pa.array(self.windows(words)[1][at].view(np.int64)), pa.array(n.astype(np.int64))]

    def _spelt(self, at: int, words: int) -> str:
        return b" ".join(self.data[self.starts[at + k]:self.ends[at + k]].tobytes() for k in range(words)).decode()


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of the batches (text, lang)."""
    for rows, data, offsets in text_blocks(batches, "text", BLOCK_BYTES):
        yield Block(data, offsets, rows.column(1).to_pylist())


# --- bitmaps of phrases ---

class Bitmap:
    """One bit for each value of the leading bits of a hash, and with two probes one more for bits further on."""

    def __init__(self, bits: int, cells: np.ndarray, probes: int):
        self.shift, self.cells, self.probes = np.uint64(64 - bits), cells, probes

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = self._probe(h >> self.shift)
        return found & self._probe((h << np.uint64(SECOND)) >> self.shift) if self.probes == 2 else found

    def _probe(self, bit: np.ndarray) -> np.ndarray:
        return (self.cells[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def bitmap(phrases: DataFrame):
    """A broadcast bitmap of the column h of a kept table. At most 2^MAP_BITS bits reach the driver, however many phrases there are."""
    spark = phrases.sparkSession
    bits = min(MAP_BITS, max(16, int(phrases.count()).bit_length() + 6))
    probes = F.array(F.shiftrightunsigned("h", 64 - bits), F.shiftrightunsigned(F.shiftleft("h", SECOND), 64 - bits))
    found = phrases.select(F.explode(probes).alias("bit")).groupBy(F.shiftright("bit", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("value")).toPandas()
    cells = np.zeros(1 << bits >> 6, np.uint64)
    cells[found["cell"].to_numpy(np.int64)] = found["value"].to_numpy(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(Bitmap(bits, cells, 2))


def pair_bitmap(texts: DataFrame, frequent, least: int):
    """A broadcast bitmap of the pairs of frequent words that may be frequent, and the share of its bits that are set.

    Each task counts pairs by the leading bits of their hash up to the least count, so a counter is one or two bytes and a sum of counters reaches the
    least count exactly if that of the pairs does.
    """
    kind = np.uint8 if least < 256 else np.uint32
    part = 1 << BUCKET_BITS >> SLICES.bit_length() - 1

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(1 << BUCKET_BITS, kind), [], 0

        def add() -> None:
            more = np.bincount(np.concatenate(held), minlength=1 << BUCKET_BITS)
            counts[:] = np.minimum(counts + more, least)

        for block in blocks(batches):
            whole, h = block.windows(2)
            if len(h):
                known = frequent.value.holds(block.windows(1)[1])
                held.append((h[whole & known[:-1] & known[1:]] >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
                size += len(held[-1])
            if size > 2_000_000:
                add()
                held, size = [], 0
        if held:
            add()
        packer = zstandard.ZstdCompressor(level=1)
        for i in range(SLICES):
            mine = counts[i * part:(i + 1) * part]
            if mine.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packer.compress(mine.tobytes())])], names=["slice", "counts"])

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind).astype(np.int64)
                sums[i] = np.minimum(sums[i] + more, least) if i in sums else more
        for i, n in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.packbits(n >= least, bitorder="little").tobytes()])], names=["slice", "counts"])

    schema = "slice int, counts binary"
    found = texts.mapInArrow(count, schema).repartition(SLICES, "slice").mapInArrow(total, schema).collect()
    cells = np.zeros(1 << BUCKET_BITS >> 6, np.uint64)
    for row in found:
        cells[row["slice"] * part >> 6:(row["slice"] + 1) * part >> 6] = np.frombuffer(row["counts"], "<u8")
    share = float(np.unpackbits(cells.view(np.uint8)).mean())
    return texts.sparkSession.sparkContext.broadcast(Bitmap(BUCKET_BITS, cells, 1)), share


# --- passes over the texts ---

_NAMES = ["lang", "phrase", "h", "n"]


def _emit(block: Block, words: int, at: np.ndarray) -> pa.RecordBatch:
    first, n, _ = block.groups(at, words)
    return pa.RecordBatch.from_arrays(block.columns(first, words, n), names=_NAMES)


def _merged(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts, and extremes where there are some, of many blocks put together within a task."""
    held, size = [], 0

    def settle() -> pa.Table:
        names = held[0].schema.names
        how = [(c, "sum" if c == "n" else "min" if c.endswith("_low") else "max") for c in names[3:]]
        found = pa.Table.from_batches(held).group_by(["lang", "phrase", "h"]).aggregate(how)
        return found.select([*names[:3], *(f"{c}_{f}" for c, f in how)]).rename_columns(names).combine_chunks()

    for batch in rows:
        held.append(batch)
        size += batch.num_rows
        if size >= MERGED:
            table = settle()
            if table.num_rows > MERGED // 2:
                yield from table.to_batches()
                held, size = [], 0
            else:
                held, size = table.to_batches(), table.num_rows
    if held:
        yield from settle().to_batches()


def _count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _merged(_emit(block, 1, np.arange(block.size)) for block in blocks(batches))


def _grow(sizes: tuple[int, ...], prefixes, suffixes, frequent, pairs):
    """Phrases of so many words: an open prefix of the shortest size less one, words and pairs behind it that may be frequent, and where suffixes are
    given the same of the words but the first."""
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            if block.size < sizes[0]:
                continue
            together = block.windows(2)[0] & frequent.value.holds(block.windows(1)[1])[1:] & pairs.value.holds(block.windows(2)[1])
            shorter = block.windows(sizes[0] - 1)[1]
            go = prefixes.value.holds(shorter[:-1])
            if suffixes is not None:
                go &= suffixes.value.holds(shorter[1:])
            for words in sizes:
                if block.size < words:
                    break
                go = go[:block.size - words + 1]
                for k in range(words - 2, words - 1) if words > sizes[0] else range(words - 1):           # the longer ones go on from the shorter
                    go = go & together[k:k + len(go)]
                at = np.flatnonzero(go)
                if len(at):
                    yield _emit(block, words, at)

    return lambda batches: _merged(found(batches))


def _watch(wanted):
    """Phrases of 2 words and more that are wanted, with the extremes of the hashes of the words before and behind them."""
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            for words in range(2, LONGEST + 1):
                whole, h = block.windows(words)
                at = np.flatnonzero(whole & wanted.value.holds(h))
                first, n, group = block.groups(at, words)
                columns = block.columns(first, words, n)
                value = block.hashes.view(np.int64)
                for side in (at - 1, at + words):
                    inside = (side >= 0) & (side < block.size)
                    inside[inside] = block.piece[side[inside]] == block.piece[at[inside]]
                    open_end = np.bincount(group[~inside], minlength=len(first)) > 0
                    low, high = np.full(len(first), _HIGH), np.full(len(first), _LOW)
                    np.minimum.at(low, group[inside], value[side[inside]])
                    np.maximum.at(high, group[inside], value[side[inside]])
                    low[open_end], high[open_end] = _LOW, _HIGH              # an occurrence without a neighbour keeps them apart for good
                    columns += [pa.array(low), pa.array(high)]
                yield pa.RecordBatch.from_arrays(columns, names=[*_NAMES, *[f"{c}_{x}" for c in _SEEN for x in ("low", "high")]])

    return lambda batches: _merged(found(batches))


def _bound(n: Column, count: Column) -> Column:
    """floor(1000 n / count) without overflow."""
    return F.floor(F.lit(1000).cast("decimal(5,0)") * n.cast("decimal(20,0)") / count.cast("decimal(20,0)"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(lang, phrase, h, n) of all words of a table (text, lang), kept."""
    return keep(texts.mapInArrow(_count_words, COUNTED).groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n")))


def _limits(words: DataFrame, totals: DataFrame, share: float, least: int) -> DataFrame:
    """(lang, most): the largest count of a word to open, so that opened words make up about that share of the occurrences of frequent words, one
    band of counts (a sixteenth of an octave) at least."""
    band = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    bands = words.where(F.col("n") >= least).groupBy("lang", band.alias("band")).agg(F.sum("n").alias("mass"), F.max("n").alias("most"))
    order = Window.partitionBy("lang").orderBy("band")
    bands = bands.withColumn("below", F.sum("mass").over(order) - F.col("mass")).join(totals, "lang")
    return bands.where(F.col("below") <= F.col("total") * share).groupBy("lang").agg(F.max("most").alias("most"))


def _scored(candidates: DataFrame, counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score): the cut of the lowest score, the first of equal ones."""
    w = F.split("phrase", " ")
    cuts = candidates.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(w) - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(w, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(w, F.col("k") + 1, F.size(w)), " ").alias("rest"))
    known = counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    cuts = (cuts.join(known.withColumnRenamed("part", "first").withColumnRenamed("f", "l"), ["lang", "first"])
            .join(known.withColumnRenamed("part", "rest").withColumnRenamed("f", "r"), ["lang", "rest"]).join(totals, "lang"))
    wide = "decimal(38,0)"
    score = F.expr(f"(cast(1000 as {wide}) * a * total) div (cast(l as {wide}) * r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "total")).alias("b"))
    return best.select("lang", "phrase", "b.a", "b.l", "b.r", F.col("b.total").alias("n"), "b.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, limit: int = LIMIT,
                 shares: tuple[float, ...] = SHARES) -> DataFrame:
    """The first phrases of each language by score, count and phrase: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang), F.lit("und")).alias("lang")).where("text is not null and text <> ''")
    words = word_counts(texts)
    totals = keep(words.groupBy("lang").agg(F.sum("n").alias("total")))
    frequent = keep(words.where(F.col("n") >= least))
    frequent_map = bitmap(frequent)
    pairs, fill = pair_bitmap(texts, frequent_map, least)
    opened = keep(frequent.groupBy("lang").agg(F.lit(0).cast("bigint").alias("done")))      # largest count opened so far
    found: list[DataFrame] = []                                                             # candidates of the stages
    watched: list[DataFrame] = []
    settled = None
    for share in shares:
        to_open = _limits(words, totals, share, least).join(opened, "lang") if share < 1 else (
            frequent.groupBy("lang").agg(F.max("n").alias("most")).join(opened, "lang"))
        to_open = keep(to_open.where("most > done"))
        if to_open.isEmpty():
            break
        still = to_open.select("lang")
        rows = texts.join(F.broadcast(still) if still.count() <= SENT_LANGUAGES else still, "lang", "left_semi").select("text", "lang")
        level = keep(frequent.join(to_open, "lang").where("n > done and n <= most").select("lang", "phrase", "h", "n"))
        new = []
        every = tuple(range(2, LONGEST + 1))
        for sizes in [every] if share < 1 and fill <= FULL else [(size,) for size in every]:
            suffixes = None
            if len(sizes) == 1 and sizes[0] > 2 and share >= 1:  # every word is open now, so the end of a phrase is a phrase found
                known = [level, *(f.where(F.size(F.split("phrase", " ")) == sizes[0] - 1) for f in found)]
                suffixes = bitmap(reduce(DataFrame.unionByName, known).select("h"))
            grown = rows.mapInArrow(_grow(sizes, bitmap(level), suffixes, frequent_map, pairs), COUNTED).groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"))
            level = keep(grown.where(F.col("n") >= least))
            new.append(level)
        new = keep(reduce(DataFrame.unionByName, new))
        found.append(new)
        wanted = _wanted(new)
        extremes = [f(f"{c}_{x}").alias(f"{c}_{x}") for c in _SEEN for f, x in ((F.min, "low"), (F.max, "high"))]
        watched.append(keep(rows.mapInArrow(_watch(bitmap(wanted)), WATCHED).groupBy("lang", "phrase", "h").agg(F.sum("n").alias("n"), *extremes)))
        # a later stage may watch an end again; its numbers are the same
        seen = reduce(DataFrame.unionByName, watched).dropDuplicates(["lang", "phrase"])
        counts = keep(seen.select("lang", "phrase", "n").unionByName(frequent.select("lang", "phrase", "n")))
        closed = [F.col(f"{side}_low") == F.col(f"{side}_high") for side in _SEEN]
        part = seen.where(closed[0] | closed[1]).where(F.size(F.split("phrase", " ")) < LONGEST).select("lang", "phrase")
        candidates = reduce(DataFrame.unionByName, found).join(part, ["lang", "phrase"], "left_anti")
        settled = keep(_scored(candidates, counts, totals))
        # open goes on what could still come: the best word not opened bounds all phrases that begin with it
        opened = keep(opened.join(to_open.select("lang", "most"), "lang", "left").select("lang", F.greatest("done", F.coalesce("most", "done")).alias("done")))
        ahead = (frequent.join(opened, "lang").where("n > done").groupBy("lang").agg(F.min("n").alias("next")).join(totals, "lang")
                 .select("lang", _bound(F.col("total"), F.col("next")).alias("bound")))
        safe = settled.join(ahead, "lang").where("score > bound").groupBy("lang").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= limit)
        opened = keep(opened.join(safe.select("lang", F.lit(True).alias("safe")), "lang", "left")
                      .select("lang", F.when(F.col("safe"), F.lit((1 << 63) - 1)).otherwise(F.col("done")).alias("done")))
    if settled is None:
        return spark.createDataFrame([], "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return settled.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= limit).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))


def _wanted(found: DataFrame) -> DataFrame:
    """The phrases found and their ends of two words or more, with the hashes that Block gives them; kept."""
    w = F.split("phrase", " ")
    ends = found.select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.array_join(F.slice(w, k, F.size(w)), " "))).alias("text"))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            one = np.flatnonzero(np.diff(block.piece, prepend=-1))
            sizes = np.diff(np.append(one, block.size))
            for size in np.unique(sizes).tolist():
                at = one[sizes == size]
                yield pa.RecordBatch.from_arrays([pa.array(block.windows(size)[1][at].view(np.int64))], names=["h"])

    return keep(ends.distinct().select("text", "lang").mapInArrow(hashed, "h bigint").distinct())
