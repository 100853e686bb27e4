"""Operator 10: remove passages that stand anywhere else, by super-k-mer partitioning.

A window is 35 consecutive words. Its minimiser is the smallest hash among its runs of 8 words, so equal windows have equal
minimisers. Consecutive windows with the same minimiser form a super-k-mer.

1. Every place that is a minimiser is counted by its hash, with partial aggregation. A window whose minimiser stands at one
   place only cannot stand twice; nothing of it travels.
2. The other super-k-mers travel as one packed string each to the bucket of their minimiser. Equal strings are counted
   before the shuffle, so copies of a text are one string with a count. In a bucket the windows are sorted and counted.
3. A minimiser with very many distinct strings is hot: its windows are spread and counted one by one by 128-bit digest.
4. The places of repeated windows go back to their texts, and the words that they cover are removed.

Words are [^\\x20\\x09-\\x0D]+, unchanged; null is no text. Every row counts, so of rows that repeat a text each loses the windows
that the other has. A text is known inside by two 64-bit hashes, so ids may be null or repeat. Texts under 35 words stay whole.
An empty table gives an empty result. Window equality is decided on two independent 64-bit hashes of the 35 words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.blocks import column_buffers, run_hashes, span_hashes, text_blocks, words
from wavepanel.llm.names import carried, ddl, quoted, unused
from wavepanel.llm.store import keep, shuffle_width

WINDOW, MER = 35, 8
#: Distinct strings of one minimiser from which its windows are spread one by one.
HOT_STRINGS = 2000
#: Distinct strings in a bucket on average.
BUCKET_STRINGS = 5_000


def sliding(op: Callable, values: np.ndarray, width: int) -> np.ndarray:
    """op over every run of width values, by doubling."""
    size = 1
    while size * 2 <= width:
        values = op(values[:-size], values[size:])
        size *= 2
    if size < width:
        values = op(values[:len(values) - (width - size)], values[width - size:])
    return values


def window_minimisers(word_hashes: np.ndarray, first: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the run at each word, minimiser of the window at each word, and whether that window lies in one text."""
    n = len(word_hashes)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)
    runs = run_hashes(word_hashes, mer)
    least = sliding(np.minimum, runs, window - mer + 1)
    text_end = np.repeat(first[1:], np.diff(first))
    valid = np.arange(len(least)) + window <= text_end[:len(least)]
    return runs, least, valid


def minimiser_places(runs: np.ndarray, least: np.ndarray, valid: np.ndarray, span: int) -> np.ndarray:
    """Word places whose run is the minimiser of some window that holds it."""
    if not valid.any():
        return np.zeros(0, np.int64)
    guarded = np.zeros(len(runs) + span - 1, np.uint64)
    guarded[span - 1:span - 1 + len(least)] = np.where(valid, least, 0)
    return np.flatnonzero((runs == sliding(np.maximum, guarded, span)) & (runs > 0))


def super_kmers(least: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each run of windows with one minimiser."""
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, np.zeros(0, np.uint64)
    value = least[at]
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (value[1:] != value[:-1])]))
    return at[heads], np.diff(np.append(heads, len(at))), value[heads]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _minimisers(window: int, mer: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(batches, "text"):
            starts, ends, first = words(data, offsets)
            runs, least, valid = window_minimisers(span_hashes(data, starts, ends), first, window, mer)
            at = minimiser_places(runs, least, valid, window - mer + 1)
            doc, mini = np.searchsorted(first, at, "right") - 1, runs[at] if len(at) else np.zeros(0, np.uint64)
            order = np.lexsort((mini, doc))                      # a text that repeats a minimiser gives one row with a count
            doc, mini = doc[order], mini[order]
            heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (mini[1:] != mini[:-1])])) if len(doc) else order
            n = np.diff(np.append(heads, len(doc)))
            doc = pa.array(doc[heads])
            yield pa.RecordBatch.from_arrays([_signed(mini[heads]), rows.column(1).take(doc), rows.column(2).take(doc), pa.array(n, pa.int32())],
                                             names=["mini", "t0", "t1", "n"])
    return run


def _unpacked(batches: Iterable[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of some texts with the packed column as text again."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            at = part.schema.get_field_index(column)
            texts = [unpack.decompress(v) if v else b"" for v in part.column(at).to_pylist()]
            yield part.set_column(at, column, pa.array(texts, pa.large_binary()))


def pack_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column, a text, compressed; the others as they are. Texts travel twice, so they travel small."""
    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, offsets = column_buffers(batch.column(0))
        whole = memoryview(np.ascontiguousarray(data))
        packed = [packer.compress(whole[a:b]) if b > a else b"" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield batch.set_column(0, batch.schema.names[0], pa.array(packed, pa.binary()))


def _strings(window: int, mer: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_blocks(_unpacked(batches, "packed"), "packed"):
            starts, ends, first = words(data, offsets)
            _, least, valid = window_minimisers(span_hashes(data, starts, ends), first, window, mer)
            begin, count, mini = super_kmers(least, valid)
            wanted = rows.column(rows.schema.get_field_index("minis")).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            found = np.isin(mini, wanted)
            begin, count, mini = begin[found], count[found], mini[found]
            doc = np.searchsorted(first, begin, "right") - 1
            whole, strings, digests = data.tobytes(), [], []
            for a, b in zip(starts[begin].tolist(), ends[begin + count + window - 2].tolist(), strict=True):
                string = b" ".join(whole[a:b].split())
                strings.append(string)
                digests.append(md5(string, usedforsecurity=False).digest())
            keys = [rows.column(rows.schema.get_field_index(c)).take(pa.array(doc)) for c in ("t0", "t1")]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(begin - first[doc], pa.int32()), _signed(mini),
                                              pa.array(digests, pa.binary()), pa.array(strings, pa.binary())],
                                             names=["t0", "t1", "start", "mini", "digest", "packed"])
    return run


def _windows_of(strings: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes of every window of the strings, the string of each and its place there."""
    data, offsets = column_buffers(pa.array(strings, pa.large_binary()))
    starts, ends, first = words(data, offsets)
    counts = np.diff(first) - window + 1
    string = np.repeat(np.arange(len(strings)), counts)
    place = np.arange(len(string)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = first[:-1][string] + place
    both = [run_hashes(span_hashes(data, starts, ends, f), window, f)[at] for f in (0, 1)]
    return both[0], both[1], string, place


def _ranges(string: np.ndarray, place: np.ndarray, window: int) -> dict[int, list[int]]:
    """Per string the covered words as from, to, from, to, ...; string and place are sorted."""
    if not len(string):
        return {}
    breaks = np.concatenate([[True], (np.diff(string) != 0) | (np.diff(place) != 1)])
    heads = np.flatnonzero(breaks)
    lasts = np.append(heads[1:], len(string)) - 1
    out: dict[int, list[int]] = {}
    for s, a, b in zip(string[heads].tolist(), place[heads].tolist(), (place[lasts] + window).tolist(), strict=True):
        out.setdefault(s, []).extend((a, b))
    return out


def _count_bucket(window: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        h0, h1, string, place = _windows_of(rows["packed"].tolist(), window)
        order = np.lexsort((h1, h0))
        a, b = h0[order], h1[order]
        heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        total = np.add.reduceat(rows["n"].to_numpy(np.int64)[string[order]], heads)
        often = np.zeros(len(order), bool)
        often[order] = np.repeat(total >= 2, np.diff(np.append(heads, len(order))))
        found = _ranges(string[often], place[often], window)
        return pd.DataFrame({"digest": rows["digest"].iloc[list(found)].tolist(), "covered": list(found.values())})
    return run


def _spread(window: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                h0, h1, string, place = _windows_of(part.column(1).to_pylist(), window)
                string = pa.array(string)
                yield pa.RecordBatch.from_arrays([part.column(0).take(string), pa.array(place, pa.int32()), _signed(h0), _signed(h1),
                                                  part.column(2).take(string)], names=["digest", "place", "h0", "h1", "n"])
    return run


def repeated_windows(docs: DataFrame, window: int = WINDOW, mer: int = MER) -> DataFrame:
    """docs: packed (compressed text), t0, t1, text. Returns t0, t1 and places: array of (start, covered) per text with repeats."""
    spark = docs.sparkSession
    minis = keep(docs.select("text", "t0", "t1").mapInArrow(_minimisers(window, mer), "mini bigint, t0 bigint, t1 bigint, n int"))
    shared = keep(minis.groupBy("mini").agg(F.sum("n").alias("n")).where("n > 1").select("mini"))
    wanted = minis.join(shared, "mini", "left_semi").groupBy("t0", "t1").agg(F.collect_set("mini").alias("minis"))
    packed = docs.select("text", "t0", "t1").mapInArrow(pack_texts, "packed binary, t0 bigint, t1 bigint")
    places = keep(packed.join(wanted, ["t0", "t1"]).mapInArrow(
        _strings(window, mer), "t0 bigint, t1 bigint, start int, mini bigint, digest binary, packed binary"))
    strings = keep(places.groupBy("mini", "digest", "packed").agg(F.count(F.lit(1)).alias("n")))
    hot = keep(strings.groupBy("mini").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > HOT_STRINGS).select("mini"))
    buckets = max(shuffle_width(spark), -(-strings.count() // BUCKET_STRINGS))
    calm = (strings.join(hot, "mini", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("mini"), F.lit(buckets)))
            .select("bucket", "digest", "packed", "n").groupBy("bucket").applyInPandas(_count_bucket(window), "digest binary, covered array<int>"))
    single = strings.join(hot, "mini", "left_semi").select("digest", "packed", "n").mapInArrow(
        _spread(window), "digest binary, place int, h0 bigint, h1 bigint, n bigint")
    often = single.groupBy("h0", "h1").agg(F.sum("n").alias("n")).where("n > 1").select("h0", "h1")
    spread = (single.join(often, ["h0", "h1"], "left_semi").groupBy("digest").agg(F.sort_array(F.collect_set("place")).alias("p"))
              .select("digest", F.flatten(F.transform("p", lambda p: F.array(p, p + window))).alias("covered")))
    covered = keep(calm.unionByName(spread))
    return (places.select("t0", "t1", "start", "digest").join(covered, "digest")
            .groupBy("t0", "t1").agg(F.collect_set(F.struct("start", "covered")).alias("places")))


def _remove(columns: list[str], outputs: list[str], packed: str, places_column: str, join_untouched: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches, packed):
            texts = batch.column(batch.schema.get_field_index(packed)).to_pylist()
            places = batch.column(batch.schema.get_field_index(places_column)).to_pylist()
            kept, n_words, n_removed = [], [], []
            for text, own in zip(texts, places, strict=True):
                parts = text.split()
                n_words.append(len(parts))
                if own:
                    gone = np.zeros(len(parts) + 1, np.int64)
                    for p in own:
                        at = np.array(p["covered"], np.int64) + p["start"]
                        np.add.at(gone, at[::2], 1)
                        np.add.at(gone, at[1::2], -1)
                    stay = np.cumsum(gone[:-1]) == 0
                    n_removed.append(int((~stay).sum()))
                    parts = [w for w, s in zip(parts, stay.tolist(), strict=True) if s]
                else:
                    n_removed.append(0)
                kept.append((b" ".join(parts) if own or join_untouched else text).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns),
                                              pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=[*columns, *outputs])
    return run


def drop_repeated_passages(docs: DataFrame, text: str = "text", window: int = WINDOW, mer: int = MER,
                           kept_text: str = "kept_text", join_untouched: bool = True, prefix: str = "") -> DataFrame:
    """The columns of docs but the text, with n_words, n_removed and the kept words joined by one space (names after prefix).

    Without join_untouched a text that loses nothing keeps its own white space.
    """
    outputs = {prefix + "n_words": "bigint", prefix + "n_removed": "bigint", prefix + kept_text: "string"}
    columns = carried(docs, outputs, [text])
    own = unused(docs)
    source = F.coalesce(docs[quoted(text)], F.lit(""))
    t0, t1 = F.xxhash64(source), F.xxhash64(F.lit(1), source)
    places = repeated_windows(docs.select(source.alias("text"), t0.alias("t0"), t1.alias("t1")), window, mer)
    renamed = docs.select(source.alias(own + "packed"), t0.alias(own + "t0"), t1.alias(own + "t1"), *[docs[quoted(c)] for c in columns])
    packed = renamed.mapInArrow(pack_texts, ", ".join([f"{own}packed binary", f"{own}t0 bigint", f"{own}t1 bigint", ddl(docs, columns, {})]).rstrip(", "))
    places = places.withColumnsRenamed({c: f"{own}p_{c}" for c in ("t0", "t1", "places")})
    joined = packed.join(places, (F.col(own + "t0") == F.col(own + "p_t0")) & (F.col(own + "t1") == F.col(own + "p_t1")), "left")
    return joined.select(own + "packed", own + "p_places", *[F.col(quoted(c)) for c in columns]).mapInArrow(
        _remove(columns, list(outputs), own + "packed", own + "p_places", join_untouched), ddl(docs, columns, outputs))
