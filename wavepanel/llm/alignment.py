"""Operator 11: alignment of the tokens of two tokenizers.

Each text is encoded with a blank in front by a byte-level BPE (A) and by a piece model (B, which adds that blank itself). Where the joined
bytes of both are those of blank + text, the tokens of each side tile the same bytes:

1. Per block of texts pandas.merge_asof, keyed by text, finds for the start of each A token the B token that covers it, and for the start of each B token
   the A token that covers it. The union of both directions is the set of overlapping pairs; pairs that start together are in both and taken once.
   Where tokens of both sides end together a group ends.
2. A block sends each of its distinct id pairs once, with the number of its texts that hold it linked; the sums over all blocks are the counts of the pairs.
3. The counts go back to the blocks that hold the pair, each once, and every text adds up its own links there.

A block is about BLOCK_BYTES of whole texts (a longer text is its own block), so no group grows with the table; a pair that stands everywhere is one row per
block. Texts that are null, empty or not reproduced by a tokenizer have no tokens: zeros and an empty digest. Special tokens written in a text are plain text. Rows
with repeated or missing ids are rows of their own and each counts as a document; outputs replace columns of their names, other columns stay. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import replace
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.blocks import ragged, text_blocks
from wavepanel.llm.bpe import Vocabulary, checked_encode, vocabulary
from wavepanel.llm.names import carried, ddl, quoted, unused
from wavepanel.llm.store import keep

#: Bytes of texts whose pairs travel together, and bytes encoded at once.
BLOCK_BYTES, ENCODE_BYTES = 2 << 20, 1 << 19
#: An id pair is a * PAIR + b.
PAIR = 1 << 20
OUTPUTS = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "n_best": "bigint", "count_sum": "bigint", "groups_sha256": "string"}


@lru_cache(maxsize=2)
def plain(path: str) -> Vocabulary:
    """The byte-level vocabulary without its special tokens."""
    return replace(vocabulary(path), specials=())


class Pieces:
    """The piece model with the bytes of each of its ids: U+2581 is a blank, <0xHH> a byte, other pieces are UTF-8."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.vocab_size()
        spelt = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
                 for i, p in enumerate(map(self.model.id_to_piece, range(size)))]
        self.token_offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelt])]).astype(np.int64)
        self.token_bytes = np.frombuffer(b"".join(spelt), np.uint8)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def spelled(ids: np.ndarray, table) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids one after the other, and where those of each begin (one more at the end)."""
    lengths = table.token_offsets[ids + 1] - table.token_offsets[ids]
    return table.token_bytes[ragged(table.token_offsets[ids], lengths)], np.concatenate([[0], np.cumsum(lengths)])


class Side:
    """The tokens of one tokenizer over the texts of a block: ids, the text of each, start and end in the bytes of the block."""

    def __init__(self, ids: np.ndarray, firsts: np.ndarray, table, data: np.ndarray, offsets: np.ndarray):
        said, at = spelled(ids, table)
        texts = len(offsets) - 1
        begin = at[firsts]
        fits = np.diff(begin) == np.diff(offsets)
        if len(said) == len(data) and fits.all():
            same = np.flatnonzero(said != data)
            fits[np.searchsorted(offsets, same, "right") - 1] = False
        else:
            for i in np.flatnonzero(fits).tolist():
                fits[i] = np.array_equal(said[begin[i]:begin[i + 1]], data[offsets[i]:offsets[i + 1]])
        self.fits = fits
        self.ids = ids
        self.text = np.repeat(np.arange(texts), np.diff(firsts))
        self.start = at[:-1] - begin[self.text] + offsets[self.text]
        self.end = at[1:] - begin[self.text] + offsets[self.text]

    def only(self, texts: np.ndarray) -> None:
        stay = texts[self.text] if len(self.ids) else np.zeros(0, bool)
        self.ids, self.text, self.start, self.end = self.ids[stay], self.text[stay], self.start[stay], self.end[stay]

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame({"text": self.text, "at": self.start})


def covering(of: Side, by: Side) -> np.ndarray:
    """For the start of each token of one side the token of the other side that covers it."""
    found = pd.merge_asof(of.frame(), by.frame().assign(token=np.arange(len(by.ids))), on="at", by="text", direction="backward")
    return found["token"].to_numpy(np.int64)


@lru_cache(maxsize=2)
def _decimals(size: int) -> np.ndarray:
    """Decimal digits of the ids, one row each; 0 fills up."""
    return np.array([str(i) for i in range(size)], "S7").view(np.uint8).reshape(size, 7)


def group_texts(a: Side, b: Side, shared_a: np.ndarray, shared_b: np.ndarray, texts: int) -> list[str]:
    """Digest of the groups of each text; empty for texts without tokens. shared_*: tokens that end with one of the other side."""
    group_a = np.cumsum(shared_a) - shared_a
    group_b = np.cumsum(shared_b) - shared_b
    ids, group = np.concatenate([a.ids, b.ids]), np.concatenate([group_a, group_b])
    if not len(ids):
        return [""] * texts
    text = np.concatenate([a.text, b.text])
    mark = np.full(len(ids), ord(","), np.uint8)
    mark[:len(a.ids)][shared_a] = ord("|")
    mark[len(a.ids):][shared_b] = ord(";")
    order = np.argsort(group * 2 + (np.arange(len(ids)) >= len(a.ids)), kind="stable")
    rows = np.concatenate([_decimals(1 << int(ids.max()).bit_length())[ids[order]], mark[order][:, None]], 1)
    filled = rows != 0
    ends = np.concatenate([[0], np.cumsum(filled.sum(1))])
    out = rows[filled].tobytes()
    last = ends[np.searchsorted(text[order], np.arange(texts + 1))].tolist()
    return [sha256(out[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(last[:-1], last[1:], strict=True)]


def align(texts: list[str], path_a: str, path_b: str) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """One row per text (n_a, n_b, n_groups, n_links, groups_sha256), and the links as arrays: text and id pair of each."""
    spelt = [b" " + t.encode() if t else b"" for t in texts]
    data = np.frombuffer(b"".join(spelt), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in spelt])]).astype(np.int64)
    ids_a, first_a, _, _ = checked_encode(data, offsets, plain(path_a))
    lists = pieces(path_b).encode([t or "" for t in texts])
    first_b = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    ids_b = np.fromiter(chain.from_iterable(lists), np.int64, first_b[-1])
    a, b = Side(ids_a, first_a, plain(path_a), data, offsets), Side(ids_b, first_b, pieces(path_b), data, offsets)
    whole = a.fits & b.fits & (np.diff(offsets) > 0)
    a.only(whole)
    b.only(whole)
    n = len(texts)
    over_a, over_b = covering(a, b), covering(b, a)
    later = b.start != a.start[over_b]                           # starts in common are links of the first direction already
    text = np.concatenate([a.text, b.text[later]])
    pair = np.concatenate([a.ids * PAIR + b.ids[over_a], a.ids[over_b[later]] * PAIR + b.ids[later]])
    shared_a, shared_b = np.isin(a.end, b.end, assume_unique=True), np.isin(b.end, a.end, assume_unique=True)
    rows = pd.DataFrame({"n_a": np.bincount(a.text, minlength=n), "n_b": np.bincount(b.text, minlength=n),
                         "n_groups": np.bincount(a.text[shared_a], minlength=n), "n_links": np.bincount(text, minlength=n)})
    rows["groups_sha256"] = group_texts(a, b, shared_a, shared_b, n)
    return rows, text, pair


def _pack(values: np.ndarray, times: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(values, prepend=0), times]).astype("<i4").tobytes())


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "<i4").reshape(2, -1)
    return np.cumsum(both[0]), both[1]


def _encode(path_a: str, path_b: str, columns: list[str], own: str):
    """Rows of texts (pairs empty) and one row per block (pairs and the number of texts that hold each linked)."""
    names = [*columns, *(own + c for c in ("block", "links")), *(own + c for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")),
             own + "pairs", own + "texts"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            at = batch.schema.get_field_index(own + "text")
            for rows, _, offsets in text_blocks([batch], own + "text", BLOCK_BYTES):
                found, text, pair = [], [], []
                for part, _, inner in text_blocks([rows], own + "text", ENCODE_BYTES):
                    one, t, p = align(part.column(at).to_pylist(), path_a, path_b)
                    text.append(t + sum(map(len, found)))
                    pair.append(p)
                    found.append(one)
                info = pd.concat(found, ignore_index=True)
                code, distinct = pd.factorize(np.concatenate(pair), sort=True)
                held, times = np.unique(np.concatenate(text) * max(1, len(distinct)) + code, return_counts=True)
                owner, code = np.divmod(held, max(1, len(distinct)))
                cut = np.searchsorted(owner, np.arange(rows.num_rows + 1)).tolist()
                links = [_pack(code[x:y], times[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                n = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(i) for i in range(len(columns))], pa.array(np.full(n, block)), pa.array(links, pa.binary()),
                     *[pa.array(info[c]) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(info["groups_sha256"], pa.string()),
                     pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
                yield pa.RecordBatch.from_arrays(
                    [*[pa.nulls(1, rows.column(i).type) for i in range(len(columns))], pa.array([block]), pa.nulls(1, pa.binary()),
                     *[pa.nulls(1, pa.int64())] * 4, pa.nulls(1, pa.string()), pa.array([distinct], pa.list_(pa.int64())),
                     pa.array([np.bincount(code, minlength=len(distinct))], pa.list_(pa.int64()))], names=names)
                block += 1
    return run


def align_tokens(docs: DataFrame, path_a: str, path_b: str, text: str = "text", columns: Iterable[str] | None = None,
                 pairs: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The named columns of docs (all by default) with OUTPUTS; with pairs also the kept table (a, b, n, best) of all linked id pairs."""
    own = unused(docs)
    columns = [c for c in carried(docs, OUTPUTS) if columns is None or c in set(columns)]
    inner = {"block": "bigint", "links": "binary", **{c: OUTPUTS[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")},
             "pairs": "array<bigint>", "texts": "array<bigint>"}
    source = docs.select(*[docs[quoted(c)] for c in columns], docs[quoted(text)].alias(own + "text"))
    table = keep(source.mapInArrow(_encode(path_a, path_b, columns, own), ddl(docs, columns, {own + c: t for c, t in inner.items()})))
    rows = table.where(F.col(own + "links").isNotNull())
    held = table.where(F.col(own + "links").isNull()).select(
        F.col(own + "block").alias("block"), F.explode(F.arrays_zip(F.col(own + "pairs").alias("pair"), F.col(own + "texts").alias("n"))).alias("p")
    ).select("block", "p.pair", "p.n")
    counts = keep(held.groupBy("pair").agg(F.sum("n").alias("n")))
    a = F.shiftright("pair", 20)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))                     # one row per id of A
    counts = keep(counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")))
    back = held.select("block", "pair").join(counts, "pair")
    spare = [own + c for c in ("block", "links")]
    schema = ddl(docs, columns, OUTPUTS)
    first = {c: own + c for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")}

    def add_up(key: tuple, rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        known = known.sort_values("pair")                        # the block's own numbering
        n, best = known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)
        sums, bests = [], []
        for packed in rows[own + "links"]:
            code, times = _unpack(packed)
            sums.append(int((n[code] * times).sum()))
            bests.append(int(times[best[code]].sum()))
        out = rows.drop(columns=spare).rename(columns={v: k for k, v in first.items()})
        out["n_best"], out["count_sum"] = np.array(bests, np.int64), np.array(sums, np.int64)
        return out[[*columns, *OUTPUTS]]

    rows = rows.select(*map(quoted, columns), *spare, *first.values())
    result = rows.groupBy(own + "block").cogroup(back.groupBy("block")).applyInPandas(add_up, schema)
    if not pairs:
        return result
    return result, counts.select(a.alias("a"), (F.col("pair") % PAIR).alias("b"), "n", "best")

