"""Operator 2: byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the whole corpus are compiled, with their ids as outputs, into a minimal automaton that shares
prefixes and suffixes; executors memory-map it. A block of texts is split into words by array operations, each
distinct word of the block is looked up in the automaton once, and words that it lacks are merged exactly by rank.
The lexicon only saves time: results are the same with any lexicon, also with none.

Null and empty texts have no ids. A special token written in a text counts as that token, as the public library does
by default. A text of any length is encoded whole. Rows, columns and ties stay as they are; an output replaces an input column of its name. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.llm.bounded import most_frequent
from wavepanel.llm.blocks import ragged, span_hashes, text_blocks
from wavepanel.llm.names import carried, ddl, quoted, unused
from wavepanel.llm.store import keep as keep_table

#: Words in the lexicon, about; the others are merged when they occur.
LEXICON_WORDS = 60_000
#: A word counts towards the lexicon from a block in which it occurs so often.
LEXICON_MIN_COUNT = 3
#: Bytes encoded at once; a worker's memory is about 60 times this.
ENCODE_BLOCK = 1 << 20

_OTHER, _LETTER, _NUMBER, _SPACE, _SPECIAL = range(5)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point: letter (L*), number (N*), white space, other."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _LETTER
        elif kind == "N":
            out[c] = _NUMBER
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029),
                 (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a:b + 1] = _SPACE
    return out


def _byte_letters() -> dict[str, int]:
    """Characters that stand for bytes in vocabulary files: printable bytes stand for themselves, the others follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    byte_ids: np.ndarray        # id of each single byte
    pair_keys: np.ndarray       # sorted left * 2^32 + right
    pair_ranks: np.ndarray
    merged: np.ndarray          # id by rank
    token_offsets: np.ndarray   # bytes of each id
    token_bytes: np.ndarray
    specials: tuple[tuple[bytes, int], ...]
    decimals: np.ndarray        # "id," of each id, padded with zeros


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """Read a byte-level BPE vocabulary file; kept once in each process."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, vocab = _byte_letters(), spec["model"]["vocab"]
    specials = tuple((t["content"].encode(), t["id"]) for t in spec["added_tokens"])
    size = max([*vocab.values(), *(i for _, i in specials)]) + 1
    token = [b""] * size
    for text, i in vocab.items():
        token[i] = bytes(letters[c] for c in text)
    for text, i in specials:
        token[i] = text
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    keys = np.array([(vocab[a] << 32) + vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys)
    single = {token[i]: i for i in vocab.values() if len(token[i]) == 1}
    width = len(str(size - 1)) + 1
    decimals = np.zeros((size, width), np.uint8)
    for i in range(size):
        s = f"{i},".encode()
        decimals[i, :len(s)] = list(s)
    return Vocabulary(np.array([single.get(bytes([b]), 0) for b in range(256)], np.int64), keys[order], order.astype(np.int64),
                      np.array([vocab[a + b] for a, b in pairs], np.int64),
                      np.concatenate([[0], np.cumsum([len(t) for t in token])]).astype(np.int64),
                      np.frombuffer(b"".join(token), np.uint8), specials, decimals)


def split_words(data: np.ndarray, offsets: np.ndarray, specials: tuple[tuple[bytes, int], ...] = ()
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts of the words of the public byte-level pattern, their ends, and the special id of each (-1: none).

    Words: a contraction ('s 't 're 've 'm 'll 'd); letters, numbers or other signs, each with one space before them;
    white space, whose last space goes to the word that follows.
    """
    n_bytes = len(data)
    if not n_bytes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)                   # byte place of each code point
    raw = data.tobytes()
    cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[cps]
    n = len(cps)
    first = np.zeros(n + 1, bool)                                # a text or a special token begins or ends
    first[np.searchsorted(at, offsets)] = True
    special_at, special_id = [], []
    for text, i in specials:
        place = raw.find(text)
        while place >= 0:
            stop = place + len(text)
            if np.searchsorted(offsets, place, "right") == np.searchsorted(offsets, stop, "left"):
                a, b = np.searchsorted(at, (place, stop))
                first[[a, b]] = True
                kind[a:b] = _SPECIAL
                special_at.append(place)
                special_id.append(i)
            place = raw.find(text, stop)
    change = first[:n].copy()
    change[0] = True
    change[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(change)
    stops = np.append(runs[1:], n)
    closed = first[stops] | (stops == n)                         # nothing follows in the same piece
    start = change
    # white space: all but its last sign is a word; a last space belongs to what follows
    space = np.flatnonzero((kind[runs] == _SPACE) & ~closed)
    last = stops[space] - 1
    start[last] = True
    given = cps[last] == 32
    start[stops[space[given]]] = False
    # contractions: a lone ' that begins a word, with letters after it
    quote = (kind[runs] == _OTHER) & (cps[runs] == 39) & (stops - runs == 1) & ~closed
    quote &= start[runs]
    quote = np.flatnonzero(quote)
    quote = quote[kind[np.minimum(stops[quote], n - 1)] == _LETTER]
    if len(quote):
        a, room = stops[quote], stops[quote + 1] - runs[quote + 1]
        one = cps[a]
        two = np.where(room > 1, cps[np.minimum(a + 1, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for found, letters in ((short, 1), (long & ~short, 2)):
            begin, left = a[found], room[found]
            start[begin] = False
            more = left > letters
            start[begin[more] + letters] = True
    starts = at[np.flatnonzero(start)]
    ends = np.append(starts[1:], n_bytes)
    marks = np.full(len(starts), -1, np.int64)
    if special_at:
        marks[np.searchsorted(starts, special_at)] = special_id
    return starts, ends, marks


def merge_words(ids: np.ndarray, word: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Apply the merges to symbol ids of many words at once; word is the ascending word number of each symbol.

    Every round merges, in each word, all places of its lowest-ranked pair from left to right. A new symbol only takes
    part in higher ranks, so this equals merging one place at a time. Words without a pair left drop out of the rounds.
    """
    none = np.int64(1 << 60)
    done_ids, done_words = [], []

    def ranks(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) + right
        place = np.minimum(np.searchsorted(vocab.pair_keys, key), len(vocab.pair_keys) - 1)
        return np.where(vocab.pair_keys[place] == key, vocab.pair_ranks[place], none)

    rank = np.full(len(ids), none, np.int64)                     # of the pair that begins here
    if len(ids) > 1:
        same = np.flatnonzero(word[1:] == word[:-1])
        rank[same] = ranks(ids[same], ids[same + 1])
    while len(ids):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(rank, heads)
        sizes = np.diff(np.append(heads, len(ids)))
        open_word = np.repeat(best < none, sizes)
        if not open_word.all():
            done_ids.append(ids[~open_word])
            done_words.append(word[~open_word])
            sizes, best = sizes[best < none], best[best < none]
            ids, word, rank = ids[open_word], word[open_word], rank[open_word]
            if not len(ids):
                break
        chosen = np.flatnonzero(rank == np.repeat(best, sizes))
        # of overlapping places of a pair (x, x) every second one is merged, from the left
        breaks = np.concatenate([[True], (np.diff(chosen) != 1) | (word[chosen[1:]] != word[chosen[:-1]])])
        nth = np.arange(len(chosen)) - np.maximum.accumulate(np.where(breaks, np.arange(len(chosen)), 0))
        chosen = chosen[nth % 2 == 0]
        ids = ids.copy()
        ids[chosen] = vocab.merged[rank[chosen]]
        stay = np.ones(len(ids), bool)
        stay[chosen + 1] = False
        new_place = np.cumsum(stay) - 1
        ids, word, rank = ids[stay], word[stay], rank[stay]
        touched = new_place[chosen]
        touched = np.concatenate([touched, touched[touched > 0] - 1])
        rank[touched] = none
        touched = touched[touched < len(ids) - 1]
        touched = touched[word[touched] == word[touched + 1]]
        rank[touched] = ranks(ids[touched], ids[touched + 1])
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ids, word = np.concatenate(done_ids), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return ids[order], word[order]


# --- the lexicon: a minimal acyclic automaton whose paths add up to the number of the word ---

def build_automaton(entries: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimal automaton of sorted distinct byte strings: edge keys (state * 256 + byte, ascending), edge targets,
    edge outputs, and whether each state accepts. The outputs along the path of entry i add up to i."""
    registry: dict[tuple, int] = {}
    accepts: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        state = registry.get(key)
        if state is None:
            state = registry[key] = len(accepts)
            accepts.append(node[0])
            arcs.append(key[1])
        return state

    path: list[list] = [[False, []]]                             # open nodes: accepts, settled (byte, state)
    previous = b""
    for entry in entries:
        common = len(os.path.commonprefix([previous, entry]))
        while len(path) > common + 1:
            node = path.pop()
            path[-1][1].append((previous[len(path) - 1], settle(node)))
        path.extend([False, []] for _ in range(len(entry) - common))
        path[-1][0] = True
        previous = entry
    while len(path) > 1:
        node = path.pop()
        path[-1][1].append((previous[len(path) - 1], settle(node)))
    root = settle(path[0])
    paths = [0] * len(accepts)                                   # a state is settled after those it leads to
    for s in range(len(accepts)):
        paths[s] = accepts[s] + sum(paths[t] for _, t in arcs[s])
    edges = []
    for s, own in enumerate(arcs):
        output = int(accepts[s])
        for byte, target in own:
            edges.append((((root - s) << 8) + byte, root - target, output))
            output += paths[target]
    edges.sort()
    table = np.array(edges, np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2], np.array(accepts[::-1], np.int64)


_FIELDS = ("keys", "targets", "outputs", "accepts", "id_offsets", "ids")


@dataclass(frozen=True)
class Lexicon:
    keys: np.ndarray
    targets: np.ndarray
    outputs: np.ndarray
    accepts: np.ndarray
    id_offsets: np.ndarray
    ids: np.ndarray
    longest: int

    def find(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Number of each word in the lexicon, -1 where it has none; all words walk the automaton together."""
        found = np.full(len(starts), -1, np.int64)
        live = np.flatnonzero(lengths <= self.longest)
        state, total = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for j in range(self.longest):
            ended = lengths[live] == j
            if ended.any():
                good = ended & (self.accepts[state] == 1)
                found[live[good]] = total[good]
                live, state, total = live[~ended], state[~ended], total[~ended]
            if not len(live):
                return found
            key = (state << 8) + data[starts[live] + j]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[place] == key
            live, place = live[good], place[good]
            state, total = self.targets[place], total[good] + self.outputs[place]
        good = self.accepts[state] == 1
        found[live[good]] = total[good]
        return found


def compile_lexicon(entries: list[bytes], vocab: Vocabulary) -> bytes:
    """The automaton and the ids of its words as one block of bytes that can be mapped."""
    entries = sorted(set(entries) - {b""})
    keys, targets, outputs, accepts = build_automaton(entries)
    flat = np.frombuffer(b"".join(entries), np.uint8)
    lengths = np.array([len(e) for e in entries], np.int64)
    ids, word = merge_words(vocab.byte_ids[flat], np.repeat(np.arange(len(entries)), lengths), vocab)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(entries)))])
    arrays = [np.ascontiguousarray(x, np.int64) for x in (keys, targets, outputs, accepts, offsets, ids)]
    head = np.array([len(_FIELDS), int(lengths.max(initial=0)), *(len(x) for x in arrays)], np.int64)
    return head.tobytes() + b"".join(x.tobytes() for x in arrays)


@lru_cache(maxsize=4)
def map_lexicon(path: str) -> Lexicon:
    """Map a lexicon file; all workers of a machine share its pages."""
    whole = np.memmap(path, np.int64, "r")
    n, longest = int(whole[0]), int(whole[1])
    sizes = whole[2:2 + n]
    ends = 2 + n + np.cumsum(sizes)
    return Lexicon(*(whole[e - s:e] for e, s in zip(ends, sizes, strict=True)), longest=longest)


def encode_block(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary, lexicon: Lexicon | None = None
                 ) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block, and where those of each text begin (one more at the end)."""
    starts, ends, marks = split_words(data, offsets, vocab.specials)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    codes, keys = pd.factorize(span_hashes(data, starts, ends))
    where = np.empty(len(keys), np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]             # the first place of each distinct word
    begin, lengths, mark = starts[where], (ends - starts)[where], marks[where]
    known = np.full(len(keys), -1, np.int64)
    if lexicon is not None and len(lexicon.keys):
        known = lexicon.find(data, begin, lengths)
    known[mark >= 0] = -1
    counts = np.zeros(len(keys), np.int64)
    first = np.zeros(len(keys), np.int64)
    pools, size = [], 0
    if lexicon is not None:
        hit = known >= 0
        counts[hit] = lexicon.id_offsets[known[hit] + 1] - lexicon.id_offsets[known[hit]]
        first[hit] = lexicon.id_offsets[known[hit]]
        pools.append(np.asarray(lexicon.ids))
        size = len(lexicon.ids)
    unseen = np.flatnonzero((known < 0) & (mark < 0))
    ids, word = merge_words(vocab.byte_ids[data[ragged(begin[unseen], lengths[unseen])]],
                            np.repeat(np.arange(len(unseen)), lengths[unseen]), vocab)
    counts[unseen] = np.bincount(word, minlength=len(unseen))
    first[unseen] = size + np.cumsum(counts[unseen]) - counts[unseen]
    pools.append(ids)
    special = np.flatnonzero(mark >= 0)
    counts[special] = 1
    first[special] = size + len(ids) + np.arange(len(special))
    pools.append(mark[special])
    out = np.concatenate(pools)[ragged(first[codes], counts[codes])]
    per_word = np.concatenate([[0], np.cumsum(counts[codes])])
    return out, per_word[np.searchsorted(starts, offsets)]


def decode_block(ids: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids one after the other, and where those of each id begin (one more at the end)."""
    lengths = vocab.token_offsets[ids + 1] - vocab.token_offsets[ids]
    return vocab.token_bytes[ragged(vocab.token_offsets[ids], lengths)], np.concatenate([[0], np.cumsum(lengths)])


def checked_encode(data: np.ndarray, offsets: np.ndarray, vocab: Vocabulary, lexicon: Lexicon | None = None
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids and text offsets as encode_block, with their decoded bytes and the byte offsets of the texts.

    The decoded bytes must be the input's. Should two words of a block ever share a hash they are not, and the block
    is encoded again in halves, down to single words.
    """
    ids, at = encode_block(data, offsets, vocab, lexicon)
    decoded, ends = decode_block(ids, vocab)
    if len(decoded) == len(data) and np.array_equal(decoded, data):
        return ids, at, decoded, ends[at]
    if len(offsets) > 2:
        cut = len(offsets) // 2
        middle = offsets[cut]
        left = checked_encode(data[:middle], offsets[:cut + 1], vocab, lexicon)
        right = checked_encode(data[middle:], offsets[cut:] - middle, vocab, lexicon)
        return (np.concatenate([left[0], right[0]]), np.concatenate([left[1][:-1], right[1] + len(left[0])]),
                np.concatenate([left[2], right[2]]), np.concatenate([left[3][:-1], right[3] + len(left[2])]))
    starts, stops, marks = split_words(data, offsets, vocab.specials)
    lengths = stops - starts
    ids, word = merge_words(vocab.byte_ids[data], np.repeat(np.arange(len(starts)), lengths), vocab)
    keep = marks[word] < 0
    special = np.flatnonzero(marks >= 0)
    ids, word = np.concatenate([ids[keep], marks[special]]), np.concatenate([word[keep], special])
    ids = ids[np.argsort(word, kind="stable")]
    decoded, _ = decode_block(ids, vocab)
    return ids, np.array([0, len(ids)]), decoded, np.array([0, len(decoded)])


# --- Spark ---

def word_counts(docs: DataFrame, text: str, path: str, min_count: int = LEXICON_MIN_COUNT) -> DataFrame:
    """(word, n) over all texts; a word counts from each block in which it occurs min_count times."""
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = vocabulary(path).specials
        for _, data, offsets in text_blocks(batches, text, ENCODE_BLOCK):
            starts, ends, marks = split_words(data, offsets, specials)
            codes, keys = pd.factorize(span_hashes(data, starts, ends))
            n = np.bincount(codes, minlength=len(keys))
            where = np.empty(len(keys), np.int64)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            often = np.flatnonzero((n >= min_count) & (marks[where] < 0)) if len(keys) else []
            whole = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([whole[starts[w]:ends[w]] for w in where[often]], pa.binary()), pa.array(n[often], pa.int64())],
                names=["word", "n"])
    return docs.select(text).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def ship_lexicon(spark: SparkSession, docs: DataFrame, text: str, path: str, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words of docs and hand the file to all executors; its name there.

    Only about size words reach the driver, whatever the corpus. Long words (over 64 bytes) stay out.
    """
    counts = keep_table(word_counts(docs, text, path).where(F.octet_length("word") <= 64))
    top = most_frequent(counts, "word", "n", size).select("word").collect()
    if not top:
        return ""
    block = compile_lexicon([bytes(r.word) for r in top], vocabulary(path))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lexicon-"))
    name = f"lexicon-{uuid.uuid4().hex}"
    with open(os.path.join(folder, name), "wb") as f:
        f.write(block)
    spark.sparkContext.addFile(os.path.join(folder, name))
    return name


_COLUMNS = {"ids": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def bpe_encode(docs: DataFrame, path: str, text: str = "text", lexicon_words: int = LEXICON_WORDS,
               outputs: tuple[str, ...] = ("ids",), keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of docs (or those in keep) and the outputs asked for.

    outputs: ids; decoded (text of the ids); n_tokens; ids_sha256 (hex digest of the decimal ids joined by commas);
    decoded_sha256. Digests are made where the ids are, so the ids need not travel.
    """
    wanted = {c: _COLUMNS[c] for c in outputs}
    columns = [c for c in carried(docs, wanted) if keep is None or c in keep]
    whole_text = unused(docs) + "text"
    schema = ddl(docs, columns, wanted)
    name = ship_lexicon(docs.sparkSession, docs, text, path, lexicon_words) if lexicon_words else ""
    source = docs.select(*[docs[quoted(c)] for c in columns], docs[quoted(text)].alias(whole_text))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        lexicon = map_lexicon(SparkFiles.get(name)) if name else None
        for rows, data, offsets in text_blocks(batches, whole_text, ENCODE_BLOCK):
            ids, at, decoded, byte_at = checked_encode(data, offsets, vocab, lexicon)
            made = {}
            if "ids" in wanted:
                made["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
            if "n_tokens" in wanted:
                made["n_tokens"] = pa.array(np.diff(at), pa.int64())
            if "ids_sha256" in wanted:
                signs = vocab.decimals[ids].ravel()
                used = signs != 0
                stops = np.concatenate([[0], np.cumsum((vocab.decimals != 0).sum(1)[ids])])[at]
                signs = memoryview(signs[used])
                made["ids_sha256"] = pa.array([sha256(signs[a:max(a, b - 1)]).hexdigest()
                                               for a, b in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], pa.string())
            if "decoded" in wanted or "decoded_sha256" in wanted:
                whole = decoded.tobytes()
                texts = [whole[a:b].decode("utf-8", "replace")
                         for a, b in zip(byte_at[:-1].tolist(), byte_at[1:].tolist(), strict=True)]
                if "decoded" in wanted:
                    made["decoded"] = pa.array(texts, pa.string())
                if "decoded_sha256" in wanted:
                    made["decoded_sha256"] = pa.array([sha256(t.encode()).hexdigest() for t in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(columns))), *(made[c] for c in wanted)],
                                             names=[*columns, *wanted])

    return source.mapInArrow(encode, schema)


def bpe_decode(df: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """The columns of df and the text of its ids; null ids give an empty text, invalid UTF-8 the replacement sign."""
    columns = carried(df, [output])
    schema = ddl(df, columns, {output: "string"})

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            texts = []
            for value in lists:
                own = np.array(value.as_py() or [], np.int64)
                texts.append(decode_block(own, vocab)[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(texts, pa.string())],
                                             names=[*columns, output])

    return df.mapInArrow(decode, schema)


__all__ = ["bpe_decode", "bpe_encode", "vocabulary", "word_counts"]
