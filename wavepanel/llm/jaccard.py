"""Operator 8: n-gram Jaccard join by vertical partitioning.

The shingles of a text (5 words) are hashed to 64 bits and put in one global order: rare ones by hash, then the hot ones, those that
many texts of some block share, by ascending count. Any order gives right results; this one keeps common passages at its end.
The order is cut into fragments.

1. Sets that may be linked meet in lists. Two keys serve, and every set has the ones that it needs:
   a) neighbours: two shingles that follow each other in the order of a set. Of sets of n and m shingles with similarity t or more all but few are shared, and
      private shingles break the shared ones into few runs, so linked sets share neighbours, the first of them among the first n / 2 of a set. Sets that only share
      a passage here and there do not. This serves sets with n / 2 + 2 rare shingles or more.
   b) single shingles among the first ones in the order (the prefix, about 1 - t of a set), for sets with less than 2 n / 3 + 2 rare ones. There common passages
      stand behind the prefix. A set below the bound of a) can be linked to sets below the bound of b) alone, so no pair falls between them.
   An entry says up to which size a partner is possible from its place on. Lists are made in one shuffle and read as sorted streams; hot shingles are spread.
2. Stars: in each list every set is paired with the set of the smallest share of rare shingles, which in a group of near copies is near their origin.
   This joins large groups without their pairs.
3. Cross pairs: every pair of one list that stars have left in different components, and that its sizes and its places in the order allow, is a
   candidate. Pairs inside a component cannot change it. Lists are cut by bands of sizes before they are paired, only entries near the beginning of the smaller
   set are paired at all, and a pair is taken where it first meets, not again in the lists that follow in both sets. Signatures refute most of the others in the join:
   bit i of a set's signature is the parity of its shingles that hash to i, so two signatures differ in no more bits than their sets differ in shingles. Of each two
   components the pair of the nearest signatures is checked first; the others are only where that leaves them apart.
4. Candidate pairs are checked exactly: one set of a pair owns it and sends each of its fragments once for OWNED pairs, the other sends its own; the
   shared shingles of the fragments are counted in sorted streams and summed.

So every link between different components is found and none is guessed. Equal sets are one set from the start, so copies are no pairs.

A-Z count as a-z; words are [^\\x20\\x09-\\x0D]+. Texts with fewer than 5 words have one shingle, the whole sequence; null and empty texts have none and link
with nothing. Rows may repeat ids or have none: they take part by their text, and the smallest id of a component names it (null if it has none).
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.llm.blocks import LOWER, mix, run_hashes, span_hashes, text_blocks, words
from wavepanel.llm.bounded import most_frequent
from wavepanel.llm.graph import components
from wavepanel.llm.store import keep

SHINGLE = 5
#: Similarity of a link as a fraction.
NUMERATOR, DENOMINATOR = 75, 100
#: A shingle is hot if so many different sets of one block (of BLOCK_SHINGLES) hold it; about HOT_SHINGLES at most are put last.
HOT_COUNT, HOT_SHINGLES, BLOCK_SHINGLES = 4, 500_000, 4_000_000
#: Tasks over which the list of a hot shingle is spread.
HOT_SPREAD = 16
FRAGMENT_BITS = 3
#: Pairs for which an owner sends its fragments once; pairs in one row of a member; bytes of pairs up to which they are sent to every executor; bytes in a batch of parts.
OWNED, HELD, SENT_BYTES, PART_BYTES = 256, 64, 16 << 20, 4 << 20
#: Words of 64 bits in the signature of a set, a power of two. Of sets up to the number of its bits it tells most pairs that are no links; of larger ones fewer.
SIGN_WORDS = 8
SIGNS = [f"g{i}" for i in range(SIGN_WORDS)]
#: An entry carries n, the largest possible partner and the share of rare shingles in one number.
RARE_BITS, REACH_BITS = 5, 30


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    data = LOWER[data]
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    runs = run_hashes(hashes, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(runs[a:b - size + 1])
        elif b > a:                                              # the whole sequence; its length keeps it apart
            yield run_hashes(np.concatenate([hashes[a:b], np.full(1, b - a, np.uint64)]), b - a + 1)
        else:
            yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """A 64-bit key of a set; with the size it stands for the set."""
    with np.errstate(over="ignore"):
        return int(mix(np.add.reduce(mix(shingles), keepdims=True))[:1].view(np.int64)[0])


def signature(shingles: np.ndarray) -> np.ndarray:
    """Bit i is the parity of the shingles that hash to i: the signatures of two sets differ in at most as many bits as the sets in shingles."""
    bits = 64 * SIGN_WORDS
    at = (mix(shingles) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _survey(size: int):
    """Rows kind 0: (row key, set size, set key, document id, signature); kind 1: (hot shingle, count in a block, -, -, -)."""
    names = ["kind", "a", "n", "s", "doc_id", *SIGNS]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()
        total = 0

        def hot() -> pa.RecordBatch:
            found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            often = n >= HOT_COUNT
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.array(found[often].view(np.int64)),
                                               pa.array(n[often].astype(np.int64)), *[pa.nulls(k, pa.int64())] * (2 + SIGN_WORDS)], names=names)

        for rows, data, offsets in text_blocks(batches, "text"):
            n, s, signs = [], [], [np.zeros((0, SIGN_WORDS), np.int64)]
            for shingles in shingle_sets(data, offsets, size):
                n.append(len(shingles))
                s.append(set_key(shingles))
                signs.append(signature(shingles)[None])
                if len(shingles) and s[-1] not in seen:
                    seen.add(s[-1])
                    held.append(shingles)
                    total += len(shingles)
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), rows.column(1), pa.array(n, pa.int64()), pa.array(s, pa.int64()),
                                              rows.column(2), *map(pa.array, np.concatenate(signs).T.copy())], names=names)
            if total >= BLOCK_SHINGLES:
                yield hot()
                held, seen, total = [], set(), 0
        yield hot()
    return run


class Order:
    """Places of shingles in the global order: rare ones by hash (top bit 0), hot ones by ascending count (top bit 1)."""

    def __init__(self, hot: np.ndarray, counts: np.ndarray):
        by_hash = np.argsort(hot)
        rank = np.empty(len(hot), np.uint64)
        rank[np.lexsort((hot, counts))] = np.arange(len(hot), dtype=np.uint64)
        self.hot, self.rank = hot[by_hash], rank[by_hash]

    def places(self, shingles: np.ndarray) -> np.ndarray:
        out = shingles >> np.uint64(1)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, shingles), len(self.hot) - 1)
            found = self.hot[at] == shingles
            out[found] = (np.uint64(1) << np.uint64(63)) | self.rank[at[found]]
        return np.unique(out)


def entry_keys(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lists of a set in the global order, and the size up to which a partner is possible from each."""
    n = len(place)
    rare = int(np.searchsorted(place, _HOT))
    keys, reach = [], []
    if 2 * rare >= n + 4:                                        # neighbours: at most (5 n - 2 m) / 7 of them come before the first shared one
        k = min(rare - 1, n // 2 + 2)
        with np.errstate(over="ignore"):
            keys.append(mix(place[:k] * np.uint64(0x9E3779B97F4A7C15) + place[1:k + 1]) >> np.uint64(1))
        reach.append((5 * n - 7 * np.arange(k)) // 2)
    if 3 * rare < 2 * n + 6:                                     # single shingles: at most n less the overlap come before the first shared one
        k = prefix_length(n)
        keys.append(place[:k])
        reach.append((4 * n - 7 * np.arange(k)) // 3)
    return np.concatenate(keys), np.concatenate(reach)


_HOT = np.uint64(1) << np.uint64(63)


def _prefixes(size: int, order):
    """Rows (w, s, info): the entries of each set once per block of texts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = order.value
        for _, data, offsets in text_blocks(batches, "text"):
            seen: set[int] = set()
            keys, owners, infos = [], [], []
            for shingles in shingle_sets(data, offsets, size):
                n = len(shingles)
                if not n or (s := set_key(shingles)) in seen:
                    continue
                seen.add(s)
                place = ranks.places(shingles)
                w, reach = entry_keys(place)
                share = int(np.searchsorted(place, _HOT)) * ((1 << RARE_BITS) - 1) // n
                keys.append(w)
                owners.append(np.full(len(w), s, np.int64))
                infos.append((n << REACH_BITS + RARE_BITS) | (np.maximum(reach, 0) << RARE_BITS) | share)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(owners)),
                                                  pa.array(np.concatenate(infos).astype(np.int64))], names=["w", "s", "info"])
    return run


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (w, s): each set once per shingle, and only shingles of two sets or more. Hot shingles (w < 0) always stay."""
    names = ["w", "s", "info"]
    rest: pa.Table | None = None

    def settle(table: pa.Table, last: bool) -> tuple[pa.Table, pa.Table | None]:
        table = table.combine_chunks()
        w, s = table.column("w").to_numpy(), table.column("s").to_numpy()
        fresh = np.ones(len(w), bool)
        fresh[1:] = (w[1:] != w[:-1]) | (s[1:] != s[:-1])
        at = np.flatnonzero(fresh)
        w = w[at]
        twin = np.zeros(len(w), bool)
        twin[1:] |= w[1:] == w[:-1]
        twin[:-1] |= w[1:] == w[:-1]
        twin |= w < 0
        if last or not len(at):
            return table.take(pa.array(at[twin])), None
        # the last row waits for what follows; a partner already seen is remembered by keeping two rows of its list
        held = at[-2:] if len(at) > 1 and w[-2] == w[-1] else at[-1:]
        done = at[:-len(held)]
        return table.take(pa.array(done[twin[:-len(held)]])), table.take(pa.array(held))

    for batch in batches:
        table = pa.Table.from_batches([batch]).select(names)
        if rest is not None:
            table = pa.concat_tables([rest, table])
        done, rest = settle(table, False)
        yield from done.to_batches()
    if rest is not None:
        yield from settle(rest, True)[0].to_batches()


def prefix_length(n):
    """Entries of the order that a set of n shows: the smallest partner has ceil(t n) shingles, and all of them must be shared."""
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def _parts(size: int, order):
    """Rows (owner, salt, frag, member, total, places): a set cut into the fragments of the order, for each of its jobs; member is null where the owner itself is sent."""
    names = ["owner", "salt", "frag", "member", "total", "places"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = order.value
        edges = np.arange(1, 1 << FRAGMENT_BITS, dtype=np.uint64) << np.uint64(64 - FRAGMENT_BITS)
        out: list[tuple] = []
        held = 0
        for rows, data, offsets in text_blocks(batches, "text"):
            jobs = rows.column(rows.schema.get_field_index("jobs")).to_pylist()
            for own, shingles in zip(jobs, shingle_sets(data, offsets, size), strict=True):
                place = ranks.places(shingles)
                parts = [(f, part.tobytes()) for f, part in enumerate(np.split(place, np.searchsorted(place, edges))) if len(part)]
                for job in own:
                    out.extend((job["owner"], job["salt"], f, job["member"], job["total"], part) for f, part in parts)
                    held += 8 * len(place) + 100
                    if held > PART_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    return run


def _overlaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared places of each member's part and its owner's, from rows sorted by owner, salt, fragment and member, the owner first."""
    at, own, last = None, np.zeros(0, np.uint64), None
    for batch in batches:
        owners, members, totals, shared = [], [], [], []
        for owner, salt, frag, member, total, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            key = (owner, salt, frag)
            if member is None:
                at, own = key, np.frombuffer(places, np.uint64)
            elif at == key and last != (key, member):            # rows that repeat an id and a text send a part twice
                other = np.frombuffer(places, np.uint64)
                n = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                if n:
                    owners.append(owner)
                    members.append(member)
                    totals.append(total)
                    shared.append(n)
            last = (key, member)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (owners, members, totals, shared)], names=["owner", "member", "total", "shared"])


class Sets:
    """What a join knows of a table of texts: one row per row, the distinct sets, and the order."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, size: int, row: str | None = None):
        self.size = size
        spark = docs.sparkSession
        key = F.xxhash64(F.col(doc_id), F.col(text)) if row is None else F.col(row)
        source = docs.select(F.col(text).alias("text"), key.alias("k"), F.col(doc_id).cast("bigint").alias("doc_id"))
        self.texts = source
        found = keep(source.mapInArrow(_survey(size), ", ".join(["kind int", *(f"{c} bigint" for c in ("a", "n", "s", "doc_id", *SIGNS))])))
        self.rows = found.where("kind = 0").select("doc_id", F.col("a").alias("k"), "n", "s", *SIGNS)
        hot = keep(found.where("kind = 1").groupBy("a").agg(F.sum("n").alias("c")))
        hot = most_frequent(hot, "a", "c", HOT_SHINGLES).toPandas()
        self.order = spark.sparkContext.broadcast(Order(hot["a"].to_numpy(np.int64).view(np.uint64), hot["c"].to_numpy(np.int64)))

    def shared_entries(self) -> DataFrame:
        """(w, s, n, reach, share) of the lists of two sets or more."""
        entries = self.texts.select("text").mapInArrow(_prefixes(self.size, self.order), "w bigint, s bigint, info bigint")
        spread = F.when(F.col("w") < 0, F.pmod(F.col("s"), F.lit(HOT_SPREAD))).otherwise(F.lit(0))
        found = entries.repartition("w", spread).sortWithinPartitions("w", "s").mapInArrow(_shared, "w bigint, s bigint, info bigint")
        return found.select("w", "s", F.shiftright("info", RARE_BITS + REACH_BITS).alias("n"),
                            F.shiftright("info", RARE_BITS).bitwiseAND((1 << REACH_BITS) - 1).alias("reach"),
                            F.col("info").bitwiseAND((1 << RARE_BITS) - 1).alias("share"))

    def signatures(self) -> DataFrame:
        """(s, its signature), one row per set."""
        return self.rows.where("n > 0").groupBy("s").agg(*[F.min(c).alias(c) for c in SIGNS])

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of the kept pairs (owner, member, total) those that are links, as (a, b)."""
        owned = pairs.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(OWNED))).cast("int").alias("salts"))
        held = pairs.groupBy("member").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(HELD))).alias("rows"))
        jobs = pairs.join(owned, "owner").join(held, "member").select(
            F.col("member").alias("s"), F.pmod(F.xxhash64("owner"), "rows").alias("row"),
            F.struct("owner", F.pmod(F.xxhash64("member"), "salts").cast("int").alias("salt"), "member", "total").alias("job"))
        own = owned.select("owner", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).select(
            F.col("owner").alias("s"), (-1 - F.floor(F.col("salt") / HELD)).alias("row"),
            F.struct("owner", "salt", F.lit(None).cast("bigint").alias("member"), F.lit(None).cast("bigint").alias("total")).alias("job"))
        rows = jobs.unionByName(own).groupBy("s", "row").agg(F.collect_list("job").alias("jobs"))        # HELD jobs or about
        keys = self.rows.where("n > 0").groupBy("s").agg(F.min("k").alias("k"))
        chosen = keep(rows.join(keys, "s").select("k", "jobs"))
        size = chosen.agg(F.sum(F.size("jobs") * 64 + 100)).first()[0] or 0
        parts = self.texts.join(F.broadcast(chosen) if size <= SENT_BYTES else chosen, "k").select("text", "jobs").mapInArrow(
            _parts(self.size, self.order), "owner bigint, salt int, frag int, member bigint, total bigint, places binary")
        counts = (parts.repartition("owner", "frag", "salt").sortWithinPartitions("owner", "salt", "frag", "member")
                  .mapInArrow(_overlaps, "owner bigint, member bigint, total bigint, shared bigint")
                  .groupBy("owner", "member", "total").agg(F.sum("shared").alias("shared")))
        least = F.ceil(F.col("total") * NUMERATOR / F.lit(float(NUMERATOR + DENOMINATOR)) - 1e-9)       # overlap / (total - overlap) >= t
        return counts.where(F.col("shared") >= least).select(F.least("owner", "member").alias("a"), F.greatest("owner", "member").alias("b"))


def _band(n):
    """Sizes in bands of a fifteenth or so, four to the ratio of linked sizes."""
    return F.floor(F.log(n.cast("double")) * (4 / log(DENOMINATOR / NUMERATOR)) + 1e-9).cast("int")


def _pairs(joined: DataFrame, owner: str) -> DataFrame:
    """Distinct (owner, member, total) of joined entries (columns with suffixes x and y) whose sizes and places allow a link; cross pairs with their components
    (low, high) and how far their signatures are apart."""
    extra = [c for c in ("low", "high", "apart") if c in joined.columns]
    fits = ((F.least("nx", "ny") * DENOMINATOR >= F.greatest("nx", "ny") * NUMERATOR) & (F.col("ny") <= F.col("rx")) & (F.col("nx") <= F.col("ry")))
    return joined.where((F.col("sx") != F.col("sy")) & fits).groupBy(F.least("sx", "sy").alias("a"), F.greatest("sx", "sy").alias("b")).agg(
        F.min(owner).alias("owner"), F.min(F.col("nx") + F.col("ny")).alias("total"), *[F.min(c).alias(c) for c in extra]).select(
        "owner", F.when(F.col("owner") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("member"), "total", *extra)


def _side(entries: DataFrame, mark: str) -> DataFrame:
    names = {"s": "s", "n": "n", "reach": "r", "comp": "c", "before": "p"} | {c: c for c in SIGNS}
    return entries.select("w", *[F.col(c).alias(short + mark) for c, short in names.items() if c in entries.columns])


def _larger_and_smaller(larger: DataFrame, smaller: DataFrame) -> DataFrame:
    """Entries of one list in different components, the larger set as x. A smaller set meets only larger ones that its place and theirs allow, by bands of sizes; a
    pair whose entries follow the same list in both sets has met in that list. A pair whose signatures differ in more bits than linked sets do in shingles is none."""
    least = F.ceil(F.col("nx") * NUMERATOR / F.lit(float(DENOMINATOR)) - 1e-9)
    x = _side(larger, "x").where(F.col("rx") >= least)
    x = x.withColumn("band", F.explode(F.sequence(_band(least), _band(F.least("nx", "rx")))))
    y = _side(smaller, "y").where("ry >= ny").withColumn("band", _band(F.col("ny")))
    fresh = ~F.coalesce(F.col("px") == F.col("py"), F.lit(False))
    ordered = (F.col("nx") > F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("sx") > F.col("sy")))
    apart = sum((F.bit_count(F.col(c + "x").bitwiseXOR(F.col(c + "y"))) for c in SIGNS), F.lit(0))
    near = apart * (DENOMINATOR + NUMERATOR) <= (F.col("nx") + F.col("ny")) * (DENOMINATOR - NUMERATOR)
    met = x.join(y, ["w", "band"]).where((F.col("cx") != F.col("cy")) & ordered & fresh & (F.col("ny") <= F.col("rx")) & (F.col("nx") <= F.col("ry")) & near)
    return met.select("sx", "nx", "rx", "sy", "ny", "ry", F.least("cx", "cy").alias("low"), F.greatest("cx", "cy").alias("high"), apart.alias("apart"))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    With row, a stored bigint column that differs on every row, also row_key and first: first is true on exactly one row of each component, that of the
    smallest id (rows without id last) and then the smallest key, and on every row that links with nothing.
    """
    sets = Sets(docs, doc_id, text, size, row)
    entries = keep(sets.shared_entries())
    pivots = entries.groupBy("w").agg(F.min(F.struct("share", "s", "n", "reach")).alias("p"), F.count(F.lit(1)).alias("k")).where("k > 1")
    pivots = pivots.select("w", F.col("p.s").alias("sy"), F.col("p.n").alias("ny"), F.col("p.reach").alias("ry"))
    stars = keep(_pairs(_side(entries, "x").join(pivots, "w"), "sy"))
    links = keep(sets.links(stars))
    labels = components(links)
    # every list in which components differ: whoever is not in the component of the list's pivot meets the whole list
    named = (entries.join(labels.withColumnRenamed("node", "s"), "s", "left").withColumn("comp", F.coalesce("label", "s")).drop("label"))
    mixed = (named.groupBy("w").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(F.struct("share", "s", "comp")).alias("p"))
             .where("low <> high").select("w", F.col("p.comp").alias("main")))
    before = F.lag("w").over(Window.partitionBy("s").orderBy(F.desc("reach"), "w"))                 # in the order of one set
    rest = keep(named.join(mixed, "w").join(sets.signatures(), "s").withColumn("before", before))
    outside = rest.where("comp <> main")
    cross = _pairs(_larger_and_smaller(outside, rest).unionByName(_larger_and_smaller(rest, outside)), "sy")
    known = stars.select(F.least("owner", "member").alias("a"), F.greatest("owner", "member").alias("b"))
    cross = keep(cross.join(known, (F.least("owner", "member") == F.col("a")) & (F.greatest("owner", "member") == F.col("b")), "left_anti"))
    if not cross.isEmpty():
        nearest = keep(cross.groupBy("low", "high").agg(F.min(F.struct("apart", "owner", "member", "total")).alias("p")).select("p.owner", "p.member", "p.total"))
        links = keep(links.unionByName(sets.links(nearest)))
        labels = components(links)
        ends = [labels.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in ("owner", "member")]
        others = cross.join(nearest, ["owner", "member"], "left_anti").join(ends[0], "owner", "left").join(ends[1], "member", "left")
        others = keep(others.where(F.coalesce("owner_label", "owner") != F.coalesce("member_label", "member")).select("owner", "member", "total"))
        if not others.isEmpty():
            links = keep(links.unionByName(sets.links(others)))
            labels = components(links)
    named_rows = (sets.rows.join(labels.withColumnRenamed("node", "s"), "s", "left")
                  .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("label", "s")).alias("comp"),
                          *([] if row is None else [F.col("k").alias("row_key")])))
    named_rows = keep(named_rows)
    chosen = [] if row is None else [F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("chosen")]
    names = keep(named_rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("name"), *chosen))
    return named_rows.join(names, "comp", "left").select(
        "doc_id", "n_shingles", F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"),
        *([] if row is None else ["row_key", (F.col("comp").isNull() | (F.col("row_key") == F.col("chosen"))).alias("first")]))
