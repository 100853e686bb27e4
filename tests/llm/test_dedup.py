"""Exact, line, near and passage dedup against plain Python on small tables."""

import random
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from wavepanel.llm import exact_dedup, graph, jaccard, line_dedup, substrings

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, sha string, n_lines int, kept_text string, comp long, __id long, t0 long"


def table(spark, texts):
    """A table with extra columns whose names clash with outputs and inner names."""
    return spark.createDataFrame([(i, t, "s", 1, "k", 7, 8, 9) for i, t in texts], SCHEMA)


def words_of(text):
    return [w for w in SPACE.split(text or "") if w]


def made_up(seed, n=120, copies=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 220))] for _ in range(n)]
    passage = [f"p{i}" for i in range(60)]
    for _ in range(copies):
        words = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        base.append(words)
    for words in rng.sample(base, 25):
        at = rng.randint(0, len(words))
        words[at:at] = passage[:rng.choice((20, 34, 35, 36, 60))]
    hot = [f"h{i}" for i in range(80)]
    for _ in range(50):                                          # one large group of near copies
        words = list(hot)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(80)] = rng.choice(vocabulary)
        base.append(words)
    texts = [(i, rng.choice((" ", "  ", "\n")).join(w)) for i, w in enumerate(base)]
    texts += [(1000, None), (1001, ""), (1002, " \n"), (1003, "a b"), (1004, "A  b"), (1005, "loop " * 90), (1006, "x y z u v " * 40), (1007, "é ß 日本 " * 20)]
    texts += [(1010 + i, texts[3][1]) for i in range(12)]
    rng.shuffle(texts)
    return texts


# --- exact ---

def check_exact(rows, texts):
    groups = defaultdict(list)
    for i, t in texts:
        groups[SPACE.sub(" ", t or "")].append(i)
    want = Counter()
    for text, ids in groups.items():
        for i in ids:
            want[(i, min(ids), len(ids), i == min(ids), sha256(text.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows) == want


def test_exact_dedup_against_groups(spark):
    texts = made_up(1) + [(5000, "same\ttext"), (5001, "same text"), (-3, "same \n text"), (5001, "same text")]
    check_exact(exact_dedup.exact_dedup(table(spark, texts)).collect(), texts)


def test_exact_dedup_in_many_batches(spark):
    texts = made_up(2, 40, 40)
    check_exact(exact_dedup.dedup_batches(table(spark, texts), [10, 25, 60, 1003]).collect(), texts)


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    rows = exact_dedup.exact_dedup(table(spark, [(None, "a"), (None, "b"), (3, "a"), (1, None)])).collect()
    got = sorted((r.text_sha256[:4], r.doc_id or -1, r.keep_id or -1, r.kept, r.group_size) for r in rows)
    a, b, e = (sha256(x).hexdigest()[:4] for x in (b"a", b"b", b""))
    assert got == sorted([(a, -1, 3, False, 2), (a, 3, 3, True, 2), (b, -1, -1, True, 1), (e, 1, 1, True, 1)])


def test_exact_dedup_of_repeated_ids_across_batches(spark):
    texts = [(1, "A"), (9, "A"), (9, "B"), (2, "C")]
    check_exact(exact_dedup.dedup_batches(table(spark, texts), [5]).collect(), texts)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 40_000])
def test_fuse_filter_holds_its_keys(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    made = exact_dedup.fuse_build(keys)
    assert exact_dedup.fuse_contains(keys, *made).all()
    others = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert exact_dedup.fuse_contains(others, *made).mean() < (0.02 if n else 1.1)
    assert len(made[3]) <= 1.4 * n + 4000


def test_byte_check_parts_texts_of_one_digest(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c c"), (4, "c  c")], "doc_id long, text string")
    pairs = spark.createDataFrame([("x", 1, 2), ("y", 3, 4)], "sha string, old_id long, new_id long")
    assert [r.sha for r in exact_dedup.confirm(pairs, docs, "doc_id", "text").collect()] == ["y"]


# --- lines ---

def brute_lines(texts):
    def key(line):
        return re.sub(r"[A-Z]", lambda m: m.group().lower(), line.strip("\t\n\x0b\x0c\r "))
    holders = defaultdict(set)
    for i, t in texts:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 40:
                holders[key(line)].add(i)
    shared = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    out = Counter()
    for i, t in texts:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or key(x) not in shared or shared[key(x)] == i]
        out[(i, len(lines), len(lines) - len(stay), sha256("\n".join(stay).encode()).hexdigest())] += 1
    return out


def test_line_dedup_against_plain_python(spark):
    rng = random.Random(4)
    pool = ["Licence line number %d, which is long enough to be counted here" % i for i in range(6)] + ["é" * 39, "é" * 40, "short", "", "  "]
    texts = []
    for i in range(40):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 9))]
        lines = [rng.choice((x, x.upper().replace("É", "é"), " \t" + x + "\r", x)) for x in lines]
        texts.append((i, "\n".join(lines)))
    texts += [(100, None), (101, "\n"), (None, pool[0]), (102, pool[0]), (102, pool[0]), (103, "own\n" * 3000)]
    out = line_dedup.drop_shared_lines(table(spark, texts))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, sha256(r.kept_text.encode()).hexdigest()) for r in out.collect()) == brute_lines(texts)
    assert out.columns.count("kept_text") == 1
    assert line_dedup.drop_shared_lines(table(spark, [])).count() == 0


# --- near duplicates ---

def brute_components(texts):
    sets = {}
    for row, (_, t) in enumerate(texts):
        w = words_of(re.sub(r"[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[row] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for a in range(len(texts)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    names = {}
    for row, (i, _) in enumerate(texts):
        if sets[row] and i is not None:
            names[find(row)] = min(i, names.get(find(row), i))
    return Counter((i, len(sets[row]), names.get(find(row)) if sets[row] else i) for row, (i, _) in enumerate(texts))


@pytest.mark.parametrize("hot", [2, 4, 1000])
def test_near_components_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(jaccard, "HOT_COUNT", hot)
    texts = made_up(10 + hot)
    out = jaccard.near_components(table(spark, texts))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute_components(texts)


def test_near_components_edges(spark):
    long = "a b c d e f g h"
    texts = [(None, long), (None, "q r s t u v"), (5, long), (5, long), (9, "A B\tC d e f g h"), (1, None), (2, ""), (3, "a b"), (4, "a b"), (6, "a b c")]
    out = jaccard.near_components(table(spark, texts))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute_components(texts)
    assert jaccard.near_components(table(spark, [])).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 2000 + i) for i in range(50)] + [(-5, -9), (3000, 2049)]
    out = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[2049] == out[3000] == 1000 and out[-5] == -9
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- passages ---

def brute_passages(texts, window=35):
    counts = Counter()
    for _, t in texts:
        w = words_of(t)
        counts.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = Counter()
    for i, t in texts:
        w = words_of(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k:k + window])] > 1:
                gone[k:k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[(i, len(w), sum(gone), sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [1, 2000])
def test_passages_against_plain_python(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT_STRINGS", hot)
    texts = made_up(20) + [(None, "n " * 50), (7, "again " * 20), (7, "again " * 20)]
    out = substrings.drop_repeated_passages(table(spark, texts))
    got = Counter((r.doc_id, r.n_words, r.n_removed, sha256(r.kept_text.encode()).hexdigest()) for r in out.collect())
    assert got == brute_passages(texts)
    assert "text" not in out.columns and "__id" in out.columns


def test_passages_edges(spark):
    assert substrings.drop_repeated_passages(table(spark, [])).count() == 0
    rows = substrings.drop_repeated_passages(table(spark, [(1, " a\n b ")]), join_untouched=False).collect()
    assert rows[0].kept_text == " a\n b " and rows[0].n_removed == 0


def test_minimisers_agree_for_equal_windows():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**64, 300, dtype=np.uint64)
    h = np.concatenate([h, h[100:200], h[:50]])
    first = np.array([0, 300, 400, 450])
    runs, least, valid = substrings.window_minimisers(h, first, 35, 8)
    assert (least[100:166] == least[300:366]).all()
    assert valid.sum() == 300 - 34 + 100 - 34 + 50 - 34
    places = set(substrings.minimiser_places(runs, least, valid, 28).tolist())
    for i in np.flatnonzero(valid):
        span = runs[i:i + 28]
        assert least[i] == span.min() and i + int(span.argmin()) in places
    begin, count, _ = substrings.super_kmers(least, valid)
    assert count.sum() == valid.sum() and len(begin) == len(count)


def test_a_common_passage_alone_makes_no_pair(spark, monkeypatch):
    asked = []
    real = jaccard.Sets.links
    monkeypatch.setattr(jaccard.Sets, "links", lambda self, pairs: (asked.append(pairs.count()), real(self, pairs))[1])
    rows = [(i, " ".join(f"p{k}" for k in range(60)) + " " + " ".join(f"o{i}x{k}" for k in range(14 + i % 3))) for i in range(300)]
    out = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert out.where("doc_id <> component_id").count() == 0 and sum(asked) == 0


def test_a_star_of_near_copies_has_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "OWNED", 16)
    monkeypatch.setattr(jaccard, "HELD", 8)
    rng = random.Random(7)
    rows = []
    for i in range(200):
        words = [f"s{k}" for k in range(120)]
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(120)] = f"n{i}x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(500, rows[0][1]), (None, rows[0][1]), (0, rows[0][1])]
    out = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute_components(rows)


def test_signatures_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(3)
    for n, m, shared in [(0, 1, 0), (1, 1, 1), (5, 9, 3), (146, 150, 118), (800, 700, 690), (5000, 4900, 4000)]:
        pool = np.unique(rng.integers(0, 2**64, n + m, dtype=np.uint64))
        a, b = pool[:n], pool[n - shared:n - shared + m]
        differing = (jaccard.signature(a) ^ jaccard.signature(b)).view(np.uint64)
        assert sum(int(x).bit_count() for x in differing) <= n + m - 2 * shared
    assert (jaccard.signature(pool) == jaccard.signature(pool[::-1])).all()


def test_far_copies_of_a_large_group_ask_few_pairs(spark, monkeypatch):
    asked = []
    real = jaccard.Sets.links
    monkeypatch.setattr(jaccard.Sets, "links", lambda self, pairs: (asked.append(pairs.count()), real(self, pairs))[1])
    rng = random.Random(11)

    def copy(i, places, base):
        words = list(base)
        for at in places:
            words[at] = f"n{i}x{at}"
        return words
    origin = [f"s{k}" for k in range(150)]
    near = [copy(i, rng.sample(range(5, 100, 10), 1 + i % 3), origin) for i in range(150)]
    far = [copy(500 + i, rng.sample(range(105, 150, 10), 4), origin) for i in range(20)]             # linked with none of the others
    chained = [copy(600 + i, (105 + 10 * (i % 5),), near[2 + 3 * i]) for i in range(15)]            # with some of them alone
    rows = [(i, " ".join(words)) for i, words in enumerate(far + near + chained)]
    out = jaccard.near_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == brute_components(rows)
    assert asked[0] < 2 * len(rows) and sum(asked[1:]) < 2 * len(rows)
