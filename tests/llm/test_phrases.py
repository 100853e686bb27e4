"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from wavepanel.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, limit):
    counts = defaultdict(Counter)
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    counts["und" if lang is None else lang][tuple(words[i:i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = {q[i:j] for q in candidates for i in range(len(q)) for j in range(i + 2, len(q) + 1) if j - i < len(q) and f[q[i:j]] == candidates[q]}
        found = []
        for p, a in candidates.items():
            if p in covered:
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]], n))
        for rank, (score, a, p, left, right, total) in enumerate(sorted(found)[:limit], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total, -score))
    return sorted(out)


def check(spark, rows, least, limit, **options):
    df = spark.createDataFrame([(t, x, 1, "p") for x, t in rows], "text string, lang string, rank int, phrase string").repartition(3)
    got = sorted(tuple(r) for r in phrases.collocations(df, least=least, limit=limit, **options).collect())
    assert got == brute(rows, least, limit)
    return got


def made_up(seed, n=300):
    rng = random.Random(seed)
    common = [f"c{i}" for i in range(6)]
    rare = [f"r{i}" for i in range(60)] + ["É", "é", "日本", "Straße"]
    fixed = [["New", "York"], ["as", "soon", "as", "possible"], ["one", "two", "three", "four", "five", "six"], ["ha", "ha", "ha"]]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 40)):
            words += [rng.choice(common)] if rng.random() < 0.6 else [rng.choice(rare)] if rng.random() < 0.7 else rng.choice(fixed)
        text = "".join(w + rng.choice((" ", " ", " ", " ", "  ", "\t", ". ", "\n", ",")) for w in words)
        rows.append((rng.choice(("en", "en", "de", None)), rng.choice((text, text.upper(), text))))
    return rows + [("en", None), ("en", ""), (None, " \t "), ("xx", "..."), ("fr", "un deux"), ("en", "A b\x0bc\x0cd\re"), ("en", "loop " * 3000), ("en", "loop " * 3000)]


@pytest.mark.parametrize("shares", [(0.25, 1.0), (0.05, 0.4, 1.0), (1.0,)])
def test_against_plain_counting(spark, shares):
    got = check(spark, made_up(1), 8, 2000, shares=shares)
    assert len({r[0] for r in got}) >= 2 and any(" " in r[2] for r in got)


def test_limit_and_ties(spark):
    rows = made_up(2)
    for limit in (1, 3, 7):
        check(spark, rows, 5, limit)
    ties = [("en", f"x{i} y{i}.") for i in range(30)] * 4
    assert [r[2] for r in check(spark, ties, 4, 10)] == sorted(f"x{i} y{i}" for i in range(30))[:10]


def test_a_full_table_of_pairs_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FULL", -1.0)
    check(spark, made_up(3), 6, 500)


def test_settled_languages_are_not_opened_further(spark, monkeypatch):
    asked = []
    real = phrases._grow
    monkeypatch.setattr(phrases, "_grow", lambda sizes, *more: (asked.append(sizes), real(sizes, *more))[1])
    rng = random.Random(4)
    rows = [("en", " ".join(f"the {rng.choice('abcdef')}{i} of" for _ in range(3)) + f". rare{i} pair{i}.") for i in range(40)] * 6
    check(spark, rows, 5, 10, shares=(0.1, 1.0))
    assert asked == [(2, 3, 4, 5)]                            # the second stage was not needed


def test_blocks_and_empty(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 200)
    monkeypatch.setattr(phrases, "MERGED", 50)
    check(spark, made_up(5, 120), 4, 100)
    empty = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(empty).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, "en"), ("", None)], "text string, lang string")).count() == 0


def test_bitmaps_miss_nothing(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    table = spark.createDataFrame([(int(x),) for x in h.view(np.int64)], "h bigint")
    held = phrases.bitmap(table).value
    assert held.holds(h).all() and held.holds(rng.integers(0, 2**64, 20_000, dtype=np.uint64)).mean() < 0.2
