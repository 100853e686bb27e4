"""Token alignment against a plain reading of the two libraries."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from wavepanel.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def letters():
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def tokens(text, libraries):
    a, b = libraries
    byte = letters()
    left = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (left, right) if text and b"".join(x for _, x in left) == want == b"".join(x for _, x in right) else ([], [])


def spans(side):
    at, out = 0, []
    for i, s in side:
        out.append((i, at, at + len(s)))
        at += len(s)
    return out


def brute(texts, libraries):
    links, rows = [], []
    for _, text in texts:
        left, right = (spans(s) for s in tokens(text or "", libraries))
        links.append([(x, y) for x, s, e in left for y, t, f in right if s < f and t < e])
        ends = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(i) for i, s, _ in left if low <= s < end) + "|" + ",".join(str(i) for i, s, _ in right if low <= s < end))
            low = end
        rows.append((len(left), len(right), len(groups), sha256(";".join(groups).encode()).hexdigest() if left else ""))
    counts = Counter(p for own in links for p in set(own))
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    out = Counter()
    for (i, _), own, (na, nb, ng, sha) in zip(texts, links, rows, strict=True):
        out[(i, na, nb, ng, len(own), sum(counts[p] == top[p[0]] for p in own), sum(counts[p] for p in own), sha)] += 1
    return out, counts


def check(spark, texts, libraries, parts=3):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, n_a int, block string").repartition(parts)
    found, pairs = alignment.align_tokens(docs, A, B, pairs=True)
    want, counts = brute(texts, libraries)
    rows = found.collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows) == want
    assert {r.block for r in rows} <= {"x"}
    assert {(r.a, r.b): r.n for r in pairs.collect()} == dict(counts)


def test_given_documents(spark, sf, libraries):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 3000]
    check(spark, texts, libraries)


def test_odd_texts(spark, libraries):
    rng = random.Random(5)
    signs = ["a", "b", " ", "  ", "\n", "\t", "é", "日本", "🙂", "<s>", "<0x41>", "<|endoftext|>", "'ll", "12", "▁", " ", "\x00", "the ", "ß", "Straße "]
    texts = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(1, 30)))) for i in range(150)]
    texts += [(None, "the house"), (None, "the house"), (3, "the house"), (4, None), (5, ""), (6, " "), (7, " lead"), (8, "trail "), (9, "▁x"),
              (10, "<|endoftext|> and </s>"), (11, "x" * 30_000), (11, "long " * 500), (12, "́")]
    check(spark, texts, libraries, 2)


def test_blocks_do_not_matter(spark, libraries, monkeypatch):
    texts = [(i, f"word {i % 7} and the house number {i % 11}") for i in range(200)]
    check(spark, texts, libraries, 5)
    rows, text, pair = alignment.align([t for _, t in texts], A, B)
    alone = [alignment.align([t], A, B) for _, t in texts]
    assert [tuple(r) for r in rows.itertuples(index=False)] == [tuple(next(x[0].itertuples(index=False))) for x in alone]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokens(docs, A, B).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.n_a, r.n_links, r.groups_sha256) for r in alignment.align_tokens(docs, A, B).collect()] == [(0, 0, "")] * 2
