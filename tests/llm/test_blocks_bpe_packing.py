"""Blocks, tokens and packing against plain Python and the public tokenizer library."""

import zlib
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wavepanel.llm import blocks, bpe, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
HARD = ["", "a", None, "it's don't 'll 's we'LL they've'd ''s x 's", "a  b   c\n\nd \t e  ", "hello<|endoftext|>world <|endoftext|>",
        "a" * 700, "  x　y   z", "日本語テキスト 123 ４５６ Ⅷ²", "é 🙂🙂 don’t 'tis", "  ", "\n\n\n a", "x\r\n\r\ny", "'s", "''s", "a'", "'re'", "'r",
        "'rex 'lll", "<|endof", "text|>", "-" * 60 + "   ====", "\x00\x01​z", "i'm I'M 'd'd'd 12'34's", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encode_all(texts, lexicon=None, target=1 << 12):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    out = []
    for _, data, offsets in blocks.text_blocks([batch], "text", target):
        ids, at, _, _ = bpe.checked_encode(data, offsets, bpe.vocabulary(PATH), lexicon)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def make_lexicon(tmp_path, words):
    path = tmp_path / "lexicon"
    path.write_bytes(bpe.compile_lexicon(words, bpe.vocabulary(PATH)))
    return bpe.map_lexicon(str(path))


def test_ids_equal_the_library(library, tmp_path):
    want = [library.encode(t or "", add_special_tokens=False).ids for t in HARD]
    lexicon = make_lexicon(tmp_path, [b" word", b"word", b" don", b"'t", "日本".encode(), b"a" * 30])
    for target in (1, 1 << 12, 1 << 22):
        assert encode_all(HARD, None, target) == want
        assert encode_all(HARD, lexicon, target) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("aab 'stlrevd\n\t12!?-é日🙂 ")), max_size=40), max_size=6))
def test_random_texts_equal_the_library(texts):
    library = Tokenizer.from_file(PATH)
    assert encode_all(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_automaton_numbers_its_words_and_is_minimal(tmp_path):
    words = sorted({b"walking", b"talking", b"walked", b"talked", b"walk", b"w", b"king"})
    lexicon = make_lexicon(tmp_path, words)
    probes = [*words, b"", b"wal", b"walkings", b"x", b"talk"]
    data = np.frombuffer(b"".join(probes), np.uint8)
    lengths = np.array([len(p) for p in probes])
    found = lexicon.find(data, np.cumsum(lengths) - lengths, lengths)
    assert found.tolist() == [*range(len(words)), -1, -1, -1, -1, -1]
    plain_trie = len({w[:i] for w in words for i in range(len(w) + 1)})
    assert len(lexicon.accepts) < plain_trie


def test_encode_and_decode_tables(spark, library):
    rows = [(i, t, "x", 1.0) for i, t in enumerate(HARD)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens double")
    out = bpe.bpe_encode(df, PATH, outputs=("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256"))
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(HARD):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids) and got[i].decoded == (t or "")
        assert got[i].ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == sha256((t or "").encode()).hexdigest()
    again = bpe.bpe_decode(out.select("doc_id", "ids"), PATH)
    assert {r.doc_id: r.decoded for r in again.collect()} == {i: t or "" for i, t in enumerate(HARD)}
    assert bpe.bpe_encode(df.where("false"), PATH).count() == 0


def test_query_round_trip(spark, sf, library):
    from wavepanel.llm.queries import QUERIES
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op2_bpe"].run(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(texts[r.doc_id].encode()).hexdigest()


def check_packing(rows, texts, library, window=2048):
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert by_doc.keys() == ids.keys()
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0
            at += r.length
        assert at == len(ids[i])
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
    return sum(map(len, ids.values())) / (len(by_sequence) * window)


def test_packing_query(spark, sf, library):
    from wavepanel.llm.queries import QUERIES
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert check_packing(QUERIES["op3_packing"].run(spark, sf).collect(), texts, library) > 0.97


def test_packing_edges(spark, library):
    texts = {0: None, 1: "", 2: "a", 3: "word " * 9000, 4: "same", 5: "same"}
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in texts.items()], "doc_id long, text string, sequence_id int, length int")
    check_packing(packing.pack_documents(df, PATH).collect(), texts, library)
    assert packing.pack_documents(df.where("false"), PATH).count() == 0


@pytest.mark.parametrize("kind", ["spread", "one length", "halves", "few"])
def test_plan_places_every_piece_once(kind):
    rng = np.random.default_rng(3)
    lengths = {"spread": rng.integers(1, 2049, 20_000), "one length": np.full(9_000, 1500), "halves": np.full(501, 1024), "few": np.array([7, 2041, 2048])}[kind]
    histogram = np.bincount(lengths, minlength=2049)
    plan = packing.plan(histogram)
    seen = np.zeros(2049, np.int64)
    room = {}
    for r in plan.itertuples():
        assert r.rank_from == seen[r.length]
        seen[r.length] += r.rank_to - r.rank_from
        for s in {r.sequence_from, r.sequence_from + r.rank_to - r.rank_from - 1}:
            room.setdefault(s, []).append((r.offset, r.length))
    assert (seen == histogram).all()
    for parts in room.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    sequences = int((plan.sequence_from + plan.rank_to - plan.rank_from).max())
    if kind in ("spread", "halves", "few"):
        assert lengths.sum() / (2048 * sequences) > 0.98


def test_words_and_hashes():
    texts = [" a  bb\tccc ", "", "bb", None, "\x0b\x0c", "a bb ccc"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    (_, data, offsets), = blocks.text_blocks([batch], "text")
    starts, ends, first = blocks.words(data, offsets)
    whole = data.tobytes()
    got = [[whole[starts[w]:ends[w]] for w in range(a, b)] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [(t or "").encode().split() for t in texts]
    h = blocks.span_hashes(data, starts, ends)
    assert h[1] == h[3] and len(set(h.tolist())) == 3
    assert blocks.run_hashes(h, 3)[0] == blocks.run_hashes(h, 3)[-1]
