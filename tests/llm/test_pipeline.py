"""The pipeline against brute force on the smallest tables, and on odd rows."""

import sys
from collections import Counter
from hashlib import sha256
from pathlib import Path

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline  # noqa: E402
from test_blocks_bpe_packing import check_packing  # noqa: E402
from test_dedup import brute_components, brute_lines, brute_passages  # noqa: E402


def stage_results(spark, docs, sf):
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], sf).cache())
    return out


@pytest.fixture(scope="module")
def results(spark, sf):
    return stage_results(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)


def texts(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def digest(text):
    return sha256((text or "").encode()).hexdigest()


def test_columns_and_order_of_stages(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "passages", "packing"]
    assert all(df.columns == results[0].columns for df in results[:-1])


def test_language_stage_keeps_clean_documents(results):
    assert results[1].count() >= 0.99 * results[0].count()


def test_line_stage(results):
    want = Counter({(k[0], k[3]): v for k, v in brute_lines(texts(results[1])).items()})
    assert Counter((i, digest(t)) for i, t in texts(results[2])) == want
    assert results[2].where(F.col("n_chars") != F.length("text")).count() == 0


def test_near_duplicate_stage(results):
    groups = brute_components(texts(results[2]))
    assert sorted(i for i, _ in texts(results[3])) == sorted(i for i, _, c in groups if i == c)


def test_passage_stage(results):
    want = {k[0]: k for k in brute_passages(texts(results[3]))}
    for i, t in texts(results[4]):
        _, n, gone, kept = want[i]
        assert digest(" ".join(t.split())) == kept or gone == 0
        assert len(t.split()) == n - gone


def test_packing_stage(results):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_packing(results[5].collect(), dict(texts(results[4])), library)


def test_odd_rows(spark, sf):
    rows = [(None, "the house and the tree stand by the river", "en"), (1, None, "en"), (2, "", None), (3, "12 34", "en"), (4, "the house and the tree", "en"),
            (4, "the house and the tree", "en"), (5, "word " * 20000, "en"), (6, "the house and the tree stand by the river now and then", None)]
    docs = spark.createDataFrame([(i, t, x, "s", 0, 1, "k") for i, t, x in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, score int, kept_text string")
    out = stage_results(spark, docs, sf)
    assert all(df.columns == docs.columns for df in out[:-1])
    assert {r.score for r in out[4].collect()} <= {1} and {i for i, _ in texts(out[1])} == {None, 4, 5, 6}
    empty = stage_results(spark, docs.where("false"), sf)
    assert [df.count() for df in empty] == [0] * 6


def test_one_row_of_each_group_stays(spark):
    def text(stem, n=60):
        return " ".join(f"{stem}{i}" for i in range(n))
    rows = [(1, text("a")), (1, text("a")), (1, text("a")),                                  # a repeated row
            (2, text("b")), (None, text("b")), (None, text("b") + " end"),                   # copies without id
            (None, text("c")), (None, text("c")), (None, text("d")),                         # no id in the group
            (3, text("e")), (4, text("e")), (4, text("f")), (4, text("g")), (5, text("g")),  # two texts of one id, one a copy
            (None, ""), (None, None), (6, ""), (6, "")]                                      # these link with nothing
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    near = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert near.columns == docs.columns
    want = [(1, text("a")), (2, text("b")), (None, text("c")), (None, text("d")), (3, text("e")), (4, text("f")), (4, text("g")),
            (None, ""), (None, None), (6, ""), (6, "")]
    assert Counter(texts(near)) == Counter(want)
    assert Counter(texts(corpus_pipeline.passage_stage(spark, near.cache(), ""))) == Counter((i, t or "") for i, t in want)
