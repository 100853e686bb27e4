"""Top-k search against a full sort; language, toxicity and extraction on held-out and planted cases."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavepanel.llm import html_text, language, topk, toxicity


# --- top-k ---

def brute_top(rows, k, asked):
    clean = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            clean.append((i, [math.floor(256 * float(np.float32(x))) for x in v]))
    queries = {}
    for i, v in clean:
        if asked(i):
            queries[i] = min(v, queries.get(i, v))
    out = []
    for q, u in queries.items():
        scores = sorted((-sum(a * b for a, b in zip(u, v, strict=True)), i) for i, v in clean if i != q and len(v) == len(u))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score double, ids string")


def test_top_k_against_full_sort(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 37)
    monkeypatch.setattr(topk, "QUERIES", 4)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(80)] + [(7, rows[7][1]), (20, rows[3][1])]
    rows += [(1000, None), (1020, [1.0, None] + [0.0] * 6), (1040, [float("nan")] * 8), (None, [1.0] * 8), (1060, [float("inf")] * 8), (1080, []), (1100, [1.0, 2.0]), (1101, [3.0, 4.0])]
    out = topk.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5).collect()
    assert sorted(tuple(r) for r in out) == brute_top(rows, 5, lambda i: i % 20 == 0)


def test_top_k_edges(spark):
    assert topk.top_k(vectors(spark, []), F.lit(True), 5).count() == 0
    assert topk.top_k(vectors(spark, [(1, [1.0])]), F.lit(True), 5).count() == 0
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 0.0])]
    assert sorted(tuple(r) for r in topk.top_k(vectors(spark, rows), F.col("vec_id") == 1, 5).collect()) == [(1, 1, 2, 0), (1, 2, 3, 0)]
    with pytest.raises(ValueError, match="2\\^53"):
        topk.top_k(vectors(spark, [(1, [1e9]), (2, [1e9])]), F.lit(True), 5)


# --- language ---

def test_language_of_held_out_documents(spark):
    from wavepanel.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op6_language"].run(spark, sf).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) <= 2


def test_language_edges_and_rejection(spark):
    rng = random.Random(2)
    def text(letters, n):
        return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))
    rows = [(i, text("abcde" if i % 2 else "vwxyz", 60), "one" if i % 2 else "two", 0.5) for i in range(80)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = language.fit(train, F.lit(True))
    probe = [(1, text("abcde", 50)), (2, text("VWXYZ", 50)), (3, None), (4, ""), (5, "12 ?! 3"), (6, text("μνξοπ", 80)), (7, "ab"), (None, text("abcde", 9000))]
    out = language.identify(spark.createDataFrame([(i, t, 9.0, "zz") for i, t in probe], "doc_id long, text string, score double, lang_pred string"), model)
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in out.collect()}
    assert got[1] == ("one", False) and got[2] == ("two", False) and got[7] == ("one", False) and got[None] == ("one", False)
    assert got[3] == got[4] == got[5] == ("und", True)
    assert got[6][1]
    none = language.fit(train.where("false"), F.lit(True))
    assert {(r.lang_pred, r.score) for r in language.identify(train, none).collect()} == {("und", 0.0)}
    assert language.identify(train.where("false"), model).count() == 0


def plain_grams(text):
    """Hashed n-grams of one text, letter by letter."""
    letters = "".join(c if c.isalpha() else "\0" for c in text.lower())
    words = [w for w in letters.split("\0") if w]
    stream = [0] + [x for w in words for x in [*map(ord, w), 0]]
    out = np.zeros(language.BUCKETS)
    mask = 0xFFFFFFFF
    for a, b, c in zip(stream, stream[1:], stream[2:] + [0], strict=False):
        if b:
            two = (a * 40503 + b) & mask
            for gram in ((b * 2654435761) & mask, (two * 2246822519 + 1) & mask, (((two * 69069 + c) & mask) * 3266489917 + 2) & mask):
                out[gram >> 20] += 1
    return out


def test_language_scores_by_plain_arithmetic(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("".join(rng.choice("abcde" if i % 2 else "vwxyz") for _ in range(rng.randint(1, 6))) for _ in range(50)), "one" if i % 2 else "two") for i in range(60)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    probe = ["a", "v", "b a", "abc, de!", "the house", *[t for _, t, _ in rows[:20]], "é a", "x1y", "", "?"]
    alone = [model.predict([t]) for t in probe]
    for t, (name, score, _) in zip(probe, alone, strict=True):
        v = np.log1p(plain_grams(t)) * model.idf
        cosine = model.centroids @ v / max(np.linalg.norm(v), 1e-12)
        assert score[0] == pytest.approx(max(0, cosine.max()) if v.any() else 0, abs=1e-5)
        assert name == ["und"] if not v.any() else name == [model.languages[int(cosine.argmax())]]
    assert alone[0][0] == ["one"] and alone[1][0] == ["two"]                      # one letter is a text
    for order in (probe, probe[::-1], sorted(probe)):
        names, scores, rejected = model.predict(order)
        for t, n, s, r in zip(order, names, scores, rejected, strict=True):
            want = alone[probe.index(t)]
            assert (n, r) == (want[0][0], want[2][0]) and s == pytest.approx(want[1][0], abs=1e-6)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(probe)], "doc_id long, text string")
    for parts in (1, 7):
        for r in language.identify(df.repartition(parts), model).collect():
            assert (r.lang_pred, r.rejected) == (alone[r.doc_id][0][0], alone[r.doc_id][2][0])


def test_many_languages_are_learned(spark):
    rows = [(i * 300 + j, chr(0x4E00 + 3 * i) * 3 + chr(0x4E01 + 3 * i) * (2 + j), f"l{i:03d}") for i in range(230) for j in range(3)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert len(set(model.languages)) == 230


@pytest.mark.parametrize("out", ["de", "en", "es", "fr"])
def test_language_left_out_is_rejected(spark, out):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200")
    model = language.fit(docs, F.col("lang") != out)
    rows = language.identify(docs, model, prefix="p_").select("lang", "p_rejected").collect()
    share = {known: np.mean([r.p_rejected for r in rows if (r.lang != out) == known]) for known in (False, True)}
    assert share[False] > 0.95 and share[True] < 0.01, share


def test_single_odd_texts_make_no_centroid():
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(size=(200, 40)))
    x[:, 20:] *= 0.01
    x[:3] = np.eye(40)[[25, 30, 35]]                             # three odd ones
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centers = language.spherical_means(x, 4)
    assert np.bincount((x @ centers.T).argmax(1)).min() >= 10 and (centers @ x[:3].T).max() < 0.5


# --- toxicity ---

@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(9)
    plain = ["tree", "house", "river", "walks", "green", "the", "and", "stone", "little", "window", "morning", "paper", "letter", "garden", "silver", "open"]
    bad = ["idiot", "moron", "scum", "worthless"]
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.randint(8, 60))]
        if i % 4 == 0:
            for _ in range(rng.randint(1, 3)):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))


@pytest.mark.parametrize("word, want", [("idi0t", "idiot"), ("1d10t", "idiot"), ("m0r0n", "moron"), ("$cum", "scum"), ("idiooooot", "idiot"), ("w0rthle$$", "worthless"),
                                        ("i.d.i.o.t", "idiot"), ("tree", "tree"), ("the,***", "the"), ("m-o-r-o-n", "moron")])
def test_words_are_restored(insults, word, want):
    assert toxicity.read_token(word, insults.chars) == [want]


def test_disguised_toxic_texts_are_found(spark, insults):
    toxic = ["the green 1d10t walks", "you m o r o n and the tree", "little scuuuuum", "worthless", "IDIOT!! the house"]
    clean = ["the green house walks", "", None, "a a a a a a a a a", "the tree 123 (garden) $5", "window " * 5000, "1 2 3 4 5 6"]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(toxic + clean)], "doc_id long, text string, score string")
    got = {r.doc_id: r.score for r in toxicity.score(df, insults).collect()}
    assert all(got[i] >= 0.3 for i in range(len(toxic)))
    assert all(got[i] < 0.3 for i in range(len(toxic), len(got)))
    assert toxicity.score(df.where("false"), insults).count() == 0


def test_long_tokens_and_runs_are_read_whole(insults):
    assert toxicity.read_token("idi0t-" * 10 + "m0ron", insults.chars)[:11] == ["idiot"] * 10 + ["moron"]
    assert toxicity.read_token("idiot" * 12 + "0", insults.chars)                                # 61 signs
    assert toxicity.parse('token="0641917ea4e9feb9cda83477b57ac2654884f485"')[1] == []
    assert toxicity.parse("https://x.org/idi0t/a1b2")[1] == []
    letters = " ".join("worthless" * 12)
    assert toxicity.read_text(f"so {letters} end")[1] == ["worthless" * 12]
    assert "".join(toxicity.restore("worthless" * 12, insults.chars, True)) == "worthless" * 12
    for gap in ("  ", "\t", "\n", " \n "):
        assert toxicity.read_text(f"you {gap.join('moron')} and")[1] == ["moron"]
    assert toxicity.read_text("a s s")[1] == ["ass"] and toxicity.read_text("a a a")[1] == [] and toxicity.read_text("x b o y")[1] == ["xboy"] and toxicity.read_text("the d o g")[1] == ["dog"]
    assert toxicity.read_text("1 2 3 4 5")[1] == []


def test_viterbi_by_full_enumeration(insults):
    from itertools import product
    for token, spaced in (("m0r0n", False), ("$cum", False), ("1d10t", False), ("scuuum", False), ("idi0t", True), ("(um", False)):
        model = insults.chars.covering(token, spaced)
        best = None
        for path in product(*toxicity.lattice(token, spaced), [("\0", 0.0)]):
            cost, history = 0.0, "\0"
            for letters, channel in path:
                cost += channel
                for sign in letters:
                    cost += model.cost(history, sign)
                    history = (history + sign)[-(toxicity.ORDER - 1):]
            said = "".join(x for x, _ in path[:-1])
            if best is None or cost < best[0] - 1e-9:
                best = (cost, said)
        assert toxicity.restore(token, model, spaced) == [w for w in best[1].split("\0") if w], token


def test_toxicity_without_both_classes(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}


def test_toxicity_of_held_out_documents(spark):
    from wavepanel.llm.queries import QUERIES
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in QUERIES["op9_toxicity"].run(spark, sf).collect() if r.held_out and r.doc_id in labels]
    found = [r.predicted for r in held if labels[r.doc_id] == 1]
    false = [r.predicted for r in held if labels[r.doc_id] == 0]
    assert np.mean(found) > 0.9 and np.mean(false) < 0.01


def test_rare_runs_stay_in_the_character_model(spark):
    rng = np.random.default_rng(3)
    texts = ["".join(map(chr, row)) for row in rng.integers(0x4E00, 0x9000, (1000, 450))]      # some 450,000 distinct runs, each seen twice
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts, "the zyqvok of it"]], "text string")
    chars = toxicity.fit_char_model(docs)
    assert toxicity.read_token("zyqv0k", chars) == ["zyqvok"]


def test_signs_beyond_16_bits_are_letters(spark):
    word = "".join(map(chr, (0x10428, 0x10430, 0x10430, 0x10435)))                       # Deseret
    chars = toxicity.fit_char_model(spark.createDataFrame([(f"{word} " * 30,)], "text string"))
    assert toxicity.read_token(word[:2] + word[1] * 3 + word[3], chars) == [word]


def test_scores_by_broadcast_and_by_join_agree(spark, insults, monkeypatch):
    texts = ["the green 1d10t walks", "you m o r o n and the tree", "the green 1d10t walks", "little scuuuuum", "the tree", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = sorted(tuple(r) for r in toxicity.score(docs, insults).select("doc_id", "score").collect())
    monkeypatch.setattr(toxicity, "SENT_BYTES", -1)
    assert sorted(tuple(r) for r in toxicity.score(docs, insults).select("doc_id", "score").collect()) == want


# --- extraction ---

@pytest.fixture(scope="module")
def field():
    return html_text.trained_field()


def test_held_out_layouts(field):
    right = 0
    pages = html_text.labelled_pages(120, seed=77)
    for html, kept in pages:
        right += html_text.main_text(html, field) == "\n".join(" ".join(k.split()) for k in kept)
    assert right / len(pages) > 0.9


@pytest.mark.parametrize("html, want", [
    ("", ""), ("plain text", "plain text"), ("<p>a &amp; b &lt;c&gt; &#233;&nbsp;x</p><p>two<br>lines</p>", "a & b <c> é x\ntwo lines"),
    ("<article><h1>T</h1><p>One.<p>Two <b>bold.</b></article>", "T\nOne.\nTwo bold."),
    ("<body><nav><a href=x>Home</a></nav><main><p>Text.</p></main><footer>&copy; us</footer>", "Text."),
    ("<article><p>Body text here.</p><div class='ad'>Buy now</div><p>More.</p></article><div class='comments'><p>Great post, thanks!</p></div>", "Body text here.\nMore."),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><article><p>Yes.</p></article>", "Yes."),
    ("<article><p>Unclosed <div>bits</article></p></section>", "Unclosed\nbits"),
    ("<html><head><title>no</title><body><article><p>Yes.</p></article>", "Yes.")])
def test_small_pages(field, html, want):
    assert html_text.main_text(html, field) == want


def test_pages_query(spark, sf):
    from wavepanel.llm.queries import QUERIES
    import html as entities
    import re
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op4_html_text"].run(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


@pytest.mark.parametrize("html, want", [
    ("<video src=x><article><h1>Title here</h1><p>One two three four five.</p></article>", "Title here\nOne two three four five."),
    ("<article><p>See <video>no video</video> this text here.</p></article>", "See this text here."),
    ("<article><p>See this text.</p><object><div>no object</div></object><p>More of it here.</p></article>", "See this text.\nMore of it here.")])
def test_media_elements(field, html, want):
    assert html_text.main_text(html, field) == want


def test_nesting_costs_nothing(field):
    import time
    import tracemalloc
    for html in ("<div>x" * 50_000, "<div>" * 50_000 + "</b>" * 50_000, "<p><i>" * 30_000, "<body>" * 30_000, "<a>" * 50_000 + "x"):
        tracemalloc.start()
        start = time.time()
        html_text.main_text(html, field)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 200 << 20 and time.time() - start < 60


def test_pages_edges(spark, field):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (3, "<p>" * 3000 + "x", "t"), (4, "<!-- <p>a</p> -->", "t")], "page_id long, html string, text string")
    out = html_text.extract(df, field=field)
    assert {r.page_id: r.text for r in out.collect()} == {1: "", 2: "", 3: "x", 4: ""}
    assert html_text.extract(df.where("false"), field=field).count() == 0
