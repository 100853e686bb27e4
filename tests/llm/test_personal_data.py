"""Personal data: base spans against Python's re, found spans on planted contexts."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wavepanel.llm import personal_data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def good(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def base(text):
    found = [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for order, (kind, form) in enumerate(PLAIN.items())
             for m in re.finditer(form, text or "") if good(kind, m.group())]
    return ",".join(x for _, _, x in sorted(found))


def check_base(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in texts], "doc_id long, text string, spans string, row int")
    rows = personal_data.find_personal_data(docs).collect()
    want = Counter((i, base(t)) for i, t in texts)
    assert Counter((r.doc_id, r.base) for r in rows) == want
    for r in rows:
        assert r.row == 3
        spans, kept = set(filter(None, r.spans.split(","))), set(filter(None, r.base.split(",")))
        assert kept <= spans and len(spans) - len(kept) == r.n_added
        kinds = Counter(x.split(":")[0] for x in kept)
        assert (kinds["email"], kinds["ip"], kinds["card"], kinds["phone"]) == (r.n_email, r.n_ip, r.n_card, r.n_phone)
        order = [(int(x.split(":")[1]), personal_data.KINDS.index(x.split(":")[0])) for x in filter(None, r.spans.split(","))]
        assert order == sorted(order)


def test_base_on_given_documents(spark, sf):
    check_base(spark, [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()])


def test_base_on_made_up_signs(spark):
    rng = random.Random(3)
    signs = ["1", "23", "4111111111111111", "4111 1111 1111 1111", "a@b.c", "x@y", ".", "..", "@", "+", "-", " ", "  ", "255", "256", "007", "10.0.0.1", "(", ")", "é", "🙂", "\n",
             "+1 (269) 555-3296", "a", "_", "%"]
    texts = [(i, "".join(rng.choice(signs) for _ in range(rng.randint(1, 25)))) for i in range(1500)]
    texts += [(None, "a@b.c_x@d.e"), (None, "a@b.c_x@d.e"), (1, None), (2, ""), (3, "a@b.c@d.e"), (4, "0000000255.1.2.3"), (5, "99999999999.1.2.3"), (6, "1.2.3.4.5.6.7.8")]
    check_base(spark, texts)


def test_long_texts_are_read_in_linear_time(spark):
    n = 200_000
    texts = [(1, "a" * n), (2, "1" * n), (3, "1." * n), (4, "a.b-" * n), (5, "+1(" + "(" * n), (6, "-" * n + "5"), (7, "a@" + "b." * n), (8, "12 " * n), (9, "x@y.z " * 20_000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    rows = {r.doc_id: r for r in personal_data.find_personal_data(docs).collect()}
    assert rows[9].n_email == 20_000 and rows[7].n_email == 1 and rows[2].n_card == 0 and rows[8].n_card == 0


def card(rng):
    stem = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
    return next(stem + str(d) for d in range(10) if luhn(stem + str(d)))


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(8)
    texts = [(i, f"some words reach me at +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} or pay with {card(rng)} today") for i in range(60)]
    hidden = [(100, "today +1 (301) 555-2222 " + card(rng) + " end", 2),           # phone and card side by side fail as one match each
              (101, "please reach me at 269-555-0177 soon", 1),                   # only the words before it tell
              (102, "the year 2019 had 365 days and 4111111111111112 atoms", 0),
              (103, "part 269-555-0178 in the list", 0)]
    docs = spark.createDataFrame(texts + [h[:2] for h in hidden], "doc_id long, text string")
    rows, patterns = personal_data.find_personal_data(docs, patterns=True)
    return texts, hidden, {r.doc_id: r for r in rows.collect()}, patterns.collect()


def test_contexts_and_shapes_find_what_the_forms_miss(planted):
    texts, hidden, rows, patterns = planted
    assert {i: rows[i].n_added for i, _, _ in hidden} == {i: n for i, _, n in hidden}
    text = hidden[0][1]
    at = text.index("+1")
    assert rows[100].base == "" and rows[100].spans == f"phone:{at}:{at + 17},card:{at + 18}:{at + 34}"
    assert rows[101].spans == "phone:19:31"
    assert {("exact +9 (999) 999-9999", "phone"), ("exact 9999999999999999", "card"), ("after me at", "phone")} <= {(p.pattern, p.kind) for p in patterns}
    assert all(rows[i].n_added == 0 and rows[i].n_phone == 1 and rows[i].n_card == 1 for i, _ in texts)


def test_native_and_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data.find_personal_data(docs).count() == 0
    docs = spark.createDataFrame([(1, None), (2, "no data"), (2, "7")], "doc_id long, text string")
    found = personal_data.find_personal_data(docs)
    assert found.where(F.col("spans") != "").count() == 0 and found.count() == 3
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
