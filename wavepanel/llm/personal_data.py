"""Operator 12: personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Base spans (e-mail, IPv4 address, card number, phone number) follow fixed forms with a check of each match. They are the seeds:

1. The tokens with a digit or @ of every text are found with the white space between them. Runs of up to WINDOW such tokens, one blank apart and trimmed of
   punctuation, are the instances; those that lie across a base span are left out.
2. Every instance stands in patterns: its exact shape (digits 9, letter runs a), its shape with runs of digits as one together with the word before it,
   and, where it is not part of a longer run, the two words before it.
3. Pattern and instance graph, round after round: a pattern's confidence in a kind is the share of its distinct instances that are of that kind, weighted by
   their own confidence, with one doubtful instance added; an instance's confidence is 1 less the product of the doubts of its patterns. Patterns from SUPPORT and
   PATTERN on are believed, instances from INSTANCE on that also pass the check of their kind become seeds of the next round, until nothing new is found.
4. Occurrences of believed instances outside base spans become spans. Of two that overlap the more confident, then the longer, then the earlier one stays.

Positions come from running sums over the matches of a text. The forms are written so that each text is read in linear time: runs are possessive and a match begins
only where a run begins. The graph holds each distinct edge once, whatever the number of occurrences.

Whole texts are read; null and empty texts have no spans. Every row has a key of its own, so ids may be missing or repeat; repeated rows count as one instance, as
instances are distinct strings. Outputs replace columns of their names, other columns stay. An empty table gives an empty result. Without seeds nothing is added.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavepanel.llm.names import carried, quoted, unused
from wavepanel.llm.store import keep

KINDS = ("email", "ip", "card", "phone")
#: Tokens of an instance at most.
WINDOW = 5
#: Code points of an instance at most: no e-mail address is longer.
LONGEST = 320
#: Distinct seeds and confidence that a pattern needs, confidence that an instance needs, rounds at most.
SUPPORT, PATTERN, INSTANCE, ROUNDS = 5, 0.8, 0.9, 5

# The forms of the kinds, equal to the plain ones of the contract:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     a local part begins where its run begins or the last match ended
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)                  likewise a run of digits
#   card  [0-9]([ -]?[0-9])+ with 14 to 19 digits               a run of digits with single signs between them is matched whole or not at all
#   phone \+[0-9][ ().0-9-]+[0-9]
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A sign that every match of a form holds.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}
_TOKEN = r"(?<!\S)(?=\S*[0-9@])\S++"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of one digit or more passes the Luhn check."""
    turned = F.reverse(digits)

    def part(i: Column) -> Column:
        d = F.substring(turned, i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), part), F.lit(0), lambda s, x: s + x) % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    """Whether a match of the form of a kind passes the kind's check."""
    n = F.length(_digits(value))
    parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    card = F.when(n.between(14, 19), luhn(_digits(value))).otherwise(False)
    return F.when(kind == "email", F.lit(True)).when(kind == "ip", small).when(kind == "card", card).otherwise(n.between(10, 15))


def plausible(kind: Column, value: Column) -> Column:
    """Whether an instance of any form may be of a kind."""
    form = (F.when(kind == "email", value.contains("@")).when(kind == "ip", value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"))
            .when(kind == "card", value.rlike(r"^[0-9][0-9 ./-]*+(?<=[0-9])$")).otherwise(value.rlike(r"^[+(]{0,2}[0-9][0-9 ()./-]*+(?<=[0-9])$")))
    return F.when(form, passes(kind, value)).otherwise(False)


# --- matches ---

def _hits(text: Column, form: str, extra=lambda piece: ()) -> Column:
    """The matches in order: array of (value, gap), gap being the length of the piece before a match, and more about that piece."""
    def hit(piece: Column, value: Column) -> Column:
        return F.struct(value.alias("value"), F.length(piece).alias("gap"), *extra(piece))

    return F.filter(F.zip_with(F.split(text, form, -1), F.regexp_extract_all(text, F.lit(form), F.lit(0)), hit), lambda h: h["value"].isNotNull())


def _before(piece: Column) -> tuple[Column, ...]:
    """The word and the two words before a token, and whether the token before it is one blank away."""
    words = F.split(F.rtrim(F.lower(F.substring(piece, -60, 60))), r"\s+")
    return (F.element_at(words, -1).alias("word"), F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)), " ").alias("words"),
            (piece == " ").alias("joined"))


def _numbered(kind: str):
    return lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), h["value"].alias("value"), h["gap"].alias("gap"))


def find_matches(docs: DataFrame, text: str, columns: list[str], own: str) -> DataFrame:
    """The columns of docs, a key of each row, the matches of all forms and the tokens with a digit or @; kept."""
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    found = []
    for kind, form in FORMS.items():
        at = F.when(t.contains(SIGNS[kind]), _hits(t, form)) if kind in SIGNS else _hits(t, form)
        found.append(F.transform(at, _numbered(kind)))
    none = F.array().cast("array<struct<kind:string,i:int,value:string,gap:int>>")
    return keep(docs.select(*[F.col(quoted(c)) for c in columns], F.monotonically_increasing_id().alias(own + "row"),
                            F.concat(*[F.coalesce(f, none) for f in found]).alias(own + "matches"), _hits(t, _TOKEN, _before).alias(own + "tokens")))


def base_spans(matches: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of the matches that pass; from (row, matches)."""
    rows = matches.select("row", F.inline("matches"))
    upto = Window.partitionBy("row", "kind").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("bigint") + F.length("value")).over(upto))
    return rows.where(passes(F.col("kind"), F.col("value"))).select("row", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def instances(tokens: DataFrame) -> DataFrame:
    """(row, at, start, end, value, word, words): trimmed runs of tokens from token number `at` on; from (row, tokens). words is null inside a longer run."""
    rows = tokens.select("row", F.posexplode("tokens").alias("at", "t")).select("row", "at", "t.*")
    order = Window.partitionBy("row").orderBy("at")
    rows = rows.withColumn("start", F.sum(F.col("gap").cast("bigint") + F.length("value")).over(order) - F.length("value"))
    run = F.collect_list(F.struct("value", "joined")).over(order.rowsBetween(0, WINDOW)).alias("run")
    rows = rows.select("row", "at", "start", "word", "words", "joined", run)
    sizes = F.filter(F.sequence(F.lit(1), F.least(F.size("run"), F.lit(WINDOW))),
                     lambda k: F.forall(F.slice("run", F.lit(2), k - 1), lambda x: x["joined"]))
    rows = rows.select("*", F.explode(sizes).alias("k"))
    raw = F.array_join(F.transform(F.slice("run", F.lit(1), F.col("k")), lambda x: x["value"]), " ")
    alone = ~F.col("joined") & ~F.coalesce(F.try_element_at("run", F.col("k") + 1)["joined"], F.lit(False))
    rows = rows.select("row", "at", "start", F.when(F.col("joined"), "#").otherwise(F.col("word")).alias("word"),
                       F.when(alone, F.col("words")).alias("words"), raw.alias("raw"))
    lead = F.length(F.regexp_extract("raw", r"^[^0-9A-Za-z+(]*", 0))
    value = F.regexp_replace("raw", r"^[^0-9A-Za-z+(]+|(?<![^0-9A-Za-z)])[^0-9A-Za-z)]++$", "")
    rows = rows.select("row", "at", (F.col("start") + lead).alias("start"), value.alias("value"), "word", "words")
    return rows.where((F.col("value") != "") & (F.length("value") <= LONGEST)).withColumn("end", F.col("start") + F.length("value"))


def apart(found: DataFrame, base: DataFrame) -> DataFrame:
    """found with `clear`: no base span overlaps it. Instances equal to a base span stay and are not clear, other ones across a base span go."""
    names = found.columns
    both = found.withColumn("b", F.lit(None).cast("bigint")).unionByName(base.select("row", "start", "end", F.col("end").alias("b")), allowMissingColumns=True)
    early = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    late = Window.partitionBy("row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("row", "start", "end")
    both = both.select("*", F.max("b").over(early).alias("reach"), F.min(F.when(F.col("b").isNotNull(), F.col("start"))).over(late).alias("next"),
                       F.max("b").over(same).alias("equal"))
    clear = ~(F.coalesce(F.col("reach") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    return both.where("b is null").withColumn("clear", clear).where(F.col("clear") | F.col("equal").isNotNull()).select(*names, "clear")


# --- graph ---

def shapes(found: DataFrame) -> DataFrame:
    """Distinct edges (pattern, value) of the instances."""
    exact = F.regexp_replace(F.regexp_replace("value", r"\p{L}+", "a"), "[0-9]", "9")
    short = F.regexp_replace(exact, "9+", "9")
    patterns = F.array(F.concat(F.lit("exact "), exact), F.concat(F.lit("behind "), "word", F.lit(" "), short), F.concat(F.lit("after "), "words"))
    return found.select("value", F.explode(F.array_compact(patterns)).alias("pattern")).distinct()


def bootstrap(edges: DataFrame, seeds: DataFrame, support: int = SUPPORT, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Kept tables of the believed instances (value, kind, c), seeds with c = 1 among them, and of the believed patterns (pattern, kind, confidence, seeds, n).

    edges (pattern, value) and seeds (value, kind) are kept tables of distinct rows.
    """
    totals = keep(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    first = seeds.select("value", "kind", F.lit(1.0).alias("c"))
    known, size = keep(first), -1
    good = None
    for _ in range(rounds):
        sums = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum("c").alias("seeds")).where(F.col("seeds") >= support)
        good = keep(sums.join(totals, "pattern").withColumn("confidence", F.col("seeds") / (F.col("n") + 1)).where(F.col("confidence") >= PATTERN)
                    .select("pattern", "kind", "confidence", "seeds", "n"))
        c = 1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))
        new = (edges.join(good, "pattern").groupBy("value", "kind").agg(c.alias("c")).where((F.col("c") >= INSTANCE) & plausible(F.col("kind"), F.col("value")))
               .groupBy("value").agg(F.max(F.struct("c", "kind")).alias("b")).select("value", "b.kind", "b.c"))
        known = keep(first.unionByName(new.join(first.select("value"), "value", "left_anti")))
        n = known.count()
        if n == size:
            break
        size = n
    return known, good


def settle(found: DataFrame) -> DataFrame:
    """Of the overlapping rows (row, at, kind, start, end, c) the better ones: more confident, longer, earlier. Runs that begin WINDOW tokens apart cannot overlap."""
    near = Window.partitionBy("row").orderBy("at").rangeBetween(1 - WINDOW, WINDOW - 1)
    order = F.struct(F.col("c").alias("c"), (F.col("end") - F.col("start")).alias("long"), (-F.col("start")).alias("early"), F.col("kind").alias("kind"))
    rows = found.withColumn("own", order).withColumn("others", F.collect_list(F.struct("start", "end", "own")).over(near))
    beaten = F.exists("others", lambda o: (o["start"] < F.col("end")) & (o["end"] > F.col("start")) & (o["own"] > F.col("own")))
    return rows.where(~beaten).drop("own", "others")


def _listed(spans: Column) -> Column:
    """kind:start:end of the spans by start, then kind."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, text: str = "text", columns: Iterable[str] | None = None, support: int = SUPPORT,
                       patterns: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """The named columns of docs (all by default) with n_email, n_ip, n_card and n_phone (base spans), n_added (spans that the method found), base (the base spans
    as text) and spans (all spans as text). With patterns also the kept table of believed patterns."""
    outputs = [f"n_{k}" for k in KINDS] + ["n_added", "base", "spans"]
    columns = [c for c in carried(docs, outputs) if columns is None or c in set(columns)]
    own = unused(docs)
    table = find_matches(docs, text, columns, own)
    base = keep(base_spans(table.select(F.col(own + "row").alias("row"), F.col(own + "matches").alias("matches"))))
    found = keep(apart(instances(table.select(F.col(own + "row").alias("row"), F.col(own + "tokens").alias("tokens"))), base))
    seeds = keep(base.where(F.length("value") <= LONGEST).select("value", "kind").distinct())
    known, believed = bootstrap(keep(shapes(found)), seeds, support)
    hits = found.where("clear").join(known, "value").where(plausible(F.col("kind"), F.col("value")))
    added = settle(hits.select("row", "at", "kind", "start", "end", "c"))
    rank = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS, F.when(F.lit(False), -1))
    span = F.struct("start", rank.alias("rank"), "end", "kind")
    every = base.select("row", "kind", "start", "end", F.lit(True).alias("base")).unionByName(added.select("row", "kind", "start", "end", F.lit(False).alias("base")))
    counts = [F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS]
    per_row = every.groupBy(F.col("row").alias(own + "row")).agg(
        *[c.alias(own + n) for c, n in zip(counts, outputs, strict=False)], F.count(F.when(~F.col("base"), 1)).alias(own + "n_added"),
        _listed(F.collect_list(F.when(F.col("base"), span))).alias(own + "base"), _listed(F.collect_list(span)).alias(own + "spans"))
    result = table.select(*map(quoted, columns), own + "row").join(per_row, own + "row", "left").select(
        *[F.col(quoted(c)) for c in columns], *[F.coalesce(F.col(own + n), F.lit(0)).alias(n) for n in outputs[:5]],
        *[F.coalesce(F.col(own + n), F.lit("")).alias(n) for n in outputs[5:]])
    return (result, believed) if patterns else result
