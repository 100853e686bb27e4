"""Operator 5: drop lines that many documents share.

The lines of a text are exploded, normalised and hashed (128 bits); distinct documents are counted per hash with partial
aggregation; lines of hashes over the threshold go, except in the largest document id that holds them; the remaining
lines are put together again by position. All native: no line leaves the JVM.

A text is split at \\n; null counts as empty, which is one empty line. A line's key is the line without ASCII white space at
both ends, with A-Z in lower case; keys under min_chars code points never count. Rows without an id take no part
and stay whole. Rows that repeat an id count as one document and lose the same lines. Texts of any length are split whole;
outputs replace columns of their names, other columns stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavepanel.llm.names import carried, quoted, unused
from wavepanel.llm.store import keep

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit("\t\n\x0b\x0c\r ")), _UPPER, _LOWER)


def line_hashes(text: Column, min_chars: int) -> Column:
    """The distinct hashes of the long enough keys of a text."""
    keys = F.filter(F.transform(lines_of(text), line_key), lambda k: F.length(k) >= min_chars)
    return F.array_distinct(F.transform(keys, lambda k: F.unhex(F.md5(k))))


def shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(hash, keeper): hashes that at least min_docs distinct documents hold, and the largest id among them."""
    held = docs.select(F.col(doc_id).alias("__id"), F.explode(line_hashes(F.col(text), min_chars)).alias("hash"))
    return (held.groupBy("hash").agg(F.count_distinct("__id").alias("n"), F.max("__id").alias("keeper"))
            .where(F.col("n") >= min_docs).select("hash", "keeper"))


def drop_shared_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5,
                      kept_text: str = "kept_text", prefix: str = "") -> DataFrame:
    """The columns of docs with n_lines, n_dropped and the kept text (all after prefix); they replace columns of their names."""
    shared = keep(shared_lines(docs, doc_id, text, min_chars, min_docs))
    held = docs.select(F.col(doc_id).alias("__id"), F.explode(line_hashes(F.col(text), min_chars)).alias("hash"))
    drops = (held.join(shared, "hash").where(F.col("__id") < F.col("keeper"))
             .groupBy("__id").agg(F.collect_set("hash").alias("__drops")))
    own = unused(docs)
    drops = drops.withColumnsRenamed({"__id": own + "id", "__drops": own + "drops"})
    joined = docs.join(drops, docs[quoted(doc_id)] == drops[own + "id"], "left")
    lines = lines_of(docs[quoted(text)])
    gone = F.col(own + "drops")
    stay = F.filter(lines, lambda line: ~F.array_contains(gone, F.unhex(F.md5(line_key(line)))) | (F.length(line_key(line)) < min_chars))
    joined = joined.withColumn(own + "lines", lines).withColumn(own + "stay", F.when(gone.isNotNull(), stay).otherwise(F.col(own + "lines")))
    outputs = {"n_lines": F.size(own + "lines").cast("bigint"), "n_dropped": (F.size(own + "lines") - F.size(own + "stay")).cast("bigint"),
               kept_text: F.array_join(own + "stay", "\n")}
    return joined.select(*[F.col(quoted(c)) for c in carried(docs, [prefix + c for c in outputs])],
                         *[v.alias(prefix + c) for c, v in outputs.items()])
