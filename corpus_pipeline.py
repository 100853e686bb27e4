"""The corpus pipeline: language ID, line dedup, near-duplicate removal, passage dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame. All but the last return
the columns of documents; where a stage changes the text it sets n_chars anew. The near-duplicate stage keeps one row of each group, whether
ids repeat or are missing: a row without doc_id only where no row of its group has one.

In every stage columns of other names pass through unchanged, whatever they are called: working columns take names that the table does not have. Rows may repeat; ids may be null
or repeat. Texts of any length are read whole. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.llm import jaccard, language, line_dedup, packing, substrings
from wavepanel.llm.names import quoted, unused
from wavepanel.llm.store import keep


def _with_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    new = {"text": F.col(text), "n_chars": F.length(text).cast("bigint")}
    return df.select(*[new[c].alias(c) if c in new else F.col(quoted(c)) for c in columns])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised; the stored language is not changed. Null, empty and letterless texts have none and go; rows of equal text go or
    stay together. Without labelled rows every document goes."""
    model = language.fit(docs, ~language.held_out())
    own = unused(docs)
    return language.identify(docs, model, prefix=own).where(~F.col(own + "rejected")).select(*map(quoted, docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that five documents or more share; every document stays, a null or emptied text as an empty one. Rows that repeat an id count as one document."""
    own = unused(docs)
    return _with_text(line_dedup.drop_shared_lines(docs, prefix=own), docs.columns, own + "kept_text")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays, that of the smallest id. The rows are written once with a key of their own."""
    key = unused(docs) + "row"
    rows = keep(docs.withColumn(key, F.monotonically_increasing_id()))
    gone = jaccard.near_components(rows, row=key).where("not first").select(F.col("row_key").alias(key))
    return rows.join(gone, key, "left_anti").select(*map(quoted, docs.columns))


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove passages of 35 words or more that stand anywhere else. Texts without such passages keep their white space, null ones become empty; every row counts, so
    rows that still repeat a text lose it both."""
    own = unused(docs)
    kept = substrings.drop_repeated_passages(docs, join_untouched=False, prefix=own)
    return _with_text(kept, docs.columns, own + "kept_text")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all that is left into sequences of at most 2048 tokens; one row per piece, an empty text being its end token alone. Only doc_id and text are used."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language_stage), ("lines", line_stage), ("near_duplicates", near_duplicate_stage), ("passages", passage_stage),
          ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what a stage returns is written once and read again by the next."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i + 1 < len(STAGES):
            df = keep(df)
    return df


#: Language ID and tokens are not SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None
