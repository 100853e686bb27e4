"""The registered queries of the subpackage and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.llm import (
    alignment,
    bpe,
    exact_dedup,
    html_text,
    jaccard,
    language,
    line_dedup,
    packing,
    personal_data,
    phrases,
    substrings,
    topk,
    toxicity,
)
from wavepanel.llm.registry import QUERIES, query

TOKENIZER, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_exact_dedup", r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir).select("doc_id", "text"))


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER,
                          outputs=("n_tokens", "ids_sha256", "decoded_sha256"), keep=("doc_id",))


@query("op3_packing")
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER)


@query("op5_line_dedup", r"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                      generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
         k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
         s AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
         j AS (SELECT k.*, coalesce(k.doc_id < s.keeper, false) AS gone FROM k LEFT JOIN s USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM j GROUP BY doc_id""")
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_html_text")
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return html_text.extract(pages).withColumn("n_chars", F.length("text").cast("bigint"))


@query("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = language.fit(docs, ~language.held_out())
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op7_top_k", r"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
               WHERE embedding IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
               FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


@query("op8_jaccard_join", r"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
         n AS (SELECT doc_id, CASE WHEN len(words) >= 5 THEN list_distinct(list_transform(range(1, len(words) - 3),
                      lambda i: array_to_string(words[i:i + 4], ' '))) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS g FROM w),
         e AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM n),
         o AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
               FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
         l AS (SELECT a, b FROM o WHERE 100 * shared >= 75 * (na + nb - shared)),
         r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
    SELECT n.doc_id, len(g) AS n_shingles, c.component_id
    FROM n JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = n.doc_id""")
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_components(documents(spark, sf_dir).select("doc_id", "text"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~language.held_out())
    return toxicity.score(docs, model).select("doc_id", language.held_out().alias("held_out"), "score",
                                              (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op10_substring_dedup", r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
         s AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
         h AS (SELECT doc_id, i, md5(array_to_string(words[i:i + 34], ' ')) AS m FROM s),
         d AS (SELECT doc_id, i FROM h WHERE m IN (SELECT m FROM h GROUP BY m HAVING count(*) > 1)),
         p AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
         c AS (SELECT DISTINCT doc_id, i + k AS i FROM d, range(0, 35) r(k)),
         k AS (SELECT p.doc_id, p.i, p.word, c.i IS NOT NULL AS gone FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i)
    SELECT w.doc_id, len(w.words) AS n_words, coalesce(any_value(g.gone), 0)::BIGINT AS n_removed, sha256(coalesce(any_value(g.kept), '')) AS kept_sha256
    FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gone) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
                      FROM k GROUP BY doc_id) g USING (doc_id) GROUP BY w.doc_id, w.words""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return substrings.drop_repeated_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_alignment")
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(documents(spark, sf_dir).select("doc_id", "text"), TOKENIZER, PIECES, columns=("doc_id",))


@query("op12_personal_data")
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(documents(spark, sf_dir).select("doc_id", "text"), columns=("doc_id",))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_added")


@query("op13_phrases", r"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
         w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
         g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
               FROM w, range(1, 6) r(k) WHERE len(w) >= k),
         f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
         n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
         c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 100),
         u AS (SELECT c.lang, c.k, c.phrase, a, j, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
               FROM c JOIN n USING (lang), range(1, 5) s(j), f x, f y
               WHERE j < c.k AND x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
                 AND y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')),
         b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
         s AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c q WHERE q.lang = b.lang AND q.k > b.k AND 100 * q.a >= 100 * b.a
                                                   AND contains(' ' || q.phrase || ' ', ' ' || b.phrase || ' '))),
         o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s)
    SELECT lang, rank, phrase, a, l, r, n, score FROM o WHERE rank <= 2000""")
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir).select("text", "lang"))


__all__ = ["QUERIES"]
