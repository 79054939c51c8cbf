"""The training-data operators as named queries over the test tables, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidewrack.llm import (
    ann, classifier, forest, lexical, lines, masked, mixing, packing, passages, simhash, topk, warc, whitening,
)
from tidewrack.session import new_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_warc_chunks(spark: SparkSession, folder: str) -> DataFrame:
    archives = warc.write_archives(table(spark, folder, "pages"), new_folder(spark, "warc"))
    return (
        warc.read_chunks(archives)
        .where("is_last")
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    )


def op3_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents")).drop("text_hash")


def op4_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(table(spark, folder, "embeddings"))


def op5_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_products(table(spark, folder, "embeddings"))


def op6_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return passages.without_repeats(table(spark, folder, "documents"))


def op7_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed(table(spark, folder, "documents"), keep=mixing.KEEP).drop("text_hash")


def op8_packed_sequences(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.packed(table(spark, folder, "documents"), str(path))


def op9_quality_scores(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_masked_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    return masked.pseudo_likelihood(table(spark, folder, "documents"))


def op11_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_vectors(table(spark, folder, "embeddings"))


def op12_whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


def op13_ranked_documents(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {q.__name__: q for q in (op1_line_dedup, op2_warc_chunks, op3_simhash_groups, op4_nearest_neighbours, op5_exact_topk, op6_repeated_passages,
                                op7_mixed_sources, op8_packed_sequences, op9_quality_scores, op10_masked_likelihood,
                                op11_near_vectors, op12_whitened_vectors, op13_ranked_documents)}

SQL = {
    "op1_line_dedup": r"""
        WITH line AS (
            SELECT doc_id, i AS line, split[i] AS content,
                   list_sort(list_distinct(list_filter(string_split_regex(split[i], '[ \t-\r]+'),
                                                       lambda w: w <> ''))) AS words
            FROM (SELECT doc_id, string_split(text, chr(10)) AS split FROM documents WHERE text IS NOT NULL) d,
                 LATERAL (SELECT unnest(generate_series(1, len(split))) AS i)
        ), sets AS (
            SELECT words, len(words) AS n, min((doc_id, line)) AS first, row_number() OVER () AS s
            FROM line WHERE len(words) > 0 GROUP BY words
        ), word AS (
            SELECT s, n, first, unnest(words) AS w FROM sets
        ), alike AS (
            SELECT DISTINCT s FROM (
                SELECT a.s AS s, b.s AS t, a.n AS n, b.n AS m, count(*) AS shared
                FROM word a JOIN word b ON a.w = b.w AND b.first < a.first AND b.n >= 0.8 * a.n AND a.n >= 0.8 * b.n
                GROUP BY ALL
            ) WHERE shared::DOUBLE / (n + m - shared) >= 0.8::DOUBLE
        ), judged AS (
            SELECT l.doc_id, l.line, l.content,
                   sets.s IS NOT NULL AND ((l.doc_id, l.line) > sets.first OR alike.s IS NOT NULL) AS gone
            FROM line l LEFT JOIN sets ON l.words = sets.words LEFT JOIN alike ON alike.s = sets.s
        ), rebuilt AS (
            SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines,
                   CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed,
                   coalesce(string_agg(content, chr(10) ORDER BY line) FILTER (WHERE NOT gone), '') AS text
            FROM judged GROUP BY doc_id
        )
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
               CASE WHEN d.text IS NOT NULL THEN r.text END AS text
        FROM documents d LEFT JOIN rebuilt r USING (doc_id)
    """,
    "op2_warc_chunks": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload,
                   max(page_id) OVER (PARTITION BY coalesce(html, '')) AS kept
            FROM pages
        ), digits AS (
            SELECT page_id, kept, octet_length(payload) AS n, sha1(payload) AS hex FROM p
        ), bits AS (
            SELECT page_id, kept, n,
                   list_transform(generate_series(0, 31), lambda i:
                       CAST(('0x' || hex[((i * 5) // 20) * 5 + 1 : ((i * 5) // 20) * 5 + 5]) AS BIGINT)
                           >> (15 - (i * 5) % 20) & 31) AS fives
            FROM digits
        )
        SELECT page_id, n AS payload_bytes,
               list_aggregate(list_transform(fives, lambda f: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', f + 1, 1)),
                              'string_agg', '') AS payload_digest,
               CASE WHEN kept > page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN kept > page_id THEN kept END AS refers_to
        FROM bits
    """,
    "op5_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        )
        SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id AS vec_id,
               CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        WINDOW w AS (PARTITION BY q.vec_id
                     ORDER BY list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) DESC, c.vec_id)
        QUALIFY row_number() OVER w <= 5
    """,
    "op13_ranked_documents": r"""
        WITH doc AS (
            SELECT doc_id, r, t, len(t) AS n FROM (
                SELECT doc_id, row_number() OVER () AS r,
                       regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
                FROM documents WHERE text IS NOT NULL)
            WHERE len(t) > 0
        ), total AS (
            SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM doc
        ), item AS (
            SELECT DISTINCT item_id, i, unnest(
                regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT item_id, text, row_number() OVER () AS i FROM (SELECT DISTINCT item_id, text FROM benchmark))
        ), held AS (
            SELECT doc_id, r, n, term, count(*) AS tf
            FROM (SELECT doc_id, r, n, unnest(t) AS term FROM doc)
            WHERE term IN (SELECT term FROM item)
            GROUP BY ALL
        ), weight AS (
            SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY term), total
        ), impact AS (
            SELECT doc_id, r, term,
                   w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS part
            FROM held JOIN weight USING (term), total
        ), scored AS (
            SELECT item_id, i, doc_id, r, CAST(sum(part) AS BIGINT) AS score
            FROM item JOIN impact USING (term) WHERE doc_id IS NOT NULL
            GROUP BY item_id, i, doc_id, r HAVING sum(part) > 0
        )
        SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
        FROM scored
        WINDOW best AS (PARTITION BY item_id, i ORDER BY score DESC, doc_id)
        QUALIFY row_number() OVER best <= 50
    """,
}
