"""One query per operator over its whole table, and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftgate.llm import (
    counts,
    exact,
    languages,
    licenses,
    packing,
    sentencepieces,
    sharding,
    simhash,
    sketch,
    toxicity,
    tries,
    variants,
    wrappers,
)
from driftgate.llm.common import prepare, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "documents")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_report(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprint_report(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return wrappers.extract(table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op9_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.reshard(documents(spark, sf_dir), sharding.by_source()).selectExpr(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "cast(null as int) as grown_shard", "old_shard"
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.identify(documents(spark, sf_dir))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variant_groups(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return tries.prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_exact_dedup, op3_fingerprints, op4_simhash, op5_token_counts,
        op6_html_extraction, op7_packing, op8_toxicity, op9_resharding, op10_licenses, op11_language,
        op12_variants, op13_prefix_trie,
    )
}

#: The table of CRC-32 by its rule, and the checksum of an expression by that table.
CRC_TABLE = """
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)
                ORDER BY i) AS steps FROM range(256) t(i)"""


def crc32(text: str) -> str:
    """SQL for the CRC-32 of the UTF-8 bytes of an expression over letters up to U+00FF, beside the table `crc`."""
    octets = (
        f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] "
        "ELSE [192 | (unicode(c) >> 6), 128 | (unicode(c) & 63)] END))"
    )
    return (
        f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295)"
    )


ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER copies AS keep_id, count(*) OVER copies AS group_size,
               doc_id = max(doc_id) OVER copies AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW copies AS (PARTITION BY coalesce(text, ''))
    """,
    "op12_variants": rf"""
        WITH RECURSIVE crc AS ({CRC_TABLE}),
        run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')),
                       'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
        hashed AS (SELECT w, {crc32("doc_id::VARCHAR || ':' || w")} AS h FROM run, crc WHERE length(w) >= 5),
        vocabulary AS (
          SELECT word, count(*) AS n
          FROM (SELECT CASE WHEN h % 97 = 0 THEN w[1 : h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word FROM hashed)
          WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
        cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM vocabulary),
        hole AS (SELECT word, n, place, word[1 : place - 1] || word[place + 1 :] AS left_over FROM cut),
        pair AS (
          SELECT a.word, b.word AS near, b.n AS near_n FROM hole a JOIN hole b
            ON a.left_over = b.left_over AND a.place = b.place AND a.word <> b.word
          UNION SELECT h.word, v.word, v.n FROM hole h JOIN vocabulary v ON h.left_over = v.word
          UNION SELECT v.word, h.word, h.n FROM hole h JOIN vocabulary v ON h.left_over = v.word),
        best AS (
          SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n
          FROM pair GROUP BY word),
        formed AS (
          SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
                 CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
          FROM vocabulary v LEFT JOIN best USING (word)),
        walk AS (
          SELECT word, word AS place FROM formed
          UNION ALL SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.place WHERE f.form IS NOT NULL),
        ended AS (SELECT walk.word, place FROM walk JOIN formed f ON f.word = walk.place WHERE f.form IS NULL)
        SELECT word, n, n_near, form, form_n, place AS root FROM formed JOIN ended USING (word)
    """,
    "op13_prefix_trie": rf"""
        WITH crc AS ({CRC_TABLE}),
        turn AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER
                   (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p
                 FROM conversations WHERE conv_id IS NOT NULL),
        conv AS (SELECT conv_id, conv_id - conv_id % 5 AS start, {crc32("conv_id::VARCHAR")} % 9 AS h
                 FROM (SELECT DISTINCT conv_id FROM turn), crc),
        rebuilt AS (SELECT c.conv_id, 0 AS own, t.p, {{'role': role, 'text': text}} AS said
                    FROM conv c JOIN turn t ON t.conv_id = c.start AND t.p <= c.h
                    UNION ALL SELECT c.conv_id, 1, t.p, {{'role': role, 'text': text}}
                    FROM conv c JOIN turn t ON t.conv_id = c.conv_id AND t.p > c.h),
        sequence AS (SELECT c.conv_id, coalesce(list(said ORDER BY own, p) FILTER (p IS NOT NULL), []) AS s
                     FROM conv c LEFT JOIN rebuilt USING (conv_id) GROUP BY c.conv_id),
        prefix AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS depth, s FROM sequence),
        node AS (SELECT s[1 : depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
                        CASE WHEN depth = 0 THEN 0 ELSE strlen(any_value(s[depth].text)) END AS size,
                        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = depth), '')) AS ends_sha256
                 FROM prefix GROUP BY s[1 : depth], depth),
        child AS (SELECT k[1 : depth - 1] AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY k[1 : depth - 1]),
        known AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN child USING (k)),
        above AS (SELECT k, unnest(range(0, depth + 1)) AS d, n_children, (n_convs - 1) * size AS saved FROM known),
        below AS (SELECT k[1 : d] AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
                  FROM above GROUP BY k[1 : d])
        SELECT a.conv_id, a.depth, up.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves, saved_tokens, a.ends_sha256
        FROM known a JOIN below USING (k) LEFT JOIN node up ON a.depth > 0 AND up.k = a.k[1 : a.depth - 1]
    """,
}
