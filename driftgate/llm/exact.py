"""Exact deduplication of texts that is safe under skew.

Texts are combined in three steps that all compare full contents, because the text itself is a grouping key next to its
digest: inside each map task (Spark's partial aggregate), then for each salt of a digest, then over the salts of a
digest. A group of any number of copies is therefore at most one row per map task and salt in the first shuffle and one
row per salt in the second. The winner then goes back to the documents by digest and salt, so that a hot group is spread
there too. Should different contents ever share a SHA-256 digest, their MD5 tells them apart in that last step.

Null texts count as empty. Copies without an id never stay where a copy has one; where no copy has one, all of them
stay. Rows that repeat both id and text are one document and share one decision; rows that only share an id are decided
each by its own text. Texts of any length are compared whole. Extra columns pass through `deduplicate`, whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import text_or_empty

SALTS = 16


def digested(docs: DataFrame, salts: int, *others: Column) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        "doc_id",
        text.alias("_text"),
        # None of these is ever null; saying so spares a filter that would compute them twice.
        F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("")).alias("text_sha256"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("_md5"),
        F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(salts)), F.lit(0)).alias("_salt"),
        *others,
    )


def winners(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct content: text_sha256, _md5, keep_id, group_size, and the salts its copies have."""
    salted = digested(docs, salts).groupBy("text_sha256", "_md5", "_text", "_salt").agg(
        F.max("doc_id").alias("_best"), F.count(F.lit(1)).alias("_rows")
    )
    return (
        salted.groupBy("text_sha256", "_md5", "_text")
        .agg(
            F.max("_best").alias("keep_id"),
            F.sum("_rows").alias("group_size"),
            F.sum(F.expr("shiftleft(1, int(_salt))")).alias("_salts"),
        )
        .drop("_text")
    )


def spread_winners(docs: DataFrame, salts: int) -> DataFrame:
    """The winners, a row for each salt that copies have: text_sha256, _md5, _salt, keep_id, group_size."""
    return (
        winners(docs, salts)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .filter("shiftright(_salts, _salt) & 1 = 1")
        .select("text_sha256", "_md5", F.col("_salt").cast("bigint").alias("_salt"), "keep_id", "group_size")
    )


def exact_groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    return (
        digested(docs, salts)
        .drop("_text")
        .join(spread_winners(docs, salts), ["text_sha256", "_md5", "_salt"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            "text_sha256",
        )
    )


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The documents that stay, with all their columns, whatever their names.

    A row is decided by its own text and id, so rows that share an id, or have none, don't share their fate. The row itself
    travels as one value, so that no column of it can clash with those used here.
    """
    return (
        digested(docs, salts, F.struct("*").alias("_row"))
        .drop("_text")
        .join(spread_winners(docs, salts), ["text_sha256", "_md5", "_salt"])
        .filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select("_row.*")
    )
