"""A corpus from raw documents to packed sequences: each stage works on all that the one before it kept.

Rows are decided one by one, so null ids and ids that repeat with different texts lose no document; null texts count as
empty; whole texts are read, however long; ties are decided as the operators say; equal rows share one decision. All stages
but the last keep every column of their input, whatever its name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from driftgate.llm import exact, packing, simhash, toxicity
from driftgate.llm.common import prepare, remove, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leave out documents predicted toxic."""
    prepare(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    prepare(spark)
    return exact.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    prepare(spark)
    return simhash.deduplicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the remaining documents in sequences."""
    prepare(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: No SQL states the stages that learn, hash by XXH64 or tokenize.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to `documents`; each result is written and reread as the next stage's input.

    A copy is deleted when the stage after it is written. The last stage checkpoints what it reads of its input before it
    returns, so its input's copy goes too.
    """
    docs, copy = table(spark, sf_dir, "documents"), None
    for number, (_, stage) in enumerate(STAGES, 1):
        docs, used = stage(spark, docs, sf_dir), copy
        if number < len(STAGES):
            docs, copy = written(docs)
        if used:
            remove(spark, used)
    return docs
