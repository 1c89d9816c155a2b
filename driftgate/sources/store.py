"""Stored inventories: a table of names whose parts are replaced as a whole, and a manifest of what was stored.

A publication writes the names of some (repo, rev) into a folder of its own and then one manifest row for each of them, also
for those without names, so that an empty inventory and a missing one stay apart. Readers take, for each (repo, rev), the
publication that the manifest names last. A publication that dies before its manifest is written has no effect, and one
repository can be replaced without touching the files of the others.

The manifest has a digest of each inventory. Digests of equal inventories are equal however their rows lie, so two
inventories are compared by one value a repository, and names are read only where the values differ.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.model import NAMED_SCHEMA, require

MANIFEST_SCHEMA = "repo BIGINT, rev STRING, n_names BIGINT, digest STRING, version STRING, published BIGINT"
SEEDS = (0, 1)


def name_digest(name: Column) -> Column:
    """Aggregate: a digest of a set of distinct names. Two sums of hashes, so that partial results add up in any order."""
    sums = [F.sum(F.xxhash64(F.lit(seed), name).cast("decimal(20,0)")) for seed in SEEDS]
    return F.concat_ws(".", *[F.coalesce(s, F.lit(0)).cast("string") for s in sums])


def digests(named: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """(repo, rev, n_names, digest) of each inventory; with `scope`, also of the (repo, rev) in it that have no names.

    Repeated names count once.
    """
    distinct = require(named, "repo", "rev", "name").select("repo", "rev", "name").distinct()
    found = distinct.groupBy("repo", "rev").agg(
        F.count(F.lit(1)).alias("n_names"), name_digest(F.col("name")).alias("digest")
    )
    if scope is None:
        return found
    empty = ".".join("0" for _ in SEEDS)
    return (
        require(scope, "repo", "rev").select("repo", "rev").distinct().join(found, ["repo", "rev"], "left")
        .select("repo", "rev", F.coalesce("n_names", F.lit(0)).alias("n_names"), F.coalesce("digest", F.lit(empty)).alias("digest"))
    )


def publish(named: DataFrame, scope: DataFrame, path: str) -> str:
    """Store the inventories of the (repo, rev) in `scope`, replacing what was stored of them. Returns the publication's name.

    Names of anything outside `scope` are not stored.
    """
    version = uuid.uuid4().hex
    wanted = require(scope, "repo", "rev").select("repo", "rev").distinct()
    (
        require(named, "repo", "rev", "name").select("repo", "rev", "name").distinct()
        .join(wanted, ["repo", "rev"], "left_semi")
        .hint("rebalance", "rev")
        .sortWithinPartitions("rev", "repo", "name")
        .write.parquet(f"{path}/names/version={version}")
    )
    stored = named.sparkSession.read.schema(NAMED_SCHEMA).parquet(f"{path}/names/version={version}")
    (
        digests(stored, wanted)
        .select(
            F.col("repo").cast("bigint").alias("repo"), "rev", "n_names", "digest",
            F.lit(version).alias("version"), F.lit(time.time_ns()).alias("published"),
        )
        .write.mode("append").parquet(f"{path}/manifest")
    )
    return version


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The inventories that count: (repo, rev, n_names, digest, version), the last publication of each."""
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(f"{path}/manifest")
    last = F.max(F.struct("published", "version", "n_names", "digest")).alias("last")
    return rows.groupBy("repo", "rev").agg(last).select("repo", "rev", "last.n_names", "last.digest", "last.version")


def stored_names(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """(repo, rev, name) of the inventories that count; with `wanted`, only of its repositories."""
    counts = manifest(spark, path).select("repo", "rev", "version")
    if wanted is not None:
        counts = counts.join(require(wanted, "repo").select("repo").distinct(), "repo", "left_semi")
    names = spark.read.schema(f"{NAMED_SCHEMA}, version STRING").parquet(f"{path}/names")
    return names.join(counts, ["repo", "rev", "version"], "left_semi").select("repo", "rev", "name")
