"""The gate that a stored inventory is up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.model import BASE, HEAD
from driftgate.operators.diff import presence
from driftgate.sources.store import digests, manifest, stored_names


def lock_gate(
    repos: DataFrame,
    inventories: DataFrame,
    named: DataFrame,
    stored: str = BASE,
    expected: str = HEAD,
    incomplete: DataFrame | None = None,
) -> DataFrame:
    """For every repository, how many names it declares and how many its stored inventory lacks or has too many.

    `inventories` says which (repo, rev) were stored at all. `incomplete`, a row (repo, path) per file with a name that is
    not a literal, adds how many files the expected names may lack some of. That is a warning: it changes no verdict.
    """
    counts = (
        presence(named, ("repo", "name"), stored, expected)
        .groupBy("repo")
        .agg(
            F.count_if("in_head").alias("n_tables"),
            F.count_if(F.col("in_head") & ~F.col("in_base")).alias("n_missing"),
            F.count_if(F.col("in_base") & ~F.col("in_head")).alias("n_extra"),
        )
    )
    exists = (
        inventories.filter(F.col("rev") == stored).select("repo").distinct()
        .withColumn("exists", F.lit(True))
    )
    result = verdicts(repos.select("repo").join(exists, "repo", "left").join(counts, "repo", "left"))
    if incomplete is None:
        return result
    files = incomplete.groupBy("repo").agg(F.count(F.lit(1)).alias("n_incomplete"))
    return result.join(files, "repo", "left").withColumn("n_incomplete", F.coalesce("n_incomplete", F.lit(0)))


def verdicts(known: DataFrame) -> DataFrame:
    """Status and exit code from `exists` and the three counts, null where nothing was counted."""
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    status = (
        F.when(F.col("exists").isNull(), "absent")
        .when(F.col("n_missing") + F.col("n_extra") > 0, "outdated")
        .otherwise("up to date")
    )
    return (
        known.select("repo", "exists", number("n_tables"), number("n_missing"), number("n_extra"))
        .select("repo", "n_tables", "n_missing", "n_extra", status.alias("status"))
        .withColumn("exit_code", F.when(F.col("status") == "up to date", 0).otherwise(1).cast("bigint"))
    )


def stored_lock_gate(repos: DataFrame, named: DataFrame, path: str, stored: str = BASE, expected: str = HEAD) -> DataFrame:
    """The same verdicts against the inventories stored at `path`.

    Both sides are compared by digest first; stored names are read for the repositories only where the digests differ.
    """
    spark = named.sparkSession
    held = manifest(spark, path).filter(F.col("rev") == stored).select("repo", F.col("digest").alias("held"), F.lit(True).alias("exists"))
    wanted = named.filter(F.col("rev") == expected)
    declared = digests(wanted).select("repo", F.col("digest").alias("declared"), F.col("n_names").alias("n_tables"))
    empty = digests(wanted.limit(0), repos.select("repo", F.lit(expected).alias("rev"))).select("repo", F.col("digest").alias("none"))
    compared = (
        repos.select("repo").join(held, "repo", "left").join(declared, "repo", "left").join(empty, "repo", "left")
        .withColumn("differs", F.coalesce("held", "none") != F.coalesce("declared", "none"))
    )
    differing = compared.filter("differs").select("repo")
    sides = (
        stored_names(spark, path, differing).filter(F.col("rev") == stored).select("repo", F.lit(BASE).alias("rev"), "name")
        .unionByName(wanted.join(differing, "repo", "left_semi").select("repo", F.lit(HEAD).alias("rev"), "name"))
    )
    counts = (
        presence(sides, ("repo", "name")).groupBy("repo")
        .agg(
            F.count_if(F.col("in_head") & ~F.col("in_base")).alias("n_missing"),
            F.count_if(F.col("in_base") & ~F.col("in_head")).alias("n_extra"),
        )
    )
    return verdicts(compared.join(counts, "repo", "left"))
