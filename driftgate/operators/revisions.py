"""Diffs between pairs of revisions, where every repository has its own base and head, or several of them.

A table of pairs (repo, base_rev, head_rev) says what is compared with what. The rows of a revision go to every pair that it
takes part in, marked `base` or `head`; from there on a diff is the one aggregate it is between two fixed revisions, with
the pair as a part of its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.model import BASE, DESTRUCTIVE, HEAD, NOTICE, require
from driftgate.operators.diff import presence, removed_classified

PAIR = ("repo", "base_rev", "head_rev")


def sides(pairs: DataFrame) -> DataFrame:
    """(repo, rev, side, base_rev, head_rev): the two revisions of each distinct pair. Both may be the same."""
    side = lambda column, name: F.struct(F.col(column).alias("rev"), F.lit(name).alias("side"))
    return (
        require(pairs, *PAIR).select(*PAIR).distinct()
        .select(*PAIR, F.inline(F.array(side("base_rev", BASE), side("head_rev", HEAD))))
    )


def between(df: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of `df` once for each pair that their revision takes part in; `rev` becomes the side, `base` or `head`."""
    others = [c for c in require(df, "repo", "rev").columns if c not in ("repo", "rev")]
    return df.join(sides(pairs), ["repo", "rev"]).select(*PAIR, F.col("side").alias("rev"), *others)


def pair_removed(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """(repo, base_rev, head_rev, name) that the base of a pair has and its head has not."""
    seen = presence(between(named, pairs), (*PAIR, "name"))
    return seen.filter(F.col("in_base") & ~F.col("in_head")).select(*PAIR, "name")


def pair_drift(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """Names that only one side of a pair has: `missing` from its base, or `extra` in it."""
    seen = presence(between(named, pairs), (*PAIR, "name"))
    return seen.filter(F.col("in_base") != F.col("in_head")).select(
        *PAIR, "name", F.when(F.col("in_base"), "extra").otherwise("missing").alias("drift")
    )


def pair_guard(pairs: DataFrame, revisions: DataFrame, inventories: DataFrame) -> DataFrame:
    """What could be seen of each pair: has_base, has_head, base_listed, head_listed, status.

    `revisions` has a row (repo, rev) for what could be read, `inventories` for what has an inventory. A base that can't be
    read is an error (`unresolved`). A base that can be read and has no inventory is not: there was nothing to remove.
    Without an inventory at head removed names can't be told, which is a notice.
    """
    flag = lambda side, kind: F.bool_or((F.col("rev") == side) & (F.col("what") == kind))
    what = lambda df, kind: require(df, "repo", "rev").select("repo", "rev", F.lit(kind).alias("what"))
    seen = (
        between(what(revisions, "read").unionByName(what(inventories, "listed")), pairs)
        .groupBy(*PAIR)
        .agg(
            flag(BASE, "read").alias("has_base"),
            flag(HEAD, "read").alias("has_head"),
            flag(BASE, "listed").alias("base_listed"),
            flag(HEAD, "listed").alias("head_listed"),
        )
    )
    flags = ("has_base", "has_head", "base_listed", "head_listed")
    status = (
        F.when(~F.col("has_base"), "unresolved")
        .when(~F.col("head_listed"), "no inventory at head")
        .when(~F.col("base_listed"), "no inventory at base")
        .otherwise("ok")
    )
    return (
        pairs.select(*PAIR).distinct().join(seen, list(PAIR), "left")
        .select(*PAIR, *[F.coalesce(f, F.lit(False)).alias(f) for f in flags])
        .withColumn("status", status)
    )


def pair_table_findings(named: DataFrame, retired: DataFrame, guard: DataFrame) -> DataFrame:
    """Removed names of each pair with their severity, and a notice where the head has no inventory.

    `guard` is the result of `pair_guard`. Pairs without a readable base or an inventory at head have no removed names.
    """
    comparable = guard.filter("has_base AND head_listed").select(*PAIR)
    classified = removed_classified(pair_removed(named, comparable), retired).select(
        *PAIR,
        "severity",
        F.when(F.col("severity") == DESTRUCTIVE, "table retired").otherwise("table removed").alias("kind"),
        F.col("name").alias("item"),
        F.col("reason").alias("detail"),
    )
    notices = guard.filter("has_base AND NOT head_listed").select(
        *PAIR,
        F.lit(NOTICE).alias("severity"),
        F.lit("inventory missing").alias("kind"),
        F.lit("no inventory at head").alias("item"),
        F.lit(None).cast("string").alias("detail"),
    )
    return classified.unionByName(notices)
