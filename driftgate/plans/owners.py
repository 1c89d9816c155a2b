"""The gate that references name the owner they must."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.model import OWNER_ROLE, TOOLING_ROLE
from driftgate.operators.refs import (
    GOVERNED_FILES,
    governed_files,
    is_governed,
    one_setting,
    plan_moves,
    read_org_config,
    reference_audit,
    reference_extract,
    reference_rewrite,
)

SETTINGS = ("owner_org", "tooling_org", "tooling_repo")


def owner_gate(config: DataFrame, refs: DataFrame, default_tooling_repo: str) -> DataFrame:
    """For every configured repository, its governed references by role and how many drift.

    A repository that declares no owner fails, because nothing can be checked. References are counted
    before the join, so a repository with very many of them is a few rows by then.
    """
    tally = refs.groupBy("repo", "role", "org", "target_repo").agg(F.count(F.lit(1)).alias("n"))

    def total(condition, name):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    counts = (
        reference_audit(tally, config, default_tooling_repo)
        .groupBy("repo")
        .agg(
            total(F.col("role") == OWNER_ROLE, "n_owner"),
            total(F.col("role") == TOOLING_ROLE, "n_tooling"),
            total(F.col("drifts"), "n_drifting"),
        )
    )
    names = ("n_owner", "n_tooling", "n_drifting")
    status = (
        F.when(F.col("owner_org").isNull(), "undeclared")
        .when(F.col("n_drifting") > 0, "drift")
        .otherwise("ok")
    )
    return (
        config.select("repo", "owner_org").join(counts, "repo", "left")
        .select("repo", "owner_org", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
        .select("repo", *names, status.alias("status"))
        .withColumn("exit_code", F.when(F.col("status") == "ok", 0).otherwise(1).cast("bigint"))
    )


def move_status(config: DataFrame, source: str | None = None) -> DataFrame:
    """Whether each repository has an owner to move from; `error` needs a source to be named."""
    start = F.coalesce(F.lit(source), F.col("owner_org"))
    return config.select("repo", F.when(start.isNull(), "error").otherwise("ok").alias("status"))


def declared_config(texts: DataFrame, settings_path: str = GOVERNED_FILES[0]) -> DataFrame:
    """(repo, owner_org, tooling_org, tooling_repo) of every repository that has a text, from its settings file alone.

    What other files say about owners is a reference, not a declaration. A repository without a settings file declares
    nothing; one with two that differ is an error.
    """
    settings = read_org_config(texts.filter(F.col("path") == settings_path))
    return texts.select("repo").distinct().join(one_setting(settings, *SETTINGS), "repo", "left")


def owner_plan(texts: DataFrame, default_tooling_repo: str, settings_path: str = GOVERNED_FILES[0]) -> DataFrame:
    """The verdict of every repository from nothing but its files: settings, governed references, and what they must name.

    Ungoverned files drop out before anything is searched.
    """
    governed = governed_files(texts)
    config = declared_config(texts.select("repo", "path", "text"), settings_path)
    return owner_gate(config, reference_extract(governed), default_tooling_repo)


def owner_move(
    texts: DataFrame,
    default_tooling_repo: str,
    owner: str | None = None,
    tooling: str | None = None,
    source: str | None = None,
    settings_path: str = GOVERNED_FILES[0],
) -> DataFrame:
    """All files after a move, and whether each changed: governed ones rewritten, all others as they are."""
    config = declared_config(texts.select("repo", "path", "text"), settings_path)
    governed = governed_files(texts)
    moves = plan_moves(config, owner, tooling, source)
    path = F.coalesce(F.col("path"), F.lit(""))
    others = texts.filter(~is_governed(path)).withColumn("moved", F.lit(False))
    return reference_rewrite(governed, moves, config, default_tooling_repo).unionByName(others)
