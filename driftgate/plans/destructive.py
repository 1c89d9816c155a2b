"""The gate for changes that destroy data or leave tables behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.model import (
    BASE,
    DESTROY_LABEL,
    DESTRUCTIVE,
    FINDING_COLUMNS,
    HEAD,
    INACTIVE_LABEL,
    NOTICE,
    PIPELINES,
)
from driftgate.operators.diff import (
    definitions,
    field_changes,
    removal_severity,
    removed_classified,
    removed_tables,
    revision_guard,
)
from driftgate.operators.gate import gate_decision
from driftgate.operators.revisions import PAIR, between, pair_guard, pair_table_findings

RENAME_REMEDY = "A pipeline that only gets a new key keeps its data if the new key is tied to the old pipeline."
MOVE_REMEDY = "Hand the tables over to another pipeline before this setting changes."
DROP_REMEDY = "Grant the label for destruction, or take the retirement back."
KEEP_REMEDY = "Grant the label for inactive tables to leave the data in place; only a drop deletes it."
LOCK_REMEDY = "Generate the inventory, so that removed tables can be seen."


def resource_findings(
    resources: DataFrame, base: str = BASE, head: str = HEAD, by: tuple[str, ...] = ("repo",), typed: bool = False
) -> DataFrame:
    """Removed resources and recreated pipelines, from a single aggregate over the definitions.

    `by` is what is compared with itself: a repository, or a pair of its revisions. `typed`: settings are JSON texts.
    """
    kind, key = F.col("kind"), F.col("key").cast("string")

    def finding(severity, title, item, detail, remedy):
        values = (severity, title, item, detail, remedy)
        return F.struct(*[v.alias(n) for v, n in zip(values, FINDING_COLUMNS[1:])])

    none = F.lit(None).cast("string")
    removed = finding(
        removal_severity(kind),
        F.lit("resource removed"),
        key,
        F.when(kind == PIPELINES, "its tables are deleted with it").otherwise("it stops running"),
        F.when(kind == PIPELINES, RENAME_REMEDY),
    )
    text = lambda v: F.coalesce(v, F.lit("None"))
    changed = F.transform(
        field_changes(typed=typed),
        lambda c: finding(
            F.lit(DESTRUCTIVE),
            F.lit("resource recreated"),
            F.concat(key, F.lit("."), c["field"]),
            F.concat(text(c["old_value"]), F.lit(" -> "), text(c["new_value"])),
            F.lit(MOVE_REMEDY),
        ),
    )
    found = F.when(F.col("new").isNull(), F.array(removed)).when(kind == PIPELINES, changed)
    return (
        definitions(resources, (*by, "kind", "key"), base=base, head=head)
        .filter(F.col("old").isNotNull())
        .select(*by, F.inline(found))
        .select(*by, "severity", F.col("kind"), "item", "detail", F.coalesce("remedy", none).alias("remedy"))
    )


def table_findings(
    repos: DataFrame,
    named: DataFrame,
    inventories: DataFrame,
    retired: DataFrame,
    base: str = BASE,
    head: str = HEAD,
) -> DataFrame:
    """Removed tables, and a notice for each repository that has no inventory at head.

    `inventories` says which (repo, rev) have one, because an empty inventory and a missing one differ: a
    missing one at head leaves nothing to compare, a missing one at base counts as empty.
    """
    with_head = inventories.filter(F.col("rev") == head).select("repo").distinct()
    removed = removed_tables(named, base, head).join(with_head, "repo", "left_semi")
    is_destructive = F.col("severity") == DESTRUCTIVE
    tables = removed_classified(removed, retired).select(
        "repo",
        "severity",
        F.when(is_destructive, "table retired").otherwise("table removed").alias("kind"),
        F.col("name").alias("item"),
        F.when(is_destructive, F.col("reason")).otherwise("becomes inactive").alias("detail"),
        F.when(is_destructive, DROP_REMEDY).otherwise(KEEP_REMEDY).alias("remedy"),
    )
    notices = repos.select("repo").join(with_head, "repo", "left_anti").select(
        "repo",
        F.lit(NOTICE).alias("severity"),
        F.lit("inventory missing").alias("kind"),
        F.lit("no inventory at head").alias("item"),
        F.lit("removed tables cannot be detected").alias("detail"),
        F.lit(LOCK_REMEDY).alias("remedy"),
    )
    return tables.unionByName(notices)


def destructive_gate(
    repos: DataFrame,
    revisions: DataFrame,
    findings: DataFrame,
    labels: DataFrame,
    mode: str = "pr",
    destroy_label: str = DESTROY_LABEL,
    inactive_label: str = INACTIVE_LABEL,
) -> DataFrame:
    """The verdict of every known repository.

    Status is `error` if the base cannot be read, `clean` without findings, else `accepted` or `blocked`.
    Without a base the flags are null: what was not seen is neither true nor false.
    """
    guard = revision_guard(repos, revisions).select("repo", F.col("has_base"))
    decided = gate_decision(findings, labels, mode, destroy_label, inactive_label)
    status = (
        F.when(~F.col("has_base"), "error")
        .when(F.col("passes").isNull(), "clean")
        .when(F.col("passes"), "accepted")
        .otherwise("blocked")
    )
    codes = F.when(F.col("status") == "error", 2).when(F.col("status") == "blocked", 1).otherwise(0)
    flag = lambda c: F.when(F.col("has_base"), F.coalesce(c, F.lit(False))).alias(c)
    return (
        guard.join(decided, "repo", "left")
        .select("repo", status.alias("status"), *[
            flag(c) for c in ("destructive", "orphaned", "needs_destroy", "needs_inactive")
        ])
        .withColumn("exit_code", codes.cast("bigint"))
    )


def pair_gate(
    pairs: DataFrame,
    revisions: DataFrame,
    inventories: DataFrame,
    named: DataFrame,
    retired: DataFrame,
    resources: DataFrame,
    labels: DataFrame,
    mode: str = "pr",
    destroy_label: str = DESTROY_LABEL,
    inactive_label: str = INACTIVE_LABEL,
) -> DataFrame:
    """The verdict of every pair of revisions: what was seen, what was found, and whether the labels cover it.

    Status is `error` if the base can't be read; then the flags are null, because nothing was compared. A base that can be
    read but has no inventory is compared as an empty one, and `base_listed` tells the two apart.
    """
    guard = pair_guard(pairs, revisions, inventories)
    readable = guard.filter("has_base").select(*PAIR)
    found = resource_findings(between(resources, readable), by=PAIR).drop("remedy").unionByName(
        pair_table_findings(named, retired, guard)
    )
    decided = gate_decision(found, labels, mode, destroy_label, inactive_label, by=PAIR)
    counts = found.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n_findings"))
    status = (
        F.when(~F.col("has_base"), "error")
        .when(F.col("passes").isNull(), "clean")
        .when(F.col("passes"), "accepted")
        .otherwise("blocked")
    )
    codes = F.when(F.col("status") == "error", 2).when(F.col("status") == "blocked", 1).otherwise(0)
    flag = lambda c: F.when(F.col("has_base"), F.coalesce(c, F.lit(False))).alias(c)
    return (
        guard.drop("status")
        .join(decided, list(PAIR), "left")
        .join(counts, list(PAIR), "left")
        .select(
            *PAIR,
            "base_listed",
            "head_listed",
            F.when(F.col("has_base"), F.coalesce("n_findings", F.lit(0))).alias("n_findings"),
            *[flag(c) for c in ("destructive", "orphaned", "needs_destroy", "needs_inactive")],
            status.alias("status"),
        )
        .withColumn("exit_code", codes.cast("bigint"))
    )
