"""Findings, labels, decisions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.functions.text import strip
from driftgate.model import DESTROY_LABEL, DESTRUCTIVE, INACTIVE_LABEL, NOTICE, ORPHAN, require
from driftgate.operators.ranking import number_rows

CLEAN_SECTION = 0
SECTIONS = ((1, DESTRUCTIVE), (2, ORPHAN), (3, NOTICE))
UNLOCK_SECTION = 4
CLEAN_LINE = "Nothing that holds data is lost or left behind."


def severity_rollup(findings: DataFrame) -> DataFrame:
    """How many findings of each severity a repository has."""
    return (
        require(findings, "repo", "severity")
        .groupBy("repo", "severity")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def any_flags(findings: DataFrame, by: tuple[str, ...] = ("repo",)) -> DataFrame:
    """For each repository (or pair of its revisions), whether it has any destructive and any orphan finding."""
    return (
        require(findings, *by, "severity")
        .groupBy(*by)
        .agg(
            F.bool_or(F.col("severity") == DESTRUCTIVE).alias("destructive"),
            F.bool_or(F.col("severity") == ORPHAN).alias("orphaned"),
        )
    )


def flags(repos: DataFrame, gate: DataFrame) -> DataFrame:
    """The two outputs that later steps read, as the texts `true` and `false`, for every known repository.

    One without findings has both, as `false`: a step that reads them must not meet a gap.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("string").alias(c)
    return require(repos, "repo").select("repo").join(gate, "repo", "left").select("repo", text("destructive"), text("orphaned"))


def label_set(labels: DataFrame) -> DataFrame:
    """Distinct labels of each repository from a comma list; blanks do not count."""
    require(labels, "repo", "labels_csv")
    return (
        labels.select("repo", F.explode(F.split("labels_csv", ",")).alias("entry"))
        .select("repo", strip(F.col("entry")).alias("label"))
        .filter(F.col("label") != "")
        .distinct()
    )


def gate_decision(
    findings: DataFrame,
    labels: DataFrame,
    mode: str = "pr",
    destroy_label: str = DESTROY_LABEL,
    inactive_label: str = INACTIVE_LABEL,
    by: tuple[str, ...] = ("repo",),
) -> DataFrame:
    """Whether the granted labels cover the findings of each repository, or of each pair of its revisions (`by`).

    `labels` has one row (repo, label) per label. Each family of findings needs its own label, notices need
    none, and mode `report` never blocks.
    """
    if mode not in ("pr", "report"):
        raise ValueError(f"unknown mode {mode!r}")
    granted = (
        require(labels, "repo", "label")
        .filter(F.col("label").isin(destroy_label, inactive_label))
        .groupBy("repo")
        .agg(
            F.bool_or(F.col("label") == destroy_label).alias("may_destroy"),
            F.bool_or(F.col("label") == inactive_label).alias("may_orphan"),
        )
    )
    lacks = lambda flag, may: F.col(flag) & ~F.coalesce(may, F.lit(False))
    decided = (
        any_flags(findings, by)
        .join(granted, "repo", "left")
        .select(
            *by,
            "destructive",
            "orphaned",
            lacks("destructive", "may_destroy").alias("needs_destroy"),
            lacks("orphaned", "may_orphan").alias("needs_inactive"),
        )
    )
    passes = F.lit(True) if mode == "report" else ~(F.col("needs_destroy") | F.col("needs_inactive"))
    return decided.withColumn("passes", passes)


def section_of(severity: Column) -> Column:
    """The place of a severity in a report."""
    place = F.lit(None).cast("int")
    for number, name in SECTIONS:
        place = F.when(severity == name, number).otherwise(place)
    return place


def finding_report(findings: DataFrame, page_lines: int = 1000) -> DataFrame:
    """The findings of each repository and severity as text, in pages of at most `page_lines` lines.

    A line is the item with its detail. Lines are in order inside a page and across pages, and none is left out: a finding
    without an item is a line too, before the others. Every page tells how many findings the group has on all pages. Pages
    are what keeps a repository with very many findings from becoming one value in one task.
    """
    detail = F.col("detail") if "detail" in findings.columns else F.lit(None).cast("string")
    item = F.coalesce("item", F.lit(""))
    items = require(findings, "repo", "severity", "item").select(
        "repo", "severity", item.alias("item"), F.concat_ws(": ", item, detail).alias("line")
    )
    numbered = number_rows(items, ("repo", "severity"), ("item", "line"), "n")
    page = F.floor((F.col("n") - 1) / page_lines).cast("bigint")
    lines = F.sort_array(F.collect_list(F.struct("item", "line")))
    pages = (
        numbered.withColumn("page", page)
        .groupBy("repo", "severity", "page")
        .agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("detail"))
    )
    totals = severity_rollup(items).withColumnRenamed("n", "total")
    return pages.join(totals, ["repo", "severity"]).select(
        "repo", "severity", section_of(F.col("severity")).alias("section"), "page", "total", "detail"
    )


def report_lines(
    repos: DataFrame,
    findings: DataFrame,
    labels: DataFrame,
    mode: str = "pr",
    destroy_label: str = DESTROY_LABEL,
    inactive_label: str = INACTIVE_LABEL,
) -> DataFrame:
    """The whole report as a table of lines, to be sorted by (repo, section, item) when it is shown.

    Sections are destructive, orphan and notice, then in mode `pr` the labels that unlock the change. A
    repository without findings gets one line that says so. One row per line means that no group is ever
    gathered.
    """
    body = findings.select(
        "repo",
        section_of(F.col("severity")).alias("section"),
        F.coalesce("item", F.lit("")).alias("item"),
        F.concat_ws(": ", F.coalesce("item", F.lit("")), "detail").alias("line"),
    )
    gate = gate_decision(findings, labels, mode, destroy_label, inactive_label)

    def unlock(flag: str, lacks: str, label: str) -> Column:
        state = F.when(F.col(lacks), ": missing").otherwise(": granted")
        return F.when(F.col(flag), line(UNLOCK_SECTION, F.lit(label), F.concat(F.lit(f"label {label}"), state)))

    def line(section: int, item: Column, text: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), item.alias("item"), text.alias("line"))

    clean = line(CLEAN_SECTION, F.lit(""), F.lit(CLEAN_LINE))
    added = [F.when(F.col("passes").isNull(), clean)]
    if mode == "pr":
        added.append(unlock("destructive", "needs_destroy", destroy_label))
        added.append(unlock("orphaned", "needs_inactive", inactive_label))
    closing = repos.select("repo").join(gate, "repo", "left").select(
        "repo", F.inline(F.array_compact(F.array(*added)))
    )
    return body.unionByName(closing)
