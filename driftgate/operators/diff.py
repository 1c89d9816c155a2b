"""What differs between two revisions.

Every diff is one aggregate that notes in which revisions a key was seen. It needs one shuffle, it combines
repeats before that shuffle, and null keys compare equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.functions.values import canonical_value
from driftgate.model import BASE, DESTRUCTIVE, HEAD, NOTICE, ORPHAN, PIPELINES, RECREATE_FIELDS, require


def presence(df: DataFrame, keys: tuple[str, ...], base: str = BASE, head: str = HEAD) -> DataFrame:
    """For each key, whether the base and the head revision have it."""
    require(df, "rev", *keys)
    return (
        df.filter(F.col("rev").isin(base, head))
        .groupBy(*keys)
        .agg(
            F.bool_or(F.col("rev") == base).alias("in_base"),
            F.bool_or(F.col("rev") == head).alias("in_head"),
        )
    )


def removed_tables(named: DataFrame, base: str = BASE, head: str = HEAD) -> DataFrame:
    """(repo, name) that the base revision has and the head has not."""
    seen = presence(named, ("repo", "name"), base, head)
    return seen.filter(F.col("in_base") & ~F.col("in_head")).select("repo", "name")


def inventory_drift(named: DataFrame, stored: str = BASE, expected: str = HEAD) -> DataFrame:
    """Names that only one side has: `missing` from the stored inventory, or `extra` in it."""
    seen = presence(named, ("repo", "name"), stored, expected)
    return seen.filter(F.col("in_base") != F.col("in_head")).select(
        "repo", "name", F.when(F.col("in_base"), "extra").otherwise("missing").alias("drift")
    )


def resource_removed(
    resources: DataFrame,
    keys: tuple[str, ...] = ("repo", "kind", "key"),
    base: str = BASE,
    head: str = HEAD,
) -> DataFrame:
    """Keys that are gone at head. Where `kind` is a key, its severity is added."""
    seen = presence(resources, keys, base, head)
    gone = seen.filter(F.col("in_base") & ~F.col("in_head")).select(*keys)
    return gone.withColumn("severity", removal_severity(F.col("kind"))) if "kind" in keys else gone


def removal_severity(kind: Column) -> Column:
    """Losing a pipeline destroys its tables; losing any other resource does not."""
    return F.when(kind == PIPELINES, DESTRUCTIVE).otherwise(NOTICE)


def definitions(
    resources: DataFrame,
    keys: tuple[str, ...],
    fields: tuple[str, ...] = RECREATE_FIELDS,
    base: str = BASE,
    head: str = HEAD,
) -> DataFrame:
    """The last definition of each key at base (`old`) and at head (`new`); null where it has none."""
    require(resources, "rev", "file_order", *keys, *fields)
    definition = F.struct("file_order", *fields)
    return (
        resources.filter(F.col("rev").isin(base, head))
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("rev") == base, definition)).alias("old"),
            F.max(F.when(F.col("rev") == head, definition)).alias("new"),
        )
    )


def field_changes(fields: tuple[str, ...] = RECREATE_FIELDS, typed: bool = False) -> Column:
    """Array of (field, old_value, new_value) that differ. Null and absent are the same.

    `typed`: values are JSON texts and are compared by type and value, not by spelling.
    """
    value = canonical_value if typed else lambda v: v
    values = [
        F.struct(
            F.lit(f).alias("field"),
            value(F.col("old")[f]).alias("old_value"),
            value(F.col("new")[f]).alias("new_value"),
        )
        for f in fields
    ]
    return F.filter(F.array(*values), lambda v: ~v["old_value"].eqNullSafe(v["new_value"]))


def recreate_fields(
    resources: DataFrame,
    keys: tuple[str, ...] = ("repo", "kind", "key"),
    fields: tuple[str, ...] = RECREATE_FIELDS,
    base: str = BASE,
    head: str = HEAD,
    typed: bool = False,
) -> DataFrame:
    """One row per changed field of each resource that both revisions have.

    Picking the last definition and comparing the revisions happen in the same aggregate. `typed`: values are JSON texts,
    see `canonical_value`; only the last definitions are parsed.
    """
    both = definitions(resources, keys, fields, base, head).filter(
        F.col("old").isNotNull() & F.col("new").isNotNull()
    )
    return both.select(*keys, F.inline(field_changes(fields, typed)))


def removed_classified(removed: DataFrame, retired: DataFrame) -> DataFrame:
    """Severity of each removed name: destructive with a reason if it was retired, else orphan.

    A retirement of a name that was not removed does nothing. The retirements can grow with the lakehouse,
    so the choice of join is left to adaptive execution.
    """
    reasons = (
        require(retired, "repo", "name", "reason")
        .groupBy("repo", "name")
        .agg(F.max("reason").alias("reason"))
        .withColumn("is_retired", F.lit(True))
    )
    return removed.join(reasons, ["repo", "name"], "left").select(
        *removed.columns,
        F.when(F.col("is_retired"), DESTRUCTIVE).otherwise(ORPHAN).alias("severity"),
        "reason",
    )


def revision_guard(repos: DataFrame, seen: DataFrame, base: str = BASE, head: str = HEAD) -> DataFrame:
    """For every known repository, whether both revisions could be seen.

    `seen` has a row (repo, rev) for what could be read. Without a base the status is `unresolved`, which
    is an error and not "nothing changed".
    """
    present = presence(seen, ("repo",), base, head)
    return (
        require(repos, "repo").select("repo").join(present, "repo", "left")
        .select(
            "repo",
            F.coalesce("in_base", F.lit(False)).alias("has_base"),
            F.coalesce("in_head", F.lit(False)).alias("has_head"),
        )
        .withColumn("status", F.when(F.col("has_base"), "ok").otherwise("unresolved"))
    )
