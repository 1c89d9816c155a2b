"""Which tables a repository declares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.functions.names import normalise_ref, qualify_name
from driftgate.model import (
    DECLARING_CALLS,
    DECLARING_DECORATORS,
    DECLARING_RECEIVER,
    DEFAULT_CATALOG,
    DEFAULT_SCHEMA,
    HEAD,
    require,
)


def declaration_calls(calls: DataFrame) -> DataFrame:
    """The calls that declare a table.

    There is one row per argument that may carry the name, and `arg_source` says how it was passed
    (`keyword`, `positional`, or null for a call without arguments). Decorators take the name by keyword
    only. The same method on any other receiver reads, and is not a declaration.
    """
    require(calls, "receiver", "method", "arg_source", "name_literal", "is_dynamic")
    method, source = F.col("method"), F.col("arg_source")
    return calls.filter(
        (F.col("receiver") == DECLARING_RECEIVER)
        & (
            (method.isin(*DECLARING_DECORATORS) & (source == "keyword"))
            | (method.isin(*DECLARING_CALLS) & source.isin("positional", "keyword"))
        )
    )


def dynamic_names(calls: DataFrame, by: tuple[str, ...] = ("repo", "path")) -> DataFrame:
    """Groups that declare a name that is not a literal, so that their inventory is incomplete."""
    dynamic = F.col("is_dynamic")
    return (
        declaration_calls(calls)
        .groupBy(*by)
        .agg(F.count_if(dynamic).alias("n_dynamic"), F.count_if(~dynamic).alias("n_literal"))
        .filter(F.col("n_dynamic") > 0)
    )


def incomplete_files(
    files: DataFrame,
    calls: DataFrame,
    providers: DataFrame | None = None,
    rev: str = HEAD,
    on: tuple[str, ...] = ("repo", "rev", "path"),
) -> DataFrame:
    """(repo, path) of the files that some pipeline loads in revision `rev` and that declare a name that is not a literal.

    The inventory of their repositories may lack names. A repository that has a provider takes its names from there, so it
    lacks none. Declarations are reduced to distinct files before the join, and files to those of the revision.
    """
    dynamic = declaration_calls(calls).filter("is_dynamic").select(*on).distinct()
    loaded = require(files, "repo", "rev", "path").filter(F.col("rev") == rev)
    found = loaded.join(dynamic, list(on), "left_semi").select("repo", "path").distinct()
    if providers is None:
        return found
    return found.join(require(providers, "repo").select("repo").distinct(), "repo", "left_anti")


def with_scope(df: DataFrame) -> DataFrame:
    """Add the normalised `catalog` and `schema` where `df` holds the raw references.

    Columns `catalog_given` and `schema_given`, if there, tell that the key was written: a null that was written is not the
    default.
    """
    if "catalog_ref" not in df.columns:
        return df
    given = lambda c: F.col(c) if c in df.columns else None
    raw = ("catalog_ref", "schema_ref", "catalog_given", "schema_given")
    return df.select(
        *[c for c in df.columns if c not in raw],
        normalise_ref(F.col("catalog_ref"), DEFAULT_CATALOG, given("catalog_given")).alias("catalog"),
        normalise_ref(F.col("schema_ref"), DEFAULT_SCHEMA, given("schema_given")).alias("schema"),
    )


def declared_names(
    files: DataFrame, calls: DataFrame, on: tuple[str, ...] = ("repo", "rev", "path")
) -> DataFrame:
    """(repo, rev, name) of every declaration in a file that a pipeline loads, with repeats.

    References are normalised before the join, where there are fewer rows. Files that no pipeline loads
    drop out in the join. Revision diffs take this as it is: their own aggregate removes repeats, which
    saves the shuffle of a `distinct`.
    """
    literals = declaration_calls(calls).filter(F.col("name_literal") != "")
    keep = [c for c in ("catalog_ref", "schema_ref", "catalog_given", "schema_given") if c in calls.columns]
    published = with_scope(files).join(
        with_scope(literals.select(*on, "name_literal", *keep)), list(on)
    )
    name = qualify_name(F.col("catalog"), F.col("schema"), F.col("name_literal"))
    return published.select("repo", "rev", name.alias("name"))


def declared_inventory(
    files: DataFrame, calls: DataFrame, on: tuple[str, ...] = ("repo", "rev", "path")
) -> DataFrame:
    """Distinct (repo, rev, name): the inventory of every repository and revision."""
    return declared_names(files, calls, on).distinct()


def with_provider(scanned: DataFrame, provided: DataFrame, providers: DataFrame) -> DataFrame:
    """Rows of `provided` for the repositories in `providers`, rows of `scanned` for the others.

    A repository whose provider gave no rows has none; it does not fall back to the scan.
    """
    repos = require(providers, "repo").select("repo").distinct()
    return scanned.join(repos, "repo", "left_anti").unionByName(provided.join(repos, "repo", "left_semi"))


def last_definition(
    resources: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...]
) -> DataFrame:
    """The definition in the last file, whole, for each key.

    A maximum is combined before the shuffle, so a key that is repeated very often stays cheap, which a
    ranking window would not.
    """
    require(resources, *keys, "file_order", *fields)
    return (
        resources.groupBy(*keys)
        .agg(F.max(F.struct("file_order", *fields)).alias("last"))
        .select(*keys, *[F.col("last")[f].alias(f) for f in fields])
    )


def distinct_files(files: DataFrame) -> DataFrame:
    """Each (repo, path) once, however many pipelines load it."""
    return require(files, "repo", "path").select("repo", "path").distinct()
