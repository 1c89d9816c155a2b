"""Input and output schemas, and the values that every operator shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fields of a pipeline whose change recreates it.
RECREATE_FIELDS = ("catalog", "schema", "target", "storage", "serverless")

# Calls that declare a table, and the name they must be called on.
DECLARING_RECEIVER = "dlt"
DECLARING_DECORATORS = ("table", "view", "materialized_view")
DECLARING_CALLS = ("create_streaming_table", "create_target_table")

# Writer methods that name their destination.
WRITER_METHODS = ("saveAsTable", "insertInto")

# What a pipeline without catalog or schema publishes under.
DEFAULT_CATALOG = "{catalog}"
DEFAULT_SCHEMA = "default"

# Labels that accept each family of findings.
DESTROY_LABEL = "acepta-destruccion"
INACTIVE_LABEL = "acepta-tablas-inactivas"

# Kinds of resources and roles of references.
PIPELINES = "pipelines"
JOBS = "jobs"
OWNER_ROLE = "repo"
TOOLING_ROLE = "tooling"

BASE = "base"
HEAD = "head"

DESTRUCTIVE = "DESTRUCTIVE"
ORPHAN = "ORPHAN"
NOTICE = "NOTICE"

# Input tables, as Spark DDL for readers.
PIPELINES_SCHEMA = (
    "repo BIGINT, rev STRING, key STRING, catalog_ref STRING, schema_ref STRING, files ARRAY<STRING>"
)
PIPELINE_FILES_SCHEMA = (
    "repo BIGINT, rev STRING, key STRING, catalog_ref STRING, schema_ref STRING, path STRING"
)
CALLS_SCHEMA = (
    "repo BIGINT, rev STRING, path STRING, line BIGINT, receiver STRING, method STRING, "
    "arg_source STRING, name_literal STRING, is_dynamic BOOLEAN"
)
RESOURCES_SCHEMA = (
    "repo BIGINT, rev STRING, kind STRING, key STRING, file_order BIGINT, "
    "catalog STRING, schema STRING, target STRING, storage STRING, serverless STRING"
)
NAMED_SCHEMA = "repo BIGINT, rev STRING, name STRING"
RETIRED_SCHEMA = "repo BIGINT, name STRING, reason STRING"
SCHEMA_CONFIG_SCHEMA = "repo BIGINT, literal ARRAY<STRING>, provided ARRAY<STRING>"
ALLOWED_SCHEMA = "repo BIGINT, schema_name STRING"
LABELS_SCHEMA = "repo BIGINT, labels_csv STRING"
STATEMENTS_SCHEMA = (
    "repo BIGINT, path STRING, line BIGINT, sql STRING, dynamic BOOLEAN"
)
TEXTS_SCHEMA = "repo BIGINT, path STRING, text STRING"
ORG_CONFIG_SCHEMA = (
    "repo BIGINT, owner_org STRING, tooling_org STRING, tooling_repo STRING"
)
FINDING_COLUMNS = ("repo", "severity", "kind", "item", "detail", "remedy")


class ConfigurationError(ValueError):
    """An input table does not have the shape an operator needs."""


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Return `df`, or fail if a column is missing.

    An unreadable input must never look like an empty one.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ConfigurationError(f"missing column(s) {missing}; got {df.columns}")
    return df


def require_string_lists(df: DataFrame, *columns: str) -> DataFrame:
    """Return `df`, or fail if a column is not a list of strings."""
    require(df, *columns)
    for name in columns:
        kind = df.schema[name].dataType
        if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType)):
            raise ConfigurationError(f"{name} must be a list of strings, not {kind.simpleString()}")
    return df
