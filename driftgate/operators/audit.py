"""Which schemas a repository may use, and which it declares or writes to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.functions.names import (
    clean_destination,
    destination_schema,
    is_interpolated,
    schema_of_name,
)
from driftgate.functions.text import WRITE_STATEMENT
from driftgate.model import HEAD, WRITER_METHODS, require, require_string_lists

MATERIALIZED = "materialize"
RETIRED = "retire"

WRITE_COLUMNS = ("verb", "dest", "dynamic")


def allowed_schemas(config: DataFrame) -> DataFrame:
    """(repo, schema_name) each repository may use; a provided list goes before a literal one.

    A repository whose lists are both null has not declared anything. One whose list is empty may use
    nothing. `allowed_declared` keeps the two apart.
    """
    require_string_lists(config, "literal", "provided")
    return config.select(
        "repo", F.explode(F.coalesce("provided", "literal")).alias("schema_name")
    ).distinct()


def allowed_declared(config: DataFrame) -> DataFrame:
    """The repositories that declare their schemas, even as an empty list."""
    require_string_lists(config, "literal", "provided")
    return config.filter(F.coalesce("provided", "literal").isNotNull()).select("repo").distinct()


def declared_union(named: DataFrame, retired: DataFrame, rev: str = HEAD) -> DataFrame:
    """Distinct (repo, name, origin) of everything materialised in revision `rev` or retired.

    A name that only another revision declares is not audited. A retirement deletes data, so in this audit it counts by itself.
    Rows of different origin are never equal, so each origin is made distinct by itself, without the origin in the key.
    """
    made = require(named, "rev").filter(F.col("rev") == rev).select("repo", "name").distinct()
    gone = retired.select("repo", "name").distinct()
    return made.withColumn("origin", F.lit(MATERIALIZED)).unionByName(gone.withColumn("origin", F.lit(RETIRED)))


def malformed_names(declared: DataFrame) -> DataFrame:
    """Declared names that are not `catalog.schema.table`, so that their schema is unknown."""
    return require(declared, "name").filter(schema_of_name(F.col("name")).isNull())


def outside(df: DataFrame, allowed: DataFrame) -> DataFrame:
    """Rows whose (repo, schema_name) is not allowed. The comparison is exact.

    The rows with an unknown schema must be gone by now, so no null key piles up in one partition.
    """
    pairs = require(allowed, "repo", "schema_name").select("repo", "schema_name")
    return df.join(pairs, ["repo", "schema_name"], "left_anti")


def outside_schema(declared: DataFrame, allowed: DataFrame) -> DataFrame:
    """Well-formed declared names in a schema the repository may not use."""
    known = (
        require(declared, "repo", "name", "origin")
        .withColumn("schema_name", schema_of_name(F.col("name")))
        .filter(F.col("schema_name").isNotNull())
    )
    return outside(known, allowed).select("repo", "name", "origin", "schema_name")


def in_loaded_files(found: DataFrame, files: DataFrame, rev: str = HEAD) -> DataFrame:
    """The statements or calls in files that some pipeline loads in revision `rev`, each once however many load it.

    The revision stays in the key that makes the files distinct: with the columns of the join alone, Spark would hold the
    distinct files and sort them in one and the same task, and could not split a file with very many findings.
    """
    require(found, "repo", "path")
    loaded = require(files, "repo", "rev", "path").filter(F.col("rev") == rev).select("repo", "rev", "path").distinct()
    return found.join(loaded.select("repo", "path"), ["repo", "path"], "left_semi")


def statement_writes(statements: DataFrame) -> DataFrame:
    """Every write in each SQL text, with its verb in upper case and its destination.

    A text is searched once. A destination holds no blank, so verb and destination are what stands before and
    after the last blank of a hit. They are taken inside the list of hits, because a filter on a column made
    after the explode would evaluate all of it again. `dynamic`, if the table has it, says that the text was
    built around values known only at run time.
    """
    require(statements, "sql")
    others = [c for c in statements.columns if c not in ("sql", "dynamic")]
    dynamic = F.col("dynamic") if "dynamic" in statements.columns else F.lit(False)
    hits = F.transform(
        F.regexp_extract_all("sql", F.lit(WRITE_STATEMENT), F.lit(0)),
        lambda hit: F.regexp_replace(hit, r"(?U)\s+", " "),
    )

    def parts(hit: Column) -> Column:
        last = F.substring_index(hit, " ", -1)
        verb = F.substr(hit, F.lit(1), F.length(hit) - F.length(last) - 1)
        return F.struct(F.upper(verb).alias("verb"), F.replace(last, F.lit("`")).alias("dest"))

    return statements.select(
        *others,
        F.coalesce(dynamic, F.lit(False)).alias("dynamic"),
        F.inline(F.transform(hits, parts)),
    ).select(*others, *WRITE_COLUMNS)


def writer_calls(calls: DataFrame) -> DataFrame:
    """Calls that save to a named table, on any receiver.

    Only a literal that is the first positional argument is a known destination (`arg_source`, if the table has it); what is
    passed by keyword or computed is known only at run time.
    """
    require(calls, "method", "name_literal", "is_dynamic")
    by_name = F.coalesce(F.col("arg_source") != "positional", F.lit(True)) if "arg_source" in calls.columns else F.lit(False)
    dropped = ("receiver", "method", "arg_source", "name_literal", "is_dynamic")
    others = [c for c in calls.columns if c not in dropped]
    return calls.filter(F.col("method").isin(*WRITER_METHODS)).select(
        *others,
        F.col("method").alias("verb"),
        clean_destination(F.col("name_literal")).alias("dest"),
        (F.col("is_dynamic") | F.col("name_literal").isNull() | by_name).alias("dynamic"),
    )


def statement_violations(writes: DataFrame, allowed: DataFrame) -> DataFrame:
    """Writes with a known destination in a schema the repository may not use.

    An unqualified destination is in the pipeline's own schema and is fine.
    """
    require(writes, "repo", *WRITE_COLUMNS)
    known = (
        writes.filter(~F.col("dynamic"))
        .withColumn("schema_name", destination_schema(F.col("dest")))
        .filter(F.col("schema_name").isNotNull())
    )
    return outside(known, allowed).select(*writes.columns, "schema_name")


def statement_unresolved(writes: DataFrame) -> DataFrame:
    """Writes whose destination is only known at run time: a warning, never an error."""
    require(writes, *WRITE_COLUMNS)
    return writes.filter(F.col("dynamic") | is_interpolated(F.col("dest")))
