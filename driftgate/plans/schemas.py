"""The gate that a repository stays inside its schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgate.functions.names import destination_schema, is_interpolated, schema_of_name
from driftgate.operators.audit import allowed_declared, allowed_schemas, in_loaded_files
from driftgate.operators.inventory import distinct_files


def schema_gate(
    repos: DataFrame, config: DataFrame, declared: DataFrame, writes: DataFrame, files: DataFrame
) -> DataFrame:
    """The verdict of every known repository, from the first check that fails.

    Names and writes are counted by schema before anything is joined, so the join with the allowed schemas
    sees one row per repository and schema, however many names fall into it, and the join with the loaded files
    one row per file and schema. Only writes in files that some pipeline loads at head count. Files without any
    write are left out before files are made distinct; the writes are read twice for this.
    """
    declares = (
        declared.select("repo", schema_of_name(F.col("name")).alias("schema_name"))
        .groupBy("repo", "schema_name")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("repo", F.lit("name").alias("source"), "schema_name", F.lit(False).alias("unresolved"), "n")
    )
    by_file = (
        writes.select(
            "repo",
            "path",
            F.when(~F.col("dynamic"), destination_schema(F.col("dest"))).alias("schema_name"),
            (F.col("dynamic") | is_interpolated(F.col("dest"))).alias("unresolved"),
        )
        .groupBy("repo", "path", "schema_name", "unresolved")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    written_files = files.join(distinct_files(by_file), ["repo", "path"], "left_semi")
    written = (
        in_loaded_files(by_file, written_files)
        .groupBy("repo", "schema_name", "unresolved")
        .agg(F.sum("n").alias("n"))
        .select("repo", F.lit("write").alias("source"), "schema_name", "unresolved", "n")
    )
    tally = declares.unionByName(written)
    pairs = allowed_schemas(config).withColumn("is_allowed", F.lit(True))
    foreign = F.col("schema_name").isNotNull() & F.col("is_allowed").isNull()
    is_name = F.col("source") == "name"

    def total(condition, name):
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).alias(name)

    counts = (
        tally.join(pairs, ["repo", "schema_name"], "left")
        .groupBy("repo")
        .agg(
            total(is_name, "n_declared"),
            total(is_name & F.col("schema_name").isNull(), "n_malformed"),
            total(is_name & foreign, "n_outside"),
            total(~is_name & foreign, "n_writes_outside"),
            total(F.col("unresolved"), "n_unresolved"),
        )
    )
    names = ("n_declared", "n_malformed", "n_outside", "n_writes_outside", "n_unresolved")
    declares_schemas = allowed_declared(config).withColumn("checked", F.lit(True))
    status = (
        F.when(F.col("checked").isNull(), "skipped")
        .when(F.col("n_malformed") > 0, "malformed")
        .when(F.col("n_outside") > 0, "outside")
        .when(F.col("n_writes_outside") > 0, "writes outside")
        .when(F.col("n_unresolved") > 0, "warnings")
        .otherwise("ok")
    )
    failing = F.col("status").isin("malformed", "outside", "writes outside")
    return (
        repos.select("repo").join(declares_schemas, "repo", "left").join(counts, "repo", "left")
        .select("repo", "checked", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
        .select("repo", *names, status.alias("status"))
        .withColumn("exit_code", F.when(failing, 1).otherwise(0).cast("bigint"))
    )
