"""Reading and writing inventories and resource definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgate.functions.paths import resolved_path
from driftgate.functions.text import LINE_BREAK, strip
from driftgate.model import BASE, HEAD, require


def inventory_names(texts: DataFrame, text: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Distinct names in inventory texts; blank lines and `#` comments are not names."""
    return (
        texts.select(*keys, F.explode(F.split(F.col(text), LINE_BREAK)).alias("line"))
        .select(*keys, strip(F.col("line")).alias("name"))
        .filter((F.col("name") != "") & ~F.col("name").startswith("#"))
        .distinct()
    )


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Names in the inventory text files under `path`, with the folder's partition columns.

    A path that does not exist fails the read. It does not read as "no names".
    """
    lines = spark.read.text(path)
    return inventory_names(lines, keys=tuple(c for c in lines.columns if c != "value"))


def write_inventory(named: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Distinct names as parquet, one folder per revision, sorted inside each file.

    The rebalance hint lets Spark split a revision that is much larger than the others over several
    files, and join small ones.
    """
    (
        require(named, "repo", "rev", "name").select("repo", "rev", "name").distinct()
        .hint("rebalance", "rev")
        .sortWithinPartitions("rev", "repo", "name")
        .write.mode(mode).partitionBy("rev").parquet(path)
    )


def write_inventory_text(named: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Distinct names as sorted text lines, one folder per repository and revision."""
    (
        require(named, "repo", "rev", "name").select("repo", "rev", "name").distinct()
        .hint("rebalance", "repo", "rev")
        .sortWithinPartitions("repo", "rev", "name")
        .write.mode(mode).partitionBy("repo", "rev").text(path)
    )


def resources_by_kind(
    resources: DataFrame, kind: str, revisions: tuple[str, ...] = (BASE, HEAD)
) -> DataFrame:
    """Definitions of one kind in the given revisions. Both filters reach the scan."""
    require(resources, "rev", "kind")
    return resources.filter((F.col("kind") == kind) & F.col("rev").isin(*revisions))


def explode_files(pipelines: DataFrame, path: Column | None = None) -> DataFrame:
    """One row per code file of a pipeline; entries without a path are skipped.

    `files` is a list of paths, or of structs from which `path` takes one.
    """
    require(pipelines, "files")
    others = [c for c in pipelines.columns if c != "files"]
    entry = F.col("file") if path is None else path
    return (
        pipelines.select(*others, F.explode("files").alias("file"))
        .select(*others, entry.alias("path"))
        .filter(F.col("path").isNotNull() & (F.col("path") != ""))
    )


def resolved_files(files: DataFrame, declared_in: str = "declared_in") -> DataFrame:
    """Files with `path` as seen from the top of the repository; column `declared_in` names the file that declares each.

    Declarations write paths relative to themselves, so the same file may come as `../a.py` and `a.py`. A path that leads
    out of the repository can't be one of its files; `files_outside` lists those, so they are dropped here and not lost.
    """
    return with_resolved(files, declared_in).filter(F.col("path").isNotNull()).drop("written")


def files_outside(files: DataFrame, declared_in: str = "declared_in") -> DataFrame:
    """The declarations whose path leads out of the repository, with the path as `written`."""
    return with_resolved(files, declared_in).filter(F.col("path").isNull() & F.col("written").isNotNull()).drop("path")


def with_resolved(files: DataFrame, declared_in: str) -> DataFrame:
    others = [c for c in require(files, "path", declared_in).columns if c != "path"]
    return files.select(*others, F.col("path").alias("written"), resolved_path(F.col(declared_in), F.col("path")).alias("path"))
