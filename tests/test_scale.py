"""What must hold when one key has a third of all rows."""

import pytest
from pyspark.sql import functions as F

from driftgate.operators import audit, diff, inventory, refs
from driftgate.operators.gate import finding_report
from driftgate.operators.ranking import number_rows
from driftgate.plans.schemas import schema_gate
from driftgate.session import durable

from .conftest import rows

N = 200_000


@pytest.fixture
def skewed(spark):
    """Joins are not broadcast, and a partition counts as too large early."""
    small = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot(column, others):
    """0 for a third of the rows, else spread out."""
    return F.when(column % 3 == 0, 0).otherwise(column % others + 1)


def numbers(spark):
    return spark.range(0, N, 1, 8)


def test_building_an_audit_starts_no_job(spark):
    declared = numbers(spark).select(
        F.col("id").alias("repo"), F.lit("{c}.s.t").alias("name"), F.lit("materialize").alias("origin"))
    allowed = spark.range(500).select(F.col("id").alias("repo"), F.lit("s").alias("schema_name"))
    spark.sparkContext.setJobGroup("building", "")
    audit.outside_schema(declared, allowed)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("building")) == []


def test_loaded_files_split_a_hot_repository(skewed, plan):
    found = numbers(skewed).select(F.lit(1).alias("repo"), hot(F.col("id"), 997).alias("path"), F.col("id").alias("line"))
    files = skewed.range(998).select(F.lit(1).alias("repo"), F.lit("head").alias("rev"), F.col("id").alias("path"))
    loaded = audit.in_loaded_files(found, files)
    assert len(loaded.collect()) == N
    assert "skew=true" in plan(loaded)


def aggregated(df):
    """The most rows that any hash aggregate of the plan that ran has put out, all tasks together."""
    most, nodes = 0, [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        kind = node.getClass().getSimpleName()
        if kind == "HashAggregateExec":
            most = max(most, node.metrics().apply("numOutputRows").value())
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        nodes += inner + [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_loaded_files_split_a_hot_file(skewed, plan):
    found = numbers(skewed).select(hot(F.col("id"), 9).alias("repo"), hot(F.col("id"), 97).alias("path"), F.col("id").alias("line"))
    files = skewed.range(980).select((F.col("id") % 10).alias("repo"), F.lit("head").alias("rev"), F.floor(F.col("id") / 10).alias("path"))
    loaded = audit.in_loaded_files(found, files.unionByName(files))
    assert len(loaded.collect()) == N
    assert "skew=true" in plan(loaded)


def test_the_schema_gate_makes_only_files_with_writes_distinct(skewed):
    repos = skewed.range(4).select(F.col("id").alias("repo"))
    config = repos.select("repo", F.array(F.lit("s")).alias("literal"), F.lit(None).cast("array<string>").alias("provided"))
    declared = repos.select("repo", F.lit("c.s.t").alias("name"), F.lit("materialize").alias("origin"))
    writes = skewed.range(3000).select(
        (F.col("id") % 3).alias("repo"), (F.col("id") % 50).alias("path"), F.lit("UPDATE").alias("verb"),
        F.lit("c.other.t").alias("dest"), F.lit(False).alias("dynamic"))
    files = numbers(skewed).select((F.col("id") % 2).alias("repo"), F.lit("head").alias("rev"), F.col("id").alias("path"))
    verdicts = schema_gate(repos, config, declared, writes, files)
    inside = [sum(i % 3 == r == i % 50 % 2 for i in range(3000)) for r in range(4)]
    assert rows(verdicts, "repo", "n_writes_outside") == list(enumerate(inside))
    verdicts.collect()
    assert 0 < aggregated(verdicts) <= 8 * 150


def test_schema_audit_splits_a_hot_repository(skewed, plan):
    declared = numbers(skewed).select(
        hot(F.col("id"), 997).alias("repo"),
        F.concat(F.lit("{c}.s"), F.col("id") % 2, F.lit(".t"), F.col("id")).alias("name"),
        F.lit("materialize").alias("origin"))
    allowed = skewed.range(500).select(F.col("id").alias("repo"), F.lit("s1").alias("schema_name"))
    found = audit.outside_schema(declared, allowed)
    expected = sum(1 for i in range(N) if not (i % 2 == 1 and (0 if i % 3 == 0 else i % 997 + 1) < 500))
    assert len(found.collect()) == expected
    assert "skew=true" in plan(found)


def test_inventory_join_splits_a_hot_file(skewed, plan):
    files = numbers(skewed).select(
        (F.col("id") % 50).alias("repo"), F.lit("head").alias("rev"), hot(F.col("id"), 997).alias("path"),
        F.lit("c").alias("catalog"), F.concat(F.lit("s"), F.col("id")).alias("schema"))
    calls = skewed.range(998).select(
        F.col("id").alias("path"), F.lit("dlt").alias("receiver"), F.lit("table").alias("method"),
        F.lit("keyword").alias("arg_source"), F.concat(F.lit("t"), F.col("id")).alias("name_literal"),
        F.lit(False).alias("is_dynamic"))
    names = inventory.declared_names(files, calls, on=("path",))
    assert len(names.collect()) == N
    assert "skew=true" in plan(names)


def test_reference_audit_splits_a_hot_repository(skewed, plan):
    found = numbers(skewed).select(
        hot(F.col("id"), 997).alias("repo"), F.col("id").alias("page"), F.lit("repo").alias("role"),
        F.when(F.col("id") % 2 == 0, "own").otherwise("else").alias("org"), F.lit(None).cast("string").alias("target_repo"))
    config = skewed.range(998).select(
        F.col("id").alias("repo"), F.lit("own").alias("owner_org"),
        F.lit(None).cast("string").alias("tooling_org"), F.lit(None).cast("string").alias("tooling_repo"))
    drift = refs.reference_drift(refs.reference_audit(found, config, "x"))
    assert len(drift.collect()) == N // 2
    assert "skew=true" in plan(drift)


def test_diffs_combine_repeats_before_their_only_shuffle(spark, plan):
    named = numbers(spark).select(
        hot(F.col("id"), 9).alias("repo"), F.when(F.col("id") % 2 == 0, "base").otherwise("head").alias("rev"),
        F.concat(F.lit("t"), hot(F.col("id"), 5)).alias("name"))
    removed = diff.removed_tables(named)
    removed.collect()
    text = plan(removed)
    shuffles = text.split("== Initial Plan ==")[0].count("Exchange hashpartitioning")
    assert shuffles == 1 and "partial_max" in text


def test_definitions_need_one_shuffle_and_no_window(spark, plan):
    resources = numbers(spark).select(
        F.lit(1).alias("repo"), F.when(F.col("id") % 2 == 0, "base").otherwise("head").alias("rev"),
        F.lit("pipelines").alias("kind"), hot(F.col("id"), 997).alias("key"), F.col("id").alias("file_order"),
        *[F.col("id").cast("string").alias(f) for f in ("catalog", "schema", "target", "storage", "serverless")])
    changes = diff.recreate_fields(resources)
    last = {}
    for i in range(N):
        last.setdefault(0 if i % 3 == 0 else i % 997 + 1, {})[i % 2] = i
    expected = sum(5 for pair in last.values() if len(pair) == 2)
    assert len(changes.collect()) == expected
    text = plan(changes).split("== Initial Plan ==")[0]
    assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text


def test_a_hot_group_is_numbered_over_several_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        items = numbers(spark).select(
            hot(F.col("id"), 7).alias("g"), F.format_string("i%07d", "id").alias("item"))
        ranked = number_rows(items, ("g",), ("item",), "n")
        data = ranked.select("g", "item", "n").toPandas().sort_values(["g", "item"])
        expected = data.groupby("g").cumcount() + 1
        assert len(data) == N and (data["n"] == expected).all()
        spread = items.repartitionByRange("g", "item").withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in spread.groupBy("p").count().collect()]
        assert max(sizes) < N / 3
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_large_report_is_whole(spark):
    findings = numbers(spark).select(
        hot(F.col("id"), 7).alias("repo"), F.lit("ORPHAN").alias("severity"), F.format_string("t%07d", "id").alias("item"))
    pages = finding_report(findings, page_lines=500)
    sizes = pages.select(F.size(F.split("detail", "\n")).alias("n"))
    assert sizes.agg(F.sum("n"), F.max("n")).first() == (N, 500)
    first = pages.filter("repo = 0 and page = 0").first()["detail"].split("\n")
    assert first == [f"t{i * 3:07d}" for i in range(500)]


def test_durable_copies_lie_in_the_configured_folder(spark, tmp_path):
    context = spark.sparkContext
    copy = durable(spark.range(5))
    assert rows(copy) == [(i,) for i in range(5)]
    assert context.getCheckpointDir() is not None
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert configured in context.getCheckpointDir()
