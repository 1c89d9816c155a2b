"""Inventories against a model in plain Python, and their storage."""

import random

import pytest
from pyspark.sql import functions as F

from driftgate import model
from driftgate.operators import diff, inventory
from driftgate.plans.lock import lock_gate
from driftgate.sources import inventory as sources

from .conftest import rows

DECLARING = {
    ("table", "keyword"), ("view", "keyword"), ("materialized_view", "keyword"), ("create_streaming_table", "positional"),
    ("create_streaming_table", "keyword"), ("create_target_table", "positional"), ("create_target_table", "keyword"),
}
SCOPES = {None: "{0}", "${var.hill}": "{hill}", "${moor}": "{moor}", " marsh ": "marsh", "${a}_b": "${a}_b", "${bundle.target}": "{bundle.target}"}


@pytest.fixture(scope="module")
def meadow():
    """Pipelines that load files, and calls in these and in other files, of several repositories and revisions."""
    rng = random.Random(21)
    scope = list(SCOPES)
    pipelines = [
        (rng.randint(1, 5), rng.choice(["base", "head"]), f"p{i}", rng.choice(scope), rng.choice(scope), f"f{rng.randint(1, 6)}.py")
        for i in range(200)
    ]
    methods = ["table", "view", "materialized_view", "create_streaming_table", "create_target_table", "read", "saveAsTable"]
    calls = []
    for i in range(1200):
        name = rng.choice(["clover", "thyme", "sorrel", "", None])
        calls.append((
            rng.randint(1, 6), rng.choice(["base", "head"]), f"f{rng.randint(1, 8)}.py", i, rng.choice(["dlt", "dlt", "spark.read"]),
            rng.choice(methods), rng.choice(["keyword", "positional", None]), name, name is None,
        ))
    return pipelines, calls


def declares(call):
    return call[4] == "dlt" and (call[5], call[6]) in DECLARING


def plain_inventory(pipelines, calls):
    out = set()
    for repo, rev, _, catalog, schema, path in pipelines:
        for call in calls:
            if call[:3] == (repo, rev, path) and declares(call) and call[7]:
                out.add((repo, rev, f"{SCOPES[catalog].format('{catalog}') if catalog is None else SCOPES[catalog]}."
                                    f"{'default' if schema is None else SCOPES[schema]}.{call[7]}"))  # fmt: skip
    return out


def test_inventories_are_those_of_the_model(spark, meadow):
    pipelines, calls = meadow
    files, found = spark.createDataFrame(pipelines, model.PIPELINE_FILES_SCHEMA), spark.createDataFrame(calls, model.CALLS_SCHEMA)
    expected = plain_inventory(pipelines, calls)
    names = rows(inventory.declared_inventory(files, found), "repo", "rev", "name")
    assert set(names) == expected and len(names) == len(expected) > 50
    once = {(p[0], p[5]) for p in pipelines}
    assert set(rows(inventory.distinct_files(files))) == once


def test_declaring_calls_are_those_of_the_model(spark, meadow):
    _, calls = meadow
    found = spark.createDataFrame(calls, model.CALLS_SCHEMA)
    assert rows(inventory.declaration_calls(found), "line") == sorted([(c[3],) for c in calls if declares(c)], key=repr)
    dynamic = {}
    for c in calls:
        if declares(c):
            dynamic.setdefault((c[0], c[2]), [0, 0])[0 if c[8] else 1] += 1
    assert set(rows(inventory.dynamic_names(found))) == {(*k, a, b) for k, (a, b) in dynamic.items() if a}


def test_inventory_text_has_a_name_on_each_line_that_is_neither_blank_nor_a_comment(spark):
    lines = ["# of the meadow", "", " \t", "m.a.clover", "  m.a.thyme \r", "\t# m.a.weed", "m.a.clover", "#m.a.moss"]
    df = spark.createDataFrame([("\n".join(lines),), (None,), ("",)], "value string")
    expected = {s for s in map(str.strip, lines) if s and s[0] != "#"}
    assert set(rows(sources.inventory_names(df))) == {(n,) for n in expected}


@pytest.mark.parametrize("seed", [1, 2])
def test_last_definitions_drift_and_lock_gate_agree_with_dictionaries(spark, seed):
    rng = random.Random(seed)
    made = [(rng.randint(1, 3), rng.choice(["base", "head"]), "pipelines", rng.choice("abc"), i, *[rng.choice([None, "u", "v"]) for _ in range(5)])
            for i in range(60)]
    last = {m[:4]: m[5:] for m in made}
    mixed = rng.sample(made, len(made))
    found = inventory.last_definition(spark.createDataFrame(mixed, model.RESOURCES_SCHEMA), ("repo", "rev", "kind", "key"), model.RECREATE_FIELDS)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in found.collect()} == last

    named = [(rng.randint(1, 9), rng.choice(["base", "head"]), rng.choice("klmn")) for _ in range(50)]
    named += [(10, rev, n) for rev in ("base", "head") for n in "kl"]
    held = {(r, v): {n for a, b, n in named if (a, b) == (r, v)} for r in range(1, 13) for v in ("base", "head")}
    names = spark.createDataFrame(named, model.NAMED_SCHEMA)
    drift = {(r, n, "extra" if n in held[r, "base"] else "missing") for r in range(1, 13) for n in held[r, "base"] ^ held[r, "head"]}
    assert set(rows(diff.inventory_drift(names))) == drift
    stored = {r for r in range(1, 13) if rng.random() < 0.7} | {10}
    listed = spark.createDataFrame([(r, "base") for r in stored] + [(r, "head") for r in range(1, 13)], "repo bigint, rev string")
    result = {r["repo"]: tuple(r)[1:] for r in lock_gate(spark.createDataFrame([(r,) for r in range(1, 13)], "repo bigint"), listed, names).collect()}
    for r in range(1, 13):
        base, head = held[r, "base"], held[r, "head"]
        status = "absent" if r not in stored else "up to date" if base == head else "outdated"
        assert result[r] == (len(head), len(head - base), len(base - head), status, int(status != "up to date"))


def test_a_provider_replaces_the_scan_even_when_it_gives_nothing(spark):
    scanned = spark.createDataFrame([(1, "head", "s1"), (2, "head", "s2"), (3, "head", "s3")], model.NAMED_SCHEMA)
    provided = spark.createDataFrame([(1, "head", "p1"), (3, "head", "ignored")], model.NAMED_SCHEMA)
    providers = spark.createDataFrame([(1,), (2,)], "repo bigint")
    assert rows(inventory.with_provider(scanned, provided, providers), "repo", "name") == [(1, "p1"), (3, "s3")]


def test_a_broken_provider_fails(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sources.read_inventory(spark, str(tmp_path / "missing"))
    with pytest.raises(model.ConfigurationError, match="missing column"):
        inventory.with_provider(spark.range(1), spark.range(1), spark.range(1))


def test_inventories_survive_a_round_trip(spark, tmp_path):
    named = spark.createDataFrame(
        [(1, "base", "{c}.s.a"), (1, "base", "{c}.s.a"), (1, "head", "{c}.s.b"), (2, "head", "{c}.s.c")],
        model.NAMED_SCHEMA)
    expected = rows(named.distinct(), "repo", "rev", "name")
    sources.write_inventory(named, str(tmp_path / "parquet"))
    assert rows(spark.read.parquet(str(tmp_path / "parquet")), "repo", "rev", "name") == expected
    sources.write_inventory_text(named, str(tmp_path / "text"))
    assert rows(sources.read_inventory(spark, str(tmp_path / "text")), "repo", "rev", "name") == expected


def test_revision_and_kind_filters_reach_the_scan(spark, tmp_path, plan):
    df = spark.createDataFrame(
        [(1, "base", "jobs", "j", 1, "c", "s", None, None, "true"),
         (1, "old", "pipelines", "p", 1, "c", "s", None, None, "true"),
         (1, "head", "pipelines", "p", 1, "c", "s", None, None, "true")], model.RESOURCES_SCHEMA)
    df.write.partitionBy("rev").parquet(str(tmp_path / "r"))
    chosen = sources.resources_by_kind(spark.read.parquet(str(tmp_path / "r")), "pipelines").select("key", "rev")
    assert rows(chosen) == [("p", "head")]
    text = plan(chosen)
    assert "PartitionFilters: [rev" in text and "EqualTo(kind,pipelines)" in text
    assert "ReadSchema: struct<kind:string,key:string>" in text


def test_explode_files_skips_entries_without_a_path(spark):
    df = spark.createDataFrame([(1, ["a.py", None, "", "b.py"]), (2, []), (3, None)], "repo bigint, files array<string>")
    assert rows(sources.explode_files(df)) == [(1, "a.py"), (1, "b.py")]
    nested = df.select("repo", F.transform("files", lambda f: F.struct(f.alias("path"))).alias("files"))
    assert rows(sources.explode_files(nested, F.col("file.path"))) == [(1, "a.py"), (1, "b.py")]
