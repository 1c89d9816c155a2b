"""Schemas that a repository may use: audits and gate against a model in plain Python."""

import random
import re

import pytest

from driftgate import model
from driftgate.functions.text import WRITE_STATEMENT
from driftgate.operators import audit
from driftgate.plans.schemas import schema_gate

from .conftest import rows

BEDS = ["herbs", "roses", "her", "herbs2"]
VERBS = [
    "INSERT INTO", "INSERT OVERWRITE", "INSERT OVERWRITE TABLE", "CREATE TABLE", "CREATE OR REPLACE VIEW", "CREATE EXTERNAL TABLE IF NOT EXISTS",
    "MERGE INTO", "UPDATE", "DELETE FROM", "DROP TABLE", "DROP TABLE IF EXISTS", "TRUNCATE TABLE", "ALTER TABLE",
]
READS = ["SELECT * FROM {0}", "DESCRIBE {0}", "-- nothing about {0}", "CREATE TEMP VIEW v AS SELECT 1", "DROP VIEW {0}"]


def generated():
    rng = random.Random(31)
    name = lambda: rng.choice(["c.{}.mint", "{{c}}.{}.sage", "c.{}.a.b", "{}", "c..{}.x"]).format(rng.choice(BEDS))
    well_formed = lambda: f"c.{rng.choice(BEDS)}.mint"
    out = {}
    for repo in range(160):
        made = name if rng.random() < 0.3 else well_formed
        lists = [rng.choice([None, [], ["herbs"], ["herbs", "her"], BEDS]) for _ in range(2)]
        texts, calls = [], []
        for _ in range(rng.randint(0, 2)):
            target = rng.choice(["t", "herbs.t", "c.roses.t", "`her`.`t`", "{x}.herbs.t", "c.herbs2.t"])
            verb = "  ".join(rng.choice(VERBS).split()).lower() if rng.random() < 0.5 else rng.choice(VERBS)
            texts.append((verb, target, rng.random() < 0.1))
        if rng.random() < 0.3:
            calls.append(rng.choice([("saveAsTable", "c.roses.t"), ("insertInto", "`herbs`.t"), ("saveAsTable", None), ("save", "roses.t")]))
        out[repo] = {
            "literal": lists[0], "provided": lists[1] if rng.random() < 0.4 else None, "head": {made() for _ in range(rng.randint(0, 2))},
            "base": {"c.weeds.x"}, "retired": {made()} if rng.random() < 0.2 else set(), "texts": texts, "calls": calls,
            "loaded": rng.random() < 0.8, "reads": [rng.choice(READS).format("c.roses.t")],
        }
    return out


def schema_of_name(name):
    parts = name.split(".")
    return parts[1] if len(parts) == 3 else None


def schema_of_target(target):
    parts = [p for p in target.replace("`", "").split(".") if p]
    return None if "{" in target or len(parts) < 2 else parts[0] if len(parts) == 2 else parts[1]


def plain_writes(g):
    """(schema or None, known only at run time) of every write."""
    out = [(None if dynamic else schema_of_target(t), dynamic or "{" in t) for _, t, dynamic in g["texts"]]
    return out + [(schema_of_target(t) if t else None, t is None) for m, t in g["calls"] if m != "save"]


def plain_gate(g):
    allowed = g["literal"] if g["provided"] is None else g["provided"]
    names = [(n, "materialize") for n in g["head"]] + [(n, "retire") for n in g["retired"]]
    inside = set(allowed or [])
    schemas = [schema_of_name(n) for n, _ in names]
    written = plain_writes(g) if g["loaded"] else []
    counts = (
        len(names), schemas.count(None), sum(s is not None and s not in inside for s in schemas),
        sum(s is not None and s not in inside for s, _ in written), sum(u for _, u in written),
    )
    status = "ok"
    for text, n in zip(("warnings", "writes outside", "outside", "malformed"), (counts[4], counts[3], counts[2], counts[1])):
        status = text if n else status
    status = "skipped" if allowed is None else status
    return (*counts, status, int(status in ("malformed", "outside", "writes outside")))


@pytest.fixture(scope="module")
def gardens():
    return generated()


@pytest.fixture(scope="module")
def tables(spark, gardens):
    """config, declared names, writes, loaded files."""
    frame = spark.createDataFrame
    config = frame([(r, g["literal"], g["provided"]) for r, g in gardens.items()], model.SCHEMA_CONFIG_SCHEMA)
    named = frame([(r, rev, n) for r, g in gardens.items() for rev in ("base", "head") for n in g[rev]], model.NAMED_SCHEMA)
    retired = frame([(r, n, "old") for r, g in gardens.items() for n in g["retired"]], model.RETIRED_SCHEMA)
    statements = [(r, "bed.py", 1, f"{v} {t} SELECT 1", d) for r, g in gardens.items() for v, t, d in g["texts"]]
    statements += [(r, "bed.py", 2, s, False) for r, g in gardens.items() for s in g["reads"]]
    call = "repo bigint, path string, line bigint, receiver string, method string, arg_source string, name_literal string, is_dynamic boolean"
    calls = frame([(r, "bed.py", 3, "w", m, "positional", t, t is None) for r, g in gardens.items() for m, t in g["calls"]], call)
    writes = audit.statement_writes(frame(statements, model.STATEMENTS_SCHEMA)).unionByName(audit.writer_calls(calls))
    loaded = [(r, "head", "bed.py") for r, g in gardens.items() if g["loaded"]] * 2 + [(r, "base", "bed.py") for r in gardens]
    files = frame(loaded, "repo bigint, rev string, path string")
    return config, audit.declared_union(named, retired), writes, files


def test_the_gate_is_that_of_the_model(spark, gardens, tables):
    config, declared, writes, files = tables
    result = schema_gate(spark.createDataFrame([(r,) for r in gardens], "repo bigint"), config, declared, writes, files)
    expected = {r: plain_gate(g) for r, g in gardens.items()}
    assert {tuple(r)[0]: tuple(r)[1:] for r in result.collect()} == expected
    assert {e[5] for e in expected.values()} == {"skipped", "malformed", "outside", "writes outside", "warnings", "ok"}


def test_repeats_and_nulls_count_as_rows_do(spark):
    """Equal writes count each, files that are loaded often once, and neither a null file nor a null repository is loaded."""
    frame = spark.createDataFrame
    config = frame([(1, ["herbs"], None), (2, ["herbs"], None)], model.SCHEMA_CONFIG_SCHEMA)
    declared = frame([(1, "c.herbs.a", "materialize"), (1, "c.herbs.a", "retire"), (2, None, "retire"), (None, "c.x.y", "retire")],
                     "repo bigint, name string, origin string")
    outside, unknown = ("bed.py", "INSERT INTO", "c.roses.t", False), ("bed.py", "INSERT INTO", "{x}.t", False)
    writes = [(1, *outside)] * 3 + [(1, *unknown)] * 2 + [(1, "bed.py", "INSERT INTO", None, True), (1, "bed.py", "INSERT INTO", "c.roses.t", None)]
    writes += [(1, None, *outside[1:]), (None, *outside), (2, "gone.py", *outside[1:])]
    writes = frame(writes, "repo bigint, path string, verb string, dest string, dynamic boolean")
    files = frame([(1, "head", "bed.py")] * 4 + [(1, "head", None), (None, "head", "bed.py"), (2, "base", "gone.py")],
                  "repo bigint, rev string, path string")
    result = schema_gate(frame([(1,), (2,), (3,)], "repo bigint"), config, declared, writes, files)
    assert rows(result) == [
        (1, 2, 0, 0, 3, 3, "writes outside", 1), (2, 1, 1, 0, 0, 0, "malformed", 1), (3, 0, 0, 0, 0, 0, "skipped", 0)]


def test_names_outside_and_malformed_are_those_of_the_model(gardens, tables):
    config, declared, _, _ = tables
    outside, malformed = set(), set()
    for r, g in gardens.items():
        inside = set((g["literal"] if g["provided"] is None else g["provided"]) or [])
        for n, origin in [(n, "materialize") for n in g["head"]] + [(n, "retire") for n in g["retired"]]:
            schema = schema_of_name(n)
            if schema is None:
                malformed.add((r, n, origin))
            elif schema not in inside:
                outside.add((r, n, origin, schema))
    assert outside and set(rows(audit.outside_schema(declared, audit.allowed_schemas(config)), "repo", "name", "origin", "schema_name")) == outside
    assert malformed and set(rows(audit.malformed_names(declared), "repo", "name", "origin")) == malformed


def test_violations_and_warnings_are_those_of_the_model(gardens, tables):
    config, _, writes, _ = tables
    inside = {r: set((g["literal"] if g["provided"] is None else g["provided"]) or []) for r, g in gardens.items()}
    expected = sorted((r, s) for r, g in gardens.items() for s, _ in plain_writes(g) if s is not None and s not in inside[r])
    found = audit.statement_violations(writes, audit.allowed_schemas(config))
    assert sorted(tuple(x) for x in found.select("repo", "schema_name").collect()) == expected
    unresolved = sorted(r for r, g in gardens.items() for _, u in plain_writes(g) if u)
    assert sorted(x["repo"] for x in audit.statement_unresolved(writes).collect()) == unresolved


def test_an_empty_list_is_a_declaration_and_no_list_is_none(spark):
    data = [(1, None, None), (2, [], None), (3, ["a", "a"], None), (4, ["a"], []), (5, None, ["b"]), (6, ["a"], ["b", "c"])]
    config = spark.createDataFrame(data, model.SCHEMA_CONFIG_SCHEMA)
    assert rows(audit.allowed_declared(config)) == [(r,) for r in (2, 3, 4, 5, 6)]
    assert rows(audit.allowed_schemas(config)) == [(3, "a"), (5, "b"), (6, "b"), (6, "c")]


def test_lists_must_be_lists_of_strings(spark):
    for schema in ("repo bigint, literal string, provided array<string>", "repo bigint, literal array<string>, provided array<int>"):
        with pytest.raises(model.ConfigurationError, match="list of strings"):
            audit.allowed_schemas(spark.createDataFrame([], schema))


def test_all_writes_of_a_long_text_are_found(spark):
    filler = "lorem ipsum updated created\n" * 20000
    text = filler.join(["INSERT INTO a.b ", "drop table\n c.d.e ", "x MERGE  INTO `f`.`g`"])
    df = spark.createDataFrame([(1, text)], "id bigint, sql string")
    assert rows(audit.statement_writes(df), "verb", "dest") == [
        ("DROP TABLE", "c.d.e"), ("INSERT INTO", "a.b"), ("MERGE INTO", "f.g")]


def test_write_pattern_agrees_with_another_engine(spark):
    """The same pattern in Python, over texts with accents, odd blanks and words next to verbs."""
    pattern = re.compile(WRITE_STATEMENT.removeprefix("(?iU)"), re.IGNORECASE)
    texts = ["INSERT INTO a.b", "éupdate a.b", "update a.b", "UPDATE_x a.b", "insert into table a.b", "DROP VIEW a.b",
             "CREATE TEMP VIEW a.b", "delete from x", "update {t}", "drop table", "x;UPDATE a.b;DELETE FROM c.d"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sql string")
    expected = [(i, " ".join(v.split()).upper(), d.replace("`", "")) for i, t in enumerate(texts) for v, d in pattern.findall(t)]
    assert rows(audit.statement_writes(df), "i", "verb", "dest") == sorted(expected, key=repr)
