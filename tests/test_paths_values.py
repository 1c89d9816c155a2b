"""Paths and typed values against plain Python."""

import itertools
import json
import posixpath

import pytest
from pyspark.sql import functions as F

from driftgate.functions.paths import resolved_path
from driftgate.functions.values import canonical_value
from driftgate.operators import diff
from driftgate.sources.inventory import files_outside, resolved_files

from .conftest import rows

SEGMENTS = ("..", ".", "", "a", "b.py", "...")


def plain(declaring, path):
    """The path from the top of the repository, or None where it leaves it on the way."""
    if declaring is None or path is None or path.startswith("/"):
        return None
    at = []
    for part in [*posixpath.dirname(declaring).split("/"), *path.split("/")]:
        if part == ".." and not at:
            return None
        at = at[:-1] if part == ".." else at + [part] * (part not in ("", "."))
    return "/".join(at) or None


def test_paths_agree_with_a_stack_in_python(spark):
    paths = ["/".join(p) for n in (1, 2, 3, 4) for p in itertools.product(SEGMENTS, repeat=n)] + [None]
    cases = [(d, p) for d in ("r/x.yml", "x.yml", "r/s/x.yml", None) for p in paths]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, declared string, path string")
    found = dict(rows(df.select("i", resolved_path(F.col("declared"), F.col("path")))))
    assert found == {i: plain(*c) for i, c in enumerate(cases)}
    assert any(found.values()) and None in found.values()


def test_a_resolved_path_is_the_normal_one(spark):
    df = spark.createDataFrame([("r/x.yml", "../p/a.py"), ("x.yml", "p//a.py"), ("r/s/x.yml", "./../../p/./a.py")], "d string, p string")
    assert rows(df.select(resolved_path(F.col("d"), F.col("p")))) == [(posixpath.normpath("p/a.py"),)] * 3


def test_files_outside_are_kept_apart_and_none_is_lost(spark):
    data = [(1, "r/x.yml", "../a.py"), (1, "r/x.yml", "../../a.py"), (2, "x.yml", "/a.py"), (2, "x.yml", None), (3, "x.yml", "a/..")]
    df = spark.createDataFrame(data, "repo int, declared_in string, path string")
    assert rows(resolved_files(df)) == [(1, "r/x.yml", "a.py")]
    assert rows(files_outside(df), "repo", "written") == [(1, "../../a.py"), (2, "/a.py"), (3, "a/..")]


VALUES = [
    "1", "1.0", "1.00", "1e0", '"1"', '"1.0"', "true", '"true"', "false", "0", "null", None, "[1, 2]", "[2, 1]", "[1.0,2]", "{}", "[]",
    '{"a": 1, "b": [true]}', '{"b":[true],"a":1.0}', '{"a": 1, "b": [1]}', '"x \\" 2.0"', '"x \\" 2"', "100", "1e2", "0.10", "0.1",
    '{"a": {"c": 1.0, "b": "1.0"}}', '{"a": {"b": "1.0", "c": 1}}', '{"a": {"b": "1", "c": 1}}',
]


def typed(value):
    """Equal exactly for values that count as equal."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return type(value).__name__, value
    if isinstance(value, dict):
        return "dict", tuple(sorted((k, typed(v)) for k, v in value.items()))
    if isinstance(value, list):
        return "list", tuple(map(typed, value))
    return "number", float(value)


def test_values_are_equal_by_type_and_value(spark):
    df = spark.createDataFrame(list(enumerate(VALUES)), "i int, v string")
    spelled = dict(rows(df.select("i", canonical_value(F.col("v")))))
    for (i, a), (j, b) in itertools.combinations(enumerate(VALUES), 2):
        same = typed(json.loads(a or "null")) == typed(json.loads(b or "null"))
        assert (spelled[i] == spelled[j]) == same, (a, b, spelled[i], spelled[j])


def test_text_that_is_not_json_fails(spark):
    with pytest.raises(Exception, match="(?i)json|malformed"):
        spark.createDataFrame([("{oops",)], "v string").select(canonical_value(F.col("v"))).collect()


def test_only_changes_of_type_or_value_recreate(spark):
    fields = "catalog string, schema string, target string, storage string, serverless string"
    data = [("base", 1, 1, "1", None, '{"a":1,"b":2}', "1", "true"), ("head", 1, 1, "1.0", "null", '{"b": 2, "a": 1.0}', '"1"', "1")]
    df = spark.createDataFrame(data, f"rev string, key int, file_order int, {fields}")
    found = diff.recreate_fields(df, keys=("key",), typed=True)
    assert rows(found, "field", "old_value", "new_value") == [("serverless", "true", "1"), ("storage", "1", '"1"')]
    assert diff.recreate_fields(df, keys=("key",)).count() == 5
