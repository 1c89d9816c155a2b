import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftgate.functions import names
from driftgate.functions.text import ESCAPE, MARK, escaped, strip, unescaped

from .conftest import rows


def values(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("ref", "expected"),
    [
        ("${var.catalog_silver}", "{catalog_silver}"),
        ("${bundle.target}", "{bundle.target}"),
        ("  ${catalog}  ", "{catalog}"),
        ("main", "main"),
        (" main ", "main"),
        ("${var.a}_x", "${var.a}_x"),
        ("${var.a}_${var.b}", "{a}_${var.b}"),
        ("${}", "{}"),
        ("${var.}", "{}"),
        ("", ""),
        (None, "{catalog}"),
    ],
)
def test_reference_to_a_variable(spark, ref, expected):
    assert values(spark, [ref], lambda c: names.normalise_ref(c, "{catalog}")) == [expected]


def test_key_written_as_null_is_the_text_none(spark):
    df = spark.createDataFrame([(None, True), (None, False), ("x", True)], "ref string, present boolean")
    name = names.normalise_ref(F.col("ref"), "default", F.col("present"))
    assert rows(df.select(name)) == [("None",), ("default",), ("x",)]


def test_schema_of_name_needs_three_parts(spark):
    texts = ["c.s.t", "s.t", "t", "a.b.c.d", "a..t", "..", "", "{c}.s_old.t"]
    expected = [t.split(".")[1] if t.count(".") == 2 else None for t in texts]
    assert values(spark, texts, names.schema_of_name) == expected
    assert values(spark, texts, names.name_parts) == [t.count(".") + 1 for t in texts]


def expected_schema(destination):
    """The rule in words: drop backticks, braces hide it, empty parts do not count."""
    cleaned = destination.strip().replace("`", "")
    if set("{}") & set(cleaned):
        return None
    parts = [p for p in cleaned.split(".") if p]
    return None if len(parts) < 2 else parts[0] if len(parts) == 2 else parts[1]


def test_schema_of_destination(spark):
    texts = ["t", "s.t", "c.s.t", "a.b.c.d", "`s`.`t`", "{c}.s.t", "s.{t}", "s..t", ".s.t", "s.t.", "s.", "", "."]
    assert values(spark, texts, names.schema_of_destination) == [expected_schema(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab.`{} ", max_size=9), min_size=200, max_size=400))
def test_schema_of_any_destination(spark, texts):
    assert values(spark, texts, names.schema_of_destination) == [expected_schema(t) for t in texts]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="a\t\n\x0b\x1c\x85\xa0 　 ", max_size=6), min_size=100, max_size=200))
def test_strip_removes_every_kind_of_blank(spark, texts):
    assert values(spark, texts, strip) == [t.strip() for t in texts]


def test_escaped_text_holds_no_mark_and_comes_back(spark):
    parts = ["a", MARK, ESCAPE, "\x03", "\x04", ESCAPE + "\x04", "é"]
    texts = ["".join(parts[(i * 5 + j * i) % len(parts)] for j in range(6)) for i in range(60)]
    hidden = values(spark, texts, escaped)
    assert not any(MARK in t for t in hidden)
    assert values(spark, hidden, unescaped) == texts
