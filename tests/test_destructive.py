"""The gate for destructive changes against a model in plain Python, over many generated harbours at once."""

import random

import pytest
from pyspark.sql import functions as F

from driftgate import model
from driftgate.model import DESTROY_LABEL, INACTIVE_LABEL
from driftgate.operators import diff, gate
from driftgate.plans.destructive import destructive_gate, resource_findings, table_findings

from .conftest import rows

HARBOURS = 150
SHIPS = ["port.quay.barge", "port.quay.tug", "port.dock.ferry", "sea.open.yacht"]
VALUES = [None, "red", "blue", '"red"']


def generated():
    """For each harbour: names and resources by revision, what can be read and is listed, retirements, labels."""
    rng = random.Random(11)
    some = lambda items: [x for x in items if rng.random() < 0.6]
    out = {}
    for repo in range(HARBOURS):
        listed = {rev for rev in ("base", "head") if rng.random() < 0.85}
        resources = {
            rev: [
                (rng.choice(["pipelines", "jobs"]), rng.choice("xyz"), {f: rng.choice(VALUES) for f in model.RECREATE_FIELDS if rng.random() < 0.2})
                for _ in range(rng.randint(0, 4))
            ]
            for rev in ("base", "head")
        }
        if rng.random() < 0.3:
            resources["head"] = list(resources["base"])
        names = {rev: set(some(SHIPS)) if rev in listed else set() for rev in ("base", "head")}
        if rng.random() < 0.3:
            names["head"] |= names["base"] if "head" in listed else set()
        out[repo] = {
            "names": names, "resources": resources, "listed": listed, "readable": rng.random() < 0.9,
            "retired": {n: f"sold {n[-3:]}" for n in SHIPS if rng.random() < 0.3},
            "labels": {x for x in (DESTROY_LABEL, INACTIVE_LABEL, "other") if rng.random() < 0.5},
        }
    return out


def plain_findings(h):
    found = []
    if "head" in h["listed"]:
        for name in h["names"]["base"] - h["names"]["head"]:
            retired = name in h["retired"]
            found.append(("DESTRUCTIVE" if retired else "ORPHAN", name))
    else:
        found.append(("NOTICE", "no inventory at head"))
    last = {rev: {(kind, key): fields for kind, key, fields in listed} for rev, listed in h["resources"].items()}
    for (kind, key), fields in last["base"].items():
        after = last["head"].get((kind, key))
        if after is None:
            found.append(("DESTRUCTIVE" if kind == "pipelines" else "NOTICE", key))
        elif kind == "pipelines":
            found += [("DESTRUCTIVE", f"{key}.{f}") for f in model.RECREATE_FIELDS if fields.get(f) != after.get(f)]
    return sorted(found)


def plain_verdict(h, mode):
    kinds = {severity for severity, _ in plain_findings(h)}
    if not h["readable"]:
        return "error", None, None, None, None, 2
    destructive, orphaned = "DESTRUCTIVE" in kinds, "ORPHAN" in kinds
    lacks = destructive and DESTROY_LABEL not in h["labels"], orphaned and INACTIVE_LABEL not in h["labels"]
    status = "clean" if not kinds else "blocked" if any(lacks) and mode == "pr" else "accepted"
    return status, destructive, orphaned, *lacks, int(status == "blocked")


@pytest.fixture(scope="module")
def harbours():
    return generated()


@pytest.fixture(scope="module")
def found(spark, harbours):
    frame = spark.createDataFrame
    named = [(r, rev, n) for r, h in harbours.items() for rev, names in h["names"].items() for n in names]
    resources = [
        (r, rev, kind, key, i, *[fields.get(f) for f in model.RECREATE_FIELDS])
        for r, h in harbours.items() for rev, listed in h["resources"].items() for i, (kind, key, fields) in enumerate(listed)
    ]
    tables = table_findings(
        frame([(r,) for r in harbours], "repo bigint"),
        frame(named, model.NAMED_SCHEMA),
        frame([(r, rev) for r, h in harbours.items() for rev in h["listed"]], "repo bigint, rev string"),
        frame([(r, n, why) for r, h in harbours.items() for n, why in h["retired"].items()], model.RETIRED_SCHEMA),
    )
    return resource_findings(frame(resources, model.RESOURCES_SCHEMA)).unionByName(tables)


def test_findings_are_those_of_the_model(harbours, found):
    expected = sorted((r, *f) for r, h in harbours.items() for f in plain_findings(h))
    assert len({f[1] for f in expected}) == 3
    assert sorted(tuple(r) for r in found.select("repo", "severity", "item").collect()) == expected


def test_every_finding_says_what_to_do_unless_it_only_informs(found):
    for row in found.collect():
        assert row["detail"] and (row["remedy"] or row["severity"] == "NOTICE")


def test_reasons_of_retirements_are_the_detail(harbours, found):
    for row in found.filter("kind = 'table retired'").collect():
        assert row["detail"] == harbours[row["repo"]]["retired"][row["item"]]


@pytest.mark.parametrize("mode", ["pr", "report"])
def test_verdicts_are_those_of_the_model(spark, harbours, found, mode):
    frame = spark.createDataFrame
    labels = frame([(r, " , ".join([*sorted(h["labels"]), ""])) for r, h in harbours.items()], model.LABELS_SCHEMA)
    seen = frame([(r, rev) for r, h in harbours.items() for rev in ("base", "head") if rev == "head" or h["readable"]], "repo bigint, rev string")
    verdicts = destructive_gate(frame([(r,) for r in harbours], "repo bigint"), seen, found, gate.label_set(labels), mode)
    columns = ("repo", "status", "destructive", "orphaned", "needs_destroy", "needs_inactive", "exit_code")
    result = {r[0]: tuple(r)[1:] for r in verdicts.select(*columns).collect()}
    expected = {r: plain_verdict(h, mode) for r, h in harbours.items()}
    assert result == expected
    assert {v[0] for v in expected.values()} == ({"error", "clean", "accepted", "blocked"} if mode == "pr" else {"error", "clean", "accepted"})


def test_unknown_mode_fails(spark):
    none = spark.createDataFrame([], "repo bigint, severity string, label string")
    with pytest.raises(ValueError, match="mode"):
        gate.gate_decision(none, none, "other")


def test_a_repeated_retirement_does_not_repeat_the_finding(spark):
    removed = spark.createDataFrame([(1, "a")], "repo bigint, name string")
    retired = spark.createDataFrame([(1, "a", "r1"), (1, "a", "r2")], model.RETIRED_SCHEMA)
    assert rows(diff.removed_classified(removed, retired)) == [(1, "a", "DESTRUCTIVE", "r2")]


def test_flags_are_texts(spark):
    decided = spark.createDataFrame([(1, True, False)], "repo bigint, destructive boolean, orphaned boolean")
    known = spark.createDataFrame([(1,), (2,)], "repo bigint")
    assert rows(gate.flags(known, decided)) == [(1, "true", "false"), (2, "false", "false")]


def test_guard_knows_repositories_that_left_no_row(spark):
    repos = spark.createDataFrame([(1,), (2,), (3,)], "repo bigint")
    seen = spark.createDataFrame([(1, "base"), (1, "head"), (2, "head")], "repo bigint, rev string")
    assert rows(diff.revision_guard(repos, seen)) == [
        (1, True, True, "ok"), (2, False, True, "unresolved"), (3, False, False, "unresolved")]


def test_report_lines_are_ordered_and_name_the_labels(spark):
    repos = spark.createDataFrame([(1,), (2,)], "repo bigint")
    findings = spark.createDataFrame(
        [(1, "NOTICE", "z", None), (1, "ORPHAN", "b", "inactive"), (1, "ORPHAN", "a", None), (1, "DESTRUCTIVE", "c", "x")],
        "repo bigint, severity string, item string, detail string")
    labels = spark.createDataFrame([(1, DESTROY_LABEL)], "repo bigint, label string")
    report = gate.report_lines(repos, findings, labels).orderBy("repo", "section", "item")
    assert [r["line"] for r in report.filter("repo = 1").collect()] == [
        "c: x", "a", "b: inactive", "z", f"label {DESTROY_LABEL}: granted", f"label {INACTIVE_LABEL}: missing"]
    assert report.filter("repo = 2").count() == 1
    plain = gate.report_lines(repos, findings, labels, mode="report")
    assert plain.filter(F.col("section") == gate.UNLOCK_SECTION).count() == 0


def test_report_pages_keep_every_item_in_order(spark):
    items = [f"t{n:05d}" for n in range(2500)]
    findings = spark.createDataFrame(
        [(1, "ORPHAN", t) for t in items] + [(2, "ORPHAN", "x"), (1, "NOTICE", "n")],
        "repo bigint, severity string, item string").repartition(7)
    pages = gate.finding_report(findings, page_lines=100).orderBy("repo", "section", "page").collect()
    big = [p for p in pages if (p["repo"], p["severity"]) == (1, "ORPHAN")]
    assert [p["page"] for p in big] == list(range(25))
    assert "\n".join(p["detail"] for p in big).split("\n") == items
    assert {(p["repo"], p["severity"], p["page"], p["detail"]) for p in pages} >= {(2, "ORPHAN", 0, "x"), (1, "NOTICE", 0, "n")}
