"""Pairs of revisions against sets in Python."""

import random

from driftgate.operators import gate, revisions
from driftgate.plans.destructive import pair_gate

from .conftest import rows

NAMED = "repo int, rev string, name string"
PAIRS = "repo int, base_rev string, head_rev string"
RESOURCES = (
    "repo int, rev string, kind string, key int, file_order int, catalog string, schema string, target string, storage string, "
    "serverless string"
)


def test_removed_names_and_drift_of_every_pair(spark):
    rng = random.Random(4)
    named = [(rng.randint(1, 4), f"r{rng.randint(1, 5)}", f"n{rng.randint(1, 9)}") for _ in range(160)]
    pairs = [(r, f"r{a}", f"r{b}") for r in range(1, 6) for a in range(1, 6) for b in range(1, 7) if rng.random() < 0.6]
    held = {}
    for repo, rev, name in named:
        held.setdefault((repo, rev), set()).add(name)
    of = lambda repo, rev: held.get((repo, rev), set())
    names = spark.createDataFrame(named, NAMED)
    both = spark.createDataFrame(pairs + pairs[:7], PAIRS)
    gone = {(r, a, b, n) for r, a, b in pairs for n in of(r, a) - of(r, b)}
    assert gone and set(rows(revisions.pair_removed(names, both))) == gone
    drift = {(r, a, b, n, "extra" if n in of(r, a) else "missing") for r, a, b in pairs for n in of(r, a) ^ of(r, b)}
    found = rows(revisions.pair_drift(names, both))
    assert set(found) == drift and len(found) == len(drift)


def test_a_revision_compared_with_itself_has_no_drift(spark):
    named = spark.createDataFrame([(1, "a", "n"), (1, "a", "m")], NAMED)
    assert revisions.pair_drift(named, spark.createDataFrame([(1, "a", "a")], PAIRS)).count() == 0


def test_one_aggregate_for_all_pairs(spark, plan):
    named = spark.createDataFrame([(1, "a", "n"), (1, "b", "m"), (1, "c", "n")], NAMED)
    pairs = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "a", "c")], PAIRS)
    found = revisions.pair_removed(named, pairs)
    planned = plan(found)
    assert planned.count("Join") == 1 and planned.count("HashAggregate(keys=[repo") == 4  # distinct pairs, and the diff
    assert rows(found) == [(1, "a", "b", "n"), (1, "b", "c", "m")]


def test_bases_that_cannot_be_read_and_bases_without_an_inventory_differ(spark):
    frame = spark.createDataFrame
    pairs = frame([(1, "old", "new"), (1, "lost", "new"), (2, "old", "new"), (3, "old", "new"), (4, "old", "new")], PAIRS)
    read = frame([(r, v) for r in (1, 2, 3, 4) for v in ("old", "new")], "repo int, rev string")
    listed = frame([(1, "old"), (1, "new"), (2, "new"), (3, "old"), (4, "old"), (4, "new")], "repo int, rev string")
    guard = revisions.pair_guard(pairs, read, listed)
    status = {(r[0], r[1]): r[2] for r in rows(guard, "repo", "base_rev", "status")}
    assert status == {
        (1, "old"): "ok", (1, "lost"): "unresolved", (2, "old"): "no inventory at base", (3, "old"): "no inventory at head", (4, "old"): "ok",
    }
    named = frame([(1, "old", "c.s.a"), (1, "new", "c.s.b"), (2, "new", "c.s.a"), (3, "old", "c.s.a"), (4, "old", "c.s.k"), (4, "new", "c.s.k")], NAMED)
    retired = frame([], "repo int, name string, reason string")
    resources = frame([(2, "old", "jobs", 7, 1, "a", "b", None, None, None), (4, "old", "pipelines", 8, 1, "a", "b", None, None, None)], RESOURCES)
    labels = gate.label_set(frame([(1, "keep")], "repo int, labels_csv string"))
    verdicts = pair_gate(pairs, read, listed, named, retired, resources, labels, inactive_label="keep")
    found = {(r["repo"], r["base_rev"]): r for r in verdicts.collect()}
    wanted = {(1, "old"): "accepted", (1, "lost"): "error", (2, "old"): "accepted", (3, "old"): "accepted", (4, "old"): "blocked"}
    assert {k: r["status"] for k, r in found.items()} == wanted
    assert found[1, "lost"]["destructive"] is None and found[1, "lost"]["exit_code"] == 2 and found[4, "old"]["exit_code"] == 1
    assert (found[2, "old"]["base_listed"], found[2, "old"]["n_findings"]) == (False, 1)


def test_a_clean_repository_has_both_flags_and_a_finding_without_item_is_a_line(spark):
    repos = spark.createDataFrame([(1,), (2,)], "repo int")
    found = spark.createDataFrame(
        [(1, "ORPHAN", None, "why"), (1, "ORPHAN", "t", None), (1, "ORPHAN", "t", None)], "repo int, severity string, item string, detail string"
    )
    decided = gate.gate_decision(found, spark.createDataFrame([], "repo int, label string"))
    assert rows(gate.flags(repos, decided)) == [(1, "false", "true"), (2, "false", "false")]
    pages = gate.finding_report(found, page_lines=2).orderBy("page").collect()
    assert [(p["total"], p["detail"]) for p in pages] == [(3, ": why\nt"), (3, "t")]
