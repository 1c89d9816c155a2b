"""Stored inventories, their digests, and warnings about incomplete ones."""

import random

import pytest

from driftgate.operators import audit, inventory
from driftgate.plans.lock import lock_gate, stored_lock_gate
from driftgate.session import local_session, shared_folder
from driftgate.sources import store

from .conftest import rows

NAMED = "repo bigint, rev string, name string"


@pytest.fixture
def frame(spark):
    return lambda data, schema=NAMED: spark.createDataFrame(data, schema)


def scope(frame, *repos):
    return frame([(r, "base") for r in repos], "repo bigint, rev string")


def test_a_part_is_replaced_and_the_rest_stays(spark, frame, tmp_path):
    path = str(tmp_path / "s")
    store.publish(frame([(1, "base", "a"), (1, "base", "a"), (2, "base", "b"), (3, "base", "z")]), scope(frame, 1, 2), path)
    assert rows(store.stored_names(spark, path)) == [(1, "base", "a"), (2, "base", "b")]
    store.publish(frame([(1, "base", "c"), (1, "base", "d")]), scope(frame, 1), path)
    assert rows(store.stored_names(spark, path)) == [(1, "base", "c"), (1, "base", "d"), (2, "base", "b")]
    store.publish(frame([]), scope(frame, 2, 4), path)
    assert rows(store.stored_names(spark, path)) == [(1, "base", "c"), (1, "base", "d")]
    assert rows(store.manifest(spark, path), "repo", "n_names") == [(1, 2), (2, 0), (4, 0)]
    assert rows(store.stored_names(spark, path, frame([(2,), (9,)], "repo bigint"))) == []


def test_names_without_a_manifest_row_do_not_count(spark, frame, tmp_path):
    path = str(tmp_path / "s")
    store.publish(frame([(1, "base", "a")]), scope(frame, 1), path)
    frame([(1, "base", "lost")]).write.parquet(f"{path}/names/version=died")
    assert rows(store.stored_names(spark, path)) == [(1, "base", "a")]


def test_digests_tell_sets_of_names_apart_and_nothing_else(frame):
    rng = random.Random(8)
    sets = [frozenset(rng.sample("abcdef", rng.randint(0, 6))) for _ in range(60)]
    data = [(i, "base", n) for i, names in enumerate(sets) for n in names for _ in range(rng.randint(1, 3))]
    rng.shuffle(data)
    known = frame([(i, "base") for i in range(60)], "repo bigint, rev string")
    found = {r["repo"]: (r["n_names"], r["digest"]) for r in store.digests(frame(data).repartition(5), known).collect()}
    for i in range(60):
        assert found[i][0] == len(sets[i])
        for j in range(60):
            assert (found[i] == found[j]) == (sets[i] == sets[j])


def test_the_gate_on_stored_inventories_agrees_with_the_gate_on_names(spark, frame, tmp_path):
    rng = random.Random(6)
    repos = frame([(r,) for r in range(12)], "repo bigint")
    base = [(r, "base", n) for r in range(9) for n in rng.sample("abcd", rng.randint(0, 4))]
    head = [(r, "head", n) for r in range(12) for n in rng.sample("abcd", rng.randint(0, 4))] + [(0, "head", n) for _, _, n in base[:1]]
    head = [h for h in head if h[0] > 2] + [(r, "head", n) for r, _, n in base if r <= 2]
    listed = scope(frame, *range(9))
    path = str(tmp_path / "s")
    store.publish(frame(base), listed, path)
    wanted = lock_gate(repos, listed, frame(base + head))
    assert rows(stored_lock_gate(repos, frame(head), path)) == rows(wanted)
    assert {"absent", "outdated", "up to date"} == {r["status"] for r in wanted.collect()}


def test_incomplete_files_are_loaded_at_head_and_have_no_provider(frame):
    call = "repo bigint, rev string, path string, receiver string, method string, arg_source string, name_literal string, is_dynamic boolean"
    made = lambda repo, rev, path, dynamic: (repo, rev, path, "dlt", "table", "keyword", None if dynamic else "t", dynamic)
    calls = frame([made(1, "head", "p", True), made(1, "head", "q", False), made(1, "head", "unloaded", True), made(1, "base", "old", True),
                   made(2, "head", "p", True), made(3, "head", "p", True), made(3, "head", "p", True)], call)
    files = frame([(r, "head", p) for r in (1, 2, 3) for p in ("p", "q", "p")] + [(1, "base", "old")], "repo bigint, rev string, path string")
    providers = frame([(2,), (2,)], "repo bigint")
    found = inventory.incomplete_files(files, calls, providers)
    assert rows(found) == [(1, "p"), (3, "p")]
    repos, none = frame([(1,), (2,), (3,)], "repo bigint"), frame([])
    gate = lock_gate(repos, scope(frame, 1, 2, 3), none, incomplete=found)
    assert rows(gate, "repo", "n_incomplete", "status") == [(1, 1, "up to date"), (2, 0, "up to date"), (3, 1, "up to date")]


def test_only_a_positional_literal_is_a_known_destination(frame):
    schema = "repo int, method string, arg_source string, name_literal string, is_dynamic boolean"
    calls = frame([(1, "saveAsTable", s, "a.b", False) for s in ("positional", "keyword", None)] + [(1, "insertInto", "positional", None, True)], schema)
    assert [r["dynamic"] for r in audit.writer_calls(calls).collect()] == [False, True, True, True]
    assert [r["dynamic"] for r in audit.writer_calls(calls.drop("arg_source")).collect()] == [False, False, False, True]


def test_a_null_that_was_written_is_not_the_default(frame):
    files = frame([(1, "h", "p", None, False, None, True), (2, "h", "p", None, True, "s", True)],
                  "repo int, rev string, path string, catalog_ref string, catalog_given boolean, schema_ref string, schema_given boolean")
    calls = frame([("p", "dlt", "table", "keyword", "t", False)],
                  "path string, receiver string, method string, arg_source string, name_literal string, is_dynamic boolean")
    found = inventory.declared_inventory(files, calls, on=("path",))
    assert rows(found, "name") == [("None.s.t",), ("{catalog}.None.t",)]


def test_a_cluster_without_a_shared_folder_fails(spark, monkeypatch):
    class Cluster:
        master = "spark://host:7077"

    class Session:
        sparkContext = Cluster()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
    assert local_session and shared_folder(spark) == shared_folder(spark)
