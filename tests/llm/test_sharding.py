"""Resharding: the least bytes moved, sizes against the law, and a rewrite from end to end."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from driftgate.llm import sharding
from driftgate.llm.common import prepare

SCHEMA = "doc_id bigint, text string, old int, shard int, slot string, size string"


@pytest.fixture(scope="module")
def make(spark):
    prepare(spark)
    return lambda rows: spark.createDataFrame([(i, t, o, 7, "s", "z") for i, t, o in rows], SCHEMA)


def least_moved(supply, capacity):
    """Every byte that can stay may stay, so what moves is what is too much."""
    return sum(max(0, s - (capacity[i] if i < len(capacity) else 0)) for i, s in enumerate(supply))


def test_the_flow_moves_the_fewest_bytes():
    rng = random.Random(1)
    for _ in range(200):
        supply = [rng.randint(0, 9) for _ in range(rng.randint(1, 5))]
        new = rng.randint(1, 5)
        capacity = sharding.scaled([rng.randint(0, 5) for _ in range(new)], sum(supply))
        assert sum(capacity) == sum(supply)
        flow = sharding.min_cost_flow(supply, capacity)
        assert [sum(n for (i, _), n in flow.items() if i == k) for k in range(len(supply))] == supply
        assert [sum(n for (_, j), n in flow.items() if j == k) for k in range(new)] == capacity
        assert sum(n for (i, j), n in flow.items() if i != j) == least_moved(supply, capacity)


@pytest.mark.parametrize(("old", "new"), [(4, 4), (4, 2), (2, 5), (1, 1), (3, 1)])
def test_every_document_has_one_place_and_sizes_follow_the_law(make, old, new):
    rng = random.Random(old * 10 + new)
    rows = [(i, "x" * rng.randint(0, 40), rng.randrange(old)) for i in range(400)] + [(None, None, 0), (5, "x" * 9, 0)]
    placed = sharding.reshard(make(rows), F.col("old"), new).collect()
    assert len(placed) == len(rows) and {r["shard"] for r in placed} <= set(range(new))
    for _, group in itertools.groupby(sorted(placed, key=lambda r: r["shard"]), key=lambda r: r["shard"]):
        slots = sorted(r["slot"] for r in group)
        assert slots == list(range(len(slots)))
    sizes = [sum(r["size"] for r in placed if r["shard"] == k) for k in range(new)]
    total = sum(len(t or "") + 8 for _, t, _ in rows)
    assert sum(sizes) == total and max(abs(s - total / new) for s in sizes) <= 48 * (old + 1)
    assert old != new or sum(r["size"] for r in placed if r["shard"] != r["old_shard"]) <= total / 4


def test_shares_may_differ_and_may_be_none(make):
    rows = [(i, "x" * 12, i % 2) for i in range(300)]
    placed = sharding.reshard(make(rows), F.col("old"), capacity=[3, 0, 1]).collect()
    counts = [sum(r["shard"] == k for r in placed) for k in range(3)]
    assert counts[1] == 0 and abs(counts[0] - 225) <= 2 and sum(counts) == 300


@pytest.mark.parametrize("new", [2, 5])
def test_a_rewrite_keeps_every_document_once(spark, make, tmp_path, new):
    rng = random.Random(new)
    docs = make([(i, "y" * rng.randint(1, 30), i % 4) for i in range(200)])
    folder = str(tmp_path / "shards")
    docs.withColumn("shard", F.col("old")).write.partitionBy("shard").parquet(folder)
    placed = sharding.reshard(docs, F.col("old"), new)
    sharding.rewrite(docs, placed, folder)
    again = spark.read.parquet(folder)
    assert sorted(r["doc_id"] for r in again.collect()) == list(range(200))
    place = {r["doc_id"]: r["shard"] for r in placed.collect()}
    assert {r["doc_id"]: r["shard"] for r in again.collect()} == place
    assert {int(p.name.split("=")[1]) for p in (tmp_path / "shards").glob("shard=*")} == set(place.values())


def test_a_rewrite_without_unique_ids_fails(make, tmp_path):
    for rows in ([(1, "a", 0), (1, "b", 1)], [(None, "a", 0), (2, "b", 1)]):
        docs = make(rows)
        with pytest.raises(ValueError, match="unique"):
            sharding.rewrite(docs, sharding.reshard(docs, F.col("old"), 2), str(tmp_path / "no"))
