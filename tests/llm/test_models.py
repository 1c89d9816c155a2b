"""The random field against an enumeration of all taggings, and sketches against plain sets of hashes."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgate.llm import sketch, toxicity
from driftgate.llm.common import prepare


def enumerated(scores, moves):
    """Marginals of tag 1 by summing over every sequence of tags."""
    total, hits = 0.0, np.zeros(len(scores))
    for tags in itertools.product((0, 1), repeat=len(scores)):
        weight = np.exp(sum(s for s, t in zip(scores, tags) if t) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
        total += weight
        hits += weight * np.array(tags)
    return hits / total


def test_marginals_agree_with_an_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(40):
        lengths = rng.integers(1, 9, size=3)
        moves = rng.normal(size=(2, 2))
        scores = rng.normal(size=lengths.sum()) * 2
        found = toxicity.forward_backward(scores, lengths, moves)[0]
        ends = np.cumsum(lengths)
        plain = np.concatenate([enumerated(scores[e - n : e], moves) for e, n in zip(ends, lengths)])
        assert np.abs(found - plain).max() < 1e-9


def test_stretches_without_evidence_are_not_walked_and_come_out_the_same():
    rng = np.random.default_rng(2)
    moves = np.array([[0.3, -1.2], [-0.8, 1.1]])
    scores = np.full(3000, -2.0)
    scores[rng.integers(0, 3000, size=9)] = 3.0
    lengths = np.array([1, 1400, 1599])
    found = toxicity.marginals(scores, lengths, moves, -2.0)
    assert np.abs(found - toxicity.forward_backward(scores, lengths, moves)[0]).max() < 1e-9


SCHEMA = "doc_id bigint, text string, sketch string, bucket string, _words string"


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choices(words, k=n)) for n in (0, 1, 4, 5, 6, 40, 40, 400, 400, 2000)]
    texts += [texts[-1] + " tail of it", texts[-2].upper(), None, " \t", texts[5]]
    return spark.createDataFrame([(i, t, "s", "b", "w") for i, t in enumerate(texts)], SCHEMA)


def hashes(spark, docs):
    """Every shingle's hash by Spark's own function over single words, gathered per document in Python."""
    out = {}
    for r in docs.select("doc_id", "text").collect():
        text = (r["text"] or "").strip(" \t\n\r\x0b\x0c").lower()
        words = text.split() if text else []
        shingles = [words[i : i + sketch.WORDS] for i in range(max(1, len(words) - sketch.WORDS + 1))] if words else []
        out[r["doc_id"]] = (len(words) >= sketch.WORDS, shingles)
    every = sorted({w for _, ss in out.values() for s in ss for w in s})
    frame = spark.createDataFrame([(w,) for w in every] or [("",)], "w string").select("w", F.xxhash64("w").alias("h"))
    known = {r["w"]: r["h"] for r in frame.collect()}
    rows = [(i, full, [known[w] for w in s]) for i, (full, ss) in out.items() for s in ss]
    table = spark.createDataFrame(rows, "i bigint, full boolean, h array<bigint>")
    joined = F.xxhash64(*[F.get("h", F.lit(k)) for k in range(sketch.WORDS)])
    whole = table.select("i", F.shiftrightunsigned(F.when(F.col("full"), joined).otherwise(F.xxhash64("h")), 32).alias("v"))
    found = {i: set() for i in out}
    for r in whole.collect():
        found[r["i"]].add(r["v"])
    return found


def test_sketches_hold_every_hash_below_the_limit(spark, docs):
    plain = hashes(spark, docs)
    found = {r["doc_id"]: r["s"] for r in sketch.with_sketch(docs.drop("sketch", "_words"), "text", "s").collect() if r["text"] is not None}
    for i, kept in found.items():
        low = sorted(h for h in plain[i] if h < sketch.LIMIT)
        assert kept == (low or sorted(plain[i])[:1])


def test_sketches_of_documents_together_are_merged_sketches(spark, docs):
    found = {r["doc_id"]: r["s"] for r in sketch.with_sketch(docs.drop("sketch", "_words"), "text", "s").collect()}
    pairs = spark.createDataFrame([(found[7], found[8]), (found[9], found[10]), (found[0], found[5])], "a array<bigint>, b array<bigint>")
    for r in pairs.select("a", "b", sketch.merged(F.col("a"), F.col("b")).alias("m"), sketch.containment(F.col("a"), F.col("b")).alias("c")).collect():
        both = set(r["a"]) | set(r["b"])
        assert set(r["m"]) == ({h for h in both if h < sketch.LIMIT} or set(sorted(both)[:1]))
        assert r["c"] == (len(set(r["a"]) & set(r["b"])) / len(r["a"]) if r["a"] else 1.0)


def test_a_part_is_contained_in_a_whole_of_another_size(spark, docs):
    rows = sketch.fingerprint_report(docs).collect()
    for r in rows:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[10]["near_next"] >= 0.95  # a document and the same with a tail
    assert by_id[11]["fingerprint"] == by_id[8]["fingerprint"] and by_id[14]["fingerprint"] == by_id[5]["fingerprint"]
