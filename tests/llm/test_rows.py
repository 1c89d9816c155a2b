"""Which rows stay: null ids, an id with several texts, repeated rows, clashing columns; and packing against plain code."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftgate.llm import exact, packing, simhash, toxicity, words
from driftgate.llm.common import prepare

SCHEMA = "doc_id bigint, text string, _dropped string, _row string, keep_id string, text_sha256 string, digest string"


@pytest.fixture(scope="module")
def make(spark):
    prepare(spark)
    return lambda rows: spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)


def test_exact_copies_are_decided_by_row(make):
    rows = [(1, "a"), (2, "a"), (1, "b"), (None, "a"), (None, "x"), (3, None), (4, ""), (5, "c"), (5, "c")]
    found = exact.deduplicate(make(rows))
    assert kept(found) == sorted([(2, "a"), (1, "b"), (None, "x"), (4, ""), (5, "c"), (5, "c")], key=repr)
    assert found.columns == make(rows).columns and found.first()["_dropped"] == "a"
    assert exact.deduplicate(make([])).count() == 0


def test_near_copies_are_decided_by_row(make):
    long = " ".join(f"w{i}" for i in range(300))
    other = " ".join(f"v{i}" for i in range(300))
    rows = [(1, long), (2, long + " w"), (1, other), (None, long), (None, "quite alone here"), (7, None), (8, " ")]
    found = simhash.deduplicate(make(rows))
    assert kept(found) == sorted([(1, long), (1, other), (None, "quite alone here"), (7, None)], key=repr)
    assert found.columns == make(rows).columns
    assert simhash.deduplicate(make([])).count() == 0


def test_toxic_rows_go_and_no_other(spark, make):
    clean, vile = "alpha beta gamma delta river stone cloud " * 3, "alpha beta you vile scum you vile scum "
    rows = [(i, vile if i % 4 == 0 else clean + str(i)) for i in range(200)]
    rows += [(1, vile), (None, vile), (None, clean), (None, None), (500, clean)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id bigint, toxic int")
    found = toxicity.drop_toxic(make(rows), labels)
    assert kept(found) == sorted([r for r in rows if r[1] != vile], key=repr)
    assert found.columns == make(rows).columns
    assert toxicity.drop_toxic(make([]), labels).count() == 0


def test_unit_ids_are_the_librarys():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = words.UnitEncoder(path), Tokenizer.from_file(path)
    assert encoder.units is not None
    odd = [
        "I'M 100% DÉJÀ　vu!", "<|endoftext|> x <|startoftext|>", "ß İ Σς ǅ", "a\x1cb\x85c\xa0d\x00e", "é é", "'S'T' 'll we'Ve",
        "٣٤ ½ ²3", "x" * 5000, "ab​c", "", None, "×÷ µª", "日本語 text",
    ]
    plain = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in odd]
    assert encoder.encode(odd) == plain
    assert encoder.encode(odd) == plain


def test_units_that_come_back_are_not_forgotten(monkeypatch):
    monkeypatch.setattr(words, "REMEMBERED", 3)
    encoder = words.UnitEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"same word{chr(97 + i % 26)}{chr(97 + i // 26)} here" for i in range(60)]
    assert encoder.encode(texts) == [encoder.whole(t) for t in texts]
    assert "same" in encoder.young | encoder.old and len(encoder.young) <= 6 and len(encoder.old) <= 6


def test_checksums_of_packed_pieces(make):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(i, "some words " * n) for i, n in enumerate((0, 1, 50, 3000, 2048))] + [(9, None)]
    texts = dict(rows)
    for r in packing.pack(make(rows), path).collect():
        ids = np.array([*library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, 1], "<u4")
        part = ids[r["start"] : r["start"] + r["length"]]
        assert (len(part), zlib.crc32(part.tobytes())) == (r["length"], r["ids_crc32"])


def plain_best_two_fit(lengths, capacity):
    """One bin at a time, lengths one by one: fill greedily, then swap the smallest for the best two that fit."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        room, held = capacity, []
        for x in list(left):
            if x <= room:
                held.append(x)
                left.remove(x)
                room -= x
        if room:
            smallest = min(held)
            fits = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if a + b <= room + smallest]
            if fits and max(fits)[0] > smallest:
                _, a, b = max(fits)
                held.remove(smallest)
                left.append(smallest)
                for x in (a, b):
                    left.remove(x)
                    held.append(x)
                left.sort(reverse=True)
        bins.append(sorted(held))
    return bins


def test_the_plan_fills_bins_as_plain_best_two_fit_does():
    rng = np.random.default_rng(3)
    for capacity in (10, 37, 100):
        for _ in range(20):
            lengths = rng.integers(1, capacity + 1, size=40).tolist()
            histogram = {int(k): lengths.count(k) for k in set(lengths)}
            plan = packing.best_two_fit(histogram, capacity)
            bins = {}
            for length, first, last, many, start, _ in plan.tolist():
                for rank in range(last - first):
                    bins.setdefault(start + rank // many, []).append(length)
            assert sorted(x for b in bins.values() for x in b) == sorted(lengths)
            assert max(map(sum, bins.values())) <= capacity
            assert len(bins) <= len(plain_best_two_fit(lengths, capacity))
