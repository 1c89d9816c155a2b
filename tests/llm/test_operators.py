"""Operators on training text against brute force, and on nulls, empty texts, repeated rows and empty tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from driftgate.llm import counts, exact, licenses, packing, sentencepieces, sharding, simhash, sketch, toxicity, wrappers
from driftgate.llm.common import prepare

SCHEMA = "doc_id bigint, source string, text string, keep_id string"


def fixture_rows():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 6))) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60))) for _ in range(40)]
    texts += texts[:10] + [t + " x" for t in texts[:10]]
    texts += [None, "", " \t\n", "Under the MIT license. CC BY-NC", "I'm  100% déjà　vu!\n\n  ok", "word " * 9000]
    return [(i, "hot" if i % 3 else "cold", t, None) for i, t in enumerate(texts)]


ROWS = fixture_rows()


@pytest.fixture(scope="module")
def docs(spark):
    prepare(spark)
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact_groups(docs, empty):
    groups = {}
    for i, _, text, _ in ROWS:
        groups.setdefault(text or "", []).append(i)
    found = by_id(exact.exact_groups(docs))
    assert len(found) == len(ROWS)
    for i, _, text, _ in ROWS:
        copies = groups[text or ""]
        row = found[i]
        assert (row["keep_id"], row["group_size"], row["kept"]) == (max(copies), len(copies), i == max(copies))
        assert row["text_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact.exact_groups(empty).count() == 0


def brute_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("chunk", [4, 2048])
def test_simhash_groups(docs, empty, chunk):
    prints = {i: brute_simhash(t) for i, _, t, _ in ROWS}
    label = {i: i for i in prints}
    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    found = by_id(simhash.near_groups(docs, chunk))
    assert {i: r["fingerprint"] for i, r in found.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in found.items()} == label
    assert simhash.near_groups(empty).count() == 0


def test_token_counts(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    found = by_id(counts.count_tokens(docs, path))
    for i, _, text, _ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len((text or "").encode()), n, n > 1024)
    assert counts.count_tokens(empty, path).count() == 0


def test_sentencepiece(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.codec(path)
    found = by_id(sentencepieces.encode_report(docs, path))
    for i, _, text, _ in ROWS:
        ids = np.array(library.encode(text or ""), "<u4").tobytes()
        assert codec.encode([text]) == [ids]
        assert (found[i]["n_tokens"], found[i]["ids_crc32"]) == (len(ids) // 4, zlib.crc32(ids))
        assert codec.decode(ids) == (text or "") and found[i]["round_trip"]


def test_packing(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    placed = packing.pack(docs, path).collect()
    lengths, bins = {}, {}
    for r in placed:
        lengths.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, _, text, _ in ROWS:
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        assert sorted(lengths[i]) == [(k, at, min(4096, n - at)) for k, at in enumerate(range(0, n, 4096))]
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 4096
    assert packing.pack(empty, path).count() == 0


def test_resharding(docs, empty):
    placed = sharding.reshard(docs, sharding.by_source()).collect()
    assert sorted(r["doc_id"] for r in placed) == [r[0] for r in ROWS]
    slots = {}
    for r in placed:
        assert r["size"] == len((ROWS[r["doc_id"]][2] or "").encode()) + 8 and 0 <= r["shard"] < 24
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.reshard(empty, sharding.by_source()).count() == 0


def test_licenses(docs, empty):
    found = by_id(licenses.scan_licenses(docs))
    assert len(found) == len(ROWS)
    row = found[next(i for i, _, t, _ in ROWS if t and t.startswith("Under the MIT"))]
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (7, 2, 0, 4)
    assert row["base_labels"] == "cc-by-nc,mit"
    assert licenses.scan_licenses(empty).count() == 0


def test_fingerprints(docs, empty):
    found = by_id(sketch.fingerprint_report(docs))
    assert len(found) == len(ROWS)
    texts = [(t or "") for _, _, t, _ in ROWS]
    for i, text in enumerate(texts):
        following = texts[i - 1] if i else texts[-1]
        third = len(text) // 3
        edit = text[: len(text) - third] + following[:third]
        assert found[i]["n_chars"] == len(text)
        assert found[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest(), i
        assert 0 <= found[i]["near_edited"] <= 1 and 0 <= found[i]["near_next"] <= 1
    assert len({(texts[i], r["fingerprint"]) for i, r in found.items()}) == len(set(texts))
    assert sketch.fingerprint_report(empty).count() == 0


def test_html(spark):
    page = "<html><body><nav><a href='/'>Home</a></nav><article><h1>A &amp; b</h1><p>One\n two</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://h/1", page), (2, "http://h/2", None), (3, None, "")], "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in wrappers.extract(pages).collect()}
    assert found == {1: "A & b\nOne two", 2: "", 3: ""}


def test_toxicity(spark):
    prepare(spark)
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "river", "stone", "cloud"]
    rows, labels = [], []
    for i in range(240):
        text = " ".join(rng.choices(words, k=20)) + (" you vile scum" if i % 4 == 0 else "")
        rows.append((i, "hot", text, None))
        labels.append((i, int(i % 4 == 0)))
    rows += [(240, "hot", None, None), (241, "hot", "", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    found = by_id(toxicity.score_documents(docs, known))
    assert len(found) == 242 and found[240]["score"] == found[241]["score"]
    for i, row in found.items():
        assert row["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.7)
    held = [(i, r["predicted"]) for i, r in found.items() if r["held_out"]]
    assert sum(p == int(i < 240 and i % 4 == 0) for i, p in held) >= 0.95 * len(held)
    kept = toxicity.drop_toxic(docs, known)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in found.items() if not r["predicted"]}
