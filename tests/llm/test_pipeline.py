"""The pipeline's stages one after another against plain code, and what it leaves behind."""

import random
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from driftgate.llm import simhash
from driftgate.llm.common import prepare
from driftgate.session import shared_folder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _dropped string"
LABELS = "doc_id bigint, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    prepare(spark)
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    plain = [" ".join(rng.choices(words, k=rng.randint(40, 120))) for _ in range(150)]
    vile = " you vile scum you vile scum"
    rows = [(i, t + vile if i % 5 == 0 else t) for i, t in enumerate(plain)]
    rows += [(1000 + i, t) for i, t in rows[1:20] if i % 5]  # exact copies, with larger ids
    rows += [(2000 + i, t + " a") for i, t in rows[30:60] if i % 5]  # some of them near copies
    rows += [(3000, None), (3001, ""), (None, plain[1] + " and more of it that is long enough to be apart " + plain[2]), (7, "an id that is there twice already")]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "xx", "hot", 1, "d") for i, t in rows], DOCS).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(150)], LABELS).write.parquet(str(folder / "labels.parquet"))
    return rows, str(folder)


def test_each_stage_keeps_what_it_should(spark, corpus):
    rows, folder = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted((r for r in rows if "vile" not in (r[1] or "")), key=repr)
    once = stages["exact_dedup"](spark, clean, folder)
    best = {}
    for i, t in ((r["doc_id"], r["text"] or "") for r in clean.collect()):
        best[t] = max(best.get(t, -1), -1 if i is None else i)
    assert {r["text"] or "": -1 if r["doc_id"] is None else r["doc_id"] for r in once.collect()} == best and once.count() == len(best)
    apart = stages["simhash_near_dedup"](spark, once, folder)
    prints = [(r["doc_id"], r["text"] or "", simhash.fingerprint(r["text"])) for r in once.collect()]
    group = list(range(len(prints)))
    for a, (_, _, x) in enumerate(prints):
        for b, (_, _, y) in enumerate(prints[:a]):
            if ((x ^ y) & (2**64 - 1)).bit_count() <= 3:
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    wanted = [min(((i is None, i, t) for (i, t, _), g in zip(prints, group) if g == k)) for k in set(group)]
    assert len(wanted) < len(prints) and apart.columns == docs.columns
    found = sorted(((r["doc_id"], r["text"] or "") for r in apart.collect()), key=repr)
    assert found == sorted(((i, t) for _, i, t in wanted), key=repr)


def test_the_whole_pipeline(spark, corpus):
    rows, folder = corpus
    before = set(Path(shared_folder(spark).removeprefix("file:")).glob("table-*"))
    placed = corpus_pipeline.run(spark, folder).collect()
    assert set(Path(shared_folder(spark).removeprefix("file:")).glob("table-*")) == before
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(len(library.encode(t or "", add_special_tokens=False).ids) + 1)
    bins = {}
    for r in placed:
        assert any(r["start"] + r["length"] <= n for n in texts[r["doc_id"]])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        assert [o for o, _ in sorted(held)] == [sum(n for _, n in sorted(held)[:k]) for k in range(len(held))]
        assert sum(n for _, n in held) <= 4096


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
