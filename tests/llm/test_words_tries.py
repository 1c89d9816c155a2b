"""Language identification, spelling variants and the prefix trie against held-out rows and brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from driftgate.llm import languages, tries, variants
from driftgate.llm.common import prepare

DOCS = "doc_id bigint, text string, lang string, source string, word string, n string, form string"
TURNS = "conv_id bigint, turn int, role string, text string, p string, shard string, anchor string"


def documents(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, lang, "hot", "w", "n", "f") for i, t, lang in rows], DOCS)


# Languages ---------------------------------------------------------------------------------------------------------


def spoken(rng, syllables, words):
    return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(words)).capitalize() + "."


def test_languages_are_told_apart_on_held_out_rows(spark):
    rng = random.Random(2)
    tongues = {"aa": ["ka", "mo", "ri", "tu"], "bb": ["sch", "en", "ü", "er"], "cc": ["日", "本", "語", "の"]}
    rows = [(i, spoken(rng, tongues[lang], rng.randint(2, 120)), lang) for i in range(300) for lang in [sorted(tongues)[i % 3]]]
    truth = {i: lang for i, _, lang in rows}
    rows += [(300, None, "aa"), (301, "", "aa"), (302, " 12 !", "bb"), (None, "Kamoritu katu mori.", "bb"), (303, "Kamo " * 40_000, None)]
    rows += rows[:4]
    found = languages.identify(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    by_id = {r["doc_id"]: r for r in found}
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (300, 301, 302))
    assert by_id[None]["lang_pred"] == "aa" and by_id[303]["lang_pred"] == "aa"
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 30 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_nothing_to_learn_from_is_unknown(spark):
    rows = [(i, "some words", None) for i in range(5)]
    assert {r["lang_pred"] for r in languages.identify(documents(spark, rows)).collect()} == {"und"}
    assert languages.identify(documents(spark, [])).count() == 0


def test_windows_hold_every_run_of_bytes_and_every_byte_is_weighed():
    for n in (1, 4, 255, 256, 257, 252, 508, 509, 2000):
        data = np.arange(n, dtype=np.int64).astype(np.uint8) % 250 + 1
        cut, weights = languages.windows(data)
        widest = max(languages.WIDTHS)
        seen = {bytes(w[k : k + widest]) for w in cut for k in range(languages.WINDOW - widest + 1)}
        assert all(bytes(data[k : k + widest]) in seen for k in range(n - widest + 1))
        assert weights.min() > 0 and weights.sum() >= n


def test_the_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    texts = ["abcab" * 30, "xyzzy" * 30, "abzab" * 20, "xyxyz" * 20]
    net = languages.train(texts, ["a", "x", "a", "x"])
    guess = [net.labels[int(net.predict(languages.encoded(t)).argmax())] for t in ("abcabcab", "zyxyzzyx")]
    assert guess == ["a", "x"]
    # Convolution by patches equals the sum it stands for.
    batch = rng.integers(1, 255, (2, 40)).astype(np.uint8)
    _, responses = net.responses(batch)
    for f in (0, 13, 40):
        plain = sum(
            net.embedding[batch[1, 7 + k]] @ net.filters[k * languages.EMBEDDING : (k + 1) * languages.EMBEDDING, f]
            for k in range(max(languages.WIDTHS))
        )
        assert abs(responses[1, 7, f] - plain) < 1e-3


# Variants ----------------------------------------------------------------------------------------------------------


def brute_variants(rows):
    counts = collections.Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 5:
                counts[word] += 1
    words = {w: n for w, n in counts.items() if n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    around = {w: [v for v in words if v != w and near(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in around.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (n, len(around[w]), form.get(w), words[form[w]] if w in form else None, root)
    return out


@pytest.mark.parametrize("parts", [None, 3, 7])
def test_variants_agree_with_comparing_all_words(spark, parts):
    rng = random.Random(9)
    stems = ["".join(rng.choices("abcdé×ÿ", k=rng.randint(5, 9))) for _ in range(12)]

    def damage(word):
        k = rng.randrange(len(word))
        return rng.choice([word[:k] + word[k + 1 :], word[:k] + rng.choice("abcÉzï") + word[k + rng.randint(0, 1) :], word.upper()])

    pool = stems + [damage(s) for s in stems for _ in range(5)]
    rows = [(i if i % 9 else None, " ".join(rng.choices(pool, weights=range(len(pool), 0, -1), k=60)) + ", x1", None) for i in range(60)]
    rows += rows[:3] + [(99, None, None), (98, "", None), (97, (stems[0] + " ") * 3000, None), (96, "aaaaa aaaaa aaaaa aaaab aaaab aaaab", None)]
    expected = brute_variants(rows)
    found = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants.variant_groups(documents(spark, rows), parts).collect()}
    assert len(expected) > 30 and any(v[2] for v in expected.values())
    assert found == expected


def test_no_words_no_variants(spark):
    assert variants.variant_groups(documents(spark, [])).count() == 0
    assert variants.variant_groups(documents(spark, [(1, "a few short", None)])).count() == 0


# Tries -------------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            text = text or ""
            turns[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    plain = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, said in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        start = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = tuple(plain.get(start, [])[:h] + said[h:])
    members = collections.defaultdict(list)
    for c, said in rebuilt.items():
        for d in range(len(said) + 1):
            members[said[:d]].append(c)
    children = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(5)
    rows = []
    for c in range(-12, 90):
        if c % 11 == 3:
            continue
        for t in range(rng.randint(1, rng.choice([2, 4, 14, 30]))):
            text = rng.choice(["a", "b", "é", None]) if rng.random() < 0.9 else f"t{rng.randint(0, 5)}"
            rows.append((c, None if rng.random() < 0.03 else t, rng.choice(["u", None]), text))
    for c in range(200, 290):
        rows += [(c, 0, "u", "hot"), (c, 1, "u", "x" * 3000)]
    for c in (400, 401, 402, 405):
        rows += [(c, t, "u", f"long{t % 3}") for t in range(40)]
    return rows + [(None, 0, "u", "x")] * 3 + rows[:5]


@pytest.mark.parametrize(("segment", "shard_turns"), [(4096, 500_000), (7, 40)])
def test_tries_agree_with_sets_of_prefixes(spark, segment, shard_turns):
    prepare(spark)
    rows = conversations()
    df = spark.createDataFrame([(*r, "p", "s", "a") for r in rows], TURNS)
    found = tries.prefix_trie(df, segment, shard_turns)
    wanted = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert sorted((tuple(r) for r in found.select(*wanted).collect()), key=repr) == brute_trie(rows)


def test_no_conversations_no_trie(spark):
    prepare(spark)
    assert tries.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0
    assert tries.prefix_trie(spark.createDataFrame([(None, 1, "u", "x", "", "", "")], TURNS)).count() == 0


def test_median_insertion_keeps_siblings_balanced():
    order = list(tries.medians(1000))
    assert sorted(order) == list(range(1000))
    tree = tries.SearchTree()
    root = tree.node(-1, 0, 0, 0)
    for k in order:
        tree.insert(root, [k], [1], 1, k)

    def height(at):
        return 0 if at < 0 else 1 + max(height(tree.low[at]), height(tree.high[at]))

    assert height(tree.down[root]) <= 10 and tree.members[root] == 1000
