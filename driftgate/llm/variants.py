"""Spelling variants of words: near words, the more frequent form of each, and the root of its chain of forms.

Near words differ by one inserted, deleted or replaced code point. They are found by PartEnum signatures. A word's letter
multiset is read as a binary vector with a dimension for every copy of every letter. A replaced letter changes two
dimensions and an inserted or deleted one changes one, so near words lie within Hamming distance two. The dimensions are
dealt into parts by the letter. Vectors that differ in two dimensions agree outside some two parts, vectors that differ in
one agree outside some one part; enumerating the parts to leave out gives the exact signatures. How many letters the word and
a part left out have is known for both words too, and is a part of each signature. Signatures are equi-joined, and
the join itself verifies the words by edit distance, so what leaves it are near words only. How many parts there are follows
the size of the vocabulary, which keeps signature groups small; it has no influence on the result. Groups that are large
all the same are what adaptive execution splits.

A form has at least twice its word's count, so a chain of forms has at most about 40 members, and pointer jumping finds
all roots in a few joins.

Null texts have no words; a null id is written as nothing before the colon. Rows that repeat an id and a text count as
often as they occur. Texts of any length are read whole. Ties between near words of equal count go to the smallest in
code-point order. Extra columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import durable

LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
#: The code points that a lower-cased run may hold.
ALPHABET = [chr(c) for c in (*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
MIN_LENGTH = 5
MIN_COUNT = 3
#: One occurrence in so many loses a letter.
DAMAGED = 97
#: A form's count is at least so many times its word's.
RATIO = 2
PARTS = 6


def lower_ascii(run: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    return F.when(F.octet_length(run) == F.length(run), F.lower(run)).otherwise(F.translate(run, upper, upper.lower()))


def damaged(run: Column, doc_id: Column) -> Column:
    """`run`, without one of its code points where the checksum of document and run says so."""
    key = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run)
    h = F.crc32(key.cast("binary"))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(h % DAMAGED == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """The words of all texts and how often each occurs: word, n.

    Runs that are too short before a letter is taken out are too short after it, so the search leaves them out.
    """
    runs = docs.select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))).alias("run")
    )
    words = runs.select(damaged(lower_ascii(F.col("run")), F.col("doc_id")).alias("word"))
    counted = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter((F.length("word") >= min_length) & (F.col("n") >= min_count))


def parts_for(words: int) -> int:
    """Parts of the vector: one more for each tenfold vocabulary beyond a million words."""
    return PARTS + max(0, math.ceil(math.log10(max(words, 1))) - 6)


def dealt(words: DataFrame, parts: int) -> DataFrame:
    """word, n, and of each part of the vector its digest and how many letters it has.

    A letter's part is its code point modulo the number of parts.
    """
    sorted_letters = F.array_join(F.array_sort(F.split("word", "")), "")
    classes = ["".join(c for c in ALPHABET if ord(c) % parts == p) for p in range(parts)]
    held = [F.regexp_replace("_letters", f"[^{letters}]+", "") for letters in classes]
    split = words.select("word", "n", sorted_letters.alias("_letters")).select(
        "word", "n", F.length("word").alias("_length"), *[h.alias(f"_part{p}") for p, h in enumerate(held)]
    )
    return split.select(
        "word",
        "n",
        "_length",
        *[F.xxhash64(f"_part{p}").alias(f"_digest{p}") for p in range(parts)],
        *[F.length(f"_part{p}").alias(f"_size{p}") for p in range(parts)],
    )


def rest(parts: int, *left_out: int) -> list[str]:
    return [f"_digest{p}" for p in range(parts) if p not in left_out]


def one_part(parts: int, shorter: int = 0) -> list[Column]:
    """Signatures with one part left out. Lengths count `shorter` less."""
    return [F.xxhash64(F.lit(p), F.col("_length") - shorter, *rest(parts, p)) for p in range(parts)]


def two_parts(parts: int, fewer: int = 0) -> list[Column]:
    """Signatures with two parts left out, and how many letters the first of them has, `fewer` less."""
    return [
        F.xxhash64(F.lit(p * parts + q), "_length", F.col(f"_size{p}") - fewer, *rest(parts, p, q))
        for p, q in combinations(range(parts), 2)
    ]


def signed(vectors: DataFrame, choices: list[Column], name: str) -> DataFrame:
    """One row per word and signature: signature, and `name` as a struct of n and word."""
    listed = vectors.select(F.array(*choices).alias("_signatures"), F.struct("n", "word").alias(name))
    return listed.select(F.explode("_signatures").alias("signature"), name)


def near_pairs(words: DataFrame, parts: int | None = None) -> DataFrame:
    """Every pair of near words: a, b, both structs of n and word.

    `words` has columns word and n; a word occurs once. A letter may be replaced by one of another part (a word loses a
    letter of one part and gains one of the other) or of its own part, or be taken out. Each case has its own signatures,
    and a pair comes from exactly one of them. All go through one join; the last bit of a signature is set where both
    sides have the same ones, so that one order of a pair is enough.
    """
    parts = parts or parts_for(words.count())
    vectors = durable(dealt(words, parts))
    a, b = F.col("a.word"), F.col("b.word")

    def tagged(signatures: list[Column], number: int, twin: bool = False) -> list[Column]:
        return [F.shiftleft(F.xxhash64(F.lit(number), s), 1).bitwiseOR(F.lit(int(twin))) for s in signatures]

    within = tagged(one_part(parts), 1, True)
    left = signed(vectors, [*tagged(two_parts(parts), 2), *within, *tagged(one_part(parts), 3)], "a")
    right = signed(vectors, [*tagged(two_parts(parts, 1), 2), *within, *tagged(one_part(parts, 1), 3)], "b")
    ordered = (F.col("signature").bitwiseAND(F.lit(1)) == 0) | (a < b)
    # A replaced letter stands in one half of the word and leaves the other as it is: cheaper to see than a distance.
    half = (F.length(a) / 2).cast("int")
    same_half = (F.substring(a, F.lit(1), half) == F.substring(b, F.lit(1), half)) | (
        F.substring(a, half + 1, F.length(a)) == F.substring(b, half + 1, F.length(b))
    )
    likely = (F.length(a) != F.length(b)) | same_half
    joined = left.join(right, "signature").filter(ordered & likely & (F.levenshtein(a, b, 1) == 1))
    return joined.select("a", "b")


def near_words(pairs: DataFrame) -> DataFrame:
    """For each word that has near words: word, n, near (set of structs of n and word).

    A word has at most about 180 near words for each of its letters, so the set is bounded.
    """
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a.word").alias("word"), F.col("a.n").alias("n")).agg(F.collect_set("b").alias("near"))


def chosen_form(n: Column, near: Column, ratio: int = RATIO) -> Column:
    """The near word of largest count, the smallest of these, if it is frequent enough: struct of count and word."""
    best = F.array_max(F.transform(near, lambda x: x["n"]))
    word = F.array_min(F.transform(F.filter(near, lambda x: x["n"] == best), lambda x: x["word"]))
    return F.when(best >= ratio * n, F.struct(best.alias("n"), word.alias("word")))


def roots(forms: DataFrame) -> DataFrame:
    """The last form of each chain: word, root. `forms` has a row (word, form) for each word that has a form.

    Every round replaces a pointer by the pointer of what it points to, so chains halve; it ends when no pointer leads to
    a word that points on.
    """
    jumped = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = jumped.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = durable(jumped.join(onward, "root", "left"))
        if step.filter(F.col("_next").isNotNull()).isEmpty():
            return jumped
        jumped = step.select("word", F.coalesce("_next", "root").alias("root"))


def variant_groups(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = durable(vocabulary(docs))
    near = near_words(near_pairs(words, parts))
    found = durable(
        near.select("word", F.size("near").cast("bigint").alias("n_near"), chosen_form(F.col("n"), F.col("near")).alias("form"))
    )
    ends = roots(found.filter("form is not null").select("word", F.col("form.word").alias("form")))
    return (
        words.join(found, "word", "left")
        .join(ends, "word", "left")
        .select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.col("form.word").alias("form"),
            F.col("form.n").alias("form_n"),
            F.coalesce("root", "word").alias("root"),
        )
    )
