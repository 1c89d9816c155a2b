"""Document fingerprints that estimate containment between documents of very different length.

A fingerprint keeps every hash of a word shingle that lies below a fixed fraction of all hashes. Which hashes are kept
doesn't depend on the length of a document, so sketches of parts can be merged and sketches of a paragraph and of a book
compared. A text of which no hash lies below the fraction keeps its smallest one; `merged` applies the same rule again,
so a merged sketch is the sketch of the united shingles.

Null texts count as empty and have an empty fingerprint. A text with fewer words than a shingle is one shingle. Repeated
shingles count once, repeated rows get equal fingerprints. An empty table gives an empty result. Extra columns are
ignored. Everything is built from Spark's own column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import text_or_empty

WORDS = 5
#: One hash of SCALE is kept.
SCALE = 4
#: Hashes are 32 bits wide; so the largest that is kept is LIMIT - 1.
LIMIT = (1 << 32) // SCALE


#: What trims a text; words are split at any white space.
BLANKS = " \t\n\r\x0b\x0c"


def kept(hashes: Column, low: Column) -> Column:
    """The sketch of some hashes, of which `low` lie below the limit: those, else the smallest of all."""
    chosen = F.when(F.size(low) > 0, low).when(F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(low)
    return F.sort_array(F.array_distinct(chosen))


def with_sketch(df: DataFrame, text: str, name: str, words: int = WORDS, limit: int = LIMIT) -> DataFrame:
    """Add the sketch of a text column: its kept hashes, sorted, as an array of numbers below 2^32.

    Words are hashed first and shingles from the hashes of their words, so no shingle is ever built as a string. Each step is
    a column of its own, because Spark computes a column once but a repeated expression again.
    """
    trimmed = F.btrim(F.lower(F.col(text)), F.lit(BLANKS))
    shingle = lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get("_words", i + k) for k in range(words))), 32)
    none = F.array().cast("array<bigint>")
    return (
        df.withColumn("_trimmed", trimmed)
        .withColumn(
            "_words",
            F.when(F.col("_trimmed") == "", none).otherwise(
                F.transform(F.split("_trimmed", r"\s+"), lambda w: F.xxhash64(w))
            ),
        )
        .withColumn(
            "_hashes",
            F.when(F.size("_words") >= words, F.transform(F.sequence(F.lit(0), F.size("_words") - words), shingle))
            .when(F.size("_words") > 0, F.array(F.shiftrightunsigned(F.xxhash64("_words"), 32)))
            .otherwise(none),
        )
        .withColumn("_low", F.filter("_hashes", lambda h: h < limit))
        .withColumn(name, kept(F.col("_hashes"), F.col("_low")))
        .drop("_trimmed", "_words", "_hashes", "_low")
    )


def merged(a: Column, b: Column, limit: int = LIMIT) -> Column:
    """The sketch of two documents together."""
    both = F.array_union(a, b)
    return kept(both, F.filter(both, lambda h: h < limit))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def likeness(a: Column, b: Column) -> Column:
    """Containment of the smaller sketch in the larger; an empty sketch is like an empty one only."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise((F.size(a) == F.size(b)).cast("double"))


def as_text(sketch_column: Column) -> Column:
    """Eight hexadecimal digits per hash."""
    return F.array_join(F.transform(sketch_column, lambda h: F.lower(F.lpad(F.hex(h), 8, "0"))), "")


def cut_points(docs: DataFrame, buckets: int) -> list[int]:
    """Ids that cut the table into about `buckets` equal ranges, largest first; the largest id is one of them."""
    shares = [i / buckets for i in range(1, buckets)]
    row = docs.agg(
        F.percentile_approx("doc_id", shares, 20 * buckets).alias("cuts") if shares else F.array().alias("cuts"),
        F.max("doc_id").alias("last"),
    ).first()
    return sorted({*(row["cuts"] or []), row["last"]} - {None}, reverse=True)


def bucket_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of the last cut that isn't below an id; found in two steps, so a row looks at few of the cuts."""
    wide = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*(F.lit(c) for c in cuts[::wide]))
    block = F.size(F.filter(coarse, lambda c: c >= doc_id)) - 1
    fine = F.array(*(F.array(*(F.lit(c) for c in cuts[i : i + wide])) for i in range(0, len(cuts), wide)))
    return block * wide + F.size(F.filter(F.get(fine, block), lambda c: c >= doc_id)) - 1


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with the next one in descending doc_id, the first after the last, and both sketches.

    Documents are dealt into ranges of ids. The first document of a range is also a guest at the end of the range before, so
    every neighbour is found inside a range. Ids are keys here; documents without one form a range of their own.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut_points(docs, 4 * tasks) or [0]
    own = F.coalesce(bucket_of(F.col("doc_id"), cuts), F.lit(len(cuts)))
    first = F.array(*(F.lit(c) for c in cuts))
    homes = F.when(
        F.array_contains(first, F.col("doc_id")),
        F.array(F.struct(F.col("_own").alias("bucket"), F.lit(False).alias("guest")),
                F.struct(F.pmod(F.col("_own") - 1, F.lit(len(cuts))).alias("bucket"), F.lit(True).alias("guest"))),
    ).otherwise(F.array(F.struct(F.col("_own").alias("bucket"), F.lit(False).alias("guest"))))
    placed = (
        docs.select("doc_id", text_or_empty().alias("text"))
        .withColumn("_own", own)
        .withColumn("_home", F.explode(homes))
        .select("doc_id", "text", "_home.bucket", "_home.guest")
        .repartition(tasks, "bucket")
    )
    order = Window.partitionBy("bucket").orderBy("guest", F.desc("doc_id"), F.desc("text"))
    following = F.lead(F.struct("text", "sketch")).over(order)
    own = F.struct("text", "sketch")
    return (
        with_sketch(placed, "text", "sketch")
        .withColumn("_next", following)
        .filter(~F.col("guest"))
        .withColumn("_next", F.coalesce("_next", own))
        .select("doc_id", "text", "sketch", F.col("_next.text").alias("next_text"), F.col("_next.sketch").alias("next_sketch"))
    )


def edited(text: Column, following: Column) -> Column:
    """The text with its last third replaced by as many of the first characters of another."""
    n = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - n), F.substring(following, F.lit(1), n))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how like they and the next one's are."""
    changed = with_next(docs).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    return with_sketch(changed, "edit", "edit_sketch").select(
        "doc_id",
        F.char_length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edit_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edit_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
