"""Near-duplicates by SimHash: fingerprints, and a trie self-join that finds all pairs within a few bits.

Two fingerprints that differ in at most three bits agree in one of four blocks of 16 bits. So the trie is held four times,
each time with another block on top, and cut below that block: each (table, block) is a subtree whose path has used no
part of the error budget. Inside a subtree, node pairs are walked down together one bit at a time, the differing bits add
up, and a pair of nodes is pruned when they exceed the budget; small node pairs are compared leaf by leaf. Subtrees with
very many fingerprints are dealt into chunks, and each pair of chunks is joined as two tries, so no subtree has to fit
in one task. What a task reports is a spanning forest of the links that it found, never all pairs of a group.

Null texts count as empty; texts without words have fingerprint zero and link like any other. Equal fingerprints are one
leaf. A document without an id links others but gives no component id; a component without any id has a null one. Texts
of any length are read whole. Extra columns pass through `deduplicate`, whatever their names. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import durable, map_batches, text_or_empty
from driftgate.llm.components import components

WORDS = 3
MAX_BITS = 3
SEED = 42
BLOCK = 16
#: Fingerprints of one subtree in one chunk.
CHUNK = 2048
#: Node pairs with at most this many leaf pairs are compared leaf by leaf.
LEAVES = 64
#: Node pairs or leaf pairs handled at once.
WIDTH = 1 << 18
#: Rows of whole subtrees joined at once.
ROWS = 1 << 19


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64 majority bits of the XXH64 hashes of all word shingles."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) < words:
        hashes = [digest(b" ".join(parts), SEED)]
    else:
        hashes = [digest(b" ".join(s), SEED) for s in zip(*(parts[i:] for i in range(words)))]
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    counts = np.unpackbits(packed, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_batch(batch: dict[str, list]) -> dict[str, list]:
    return {"doc_id": batch["doc_id"], "digest": batch["digest"], "fp": [fingerprint(t) for t in batch["text"]]}


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (MD5 of the text, which tells rows apart that share an id), fp (signed)."""
    rows = docs.select("doc_id", "text", text_digest().alias("digest"))
    return map_batches(rows, fingerprint_batch, "doc_id bigint, digest string, fp bigint")


def text_digest() -> Column:
    return F.md5(text_or_empty().cast("binary"))


def boundary(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: int) -> np.ndarray:
    """For each range of sorted keys with a common prefix: the first position whose `bit` is set."""
    low, high = low.copy(), high.copy()
    mask = np.uint64(1 << bit)
    while (todo := low < high).any():
        middle = (low + high) >> 1
        unset = todo & ((keys[np.minimum(middle, len(keys) - 1)] & mask) == 0)
        low = np.where(unset, middle + 1, low)
        high = np.where(todo & ~unset, middle, high)
    return low


def leaf_pairs(keys: np.ndarray, pairs: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked leaves below small node pairs; columns of pairs: low a, high a, low b, high b, ..."""
    wide = pairs[:, 3] - pairs[:, 2]
    sizes = (pairs[:, 1] - pairs[:, 0]) * wide
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)
    wide = np.repeat(wide, sizes)
    a = np.repeat(pairs[:, 0], sizes) + at // np.maximum(wide, 1)
    b = np.repeat(pairs[:, 2], sizes) + at % np.maximum(wide, 1)
    linked = (a != b) & (np.bitwise_count(keys[a] ^ keys[b]) <= budget)
    return a[linked], b[linked]


def link_roots(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Put the links into `roots`, where each position points to a smaller one of its component or to itself."""
    while len(a):
        ra, rb = roots[a], roots[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(roots, np.maximum(ra, rb), np.minimum(ra, rb))
        while (up := roots[roots]).tobytes() != roots.tobytes():
            roots[:] = up


def walk(keys: np.ndarray, pairs: np.ndarray, roots: np.ndarray, budget: int, top: int) -> None:
    """Walk node pairs down from `top`; columns of pairs: low a, high a, low b, high b, differing bits so far."""
    stack = [(top, pairs)]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > WIDTH:
            stack += [(bit, pairs[i : i + WIDTH]) for i in range(0, len(pairs), WIDTH)]
            continue
        small = ((pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAVES) | (bit < 0)
        leaves, pairs = pairs[small], pairs[~small]
        for i in range(0, len(leaves), WIDTH // LEAVES):
            link_roots(roots, *leaf_pairs(keys, leaves[i : i + WIDTH // LEAVES], budget))
        if not len(pairs):
            continue
        la, ha, lb, hb, used = pairs.T
        ma, mb = boundary(keys, la, ha, bit), boundary(keys, lb, hb, bit)
        twin = (la == lb) & (ha == hb)
        children = np.concatenate([
            np.stack([la, ma, lb, mb, used], 1),
            np.stack([ma, ha, mb, hb, used], 1),
            np.stack([la, ma, mb, hb, used + 1], 1),
            np.stack([ma, ha, lb, mb, used + 1], 1)[~twin],
        ])
        full = (children[:, 0] < children[:, 1]) & (children[:, 2] < children[:, 3])
        children = children[full & (children[:, 4] <= budget)]
        stack.append((bit - 1, children))


def join_subtrees(group: np.ndarray, side: np.ndarray, keys: np.ndarray, budget: int) -> np.ndarray:
    """For rows sorted by group, side and key: the position of the smallest row linked to each."""
    roots = np.arange(len(keys))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(keys)]
    middles = starts + np.add.reduceat(side == 0, starts)
    alone = middles == ends
    pairs = np.stack([starts, middles, np.where(alone, starts, middles), ends, np.zeros_like(starts)], 1)
    # Of two tries, one may be missing: then there is nothing to join.
    pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
    walk(keys, pairs, roots, budget, 63 - BLOCK)
    return roots


def rotated(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    by = by.astype(np.uint64) & np.uint64(63)
    return (values << by) | (values >> ((np.uint64(64) - by) & np.uint64(63)))


def links(table: np.ndarray, cell: np.ndarray, side: np.ndarray, key: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    roots = join_subtrees(cell, side, key, budget)
    linked = np.flatnonzero(roots != np.arange(len(roots)))
    back = 64 - BLOCK * table.astype(np.uint64)
    own = rotated(key, back).view(np.int64)
    return own[linked], own[roots[linked]]


def link_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join whole subtrees of a sorted partition, a bounded number of rows at a time."""
    kept: list[tuple[np.ndarray, ...]] = []
    rows = 0

    def emit(parts):
        table, block, i, j, side, key = (np.concatenate(p) for p in zip(*parts))
        changed = np.r_[True, (table[1:] != table[:-1]) | (block[1:] != block[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]
        a, b = links(table, np.cumsum(changed), side, key.view(np.uint64), MAX_BITS)
        return pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    for batch in batches:
        part = tuple(batch.column(n).to_numpy() for n in ("t", "block", "i", "j", "side", "key"))
        if not len(part[0]):
            continue
        kept.append(part)
        rows += len(part[0])
        if rows >= ROWS:
            table, block, i, j, side, key = (np.concatenate(p) for p in zip(*kept))
            last = (table == table[-1]) & (block == block[-1]) & (i == i[-1]) & (j == j[-1])
            cut = int(np.argmax(last))
            if cut:
                whole = tuple(c[:cut] for c in (table, block, i, j, side, key))
                yield emit([whole])
                kept = [tuple(c[cut:] for c in (table, block, i, j, side, key))]
                rows = len(kept[0][0])
    if kept:
        yield emit(kept)


def subtrees(leaves: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The four tries below their top block, dealt into pairs of chunks: t, block, i, j, side, key."""
    tables = 64 // BLOCK
    turned = leaves.select("fp", F.explode(F.array(*(F.lit(t) for t in range(tables)))).alias("t")).withColumn(
        "key",
        F.expr(f"if(t = 0, fp, shiftleft(fp, {BLOCK} * t) | shiftrightunsigned(fp, 64 - {BLOCK} * t))"),
    ).withColumn("block", F.expr(f"int(shiftrightunsigned(key, {64 - BLOCK}))"))
    hot = (
        turned.groupBy("t", "block").count().filter(F.col("count") > chunk)
        .select("t", "block", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    )
    return (
        turned.join(hot, ["t", "block"], "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "t", "block",
            F.least("own", "other").alias("i"),
            F.greatest("own", "other").alias("j"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "key",
        )
    )


def near_links(leaves: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A spanning forest of the links between distinct fingerprints: a, b with a > b."""
    cells = ("t", "block", "i", "j")
    tasks = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = subtrees(leaves, chunk).repartition(tasks, *cells).sortWithinPartitions(*cells, "side", "key")
    return dealt.mapInArrow(link_partition, "a bigint, b bigint")


def grouped(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, digest, fp, component_id, and `best`, the doc_id and digest that stay of its component."""
    prints = durable(fingerprints(docs))
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    leaves = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min(row).alias("best")))
    roots = components(near_links(leaves.select("fp"), chunk))
    rooted = leaves.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", "best", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.min("best").alias("best"))
    owners = rooted.select("fp", "root").join(named, "root").select("fp", "component_id", "best")
    return prints.join(owners, "fp")


def near_groups(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id."""
    return grouped(docs, chunk).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id, of several the one with the smallest digest.

    A document without an id stays only where no other of its component has one. Rows are decided by id and text, so rows
    that only share an id are not dropped together. The row itself travels as one value, so that none of its columns can
    clash with those used here.
    """
    dropped = (
        grouped(docs, chunk)
        .filter(~(F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("digest") == F.col("best.digest"))))
        .select(F.col("doc_id").alias("_dropped"), F.col("digest").alias("_dropped_digest"))
        .distinct()
    )
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), text_digest().alias("_digest"))
    gone = F.col("_id").eqNullSafe(F.col("_dropped")) & (F.col("_digest") == F.col("_dropped_digest"))
    return rows.join(dropped, gone, "left_anti").select("_row.*")
