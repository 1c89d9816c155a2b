"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

How a bin is filled depends on lengths only, so the plan is made from the histogram of lengths, which has at most as many
rows as a sequence has tokens however large the corpus is. A bin is filled greedily with the longest length that still
fits; then its smallest document gives way to the two unpacked lengths that fill the widened gap best, if they fill it
better. The same filling is repeated as often as the histogram allows, so the plan stays small. Documents then find
their place by their rank within their length: ranks are counted in salted groups, so a length that a third of all
documents share is spread over many tasks.

A document longer than a sequence is cut into full sequences and a rest; nothing else is cut, and texts of any length are
read whole. Null and empty texts are a single end token. Rows that repeat an id are packed as often as they occur. Pieces of
equal length take their places by id, piece and checksum. Extra columns are ignored, whatever their names. An empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import durable, map_batches
from driftgate.llm.words import encoder, packed

CAPACITY = 4096
END = 1
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"


def piece_batch(batch: dict[str, list], path: str, capacity: int) -> dict[str, list]:
    out: dict[str, list] = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
    end = packed([END])
    for doc_id, ids in zip(batch["doc_id"], encoder(path).encode(batch["text"])):
        ids += end
        for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
            part = ids[at : at + 4 * capacity]
            for name, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                out[name].append(value)
    return out


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    return map_batches(docs.select("doc_id", "text"), partial(piece_batch, path=path, capacity=capacity), PIECES)


def longest(counts: np.ndarray) -> np.ndarray:
    """For each room: the longest length left that fits into it, or 0."""
    return np.maximum.accumulate(np.where(counts > 0, np.arange(len(counts)), 0))


def best_two(counts: np.ndarray, room: int) -> tuple[int, int]:
    """The two lengths left with the largest sum within `room`."""
    fits = longest(counts)
    a = np.flatnonzero(counts[: room + 1])
    a = a[a < room]
    if not len(a):
        return 0, 0
    b = fits[room - a]
    same = (b == a) & (counts[a] < 2)
    b = np.where(same, fits[np.maximum(a - 1, 0)], b)
    sums = np.where(b > 0, a + b, 0)
    k = int(np.argmax(sums))
    return (int(a[k]), int(b[k])) if sums[k] else (0, 0)


def fill(counts: np.ndarray, capacity: int) -> dict[int, int]:
    """What one bin holds: length -> how many. Leaves counts as they are."""
    left, room, held = counts.copy(), capacity, {}
    fits = longest(left)
    while length := int(fits[room]):
        many = int(min(left[length], room // length))
        held[length] = many
        left[length] -= many
        room -= many * length
        if not left[length]:
            fits = longest(left)
    if room:
        smallest = min(held)
        a, b = best_two(left, room + smallest)
        if smallest < a + b:
            for length, many in ((smallest, -1), (a, 1), (b, 1)):
                held[length] = held.get(length, 0) + many
            held = {k: n for k, n in held.items() if n}
    return held


def best_two_fit(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """The plan, a row per filling and length: length, first rank, last rank + 1, copies in a bin, first bin, offset."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    ranks = np.zeros_like(counts)
    plan, bins = [], 0
    while counts.any():
        held = fill(counts, capacity)
        times, offset = int(min(counts[k] // n for k, n in held.items())), 0
        for length, many in sorted(held.items(), reverse=True):
            used = times * many
            plan.append((length, ranks[length], ranks[length] + used, many, bins, offset))
            ranks[length] += used
            counts[length] -= used
            offset += many * length
        bins += times
    return np.array(sorted(plan), np.int64).reshape(-1, 6)


def placed_batches(batches: Iterator[pa.RecordBatch], plan) -> Iterator[pa.RecordBatch]:
    rows = plan.value
    keys = (rows[:, 0] << 44) + rows[:, 1]
    for batch in batches:
        length, rank = (batch.column(n).to_numpy() for n in ("length", "_rank"))
        length, first, _, many, bins, offset = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1].T
        at = rank - first
        columns = {n: batch.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
        yield pa.RecordBatch.from_pydict(columns | {"sequence_id": bins + at // many, "offset": offset + at % many * length})


def ranked(cut: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Number the pieces of each length from 0, a bounded number of rows at a time."""
    tasks = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = max(1, sum(histogram.values()) // (4 * tasks))
    # A row per length that needs more than one group: at most 4 * tasks of them.
    wide = {k: -(-n // group) for k, n in histogram.items() if n > group}
    salts, spread = F.lit(1), cut
    if wide:
        table = cut.sparkSession.createDataFrame(sorted(wide.items()), "length bigint, _salts int")
        salts, spread = F.coalesce("_salts", F.lit(1)), cut.join(F.broadcast(table), "length", "left")
    salted = spread.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), salts)).drop("_salts")
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = salted.groupBy("length", "_salt").count().select(
        "length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift")
    )
    inside = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = salted.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(shifts, ["length", "_salt"]).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_salt", "_at", "_shift")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = durable(pieces(docs, path, capacity))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    plan = docs.sparkSession.sparkContext.broadcast(best_two_fit(histogram, capacity))
    return ranked(cut, histogram).mapInArrow(partial(placed_batches, plan=plan), PLACED)
