"""Resharding that moves the fewest bytes: a minimum-cost flow from old shard sizes to new capacities.

Documents lie in old shards. Each old shard is a row of blocks, one for each eighth of a doubling of the size.
A minimum-cost flow between old shards and new capacities (a byte that stays costs nothing, a byte that moves costs one)
says how many bytes go from each old shard to each new one. Every old shard is then read as a line of bytes: what stays
comes first, then one stretch per transfer. Whole blocks fall into stretches; only the block at the end of a stretch is
parted, between two documents. So new sizes differ from their capacities by a few documents at most.

The flow is solved on sums per shard and the line on sums per block; the number of both is set by shards and tasks, not by
documents. A block that many equal documents share is salted.

There may be more or fewer new shards than old ones. Equal texts are placed each for itself: a group of copies may hold a
third of all bytes, and could not lie in one shard of a 24th.

Null texts have no bytes. Documents without an id are placed like any other. Repeated rows each take a slot. Texts of any
length are sized whole. Ties in size go by id, then checksum. Extra columns are ignored by `reshard`, whatever their names,
and pass through `rewrite`, which needs unique ids that aren't null and fails where they are not. An empty table gives an
empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftgate.llm.common import durable, text_or_empty

SHARDS = 24
LAW = "bytes"
#: Bytes of a document beside its text.
OVERHEAD = 8


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Bytes from each old to each new shard, moving as few as can be: successive shortest paths with potentials.

    Nodes: a source, the old shards, the new shards, a sink. supply and capacity have equal sums.
    """
    old, new = len(supply), len(capacity)
    source, sink = old + new, old + new + 1
    room: dict[int, dict[int, int]] = {v: {} for v in range(sink + 1)}
    cost: dict[tuple[int, int], int] = {}

    def edge(a: int, b: int, most: int, price: int) -> None:
        room[a][b], cost[a, b] = most, price
        room[b].setdefault(a, 0)
        cost[b, a] = -price

    for i, most in enumerate(supply):
        edge(source, i, most, 0)
        for j in range(new):
            edge(i, old + j, most, int(i != j))
    for j, most in enumerate(capacity):
        edge(old + j, sink, most, 0)
    height = [0] * (sink + 1)
    while True:
        far, back, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for b, left in room[a].items():
                step = d + cost[a, b] + height[a] - height[b]
                if left > 0 and step < far.get(b, 1 << 60):
                    far[b], back[b] = step, a
                    heapq.heappush(queue, (step, b))
        if sink not in far:
            break
        for v, d in far.items():
            height[v] += d
        path, v = [], sink
        while v != source:
            path.append((back[v], v))
            v = back[v]
        amount = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= amount
            room[b][a] += amount
    return {(i, j): room[old + j][i] for i in range(old) for j in range(new) if room[old + j].get(i, 0) > 0}


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def document_size(text: Column) -> Column:
    return (F.octet_length(text) + OVERHEAD).cast("bigint")


def by_source(shards: int = SHARDS) -> Column:
    """The layout that documents arrive in: one source, one shard."""
    return F.pmod(F.crc32(F.coalesce(F.col("source").cast("string"), F.lit("")).cast("binary")), F.lit(shards)).cast("int")


def blocks(docs: DataFrame, old_shard: Column) -> DataFrame:
    text = text_or_empty()
    sized = docs.select(
        "doc_id",
        document_size(text).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        old_shard.alias("old_shard"),
    )
    # Eight blocks to each doubling of the size, large ones first.
    return sized.withColumn("block", -F.floor(F.log2(F.col("size").cast("double")) * 8).cast("int"))


def stretches(sums: list[tuple[int, int]], capacity: list[int]) -> list[tuple[int, int, int]]:
    """Where the stretches of each old shard begin: old shard, first byte, new shard.

    `sums` has (old shard, bytes) in any number. Capacities are scaled to what there is, so that they are shares.
    """
    supply = [0] * (max((shard for shard, _ in sums), default=-1) + 1)
    for shard, size in sums:
        supply[shard] += size
    flow = min_cost_flow(supply, scaled(capacity, sum(supply)))
    out = []
    for i in range(len(supply)):
        at = 0
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != i, j)):
            out.append((i, at, j))
            at += flow[i, j]
    return out


def scaled(capacity: list[int], total: int) -> list[int]:
    """Whole numbers in the proportions of `capacity` that add up to `total`."""
    whole = sum(capacity)
    if whole == total or not whole:
        return capacity if whole == total else equal_capacities(total, len(capacity))
    ends, held = [], 0
    for c in capacity:
        held += c
        ends.append(held * total // whole)
    return [b - a for a, b in zip([0, *ends], ends)]


def reshard(docs: DataFrame, old_shard: Column, shards: int = SHARDS, capacity: list[int] | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, old_shard, shard, slot.

    `capacity` gives the new shards their shares of all bytes, by default `shards` equal ones.
    """
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = durable(blocks(docs, old_shard))
    counted = rows.groupBy("old_shard", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    counted = sorted(tuple(r) for r in counted.collect())
    group = max(1, sum(n for _, _, n, _ in counted) // (4 * tasks))
    wide = {f"{s} {b}": -(-n // group) for s, b, n, _ in counted if n > group}
    salts = F.lit(1)
    if wide:
        key = F.concat_ws(" ", "old_shard", "block")
        salts = F.coalesce(F.create_map(*(F.lit(x) for pair in wide.items() for x in pair))[key], F.lit(1))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32"), salts))
    # Bytes before each salted block of an old shard: one row per block.
    line = Window.partitionBy("old_shard").orderBy("block", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("old_shard", "block", "salt").agg(F.sum("size").alias("bytes")).select(
        "old_shard", "block", "salt", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("first")
    )
    inside = Window.partitionBy("old_shard", "block", "salt").orderBy(F.desc("size"), "doc_id", "text_crc32")
    placed = (
        salted.withColumn("at", F.row_number().over(inside))
        .withColumn("before", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(starts, ["old_shard", "block", "salt"])
        .withColumn("middle", F.col("first") + F.col("before") + F.floor(F.col("size") / 2))
    )
    cuts = stretches([(s, b) for s, _, _, b in counted], capacity or [1] * shards)
    shard = F.lit(0)
    # At most two stretches to a shard, so a short expression.
    for old, first, new in cuts:
        shard = F.when((F.col("old_shard") == old) & (F.col("middle") >= first), F.lit(new)).otherwise(shard)
    placed = durable(placed.select("doc_id", "size", "text_crc32", "old_shard", "block", "salt", "at", shard.alias("shard")))
    parts = placed.groupBy("shard", "old_shard", "block", "salt").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lowest"))
    order = Window.partitionBy("shard").orderBy("old_shard", "block", "salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select(
        "shard", "old_shard", "block", "salt",
        (F.coalesce(F.sum("n").over(order), F.lit(0)) - F.col("lowest")).alias("base"),
    )
    return placed.join(bases, ["shard", "old_shard", "block", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "old_shard", "shard",
        (F.col("base") + F.col("at")).cast("bigint").alias("slot"),
    )


def affected(placed: DataFrame) -> DataFrame:
    """The shards that give or take documents; only their files are written anew."""
    moved = placed.filter("shard != old_shard")
    return moved.select("shard").unionAll(moved.select(F.col("old_shard").alias("shard"))).distinct()


def rewrite(docs: DataFrame, placed: DataFrame, folder: str) -> None:
    """Write the affected shards below `folder`, a directory per shard, and leave all other directories as they are.

    A shard that gives everything away loses its directory. Documents are matched to their places by id, so ids must be
    unique and not null; otherwise nothing is written.
    """
    spark = docs.sparkSession
    named = placed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if not named.filter("doc_id is null or n > 1").isEmpty():
        raise ValueError("documents can only be rewritten by unique ids")
    changed = affected(placed)
    wanted = placed.join(changed, "shard").select("doc_id", F.col("shard").alias("_shard"), "slot")
    rows = docs.drop("shard", "slot").join(wanted, "doc_id").withColumnRenamed("_shard", "shard")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(folder)
    # At most as many rows as there are shards.
    emptied = changed.join(placed.select("shard").distinct(), "shard", "left_anti").collect()
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in emptied:
        system.delete(path(f"{folder}/shard={row['shard']}"), True)
