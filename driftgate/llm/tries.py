"""The prefix trie of rebuilt conversations, from ternary search trees over range shards.

Turns (role and text) are numbered by a dictionary, so a conversation is a sequence of numbers. Sequences are sorted by
range into shards; the conversation id is the last sort key, so copies of one sequence may fill any number of shards. Each
shard inserts its distinct sequences into a ternary search tree, median first, which balances it, and one pass over its
nodes, children before parents, adds up members, leaves and savings. Two neighbouring shards share the common prefix of the
last sequence of one and the first of the other. Nodes on such prefixes are the boundary nodes; each shard reports its
share of them and the shares are merged. There are at most as many of them as shards times `SEGMENT`, however many
conversations there are.

A conversation longer than `SEGMENT` turns is cut into segments, and what follows an equal beginning is a trie of its own
whose totals are handed to the node it hangs from. So no row grows with a conversation; there is one round for each segment
of the longest.

Rows without a conversation id belong to no conversation. A null turn comes first; rows of one conversation and turn are
ordered by role and then by the SHA-256 of the text, and repeated rows each are a turn. Null roles and texts are empty.
Texts of any length are read whole, but only their digests and lengths are shuffled. Extra columns are ignored, whatever
their names. An empty table gives an empty result, without a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgate.llm.common import durable
from driftgate.operators.ranking import number_rows

#: Conversations that follow one another by this many borrow the first one's beginning.
GROUP = 5
#: One more than the longest beginning that is borrowed.
BORROWED = 9
#: Turns in one row.
SEGMENT = 4096
#: Turns in one shard, so that its tree fits in a task.
SHARD_TURNS = 500_000

EDGES = "shard int, first_anchor string, first_ids array<bigint>, last_anchor string, last_ids array<bigint>"
NODES = (
    "shard int, key bigint, parent_key bigint, anchor string, depth bigint, conv_id bigint, parent_conv_id bigint, "
    "n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, size bigint, ends string, ends_sha256 string"
)
TOTALS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def coded_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, p (place from 1), id (number of role and text), size (bytes of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.sha2(text.cast("binary"), 256).alias("digest"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    placed = number_rows(turns, ("conv_id",), ("turn", "role", "digest"), "p")
    dictionary = durable(
        placed.groupBy("role", "digest").agg(F.max("size").alias("size")).withColumn("id", F.monotonically_increasing_id())
    )
    return durable(placed.drop("size").join(dictionary, ["role", "digest"]).select("conv_id", "p", "id", "size"))


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its group."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % BORROWED).cast("int")


def rebuilt_segments(coded: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The rebuilt conversations, one row per segment: conv_id, segment, ids, sizes. A turnless one has an empty row."""
    heads = (
        coded.filter((F.col("p") < BORROWED) & (F.col("conv_id") % GROUP == 0))
        .groupBy(F.col("conv_id").alias("start"))
        .agg(F.sort_array(F.collect_list(F.struct("p", "id", "size"))).alias("head"))
    )
    convs = coded.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("start"), borrowed_turns(F.col("conv_id")).alias("h")
    )
    borrowed = F.coalesce(F.filter("head", lambda t: t["p"] <= F.col("h")), F.array().cast("array<struct<p:bigint,id:bigint,size:bigint>>"))
    convs = durable(convs.join(heads, "start", "left").select("conv_id", "h", borrowed.alias("begins")))
    own = (
        coded.join(convs.select("conv_id", "h", F.size("begins").alias("k")), "conv_id")
        .filter("p > h")
        .select("conv_id", (F.col("p") - F.col("h") + F.col("k")).alias("p"), "id", "size")
    )
    none = F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("size"))
    begins = convs.select("conv_id", F.inline(F.concat(F.array(none), "begins")))
    number = F.floor(F.greatest(F.col("p") - 1, F.lit(0)) / segment).cast("int")
    return (
        begins.unionAll(own)
        .groupBy("conv_id", number.alias("segment"))
        .agg(F.sort_array(F.collect_list(F.struct("p", "id", "size"))).alias("turns"))
        .select("conv_id", "segment", F.filter("turns", lambda t: t["p"] > 0).alias("turns"))
        .select("conv_id", "segment", F.col("turns.id").alias("ids"), F.col("turns.size").alias("sizes"))
    )


def anchored(segments: DataFrame) -> DataFrame:
    """Add `anchor`, a digest of all earlier segments of the conversation, and `continues`."""
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    long = segments.filter("segment > 0").select("conv_id").distinct()
    lists = (
        segments.join(long, "conv_id", "left_semi")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("segment", digest.alias("digest")))).alias("parts"))
    )
    chained = F.aggregate(
        "parts",
        F.array(F.lit("")),
        lambda held, part: F.array_append(held, F.sha2(F.concat(F.element_at(held, -1), part["digest"]).cast("binary"), 256)),
    )
    anchors = lists.select("conv_id", F.size("parts").alias("n"), F.posexplode(F.slice(chained, F.lit(1), F.size("parts"))).alias("segment", "anchor"))
    return (
        segments.join(anchors, ["conv_id", "segment"], "left")
        .withColumn("anchor", F.coalesce("anchor", F.lit("")))
        .withColumn("continues", F.coalesce(F.col("segment") + 1 < F.col("n"), F.lit(False)))
        .withColumn("after", F.sha2(F.concat("anchor", digest).cast("binary"), 256))
        .drop("n")
    )


# Shards ------------------------------------------------------------------------------------------------------------


def edge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last sequence of a shard."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            ends = batch.take(pa.array([0, batch.num_rows - 1])).to_pylist()
            first, last = first or ends[0], ends[1]
    if first:
        row = {"shard": first["shard"], "first_anchor": first["anchor"], "first_ids": first["ids"]}
        row |= {"last_anchor": last["anchor"], "last_ids": last["ids"]}
        types = {"shard": pa.int32(), "first_ids": pa.list_(pa.int64()), "last_ids": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_pydict({k: pa.array([v], types.get(k, pa.string())) for k, v in row.items()})


def common(a: tuple[str, list[int]], b: tuple[str, list[int]]) -> int:
    """How many ids two sequences share at their beginning; -1 if they don't even share the anchor."""
    if a[0] != b[0]:
        return -1
    n = 0
    for x, y in zip(a[1], b[1]):
        if x != y:
            break
        n += 1
    return n


def boundaries(edges: list) -> dict[int, tuple[list[int], list[int]]]:
    """For each shard, the keys of the boundary nodes on its first and on its last sequence, by depth."""
    edges = sorted(edges, key=lambda e: e["shard"])
    out, before, fresh = {}, [], 0
    for here, following in zip(edges, edges[1:] + [None]):
        first, last = (here["first_anchor"], here["first_ids"]), (here["last_anchor"], here["last_ids"])
        through = min(common(first, last) + 1, len(before))
        shared = common(last, (following["first_anchor"], following["first_ids"])) + 1 if following else 0
        after = before[: min(through, shared)]
        added = shared - len(after)
        after = after + list(range(fresh, fresh + added))
        fresh += added
        out[here["shard"]] = (before, after)
        before = after
    return out


@dataclass
class SearchTree:
    """A ternary search tree: `low` and `high` lead to siblings, `down` to children, `up` to the parent."""

    ids: list[int] = field(default_factory=list)
    low: list[int] = field(default_factory=list)
    high: list[int] = field(default_factory=list)
    down: list[int] = field(default_factory=list)
    up: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    size: list[int] = field(default_factory=list)
    members: list[int] = field(default_factory=list)
    least: list[int] = field(default_factory=list)

    def node(self, up: int, number: int, size: int, least: int) -> int:
        for name, value in (("ids", number), ("low", -1), ("high", -1), ("down", -1), ("up", up), ("size", size), ("members", 0)):
            getattr(self, name).append(value)
        self.depth.append(self.depth[up] + 1 if up >= 0 else 0)
        self.least.append(least)
        return len(self.ids) - 1

    def child(self, up: int, number: int, size: int, least: int) -> int:
        at = self.down[up]
        if at < 0:
            self.down[up] = at = self.node(up, number, size, least)
            return at
        while (held := self.ids[at]) != number:
            side = self.low if number < held else self.high
            if side[at] < 0:
                side[at] = self.node(up, number, size, least)
                return side[at]
            at = side[at]
        return at

    def insert(self, root: int, ids: list[int], sizes: list[int], members: int, least: int) -> int:
        """Add a sequence of so many members; the node it ends in."""
        at = root
        self.members[at] += members
        self.least[at] = min(self.least[at], least)
        for number, size in zip(ids, sizes):
            at = self.child(at, number, size, least)
            self.members[at] += members
            self.least[at] = min(self.least[at], least)
        return at

    def path(self, root: int, ids: list[int]) -> Iterator[int]:
        """The nodes of a sequence that is in the tree, the root first."""
        at = root
        yield at
        for number in ids:
            at = self.down[at]
            while self.ids[at] != number:
                at = self.low[at] if number < self.ids[at] else self.high[at]
            yield at


def medians(n: int) -> Iterator[int]:
    """The positions of a sorted list, each range's middle before its halves."""
    ranges = [(0, n)]
    while ranges:
        a, b = ranges.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            ranges += [(a, middle), (middle + 1, b)]


def shard_nodes(rows: list[dict], left: list[int], right: list[int]) -> dict[str, list]:
    """The nodes of one shard, from its sorted rows and the keys of its boundary nodes."""
    runs: list[tuple[dict, list[dict]]] = []
    for row in rows:
        if runs and runs[-1][0]["ids"] == row["ids"] and runs[-1][0]["anchor"] == row["anchor"]:
            runs[-1][1].append(row)
        else:
            runs.append((row, [row]))
    tree, roots, last = SearchTree(), {}, {}
    for row, copies in runs:
        if row["anchor"] not in roots:
            roots[row["anchor"]] = tree.node(-1, 0, 0, row["conv_id"])
    bounds: dict[str, list[int]] = {}
    for at, (row, _) in enumerate(runs):
        bounds.setdefault(row["anchor"], [at, at])[1] = at + 1
    anchor_of = {root: anchor for anchor, root in roots.items()}
    for anchor, (a, b) in bounds.items():
        for middle in medians(b - a):
            row, copies = runs[a + middle]
            end = tree.insert(roots[anchor], row["ids"], row["sizes"], len(copies), copies[0]["conv_id"])
            last[end] = copies
    keys: dict[int, int] = {}
    for row, known in ((rows[0], left), (rows[-1], right)):
        keys |= dict(zip(tree.path(roots[row["anchor"]], row["ids"][: max(len(known) - 1, 0)]), known)) if known else {}

    n = len(tree.ids)
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    out: dict[str, list] = {name.split()[0]: [] for name in NODES.split(", ")}
    anchors = [""] * n
    for at in range(n):
        anchors[at] = anchor_of[at] if at in anchor_of else anchors[tree.up[at]]
    for at in range(n - 1, -1, -1):  # children were made after their parents
        up, key = tree.up[at], keys.get(at)
        copies = last.get(at, ())
        ends = ",".join(str(c["conv_id"]) for c in copies if not c["continues"])
        if key is None:
            if copies and copies[0]["sub_leaves"] is not None:
                children[at] += copies[0]["sub_children"]
                leaves[at] += copies[0]["sub_leaves"]
                saved[at] += copies[0]["sub_saved"]
            leaves[at] = leaves[at] if children[at] else 1
            saved[at] += (tree.members[at] - 1) * tree.size[at]
            if up >= 0:
                children[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]
        values = (
            rows[0]["shard"], key, keys.get(up), anchors[at], tree.depth[at], tree.least[at],
            tree.least[up] if up >= 0 and up not in keys else None,
            tree.members[at], children[at], leaves[at], saved[at], tree.size[at],
            ends if key is not None else None,
            hashlib.sha256(ends.encode()).hexdigest() if key is None else None,
        )
        for column, value in zip(out.values(), values):
            column.append(value)
        if key is not None and copies and copies[0]["sub_leaves"] is not None:
            # What hangs from a boundary node is told once, apart from the shares, because every shard sees it.
            hung = dict(zip(out, values)) | {
                "conv_id": None, "n_convs": 0, "n_children": copies[0]["sub_children"], "n_leaves": copies[0]["sub_leaves"],
                "saved_tokens": copies[0]["sub_saved"], "ends": "",
            }
            for name, column in out.items():
                column.append(hung[name])
    return out


def node_batches(batches: Iterator[pa.RecordBatch], opened, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows = [row for batch in batches for row in batch.to_pylist()]
    if rows:
        out = shard_nodes(rows, *opened.value[rows[0]["shard"]])
        for a in range(0, len(out["shard"]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name][a : a + 50_000], f.type) for f in schema], schema=schema)


def merge_boundary(shares: list) -> dict[int, dict]:
    """The boundary nodes by key, from every shard's share of each."""
    whole: dict[int, dict] = {}
    hung: set[int] = set()
    for row in shares:
        node = whole.setdefault(row["key"], {
            "key": row["key"], "parent_key": row["parent_key"], "anchor": row["anchor"], "depth": row["depth"],
            "conv_id": row["conv_id"], "size": row["size"], **dict.fromkeys(TOTALS, 0),
        })
        if row["conv_id"] is None:
            if row["key"] in hung:
                continue
            hung.add(row["key"])
        elif node["conv_id"] is None or row["conv_id"] < node["conv_id"]:
            node["conv_id"] = row["conv_id"]
        for name in TOTALS:
            node[name] += row[name]
    for node in sorted(whole.values(), key=lambda v: -v["depth"]):
        node["n_leaves"] = node["n_leaves"] if node["n_children"] else 1
        node["saved_tokens"] += (node["n_convs"] - 1) * node["size"]
        if node["parent_key"] is not None:
            parent = whole[node["parent_key"]]
            parent["n_children"] += 1
            parent["n_leaves"] += node["n_leaves"]
            parent["saved_tokens"] += node["saved_tokens"]
    return whole


def hash_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined pieces of each key, from pieces sorted by key and shard, one piece at a time."""
    key, digest, keys, hashes = None, None, [], []
    for batch in batches:
        for name, piece in zip(batch.column("key").to_pylist(), batch.column("ends")):
            if name != key:
                if digest:
                    keys.append(key)
                    hashes.append(digest.hexdigest())
                key, digest = name, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(piece.as_py().encode())
    if digest:
        keys.append(key)
        hashes.append(digest.hexdigest())
    yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "sha": pa.array(hashes, pa.string())})


def layer_nodes(rows: DataFrame, shards: int) -> DataFrame:
    """All nodes of the tries of one layer: anchor, depth inside the layer, and the columns of a node.

    `rows` has conv_id, anchor, ids, sizes, continues, sub_children, sub_leaves and sub_saved.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rows.sparkSession
    order = ("anchor", "ids", "conv_id")
    placed = durable(
        rows.repartitionByRange(shards, *order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    )
    # Two sequences of at most SEGMENT ids per shard.
    edges = placed.select("shard", "anchor", "ids").mapInArrow(edge_batches, EDGES).collect()
    opened = spark.sparkContext.broadcast(boundaries(edges))
    schema = to_arrow_schema(spark.createDataFrame([], NODES).schema)
    nodes = durable(placed.mapInArrow(partial(node_batches, opened=opened, schema=schema), NODES))
    # At most SEGMENT + 1 boundary nodes per shard.
    shares = nodes.filter("key is not null").drop("ends", "ends_sha256").collect()
    whole = merge_boundary(shares)
    for node in whole.values():
        parent = whole.get(node["parent_key"])
        node["parent_conv_id"] = parent["conv_id"] if parent else None
    names = ("key", "anchor", "depth", "conv_id", "parent_conv_id", *TOTALS)
    kinds = ["string" if n == "anchor" else "bigint" for n in names]
    merged = spark.createDataFrame(
        [tuple(node[n] for n in names) for node in whole.values()], ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    )
    pieces = nodes.filter("key is not null and ends != ''").select("key", "shard", "ends")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "shard").mapInArrow(hash_batches, "key bigint, sha string")
    kept = ("anchor", "depth", "conv_id", "parent_conv_id", *TOTALS)
    boundary = merged.join(hashes, "key", "left").select(*kept, F.coalesce("sha", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
    parents = F.broadcast(merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_parent")))
    inner = nodes.filter("key is null").join(parents, "parent_key", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_parent"))
    return inner.select(*kept, "ends_sha256").unionAll(boundary)


def prefix_trie(conversations: DataFrame, segment: int = SEGMENT, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    segments = durable(rebuilt_segments(coded_turns(conversations), segment))
    found = segments.agg(F.max("segment"), F.sum(F.size("ids"))).first()
    layers, turns = (found[0] or 0) + 1, found[1] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // shard_turns))
    if layers > 1:
        segments = durable(anchored(segments))
    else:
        segments = segments.select("*", F.lit("").alias("anchor"), F.lit(False).alias("continues"), F.lit("").alias("after"))
    none = F.lit(None).cast("bigint")
    below, out = None, None
    for layer in range(layers - 1, -1, -1):
        rows = segments.filter(F.col("segment") == layer)
        if below is None:
            rows = rows.select("*", none.alias("sub_children"), none.alias("sub_leaves"), none.alias("sub_saved"))
        else:
            rows = rows.join(below, "after", "left")
        wanted = ("conv_id", "anchor", "ids", "sizes", "continues", "sub_children", "sub_leaves", "sub_saved")
        nodes = layer_nodes(rows.select(*wanted), shards)
        if layer:
            nodes = durable(nodes)
            below = nodes.filter("depth = 0").select(
                F.col("anchor").alias("after"), F.col("n_children").alias("sub_children"),
                F.col("n_leaves").alias("sub_leaves"), F.col("saved_tokens").alias("sub_saved"),
            )
            tops = (
                segments.filter((F.col("segment") == layer - 1) & (F.size("ids") == segment))
                .groupBy(F.col("after").alias("anchor")).agg(F.min("conv_id").alias("_top"))
            )
            nodes = nodes.filter("depth > 0").join(tops, "anchor", "left").withColumn(
                "parent_conv_id", F.when(F.col("depth") == 1, F.col("_top")).otherwise(F.col("parent_conv_id"))
            )
        part = nodes.select(
            "conv_id", (F.col("depth") + layer * segment).alias("depth"), "parent_conv_id", *TOTALS, "ends_sha256"
        )
        out = part if out is None else out.unionAll(part)
    return out
