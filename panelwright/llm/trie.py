"""Prefix trie of conversations by a splitter skeleton.

A conversation is a path of turns, each known by 16 bytes of the SHA-256 of its role and text. Paths are dealt to
shards by ranges. Whatever prefix reaches over the end of a shard is a prefix of the splitter there, so the trie of the
splitters' paths (the skeleton) holds every node that more than one shard sees. It is broadcast; each shard, sorted by
path, finishes all other nodes alone and gives partial aggregates of skeleton nodes, which are then summed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import tokens as T
from panelwright.llm.shared import stored

#: Bytes that stand for a turn in a path.
KEY = 16
#: Conversations of a shard, about: with these many, a shard's open nodes and their children stay small.
SHARD = 50_000
#: Sampled conversations per shard, from which the splitters are taken.
SAMPLES = 16
#: Bytes of all splitters' paths at most; beyond it every other splitter goes, so shards grow but results don't change.
SKELETON_BYTES = 16 << 20
#: Bytes of ids that one row carries where the ids ending at a skeleton node are streamed into their hash.
ENDS = 1 << 16
BATCH = 4096

LOCAL, PARTIAL, IDS = 0, 1, 2
#: What the shards give. kind LOCAL: a finished node, whose parent is `parent_conv_id` or skeleton node `above`. PARTIAL:
#: what one shard has of skeleton node `node`. IDS: the ids that end there, `piece` by `piece`.
PARTS = pa.schema([("kind", pa.int32()), ("node", pa.int32()), ("above", pa.int32()), ("shard", pa.int32()), ("piece", pa.int32()),
                   ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                   ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()),
                   ("ends", pa.string())])
NAMES = PARTS.names
_SPARK = {pa.int32(): "int", pa.int64(): "long", pa.string(): "string"}
DDL = ", ".join(f"{f.name} {_SPARK[f.type]}" for f in PARTS)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_key(role: Column, text: Column) -> Column:
    """Hex digits of a turn's key; the role's length keeps (role, text) apart from any other split of the same letters."""
    return F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """conv_id, path (binary, 16 bytes a turn), words (of each turn's text) of every conversation, rebuilt.

    Conversation c begins with the first h = crc32(c) % most turns of conversation c - c % block (all if fewer, none if
    absent), then come its own turns after its first h. Turns are ordered by turn, null first, then by role and by key
    (so repeated rows stay, each a turn). Null role or text is empty; rows with a null conv_id belong to no conversation
    and are left out; other columns are not read; no rows give no rows. One exchange by block serves the grouping and the
    look-up; texts, however long, are left behind before it.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    conv = F.col("conv_id").cast("long")
    n_words = F.size(F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")).cast("long")
    rows = turns.select(conv.alias("conv_id"), (conv - conv % block).alias("block"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), turn_key(role, text).alias("key"), n_words.alias("n")).alias("t"))
    own = rows.filter("conv_id is not null").repartition("block").groupBy("block", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    first = F.max(F.when(F.col("conv_id") == F.col("block"), F.slice("ts", 1, max(most - 1, 1)))).over(Window.partitionBy("block"))
    lent = F.when(F.col("base").isNull() | (F.col("h") == 0), F.slice("ts", 1, 0)).otherwise(F.slice("base", 1, F.greatest("h", F.lit(1))))
    kept = F.filter("ts", lambda t, k: k >= F.col("h"))
    all_turns = own.withColumn("base", first).withColumn("h", h).select("conv_id", F.concat(lent, kept).alias("ts"))
    path = F.unhex(F.array_join(F.transform("ts", lambda t: t["key"]), ""))
    return all_turns.select("conv_id", path.alias("path"), F.transform("ts", lambda t: t["n"]).alias("words"))


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Lower bounds (path, conv_id) of all shards but the first, from a sample of SAMPLES conversations a shard.

    The sample is drawn by a hash of the id; it sets only how even the shards are. Between two sampled paths the shortest
    prefix that parts them is enough.
    """
    drawn = paths.select("path", "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLES * shards).collect()
    keys = sorted((bytes(r.path), r.conv_id) for r in drawn)
    bounds: dict[tuple[bytes, int], None] = {}
    for k in range(1, shards):
        at = k * len(keys) // shards
        if 0 < at < len(keys):
            (before, _), (path, conv) = keys[at - 1], keys[at]
            cut = shared_depth(before, path) * KEY + KEY
            bounds[(path, conv) if before == path or cut >= len(path) else (path[:cut], -(1 << 63))] = None
    out = sorted(bounds)
    while sum(len(p) for p, _ in out) > SKELETON_BYTES:
        out = out[1::2]
    return out


def shared_depth(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from their start."""
    if a == b:
        return len(a) // KEY
    n = min(len(a), len(b)) // KEY
    for d in range(n):
        if a[d * KEY : d * KEY + KEY] != b[d * KEY : d * KEY + KEY]:
            return d
    return n


class Skeleton:
    """The trie of the splitters' paths, nodes numbered in preorder from the root, 0."""

    def __init__(self, bounds: list[tuple[bytes, int]]) -> None:
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in bounds:  # sorted, so new nodes come in preorder
            node = 0
            for at in range(0, len(path), KEY):
                step = (node, path[at : at + KEY])
                if step not in self.child:
                    self.child[step] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.child[step]
        self.n_children = [0] * len(self.parent)
        self.last = list(range(len(self.parent)))
        for k in range(len(self.parent) - 1, 0, -1):
            up = self.parent[k]
            self.n_children[up] += 1
            self.last[up] = max(self.last[up], self.last[k])

    def rows(self) -> list[tuple[int, int, int, int, int]]:
        """node, above, depth, number of skeleton children, last node of the subtree."""
        return list(zip(range(len(self.parent)), self.parent, self.depth, self.n_children, self.last, strict=True))


class _Node:
    __slots__ = ("conv", "depth", "node", "n", "children", "leaves", "saved", "words", "hash", "ids", "size", "pieces", "waiting")

    def __init__(self, conv: int, depth: int, node: int, words: int) -> None:
        self.conv, self.depth, self.node, self.words = conv, depth, node, words
        self.n = self.children = self.leaves = self.saved = self.size = self.pieces = 0
        self.hash, self.ids, self.waiting = None, [], []


class Shard:
    """The nodes of one shard, from its conversations in order of path and id."""

    def __init__(self, skeleton: Skeleton, shard: int) -> None:
        self.skeleton, self.shard = skeleton, shard
        self.open: list[_Node] = []
        self.path = b""
        self.out: list[tuple] = []

    def add(self, path: bytes, conv: int, words: list[int]) -> None:
        if not self.open:
            self.open.append(_Node(conv, 0, 0, 0))
            same = 0
        else:
            same = shared_depth(self.path, path)
        while len(self.open) > same + 1:
            self.close()
        for d in range(same, len(path) // KEY):
            above = self.open[-1].node
            node = self.skeleton.child.get((above, path[d * KEY : d * KEY + KEY]), -1) if above >= 0 else -1
            self.open.append(_Node(conv, d + 1, node, words[d]))
        for x in self.open:
            x.n += 1
            x.conv = min(x.conv, conv)
        self.path = path
        self.end_here(self.open[-1], conv)

    def end_here(self, x: _Node, conv: int) -> None:
        if x.node < 0:
            x.hash, lead = (hashlib.sha256(), "") if x.hash is None else (x.hash, ",")
            x.hash.update(f"{lead}{conv}".encode())
        else:
            x.ids.append(str(conv))
            x.size += len(x.ids[-1]) + 1
            if x.size >= ENDS:
                self.give_ids(x)

    def give_ids(self, x: _Node) -> None:
        if x.ids:
            self.out.append((IDS, x.node, None, self.shard, x.pieces, None, None, None, None, None, None, None, None, ",".join(x.ids)))
            x.ids, x.size, x.pieces = [], 0, x.pieces + 1

    def close(self) -> None:
        x = self.open.pop()
        up = self.open[-1] if self.open else None
        self.out += [(*row[:7], x.conv, *row[8:]) for row in x.waiting]
        if x.node >= 0:
            self.give_ids(x)
            self.out.append((PARTIAL, x.node, None, self.shard, None, x.conv, x.depth, None, x.n, x.children, x.leaves, x.saved, x.words, None))
        else:
            x.saved += (x.n - 1) * x.words
            x.leaves += x.children == 0
            ends = x.hash.hexdigest() if x.hash else NO_ENDS
            row = (LOCAL, None, up.node if up.node >= 0 else None, None, None, x.conv, x.depth, None, x.n, x.children, x.leaves, x.saved, x.words, ends)
            up.children += 1
            (self.out if up.node >= 0 else up.waiting).append(row)
        if up:
            up.leaves += x.leaves
            up.saved += x.saved

    def finish(self) -> None:
        while self.open:
            self.close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PARTS.types, strict=True)], schema=PARTS)


def _shards(bounds):
    """Adds the shard of each conversation: how many splitters come before it or with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True)
            shard = [bisect_right(bounds.value, k) for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), *batch.columns], ["shard", *batch.schema.names])

    return run


def _nodes(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton, work = Skeleton(bounds.value), None
        for batch in batches:
            for shard, conv, path, words in zip(*(batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "words")), strict=True):
                if work is None or work.shard != shard:
                    done = work.out if work else []
                    if work:
                        work.finish()
                    work = Shard(skeleton, shard)
                    work.out = done
                work.add(path, conv, words)
                if len(work.out) >= BATCH:
                    yield _batch(work.out)
                    work.out = []
        if work:
            work.finish()
            if work.out:
                yield _batch(work.out)

    return run


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the ids of each skeleton node, streamed in order; one at a time is in memory."""
    node, state = None, None
    give = lambda: pa.RecordBatch.from_pydict({"node": pa.array([node], pa.int32()), "ends_sha256": [state.hexdigest()]})
    for batch in batches:
        for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != node:
                if state:
                    yield give()
                node, state = k, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if state:
        yield give()


def prefix_trie(paths: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """Nodes of the trie of `paths` (conv_id, path, words as `rebuilt` gives them), one row each.

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves, saved_tokens (over the
    subtree: (members - 1) x words of the last turn), ends_sha256 (ids of the members that end here, ascending,
    comma-joined). Equal paths share all their nodes, however many there are: they are split between shards by id. A path
    without turns is a member of the root alone. Repeated (conv_id, path) rows count once each. No rows give no nodes.
    The ids that end at one node pass through one hash in order, as a stream of rows of ids; nothing else of a hot node
    meets in one task but one partial aggregate a shard.
    """
    spark = paths.sparkSession
    paths = stored(paths.select("conv_id", "path", "words"), "paths")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-paths.count() // shard_rows))
    bounds = splitters(paths, shards)
    skeleton = Skeleton(bounds)
    shared = spark.sparkContext.broadcast(bounds)
    dealt = paths.mapInArrow(T.tidied(_shards(shared)), "shard int, conv_id long, path binary, words array<long>")
    dealt = dealt.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    parts = stored(dealt.mapInArrow(T.tidied(_nodes(shared)), DDL), "parts")

    frame = spark.createDataFrame(skeleton.rows(), "node int, above int, depth long, inner long, last int")
    ids = parts.filter(F.col("kind") == IDS).select("node", "ends", "shard", "piece").repartition("node").sortWithinPartitions("node", "shard", "piece")
    ends = ids.select("node", "ends").mapInArrow(_hashes, "node int, ends_sha256 string")
    total = lambda c: F.sum(c).alias(c)
    sums = parts.filter(F.col("kind") == PARTIAL).groupBy("node").agg(F.min("conv_id").alias("conv_id"), *map(total, ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("words").alias("words"))
    own = sums.join(frame, "node").join(ends, "node", "left").withColumn("n_children", F.col("n_children") + F.col("inner"))
    # what skeleton nodes themselves add to their subtrees: a subtree is a range of nodes in preorder
    upto = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    leaf, saved = (F.col("n_children") == 0).cast("long"), (F.col("n_convs") - 1) * F.col("words")
    own = stored(own.withColumn("leaf_sum", F.sum(leaf).over(upto)).withColumn("saved_sum", F.sum(saved).over(upto)).withColumn("leaf", leaf).withColumn("saved", saved), "skeleton")
    ending = own.select(F.col("node").alias("last"), F.col("leaf_sum").alias("leaf_end"), F.col("saved_sum").alias("saved_end"))
    above = own.select(F.col("node").alias("above"), F.col("conv_id").alias("parent"))
    above = F.broadcast(above)  # one row a skeleton node, of which SKELETON_BYTES allows a million
    top = own.join(ending, "last").join(above, "above", "left").select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf_end") - F.col("leaf_sum") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saved_end") - F.col("saved_sum") + F.col("saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
    rest = parts.filter(F.col("kind") == LOCAL).join(above, "above", "left").select(
        "conv_id", "depth", F.coalesce("parent", "parent_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))
    return top.unionByName(rest)
