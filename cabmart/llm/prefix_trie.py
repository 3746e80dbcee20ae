"""The trie of all conversations' beginnings, by a splitter skeleton (operator 12).

A node is a distinct sequence of first turns (role, text); its members are the
conversations that begin with it.  A turn is known by the MD5 of its role and
text, so a conversation is a string of 16-byte steps, and sorting these strings
puts the members of a node side by side.

1. Conversations are dealt to shards by splitters, (path, id) pairs taken from a
   bounded sample in sorted order.  A group of equal conversations is cut by
   their ids, so no shard needs to hold it whole.
2. Only a node that is the beginning of a splitter's path can have members in
   two shards.  The trie of those paths is the skeleton; it is broadcast, and has at
   most ``DEEP`` nodes a splitter.
3. Each shard reads its sorted conversations once, with the open nodes of one
   path on a stack, and finishes every node that is not in the skeleton.
4. Of a skeleton node each shard gives a partial row.  These are summed by node;
   what the subtree of a skeleton node holds is the sum over the skeleton nodes
   below it, of whatever their shards have finished.
5. The ids that end at a skeleton node come from the shards as runs of text, which
   one pass hashes in order, a run at a time.

Defined results: rows without a conversation id belong to none; a null role or
text is empty; a null turn number comes first, turns of one number are in the
order of their MD5; repeated rows are turns of their own; an empty table has no
nodes, not even a root; other columns are ignored.  A conversation is one row of
16 bytes and a count for each turn (its texts are not held).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: Conversations that a shard should hold, shards at most, and sampled rows a shard.
PER_SHARD, MOST_SHARDS, SAMPLED = 50_000, 20_000, 16
#: Turns of a sampled path that a splitter keeps at most (later ones would only cut more evenly).
DEEP = 64
#: Ids in one run of a skeleton node's ends.
RUN = 4096
STEP = 16

NODE, PARTIAL, ENDS = 0, 1, 2
_OUT = pa.schema([("kind", pa.int8()), ("num", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int32()),
                  ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
                  ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends", pa.string())])
_DDL = ("kind byte, num int, conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, "
        "n_leaves long, saved_tokens long, chars long, ends string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(``conv_id``, ``steps``): of each conversation the steps (MD5 as hex, code points of the text) in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    one = F.struct(F.col(turn_col).isNotNull().alias("numbered"), F.col(turn_col).alias("turn"),
                   F.md5(told.cast("binary")).alias("step"), F.length(text).alias("chars"))
    kept = turns.filter(F.col(conv_col).isNotNull())
    return (kept.select(F.col(conv_col).cast("long").alias("conv_id"), one.alias("one")).groupBy("conv_id")
            .agg(F.transform(F.sort_array(F.collect_list("one")),
                             lambda t: F.struct(t["step"].alias("step"), t["chars"].alias("chars"))).alias("steps")))


def with_shared_heads(convs: DataFrame, block: int, n_first: Column, most: int) -> DataFrame:
    """``convs`` with their first ``n_first`` (at most ``most``) steps taken from the first conversation of their block.

    The blocks are ``block`` ids long; a conversation whose block's first id is absent loses those steps.
    """
    heads = (convs.filter(F.col("conv_id") % block == 0)
             .select(F.col("conv_id").alias("lead"), F.slice("steps", 1, most).alias("head")))
    own = convs.select("conv_id", "steps", (F.col("conv_id") - F.col("conv_id") % block).alias("lead"),
                       n_first.cast("int").alias("h")).join(heads, "lead", "left")
    none = F.slice("steps", 1, 0)
    steps = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")),
                     F.slice("steps", F.col("h") + 1, F.greatest(F.size("steps") - F.col("h"), F.lit(0))))
    return own.select("conv_id", steps.alias("steps"))


def splitters(paths: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Sorted (path, id) pairs that cut the sorted conversations into ``shards`` about even parts."""
    if shards < 2:
        return []
    sample = (paths.select(F.substring("path", 1, STEP * DEEP).alias("path"), "conv_id")
              .orderBy(F.xxhash64("conv_id"), "conv_id").limit(shards * SAMPLED).collect())      # a bounded sample
    at = sorted((bytes(r.path), r.conv_id) for r in sample)
    return sorted({at[i * len(at) // shards] for i in range(1, shards)}) if at else []


class Skeleton:
    """The nodes on the paths of the splitters; number 0 is the root."""

    def __init__(self, cuts: list[tuple[bytes, int]]):
        self.cuts = cuts
        self.below: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.children = [-1], [0], [0]
        for path, _ in cuts:
            at = 0
            for i in range(0, len(path), STEP):
                step = (at, path[i:i + STEP])
                if step not in self.below:
                    self.below[step] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                    self.children.append(0)
                    self.children[at] += 1
                at = self.below[step]

    def shard(self, path: bytes, conv_id: int) -> int:
        return bisect_right(self.cuts, (path, conv_id))

    def rows(self) -> list[tuple[int, int, int, int, list[int]]]:
        """(number, depth, parent's number, children in the skeleton, numbers from the root to the node)."""
        ups: list[list[int]] = []
        for num, up in enumerate(self.parent):
            ups.append((ups[up] if num else []) + [num])
        return [(n, d, p, c, u) for n, (d, p, c, u) in enumerate(zip(self.depth, self.parent, self.children, ups))]


class _Open:
    """A node whose members are being read."""
    __slots__ = ("step", "num", "chars", "least", "n", "children", "leaves", "saved", "hash", "ends", "held")

    def __init__(self, step: bytes, num: int, chars: int):
        self.step, self.num, self.chars = step, num, chars
        self.least: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.hash = None
        self.ends: list[int] = []
        self.held: list[tuple] = []                      # finished children, until the smallest member is known

    def seen(self, conv_id: int, n: int = 1):
        self.n += n
        self.least = conv_id if self.least is None or conv_id < self.least else self.least


def walk(rows: Iterator[tuple[bytes, int, list[int]]], skeleton: Skeleton) -> Iterator[tuple]:
    """The nodes and partial rows of one shard's sorted (path, id, code points of each turn)."""
    stack = [_Open(b"", 0, 0)]

    def run_of(node: _Open) -> tuple:
        ids, node.ends = node.ends, []
        return (ENDS, node.num, ids[0], None, None, None, None, None, None, None, ",".join(map(str, ids)))

    def close() -> Iterator[tuple]:
        node, depth = stack.pop(), len(stack)
        if node.num >= 0:
            if node.ends:
                yield run_of(node)
            yield (PARTIAL, node.num, node.least, depth, None, node.n, node.children, node.leaves, node.saved,
                   node.chars, None)
        else:
            node.leaves = node.leaves if node.children else 1
            node.saved += (node.n - 1) * node.chars
            for child in node.held:
                yield (*child[:4], node.least, *child[5:])
        if not stack:
            return
        up = stack[-1]
        up.seen(node.least, node.n)
        if node.num < 0:
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            row = (NODE, up.num, node.least, depth, None, node.n, node.children, node.leaves, node.saved, None,
                   node.hash.hexdigest() if node.hash else NO_ENDS)
            if up.num >= 0:
                yield row                                # the parent is named by its number
            else:
                up.held.append(row)

    for path, conv_id, chars in rows:
        depth = 0
        steps = len(path) // STEP
        while depth < steps and depth + 1 < len(stack) and stack[depth + 1].step == path[STEP * depth:STEP * depth + STEP]:
            depth += 1
        while len(stack) > depth + 1:
            yield from close()
        for d in range(depth, steps):
            step = path[STEP * d:STEP * d + STEP]
            up = stack[-1].num
            stack.append(_Open(step, skeleton.below.get((up, step), -1) if up >= 0 else -1, chars[d]))
        last = stack[-1]
        last.seen(conv_id)
        if last.num >= 0:
            last.ends.append(conv_id)
            if len(last.ends) >= RUN:
                yield run_of(last)
        elif last.hash is None:
            last.hash = hashlib.sha256(str(conv_id).encode())
        else:
            last.hash.update(f",{conv_id}".encode())
    if stack[0].n or len(stack) > 1:
        while stack:
            yield from close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def _hash_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's runs, which come in order."""
    now, digest = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([now], type=pa.int32()), pa.array([digest.hexdigest()])],
                                          names=["num", "ends_sha256"])

    for batch in batches:
        for num, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if num != now:
                if digest is not None:
                    yield done()
                now, digest = num, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if digest is not None:
        yield done()


def trie(convs: DataFrame, per_shard: int = PER_SHARD) -> DataFrame:
    """One row per node of the conversations (``conv_id``, ``steps``).

    ``conv_id`` (smallest member; with ``depth`` it names the node and its last
    turn), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens``, ``ends_sha256`` (of the ids that end here, ascending, joined by commas).
    """
    spark = convs.sparkSession
    path = F.unhex(F.array_join(F.transform("steps", lambda s: s["step"]), ""))
    paths = cut(convs.select(path.alias("path"), "conv_id", F.transform("steps", lambda s: s["chars"]).alias("chars")), "paths")
    n = paths.count()
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = min(MOST_SHARDS, max(min(width, n // 64), -(-n // per_shard)))
    skeleton = Skeleton(splitters(paths, shards))
    shared = spark.sparkContext.broadcast(skeleton)      # at most DEEP nodes for each of MOST_SHARDS splitters

    def deal(batches):
        own = shared.value
        for batch in batches:
            where = [own.shard(p, i) for p, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(where, type=pa.int32()), *batch.columns],
                                             names=["shard", "path", "conv_id", "chars"])

    def build(batches):
        def rows():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns))

        def shards_of():                                 # consecutive rows of one shard
            now = next(source, None)
            while now is not None:
                shard, held = now[0], [now]

                def own():
                    row = held[0]
                    while row is not None and row[0] == shard:
                        yield row[1:]
                        row = held[0] = next(source, None)

                yield own()
                now = held[0]

        source, out = rows(), []
        for own in shards_of():
            for row in walk(own, shared.value):
                out.append(row)
                if len(out) >= 5000:
                    yield _batch(out)
                    out = []
        if out:
            yield _batch(out)

    dealt = paths.mapInArrow(deal, "shard int, path binary, conv_id long, chars array<int>")
    sorted_ = dealt.repartition(max(shards, 1), "shard").sortWithinPartitions("shard", "path", "conv_id")
    made = cut(sorted_.mapInArrow(build, _DDL), "trie")

    info = spark.createDataFrame(skeleton.rows(), "num int, s_depth int, parent int, below int, ups array<int>")
    partial = (made.filter(F.col("kind") == PARTIAL).groupBy("num")
               .agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")),
                    F.max("chars").alias("chars")))
    tops = cut(partial.join(F.broadcast(info), "num")
               .select("num", "parent", F.col("s_depth").alias("depth"), "ups", "conv_id", "n_convs",
                       (F.col("n_children") + F.col("below")).alias("n_children"),
                       (F.col("n_leaves") + (F.col("n_children") + F.col("below") == 0).cast("long")).alias("own_leaves"),
                       (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("own_saved")), "skeleton")
    under = (tops.select(F.explode("ups").alias("num"), "own_leaves", "own_saved").groupBy("num")
             .agg(F.sum("own_leaves").alias("n_leaves"), F.sum("own_saved").alias("saved_tokens")))
    ends = (made.filter(F.col("kind") == ENDS).repartition("num").sortWithinPartitions("num", "conv_id")
            .select("num", "ends").mapInArrow(_hash_runs, "num int, ends_sha256 string"))
    names = tops.select(F.col("num").alias("parent"), F.col("conv_id").alias("top_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    upper = (tops.join(under, "num").join(ends, "num", "left").join(names, "parent", "left")
             .select("conv_id", "depth", F.col("top_conv_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                     "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
    # Names are as few as the skeleton's nodes.
    lower = (made.filter(F.col("kind") == NODE).join(F.broadcast(names), F.col("num") == F.col("parent"), "left")
             .select("conv_id", "depth", F.coalesce("parent_conv_id", "top_conv_id").alias("parent_conv_id"), "n_convs",
                     "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")))
    return upper.select(*columns).union(lower.select(*columns)).withColumn("depth", F.col("depth").cast("long"))
