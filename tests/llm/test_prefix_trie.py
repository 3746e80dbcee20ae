import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from cabmart.llm import prefix_trie as T
from conftest import SF_MIDDLE, SF_SMALL
from pyspark.sql import functions as F


def plain(paths):
    """{(smallest member, depth): row} of {conversation: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        gain = (len(own) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += gain
    out = {}
    for node, own in members.items():
        ends = sorted(c for c in own if len(paths[c]) == len(node))
        out[min(own), len(node)] = (min(members[node[:-1]]) if node else None, len(own), kids[node], leaves[node], saved[node],
                                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(got) == len(rows)
    return got


def frame(spark, paths):
    rows = [(c, i, role, text) for c, path in paths.items() for i, (role, text) in enumerate(path)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("seed, per_shard", [(1, 7), (2, 40), (3, 10_000)])
def test_against_plain_python(spark, monkeypatch, seed, per_shard):
    monkeypatch.setattr(T, "RUN", 3)
    rnd = random.Random(seed)
    turns = [(role, "t" * k) for role in ("user", "assistant") for k in range(4)]
    paths = {i: [rnd.choice(turns) for _ in range(rnd.randrange(1, 7))] for i in rnd.sample(range(10 ** 6), 150)}
    hot = [turns[1], turns[2], turns[3]]
    paths |= {-i: hot[:] for i in range(1, 120)}          # a group of equal ones that many shards share
    paths |= {2 * 10 ** 6 + i: hot + [("user", f"own {i}")] for i in range(60)}
    paths[77 * 10 ** 6] = [("user", str(i)) for i in range(500)]
    paths[78 * 10 ** 6] = [("user", str(i)) for i in range(499)]
    convs = T.conversations(frame(spark, paths).repartition(4))
    assert found(T.trie(convs, per_shard)) == plain(paths)


def rebuilt(table, block=100):
    own = defaultdict(list)
    for c, turn, role, text in table:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % block, [])[:h] + ts[h:]
    return out


@pytest.mark.parametrize("sf", [SF_SMALL, SF_MIDDLE])
def test_query(spark, queries, small, sf):
    rows = small("conversations", "conv_id, turn, role, text", sf)
    assert found(queries["op12_prefix_trie"](spark, sf)) == plain(rebuilt(rows))


def test_edge_cases(spark):
    rows = [(100, 1, "user", "a"), (100, None, None, "first"), (107, 2, "user", None), (107, 1, "", ""), (None, 1, "user", "lost"),
            (305, 1, "user", "x" * 300_000), (305, 1, "user", "x" * 300_000), (306, 1, "us", "er"), (306, 2, "u", "ser")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS num", "'s' AS steps")
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = T.with_shared_heads(T.conversations(df), 100, first, 5)
    want = plain(rebuilt([r for r in rows if r[0] is not None]))
    assert found(T.trie(convs)) == want
    # 305 and 306 have no first conversation of their block: turns taken from it are missing.
    assert want[min(c for c, d in want if d == 0), 0][1] == 4
    empty = T.with_shared_heads(T.conversations(df.filter("false")), 100, first, 5)
    assert T.trie(empty).count() == 0
    whole = T.trie(T.conversations(df))
    assert found(whole) == plain({
        100: [("", "first"), ("user", "a")], 107: [("", ""), ("user", "")], 305: [("user", "x" * 300_000)] * 2,
        306: [("us", "er"), ("u", "ser")]})


def test_shards_are_even_and_the_skeleton_is_bounded(spark):
    paths = {i: [("user", "same")] * 3 for i in range(4000)}
    convs = T.conversations(frame(spark, paths))
    path = F.unhex(F.array_join(F.transform("steps", lambda s: s["step"]), ""))
    cuts = T.splitters(convs.select(path.alias("path"), "conv_id"), 20)
    skeleton = T.Skeleton(cuts)
    p = cuts[0][0]
    sizes = defaultdict(int)
    for c in paths:
        sizes[skeleton.shard(p, c)] += 1
    assert len(skeleton.parent) == 4 and max(sizes.values()) < 4 * 4000 / 20
