"""Exact Jaccard self-join of word n-gram sets, and the groups it links (operator 10).

Token-combination prefixes.  Tokens are the 64-bit hashes of a document's
distinct n-grams, in a global order from rare to frequent.  Two sets of sizes
x >= y with Jaccard similarity of at least t share k tokens or more within
their first |s| - ceil(t |s|) + k tokens (the prefix, extended by k - 1).
With k = 2:

* a token that few groups share is *rare*: it is indexed alone;
* a token that many groups share is *frequent*: pairs of frequent tokens of an
  extended prefix are indexed instead.

A similar pair shares two tokens; if one is rare it meets there, else it meets
at a pair of frequent tokens.  What meets, passes the length and positional
bounds and is not linked already is verified on whole texts.

Copies cost little: documents with equal sets are one class; classes that
share a min-hash are first verified against the one of most common tokens
among them (of near copies, their source) and linked; and then only keys that join *different* groups are kept, the largest group of
a key meeting the rest but not itself.  Neither step takes a decision that the
exact one would not: links are verified, and pairs are left out only if they
are connected already.

The order comes from counts of all documents' tokens in ``COUNTERS`` hashed
counters (any order gives the same result).  Two different n-grams share a
hash with a probability of 2**-64.

Defined results: a null text has no words; a document without words has an
empty set, is linked with nothing and is its own group; fewer than n words
form one n-gram; a null id is never the smallest of a group that has another;
repeated rows are equal sets, hence one group; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, drop, free_name, release
from .components import components
from .words import Words, mix, ngrams, runs

COUNTERS = 1 << 22
_PARTS = 16
#: Min-hashes for the first links; groups that share a token from which on it counts as frequent.
MINHASHES, FREQUENT = 6, 64
ROW = ["none", "id", "version"]


def shingles(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, token) of every distinct n-gram, sorted by both."""
    w = Words(texts)
    h = w.hashes()
    gram, text = ngrams(h, w.text, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    first = np.cumsum(w.counts) - w.counts
    for size in range(1, n):                             # whole short texts, with their length mixed in
        own = short[w.counts[short] == size]
        if len(own):
            value = np.full(len(own), size, dtype=np.uint64)
            for k in range(size):
                value = mix(value * np.uint64(0xA24BAED4963EE407) + h[first[own] + k])
            gram, text = np.concatenate((gram, value)), np.concatenate((text, own))
    order = np.lexsort((gram, text))
    gram, text = gram[order], text[order]
    if len(gram):
        new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (text[1:] != text[:-1])))
        gram, text = gram[new], text[new]
    return text, gram


def _bounds(text: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(text, np.arange(n + 1))


def signatures(gram: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set (of any order)."""
    sums = np.zeros(len(gram) + 1, dtype=np.uint64)
    np.cumsum(mix(gram + np.uint64(0x5851F42D4C957F2D)), out=sums[1:])
    size = np.diff(bounds).astype(np.uint64)
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + (size << np.uint64(32)))


def profile(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Of each document its set's size, signature and min-hashes; of each task the counts of its tokens.

    Rows of counts have ``part`` and ``counts`` and no document.
    """
    step = COUNTERS // _PARTS
    names = ["doc_id", "version", "n", "node", "minhash", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]

    def run(batches):
        counters = np.zeros(COUNTERS, dtype=np.uint32)
        for batch in batches:
            ids, versions = batch.column(0), batch.column(1)
            done = 0
            for part in runs([(t or "").encode() for t in batch.column(2).to_pylist()]):
                text, gram = shingles(part, n)
                np.add.at(counters, (gram % np.uint64(COUNTERS)).astype(np.int64), np.uint32(1))
                bounds = _bounds(text, len(part))
                size = np.diff(bounds)
                node = signatures(gram, bounds).view(np.int64)
                full = np.flatnonzero(size)
                least = np.zeros((len(part), MINHASHES), dtype=np.int64)
                for k in range(MINHASHES if len(full) else 0):
                    value = mix(gram ^ mix(np.full(1, k + 1, dtype=np.uint64)))
                    least[full, k] = mix(np.minimum.reduceat(value, bounds[full]) + np.uint64(k)).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * MINHASHES),
                                                pa.array(least.ravel()))
                none = [pa.nulls(len(part), type=k) for k in kinds[5:]]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(done, len(part)), versions.slice(done, len(part)), pa.array(size, type=pa.int32()), pa.array(node), flat, *none],
                    names=names)
                done += len(part)
        for p in range(_PARTS):
            own = counters[p * step:(p + 1) * step]
            if own.any():
                row = [None, None, None, None, None, p, _packed(own)]
                yield pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds)], names=names)

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("version"),
                        F.col(text_col).alias("text"))
            .mapInArrow(run, "doc_id long, version long, n int, node long, minhash array<long>, part int, counts binary"))


def _packed(counts: np.ndarray) -> bytes:
    """Counts as bytes; those of one task are mostly zeros."""
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum the counters of a group, batch by batch."""
    total = np.zeros(COUNTERS // _PARTS, dtype=np.int64)
    for batch in batches:
        for c in batch.column(batch.schema.get_field_index("counts")):
            total += np.frombuffer(zlib.decompress(c.as_py()), dtype="<i8")
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], type=pa.int32()), pa.array([_packed(total)])],
                                     names=["part", "counts"])


def frequencies(profiled: DataFrame) -> np.ndarray:
    """The counters of all tasks together, as steps of a quarter of a power of two (one byte each)."""
    rows = profiled.filter("part IS NOT NULL").select("part", "counts", (F.spark_partition_id() % 32).alias("lot"))
    rows = rows.groupBy("part", "lot").applyInArrow(_add, "part int, counts binary")
    step = COUNTERS // _PARTS
    out = np.zeros(COUNTERS, dtype=np.uint8)
    for r in rows.groupBy("part").applyInArrow(_add, "part int, counts binary").collect():   # _PARTS rows
        counts = np.frombuffer(zlib.decompress(r.counts), dtype="<i8").astype(np.float64)
        out[r.part * step:(r.part + 1) * step] = np.minimum(255, np.floor(4 * np.log2(counts + 1)))
    return out


def prefixes(docs: DataFrame, n: int, percent: int, level: np.ndarray, text_col: str) -> DataFrame:
    """(``node``, ``n``, ``common``, ``keys`` array<int>): the extended prefix of every set, rare tokens first.

    ``common`` is the mean level of its tokens: of near copies, the text that the
    others were made from has the highest.

    Keys are 32 bits of the tokens: a clash only brings a candidate more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        order_of, seen = shared.value, set()
        for batch in batches:
            for part in runs([(t or "").encode() for t in batch.column(0).to_pylist()]):
                text, gram = shingles(part, n)
                bounds = _bounds(text, len(part))
                size = np.diff(bounds)
                node = signatures(gram, bounds).view(np.int64)
                rank = order_of[(gram % np.uint64(COUNTERS)).astype(np.int64)].astype(np.uint64)
                common = 1000 * np.bincount(text, weights=rank, minlength=len(part)) // np.maximum(size, 1)
                order = np.lexsort((gram, rank, text))
                place = np.arange(len(gram)) - np.repeat(bounds[:-1], size)
                upto = size + (-percent * size) // 100 + 2            # |s| - ceil(t |s|) + k
                fresh = np.zeros(len(part), dtype=bool)
                for i in np.flatnonzero(size).tolist():
                    if node[i] not in seen:
                        seen.add(node[i])
                        fresh[i] = True
                keep = (place < np.repeat(upto, size)) & np.repeat(fresh, size)
                keys = (gram[order][keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                count = np.minimum(upto, size)[fresh]
                ends = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[fresh]), pa.array(size[fresh], type=pa.int32()),
                     pa.array(common[fresh].astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))], names=["node", "n", "common", "keys"])

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "node long, n int, common int, keys array<int>")
    return found.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "common", "keys")])


def _row(doc_id: Column, version: Column) -> list[Column]:
    """What tells a row's id and text, as columns that are never null (``ROW``)."""
    return [doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0)).alias("id"), version.alias("version")]


def verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int, id_col: str,
           text_col: str) -> DataFrame:
    """The pairs of nodes (``a``, ``b``) whose sets are similar enough, by their whole texts."""
    doc_id = F.col(id_col).cast("long")
    texts = docs.select(*_row(doc_id, F.xxhash64(text_col)), F.col(text_col).alias("text"))
    reps = classes.select("node", *_row(F.col("rep.doc_id"), F.col("rep.version")))
    wanted = (reps.join(pairs.select(F.explode(F.array("a", "b")).alias("node")), "node", "left_semi")
              .select(*ROW))
    # A row that is repeated, as copies without an id are, counts once.
    texts = texts.join(wanted, ROW, "left_semi").groupBy(*ROW).agg(F.first("text").alias("text"))
    for side in "ab":
        own = [f"{c}_{side}" for c in ROW]
        pairs = (pairs.join(reps.toDF(side, *own), side).join(texts.toDF(*own, f"text_{side}"), own))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                a, b, ta, tb = (c.to_pylist() for c in part.columns)
                texts = [(t or "").encode() for two in zip(ta, tb) for t in two]
                text, gram = shingles(texts, n)
                bounds = _bounds(text, len(texts))
                size = np.diff(bounds)
                node = signatures(gram, bounds).view(np.int64)
                pair = text // 2
                order = np.lexsort((gram, pair))
                g, p = gram[order], pair[order]
                equal = (g[1:] == g[:-1]) & (p[1:] == p[:-1])
                both = np.bincount(p[1:][equal], minlength=len(a))
                union = size[::2] + size[1::2] - both
                # Texts are found by a hash; those of the classes meant count.
                good = (100 * both >= percent * union) & (node[::2] == a) & (node[1::2] == b)
                at_ = np.flatnonzero(good)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(a, dtype=np.int64)[at_]),
                                                  pa.array(np.array(b, dtype=np.int64)[at_])], names=["a", "b"])

    return (pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long").distinct())


def first_links(classes: DataFrame, prefixed: DataFrame) -> DataFrame:
    """Pairs to verify first: every class with the one of most common tokens that shares a min-hash."""
    keys = (classes.select("node", F.explode("minhash").alias("key"))
            .join(prefixed.select("node", "common"), "node"))
    lead = (keys.groupBy("key").agg(F.max(F.struct("common", "node")).alias("lead"), F.count("*").alias("many"))
            .filter("many > 1").select("key", F.col("lead.node").alias("b")))
    return keys.join(lead, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _meet(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes of different groups that share a key and pass the length and positional bounds.

    ``rows``: key, node, comp, n, pos, before.  The largest group of a key meets the
    others, not itself.  A pair is wanted at the first key it shares; of what lies
    before that key, only tokens that are indexed otherwise can be shared
    (``before``, how many of them a set has).
    """
    by_group = rows.groupBy("key", "comp").agg(F.count("*").alias("many"))
    home = by_group.groupBy("key").agg(F.max_by("comp", "many").alias("home"))
    tagged = rows.join(home, "key")
    few = tagged.filter("comp <> home").select(*(F.col(c).alias(f"l_{c}") for c in ("node", "comp", "n", "pos", "before")), "key")
    both = few.join(tagged, "key").filter("l_comp <> comp AND (comp = home OR l_node < node)")
    shared_most = (F.least("before", "l_before") + 1
                   + F.least(F.col("n") - F.col("pos") - 1, F.col("l_n") - F.col("l_pos") - 1))
    close = ((F.lit(100) * F.least("n", "l_n") >= F.lit(percent) * F.greatest("n", "l_n"))
             & (F.lit(100 + percent) * shared_most >= F.lit(percent) * (F.col("n") + F.col("l_n"))))
    return (both.filter(close).select(F.greatest("node", "l_node").alias("a"), F.least("node", "l_node").alias("b")))


def _by_set(rows: DataFrame) -> DataFrame:
    """(``node``, ``n``, ``comp``, ``often``, ``alone``): the tokens (pos, key) of each set that ``FREQUENT`` groups or more share, and its others."""
    tokens = F.array_sort(F.collect_list(F.struct("pos", "key", "groups")))      # at most a prefix
    held = rows.groupBy("node", "n", "comp").agg(tokens.alias("tokens"))

    def kept(wanted):
        return F.transform(F.filter("tokens", wanted), lambda t: F.struct(t["pos"].alias("pos"), t["key"].alias("key")))

    return held.select("node", "n", "comp", kept(lambda t: t["groups"] >= FREQUENT).alias("often"),
                       kept(lambda t: t["groups"] < FREQUENT).alias("alone"))


def candidates(prefixed: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of nodes of different groups that the prefix index brings together."""
    held = (prefixed.join(groups, "node", "left")
            .select("node", "n", F.coalesce("comp", "node").alias("comp"), "keys"))
    rows = held.select("node", "n", "comp", F.posexplode("keys").alias("pos", "key"))
    joining = (rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
               .filter("lo <> hi").select("key"))
    rows = cut(rows.join(joining, "key"), "index")       # tokens that join different groups: few
    spread = rows.groupBy("key", "comp").count().groupBy("key").agg(F.count("*").alias("groups"))
    by_set = cut(_by_set(rows.join(spread, "key")), "index")     # read for each side of what meets
    singles = (by_set.select("node", "n", "comp", F.size("often").alias("before"), F.explode("alone").alias("one"))
               .select("node", "n", "comp", "one.pos", "one.key", "before"))
    two = (by_set.select("node", "n", "comp", F.col("often").alias("tokens"), F.posexplode("often").alias("i", "one"))
           .select("node", "n", "comp", "one", F.explode(F.expr("slice(tokens, i + 2, size(tokens))")).alias("other"))
           .select("node", "n", "comp", F.xxhash64("one.key", "other.key").alias("key"), F.col("one.pos").alias("pos"),
                   F.lit(0).alias("before")))
    joining = (two.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
               .filter("lo <> hi").select("key"))
    pairs = _meet(two.join(joining, "key"), percent)
    return _meet(singles.withColumn("key", F.col("key").cast("long")), percent).union(pairs).distinct()


def link(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text",
         ) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets and the groups that links make of them.

    Returns (documents, labels): every row of ``docs`` as (``doc_id``, ``version``, a
    hash of the text, ``n``, ``node``), and (``node``, ``comp``, ``component_id``) of every class: a name of
    its group and the group's smallest id, null if it has none.  Two sets are linked
    when 100 * |intersection| >= percent * |union|.
    """
    profiled = cut(profile(docs, n, id_col, text_col), "profile")
    level = frequencies(profiled)
    rows = profiled.filter("part IS NULL")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version")
    classes = cut(rows.filter("n > 0").groupBy("node").agg(F.min(place).alias("rep"), F.first("minhash").alias("minhash")),
                  "classes")
    prefixed = cut(prefixes(docs, n, percent, level, text_col), "prefixes")
    release(docs.sparkSession)
    first = cut(first_links(classes, prefixed), "first")
    release(docs.sparkSession, last=True)                # on small tables the driver made many broadcasts
    links = cut(verify(first, classes, docs, n, percent, id_col, text_col), "links")
    drop(first)
    groups = components(links)
    release(docs.sparkSession)
    pairs = cut(candidates(prefixed, groups, percent), "pairs")
    release(docs.sparkSession)
    more = verify(pairs, classes, docs, n, percent, id_col, text_col)
    every = cut(links.union(more), "links")
    drop(links, pairs)
    labelled = classes.select("node", F.col("rep.doc_id").alias("rep")).join(components(every), "node", "left")
    named = labelled.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("rep").alias("least"))
    labels = (labelled.join(named, "comp", "left")
              .select("node", F.coalesce("comp", "node").alias("comp"), F.coalesce("least", "rep").alias("component_id")))
    return rows.select("doc_id", "version", "n", "node"), labels


def join(docs: DataFrame, n: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id`` (the smallest id of its group)."""
    rows, labels = link(docs, n, percent, id_col, text_col)
    named = rows.join(labels, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return named.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id (and text hash, if ids repeat).

    Documents without words all stay; rows that repeat an id and text are one
    document, of which one row stays.
    """
    rows, labels = link(docs, n, percent, id_col, text_col)
    named = cut(rows.filter("n > 0").join(labels, "node")
                .select("comp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "version").alias("row")), "named")
    first = named.groupBy("comp").agg(F.min("row").alias("first"))
    gone = (named.join(first, "comp").filter("row <> first").select("row.doc_id", "row.version").distinct())
    a, b, c = (free_name(docs, x) for x in ("version", "g_doc", "g_version"))
    gone = gone.toDF(b, c)
    match = F.col(b).eqNullSafe(F.col(id_col).cast("long")) & (F.col(a) == F.col(c))
    kept = docs.withColumn(a, F.xxhash64(text_col)).join(gone, match, "left_anti")
    # Rows that repeat an id and text are copies of few: only they are brought together.
    again = rows.groupBy("doc_id", "version").count().filter("count > 1").select("doc_id", "version").toDF(b, c)
    first = kept.join(again, match, "left_semi").dropDuplicates([id_col, a])
    return kept.join(again, match, "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))
