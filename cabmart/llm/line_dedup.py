"""Near-duplicate lines removed by an exact set-similarity join, in Spark's own functions (operator 7).

A line's set is its distinct lower-cased words.  A line is removed if a line
before it (by document id, then line number) has a Jaccard similarity of at
least ``percent`` / 100 with it.

1. Words are counted exactly.  The ``KEPT`` most frequent ones get a level by
   their count; the others count as rare.  A token is its word's level, then 57 bits of its
   hash, so a sorted array of tokens has the rare words first.
2. Lines with equal sets are one set, of which the first line is kept.  Sets that
   are too small to be similar to any other go no further.
3. Prefix filter: two similar sets share a token among their first
   n - ceil(t n) + 1, the keys.  On a shared key the length and positional filters
   and a bitmap must allow the overlap.  (The bitmap has a bit for the parity of the tokens
   that hash to it; two sets differ in as many tokens at least as their bitmaps in bits.)
4. A key of fewer than ``HOT`` sets brings all its sets together.  On a hotter
   key each set first meets the earliest one only; sets that this removes need
   no further partner.  So a line with thousands of variants costs
   its count, not the square of it.  The others meet the sets that share a second token as well: two similar sets
   of a common word share two tokens among their first n - ceil(t n) + 2, so what a hot key brings together
   does not grow with the square of the word's count.
5. Candidates are verified on whole lines, and documents are put together
   again without the lines removed.

Only DataFrame functions are used.  Two words share a token with a probability
of 2**-57.

Defined results: a null text stays null; a line without words stays; a text that
loses every line is empty; rows that repeat an id and text are one document and
keep the same lines; texts that share an id are ordered by a hash; documents
without an id come last; an empty table gives an empty table; other columns pass
through.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import cut, drop, free_name, release

#: Most frequent words that have a level of their own, and places of the table that holds the levels.
KEPT, PLACES = 1 << 17, 1 << 20
#: Sets from which on a key is hot: a row of the index meets fewer than that many by its key, however large the corpus.
HOT = 256
#: Parts that the index is joined in, by its keys (a power of two): the shuffle files of one part lie on the disk at a time.
PARTS = 4
_SPACE = " \t\x0b\f\r"


def _words(line: Column) -> Column:
    return F.split(F.trim(F.lower(line), F.lit(_SPACE)), r"[ \t\x0B\f\r]+")


def word_levels(texts: DataFrame) -> DataFrame:
    """A level of 0 (rare) to 63 for every place that words hash to: that of the most frequent word there.

    One row, a lineage cut, with the levels as bytes (``levels``).  At most ``KEPT`` words come to the driver, those of the highest exact counts.
    """
    words = texts.select(F.explode(F.split(F.lower("text"), r"[ \t\n\x0B\f\r]+")).alias("word"))
    counted = cut(words.groupBy(F.xxhash64("word").alias("h")).count().filter("count > 1"), "words")
    total, least = 0, 2
    for r in counted.groupBy("count").agg(F.count("*").alias("n")).orderBy(F.desc("count")).toLocalIterator():
        total += r.n                                     # words that occur so often or more
        if total > KEPT:
            least = r["count"] + 1
            break
    levels = bytearray(PLACES)
    place = F.col("h").bitwiseAND(F.lit(PLACES - 1)).alias("place")
    # (Lists of numbers: a row object a word would take the driver several times as much.)
    best = counted.filter(F.col("count") >= least).select(place, "count").groupBy("place").agg(F.max("count").alias("n"))
    packed = best.groupBy((F.col("place") % 64).alias("lot")).agg(F.collect_list("place").alias("places"), F.collect_list("n").alias("counts"))
    for r in packed.toLocalIterator():
        for p, n in zip(r.places, r.counts):
            levels[p] = min(63, 1 + int(2 * math.log2(n / least)))
    drop(counted)
    return cut(texts.sparkSession.createDataFrame([(levels,)], "levels binary"), "levels")


def _tokenized(lines: DataFrame, levels: DataFrame) -> DataFrame:
    """``lines`` with the sorted distinct tokens of ``body``, rare words first, as ``tokens`` in its place.

    The levels are a subquery of one value: as a literal, each printed plan that the
    driver keeps would hold them in full, several times.
    """
    def token(h):
        level = F.ascii(F.substring("levels", h.bitwiseAND(F.lit(PLACES - 1)).cast("int") + 1, F.lit(1)).cast("string"))
        return F.shiftleft(level.cast("long"), 57).bitwiseOR(h)

    hashed = F.transform(_words(F.col("body")), lambda w: F.xxhash64(w).bitwiseAND(F.lit((1 << 57) - 1)))
    tokens = F.sort_array(F.transform(F.array_distinct(hashed), token))
    rest = [c for c in lines.columns if c != "body"]
    return lines.withColumn("levels", levels.scalar()).select(*rest, tokens.alias("tokens"))


def _bitmap(tokens: Column) -> Column:
    """A bit for each of 64 values of a token's hash: set if an odd number of tokens has it."""
    bit = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(t, 40).bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda bits, t: bits.bitwiseXOR(bit(t)))


def _prefix_size(percent: int) -> Column:
    n = F.col("n")
    return n - F.floor((n * percent + 99) / 100).cast("int") + 1


def _close(percent: int) -> Column:
    """Length, positional and bitmap filter of two sets (l_n, l_at, l_bits) and (n, at, bits) that share a token there.

    The positions hold where the token is the first that both share; at a later one, what
    precedes it could be shared as well, and the pair is found at the first.
    """
    most = 1 + F.least(F.col("n") - F.col("at") - 1, F.col("l_n") - F.col("l_at") - 1)
    both = F.col("n") + F.col("l_n")
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("l_bits")))
    return ((100 * F.least("n", "l_n") >= percent * F.greatest("n", "l_n"))
            & ((100 + percent) * most >= percent * both)
            & ((100 + percent) * apart <= (100 - percent) * both))


def _two_token_keys(hot: DataFrame, sets: DataFrame, gone: DataFrame, percent: int) -> DataFrame:
    """(``key``, ``set``, ``n``, ``bits``, ``at``, ``open``): each hot token at ``at`` with every later token of the extended prefix.

    The first two tokens that similar sets share are among the first n - ceil(t n) + 2 of both,
    if they share two.  Sets that may share one only with a similar one also have that token alone.
    Sets are open that are not ``gone``.
    """
    asked = (hot.groupBy("set").agg(F.collect_set("at").alias("ats"))        # at most a prefix
             .join(gone.withColumn("gone", F.lit(True)), "set", "left"))
    rows = (sets.join(asked, "set")
            .select("set", "n", "bits", "prefix", F.col("gone").isNull().alias("open"), F.explode("ats").alias("at")))
    first = F.element_at("prefix", F.col("at") + 1)
    keys = F.transform(F.slice("prefix", F.col("at") + 2, F.size("prefix")), lambda token: F.xxhash64(first, token))
    alone = F.when(F.col("n") * percent <= 100, F.array(F.xxhash64(first))).otherwise(F.array().cast("array<bigint>"))
    return rows.select(F.explode(F.concat(keys, alone)).alias("key"), "set", "n", "bits", "at", "open")


def _met_again(index: DataFrame, percent: int) -> DataFrame:
    """Pairs (``a``, ``b``) of the open sets of a key with all sets of it."""
    by_key = W.partitionBy("key")
    index = (index.withColumn("many", F.count("*").over(by_key)).withColumn("some", F.max("open").over(by_key))
             .filter("many > 1 AND some"))
    return (_left(index.filter("open")).join(index, "key").filter((F.col("l_set") != F.col("set")) & _close(percent))
            .select(F.least("l_set", "set").alias("a"), F.greatest("l_set", "set").alias("b")).distinct())


def _left(rows: DataFrame) -> DataFrame:
    return rows.select("key", *(F.col(c).alias(f"l_{c}") for c in ("set", "n", "at", "bits")))


def _tokens_of(asked: DataFrame, sets: DataFrame, texts: DataFrame, levels: DataFrame) -> DataFrame:
    """(``set``, ``first``, ``tokens``) of the sets asked for, from their first lines."""
    wanted = sets.join(asked, "set", "left_semi").select("set", "first")
    some = (wanted.groupBy(F.col("first.doc").alias("w_doc"), F.col("first.version").alias("w_version"))
            .agg(F.collect_list(F.struct(F.col("first.line").alias("line"), "set", "first")).alias("wanted")))
    match = F.col("w_doc").eqNullSafe(F.col("doc")) & (F.col("w_version") == F.col("version"))
    # A generator keeps the optimizer from splitting a text again for each of its lines.
    split = texts.join(some, match).select("wanted", F.explode(F.array(F.split("text", "\n"))).alias("split"))
    found = split.select(F.explode(F.transform("wanted", lambda w: F.struct(
        w["set"].alias("set"), w["first"].alias("first"),
        F.element_at("split", w["line"] + 1).alias("body")))).alias("w")).select("w.*")
    # Rows that repeat an id and text have the same line.
    one = _tokenized(found, levels)
    return one.groupBy("set").agg(F.first("first").alias("first"), F.first("tokens").alias("tokens"))


def _later(pairs: DataFrame, tokens: DataFrame, percent: int) -> DataFrame:
    """The later set (``set``) of each pair that is similar enough."""
    for side in "ab":
        pairs = pairs.join(tokens.select(*(F.col(c).alias(f"{side}_{c}") for c in ("set", "first", "tokens"))),
                           F.col(side) == F.col(f"{side}_set"))
    both = F.size(F.array_intersect("a_tokens", "b_tokens"))
    union = F.size("a_tokens") + F.size("b_tokens") - both
    later = F.when(F.col("a_first") > F.col("b_first"), F.col("a")).otherwise(F.col("b"))
    return pairs.filter(100 * both >= percent * union).select(later.alias("set")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, levels: DataFrame, percent: int) -> DataFrame:
    tokens = cut(_tokens_of(pairs.select(F.explode(F.array("a", "b")).alias("set")), sets, texts, levels), "tokens")
    release(texts.sparkSession, last=True)               # whole texts were shuffled
    gone = cut(_later(pairs, tokens, percent), "gone")
    drop(tokens)
    return gone


def _met(index: DataFrame, percent: int) -> DataFrame:
    """What meets on the keys of ``index``, or of a part of it that has all rows of its keys (one exchange serves all below).

    Rows with ``a`` and ``b`` are pairs; rows with ``hot`` are the sets of hot keys, and where in the prefix the key is.
    """
    by_key = W.partitionBy("key")
    index = (index.withColumn("many", F.count("*").over(by_key))
             .withColumn("lead", F.min(F.struct("doc", "set", "n", "at", "bits")).over(by_key)))
    cold = index.filter((F.col("many") > 1) & (F.col("many") < HOT) & F.col("lead").isNotNull())
    hot = index.filter(F.col("many") >= HOT)
    met = (_left(cold).join(cold, "key").filter((F.col("l_set") < F.col("set")) & _close(percent))
           .select(F.col("l_set").alias("a"), F.col("set").alias("b"), F.lit(None).cast("long").alias("hot"), F.lit(None).cast("int").alias("at")))
    lead = [F.col(f"lead.{c}").alias(f"l_{c}") for c in ("set", "n", "at", "bits")]
    led = hot.select("set", "n", "at", "bits", *lead)
    good = (F.col("l_set") != F.col("set")) & _close(percent)
    led = led.select(F.when(good, F.col("l_set")).alias("a"), F.when(good, F.col("set")).alias("b"), F.col("set").alias("hot"), "at")
    return met.union(led)


def removed_lines(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc``, ``version``, ``lines`` array<int>): the numbers of the lines that go, of documents that lose any."""
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("version"),
                        F.col(text_col).alias("text")).filter("text IS NOT NULL")
    levels = word_levels(texts)
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "version", "line")
    # One pass over the texts: sizes, prefixes, a bitmap and a hash of each line's set.
    lines = texts.select("doc", "version", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    held = _tokenized(lines.filter(F.trim("body", F.lit(_SPACE)) != ""), levels).withColumn("n", F.size("tokens"))
    # A set that one word more or less makes unlike has only equal ones: no prefix.
    # (Extended by a token, for the keys of two.)
    prefix = F.when(100 * F.col("n") >= percent * (F.col("n") + 1), F.slice("tokens", F.lit(1), _prefix_size(percent) + 1))
    whole = cut(held.select("doc", "version", "line", "n", F.xxhash64("tokens").alias("set"), _bitmap(F.col("tokens")).alias("bits"),
                            F.coalesce(prefix, F.array().cast("array<bigint>")).alias("prefix")), "lines")
    sets = cut(whole.groupBy("set").agg(F.min(place).alias("first"), *(F.first(c).alias(c) for c in ("n", "bits", "prefix"))), "sets")
    held = cut(whole.select("set", "doc", "version", "line"), "lines")
    drop(whole)

    index = sets.select("set", "n", "bits", F.coalesce("first.doc", F.lit((1 << 63) - 1)).alias("doc"),
                        F.posexplode(F.slice("prefix", F.lit(1), _prefix_size(percent))).alias("at", "key"))
    parts = []
    for part in range(PARTS):
        own = index.filter(F.col("key").bitwiseAND(F.lit(PARTS - 1)) == part)
        parts.append(cut(_met(own, percent), "met"))
        release(docs.sparkSession)                       # that part of the index was large, what met is less
    met = functools.reduce(DataFrame.union, parts)
    hot = met.filter("hot IS NOT NULL").select(F.col("hot").alias("set"), "at")
    pairs = cut(met.filter("a IS NOT NULL").select("a", "b").distinct(), "pairs")
    release(docs.sparkSession, last=True)
    gone = _verified(pairs, sets, texts, levels, percent)

    # What the leaders of hot keys did not remove meets all sets that share a second token, too.
    again = []
    for part in range(PARTS):
        own = _two_token_keys(hot, sets, gone, percent).filter(F.col("key").bitwiseAND(F.lit(PARTS - 1)) == part)
        again.append(cut(_met_again(own, percent), "pairs"))
        release(docs.sparkSession)
    more = functools.reduce(DataFrame.union, again).distinct()
    drop(met, pairs)
    gone = cut(gone.union(_verified(more, sets, texts, levels, percent)).distinct(), "gone")

    verdict = sets.select("set", "first").join(gone.withColumn("gone", F.lit(True)), "set", "left")
    lost = (held.select("set", "doc", "version", "line").join(verdict, "set")
            .filter(F.coalesce("gone", F.lit(False)) | (place > F.col("first"))))
    out = cut(lost.groupBy("doc", "version").agg(F.collect_set("line").alias("lines")), "lost")
    drop(sets, held, levels, *again)
    return out


def dedup(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
          counts: bool = True) -> DataFrame:
    """``docs`` without near-duplicate lines.

    With ``counts``, ``n_lines`` and ``n_removed`` (long) are added (underscores in front of taken names).
    """
    lost = removed_lines(docs, percent, id_col, text_col).toDF("l_doc", "l_version", "l_lines")
    keys = {c: free_name(docs, c) for c in ("l_doc", "l_version", "l_lines", "n_lines", "n_removed")}
    lost = lost.toDF(*(keys[c] for c in ("l_doc", "l_version", "l_lines")))
    match = (F.col(keys["l_doc"]).eqNullSafe(F.col(id_col))
             & (F.col(keys["l_version"]) == F.xxhash64(F.col(text_col))))
    joined = docs.join(lost, match, "left")
    gone = F.col(keys["l_lines"])
    parts = F.split(F.col(text_col), "\n")
    # Set operations find the lines that stay in one go, however many were lost.
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n")
    text = F.when(gone.isNull(), F.col(text_col)).otherwise(kept)
    out = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if counts:
        out += [F.when(F.col(text_col).isNull(), 0).otherwise(F.size(parts)).cast("long").alias(keys["n_lines"]),
                F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(keys["n_removed"])]
    return joined.select(*out)
