"""Byte-level BPE encoding and decoding over Arrow batches (operator 2).

The merges are done by the tokenizers library.  Its full pipeline spends most
of its time on splitting text and on repeated words, so a batch of texts is
split with numpy (the classes of the published pattern, run by run), every
*distinct* match is encoded once by the library, and the ids of all matches
are gathered from that table.  Distinct matches of earlier batches are kept in
a bounded table of the Python worker.

Model: either a tokenizer file of the library (``.json``; where its added tokens
stand in a text they are one id each, as in the library) or a rank file
(``.tiktoken``).  From ranks, every way to cut a token into two tokens of
lower rank is a merge of that token's rank, and a match that is itself a token
is taken whole: the result is that of the tiktoken library.

Offsets: a token covers whole bytes, not whole characters.  ``starts`` and
``ends`` are character positions of the text: the characters that own the
token's first and last byte.  A character of several tokens belongs to each of
them; ``n_split`` counts the tokens that begin inside a character.

Defined results: a null text counts as empty; an empty text has no ids;
repeated rows each get their own row; an empty table gives an empty table.
Decoding null ids gives no bytes; a null or unknown id raises.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .common import free_name

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Characters handled at once; a longer text is cut where a match surely ends.
CHUNK = 250_000
#: Distinct matches that a worker keeps between batches.
KEPT_MATCHES = 2_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    import regex
    classes = np.zeros(0x110000, dtype=np.uint8)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    at = np.array(points)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            classes[at[m.start():m.end()]] = cls
    return classes


@lru_cache(maxsize=1)
def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_model(ranks: dict[bytes, int]):
    """The library's BPE model that merges as the rank file says."""
    from tokenizers import models
    shown = byte_chars()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.get):
        for cut in range(len(token) - 1, 0, -1):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((name[left], name[right]))
    return models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)


class Codec:
    """Ids of texts and bytes of ids for one vocabulary; one per Python worker."""

    def __init__(self, path: str, kept: int = KEPT_MATCHES):
        from tokenizers import Tokenizer, pre_tokenizers
        if path.endswith(".json"):
            model = Tokenizer.from_file(path).model
            with open(path, encoding="utf-8") as f:
                content = json.load(f)
            vocab = content["model"]["vocab"]
            back = {c: b for b, c in byte_chars().items()}
            tokens = {i: bytes(back[c] for c in t) for t, i in vocab.items() if all(c in back for c in t)}
            self._add(content.get("added_tokens") or [], tokens)
        else:
            self._add([], {})
            ranks = read_ranks(path)
            model = rank_model(ranks)
            tokens = {r: t for t, r in ranks.items()}
        self.words = Tokenizer(model)
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.n_bytes = np.array([len(t or b"") for t in self.tokens], dtype=np.int64)
        self.flat = np.frombuffer(b"".join(t or b"" for t in self.tokens), dtype=np.uint8)
        self.at = np.concatenate(([0], np.cumsum(self.n_bytes)))
        self.kept = kept
        self._forget()
        steps = np.full(CHUNK * 2 + 1, _MUL, dtype=np.uint64)
        steps[0] = 1
        self.powers = np.multiply.accumulate(steps)
        steps[1:] = np.uint64(pow(int(_MUL), -1, 1 << 64))
        self.inverse = np.multiply.accumulate(steps)

    def _add(self, added: list[dict], tokens: dict[int, bytes]):
        """Texts are cut at the file's added tokens, each of which is one id."""
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at what is beside them are not supported")
        self.added = {t["content"]: t["id"] for t in added}
        tokens.update({i: t.encode() for t, i in self.added.items()})
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cuts = re.compile("|".join(map(re.escape, longest_first))) if added else None

    def _cut(self, text: str) -> np.ndarray:
        """Ids of a text that holds added tokens."""
        parts, at = [], 0
        for m in self.cuts.finditer(text):
            parts += [self._whole(text[at:m.start()]), np.array([self.added[m.group()]], dtype=np.uint32)]
            at = m.end()
        return np.concatenate(parts + [self._whole(text[at:])])

    def _whole(self, text: str) -> np.ndarray:
        if len(text) <= CHUNK:
            return self._encode_run([text])[0]
        return np.concatenate([self._encode_chunk(p, np.zeros(1, dtype=np.int64))[0] for p in pieces(text)])

    def _forget(self):
        """Empty the table of known matches: sorted keys, and the entry of each; new ones lie in a small table first."""
        none = np.zeros(0, dtype=np.uint64)
        self.old, self.new = (none, none.astype(np.int64)), (none, none.astype(np.int64))
        self.known = 0
        self.first = np.zeros(1 << 16, dtype=np.int64)
        self.count = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0
        self.ids = np.zeros(1 << 18, dtype=np.uint32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where it is not known."""
        entry = np.full(len(keys), -1, dtype=np.int64)
        for have, entries in (self.old, self.new):
            if len(have):
                at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                hit = have[at] == keys
                entry[hit] = entries[at[hit]]
        return entry

    def _grow(self, size: int):
        """Powers for a single match-free stretch longer than two chunks."""
        while len(self.powers) <= size:
            n = len(self.powers)
            self.powers = np.concatenate((self.powers, self.powers * (self.powers[-1] * _MUL)))
            self.inverse = np.concatenate((self.inverse, self.inverse * (self.inverse[-1] * self.inverse[1])))
            assert len(self.powers) == 2 * n

    def _encode_chunk(self, text: str, doc_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the joined texts and, for each text, how many."""
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        starts = match_starts(points, doc_starts)
        ends = np.append(starts[1:], len(points))
        keys = self._keys(points, starts, ends)
        uniq, where, inverse = np.unique(keys, return_index=True, return_inverse=True)
        entry = self._find(uniq)
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            if self.known + len(fresh) > self.kept:
                self._forget()
                fresh = np.arange(len(uniq))
            at = where[fresh]
            entry[fresh] = self._learn(uniq[fresh], [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())])
        slot = entry[inverse]
        n = self.count[slot]
        total = np.concatenate(([0], np.cumsum(n)))
        pick = np.arange(total[-1]) + np.repeat(self.first[slot] - total[:-1], n)
        per_doc = np.searchsorted(starts, np.append(doc_starts, len(points)))
        return self.ids[pick], np.diff(total[per_doc])

    def _keys(self, points, starts, ends) -> np.ndarray:
        """64-bit hash of each match (its code points and length)."""
        self._grow(len(points) + 1)
        mixed = points.astype(np.uint64) + np.uint64(1)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        mixed *= self.powers[:len(points)]
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(mixed, out=sums[1:])
        keys = (sums[ends] - sums[starts]) * self.inverse[starts]
        keys ^= (ends - starts).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(32)
        return keys

    def _learn(self, keys: np.ndarray, matches: list[str]) -> np.ndarray:
        ids, counts = [], []
        for i in range(0, len(matches), 512):
            part = matches[i:i + 512]
            e = self.words.encode_batch_fast([part], is_pretokenized=True, add_special_tokens=False)[0]
            own = np.array(e.ids, dtype=np.uint32)
            done = np.cumsum(self.n_bytes[own])         # a match ends where its bytes do
            upto = np.searchsorted(done, np.cumsum([len(m.encode()) for m in part]), side="right")
            ids.append(own)
            counts.append(np.diff(upto, prepend=0))
        entries = self.known + np.arange(len(keys))
        count = np.concatenate(counts)
        self.first = _put(self.first, self.known, self.used + np.cumsum(count) - count)
        self.count = _put(self.count, self.known, count)
        self.known += len(keys)
        own = np.concatenate(ids)
        self.ids = _put(self.ids, self.used, own)
        self.used += len(own)
        self.new = _merged(self.new, (keys, entries))
        if len(self.new[0]) > 16_384 + len(self.old[0]) // 4:
            self.old = _merged(self.old, self.new)
            self.new = (self.new[0][:0], self.new[1][:0])
        return entries

    def encode(self, texts: list[str]):
        """Yield (ids, ids per text) for runs of texts of bounded size, in order."""
        run, size = [], 0
        for text in texts:
            held = any(t in text for t in self.added)
            if held or len(text) > CHUNK:
                if run:
                    yield self._encode_run(run)
                    run, size = [], 0
                ids = self._cut(text) if held else self._whole(text)
                yield ids, np.array([len(ids)])
                continue
            if run and size + len(text) > CHUNK:
                yield self._encode_run(run)
                run, size = [], 0
            run.append(text)
            size += len(text)
        if run:
            yield self._encode_run(run)

    def _encode_run(self, run: list[str]):
        n = np.array([len(t) for t in run], dtype=np.int64)
        starts = np.cumsum(n) - n
        full = n > 0
        counts = np.zeros(len(run), dtype=np.int64)
        if not full.any():
            return np.zeros(0, dtype=np.uint32), counts
        ids, counts[full] = self._encode_chunk("".join(run), starts[full])
        return ids, counts

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens) or (self.n_bytes[ids] == 0).any()):
            raise ValueError("an id is not in the vocabulary")
        n = self.n_bytes[ids]
        ends = np.cumsum(n)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[ids] - (ends - n), n)]

    def offsets(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray):
        """Character positions of each token in its text, and whether it begins inside a character.

        ``raw`` holds the UTF-8 bytes of the texts one after another.
        """
        leads = (raw & 0xC0) != 0x80
        char_of = np.cumsum(leads) - 1                  # of each byte, over all the texts
        ends = np.cumsum(self.n_bytes[ids.astype(np.int64)])
        starts = ends - self.n_bytes[ids.astype(np.int64)]
        bounds = np.concatenate(([0], np.cumsum(counts)))
        filled = counts > 0
        base = np.zeros(len(counts), dtype=np.int64)
        base[filled] = char_of[starts[bounds[:-1][filled]]]
        base = np.repeat(base, counts)
        return (char_of[starts] - base, char_of[ends - 1] + 1 - base, ~leads[starts])


def _put(array: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """``values`` written from ``at`` on, into a longer copy where there is no room."""
    need = at + len(values)
    if need > len(array):
        array = np.concatenate((array, np.zeros(max(need, 2 * len(array)) - len(array), dtype=array.dtype)))
    array[at:need] = values
    return array


def _merged(a, b):
    keys = np.concatenate((a[0], b[0]))
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate((a[1], b[1]))[order]


def match_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Where each match of the published split pattern begins, in texts laid end to end."""
    n = len(points)
    cls = char_classes()[points]
    first = np.zeros(n + 1, dtype=bool)                 # of a text; n counts as one
    first[doc_starts] = True
    first[n] = True
    blank = points == 0x20
    space = cls == SPACE
    run = np.ones(n, dtype=bool)                        # first of a run of one class within a text
    run[1:] = cls[1:] != cls[:-1]
    run |= first[:-1]
    start = run.copy()
    # A run of white space before other characters leaves its last character; a blank joins them.
    last = np.zeros(n, dtype=bool)                      # last white space, with more of the text behind it
    last[:-1] = space[:-1] & ~space[1:] & ~first[1:-1]
    start |= last
    joined = np.flatnonzero(last & blank) + 1
    start[joined] = False
    # Contractions: an apostrophe that begins a match, and the letters that belong to it.
    quote = np.flatnonzero((points == 0x27) & start)
    if len(quote):
        nxt = np.zeros((3, len(quote)), dtype=np.uint32)
        alive = np.ones(len(quote), dtype=bool)
        for k in range(3):
            at = quote + 1 + k
            alive &= at < n
            alive[alive] &= ~first[at[alive]]
            nxt[k][alive] = points[at[alive]]
        one = np.isin(nxt[0], [ord(c) for c in "stmd"])
        two = np.zeros(len(quote), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            two |= (nxt[0] == ord(a)) & (nxt[1] == ord(b))
        for hit, size in ((one, 2), (two & ~one, 3)):
            at = quote[hit]
            for k in range(1, size):
                start[at + k] = False
            rest = at + size
            rest = rest[rest < n]
            rest = rest[(cls[rest] == LETTER) & ~first[rest]]
            start[rest] = True
    return np.flatnonzero(start)


def pieces(text: str):
    """Cut a very long text before blanks between two letters, where a match always ends."""
    import regex
    safe = regex.compile(r"(?<=\p{L}) (?=\p{L})")
    at = 0
    while len(text) - at > CHUNK:
        m = safe.search(text, at + CHUNK)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Codec(path)


def _lists(values: np.ndarray, counts: np.ndarray, kind) -> pa.ListArray:
    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, type=kind))


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", prefix: str = "bpe_",
           offsets: bool = True) -> DataFrame:
    """Add the ids of every whole text of ``df``.

    New columns, with ``prefix``: ``ids`` array<int>, ``n_tokens`` long and, with
    ``offsets``, ``starts``/``ends`` array<int> (character positions) and
    ``n_split`` long.  ``vocabulary`` is the path of a rank or tokenizer file that
    every worker has.  Underscores are put before the prefix while a name is taken.
    """
    names = ["ids", "n_tokens"] + (["starts", "ends", "n_split"] if offsets else [])
    while any(free_name(df, prefix + n) != prefix + n for n in names):
        prefix = "_" + prefix
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "starts": T.ArrayType(T.IntegerType()),
             "ends": T.ArrayType(T.IntegerType()), "n_split": T.LongType()}
    schema = T.StructType(df.schema.fields + [T.StructField(prefix + n, kinds[n]) for n in names])
    column = df.columns.index(text_col)

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(column).to_pylist()]
            done = 0
            for ids, counts in c.encode(texts):
                part = batch.slice(done, len(counts))
                own = texts[done:done + len(counts)]
                done += len(counts)
                new = [_lists(ids.astype(np.int32), counts, pa.int32()), pa.array(counts, type=pa.int64())]
                if offsets:
                    raw = np.frombuffer("".join(own).encode(), dtype=np.uint8)
                    starts, ends, inside = c.offsets(ids, counts, raw)
                    split = np.concatenate(([0], np.cumsum(inside)))
                    bounds = np.concatenate(([0], np.cumsum(counts)))
                    new += [_lists(starts.astype(np.int32), counts, pa.int32()),
                            _lists(ends.astype(np.int32), counts, pa.int32()),
                            pa.array(np.diff(split[bounds]), type=pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def _flat_ids(column) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a list column, null lists as empty ones, and the count of each row."""
    counts = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = column.flatten()
    if flat.null_count:
        raise ValueError("an id is null")
    return flat.to_numpy(zero_copy_only=False), counts


def decode(df: DataFrame, vocabulary: str, ids_col: str = "bpe_ids", prefix: str = "decoded_",
           text: bool = True) -> DataFrame:
    """Add the bytes (and text) of the ids of every row; a digest of the ids goes along.

    New columns, with ``prefix``: ``bytes`` binary, ``ids_sha256`` string (ids as
    little-endian unsigned 32-bit integers) and, with ``text``, ``text`` string.
    Characters whose bytes lie in several tokens are whole again, as bytes are
    joined before they are read as UTF-8; bytes that form no character (ids cut
    inside one) become U+FFFD.  ``ids_col`` itself is left out.
    """
    import hashlib
    names = ["bytes", "ids_sha256"] + (["text"] if text else [])
    kinds = {"bytes": T.BinaryType(), "ids_sha256": T.StringType(), "text": T.StringType()}
    kept = [f for f in df.schema.fields if f.name != ids_col]
    while any(prefix + n in {f.name for f in kept} for n in names):
        prefix = "_" + prefix
    schema = T.StructType(kept + [T.StructField(prefix + n, kinds[n]) for n in names])
    column = df.columns.index(ids_col)
    others = [i for i, f in enumerate(df.schema.fields) if f.name != ids_col]

    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):
                part = batch.slice(at, 250)
                ids, counts = _flat_ids(part.column(column))
                bounds = np.concatenate(([0], np.cumsum(counts)))
                raw = c.decode(ids)
                ends = np.concatenate(([0], np.cumsum(c.n_bytes[ids.astype(np.int64)])))[bounds]
                body = raw.tobytes()
                whole = [body[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
                packed = ids.astype("<u4").tobytes()
                digests = [hashlib.sha256(packed[4 * a:4 * b]).hexdigest()
                           for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                new = [pa.array(whole, type=pa.binary()), pa.array(digests, type=pa.string())]
                if text:
                    new.append(pa.array([w.decode("utf-8", "replace") for w in whole], type=pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), *new], names=schema.names)

    return df.mapInArrow(run, schema)
