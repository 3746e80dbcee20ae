"""WARC archives compressed by Zstandard with a dictionary (operator 5).

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary, then has one frame per record.  Archives are written and read by
Spark alone, so they may lie in any file system that Spark knows:

* writing: each task cuts its records into archives of about ``ARCHIVE_BYTES``
  (a longer record has one of its own) and trains a dictionary on the first
  records of each.  An archive is one row, and Spark's text writer puts each row
  into a file.  It must end a row with something: an empty skippable frame,
  which every Zstandard reader passes over.
* reading: Spark's ``binaryFile`` source gives each archive as a row; frames
  are found by their block headers, decoded one at a time and checked.

Records with equal payloads of at least ``least`` bytes: the one with the
smallest page id is a response, the others are revisits that refer to it.
A revisit keeps the payload's digest and, in its HTTP head, its length.

Defined results: a null payload counts as empty; pages without an id never
become the one referred to while another has an id, and read back without an
id; of a group in which no page has an id, and of rows that repeat the smallest
id, all are responses; a null url gives a record without target; control
characters of a url are percent-encoded; an empty table gives no record.
"""

from __future__ import annotations

import hashlib
import re
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame, all ASCII.
ROW_END = "P*M\x18\x00\x00\x00\x00"
#: Bytes of a dictionary; records (and bytes of them) that train it.
DICTIONARY_BYTES, TRAIN_RECORDS, TRAIN_BYTES = 32_768, 400, 4_000_000
#: An archive is closed once it has so many bytes: a reader holds one at a time.
ARCHIVE_BYTES = 32_000_000
LEVEL = 3
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SHA256 = re.compile(r"[0-9a-f]{64}")


# -- records ---------------------------------------------------------------------------------------------------------

def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)),
              ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        fields.append(("WARC-Target-URI", safe))
    if revisit:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", name(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def _head(raw: bytes, what: str) -> tuple[str, dict[str, str], int]:
    """First line, fields (by lower-case name) and the place behind the empty line."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError(f"{what}: the head has no end")
    first, *lines = raw[:end].decode("utf-8").split("\r\n")
    fields = {}
    for line in lines:
        key, colon, value = line.partition(":")
        if not colon or key != key.strip() or not key:
            raise ValueError(f"{what}: not a header line: {line[:80]!r}")
        fields[key.lower()] = value.strip()
    return first, fields, end + 4


def parse(raw: bytes) -> dict:
    """The fields and payload of one record; raises ValueError on anything that does not hold."""
    first, fields, at = _head(raw, "record")
    if not re.fullmatch(r"WARC/1\.[01]", first):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if need not in fields:
            raise ValueError(f"record without {need}")
    length = int(fields["content-length"])
    if length < 0 or raw[at + length:] != b"\r\n\r\n":
        raise ValueError(f"a block of {length} bytes does not end its record of {len(raw)} bytes")
    block = raw[at:at + length]
    status, http, body = _head(block, "block")
    if not status.startswith("HTTP/"):
        raise ValueError("the block is no HTTP message")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if not SHA256.fullmatch(digest):
        raise ValueError("the payload digest is not a SHA-256")
    kind, payload, size = fields["warc-type"], block[body:], int(http["content-length"])
    refers_to = None
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload does not match its length and digest")
    elif kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise ValueError("a revisit has a payload or refers to nothing")
        payload, refers_to = None, _page(fields["warc-refers-to"])
    else:
        raise ValueError(f"a record of type {kind!r}")
    return {"page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": kind,
            "refers_to": refers_to, "payload_digest": digest, "payload_bytes": size, "payload": payload}


def _page(urn: str):
    m = re.fullmatch(r"<urn:page:(-?\d*)>", urn)
    if not m:
        raise ValueError(f"not a page's record: {urn[:60]!r}")
    return int(m[1]) if m[1] else None


# -- frames ----------------------------------------------------------------------------------------------------------

def frames(archive: bytes):
    """(kind, start, end) of each frame: "dictionary", "skip" or "data"."""
    import zstandard
    view, at = memoryview(archive), 0
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("the archive ends inside a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + size
            kind = "dictionary" if magic == DICTIONARY_MAGIC else "skip"
        elif magic == FRAME_MAGIC:
            end = at + zstandard.frame_header_size(bytes(view[at:at + 18]))
            last = False
            while not last:
                if end + 3 > len(view):
                    raise ValueError("the archive ends inside a frame")
                block = int.from_bytes(view[end:end + 3], "little")
                last, sort, size = block & 1, block >> 1 & 3, block >> 3
                if sort == 3:
                    raise ValueError("a block of a reserved type")
                end += 3 + (1 if sort == 1 else size)
            end += 4 * bool(view[at + 4] & 4)            # checksum
            kind = "data"
        else:
            raise ValueError(f"no frame begins with {magic:#x}")
        if end > len(view):
            raise ValueError("the archive ends inside a frame")
        yield kind, at, end
        at = end


def read_records(archive: bytes):
    """Every record of an archive, one frame each, checked."""
    import zstandard
    decoder = None
    for number, (kind, a, b) in enumerate(frames(archive)):
        if kind == "dictionary":
            if number:
                raise ValueError("a dictionary behind the first frame")
            body = archive[a + 8:b]
            if body[:4] == struct.pack("<I", FRAME_MAGIC):
                body = zstandard.ZstdDecompressor().decompress(body)
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        elif kind == "data":
            decoder = decoder or zstandard.ZstdDecompressor()
            raw = decoder.decompress(archive[a:b])
            size = zstandard.frame_content_size(archive[a:min(b, a + 18)])
            if size >= 0 and size != len(raw):
                raise ValueError("a frame is not as long as it says")
            yield parse(raw)


def archives(records, most: int = ARCHIVE_BYTES):
    """Whole archives of ``records``, each closed once it has ``most`` bytes."""
    records = iter(records)
    while archive := b"".join(archive_frames(records, most)):
        yield archive


def archive_frames(records, most: int = ARCHIVE_BYTES):
    """The frames of one archive; the dictionary is trained on the first records.

    Once they have ``most`` bytes, no more records are taken.
    """
    import zstandard
    first, size = [], 0
    for r in records:
        first.append(r)
        size += len(r)
        if len(first) >= TRAIN_RECORDS or size >= min(TRAIN_BYTES, most):
            break
    if not first:
        return
    dictionary = None
    try:
        if len(first) >= 16:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:16_384] for r in first], threads=0)
    except zstandard.ZstdError:                          # too little or too uniform to train on
        dictionary = None
    if dictionary is not None:
        body = dictionary.as_bytes()
        yield struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
        encoder = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    else:
        encoder = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
    size = 0
    for r in first:
        frame = encoder.compress(r)
        size += len(frame)
        yield frame
    while size < most and (r := next(records, None)) is not None:
        frame = encoder.compress(r)
        size += len(frame)
        yield frame


# -- tables ----------------------------------------------------------------------------------------------------------

def with_revisits(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit) of every page.

    Copies are found by digest: the digests that occur twice are counted with
    partial sums, and joined back; Spark splits a digest of very many pages.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    groups = (rows.filter(F.octet_length("payload") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
              .filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    joined = rows.join(groups, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"),
                         revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, least: int = 100, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", most: int = ARCHIVE_BYTES) -> str:
    """Write one record per page into archives of about ``most`` bytes under ``path``."""
    def run(batches):
        def records():
            for batch in batches:
                for r in batch.to_pylist():
                    yield record(r["page_id"], r["url"], r["payload"].encode(), r["digest"], r["refers_to"],
                                 r["revisit"], date)

        for archive in archives(records(), most):
            yield pa.RecordBatch.from_arrays([pa.array([archive], type=pa.binary())], names=["archive"])

    rows = with_revisits(pages, least, id_col, url_col, payload_col).mapInArrow(run, "archive binary")
    # A cast from binary to string keeps the bytes as they are, and the text writer writes them so.
    (rows.select(F.col("archive").cast("string").alias("value")).write
     .option("maxRecordsPerFile", 1).option("lineSep", ROW_END).option("compression", "none").text(path))
    return path


RECORDS = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_digest", T.StringType()), T.StructField("payload_bytes", T.LongType()),
    T.StructField("payload", T.BinaryType())])


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record of the archives under ``path``; a revisit's payload is null.

    Raises on a frame or record that is damaged, cut off or contradicts itself.
    """
    schema = RECORDS if payload else T.StructType(RECORDS.fields[:-1])

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for r in read_records(batch.column(0)[i].as_py()):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if not payload:
                        r.pop("payload")
                    if len(rows) >= 1000 or payload and size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(payload))
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_arrow(payload))

    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    return files.select("content").mapInArrow(run, schema)


def _arrow(payload: bool) -> pa.Schema:
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
              ("payload_digest", pa.string()), ("payload_bytes", pa.int64())]
    return pa.schema(fields + ([("payload", pa.binary())] if payload else []))
