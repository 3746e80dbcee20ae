import hashlib
import struct

import pytest
import zstandard

from cabmart.llm import warc as A
from cabmart.llm.common import scratch_path
from conftest import SF_SMALL


def test_query_matches_sql(spark, queries):
    import __spark_entry__ as E
    from oracle_compare import compare, duck
    problems, n, _ = compare(spark, "op5_warc", queries["op5_warc"], E.oracle_sql()["op5_warc"], SF_SMALL, duck(SF_SMALL))
    assert not problems and n > 0


def pages(spark):
    big, other = "<p>same page é</p>" * 20, "<p>another</p>" * 20
    rows = [(5, "http://a/1", big), (3, "http://a/2", big), (9, None, big), (3, "http://a/2", big), (None, "u", big),
            (7, "http://b", "short"), (8, "http://b", "short"), (10, "x y\r\nz", None), (11, "e", ""), (12, "l", "y" * 3_000_000),
            (None, "n", other), (None, "n", other)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'d' AS digest", "1 AS first")


def test_round_trip(spark):
    path = A.write_archives(pages(spark).repartition(2), scratch_path(spark, "warc"))
    got = A.read_archives(spark, path).collect()
    assert len(got) == 12
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert [r.record_type for r in by[3]] == ["response", "response"]
    for i in (5, 9):
        assert (by[i][0].record_type, by[i][0].refers_to, by[i][0].payload) == ("revisit", 3, None)
    assert sorted((r.record_type, r.refers_to) for r in by[None] if r.url == "u") == [("revisit", 3)]
    assert [r.record_type for r in by[None] if r.url == "n"] == ["response"] * 2      # no id to refer to
    assert by[7][0].record_type == by[8][0].record_type == "response"
    assert by[10][0].payload_bytes == by[11][0].payload_bytes == 0 and by[10][0].url == "x%20y%0D%0Az"
    assert by[12][0].payload == b"y" * 3_000_000 and by[9][0].url is None
    want = ("<p>same page é</p>" * 20).encode()
    assert by[5][0].payload_digest == hashlib.sha256(want).hexdigest() and by[5][0].payload_bytes == len(want)
    assert bytes(by[3][0].payload) == want


def test_empty_table(spark):
    path = A.write_archives(pages(spark).filter("false"), scratch_path(spark, "warc"))
    assert A.read_archives(spark, path).count() == 0


def test_archives_begin_with_a_dictionary(spark):
    rows = [(i, f"http://h/{i}", f"<html><body><p>page number {i} of many alike</p></body></html>" * 4) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = A.write_archives(df, scratch_path(spark, "warc"))
    body = bytes(spark.read.format("binaryFile").load(path).filter("length > 0").first().content)
    kinds = [k for k, _, _ in A.frames(body)]
    assert kinds[0] == "dictionary" and kinds.count("data") == 300
    assert set(kinds[1:]) == {"skip", "data"}
    # Without the dictionary the records cannot be decoded.
    first = struct.unpack_from("<I", body, 4)[0] + 8
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(A.read_records(body[first:]))


def test_a_partition_is_cut_into_archives_of_bounded_size(spark):
    rows = [(i, f"http://h/{i}", "".join(f"{(i * 7919 + j * j) % 99991:x} " for j in range(400))) for i in range(600)]
    rows.append((600, "http://long", "".join(f"{j * 2654435761 % 4294967296:x}" for j in range(60_000))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = A.write_archives(df, scratch_path(spark, "warc"), most=100_000)
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).filter("length > 0").collect()]
    assert len(files) > 4
    records = [[r["page_id"] for r in A.read_records(f)] for f in files]
    assert sorted(i for r in records for i in r) == list(range(601))
    assert all(len(f) < 200_000 or 600 in r for f, r in zip(files, records))
    kinds = [[k for k, _, _ in A.frames(f)] for f in files]
    assert all(k[0] == "dictionary" for k in kinds if k.count("data") >= 16)
    assert A.read_archives(spark, path, payload=False).count() == 601
    assert list(A.archives([])) == []


def archive(payload=b"some payload", **change):
    raw = A.record(1, "http://h", payload, hashlib.sha256(payload).hexdigest(), None, False, "2020-01-01T00:00:00Z")
    for a, b in change.values():
        assert a in raw
        raw = raw.replace(a, b)
    return zstandard.ZstdCompressor(write_checksum=True).compress(raw)


def test_damage_is_told():
    assert [r["payload"] for r in A.read_records(archive())] == [b"some payload"]
    for change in ((b"WARC/1.1", b"WARC/9"), (b"some payload", b"some payl0ad"), (b"WARC-Type: response", b"WARC-Type: other"),
                   (b"WARC-Date", b"WARC-Dote"), (b"sha256:", b"sha256:g"), (b"Content-Length: 12\r\n", b"Content-Length: 11\r\n"),
                   (b"HTTP/1.1 200", b"nothing 200"), (b"<urn:page:1>", b"<urn:1>"), (b"WARC-Type:", b" WARC-Type:")):
        with pytest.raises(ValueError):
            list(A.read_records(archive(x=change)))
    whole = archive()
    for cut in (len(whole) - 1, len(whole) - 5, 12, 6):
        with pytest.raises(ValueError):
            list(A.read_records(whole[:cut]))
    with pytest.raises(ValueError):
        list(A.read_records(b"\x00" * 20))
    with pytest.raises(ValueError, match="behind the first"):
        list(A.read_records(whole + struct.pack("<II", A.DICTIONARY_MAGIC, 0)))
    flipped = bytearray(whole)
    flipped[-1] ^= 1                                     # the frame's checksum
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(A.read_records(bytes(flipped)))


def test_compressed_dictionary_is_read():
    samples = [archive()[:1] + f"record {i} of words alike and alike".encode() * 3 for i in range(200)]
    d = zstandard.train_dictionary(2000, samples)
    raw = A.record(1, None, b"p", hashlib.sha256(b"p").hexdigest(), None, False, "2020-01-01T00:00:00Z")
    packed = zstandard.ZstdCompressor().compress(d.as_bytes())
    body = struct.pack("<II", A.DICTIONARY_MAGIC, len(packed)) + packed + zstandard.ZstdCompressor(dict_data=d).compress(raw)
    assert [r["page_id"] for r in A.read_records(body)] == [1]
