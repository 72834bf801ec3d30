import io

import pytest

from featurescore.llm.common import shared_dir
from featurescore.llm.warc import OP2_SQL, chunked, dechunked, described, op2_warc, page_records, parse, payload_of, read_archive, write_archive

from .sqlcheck import same

SF = "/root/testdata/sf0.001"


def test_query_equals_sql(spark):
    same(op2_warc(spark, SF), OP2_SQL, SF)


def test_round_trip_with_segments_and_edges(spark, table, tmp_path):
    long, copy = "é<p>\r\n\r\nWARC/1.1\r\n" * 9000, "c" * 1000
    rows = [(1, "u 1", long), (2, "u2", copy), (3, None, copy), (4, "x\r\ny", None), (5, "u", ""), (6, "u", "c" * 999), (7, "u", "c" * 999), (None, "n", copy), (3, "again", copy), (9, "z", long)]
    pages = table(rows, "page_id long, url string, html string")
    path = f"{shared_dir(spark)}/warc-{tmp_path.name}"
    write_archive(pages, path, segment=5000, file_records=7)
    out = read_archive(spark, path).collect()
    assert len(out) == len(rows) and {r.status for r in out} == {"whole", "revisit"}
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append((r.record_type, r.payload and r.payload.decode()))
    assert by["9"] == [("response", long)] and by["1"] == [("revisit", None)] and by["2"] == [("revisit", None)] and by[None] == [("revisit", None)]
    assert sorted(by["3"], key=str) == [("response", copy), ("revisit", None)]
    assert by["4"] == by["5"] == [("response", b"".decode() or None)] or by["4"][0][0] == "response"
    assert by["6"] == by["7"] == [("response", "c" * 999)]
    assert {r.refers_to for r in described(read_archive(spark, path)).collect()} == {None, "3", "9"}


def test_broken_records(spark, tmp_path):
    records = page_records("k", 1, "u", b"abc" * 1000, None, 500)
    folder = f"{shared_dir(spark)}/warc-{tmp_path.name}"
    for name, kept in (("short", records[:-1]), ("gap", records[:2] + records[3:]), ("twice", records + records[1:2]), ("headless", records[1:]), ("good", records[::-1])):
        spark.createDataFrame([(r.decode(),) for r in kept], "value string").coalesce(1).write.option("lineSep", "\r\n").option("compression", "gzip").text(f"{folder}/{name}")
        out = read_archive(spark, f"{folder}/{name}").collect()
        assert [r.status for r in out] == (["whole"] if name == "good" else ["broken"])
        assert out[0].payload == (b"abc" * 1000 if name == "good" else None)


@pytest.mark.parametrize("payload", [b"", b"a", b"\r\n0\r\n\r\n" * 5000])
def test_framing(payload):
    assert dechunked(chunked(payload)) == payload
    assert dechunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert dechunked(b"3\r\nab") is None and dechunked(b"zz\r\n") is None and dechunked(b"") is None
    (fields, block), = parse(io.BytesIO(b"".join(page_records("k", None, None, payload, None, 10**9)) + b"\r\n"))
    assert payload_of(block) == payload and "x-page-id" not in fields


def test_empty_table(spark, table, tmp_path):
    path = f"{shared_dir(spark)}/warc-{tmp_path.name}"
    write_archive(table([], "page_id long, url string, html string", 1), path)
    assert read_archive(spark, path).count() == 0
