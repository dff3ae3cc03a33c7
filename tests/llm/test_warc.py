import base64
import gzip
import hashlib
import io
import os

import pytest

from barwright.llm import warc
from barwright.llm.q01_warc import ORACLES, op1_warc
from tests.llm.oracle import same


def test_query_equals_sql(spark, sf_dir):
    same(spark, sf_dir, op1_warc, ORACLES["op1_warc"])


ROWS = [(5, "u5", "same"), (2, None, "same"), (9, "line\nbreak", None), (7, "u7", ""), (None, "n", "same"), (3, "é", "é" * 50000), (2, "again", "same"), (11, "x", "\r\n\r\nWARC/1.1\r\n")]


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_edge_rows(spark, archive_bytes):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS archive", "2 AS place")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(pages, archive_bytes=archive_bytes).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {(t or ""): min(i for i, _, x in ROWS if (x or "") == (t or "") and i is not None) for _, _, t in ROWS}
    want, seen = [], set()
    for i, _, t in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        fresh = (t or "") not in seen
        seen.add(t or "")
        want.append((i, len((t or "").encode()), sha(t), "response" if fresh else "revisit", None if fresh else first[t or ""]))
    assert got == sorted(want, key=str)
    assert warc.archive_pages(pages.limit(0)).collect() == []


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy")], "page_id long, url string, html string")
    assert {r.record_type for r in warc.archive_pages(pages, least_bytes=3).collect()} == {"response"}


def test_normalised_archive_has_a_member_per_record_at_each_offset(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i % 3}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    captured = warc.write_archives(pages, f"file://{tmp_path}/raw")
    (raw,) = os.listdir(tmp_path / "raw")
    with open(tmp_path / "raw" / raw, "rb") as f:
        data = f.read()
    assert data.count(b"\x1f\x8b\x08") == 1 and len(list(warc.Records(warc.inflate(io.BytesIO(data))))) == 20
    (row,) = warc.normalise(warc.first_captures(captured), f"file://{tmp_path}/out").collect()
    path = row.path.removeprefix("file://")
    with open(path + ".warc.gz", "rb") as f:
        members = f.read()
    entries = [__import__("json").loads(x) for x in open(path + ".idx")]
    assert [e["offset"] for e in entries] == [sum(x["length"] for x in entries[:i]) for i in range(20)]
    each = [gzip.decompress(members[e["offset"] : e["offset"] + e["length"]]) for e in entries]
    assert b"".join(each) == gzip.decompress(members) and all(x.startswith(b"WARC/1.1\r\n") for x in each)


def test_cut_off_stream_is_an_error():
    record = warc.response(1, "u", b"payload", "X")
    with pytest.raises(ValueError, match="cut off"):
        list(warc.Records(iter([record[:-10]])))
