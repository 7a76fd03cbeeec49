import gzip
import hashlib
import io
import json

import pytest

from weftline.llm import warc as W

BIG = "<p>" + "ä" * 800 + "</p>"
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, BIG), (4, "http://a/\r\nx", "small"), (5, "u", "small"), (6, "u", None), (None, "u", BIG), (7, "u", ""), (2, "http://a/2", BIG), (8, "u", "x\r\n\r\nWARC/1.1\r\n\r\n" * 100)]


def test_round_trip(spark):
    df = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "'c' AS payload", "'c' AS refers_to")
    got = W.archive(df).collect()
    assert len(got) == len(ROWS)
    top = 3
    want = []
    for i, u, h in ROWS:
        b = (h or "").encode()
        again = h == BIG and i is not None and i < top
        want.append((i, u or "", len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    assert sorted([(r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    for r in got:
        if r.record_type == "response":
            assert hashlib.sha1(r.payload).hexdigest() == r.payload_digest
    assert W.archive(df.limit(0)).count() == 0


def test_normaliser_makes_members():
    whole = b"".join(W.record("response", k, f"u{k}", b"x" * (k * 700_000)) for k in range(4))
    archive, index = io.BytesIO(), io.BytesIO()
    assert W.normalise(io.BytesIO(gzip.compress(whole)), archive, index, "f") == 4
    assert gzip.decompress(archive.getvalue()) == whole
    for k, line in enumerate(map(json.loads, index.getvalue().splitlines())):
        one = gzip.decompress(archive.getvalue()[line["offset"] : line["offset"] + line["length"]])
        assert one == W.record("response", k, f"u{k}", b"x" * (k * 700_000))
    again = io.BytesIO()
    assert W.normalise(io.BytesIO(archive.getvalue()), again, io.BytesIO(), "f") == 4 and again.getvalue() == archive.getvalue()


def test_cut_archives_are_errors():
    data = gzip.compress(W.record("response", 1, "u", b"abc"))
    whole = gzip.decompress(data)
    with pytest.raises(ValueError):
        list(W.records([whole[:-10]]))
    for cut in (5, 9):  # the end of the stream is missing, though its last record is whole
        with pytest.raises(ValueError):
            list(W.records(W.inflated(io.BytesIO(data[:-cut]))))


def test_forms_of_a_local_path(tmp_path):
    for form in (f"{tmp_path}/x", f"file:{tmp_path}/x", f"file://{tmp_path}/x"):
        assert W.file_system(form)[1] == f"{tmp_path}/x"
