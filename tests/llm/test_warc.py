"""Archives against what the pages say."""

import hashlib

from pyspark.sql import functions as F

from loomlight.llm import warc
from loomlight.llm.shared import scratch

SCHEMA = "page_id long, url string, html string, digest string, kept int, refers_to string"


def brute(rows):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        keep = max(same, default=None) if len(data) >= 1000 else None
        visit = keep is not None and keep != page
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if visit else "response", keep if visit else None))
    return sorted(out, key=str)


def rows():
    body = "é<p>text</p>" * 200
    made = [(k, f"http://h/{k}", f"{body}{k % 7}") for k in range(60)]
    made += [(100 + k, None if k % 3 else f"http://h/a b\n{k}", t) for k, t in enumerate([None, "", "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "\x1f\x8b\x08WARC/1.1\r\n\r\n" * 50, "é" * 500, "z" * 300_000])]
    return made + [(5, "u", f"{body}5"), (None, "u", body), (None, "v", "short"), (-3, None, "neg" * 400), (-4, None, "neg" * 400)]


def frame(spark, data):
    return spark.createDataFrame([(*r, "z", 1, "z") for r in data], SCHEMA)


def test_round_trip(spark):
    data = rows()
    got = warc.round_trip(frame(spark, data)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(data)
    assert warc.round_trip(frame(spark, [])).collect() == []


def test_small_splits_own_each_record_once(spark):
    data = rows()
    listed = warc.write(frame(spark, data), scratch(spark, "warc-test"))
    for split in (700, 5000, 1 << 20):
        got = warc.read(listed, split_bytes=split).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(data)
    by_id = {r.page_id: r for r in got if r.record_type == "response"}
    assert bytes(by_id[108].payload) == b"z" * 300_000 and by_id[0 + 101].payload == b""


def test_listing(spark, tmp_path):
    warc.write(frame(spark, rows()), f"file://{tmp_path}").count()
    assert warc.archives(spark, f"file://{tmp_path}").agg(F.sum("n_bytes")).first()[0] > 1000
