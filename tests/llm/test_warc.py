import base64
import gzip
import hashlib

import pytest

from rulewright.llm import warc

ROWS = [(i, f"http://a/{i}", h) for i, h in enumerate(["<p>a</p>", None, "", "<p>a</p>", "é\r\n\r\nü", "x" * 200_000, "<p>a</p>", "é\r\n\r\nü"])] + [
    (None, "http://none", "<p>a</p>"), (None, None, None), (None, None, None), (3, "http://a/3b", "<p>a</p>"), (4, "http://a/4b", "other"), (0, "http://a/0", "<p>a</p>"),
]


def expected(rows, least):
    groups = {}
    for page, _, html in rows:
        data = (html or "").encode()
        if page is not None and len(data) >= least:
            groups.setdefault(data, []).append(page)
    out, used = [], set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        data = (html or "").encode()
        first = min(groups[data]) if page is not None and data in groups else None
        refers = first if first is not None and (first != page or data in used) else None
        if page is not None and first == page:
            used.add(data)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,roll,least", [(3, 400, 0), (1000, 1 << 20, 5)])
def test_round_trip_and_determinism(spark, tmp_path, shard, roll, least):
    made = []
    for n in (1, 3):
        df = spark.createDataFrame([(*r, "x", 5) for r in ROWS], "page_id long, url string, html string, shard string, first int").repartition(n)
        path = warc.write_warc(df, f"file://{tmp_path}/w{n}", roll_bytes=roll, rows_per_shard=shard, min_revisit_bytes=least)
        got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect()]
        assert sorted(got, key=str) == expected(ROWS, least)
        made.append({p.name: p.read_bytes() for p in (tmp_path / f"w{n}").glob("*.warc.gz")})
    assert made[0] == made[1] and (len(made[0]) > 3) == (shard == 3)
    assert not [p for p in tmp_path.rglob("*.tmp")]
    text = gzip.decompress(b"".join(made[0][k] for k in sorted(made[0])))
    assert text.count(b"WARC/1.1\r\n") == len(ROWS) and len({x for x in text.split(b"\r\n") if x.startswith(b"WARC-Record-ID")}) == len(ROWS)


def test_nothing(spark, tmp_path):
    path = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"file://{tmp_path}/none")
    assert warc.read_warc(spark, path).count() == 0


def test_query_matches_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op4_warc(spark, sf).collect()]
    assert sorted(got, key=str) == expected(rows, 0)
