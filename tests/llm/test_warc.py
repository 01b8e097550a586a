import base64
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from variscope.llm import warc as W


def plain(rows, least=0):
    """Expected rows, as a sorted list, by plain loops."""
    def rank(r):
        return (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")

    firsts = {}
    for r in sorted(rows, key=rank):
        firsts.setdefault((r[2] or "").encode(), r)
    out, used = [], set()
    for r in sorted(rows, key=rank):
        p = (r[2] or "").encode()
        first = firsts[p]
        response = len(p) < least or (p not in used and r[:2] == first[:2])
        used.add(p)
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        out.append((r[0], len(p), digest, "response" if response else "revisit", None if response else first[0]))
    return sorted(out, key=str)


def read(archive):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in W.read_warc(archive).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    hosts = ["www.Example.org", "a.example.org", "b.example.com:8080", "hot.example.net"]
    made = [(i, f"https://{rng.choice(hosts)}/p{i % 97}?q={i % 3}#part{i}", f"<p>{rng.random()}</p>" if i % 4 else "<p>the same page</p>") for i in range(600)]
    odd = [(1000, None, None), (1001, "", ""), (1002, "no url at all", "x"), (1003, "http://", "é" * 10), (None, "http://a.example.org/null", "<p>the same page</p>"),
           (None, "http://a.example.org/null2", "only here"), (1004, "http://u:p@Example.org/a\r\nb c", "x"), (1005, "http://long.example.org/", "long " * 400_000),
           (7, "https://a.example.org/again", "<p>the same page</p>"), (1006, "http://ü.example/ö", "WARC/1.1\r\n\r\nnot a record"),
           (1007, "http://twice.example.org/", "row"), (1007, "http://twice.example.org/", "row"), (1007, "http://twice.example.org/", "row")]
    return made + odd


def frame(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("kept") for c in ("key", "sha", "kind", "of", "payload", "file")}).repartition(6)


@pytest.mark.parametrize("least", [0, 5])
def test_equals_plain_loops(spark, rows, least, tmp_path):
    archive = W.write_warc(frame(spark, rows), f"file://{tmp_path}/w", least=least, block=16)
    assert read(archive) == plain(rows, least)
    assert archive.blocks.count() > 30


def test_records_are_standard_members(spark, rows, tmp_path):
    """Any reader of gzip finds every record, in order, and what it refers to."""
    W.write_warc(frame(spark, rows), str(tmp_path / "w"))
    ids, refers = set(), set()
    for path in sorted((tmp_path / "w").glob("*.warc.gz")):
        data = gzip.decompress(path.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            data = rest[int(headers["Content-Length"]) :]
            assert data.startswith(b"\r\n\r\n")
            data = data[4:]
            assert headers["WARC-Record-ID"] not in ids
            ids.add(headers["WARC-Record-ID"])
            refers.add(headers.get("WARC-Refers-To"))
    assert len(ids) == len(rows) and refers - {None} <= ids


def test_lookup_by_index(spark, rows, tmp_path):
    archive = W.write_warc(frame(spark, rows), str(tmp_path / "w"), block=8)
    asked = [rows[i][1] for i in (0, 5, 17, 300, 599)] + ["https://HOT.example.net/p5?q=1", "http://missing.example.org/", "http://zzz/", None, "http://twice.example.org/"]
    got = W.find_captures(archive, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    keys = dict(spark.createDataFrame([(r[1],) for r in rows] + [(u,) for u in asked], "url string").select("url", W.capture_key(F.col("url"))).collect())
    want = sorted((u, str(r[0])) for u in set(asked) - {None} for r in rows if keys[r[1]] == keys[u])
    assert sorted((r["asked"], str(r["page_id"])) for r in got) == want and len(want) > 8
    html = {r[0]: (r[2] or "") for r in rows}
    assert all(bytes(r["payload"]).decode() == html[r["page_id"]] for r in got if r["record_type"] == "response")


def test_keys(spark):
    urls = ["https://Blog.Example.com/a?b=c#d", "http://u@x.org:81", "//x.org?q", "plain", None, "http://a.b/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "url string").select(W.capture_key(F.col("url"))).collect()]
    assert got == ["com,example,blog)/a?b=c", "org,x:81)/", "org,x)/?q", ")plain", ")", "b,a)/"]


def test_altered_payload_is_noticed():
    member = W.record(1, "http://a/", b"abc", None, "n")
    assert W.parse(member)[1] == b"abc"
    altered = W._zipped(gzip.decompress(member).replace(b"abc", b"abd"))
    with pytest.raises(ValueError, match="digest"):
        W.parse(altered)


def test_empty_table(spark, tmp_path):
    archive = W.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert W.read_warc(archive).count() == 0
    assert W.find_captures(archive, spark.createDataFrame([("http://a/",)], "url string")).count() == 0
