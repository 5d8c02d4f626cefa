import base64
import gzip
import hashlib
import io
import random

import pytest

from tickloom.llm.warc import LoserTree, capture_history, captures, members, merged, order, parse, read_archives, record, url_key, write_archives

PAGES = "page_id long, url string, html string, id int, digest string"


def pages_of(spark, texts):
    return spark.createDataFrame([(i, f"http://WWW.h{i % 3}.example.com/p?q={i % 2}", t, 1, "x") for i, t in enumerate(texts)], PAGES)


def plain(texts, min_bytes=0):
    first, out = {}, {}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        start = first.setdefault(data, i)
        again = start != i and len(data) >= min_bytes
        out[i] = (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", start if again else None)
    return out


@pytest.mark.parametrize("min_bytes", [0, 3])
def test_against_a_plain_version(spark, min_bytes):
    texts = [None, "", "a", "WARC/1.1\r\n\r\nx", "a", "é" * 2000, "b" * 300_000, "é" * 2000, None, *["copy"] * 30, "\r\n\r\n"]
    rows = capture_history(pages_of(spark, texts), min_bytes=min_bytes, archive_bytes=4000).collect()
    assert {r.id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == plain(texts, min_bytes)
    keys = [(r.url_key, r.ts, r.id) for r in rows]
    assert keys == sorted(keys) and len({r.archive for r in rows}) > 1


def test_archives_are_warc(spark):
    pages = pages_of(spark, ["one", "two", "one"]).selectExpr("page_id AS id", "url", "'2020-01-01T00:00:00Z' AS ts", "html AS payload")
    manifest = write_archives(pages)
    assert manifest.agg({"records": "sum"}).first()[0] == 3
    for path in (r.archive for r in manifest.collect()):
        data = open(path.removeprefix("file:").replace("///", "/"), "rb").read()
        for at, size, content in members(io.BytesIO(data)):
            assert gzip.decompress(data[at : at + size]) == content and content.startswith(b"WARC/1.1\r\n")
    assert sorted(c[2] for r in manifest.collect() for c in captures(r.archive)) == [0, 1, 2]
    assert {r.range for r in read_archives(manifest, [(url_key(pages.first().url), "2020-01-01T00:00:00Z")]).collect()} <= {0, 1}


def test_a_record_and_back():
    data = record(7, "http://a/\r\nX: y", "2020-01-01T00:00:00Z", b"pay\r\n\r\nload", "D", None, False)
    warc, http, payload = parse(data)
    assert payload == b"pay\r\n\r\nload" and http["Content-Length"] == "11" and warc["WARC-Target-URI"] == "http://a/ X: y"
    with pytest.raises(ValueError):
        list(members(io.BytesIO(gzip.compress(data)[:-9])))


def test_loser_tree():
    rng = random.Random(1)
    row = lambda x: (str(x), "t", x, "", 0, "", "", None, "a", 0, 0)
    for k in (0, 1, 2, 3, 7, 16):
        runs = [sorted((row(rng.randint(0, 50)) for _ in range(rng.randint(0, 20))), key=order) for _ in range(k)]
        assert list(LoserTree([iter(r) for r in runs])) == sorted((x for r in runs for x in r), key=order)


@pytest.mark.parametrize("runs", [1, 5, 100])
def test_blocks_are_merged_as_they_come(runs):
    rng = random.Random(2)
    row = lambda x, run, k: (f"{x:03d}", "t", x, "", 0, "", "", None, str(run), k, 0)
    blocks = []
    for run in range(runs):
        own = sorted((row(rng.randint(0, 500), run, k) for k in range(rng.randint(0, 60))), key=order)
        blocks += [(order(own[k]), str(run), own[k : k + 7]) for k in range(0, len(own), 7)]
    got = list(merged(iter(sorted(blocks, key=lambda b: b[0]))))
    assert got == sorted((c for b in blocks for c in b[2]), key=order)


def test_url_keys():
    assert url_key("http://www.A.example.com:80/X?b=C") == "com,example,a)/x?b=c"
    assert url_key("") == ")/" and url_key("http://[bad") == "http://[bad"


def test_odd_rows(spark):
    assert capture_history(pages_of(spark, ["a"]).limit(0)).count() == 0
    rows = [(None, None, "a", 1, "x"), (4, None, "a", 1, "x"), (4, "u", "a", 1, "x"), (None, "u", "b", 1, "x")]
    got = sorted((r.id or -1, r.record_type, r.refers_to or -1) for r in capture_history(spark.createDataFrame(rows, PAGES)).collect())
    assert got == [(-1, "response", -1), (-1, "revisit", 4), (4, "response", -1), (4, "response", -1)]
