import base64
import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest

from kinelake.llm import common, url_filter, warc

PAGES = "page_id long, url string, html string, id long, host string, sha1 string, payload string, value string"


@pytest.fixture(scope="module")
def page_rows():
    rows = [
        (1, "http://WWW.Example.ORG/es/1?x#y", "<p>one</p>"), (2, "https://example.org/en/15", "<p>one</p>"), (3, "http://example.org/en/2", ""), (4, None, None),
        (5, "no scheme here", "<p>one</p>"), (6, "http://notexample.org", "x"), (7, "http://a.com/fr/1#f", "é\r\n\r\nWARC/1.1\r\nfake"), (8, "http://a.com/de/", "big " * 500_000),
        (9, "http://evil.com/x.org/es/", "y"), (10, "http://casino.net/en/", "z"), (11, "http://h.net/a.exe", "z"), (12, "http://h.net?q=a/org/", ""), (13, "ftp://b.com/en/\x01/", "tab\there"), (None, "http://n.org/", "w"),
        (3, "http://example.org/en/2", ""), (14, "http://line.org/a\nb", "v"), (15, "http://x.org/\tt", "u"),
    ]
    return rows


@pytest.fixture(scope="module")
def pages(spark, page_rows):
    return spark.createDataFrame([r + (9, "h", "s", "p", "v") for r in page_rows], PAGES).repartition(3).cache()


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    rest = re.split("[?#]", rest)[0]
    host, slash, path = rest.partition("/")
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path
    best = None
    for verdict, rule in rules:
        rhost, _, rpath = rule.partition("/")
        if ("." + host).endswith("." + rhost) and path.startswith("/" + rpath) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return host, path, best


def test_rules(pages, page_rows):
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.judge(pages).collect()}
    for page, url, _ in page_rows:
        host, path, best = brute_rule(url, url_filter.RULES)
        rule, verdict = got[page, host, path]
        assert rule == (best and best[0])
        blocked = "casino" in (url or "") or path.endswith(".exe")
        assert verdict == (best[1] if best else "block" if blocked else "allow")


def test_automaton_against_regular_expressions():
    rng = random.Random(3)
    for _ in range(60):
        globs = [g for _ in range(rng.randint(1, 40)) if (g := "".join(rng.choice("ab*?/.") for _ in range(rng.randint(1, 70)))).strip("*")]
        if not globs:
            continue
        texts = ["".join(rng.choice("ab/.c") for _ in range(rng.randint(0, 80))) for _ in range(20)] + [g.replace("*", "ab").replace("?", "a") for g in globs]
        hit = url_filter.Automaton(globs).match(texts)
        for j, g in enumerate(globs):
            want = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), re.S)
            for i, t in enumerate(texts):
                assert hit[i, j] == bool(want.fullmatch(t)), (g, t)


def test_empty_pages(spark):
    none = spark.createDataFrame([], PAGES)
    assert url_filter.judge(none).collect() == []
    assert warc.round_trip(none).collect() == []


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(pages, page_rows, least):
    groups = defaultdict(list)
    for page, _, html in page_rows:
        groups[html or ""].append(page)
    want = []
    for page, _, html in page_rows:
        raw = (html or "").encode()
        top = max((p for p in groups[html or ""] if p is not None), default=None)
        again = len(raw) >= least and page != top
        want.append((page or -1, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
    got = [(r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages, least).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_lookup_goes_through_the_index(spark, pages, page_rows):
    scratch = common.Scratch(spark, "test-warc")
    warc.write(pages, scratch.path("archives"))
    index = warc.CaptureIndex(spark, scratch.path("archives"), scratch)
    assert index.directory().agg({"n": "sum"}).first()[0] == len(page_rows)
    for page, url, html in page_rows:
        if url and page and "\n" not in url and "\t" not in url:
            found = []
            for uri, offset, length in index.lookup(url):
                with warc._open(uri) as f:
                    found.append(warc.record_of(f.read_at(length, offset)))
            assert page in [r[0] for r in found]
            responses = [r for r in found if r[0] == page and r[2] == "response"]
            assert all(r[5].decode() == (html or "") for r in responses)
    assert index.lookup("http://nowhere.example/") == []


def test_scan_with_tiny_reads(spark, pages, monkeypatch):
    scratch = common.Scratch(spark, "test-scan")
    warc.write(pages, scratch.path("archives"))
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(scratch.path("archives")).select("path").collect()]
    whole = {f: list(warc.scan(f)) for f in files}
    monkeypatch.setattr(warc, "CHUNK", 7)
    for f in files:
        assert list(warc.scan(f)) == whole[f]


def test_keys():
    assert warc.url_key("http://WWW.Example.com/a/b?c=d#e") == "com,example,www)/a/b?c=d"
    assert warc.url_key(None) == ""


def test_marks_in_a_url_do_not_change_its_host(spark):
    urls = ["http://ex\x01ample.org/es/a", "http://x.exe", "http://a.b/\x01.zip", "http://a.b\x01/cart/"]
    rows = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in rows] == [("org/", "allow"), (None, "allow"), (None, "block"), (None, "block")]


def test_url_blocks_are_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(url_filter, "CHARACTERS", 10)
    monkeypatch.setattr(url_filter, "BLOCK", 3)
    paths = ["/abc", "", "/" * 40, "/a", "/b", "", "", "", "/123456", "/12"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(["h"] * 10), pa.array(paths)], names=["id", "host", "path"])
    got = [b.column(0).to_pylist() for b in url_filter.blocks_of(batch)]
    assert [x for b in got for x in b] == list(range(10)) and [2] in got
    assert all(len(b) <= 3 and (len(b) == 1 or sum(1 + len(paths[k]) for k in b) <= 10) for b in got)
    assert list(url_filter.blocks_of(batch.slice(0, 0))) == []
