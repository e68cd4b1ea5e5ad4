from collections import defaultdict

from kinelake.llm import common, warc


def test_lookups_search_the_directory_and_read_single_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(i, f"http://h{i % 13}.example/{i % 17 if i % 5 else 0}", f"page {i}") for i in range(200)]
    scratch = common.Scratch(spark, "test-warc-lookup")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), scratch.path("archives"))
    index = warc.CaptureIndex(spark, scratch.path("archives"), scratch)
    want = defaultdict(list)
    for r in index.captures().collect():
        want[r.key].append((r.uri, r.offset, r.length))
    assert index.directory().count() >= 200 // 3
    for url in {r[1] for r in rows[:40]}:
        assert index.lookup(url) == sorted(want[warc.url_key(url)])

    def unread():
        raise AssertionError("a block was read")

    monkeypatch.setattr(index, "blocks", unread)
    assert index.lookup("http://a.nowhere/") == index.lookup("http://zz.zzzz/") == []


def test_many_keys_are_located_through_the_directory(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    monkeypatch.setattr(warc, "ROOT", 5)
    urls = [f"http://h{i % 13}.example/{i % 17 if i % 5 else 0}" if i % 3 else "http://hot.example/" for i in range(150)] + [None, "", "http://t\tab.x/\n", "plain"]
    scratch = common.Scratch(spark, "test-warc-locate")
    pages = spark.createDataFrame([(i, u, f"page {i}") for i, u in enumerate(urls)], "page_id long, url string, html string")
    warc.write(pages.repartition(3), scratch.path("archives"))
    index = warc.CaptureIndex(spark, scratch.path("archives"), scratch)
    want = sorted((r.key, r.uri, r.offset, r.length) for r in index.captures().collect())
    keys = warc.keys_of(pages)
    assert sorted(map(tuple, index.locate(keys).collect())) == want and len(want) == len(urls)
    some = spark.createDataFrame([("example,hot)/",), ("example,h1)/1",), ("nowhere)",), ("",)], "key string")
    asked = {r.key for r in some.collect()}
    assert sorted(map(tuple, index.locate(some).collect())) == [x for x in want if x[0] in asked]
    spans = {(r.key, r.block) for r in index.spanning(some).collect()}
    assert spans == {(k, r.block) for k in asked for r in index.directory().collect() if r.first <= k <= r.last}
    assert sorted(r.id for r in index.read(keys).collect()) == list(range(len(urls)))
