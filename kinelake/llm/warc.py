"""WARC archives and a two-level capture index.

Writing: one record for each page, payload behind an HTTP header; of pages with equal payloads of at least ``least``
bytes, the one with the largest id is a response and the others are revisits that refer to it. Spark's text writer puts
the records into files, ended as the format asks, so archives can be in any store that Spark writes.

Indexing: a scan notes each record's place under its URL's key with the host reversed. Keys are sorted over all archives
and go into compressed blocks of ``BLOCK`` lines; a sparse directory has the first key of each block.

Reading: a lookup finds its block by binary search in the directory, its lines by binary search in the block, and its
records by range reads. Many keys are looked up together: ``ROOT`` keys of the directory at most deal it and them to
tasks, each of which searches its part of the directory; blocks then meet the keys that they may hold.

Defined results: a null html is an empty payload; a null URL has an empty key; rows with one id and equal payloads have
the same type; a null id ranks below every other; an empty table gives an empty result; columns other than id, URL and
html are ignored and may have any name. The shared folder must be one that pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import out_batches
from .common import Scratch, bitmap_filter, join_groups, might_contain

END = "\r\n\r\n"
#: Lines of an index block; records of an archive; bytes that one read asks for.
BLOCK, RECORDS, CHUNK = 512, 2000, 1 << 20
#: Keys that deal the directory to tasks, and most characters of one: 4 MB in the driver and in a task.
ROOT, ROOT_KEY = 4096, 256
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """Base32 of a SHA-1 in hexadecimal: 20 bits are five digits of one and four of the other."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    out = []
    for k in range(8):
        n = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(alphabet), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def typed(pages: DataFrame, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, sha1, refers_to): refers_to is null for responses. Only pages with an equal one are shuffled."""
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1(F.col("payload").cast("binary")))
    scratch = Scratch(pages.sparkSession, "warc-groups")
    equal = rows.where(F.octet_length("payload") >= least).groupBy("sha1").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("n"))
    equal = scratch.put("equal", equal.where("n > 1"))
    marked = might_contain(rows, "sha1", bitmap_filter(equal, "sha1"))
    alone = marked.where("not _hit").select("id", "url", "payload", "sha1", F.lit(None).cast("long").alias("refers_to"))
    met = join_groups(marked.where("_hit").drop("_hit"), equal, "sha1", "n", how="left")
    again = F.col("n").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep"))
    return alone.unionByName(met.select("id", "url", "payload", "sha1", F.when(again, F.col("keep")).alias("refers_to")))


def records(rows: DataFrame, date: str = DATE) -> DataFrame:
    """One text column with each record, but for its end."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("payload").cast("string"), F.lit(END))
    block = F.when(again, http).otherwise(F.concat(http, "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name(F.col("id")),
        F.lit(f"\r\nWARC-Date: {date}\r\n"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " "), F.lit("\r\n")), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"),
        base32(F.col("sha1")),
        F.coalesce(F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), F.when(again, name(F.col("refers_to")))), F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
    )
    return rows.withColumn("block", block).select(F.concat(head, F.octet_length("block").cast("string"), F.lit(END), "block").alias("value"))


def write(pages: DataFrame, path: str, least: int = 0, **names: str) -> None:
    """Writes the archives of ``pages`` into the folder ``path``."""
    records(typed(pages, least, **names)).write.option("lineSep", END).option("maxRecordsPerFile", str(RECORDS)).mode("overwrite").text(path)


BREAKS = str.maketrans("\t\r\n", "   ")


def url_key(url: str | None) -> str:
    """com,example,www)/path?query of http://www.example.com/path?query; the host in small letters, no scheme."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    cut = min((k for k in (rest.find(c) for c in "/?#") if k >= 0), default=len(rest))
    host = rest[:cut].lower()
    key = ",".join(reversed(host.split("."))) + ")" + rest[cut:].partition("#")[0]
    return key.translate(BREAKS)  # a line of a block has tabs between its parts


def _open(uri: str) -> pa.NativeFile:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def parse_head(raw: bytes) -> dict[str, str]:
    """The header lines of a record, by lower-case name."""
    lines = raw.decode("utf-8").split("\r\n")
    return {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])} | {"": lines[0]}


def scan(uri: str) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(offset, length, header) of each record of an archive, in order, without holding more than one record."""
    with _open(uri) as file:
        size, at, held, start = file.size(), 0, b"", 0  # held: the file's bytes from start
        while at < size:
            while (cut := held.find(END.encode(), at - start)) < 0 and start + len(held) < size:
                held, start = held[at - start :], at
                held += file.read_at(min(CHUNK, size - start - len(held)), start + len(held))
            if cut < 0:
                raise ValueError(f"{uri}: no record at {at}")
            head = parse_head(held[at - start : cut])
            if not head[""].startswith("WARC/"):
                raise ValueError(f"{uri}: no record at {at}")
            length = cut + 4 - (at - start) + int(head["content-length"]) + 4
            yield at, length, head
            at += length
            if at >= start + len(held):
                held, start = b"", at
            else:
                held, start = held[at - start :], at


class CaptureIndex:
    """The two-level index of a folder of archives."""

    def __init__(self, spark: SparkSession, archives: str, scratch: Scratch | None = None):
        self.spark, self.archives = spark, archives
        self.scratch = scratch or Scratch(spark, "capture-index")
        self._blocks: DataFrame | None = None
        self._directory: DataFrame | None = None
        self._spans: tuple[list[str], list[str]] | None = None

    def captures(self) -> DataFrame:
        """(key, uri, offset, length) of each record, from a scan of the archives."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(self.archives).select("path")
        schema = pa.schema([("key", pa.string()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((url_key(head.get("warc-target-uri")), uri, at, length) for b in batches for uri in b.column(0).to_pylist() for at, length, head in scan(uri))
            yield from out_batches(rows, schema, lambda _: 200)

        return files.mapInArrow(run, "key string, uri string, `offset` long, length long")

    def blocks(self) -> DataFrame:
        """(first, last, n, data, block): compressed lines in the order of their keys, one row for each block."""
        if self._blocks is None:
            made = self.scratch.put("captures", self.captures())
            ordered = made.repartitionByRange("key", "uri", "offset").sortWithinPartitions("key", "uri", "offset")
            schema = pa.schema([("first", pa.string()), ("last", pa.string()), ("n", pa.int32()), ("data", pa.binary())])

            def pack(lines: list[tuple]) -> tuple:
                text = "\n".join("\t".join((k, u, str(o), str(n))) for k, u, o, n in lines)
                return lines[0][0], lines[-1][0], len(lines), zlib.compress(text.encode("utf-8", "surrogatepass"), 6)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                def packed() -> Iterator[tuple]:
                    held: list[tuple] = []
                    for b in batches:
                        for row in zip(*(b.column(k).to_pylist() for k in range(4))):
                            held.append(row)
                            if len(held) == BLOCK:
                                yield pack(held)
                                held = []
                    if held:
                        yield pack(held)

                yield from out_batches(packed(), schema)

            packed = ordered.mapInArrow(run, "first string, last string, n int, data binary")
            self._blocks = self.scratch.put("blocks", packed.withColumn("block", F.monotonically_increasing_id()))
        return self._blocks

    def directory(self) -> DataFrame:
        """(first, last, n, block): the sparse directory, a written table with the first and last key of each block."""
        if self._directory is None:
            self._directory = self.scratch.put("directory", self.blocks().select("first", "last", "n", "block"))
        return self._directory

    def spanning(self, keys: DataFrame) -> DataFrame:
        """(key, block): the blocks whose span holds a key, by binary search in the directory.

        A key and the blocks around it meet in the slot between two root keys. A task holds the directory's rows of one
        slot at a time, which is about one of ``ROOT``, and takes the slot's keys one after another.
        """
        firsts = self.directory().select(F.substring("first", 1, ROOT_KEY).alias("first")).distinct()
        root = sorted(r["first"] for r in firsts.orderBy(F.xxhash64("first"), "first").limit(ROOT).collect())
        schema = pa.schema([("slot", pa.int32()), ("kind", pa.int32()), ("key", pa.string()), ("last", pa.string()), ("block", pa.int64())])
        ddl = "slot int, kind int, key string, last string, block long"

        def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in range(3))))
            yield from out_batches(((slot, 0, first, last, block) for first, last, block in rows for slot in range(bisect_right(root, first), bisect_right(root, last) + 1)), schema, lambda _: 200)

        def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from out_batches(((bisect_right(root, key), 1, key, None, None) for b in batches for key in b.column(0).to_pylist()), schema, lambda _: 200)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[tuple]:
                at, low, high, numbers = None, [], [], []
                for b in batches:
                    for slot, kind, key, last, block in zip(*(b.column(k).to_pylist() for k in range(5))):
                        if slot != at:
                            at, low, high, numbers = slot, [], [], []
                        if kind == 0:
                            low.append(key)
                            high.append(last)
                            numbers.append(block)
                            continue
                        for k in range(bisect_left(high, key), bisect_right(low, key)):
                            yield key, numbers[k]

            yield from out_batches(found(), pa.schema([("key", pa.string()), ("block", pa.int64())]), lambda _: 200)

        dealt = self.directory().select("first", "last", "block").mapInArrow(entries, ddl).unionByName(keys.select("key").mapInArrow(wanted, ddl))
        ordered = dealt.repartition("slot").sortWithinPartitions("slot", "kind", "key", "last", "block")
        return ordered.mapInArrow(search, "key string, block long")

    def locate(self, keys: DataFrame) -> DataFrame:
        """(key, uri, offset, length): the captures of distinct keys, by binary search in the blocks that span them."""
        met = self.spanning(keys)
        rows = self.blocks().select("block", F.lit(None).cast("string").alias("key"), "data").unionByName(met.select("block", "key", F.lit(None).cast("binary").alias("data")))
        ordered = rows.repartition("block").sortWithinPartitions("block", F.col("key").asc_nulls_first())
        schema = pa.schema([("key", pa.string()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def found() -> Iterator[tuple]:
                at, data, lines, own = None, b"", [], []
                for b in batches:
                    for block, key, packed in zip(*(b.column(k).to_pylist() for k in range(3))):
                        if block != at:
                            at, data, lines = block, packed, []
                            continue
                        if not lines:  # only blocks with a key are unpacked
                            lines = lines_of(data)
                            own = [x[0] for x in lines]
                        yield from lines[bisect_left(own, key) : bisect_right(own, key)]

            yield from out_batches(found(), schema, lambda _: 200)

        return ordered.mapInArrow(search, "key string, uri string, `offset` long, length long")

    def lookup(self, url: str) -> list[tuple[str, int, int]]:
        """(uri, offset, length) of the captures of one URL.

        Binary search in the directory, which the driver holds from the first lookup on, finds the blocks that span the
        key; only those are read, and the lines inside are found by binary search.
        """
        if self._spans is None:
            rows = sorted((r["first"], r["last"]) for r in self.directory().collect())
            self._spans = [r[0] for r in rows], [r[1] for r in rows]
        key = url_key(url)
        firsts, lasts = self._spans
        low, high = bisect_left(lasts, key), bisect_right(firsts, key)
        if low >= high:
            return []
        spanning = self.blocks().where(F.col("first").isin(sorted(set(firsts[low:high]))) & F.col("last").isin(sorted(set(lasts[low:high]))))
        found = []
        for row in spanning.collect():
            lines = lines_of(bytes(row["data"]))
            keys = [x[0] for x in lines]
            found += [x[1:] for x in lines[bisect_left(keys, key) : bisect_right(keys, key)]]
        return sorted(found)

    def read(self, keys: DataFrame) -> DataFrame:
        """(id, url, record_type, refers_to, digest, payload) of the captures of distinct keys, found through the index
        and read by ranges."""
        places = self.locate(keys).select("uri", "offset", "length")
        # An archive has a bounded number of records: its reads stay together, in order.
        ordered = places.repartition("uri").sortWithinPartitions("uri", "offset")
        out = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest", pa.string()), ("payload", pa.binary())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from out_batches(ranged(batches), out)

        return ordered.mapInArrow(run, "id long, url string, record_type string, refers_to long, digest string, payload binary")


def lines_of(data: bytes) -> list[tuple[str, str, int, int]]:
    """(key, uri, offset, length) of a block."""
    rows = (x.split("\t") for x in zlib.decompress(data).decode("utf-8", "surrogatepass").split("\n"))
    return [(k, u, int(o), int(n)) for k, u, o, n in rows]


def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Range reads of (uri, offset, length); neighbours share one read of at most CHUNK bytes."""
    file, name, held, start = None, None, b"", 0
    for b in batches:
        for uri, at, length in zip(*(b.column(k).to_pylist() for k in range(3))):
            if uri != name:
                if file:
                    file.close()
                file, name, held, start = _open(uri), uri, b"", 0
            if not (start <= at and at + length <= start + len(held)):
                held, start = file.read_at(max(CHUNK, length), at), at
            yield record_of(held[at - start : at - start + length])
    if file:
        file.close()


def record_of(raw: bytes) -> tuple:
    """(id, url, record_type, refers_to, digest, payload) of a record's bytes."""
    cut = raw.index(END.encode())
    head = parse_head(raw[:cut])
    block = raw[cut + 4 : cut + 4 + int(head["content-length"])]
    page = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None
    return page(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], page(head.get("warc-refers-to")), head["warc-payload-digest"].removeprefix("sha1:"), block[block.index(END.encode()) + 4 :]


def keys_of(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """(key): the distinct keys of the pages' URLs, as their records state them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(0).to_pylist()], pa.string())], names=["key"])

    stated = pages.select(F.regexp_replace(F.col(f"`{url_col}`").cast("string"), r"[\r\n]+", " ").alias("url")).distinct()
    return stated.mapInArrow(run, "key string").distinct()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def round_trip(pages: DataFrame, least: int = 0, **names: str) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each page, from its record in the archives.

    A response's digest is computed from the payload that was read; a revisit has that of the response it refers to.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    write(pages, scratch.path("archives"), least, **names)
    index = CaptureIndex(spark, scratch.path("archives"), scratch)
    schema = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for i, kind, refers, said, payload in zip(*(b.column(k) for k in range(5))):
                    data = payload.as_py()
                    if kind.as_py() == "response":
                        if (own := digest_of(data)) != said.as_py():
                            raise ValueError(f"record {i}: its payload has another digest")
                        yield i.as_py(), len(data), own, "response", None
                    else:
                        yield i.as_py(), None, said.as_py(), "revisit", refers.as_py()

        yield from out_batches(rows(), schema, lambda _: 100)

    read = index.read(keys_of(pages, names.get("url_col", "url"))).select("id", "record_type", "refers_to", "digest", "payload")
    seen = scratch.put("seen", read.mapInArrow(judge, "id long, payload_bytes long, payload_digest string, record_type string, refers_to long"))
    responses = seen.where("record_type = 'response'")
    revisits = seen.where("record_type = 'revisit'").drop("payload_bytes")
    referred = revisits.groupBy("refers_to", "payload_digest").agg(F.count(F.lit(1)).alias("n"))
    sizes = responses.select(F.col("id").alias("refers_to"), "payload_digest", "payload_bytes").dropDuplicates(["refers_to", "payload_digest"])
    targets = referred.join(sizes, ["refers_to", "payload_digest"]).select("refers_to", "payload_digest", "payload_bytes", "n")
    targets = scratch.put("targets", targets.withColumn("ref", F.struct("refers_to", "payload_digest")).select("ref", "payload_bytes", "n"))
    resolved = join_groups(revisits.withColumn("ref", F.struct("refers_to", "payload_digest")), targets, "ref", "n", how="left")
    columns = ["id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return responses.select(*columns).unionByName(resolved.select(*columns)).withColumnRenamed("id", names.get("id_col", "page_id"))


def oracle_sql(least: int = 0) -> str:
    """The result in DuckDB SQL."""
    code = "list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(p.s, 5 * (i // 4)::int + 1, 5))::bigint >> (15 - 5 * (i % 4)::int)) & 31)::int + 1, 1)), 'string_agg', '')"
    return f"""
        with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as s from pages),
        g as (select s, max(page_id) as keep from p where strlen(t) >= {least} group by s)
        select p.page_id, strlen(t)::bigint as payload_bytes, {code} as payload_digest,
               case when g.keep is null or g.keep = p.page_id then 'response' else 'revisit' end as record_type,
               case when g.keep <> p.page_id then g.keep end as refers_to
        from p left join g on p.s = g.s and strlen(p.t) >= {least}
    """
