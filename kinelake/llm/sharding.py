"""Sharding by extendible hashing.

A document's bucket is a prefix of its id's hash bits. The directory starts as one bucket; a bucket above the byte limit
splits on its next bit, and only such buckets do, until every one fits. The sums of ``STEP`` levels come from one
aggregation of the cells below them (at most 2 ** STEP cells in the first round, which may be broadcast); cells that are
still too large go on to the next levels, alone.

Where all bits are used up (rows with one id), a bucket fills pages by running bytes instead. A document above the limit
has a page to itself.

Defined results: a null text has 0 bytes; a null id hashes like an empty one; repeated rows each get their own row; an
empty table gives an empty result; columns other than id and text are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, join_groups

BITS, STEP = 60, 12
LIMIT = 1 << 20
#: Copies of one row that one task deals to pages.
STRETCH = 1000
#: Pages of alike rows, and of the classes of sizes; those of the last hold at most 1/32 of the limit in a row.
CLASSES = 6


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, h): h has the first 60 bits of the id's MD5."""
    bits = F.conv(F.substring(F.md5(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`").cast("string")), F.lit(0)).cast("long")
    return docs.select(F.col(f"`{id_col}`").alias("id"), size.alias("n_bytes"), bits.alias("h"))


def _depths(cells: DataFrame, base: int, deep: int, limit: int, scratch: Scratch) -> DataFrame:
    """(cell, depth): the least depth from ``base`` to ``deep`` at which the cell's bucket fits; null if none does.

    A short prefix has many cells: it meets them like any hot key.
    """
    levels = cells.withColumn("d", F.explode(F.sequence(F.lit(base), F.lit(deep))))
    levels = levels.select("cell", "n_bytes", "d", F.struct("d", F.expr(f"shiftright(cell, {deep} - d)").alias("p")).alias("node"))
    sums = levels.groupBy("node").agg(F.sum("n_bytes").alias("total"), F.count(F.lit(1)).alias("cells"))
    fits = join_groups(levels.select("cell", "d", "node"), scratch.put(f"sums{deep}", sums), "node", "cells", how="inner")
    return fits.groupBy("cell").agg(F.min(F.when(F.col("total") <= limit, F.col("d"))).alias("depth"))


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, depth, prefix, page, shard) of each row; shard names the three that come before it."""
    scratch = Scratch(docs.sparkSession, "sharding")
    todo = scratch.put("rows", hashed(docs, id_col, text_col))
    base, out = 0, None
    while True:
        deep = min(BITS, base + STEP)
        cell = F.shiftright("h", BITS - deep)
        sums = todo.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
        depths = scratch.put(f"depths{deep}", _depths(scratch.put(f"cells{deep}", sums), base, deep, limit, scratch))
        side = F.broadcast(depths) if base == 0 else depths  # 2 ** STEP rows at most in the first round
        placed = todo.withColumn("cell", cell).join(side, "cell")
        done = placed.where("depth is not null").select("id", "n_bytes", "depth", F.expr(f"shiftright(h, {BITS} - depth)").alias("prefix"), F.lit(0).cast("long").alias("page"))
        out = done if out is None else out.unionByName(done)
        if not depths.where("depth is null").take(1):
            break
        rest = placed.where("depth is null").select("id", "n_bytes", "h")
        if deep == BITS:
            out = out.unionByName(_pages(rest, limit))
            break
        todo = scratch.put(f"rows{deep}", rest)
        base = deep + 1
    return out.select(F.col("id").alias(id_col), "n_bytes", "depth", "prefix", "page", F.concat_ws("-", "depth", "prefix", "page").alias("shard"))


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """Pages of buckets whose rows share all bits.

    Rows of one id and size are alike: they are counted, not gathered, and fill pages of their own as long as they fill
    them. The rest, at most a page of each, is placed by running bytes over one order, in classes by size: above 1/4 of
    the limit, above 1/8, and so on. A page takes the rows that begin in one window of the running bytes; a window is the
    limit less the class's largest size, so that a page fits. Page numbers name class and place: they have gaps.
    """
    ratio = F.lit(limit) / F.greatest("n_bytes", F.lit(1))
    alike = rows.groupBy("h", "id", "n_bytes").agg(F.count(F.lit(1)).alias("copies")).withColumn("fit", F.greatest(F.lit(1), F.floor(ratio)))
    doubled = F.filter(F.array(*[F.lit(float(2**c)) for c in range(2, CLASSES)]), lambda two: ratio >= two)
    each = alike.withColumn("c", 1 + F.size(doubled)).withColumn("full", F.expr("copies div fit"))
    order = lambda *by: Window.partitionBy(*by).orderBy("id", "n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("pages", F.coalesce(F.sum("full").over(order("h")), F.lit(0)))
    each = each.withColumn("bytes", F.coalesce(F.sum(F.expr("n_bytes * (copies % fit)")).over(order("h", "c")), F.lit(0)))
    # A row with many copies is dealt out in stretches before it becomes rows again.
    dealt = each.withColumn("from", F.explode(F.expr(f"sequence(0L, copies - 1, {STRETCH}L)")))
    dealt = dealt.repartition("h", "id", "n_bytes", "from").withColumn("i", F.explode(F.expr(f"sequence(from, least(from + {STRETCH} - 1, copies - 1))")))
    own = F.expr(f"(pages + i div fit) * {CLASSES}")
    shared = F.expr(f"((bytes + (i - full * fit) * n_bytes) div ({limit}L - ({limit}L div shiftleft(1L, c)))) * {CLASSES} + c")
    page = F.when(F.expr("i < full * fit"), own).otherwise(shared).cast("long")
    return dealt.select("id", "n_bytes", F.lit(BITS).alias("depth"), F.col("h").alias("prefix"), page.alias("page"))


def directory(assigned: DataFrame) -> DataFrame:
    """(shard, depth, prefix, page, documents, n_bytes): one row for each shard."""
    return assigned.groupBy("shard", "depth", "prefix", "page").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_bytes").alias("n_bytes"))


def oracle_sql(limit: int = LIMIT) -> str:
    return f"""
        with r as (select doc_id, coalesce(strlen(text), 0) as n_bytes, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
        s as (select d, (h >> (60 - d)) as p, sum(n_bytes) as total from r, (select unnest(range(0, 61))::int as d) group by 1, 2),
        l as (select doc_id, n_bytes, h, min(d) as depth from r join s on s.p = (r.h >> (60 - s.d)) where total <= {limit} group by 1, 2, 3)
        select doc_id, n_bytes, depth, (h >> (60 - depth)) as prefix, 0::bigint as page,
               depth || '-' || (h >> (60 - depth)) || '-0' as shard from l
    """
