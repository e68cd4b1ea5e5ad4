"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups, and a proof for each row.

A node is the lowercase hexadecimal SHA-256 of its children's, ``FAN`` neighbours each; the last node of a level may have
fewer children, even one. :class:`Forest` builds the trees of all groups in four steps:

* **Sort.** Leaves are range-sorted by group and order into a checkpointed table, so each partition is one stretch of the
  order, whatever the size of a group. A pass over it counts the first and the last group of each partition (two numbers
  for each partition); added up, they give the place of every leaf in its group and the sizes of all groups.
* **Local subtrees.** Each partition builds the complete aligned subtrees inside its stretch. What is left are the tops of
  those subtrees: one for a group that lies within the partition, and a few for each level at a ragged boundary.
* **Finish.** Ragged tops are shuffled by the coordinate of their ancestor ``STEP`` levels up, at most ``FAN ** STEP`` to
  an ancestor, and so on until one node for each group is left. The subroots then go through the same steps as one group.
* **Proofs.** Each leaf gets the siblings inside its subtree, then its subtree's, then its group's, bottom up.

Defined results: null fields are told apart from empty ones; a null group is a group, and first; null ids come first, ties
are ordered by leaf, and equal rows are leaves of their own with their own proofs; an empty table has no rows; columns that
are not named are ignored. A field of any length is hashed whole.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, scratch_dir

FAN, STEP = 3, 7
#: Leaves of a partition, at most about; partitions below which the session's own number is used; subtree tops that are broadcast.
LEAVES, FEW_LEAVES, FEW_TOPS = 1 << 18, 1 << 12, 1 << 12
PROOF = "array<struct<before:binary,after:binary>>"
PROOF_ARROW = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))
Siblings = tuple[bytes, bytes]


def field(col: Column) -> Column:
    """A field as it enters a leaf: byte count, colon and value; a dash for null."""
    text = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*[field(c) for c in cols]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give; ``leaf`` and the result are hexadecimal text."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(_hex(s["before"]), node, _hex(s["after"])), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings, level by level from the leaf, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: _hex(F.concat(s["before"], s["after"]))), ""), 256)


def _hex(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def parent(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


class Stretch:
    """Leaves that one task holds, ``begin`` onwards of a group of ``total``, and all complete nodes above them."""

    def __init__(self, begin: int, nodes: list[bytes], total: int):
        self.levels, self.begins = [nodes], [begin]
        while total > 1:
            end = begin + len(nodes)
            low, high = -(-begin // FAN), (-(-total // FAN) if end == total else end // FAN)
            if low >= high:
                break
            skip = low * FAN - begin
            nodes = [parent(nodes[k : k + FAN]) for k in range(skip, min((high - low) * FAN + skip, len(nodes)), FAN)]
            begin, total = low, -(-total // FAN)
            self.levels.append(nodes)
            self.begins.append(begin)

    def _up(self, level: int, k: int) -> int:
        """Where the parent of node k of a level is in the next one; -1 if it is not complete here."""
        if level + 1 == len(self.levels):
            return -1
        up = (self.begins[level] + k) // FAN - self.begins[level + 1]
        return up if 0 <= up < len(self.levels[level + 1]) else -1

    def tops(self) -> Iterator[tuple[int, int, bytes]]:
        """(level, place in the level's whole, digest) of nodes without a complete parent."""
        for level, nodes in enumerate(self.levels):
            ends = range(len(nodes)) if level + 1 == len(self.levels) else self._edge(level)
            for k in ends:
                if self._up(level, k) < 0:
                    yield level, self.begins[level] + k, nodes[k]

    def _edge(self, level: int) -> list[int]:
        n = len(self.levels[level])
        return [*range(min(FAN, n)), *range(max(min(FAN, n), n - FAN), n)]

    def proofs(self) -> tuple[list[list[Siblings]], list[int]]:
        """Siblings of each lowest node up to its top, and the number of that top in the order of :meth:`tops`."""
        number = {(level, place): k for k, (level, place, _) in enumerate(self.tops())}
        above: tuple[list[list[Siblings]], list[int]] = ([], [])
        for level in range(len(self.levels) - 1, -1, -1):
            nodes, begin = self.levels[level], self.begins[level]
            paths, tops = [], []
            for k in range(len(nodes)):
                up = self._up(level, k)
                if up < 0:
                    paths.append([])
                    tops.append(number[level, begin + k])
                    continue
                first = (begin + k) // FAN * FAN - begin
                step = (b"".join(nodes[first:k]), b"".join(nodes[k + 1 : first + FAN]))
                paths.append([step, *above[0][up]])
                tops.append(above[1][up])
            above = paths, tops
        return above


def _height(total: int) -> int:
    level = 0
    while total > 1:
        total, level = -(-total // FAN), level + 1
    return level


class Forest:
    """The trees of the groups of a table (grp, leaf, ...) with the order of each group. ``leaf`` is binary."""

    def __init__(self, scratch: Scratch, label: str, leaves: DataFrame, order: Sequence[str]):
        self.scratch, self.label, self.spark = scratch, label, leaves.sparkSession
        leaves = scratch.put(f"{label}-leaves", leaves.withColumn("_row", F.monotonically_increasing_id()))
        self.n = leaves.count()
        if not self.spark.sparkContext.getCheckpointDir():
            self.spark.sparkContext.setCheckpointDir(scratch_dir(self.spark))
        parts = max(-(-self.n // LEAVES), min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.n // FEW_LEAVES)), 1)
        keys = ["grp", *order, "_row"]
        dealt = leaves.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row")
        self.sorted = dealt.withColumn("part", F.spark_partition_id()).checkpoint()
        self._place()

    def _place(self) -> None:
        """For each partition: places of its first group's leaves before it, sizes of its first and last groups."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            first = last = None
            part = None
            for batch in batches:
                for value, n in _stretches(batch.column(0).to_pylist()):
                    part = batch.column(1)[0].as_py()
                    key = b"-" if value is None else hashlib.sha256(value.encode()).digest()
                    if last and last[0] == key:
                        last[1] += n
                    else:
                        last = [key, n]
                        first = first or last
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([first[0]]), pa.array([first[1]]), pa.array([last[0]]), pa.array([last[1]]), pa.array([first is last]), pa.array([part], pa.int32())], names=["first", "n_first", "last", "n_last", "single", "part"])

        counted = self.sorted.select("grp", "part").mapInArrow(count, "first binary, n_first long, last binary, n_last long, single boolean, part int")
        edges = sorted(counted.collect(), key=lambda e: e.part)  # one row for each partition
        total: dict[bytes, int] = {}
        before: dict[int, int] = {}
        for e in edges:
            before[e.part] = total.get(e.first, 0)
            total[e.first] = total.get(e.first, 0) + e.n_first
            if not e.single:
                total[e.last] = e.n_last
        self.places = {e.part: (before[e.part], total[e.first], total[e.last]) for e in edges}

    def _walk(self, each, schema: str, *columns: str) -> DataFrame:
        """``each(part, slot, group, rows, stretch)`` over the groups of each partition; slot numbers the tops so far."""
        places = self.spark.sparkContext.broadcast(self.places)  # three numbers for each partition

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, slot, opened, pending = 0, 0, False, None

            def close(rows: pa.Table, is_last: bool):
                nonlocal slot, opened
                before, first, last = places.value[part]
                digests = rows.column("leaf").to_pylist()
                begin = 0 if opened else before
                total = first if not opened else last if is_last else len(digests)
                opened = True
                stretch = Stretch(begin, digests, total)
                out = each(part, slot, rows, stretch, total)
                slot += sum(1 for _ in stretch.tops())
                return out

            for batch in batches:
                table, at = pa.Table.from_batches([batch]), 0
                part = table.column("part")[0].as_py() if len(table) else part
                for value, n in _stretches(batch.column(0).to_pylist()):
                    piece = table.slice(at, n)
                    at += n
                    if pending is not None and pending[0] == value:
                        pending[1].append(piece)
                        continue
                    if pending is not None:
                        yield from close(pa.concat_tables(pending[1]), False)
                    pending = (value, [piece])
            if pending is not None:
                yield from close(pa.concat_tables(pending[1]), True)

        return self.sorted.select("grp", "leaf", "part", *columns).mapInArrow(run, schema)

    def tops(self) -> DataFrame:
        """The tops of all complete local subtrees, see ``TOPS``; slot numbers those of a partition."""

        def each(part, slot, rows, stretch, total):
            grp, height = rows.column("grp")[0].as_py(), _height(total)
            found = [(part, slot + k, grp, height, *top) for k, top in enumerate(stretch.tops())]
            return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), TOPS.types)], schema=TOPS)]

        return self._walk(each, "part int, slot long, grp string, height int, level int, place long, digest binary")

    def finish(self) -> tuple[DataFrame, DataFrame]:
        """((part, slot, grp, proof) from each top to its group's root, (grp, digest) of the roots)."""
        put = lambda name, df: self.scratch.put(f"{self.label}-{name}", df)
        tops = put("tops", self.tops())
        roots = tops.where("level = height").select("grp", "digest")
        proofs = tops.where("level = height").select("part", "slot", "grp", F.array().cast(PROOF).alias("proof"))
        made, climbs = tops.where("false"), []
        for base in range(0, tops.agg(F.max("height")).first()[0] or 0, STEP):
            rest = tops.where(f"level between {base} and {base + STEP - 1} and level < height").unionByName(made.where("level < height"))
            climbs.append(put(f"climb{base}", _climb(rest, base + STEP)))
            made = climbs[-1].where("made").select(*tops.columns)
            roots = roots.unionByName(made.where("level = height").select("grp", "digest"))
        above = None  # (grp, place, proof) of the nodes that a climb made, from the highest climb down
        for k in reversed(range(len(climbs))):
            low = climbs[k].where("not made")
            if above is not None:
                low = low.join(above, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("up") == F.col("_place")), "left")
                low = low.withColumn("proof", F.concat("proof", F.coalesce("_proof", F.array().cast(PROOF))))
            low = put(f"proofs{k}", low.select("part", "slot", "grp", "place", "proof"))
            proofs = proofs.unionByName(low.where("part is not null").select(*proofs.columns))
            above = low.where("part is null").select(F.col("grp").alias("_grp"), F.col("place").alias("_place"), F.col("proof").alias("_proof"))
        return proofs, roots

    def local_proofs(self, *columns: str) -> DataFrame:
        """(part, slot, proof up to the top of the local subtree, grp, leaf and ``columns``) of every leaf."""
        types = {f.name: f.dataType.simpleString() for f in self.sorted.schema.fields}
        ddl = f"part int, slot long, proof {PROOF}, grp string, leaf binary" + "".join(f", `{c}` {types[c]}" for c in columns)

        def each(part, slot, rows, stretch, total):
            paths, tops = stretch.proofs()
            for at in range(0, len(paths), ROWS_OUT):
                some = paths[at : at + ROWS_OUT]
                flat = [s for p in some for s in p]
                offsets = [0, *itertools.accumulate(map(len, some))]
                pairs = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.binary()), pa.array([s[1] for s in flat], pa.binary())], names=["before", "after"])
                proof = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
                n = len(some)
                own = [pa.array([part] * n, pa.int32()), pa.array([slot + t for t in tops[at : at + n]], pa.int64()), proof]
                rest = rows.slice(at, n).combine_chunks()
                given = [rest.column(c).chunk(0) if n else pa.array([]) for c in ("grp", "leaf", *columns)]
                yield pa.RecordBatch.from_arrays(own + given, names=["part", "slot", "proof", "grp", "leaf", *columns])

        return self._walk(each, ddl, *columns)


def _stretches(values: list) -> Iterator[tuple[object, int]]:
    return ((value, sum(1 for _ in same)) for value, same in itertools.groupby(values))


def _climb(nodes: DataFrame, target: int) -> DataFrame:
    """Finishes the levels below ``target`` (or a lower root). Rows of ``TOPS`` for the ancestors (made), and the nodes
    themselves with the place of their ancestor and the siblings on the way to it."""
    reach = F.least(F.lit(target), F.col("height"))
    spans = F.array(*[F.lit(FAN**k) for k in range(STEP + 1)])
    dealt = nodes.withColumn("to", reach).withColumn("span", F.get(spans, F.col("to") - F.col("level")))
    dealt = dealt.withColumn("up", F.expr("cast(place div span as long)")).drop("span")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        to, height = int(rows["to"].iloc[0]), int(rows["height"].iloc[0])
        held: dict[tuple[int, int], bytes] = {(int(n), int(p)): bytes(d) for n, p, d in zip(rows["level"], rows["place"], rows["digest"])}
        family: dict[tuple[int, int], list[int]] = defaultdict(list)
        for level in range(int(rows["level"].min()), to):
            for n, place in sorted(k for k in held if k[0] == level):
                family[level, place // FAN].append(place)
            for (n, up), places in family.items():
                if n == level:
                    held[level + 1, up] = parent([held[level, p] for p in places])
        out = rows.assign(made=False)
        out["proof"] = [[_step(held, family, n, int(place) // FAN ** (n - level)) for n in range(level, to)] for level, place in zip(rows["level"], rows["place"])]
        up = int(rows["up"].iloc[0])
        top = {"part": None, "slot": None, "grp": rows["grp"].iloc[0], "height": height, "level": to, "place": up, "digest": held[to, up], "up": None, "made": True, "proof": []}
        out = [*out[list(top)].astype(object).to_dict("records"), top]
        return pd.DataFrame(out, columns=list(top), dtype=object)

    ddl = f"part int, slot long, grp string, height int, level int, place long, digest binary, up long, made boolean, proof {PROOF}"
    return dealt.groupBy("grp", "to", "up").applyInPandas(run, ddl)


def _step(held: dict, family: dict, level: int, place: int) -> dict[str, bytes]:
    others = family[level, place // FAN]
    return {"before": b"".join(held[level, p] for p in others if p < place), "after": b"".join(held[level, p] for p in others if p > place)}


ROWS_OUT = 2048
TOPS = pa.schema([("part", pa.int32()), ("slot", pa.int64()), ("grp", pa.string()), ("height", pa.int32()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.binary())])


def manifest(docs: DataFrame, fields: Sequence[str], group_col: str = "source", order_col: str = "doc_id", **extra: Column) -> DataFrame:
    """(``order_col``, leaf, subroot, root, proof, ``extra``) for each row. ``fields`` are the columns that a leaf covers;
    digests are hexadecimal text, ``proof`` is bottom up: binary digests before and after the node at each level."""
    scratch = Scratch(docs.sparkSession, "merkle")
    leaf = F.unhex(leaf_digest(*[F.col(f"`{c}`") for c in fields])).alias("leaf")
    given = [c.alias(f"_{name}") for name, c in extra.items()]
    rows = docs.select(F.col(f"`{group_col}`").cast("string").alias("grp"), F.col(f"`{order_col}`").alias("_id"), leaf, *given)
    forest = Forest(scratch, "rows", rows, ["_id", "leaf"])
    uppers, subroots = forest.finish()
    groups = Forest(scratch, "groups", subroots.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("name"), F.col("digest").alias("leaf")), ["name"])
    tops, roots = groups.finish()
    own = groups.local_proofs("name").join(tops.select("part", "slot", F.col("proof").alias("more")), ["part", "slot"])
    own = scratch.put("own", own.select("name", F.col("leaf").alias("subroot"), F.concat("proof", "more").alias("last")))
    uppers = scratch.put("uppers", uppers.join(_small(own), F.col("grp").eqNullSafe(F.col("name"))).select("part", "slot", F.concat("proof", "last").alias("more"), "subroot"))
    root = roots.select("digest").first()
    out = forest.local_proofs("_id", *[f"_{name}" for name in extra]).join(_small(uppers), ["part", "slot"])
    return out.select(
        F.col("_id").alias(order_col), _hex(F.col("leaf")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"), F.lit(root.digest.hex() if root else None).alias("root"),
        F.concat("proof", "more").alias("proof"), *[F.col(f"_{name}").alias(name) for name in extra],
    )


def _small(table: DataFrame) -> DataFrame:
    """Broadcast a written table of few rows (of a few kilobytes each); any other is shuffled."""
    return F.broadcast(table) if table.count() <= FEW_TOPS else table


def oracle_sql() -> str:
    """The same rows for ``documents`` by source in DuckDB, as lists of nodes. CRC-32 is folded bit by bit."""
    part = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    bit = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384::bigint) else c // 2 end)"
    crc = f"xor(4294967295::bigint, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(doc_id as varchar), ''), lambda c: ascii(c)::bigint)), lambda a, b: {bit}))"
    run = "nodes[(i // 3) * 3 + 1 : (i // 3) * 3 + 3]"
    siblings = f"list_aggregate({run}[: i % 3], 'string_agg', '')", f"list_aggregate({run}[i % 3 + 2 :], 'string_agg', '')"
    climb = lambda name, key: f"""{name} as (
            select {key}, 0 as level, list(digest order by place) as nodes from {name}_leaves group by {key}
            union all
            select {key}, level + 1, list_transform(range((len(nodes) + 2) // 3), lambda k: sha256(list_aggregate(nodes[3 * k + 1 : 3 * k + 3], 'string_agg', ''))) from {name} where len(nodes) > 1
        )"""  # noqa: E731
    return f"""
        with recursive l as (select doc_id, coalesce('+' || source, '-') as s, {leaf("text")} as digest, {crc} as crc, {leaf("replace(text, chr(10), '')")} as struck from documents),
        rows_leaves as (select *, row_number() over (partition by s order by doc_id nulls first, digest) - 1 as place from l),
        {climb("rows", "s")},
        subroots as (select s, nodes[1] as digest from rows where len(nodes) = 1),
        groups_leaves as (select s, digest, 0 as one, row_number() over (order by s <> '-', s) - 1 as place from subroots),
        {climb("groups", "one")},
        steps as (
            select r.doc_id, r.s, r.place, r.digest, r.crc, r.struck, 0 as half, t.level, t.nodes, r.place // cast(power(3, t.level) as bigint) as i from rows_leaves r join rows t on t.s = r.s where len(t.nodes) > 1
            union all
            select r.doc_id, r.s, r.place, r.digest, r.crc, r.struck, 1, t.level, t.nodes, g.place // cast(power(3, t.level) as bigint) from rows_leaves r join groups_leaves g on g.s = r.s join groups t on len(t.nodes) > 1
        ),
        sided as (select s, place, half, level, coalesce({siblings[0]}, '') as before, coalesce({siblings[1]}, '') as after from steps),
        proofs as (select s, place, list(before || '|' || after order by half, level) as proof from sided group by 1, 2),
        root as (select nodes[1] as root from groups where len(nodes) = 1),
        folded as (
            select r.doc_id, r.digest as leaf, b.digest as subroot, root.root, coalesce(p.proof, []) as proof,
                case when r.crc % 2 = 0 and r.struck is not null then r.struck else r.digest end as told
            from rows_leaves r join subroots b on b.s = r.s cross join root left join proofs p on p.s = r.s and p.place = r.place
        ),
        done as (
            select doc_id, leaf, subroot, root, sha256(coalesce(replace(list_aggregate(proof, 'string_agg', ''), '|', ''), '')) as proof_sha256,
                list_reduce(list_prepend(told, proof), lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) as folded_root
            from folded
        )
        select *, folded_root = root as verified from done
    """
