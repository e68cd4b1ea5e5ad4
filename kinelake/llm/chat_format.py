"""Conversations as training windows of a token budget, with a loss mask.

Each turn becomes a piece of text between marks of its role; control strings inside texts are escaped reversibly. A
window is a stretch of whole turns. Prefix sums of the turns' tokens say where it ends: as many turns as the budget holds.
Each window but the first repeats the leading system turn and the last turns before it, up to ``history`` tokens; repeated
turns are context only, so every assistant text is under the loss mask of one window.

A conversation is one group of one shuffle unless it may have more than ``block`` tokens. Longer ones are sorted by range
and counted by partition; the prefix sums then cut them into blocks of ``block`` tokens, which are groups of their own and
get the system turn and the turns that they may repeat. So no task gathers more than a block, and windows also end there.

Defined results: rows go by turn, then role, then text, nulls first; a null text or role is empty; rows with a null id are
one conversation; repeated rows are turns of their own; a turn longer than the budget has a window of its own, uncut, with
the system turn; an empty table has no windows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import load
from .common import Scratch, bitmap_filter, might_contain

#: The marks of the template: fixed values. Other roles are named in their mark.
START, ESCAPE = "<s>", "\\"
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
NAMED = ("[ROLE]", "[=]", "[/ROLE]")
CONTROL = [START, *itertools.chain(*MARKS.values()), *NAMED]

#: Tokens of a window, of what it repeats, and of a block of a long conversation; bytes of text that may become one token less.
BUDGET, HISTORY, BLOCK, SPARE = 4096, 1024, 1 << 20, 4
#: Turns and characters that are encoded together, and rows of a partition of long conversations.
TURNS, CHARS, ROWS = 2048, 1 << 20, 1 << 18
SYSTEM, PAST, NEW = 0, 1, 2
WINDOWS = "conv_id long, block long, window long, whole boolean, n_repeated int, n_tokens long, text string, loss array<struct<start:int,stop:int>>"
LOSS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

_inside = re.compile("(" + re.escape(ESCAPE) + ")|([<\\[])(?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_escaped = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
_turn = re.compile("|".join([rf"{re.escape(a)}(?P<{role}>.*?){re.escape(b)}" for role, (a, b) in MARKS.items()] + [rf"{re.escape(NAMED[0])}(?P<role>.*?){re.escape(NAMED[1])}(?P<other>.*?){re.escape(NAMED[2])}"]), re.DOTALL)


def escape(text: str) -> str:
    """Doubles each escape character and puts one behind the first character of each control string."""
    return _inside.sub(lambda m: 2 * ESCAPE if m[1] else m[2] + ESCAPE, text)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text) if ESCAPE in text else text


def piece(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its text begins and ends."""
    opening, closing = MARKS[role] if role in MARKS else (NAMED[0] + escape(role) + NAMED[1], NAMED[2])
    inner = escape(text)
    return opening + inner + closing, len(opening), len(opening) + len(inner)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    out = []
    for m in _turn.finditer(text):
        role = m.lastgroup
        out.append((unescape(m["role"]), unescape(m["other"])) if role == "other" else (role, unescape(m[role])))
    return out


@dataclass
class Group:
    """The turns of a conversation, or of one block of it, in order."""

    conv_id: int | None
    block: int
    whole: bool
    kinds: list[int] = field(default_factory=list)
    roles: list[str] = field(default_factory=list)
    pieces: list[tuple[str, int, int]] = field(default_factory=list)

    def windows(self, tokens: list[int], start: int, budget: int, history: int) -> Iterator[tuple]:
        """Rows of ``WINDOWS``; ``start`` is the cost of a window's own mark."""
        if NEW not in self.kinds:
            return
        leads = self.kinds[0] == SYSTEM or (self.block == 0 and self.roles[0] == "system")
        body = 1 if leads else 0
        ends = [0, *itertools.accumulate(tokens[body:])]
        room = budget - start - (tokens[0] if leads else 0)
        last, number = len(ends) - 1, 0
        at = self.kinds.index(NEW, body) - body if last and NEW in self.kinds[body:] else last
        while at < last or not number:
            fresh = self.block == 0 and number == 0
            back = at if fresh or at == last else bisect_left(ends, max(ends[at] - history, ends[at + 1] - room), 0, at)
            to = max(bisect_right(ends, ends[back] + room) - 1, min(at + 1, last))
            chosen = [*range(body), *range(body + back, body + to)]
            repeated = (body if not fresh else 0) + at - back
            text, loss = [START], []
            length = len(START)
            for k, n in enumerate(chosen):
                written, a, b = self.pieces[n]
                if k >= repeated and self.roles[n] == "assistant":
                    loss.append({"start": length + a, "stop": length + b})
                text.append(written)
                length += len(written)
            yield self.conv_id, self.block, number, self.whole, repeated, start + sum(tokens[n] for n in chosen), "".join(text), loss
            at, number = to, number + 1


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
    group = None
    for batch in batches:
        for conv, block, whole, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "whole", "kind", "role", "text"))):
            if group is None or (group.conv_id, group.block) != (conv, block):
                if group is not None:
                    yield group
                group = Group(conv, block, whole)
            group.kinds.append(kind)
            group.roles.append(role)
            group.pieces.append(piece(role, text))
    if group is not None:
        yield group


def _tokens(texts: list[str], path: str) -> list[int]:
    return [len(ids) // 4 for ids in load(path).encode_block(texts)]


def windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """``WINDOWS`` of (conv_id, turn, role, text) rows. The rows of a conversation come together and in order."""
    if not 0 <= history <= block or budget < 1:
        raise ValueError("history must be at most a block, the budget at least one token")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    scratch = Scratch(turns.sparkSession, "chat")
    weight = F.octet_length("text") + F.octet_length("role") + 32
    heavy = rows.groupBy("conv_id").agg(F.sum(weight.cast("long")).alias("n")).where(F.col("n") * SPARE > block)
    heavy = scratch.put("long", heavy.select("conv_id"))
    plain = [F.lit(0).cast("long").alias("block"), F.lit(True).alias("whole"), F.lit(NEW).alias("kind")]
    if heavy.take(1):
        marked = might_contain(rows, "conv_id", bitmap_filter(heavy, "conv_id"))
        rows = marked.where("not _hit").drop("_hit").select("*", *plain).unionByName(_blocks(scratch, marked.where("_hit").drop("_hit"), path, history, block))
    else:
        rows = rows.select("*", *plain)
    order = ["conv_id", "block", "kind", "turn", "role", "text"]
    dealt = rows.repartition("conv_id", "block").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = _tokens([START], path)[0]
        held: list[Group] = []
        n = chars = 0
        for group in itertools.chain(_groups(batches), [None]):
            if group is not None:
                held.append(group)
                n += len(group.pieces)
                chars += sum(len(p[0]) for p in group.pieces)
            if held and (group is None or n >= TURNS or chars >= CHARS):
                tokens = iter(_tokens([p[0] for g in held for p in g.pieces], path))
                made = [w for g in held for w in g.windows(list(itertools.islice(tokens, len(g.pieces))), start, budget, history)]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.string(), LOSS_ARROW]
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], names=["conv_id", "block", "window", "whole", "n_repeated", "n_tokens", "text", "loss"])
                held, n, chars = [], 0, 0

    return dealt.select("conv_id", "block", "whole", "kind", "role", "text").mapInArrow(run, WINDOWS)


def _blocks(scratch: Scratch, rows: DataFrame, path: str, history: int, block: int) -> DataFrame:
    """Rows of long conversations, dealt to blocks of ``block`` tokens by prefix sums, with what each block repeats."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TURNS // 8):
                part = batch.slice(at, TURNS // 8)
                texts = [piece(role, text)[0] for role, text in zip(part.column("role").to_pylist(), part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_tokens(texts, path), pa.int64())], names=[*part.schema.names, "n"])

    counted = scratch.put("counted", rows.mapInArrow(count, "conv_id long, turn long, role string, text string, n long").withColumn("row", F.monotonically_increasing_id()))
    order = ["turn", "role", "text", "row"]
    parts = max(-(-counted.count() // ROWS), min(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = scratch.put("dealt", counted.repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()))
    totals = dealt.groupBy("conv_id", "part").agg(F.sum("n").alias("total"))
    before = F.coalesce(F.sum("total").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), before.alias("_before"))  # a row for each partition of a conversation
    inside = F.sum("n").over(Window.partitionBy("conv_id", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    placed = dealt.withColumn("_inside", inside).join(totals, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
    start = F.col("_before") + F.col("_inside")
    placed = scratch.put("placed", placed.select("conv_id", "turn", "role", "text", start.alias("start"), F.expr(f"(_before + _inside) div {block}").alias("block")))
    leads = (F.col("start") == 0) & (F.col("role") == "system")
    made = lambda df, block, kind: df.select("conv_id", "turn", "role", "text", block.alias("block"), F.lit(False).alias("whole"), F.lit(kind).alias("kind"))
    past = placed.where((F.col("start") >= (F.col("block") + 1) * block - history) & ~leads)
    systems = placed.where(leads).select(F.col("conv_id").alias("_conv"), "turn", "role", "text")
    later = placed.where("block > 0").select("conv_id", "block").distinct().join(systems, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return made(placed, F.col("block"), NEW).unionByName(made(past, F.col("block") + 1, PAST)).unionByName(made(later, F.col("block"), SYSTEM))


READ = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("turns", pa.string()), ("loss", pa.string())])
TOLD = pa.schema([f for f in READ if f.name not in ("block", "turns", "loss")])
READ_DDL = "conv_id long, block long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, turns string, loss string"


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def read_back(formatted: DataFrame, together: bool = False) -> DataFrame:
    """One row for each conversation, from its windows only: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars). Turns are read once, where they are not repeated; the loss is the text under the mask, unescaped.

    ``together`` says that windows come as :func:`windows` makes them; otherwise they are dealt and sorted first. A digest
    reads its conversation from the first to the last word: long ones pass through one task block by block.
    """
    if not together:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("conv_id", "block", "whole", "n_repeated", "text", "loss")
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in names)))
        held = []
        for (conv, block, whole), own in itertools.groupby(rows, key=lambda r: r[:3]):
            n, chars, turns, loss = 0, 0, [], []
            for *_, repeated, text, spans in own:
                new = read_turns(text)[repeated:]
                n, chars = n + len(new), chars + len(text)
                turns += [f"{role}\n{said}\n" for role, said in new]
                loss += [unescape(text[s["start"] : s["stop"]]) for s in spans]
            told, under = "".join(turns), "".join(loss)
            digests = (_sha(told), len(under), _sha(under)) if whole else (None, len(under), None)
            held.append((conv, block, n, *digests, chars, *((None, None) if whole else (told, under))))
            if len(held) >= TURNS or not whole:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), READ.types)], schema=READ)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), READ.types)], schema=READ)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*(map(lambda x: x.as_py(), c) for c in b.columns)))
        held = []
        for conv, own in itertools.groupby(rows, key=lambda r: r[0]):
            turns, loss, n, loss_chars, chars, done = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, None
            for _, _, count, sha, under, loss_sha, length, told, masked in own:
                n, loss_chars, chars, done = n + count, loss_chars + under, chars + length, (sha, loss_sha)
                turns.update((told or "").encode())
                loss.update((masked or "").encode())
            digests = done if done[0] else (turns.hexdigest(), loss.hexdigest())
            held.append((conv, n, digests[0], loss_chars, digests[1], chars))
            if len(held) >= TURNS:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TOLD.types)], schema=TOLD)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), TOLD.types)], schema=TOLD)

    blocks = formatted.mapInArrow(read, READ_DDL).repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return blocks.mapInArrow(merge, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
