"""URL filters: a bit-parallel wildcard automaton runs all glob rules over each canonical URL at once.

Rules are packed one after another into the bits of as many 64-bit words as they need. A bit says that the rule has
matched up to there; each character shifts all states by one place (carrying between words) and masks them with the
places that accept it; a star keeps its state and passes it on. A worker steps through the characters of a block of URLs
together, so a block costs (longest URL) steps on arrays of (URLs, words).

The canonical URL is a dot, the host (A-Z lower-cased, between the first :// and the next /, ?, # or end), a mark that
keeps a rule's host out of the path, and the path (from there to ?, # or end). A rule host/path fits the host and its subdomains where the path starts with the rule's: as
a glob ``*.host/path*``. Of fitting rules the longest wins; without one, the verdict is block if a glob of ``BLOCKED``
matches and allow otherwise.

Defined results: a null URL or one without :// has an empty host and path and no rule; in globs ``*`` is any run of
characters and ``?`` one character; repeated rows each get their own row; an empty table gives an empty result; columns
other than id and URL are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Verdict of URLs without a rule: sites and files that no training corpus wants.
BLOCKED = ("*casino*/*", "*porn*/*", "*viagra*/*", "*poker*/*", "*.exe", "*.zip", "*/wp-login*", "*/cart/*")
#: URLs and characters that the automaton takes at a time; a longer URL is a block of its own.
BLOCK, CHARACTERS = 2048, 1 << 22
#: Between host and path of a canonical URL: half of a surrogate pair, which no text has.
MARK = "\udfff"


def blocks_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of (id, host, path) rows that ``BLOCK`` and ``CHARACTERS`` bound; a slice has one row at least."""
    sizes = sum(pc.fill_null(pc.utf8_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        fit = int(np.searchsorted(ends, ends[at] - sizes[at] + CHARACTERS, "right"))
        upto = min(max(fit, at + 1), at + BLOCK, batch.num_rows)
        yield batch.slice(at, upto - at)
        at = upto


@dataclass
class Automaton:
    """Multiword masks of a list of globs."""

    globs: Sequence[str]

    def __post_init__(self) -> None:
        places: list[str | None] = []  # the character of each place, None for any
        loops, starts, ends, ever = [], [], [], []
        for glob in self.globs:
            body = glob.replace("**", "*")
            starts.append(len(places))
            chars: list[tuple[str | None, bool]] = []  # character, and whether a star follows it
            lead = body.startswith("*")
            for c in body.lstrip("*"):
                if c == "*":
                    chars[-1] = (chars[-1][0], True)
                else:
                    chars.append((None if c == "?" else c, False))
            ever.append(lead)
            if not chars:
                raise ValueError("a glob needs a character other than a star")
            for c, star in chars:
                if star:
                    loops.append(len(places))
                places.append(c)
            ends.append(len(places) - 1)
        self.bits = len(places)
        self.words = -(-self.bits // 64)
        mask = self._mask
        self.first, self.lead = mask(starts), mask([s for s, e in zip(starts, ever) if e])
        self.loop, self.ends = mask(loops), ends
        wild = [i for i, c in enumerate(places) if c is None]
        known = sorted({c for c in places if c is not None})
        self.code = {c: k + 1 for k, c in enumerate(known)}
        self.accept = np.stack([mask(wild), *(mask(wild + [i for i, p in enumerate(places) if p == c]) for c in known)])

    def _mask(self, at: Sequence[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in at:
            out[i // 64] |= np.uint64(1) << np.uint64(i % 64)
        return out

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """(texts, globs) booleans: whether the whole text matches."""
        n = len(texts)
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        flat = np.fromiter((self.code.get(c, 0) for t in texts for c in t), np.int32, int(sizes.sum()))
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        state = np.zeros((n, self.words), np.uint64)
        top, one = np.uint64(63), np.uint64(1)
        for step in range(int(sizes.max()) if n else 0):
            live = order[: int((sizes > step).sum())]  # longest first: the others have ended
            old = state[live]
            shifted = old << one
            shifted[:, 1:] |= old[:, :-1] >> top
            shifted &= ~self.first  # a rule's last bit doesn't start the next rule
            shifted |= self.first if step == 0 else self.lead
            state[live] = (shifted & self.accept[flat[begin[live] + step]]) | (old & self.loop)
        out = np.empty((n, len(self.ends)), bool)
        for k, e in enumerate(self.ends):
            out[:, k] = (state[:, e // 64] >> np.uint64(e % 64)) & one == one
        return out


def rule_glob(rule: str) -> str:
    host, slash, path = rule.partition("/")
    return f"*.{host}{MARK}{slash}{path}*"


def parts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path) of each row."""
    out = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("_u")).select("id", rest_of("_u").alias("_rest"))
    host = ascii_lower(F.substring_index("_rest", "/", 1))
    return out.select("id", host.alias("host"), F.expr("if(instr(_rest, '/') > 0, substring(_rest, instr(_rest, '/')), '')").alias("path"))


def rest_of(column: str):
    """What follows the first ://, up to ? or #; empty without it."""
    after = f"substring({column}, instr({column}, '://') + 3)"
    return F.expr(f"if(coalesce(instr({column}, '://'), 0) > 0, substring_index(substring_index({after}, '?', 1), '#', 1), '')")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of each row."""
    if any(v not in ("allow", "block") for v, _ in rules):
        raise ValueError("a rule allows or blocks")
    # Of two rules with one text the first stands; longest first, so that the first that fits wins.
    ranked = sorted({r: v for v, r in reversed(rules)}.items(), key=lambda x: -len(x[0]))
    globs = [rule_glob(r) for r, _ in ranked] + list(blocked)
    schema = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            for part in blocks_of(batch):
                hosts, paths = part.column(1).to_pylist(), part.column(2).to_pylist()
                hit = automaton.match([f".{h}{MARK}{p}" for h, p in zip(hosts, paths)])
                rule: list[str | None] = []
                verdict = []
                for row in hit:
                    first = next((k for k in range(len(ranked)) if row[k]), None)
                    rule.append(None if first is None else ranked[first][0])
                    verdict.append(("block" if row[len(ranked) :].any() else "allow") if first is None else ranked[first][1])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], schema=schema)

    narrow = parts(pages, id_col, url_col).withColumn("id", F.col("id").cast("long"))
    return narrow.mapInArrow(run, "id long, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)


def oracle_sql(rules: Sequence[tuple[str, str]] = RULES, blocked: Sequence[str] = BLOCKED) -> str:
    """The same verdicts in DuckDB SQL."""
    quoted = ", ".join(f"('{v}', '{r.partition('/')[0]}', '{r[r.index('/'):]}', '{r}')" for v, r in rules)
    glob = " or ".join(f"('.' || host || chr(1) || path) glob '{g}'" for g in blocked)
    return f"""
        with r(verdict, rhost, rpath, rule) as (values {quoted}),
        u as (select page_id, case when coalesce(instr(url, '://'), 0) > 0
              then regexp_replace(substr(url, instr(url, '://') + 3), '[?#].*$', '', 's') else '' end as rest from pages),
        p as (select page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
              case when instr(rest, '/') > 0 then substr(rest, instr(rest, '/')) else '' end as path from u),
        best as (select p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as verdict
                 from p left join r on ends_with('.' || p.host, '.' || r.rhost) and starts_with(p.path, r.rpath) group by p.page_id, p.host, p.path)
        select page_id, host, path, rule, coalesce(verdict, case when {glob} then 'block' else 'allow' end) as verdict from best
    """
