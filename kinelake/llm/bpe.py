"""Byte-pair encoding and decoding with a segment tree over adjacent pair ranks.

The tree's leaves hold, for each adjacent pair of symbols, (merge rank, place); its root is the leftmost pair of lowest
rank. A merge updates three leaves, each in logarithmic time, until the root holds no rank. A word of n symbols costs
n log n, also one of a million characters. Words repeat, so each Python worker keeps a bounded table of words done.

Token ids travel as one binary value for each text: little-endian unsigned 32-bit integers (see :func:`unpack`).

Defined results: a null text counts as empty and gives no ids; strings of special tokens in a text become their ids, as
the tokenizers library does by default; symbols outside the vocabulary are dropped; repeated rows each get their own
row; an empty table gives an empty result; columns other than id and text are ignored and may have any name.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

#: Words that a worker remembers; beyond it the table starts anew, which changes the time and never the result.
WORDS_KEPT = 600_000
#: Texts whose new words are encoded together, and the longest word (in bytes) that goes with others.
BLOCK, SHORT = 256, 64
#: Rows and bytes of the record batches that a worker gives back.
ROWS_OUT, BYTES_OUT = 512, 8 << 20
NONE = 1 << 62
#: Symbols of the trees that hold a word of so many bytes: a power of two of pairs. 0: the word has a tree of its own.
WIDTHS = np.array([0, 1, *(max(2, 1 << (n - 2).bit_length()) + 1 for n in range(2, SHORT + 1)), 0])


def byte_symbols() -> list[str]:
    """The visible character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Merges:
    """Merge ranks by pairs of ids, and the segment tree that applies them."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]]):
        self.ranks = ranks  # (left id, right id) -> (rank, merged id)

    def apply(self, ids: list[int]) -> list[int]:
        n = len(ids)
        if n < 2:
            return ids
        ranks = self.ranks
        size = 1
        while size < n - 1:
            size *= 2
        tree = [NONE] * (2 * size)
        for i in range(n - 1):
            found = ranks.get((ids[i], ids[i + 1]))
            if found:
                tree[size + i] = found[0] * n + i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\x01") * n

        def put(i: int, value: int) -> None:
            k = size + i
            if tree[k] == value:
                return
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
                k >>= 1

        while (root := tree[1]) < NONE:
            i = root % n
            j = after[i]
            ids[i] = ranks[ids[i], ids[j]][1]
            alive[j] = 0
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = ranks.get((ids[i], ids[k]))
                put(i, found[0] * n + i if found else NONE)
            else:
                put(i, NONE)
            if j < n - 1:
                put(j, NONE)
            h = before[i]
            if h >= 0:
                found = ranks.get((ids[h], ids[i]))
                put(h, found[0] * n + h if found else NONE)
        return [x for x, lives in zip(ids, alive) if lives]


class Forest:
    """The same trees for many words of up to ``SHORT`` symbols at once: row r of each array belongs to word r."""

    def __init__(self, ranks: dict[tuple[int, int], tuple[int, int]], size: int):
        self.size = size
        keys = np.array([a * size + b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.rank = np.append(np.array([r for r, _ in ranks.values()], np.int64)[order], 0)
        self.merged = np.zeros(1 + max((r for r, _ in ranks.values()), default=0), np.int64)
        for r, m in ranks.values():
            self.merged[r] = m

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
        """(rank, place) of each pair; NONE where it has no rank or an end is missing (-1)."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        known = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(known, self.rank[at] << bits | place, NONE)

    def apply(self, symbols: np.ndarray) -> np.ndarray:
        """Merges each row in place; -1 stands behind a word's end, and where a symbol went into its left one."""
        n, width = symbols.shape
        if width < 2:
            return symbols
        bits = (width - 2).bit_length() if width > 2 else 1
        size = 1 << bits
        tree = np.full((n, 2 * size), NONE, np.int64)
        place = np.arange(width - 1)
        tree[:, size : size + width - 1] = self.leaves(symbols[:, :-1], symbols[:, 1:], place[None, :], bits)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        wide = width + 1  # a last column that stays empty
        cells = np.concatenate([symbols, np.full((n, 1), -1)], axis=1).ravel()
        after = np.tile(np.minimum(np.arange(1, width + 2), width), n)
        before = np.tile(np.arange(-1, width), n)
        nodes = tree.ravel()
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            row, top = rows * wide, rows * (2 * size)
            root = nodes[top + 1]
            i = root & (size - 1)
            j = after[row + i]
            cells[row + i] = merged = self.merged[root >> bits]
            cells[row + j] = -1
            k = after[row + j]
            after[row + i] = k
            before[row + k] = i
            h = before[row + i]
            nodes[top + size + i] = self.leaves(merged, cells[row + k], i, bits)
            inner, led = j < size, h >= 0  # the last symbol begins no pair
            nodes[(top + size + j)[inner]] = NONE
            ahead = h[led]
            nodes[top[led] + size + ahead] = self.leaves(cells[row[led] + ahead], merged[led], ahead, bits)
            for at, over in ((i, top), (j[inner], top[inner]), (ahead, top[led])):
                at = size + at
                for _ in range(bits):
                    at = at >> 1
                    pair = over + 2 * at
                    nodes[over + at] = np.minimum(nodes[pair], nodes[pair + 1])
            rows = rows[nodes[top + 1] < NONE]
        return cells.reshape(n, wide)[:, :-1]


class WordBpe:
    """A tokenizer file with word-end symbols: NFC, lower case, white space dropped, byte-level symbols."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        splits = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError(f"{path}: only BPE with NFC, white space, lower case, split and byte-level symbols")
        vocab = model["vocab"]
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        end = self.end = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = [vocab.get(s) for s in symbols]
        self.last = [vocab.get(s + end) for s in symbols]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges({(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(pairs)))})
        pattern = splits[0]["pattern"]["Regex"]
        # Latin text is split by the standard library; anything else by the tokenizers library, whose tables of letters it follows.
        latin = sorted({x for c in range(0x250) for x in chr(c) + chr(c).lower()})  # some small forms are beyond the range
        letters = "".join(c for c in latin if unicodedata.category(c)[0] == "L")
        numbers = "".join(c for c in latin if unicodedata.category(c)[0] == "N")
        self.find = re.compile(pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]").replace(r"\s\p{L}\p{N}", f"\\t-\\r \x85\xa0\u2028{letters}{numbers}")).findall
        self.find_ascii = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r ")).findall
        self.other = re.compile("[^\x00-\u024f\u2010-\u2027]").search
        self.normal = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        self.forest = Forest(self.merges.ranks, size)
        self.full = None not in self.inner and None not in self.last  # each byte has its symbols
        self.inner_ids, self.last_ids = (np.array(x if self.full else [], np.int64) for x in (self.inner, self.last))
        self.words: dict[str, bytes] = {}  # word -> packed ids

    def encode_word(self, word: str) -> bytes:
        raw = word.encode()
        ids = [self.inner[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        return np.array(self.merges.apply([i for i in ids if i is not None]), "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        """Fills the table of words."""
        if not self.full:
            self.words.update((word, self.encode_word(word)) for word in words)
            return
        raws = list(map(str.encode, words))
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        widths = WIDTHS[np.minimum(sizes, SHORT + 1)]
        for width in np.unique(widths).tolist():
            places = np.flatnonzero(widths == width)
            own = [words[i] for i in places.tolist()]
            if not width:
                self.words.update((word, self.encode_word(word)) for word in own)
                continue
            count = sizes[places]
            flat = np.frombuffer(b"".join([raws[i] for i in places.tolist()]), np.uint8)
            ids, ends = self.inner_ids[flat], np.cumsum(count) - 1
            ids[ends] = self.last_ids[flat[ends]]
            symbols = np.full((len(own), width), -1, np.int64)
            symbols[np.arange(width)[None, :] < count[:, None]] = ids
            symbols = self.forest.apply(symbols)
            there = symbols >= 0
            packed = symbols[there].astype("<u4").tobytes()
            ends = (4 * np.cumsum(there.sum(axis=1))).tolist()
            self.words.update(zip(own, map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def split_words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if text.isascii():
            return self.find_ascii(text.lower())
        if self.other(text):
            return [w for w, _ in self.split(self.normal(text))]
        return self.find(text.lower())

    def pieces(self, text: str | None) -> list[list[str] | bytes]:
        """Words, and between them the packed ids of special tokens."""
        if not text:
            return []
        if self.special and "<|" in text:
            parts = self.special.split(text)
            return [np.array([self.specials[p]], "<u4").tobytes() if k % 2 else self.split_words(p) for k, p in enumerate(parts)]
        return [self.split_words(text)]

    def encode_block(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of whole texts."""
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        split = [self.pieces(t) for t in texts]
        get = self.words.get
        done = [[part if isinstance(part, bytes) else list(map(get, part)) for part in parts] for parts in split]
        gaps, new = [], set()  # (words, their packed ids, places of words that are not known yet)
        for words, found in ((w, f) for parts, own in zip(split, done) for w, f in zip(parts, own) if isinstance(f, list)):
            if places := [i for i, x in enumerate(found) if x is None]:
                gaps.append((words, found, places))
                new.update([words[i] for i in places])
        self.learn(list(new))
        for words, found, places in gaps:
            for i in places:
                found[i] = get(words[i])
        return [b"".join(part if isinstance(part, bytes) else b"".join(part) for part in parts) for parts in done]

    def encode(self, text: str | None) -> bytes:
        return self.encode_block([text])[0]

    def encode_all(self, rows: Iterator[tuple[int, str | None]]) -> Iterator[tuple[int, bytes]]:
        """(id, packed ids) of (id, text), by blocks of bounded rows and characters."""
        ids, texts, size = [], [], 0
        for i, text in rows:
            ids.append(i)
            texts.append(text)
            size += len(text or "")
            if len(ids) >= BLOCK or size >= BYTES_OUT:
                yield from zip(ids, self.encode_block(texts))
                ids, texts, size = [], [], 0
        yield from zip(ids, self.encode_block(texts))

    def decode(self, packed: bytes) -> str:
        """The tokens, joined by spaces: what the library gives for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, unpack(packed)))


def unpack(packed: bytes) -> array:
    ids = array("I")
    ids.frombytes(packed)
    return ids


@lru_cache(4)
def load(path: str) -> WordBpe:
    """One tokenizer for each path and worker."""
    return WordBpe(path)


def out_batches(rows: Iterator[tuple], schema: pa.Schema, weight=len) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size; the last value of a row has its weight."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row[-1])
        if len(held) >= ROWS_OUT or size >= BYTES_OUT:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of two columns, a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_OUT):
            part = batch.slice(at, ROWS_OUT)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the packed ids of each whole text."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from out_batches(load(path).encode_all(pairs(batches)), schema)

    return narrow.mapInArrow(run, "id long, ids binary").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` to (id, ids); other columns are dropped. Null ids decode to an empty text."""
    narrow = tokens.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    schema = pa.schema([("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = load(path).decode
        rows = ((i, p or b"", done(p or b"")) for i, p in pairs(batches))
        yield from out_batches(rows, schema)

    return narrow.mapInArrow(run, "id long, ids binary, decoded string").withColumnRenamed("id", id_col)
