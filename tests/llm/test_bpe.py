import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kinelake.llm import bpe, packing

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIB.encode(text or "", add_special_tokens=False).ids


def test_like_the_library_on_random_text():
    own = bpe.WordBpe(PATH)
    rng = random.Random(2)
    pools = [lambda: chr(rng.randrange(32, 127)), lambda: chr(rng.choice([*range(1, 0xD7FF), *range(0xE000, 0x11000)])), lambda: rng.choice("abc'stre ΣİßéÉ́\x1c\x85​ <|>1²Ⅳ!? \t\n")]
    texts = ["".join(rng.choice(pools)() for _ in range(rng.randrange(40))) for _ in range(3000)]
    for text, (_, packed) in zip(texts, own.encode_all((0, t) for t in texts)):
        assert list(bpe.unpack(packed)) == ids_of(text)
        assert own.decode(packed) == LIB.decode(ids_of(text), skip_special_tokens=False)


def test_trees_agree_with_each_other_and_with_plain_merging():
    own = bpe.WordBpe(PATH)
    rng = random.Random(3)
    for _ in range(500):
        word = "".join(rng.choice("abcdeorstin") for _ in range(rng.randrange(1, 64)))
        ids = [own.inner[b] for b in word.encode()[:-1]] + [own.last[ord(word[-1])]]
        plain = list(ids)
        while True:
            ranked = [(own.merges.ranks[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in own.merges.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            plain[i : i + 2] = [own.merges.ranks[plain[i], plain[i + 1]][1]]
        assert own.merges.apply(list(ids)) == plain
        own.words.clear()
        own.learn([word])
        assert list(bpe.unpack(own.words[word])) == plain


def test_a_very_long_word_is_fast_and_right():
    own = bpe.WordBpe(PATH)
    word = "ab" * 100_000
    assert list(bpe.unpack(own.encode(word))) == ids_of(word)


def test_tables_beyond_their_bound_change_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 3)
    own = bpe.WordBpe(PATH)
    for text in ["many different words in here", "and some more words too", "many words"] * 3:
        assert list(bpe.unpack(own.encode(text))) == ids_of(text)


def test_operator_on_tricky_rows(tricky, tricky_rows):
    tokens = bpe.encode(tricky, PATH)
    assert tokens.columns == ["doc_id", "ids"]
    got = sorted(((r.doc_id if r.doc_id is not None else -1), bytes(r.ids)) for r in tokens.collect())
    want = sorted(((r[0] if r[0] is not None else -1), np.array(ids_of(r[1]), "<u4").tobytes()) for r in tricky_rows)
    assert got == want
    back = {(r.doc_id, hashlib.md5(bytes(r.ids)).hexdigest()): r.decoded for r in bpe.decode(tokens, PATH).collect()}
    for doc, text, *_ in tricky_rows:
        ids = ids_of(text)
        assert back[doc, hashlib.md5(np.array(ids, "<u4").tobytes()).hexdigest()] == LIB.decode(ids, skip_special_tokens=False)


def test_operator_on_an_empty_table(empty):
    assert bpe.encode(empty, PATH).collect() == []
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []
    assert packing.pack_documents(empty, PATH).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_whole_and_near_the_bound(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range([5, 40, 400, 4000, 20000, 1][seed]):
        x = max(1, min(4096, int(rng.lognormvariate(6, 1.3))))
        counts[x] = counts.get(x, 0) + 1
    plan = packing.plan_sequences(counts, 4096)
    used = {}
    for pattern, times in plan:
        assert sum(x * k for x, k in pattern) <= 4096
        for x, k in pattern:
            used[x] = used.get(x, 0) + k * times
    assert used == counts
    bound = -(-sum(x * n for x, n in counts.items()) // 4096)
    assert sum(n for _, n in plan) <= bound + 1 + bound // 100


def test_an_exact_plan_that_best_fit_alone_misses():
    # 6 + 4, 5 + 5 and 7 + 3 fill tens; taking the largest piece that fits would too, but 5 + 3 + 2 needs the search.
    plan = packing.plan_sequences({6: 1, 5: 1, 4: 1, 3: 1, 2: 1}, 10)
    assert sum(n for _, n in plan) == 2


def test_packing_tricky_rows(tricky, tricky_rows):
    rows = packing.pack_documents(tricky, PATH, capacity=512).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    want = []
    import zlib

    for doc, text, *_ in tricky_rows:
        ids = [*ids_of(text), 1]
        for piece in range(-(-len(ids) // 512)):
            part = ids[piece * 512 : (piece + 1) * 512]
            want.append((doc if doc is not None else -1, piece, piece * 512, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    total = sum(w[3] for w in want)
    assert len(by_sequence) <= -(-total // 512) + 1
