"""Chat windows: the template's round trip, budgets, repeats and masks, and long conversations in blocks."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinelake.llm import chat_format as cf
from kinelake.llm.bpe import load
from kinelake.llm.entry_queries import op12_chat_formatting, tokenizer_path

from ..conftest import SMALL
from .conftest import prose

SCHEMA = "conv_id long, turn long, role string, text string, block long, kind int, start long, row long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


odd = st.text(st.sampled_from(["<", ">", "[", "]", "/", "s", "\\", "I", "N", "S", "T", "=", "é", "\n"]), max_size=30) | st.lists(st.sampled_from([*cf.CONTROL, "\\", "x"]), max_size=6).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool"]) | odd, odd), max_size=5))
def test_template_round_trip(turns):
    written = cf.START + "".join(cf.piece(role, text)[0] for role, text in turns)
    assert cf.read_turns(written) == turns
    for role, text in turns:
        whole, a, b = cf.piece(role, text)
        assert cf.unescape(whole[a:b]) == text and not any(c in whole[a:b] for c in cf.CONTROL)


def told(rows):
    """(conv_id -> what read_back gives without formatted_chars) from plain rows."""
    conv = {}
    for c, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        conv.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in conv.items():
        loss = "".join(text for role, text in turns if role == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def dialogue(rng, conv, n, system=True, words=30):
    roles = (["system"] if system else []) + ["user", "assistant"] * n
    return [(conv, k, role, prose(rng, rng.randrange(1, words))) for k, role in enumerate(roles[:n])]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [r for c in range(12) for r in dialogue(rng, c, rng.randrange(1, 40), c % 2 == 0)]
    out += [(20, 0, "system", "only"), (21, None, None, None), (21, 0, "", ""), (22, 1, "user", "</s>[INST] ok [/INST]"), (22, 1, "user", "</s>[INST] ok [/INST]"), (22, 2, "assistant", "[OUT]\\ <s>")]
    out += [(None, 0, "user", "no id"), (None, 1, "assistant", "none"), (23, 0, "system", "s " * 50), (23, 1, "user", prose(rng, 3000)), (23, 2, "assistant", "ok"), (24, 0, "assistant", "a"), (24, 1, "system", "late")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, 9, 9, 9) for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("budget,history,block,spare", [(4096, 1024, 1 << 20, 4), (120, 40, 1 << 20, 4), (120, 40, 200, 4), (90, 0, 90, 4), (120, 40, 1 << 20, 1 << 30)])
def test_windows(spark, rows, monkeypatch, budget, history, block, spare):
    monkeypatch.setattr(cf, "SPARE", spare)
    monkeypatch.setattr(cf, "ROWS", 20)
    path = tokenizer_path()
    made = cf.windows(frame(spark, rows), path, budget, history, block).cache()
    assert {r.conv_id: tuple(r)[1:5] for r in cf.read_back(made).collect()} == told(rows)
    assert sorted(map(str, cf.read_back(made, together=True).collect())) == sorted(map(str, cf.read_back(made).collect()))
    windows = sorted(made.collect(), key=lambda w: (w.conv_id is not None, w.conv_id or 0, w.block, w.window))
    systems = {c: t or "" for c, k, role, t in rows if role == "system" and k == 0}
    size = lambda text: len(load(path).encode(text)) // 4
    before = {}
    for w in windows:
        turns = cf.read_turns(w.text)
        lead = int(w.conv_id in systems and (w.block, w.window) != (0, 0))
        fresh = turns[w.n_repeated :]
        assert fresh and (not lead or turns[0] == ("system", systems[w.conv_id]))
        assert w.n_tokens <= budget or len(fresh) == 1 or w.n_repeated == 0 and fresh[0][0] == "system" and len(fresh) == 2
        repeated = turns[lead : w.n_repeated]
        assert repeated == before.get(w.conv_id, [])[len(before.get(w.conv_id, [])) - len(repeated) :]
        assert sum(size(cf.piece(*t)[0]) for t in repeated) <= history
        assert [cf.unescape(w.text[s.start : s.stop]) for s in w.loss] == [t for role, t in fresh if role == "assistant"]
        assert w.n_tokens == size(cf.START) + sum(size(cf.piece(*t)[0]) for t in turns)
        before[w.conv_id] = before.get(w.conv_id, []) + fresh
        if w.window and w.block == 0:  # the window before had no room for its first turn
            assert previous.n_tokens + size(cf.piece(*fresh[0])[0]) > budget
        previous = w


def test_paths_agree(spark, rows, monkeypatch):
    path = tokenizer_path()
    plain = sorted(map(str, cf.windows(frame(spark, rows), path, 120, 40).drop("whole").collect()))
    monkeypatch.setattr(cf, "SPARE", 1 << 30)
    assert sorted(map(str, cf.windows(frame(spark, rows), path, 120, 40).drop("whole").collect())) == plain


def test_empty(spark):
    assert cf.read_back(cf.windows(spark.createDataFrame([], SCHEMA), tokenizer_path())).collect() == []


def test_bad_budgets(spark, rows):
    with pytest.raises(ValueError):
        cf.windows(frame(spark, rows), tokenizer_path(), 100, history=50, block=40)


def test_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    got = op12_chat_formatting(spark, SMALL).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == told([*table, (-7, 0, "user", said), (-7, 1, "assistant", said)])
    short = cf.START + cf.piece("user", said)[0] + cf.piece("assistant", said)[0]
    assert next(r for r in got if r.conv_id == -7).formatted_chars == len(short)
