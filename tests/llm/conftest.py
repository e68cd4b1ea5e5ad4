import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, norm string, row string, `_row` string, `_text` string, `_q` string, kept boolean, `key` string"


def prose(rng, words, vocabulary=None):
    vocabulary = vocabulary or ["river", "stone", "quiet", "morning", "letters", "garden", "winter", "signal", "copper", "window", "harbor", "lantern", "meadow", "thunder", "paper", "silver", "orchard", "candle", "bridge", "forest"]
    out = []
    for i in range(words):
        w = rng.choice(vocabulary) + rng.choice(["", "", "s", "ed", "ing"]) + str(rng.randrange(1000)) * (rng.random() < 0.3)
        out.append(w.capitalize() if i % 9 == 0 else w + "." * (i % 9 == 8))
    return " ".join(out)


@pytest.fixture(scope="session")
def tricky_rows():
    """Nulls, blanks, very long texts, copies, near copies, ties, repeated rows, odd characters."""
    rng = random.Random(5)
    base = prose(rng, 300)
    near = base.split()
    near[40] = "changed"
    texts = [None, "", " \t\n ", "one", "two words", "a b c d", "Mixed CASE text", "mixed case text", "ÉCOLE École école", "écolE", base, base.upper(), base, " ".join(near), base + " tail of it", prose(rng, 30000), "x" * 200_000, "\n".join(["same line here"] * 40), "<|endoftext|> special <|startoftext|>", "日本語のテキスト 123 ²Ⅳ", "İstanbul ΣΑΣ ﬁ", "### $$$ *** " * 60, "WORD!! " * 80, "a\x0bb\x0cc\rd\x00e", "nb sp line"]
    texts += [prose(rng, 80 + i) for i in range(12)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], rows[0], (None, "no id", None, None, 1), (None, None, None, None, None), (None, base, "en", "s", 1)]
    return rows


@pytest.fixture(scope="session")
def tricky(spark, tricky_rows):
    extra = (7, "d", "n", "r", "x", "t", "q", True, "k")
    return spark.createDataFrame([r + extra for r in tricky_rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
