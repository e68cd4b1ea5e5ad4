import public_tokenizers
from tokenizers import Tokenizer

from kinelake.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIB = Tokenizer.from_file(PATH)


def test_capitals_whose_small_forms_leave_the_range():
    own = bpe.WordBpe(PATH)
    assert own.split_words("AZƏRBAYCAN") == ["azərbaycan"]
    for text in ("AZƏRBAYCAN", "ƁAƊA ƘASA", "ƆKƐ Ɛʋe", "Ⱥb Ⱦc ɃɄ"):
        assert list(bpe.unpack(own.encode(text))) == LIB.encode(text, add_special_tokens=False).ids


def test_every_character_of_the_fast_path_like_the_library():
    own = bpe.WordBpe(PATH)
    fast = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000 and not own.other(c)]
    assert len(fast) >= 0x250
    texts = [t for c in fast for t in (f"a{c}b", f"É{c}{c}z 1{c}2", f"{c}", f"é {c}'s{c}", f"'{c}ll é{c}")]
    for text, packed in zip(texts, own.encode_block(texts)):
        assert list(bpe.unpack(packed)) == LIB.encode(text, add_special_tokens=False).ids, text
