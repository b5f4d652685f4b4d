import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from skein.llm import words  # noqa: E402
from skein.llm.words import hf_ids, unit_ids, word_ids  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = [
    " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "don't", "It's", "WE'LL", "'s", "word", "Word,", "word!!",
    "ÉTÉ", "été.", "Σας", "ΟΔΟΣ", "İstanbul", "é", "́", "naïve", "123", "4five", "x1", "...", "***", "<|endoftext|>", "<|startoftext|>",
    "<|ENDOFTEXT|>", "<|", "|>", "日本語", "😀", "👨‍👩‍👧", "ß", "ſ", "ǅ", "Ａ", "_", "a_b", "\\", "\x00", "​", "'", "’s",
]


def whole(path, text):
    return np.frombuffer(hf_ids(path, text.encode()), "<u4").tolist()


def same(*texts):
    """Whether the ids of all texts, encoded together, are the library's."""
    raws = [t.encode() for t in texts]
    for encode, path in ((word_ids, WORD), (unit_ids, BYTE)):
        ids, ends = encode(path, raws, 7)
        want = [whole(path, t) + [7] for t in texts]
        assert [own.tolist() for own in np.split(ids, ends)[:-1]] == want
        assert ids.dtype == np.dtype("<u4")


@settings(max_examples=600, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=4))
def test_units_encode_as_the_whole_text(texts):
    same(*texts)


def test_slices_of_texts_encode_as_the_whole(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(PIECES[14:], rng.integers(0, 60))) for _ in range(30)] + ["", "x" * 500, "one\ntwo three\nfour", "\x01 a", "a \x02", "\x030"]
    same(*texts)
    for together in (16, 64, 1000):
        monkeypatch.setattr(words, "TOGETHER", together)
        same(*texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_any_text(text):
    same(text.encode("utf-8", "ignore").decode())


LATIN = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text(LATIN, min_size=1, max_size=9), st.sampled_from(["", ".", ",", "'s", "!!", "'", "...)", " ", "1"])), max_size=5))
def test_latin_words(pairs):
    same(" ".join(word + tail for word, tail in pairs))
