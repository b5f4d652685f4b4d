"""Text cut into units whose encoding does not depend on their neighbours, with bounded caches.

Both vocabularies split text at white space first, so the ids of a text are the ids of its
white-space-delimited units one after another. The few texts for which that is not so
(control strings, white space beyond ASCII) are found by ``irregular`` and take the whole-text path.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: ASCII white space, as bytes.split() knows it: [\x20\x09-\x0D].
#: A unit of byte-level vocabularies: a word with the space before it, or white space that joins no word.
UNIT = re.compile(rb" ?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+(?![^\x20\x09-\x0D])|[\x20\x09-\x0D]")
#: White space outside ASCII.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: The bytes that its encodings begin with, by which most texts are found to have none.
WIDE_HEADS = tuple({c.encode()[:2] for c in "\x85\xa0\u1680\u2000\u2028\u202f\u205f\u3000"})


def irregular(raw: bytes, specials: tuple[bytes, ...] = ()) -> bool:
    """Whether units of this text may depend on their neighbours under a byte-level vocabulary."""
    if any(s in raw for s in specials):
        return True
    if raw.isascii() or not any(head in raw for head in WIDE_HEADS):
        return False
    return WIDE_SPACE.search(raw.decode("utf-8", "replace")) is not None


class Cache(dict):
    """unit -> ``make(unit)``, filled on demand up to ``limit`` entries.

    The units that come first hold most of the frequent ones, so a full cache keeps them and
    makes others anew; after eight times ``limit`` such misses it starts over, for input whose
    words have changed. Units longer than ``longest`` bytes are never held, so memory is bounded
    by ``limit`` short entries, some 200 bytes each. ``fixed`` entries (a broadcast tier) always stay.
    """

    def __init__(self, make, limit: int = 250_000, longest: int = 64, fixed: dict | None = None):
        super().__init__(fixed or {})
        self.make, self.limit, self.longest, self.fixed, self.missed = make, limit, longest, fixed or {}, 0

    def __missing__(self, unit):
        value = self.make(unit)
        if len(unit) <= self.longest:
            if len(self) < self.limit:
                self[unit] = value
            else:
                self.missed += 1
                if self.missed > 8 * self.limit:
                    self.clear()
                    self.update(self.fixed)
                    self.missed = 0
        return value


@cache
def hf_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def hf_specials(path: str) -> tuple[bytes, ...]:
    return tuple(t.content.encode() for t in hf_tokenizer(path).get_added_tokens_decoder().values())


def hf_ids(path: str, raw: bytes) -> bytes:
    """Ids of one text by the tokenizers library, as little-endian unsigned 32-bit integers."""
    ids = array("I", hf_tokenizer(path).encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids)
    if sys.byteorder != "little":
        ids.byteswap()
    return ids.tobytes()


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, others as letters from U+0100 on."""
    out, spare = {}, 0x100
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte:
            out[byte] = chr(byte)
        else:
            out[byte] = chr(spare)
            spare += 1
    return out


BYTE_LETTERS = _byte_letters()


@cache
def letter_coder(path: str):
    """Ids of one pre-token of letters by the library's model alone, which is all that is left to do for it."""
    tokenize = hf_tokenizer(path).model.tokenize

    space = BYTE_LETTERS[32]

    def ids(core: bytes) -> bytes:
        if core.isascii():  # letters, and the space before them
            text = space + core[1:].decode() if core[:1] == b" " else core.decode()
        else:
            text = core.decode("latin-1").translate(BYTE_LETTERS)
        out = array("I", [t.id for t in tokenize(text)])
        if sys.byteorder != "little":
            out.byteswap()
        return out.tobytes()

    return ids


#: Punctuation that both vocabularies cut off a word of letters.
TAIL = b"!\"#$%&()*+,-./:;<=>?@[]^_`{|}~'"


def _letters(core: bytes) -> bool:
    """Whether these are Latin letters only, whose lower case does not depend on what stands beside them."""
    if core.isascii():
        return core.isalpha()
    text = core.decode("utf-8", "replace")
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


@cache
def id_cache(path: str, spaced: bool, limit: int = 200_000) -> Cache:
    """The worker's cache of unit -> ids, kept over tasks.

    A word of letters with punctuation after it is the word and the punctuation, each encoded
    once however they combine; ``spaced`` vocabularies keep case and the space before a word,
    others put everything in lower case.
    """
    letters, others = Cache(letter_coder(path), limit=limit), Cache(lambda part: hf_ids(path, part), limit=limit // 4)

    def make(unit: bytes) -> bytes:
        core = unit.rstrip(TAIL)
        if not core or not _letters(core.removeprefix(b" ") if spaced else core):
            return others[unit]
        own = letters[core if spaced else core.lower() if core.isascii() else core.decode().lower().encode()]
        return own + others[unit[len(core) :]] if len(core) < len(unit) else own

    return Cache(make, limit=limit)


#: Bytes of words that are looked up together: enough for most words to occur more than once.
TOGETHER = 8 << 20


def flat_ids(joined: bytes, text_ends: np.ndarray, spell: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words of all texts, one after another, and where each text's ids end.

    ``joined`` are words, each with one space after it, ``text_ends`` where the texts end in it;
    ``spell`` gives the ids of words as bytes. About ``TOGETHER`` bytes of words at a time become
    a dictionary-encoded column: each distinct word is spelled once and its occurrences are rows
    of a gather.
    """
    out, ends, a, before = [], [], 0, 0
    while a < len(joined):
        b = len(joined)
        if b - a > TOGETHER:
            b = joined.rfind(b" ", a, a + TOGETHER) + 1 or joined.index(b" ", a + TOGETHER) + 1
        part = joined[a:b]
        at = np.flatnonzero(np.frombuffer(part, np.uint8) == 32) + 1
        offsets = np.append(0, at).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(part)]).dictionary_encode()
        found = spell([w[:-1] for w in coded.dictionary.to_numpy(zero_copy_only=False).tolist()])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        own = coded.indices.to_numpy()
        counts = sizes[own]
        to = np.cumsum(counts)
        starts = (np.cumsum(sizes) - sizes)[own] - (to - counts)
        out.append(np.frombuffer(b"".join(found), "<u4")[np.repeat(starts, counts) + np.arange(to[-1])])
        mine = text_ends[np.searchsorted(text_ends, a, side="right") : np.searchsorted(text_ends, b, side="right")] - a
        ends.append(before + to[np.searchsorted(at, mine)])
        a, before = b, before + int(to[-1])
    if not out:
        return np.zeros(0, "<u4"), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(ends)


#: ASCII white space to spaces.
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Marks in front of words: one with no space before it, the end of a text, and a whole text by its number.
BARE, END, WHOLE = b"\x01", b"\x02", b"\x03"
#: Texts that hold one, or a zero byte, are encoded whole.
MARKS, LAST_MARK = (b"\x00", BARE, END, WHOLE), b"\x03\xff"


class Speller:
    """Ids of distinct words. Those of letters are held, up to ``limit``; punctuation after letters is a word of its own."""

    def __init__(self, path: str, spaced: bool, limit: int = 300_000):
        self.code, self.spaced, self.limit, self.missed = letter_coder(path), spaced, limit, 0
        self.cores: dict[bytes, bytes] = {}
        self.others = Cache(lambda part: hf_ids(path, part), limit=limit // 5)
        self.units = id_cache(path, True, limit // 5) if spaced else None

    def _core(self, core: bytes) -> bytes | None:
        if not core or not _letters(core):
            return None
        own = self.code(b" " + core if self.spaced else core.lower() if core.isascii() else core.decode().lower().encode())
        if len(core) > 64 or len(self.cores) >= self.limit:
            self.missed += 1
            if self.missed > 8 * self.limit:  # the words have changed
                self.cores.clear()
                self.missed = 0
        else:
            self.cores[core] = own
        return own

    def ids(self, words: list[bytes], marked: Callable[[bytes], bytes]) -> list[bytes]:
        cores, others, new, spaced, out = self.cores, self.others, self._core, self.spaced, []
        for word in words:
            if word <= LAST_MARK:
                out.append(marked(word))
                continue
            core = word.rstrip(TAIL)
            own = cores.get(core) or new(core)
            if own is None:
                own = others[b" " + word if spaced else word]
            elif len(core) < len(word):
                own = own + others[word[len(core) :]]
            out.append(own)
        return out


speller = cache(Speller)


def _texts_ids(raws: list[bytes], end_id: int, speller: Speller, cut, whole) -> tuple[np.ndarray, np.ndarray]:
    """``flat_ids`` of texts and ``end_id`` after each. ``cut`` writes a text as words, or gives None for one that ``whole`` encodes."""
    end, words = np.asarray([end_id], "<u4").tobytes(), []
    for k, raw in enumerate(raws):
        own = None if any(mark in raw for mark in MARKS) else cut(raw)
        words.append((WHOLE + b"%d" % k if own is None else own) + b" " + END + b" ")

    def marked(word: bytes) -> bytes:
        mark, rest = word[:1], word[1:]
        if mark == END:
            return end
        if mark == WHOLE:
            return whole(raws[int(rest)])
        return speller.units[rest] if rest else b""

    return flat_ids(b"".join(words), np.cumsum([len(w) for w in words], dtype=np.int64), lambda distinct: speller.ids(distinct, marked))


def word_ids(path: str, raws: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts under a vocabulary that drops white space between words, ``end_id`` after each, and where each ends."""

    def whole(raw: bytes) -> bytes:
        return b"".join(map(id_cache(path, False).__getitem__, raw.split()))

    return _texts_ids(raws, end_id, speller(path, False), lambda raw: raw.translate(SPACES), whole)


#: What makes a text cut at single spaces and line ends differ from its units.
ODD_SPACE = (b"  ", b"\n\n", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")


def unit_ids(path: str, raws: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts under a byte-level vocabulary, ``end_id`` after each, and where each ends."""
    specials, own = hf_specials(path), speller(path, True)

    def cut(raw: bytes) -> bytes | None:
        if raw[:1] in (b" ", b"\n") or raw[-1:] in (b" ", b"\n") or any(odd in raw for odd in ODD_SPACE) or irregular(raw, specials):
            return None
        return BARE + raw.replace(b"\n", b" " + BARE + b"\n " + BARE)

    def whole(raw: bytes) -> bytes:
        return hf_ids(path, raw) if irregular(raw, specials) else b"".join(map(own.units.__getitem__, UNIT.findall(raw)))

    return _texts_ids(raws, end_id, own, cut, whole)


def in_slabs(batches, *columns: str):
    """Rows of record batches as lists of columns, about ``TOGETHER`` bytes of the last column at a time."""
    held, size = [], 0
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            for row in zip(*[part.column(c).to_pylist() for c in columns], strict=True):
                held.append(row)
                size += len(row[-1])
                if size >= TOGETHER:
                    yield list(zip(*held, strict=True))
                    held, size = [], 0
    if held:
        yield list(zip(*held, strict=True))
