import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
from skein.llm import packing, simple8b, token_counts, token_files, word_shuffle  # noqa: E402
from skein.llm.words import hf_ids  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ROWS = [
    (3, "Hello  world, don't\tstop!", "x", 1),
    (1, None, "x", 2),
    (2, "", None, None),
    (2, "", None, None),
    (None, "no id <|endoftext|> here", "y", 3),
    (9, "word " * 9000, "y", 4),
    (10, "é" * 3000 + "日本  語\n\n" + "z" * 5000, "z", 5),
    (11, " \n\t ", "z", 6),
]
SCHEMA = "doc_id long, text string, raw string, n_tokens int"


def ids_of(path, text):
    return np.frombuffer(hf_ids(path, (text or "").encode()), "<u4").tolist()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def keyed(rows, *columns):
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_token_counts(docs):
    got = keyed(token_counts.token_counts(docs, WORD, 2048).collect(), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = []
    for d, text, *_ in ROWS:
        n = len(ids_of(WORD, text))
        want.append((d, len((text or "").encode()), n, n > 2048))
    assert got == sorted(want, key=repr)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert token_counts.token_counts(empty, WORD).collect() == []
    assert packing.pack(empty, WORD).collect() == []
    assert word_shuffle.bpe_encode(empty, RANKS, public_tokenizers.PATTERN, decode=True).collect() == []


def test_packing(docs):
    rows = packing.pack(docs, WORD, 100, keep_ids=True).collect()
    want = []
    for d, text, *_ in ROWS:
        ids = np.array([*ids_of(WORD, text), 0], "<u4")
        for k in range(0, len(ids), 100):
            own = ids[k : k + 100].tobytes()
            want.append((d, k // 100, k, len(own) // 4, zlib.crc32(own), own))
    assert [tuple(map(bytes_of, r)) for r in keyed(rows, "doc_id", "piece", "start", "length", "ids_crc32", "ids")] == sorted(want, key=repr)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100
    full = sum(r.length for r in rows)
    assert len(places) <= -(-full // 100) + 1


def bytes_of(x):
    return bytes(x) if isinstance(x, bytearray) else x


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_best_fit(lengths):
    lengths = np.array(lengths, np.int64)
    where, offset, used = packing.best_fit(lengths, 50)
    assert len(used) == 0 or used.max() <= 50
    assert used.sum() == lengths.sum()
    for b in range(len(used)):
        own = sorted((offset[i], lengths[i]) for i in np.flatnonzero(where == b))
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist()
    # no two bins could be one: best fit never opens a bin while one has room
    assert sum(1 for u in used if u <= 25) <= 1


def test_tree_rounds_merge_open_bins(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 8)
    docs = spark.createDataFrame([(i, "word " * (1 + i % 40)) for i in range(400)], "doc_id long, text string").repartition(16)
    rows = packing.pack(docs, WORD, 100).collect()
    assert len(rows) == 400
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.1 * -(-total // 100) + 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 3) | st.integers(0, 70_000), max_size=300), st.booleans())
def test_simple8b_round_trip(values, narrow):
    a = np.array([v & 0xFFFFFFFF for v in values] if narrow else values, np.uint32 if narrow else np.uint64)
    words, frames, exceptions = simple8b.encode(a)
    assert simple8b.decode(words, frames, exceptions, len(a)).tolist() == a.tolist()


def test_simple8b_many_frames():
    rng = np.random.default_rng(0)
    a = np.where(rng.random(50_000) < 0.5, 0, rng.integers(0, 1 << 40, 50_000) >> rng.integers(0, 40, 50_000)).astype(np.uint64)
    a[::977] = 2**63
    words, frames, exceptions = simple8b.encode(a)
    assert len(frames) == -(-len(a) // simple8b.FRAME)
    assert len(exceptions) == len(a[::977])
    assert (simple8b.decode(words, frames, exceptions, len(a)) == a).all()


def test_token_files(spark, docs, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write_token_files(docs, path, BYTE, end_id=0, n_files=3)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (d, text, *_) in zip(got, order, strict=True):
        ids = [*ids_of(BYTE, text), 0]
        assert (r.doc_id, r.start, r.n_tokens) == (d, at, len(ids))
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += len(ids)
    token_files.write_token_files(docs.limit(0), f"file://{tmp_path}/none", BYTE)
    assert token_files.read_token_files(spark, f"file://{tmp_path}/none").collect() == []


def test_word_shuffle_round_trip(docs):
    encoding = word_shuffle.bpe(RANKS, public_tokenizers.PATTERN)
    rows = word_shuffle.bpe_encode(docs, RANKS, public_tokenizers.PATTERN, decode=True).collect()
    got = sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist(), bytes(r.decoded)) for r in rows), key=repr)
    want = [(d, encoding.encode_ordinary(t or ""), (t or "").encode()) for d, t, *_ in ROWS]
    assert got == sorted(want, key=repr)
    again = word_shuffle.bpe_decode(word_shuffle.bpe_encode(docs, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted((t or "").encode() for _, t, *_ in ROWS)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5), st.sampled_from([1, 3, 1 << 20]))
def test_decoding_joins_the_token_table(texts, row):
    encoding, whole = word_shuffle.bpe(RANKS, public_tokenizers.PATTERN), word_shuffle.ROW
    raws = [t.encode("utf-8", "ignore") for t in texts]
    ids = [np.array(encoding.encode_ordinary(r.decode()), "<u4").tobytes() for r in raws]
    word_shuffle.ROW = row
    try:
        assert word_shuffle.decoded(ids, word_shuffle.token_bytes(RANKS)) == raws
    finally:
        word_shuffle.ROW = whole


def test_packing_of_ties_and_one_very_long_text(spark):
    rows = [(i, "word word") for i in range(200)] + [(500, "word " * 50_000), (501, "x" * 100_000)]
    found = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), WORD, 2048).collect()
    sizes, ends = {}, {}
    for r in found:
        sizes.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for text_id, text in rows:
        n = len(ids_of(WORD, text)) + 1
        assert sorted(sizes[text_id]) == [(k, a, min(2048, n - a)) for k, a in enumerate(range(0, n, 2048))]
    for own in ends.values():
        own.sort()
        assert own[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 2048
    assert len(ends) <= -(-sum(r.length for r in found) // 2048) + 1


def test_clashing_names_and_ids_that_are_no_numbers(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x y", 1, "f")], "doc_id string, text string, n_ids int, file string")
    with pytest.raises(Exception, match="long|int|number|convert"):
        token_files.write_token_files(docs, f"file://{tmp_path}/s", BYTE)
    token_files.write_token_files(docs.selectExpr("1L AS doc_id", "text", "n_ids", "file", "text AS raw"), f"file://{tmp_path}/n", BYTE)
    assert [r.n_tokens for r in token_files.read_token_files(spark, f"file://{tmp_path}/n").collect()] == [3]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\xa0", "　", "\t", "a", "é1", "don't", "!?", "\x85", "<|endoftext|>", "x"]), max_size=10).map("".join))
def test_words_encode_as_the_text(text):
    import regex

    encoding = word_shuffle.bpe(RANKS, public_tokenizers.PATTERN)
    words = word_shuffle.words_of(text.encode(), regex.compile(public_tokenizers.PATTERN))
    assert [i for w in words for i in encoding.encode_ordinary(w.decode())] == encoding.encode_ordinary(text)


def test_changed_input_raises():
    import pyarrow as pa

    one = word_shuffle.pack_parts(word_shuffle._mark([b"a"]), b"", b"")
    rows = word_shuffle._rows([word_shuffle.TEXTS], [1], [0], [[1]], [one], pa.int64())
    with pytest.raises(RuntimeError, match="changed"):
        list(word_shuffle._assemble(None, pa.int64(), iter([rows])))


def test_chunks_of_words_are_bounded(monkeypatch):
    import pyarrow as pa
    import regex

    monkeypatch.setattr(word_shuffle, "CHUNK_BYTES", 2000)
    rows = [f"word{k} and more of it ".encode() * (1 + k % 9) for k in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([3] * 200, pa.int64()), pa.array(range(200)), pa.array(rows, pa.binary())], ["part", "doc_id", "raw"])
    found = list(word_shuffle._chunks(iter([batch]), regex.compile(public_tokenizers.PATTERN), True))
    assert [d for _, _, ids, _ in found for d in ids] == list(range(200))
    assert [c for c, *_ in found] == [(3 << 24) + k for k in range(len(found))]
    for _, _, ids, _ in found:
        assert sum(len(rows[d]) + 1 for d in ids) < 2000 + max(map(len, rows)) + 1
    assert len(found) > 5
