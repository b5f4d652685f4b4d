"""Byte-level BPE encoding by a global shuffle of distinct words, and decoding.

Tasks cut texts into words in chunks. A chunk keeps its texts as positions: for each word of a
text, its number in the chunk's list of distinct words. That list is exploded over ``bucket =
hash(word)`` and shuffled, so that each distinct word meets all its requests in one bucket and
is encoded there once; its ids go back to the chunk, where texts are put together by position.
A word that a third of all texts hold is requested once per chunk, so no bucket grows with the
copies of a word. Positions travel as compressed numbers, never as rows, and cross one shuffle
only: texts are cut twice, once for the words and once for the positions. Both cuts name the
list of words they number by a checksum, so an input that changes between them raises.

Decoding joins ids with the token-byte table, a column of bytes with offsets by id: the ids of
a slab of texts are rows of a gather, which writes all their bytes at once.
"""

from __future__ import annotations

import base64
import zlib
from functools import cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.parts import pack_parts, planes, unpack_parts, unplanes
from skein.llm.token_counts import texts
from skein.llm.words import UNIT, Cache, irregular
from skein.runtime import shuffle_partitions

#: A chunk is closed after so many bytes of text or distinct words; texts of a chunk travel in rows of about ROW words.
CHUNK_BYTES, CHUNK_WORDS, ROW = 48 << 20, 800_000, 1 << 20
#: Bytes of ids that leave a task at a time.
OUT_BYTES = 4 << 20
WORDS, TEXTS = 0, 1


@cache
def bpe(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def token_bytes(ranks_path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table: all tokens' bytes one after another, and by id where each starts and how long it is."""
    with open(ranks_path, "rb") as f:
        pairs = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    tokens = [pairs.get(i, b"") for i in range(max(pairs) + 1)]
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def decoded(texts: list[bytes], table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[bytes]:
    """The bytes that the ids of each text stand for: a join of all ids with the table."""
    raw, starts, sizes = table
    ids = np.frombuffer(b"".join(texts), "<u4")
    parts, ends, before = [], [np.zeros(1, np.int64)], 0
    for a in range(0, len(ids), ROW):
        own = ids[a : a + ROW]
        long = sizes[own]
        to = np.cumsum(long)
        parts.append(raw[np.repeat(starts[own] - (to - long), long) + np.arange(to[-1])])
        ends.append(before + to)
        before += int(to[-1])
    out = np.concatenate(parts).tobytes() if parts else b""
    cuts = np.concatenate(ends)[np.cumsum([len(t) // 4 for t in texts], dtype=np.int64)].tolist()
    return [out[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def words_of(raw: bytes, pattern) -> list[bytes]:
    """The words of a text, each of whose encodings is that of its matches of ``pattern`` one after another."""
    if irregular(raw):
        return [m.encode() for m in pattern.findall(raw.decode("utf-8", "replace"))]
    return UNIT.findall(raw)


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


SCHEMA = "kind tinyint, chunk long, bucket int, ids array<{}>, payload binary"


def _rows(kind, chunk, bucket, ids, payload, id_type):
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int8()), pa.array(chunk, pa.int64()), pa.array(bucket, pa.int32()), pa.array(ids, pa.list_(id_type)), pa.array(payload, pa.binary())],
        ["kind", "chunk", "bucket", "ids", "payload"],
    )


def _chunks(batches, find, positions_too: bool):
    """``(chunk, words, document ids, positions)`` of each chunk; positions on request."""
    numbers, size, ids, positions, chunk = _Numbers(), 0, [], [], None
    for batch in batches:
        if chunk is None and batch.num_rows:
            chunk = batch.column("part")[0].as_py() << 24
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            words = words_of(raw, find)
            own = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
            if positions_too:
                ids.append(doc)
                positions.append(own)
            size += len(raw) + 1
            if size >= CHUNK_BYTES or len(numbers) >= CHUNK_WORDS:
                yield chunk, list(numbers), ids, positions
                numbers, size, ids, positions, chunk = _Numbers(), 0, [], [], chunk + 1
    if size:
        yield chunk, list(numbers), ids, positions


def _mark(words: list[bytes]) -> bytes:
    mark = 0
    for a in range(0, len(words), 10_000):
        mark = zlib.crc32(b" ".join(words[a : a + 10_000]), mark)
    return mark.to_bytes(4, "little") + len(words).to_bytes(4, "little")


def _ask(pattern: str, n_buckets: int, id_type, batches):
    """The words of each chunk, by bucket: their numbers in the chunk, lengths and bytes."""
    for chunk, words, _, _ in _chunks(batches, regex.compile(pattern), False):
        mark = _mark(words)
        bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % n_buckets
        order = np.argsort(bucket, kind="stable")
        ends = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        for b in range(n_buckets):
            own = order[ends[b] : ends[b + 1]]
            if len(own):
                mine = [words[i] for i in own.tolist()]
                lengths = np.array([len(w) for w in mine], "<u4")
                payload = pack_parts(mark, planes(np.diff(own, prepend=0)), planes(lengths), b"".join(mine))
                yield _rows([WORDS], [chunk], [b], [None], [payload], id_type)


def _place(pattern: str, id_type, batches):
    """The texts of each chunk as positions in its words."""
    for chunk, words, ids, positions in _chunks(batches, regex.compile(pattern), True):
        mark = _mark(words)
        a = held = 0
        for b, own in enumerate(positions, 1):
            held += len(own)
            if held >= ROW or b == len(positions):
                lengths = np.array([len(p) for p in positions[a:b]], "<u4")
                payload = pack_parts(mark, lengths.tobytes(), planes(np.concatenate(positions[a:b])))
                yield _rows([TEXTS], [chunk], [0], [ids[a:b]], [payload], id_type)
                a, held = b, 0


def _encode(ranks_path: str, pattern: str, id_type, batches):
    encoding = bpe(ranks_path, pattern)

    def make(word: bytes) -> bytes:
        return np.asarray(encoding.encode_ordinary(word.decode("utf-8", "replace")), "<u4").tobytes()

    bucket_now, known = None, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("chunk", "bucket", "payload")]
        for chunk, bucket, payload in zip(*columns, strict=True):
            if bucket != bucket_now:  # rows come sorted by bucket: each distinct word is encoded in its bucket only
                bucket_now, known = bucket, Cache(make, limit=1_000_000, longest=256)
            mark, own, lengths, joined = unpack_parts(payload)
            ends = np.cumsum(unplanes(lengths)).tolist()
            ids = [known[joined[a:b]] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            counts = np.array([len(x) // 4 for x in ids], "<u4")
            reply = pack_parts(mark, own, planes(counts), planes(np.frombuffer(b"".join(ids), "<u4")))
            yield _rows([WORDS], [chunk], [bucket], [None], [reply], id_type)


def _assemble(ranks_path: str | None, id_type, batches):
    chunk_now, mark_now, table, missing = None, None, [], 0
    docs, out, size = [], [], 0
    names = ["doc_id", "ids", *(["decoded"] if ranks_path else [])]

    def flush():
        nonlocal docs, out, size
        both = [out, *([decoded(out, token_bytes(ranks_path))] if ranks_path else [])]
        yield pa.RecordBatch.from_arrays([pa.array(docs, id_type), *[pa.array(c, pa.binary()) for c in both]], names)
        docs, out, size = [], [], 0

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("kind", "chunk", "ids", "payload")]
        for kind, chunk, ids, payload in zip(*columns, strict=True):
            mark, *parts = unpack_parts(payload)
            if chunk != chunk_now:
                chunk_now, mark_now, table = chunk, mark, [b""] * int.from_bytes(mark[4:], "little")
                missing = len(table)
            if mark != mark_now or kind == TEXTS and missing:
                raise RuntimeError("the documents changed between two reads: materialize them first")
            if kind == WORDS:  # come before the texts of their chunk
                own, counts, packed = parts
                ends = np.cumsum(unplanes(counts).astype(np.int64) * 4).tolist()
                missing -= len(ends)
                raw = unplanes(packed).tobytes()
                for i, a, b in zip(np.cumsum(unplanes(own)).tolist(), [0, *ends[:-1]], ends, strict=True):
                    table[i] = raw[a:b]
                continue
            at, a = unplanes(parts[1]), 0
            for doc, n in zip(ids, np.frombuffer(parts[0], "<u4").tolist(), strict=True):
                own = b"".join(map(table.__getitem__, at[a : a + n].tolist()))
                a += n
                docs.append(doc)
                out.append(own)
                size += len(own)
                if size >= OUT_BYTES:
                    yield from flush()
    if docs:
        yield from flush()


def bpe_encode(
    docs: DataFrame, ranks_path: str, pattern: str, decode: bool = False, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, ids)``: the ids of each whole text as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded separately by the ranks file, and special strings are
    ordinary text. ``pattern`` must cut at ASCII white space the way GPT-2's does: a space joins
    the word after it, other white space stands alone. With ``decode``, ``decoded`` holds the
    bytes that the ids stand for. Null and empty texts have no ids; repeated rows and null ids
    are kept; other columns are ignored. ``docs`` is read twice and must not change meanwhile.
    """
    n = shuffle_partitions(docs.sparkSession)
    # the number of the scan's own partition, which a task's number is not where a union stands above the scan
    raw = texts(docs, doc_id, text).withColumn("part", F.spark_partition_id().cast("long"))
    id_type = raw.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    schema = SCHEMA.format(id_type.simpleString())
    asked = raw.mapInArrow(partial(_ask, pattern, n, arrow_id), schema)
    answered = asked.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(partial(_encode, ranks_path, pattern, arrow_id), schema)
    placed = raw.mapInArrow(partial(_place, pattern, arrow_id), schema)
    whole = answered.unionByName(placed).repartition(n, "chunk").sortWithinPartitions("chunk", "kind")
    out = [raw.schema["doc_id"], T.StructField("ids", T.BinaryType())]
    if decode:
        out.append(T.StructField("decoded", T.BinaryType()))
    return whole.mapInArrow(partial(_assemble, ranks_path if decode else None, arrow_id), T.StructType(out))


def _decode(ranks_path: str, batches):
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            ids = part.column("ids").to_pylist()
            found = decoded([r or b"" for r in ids], token_bytes(ranks_path))
            out = [None if r is None else d for r, d in zip(ids, found, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "decoded"])


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the bytes that ``ids`` stand for by the token-byte table of the vocabulary."""
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())])
    return encoded.mapInArrow(partial(_decode, ranks_path), schema)
