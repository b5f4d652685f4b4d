"""Token ids of documents in binary files of Simple-8b blocks.

Documents are dealt by ranges of their id, so file ``k`` holds ids before those of file
``k + 1``; inside a file they ascend. A file is a Parquet container whose rows are blocks:
``(file, block, first, n_ids, payload)``, ``first`` counting the ids of the file before the
block. A block holds some 8 MiB of text, or one longer text. A payload is

    magic "S8B1" | n_docs u4 | n_frames u4 | n_exceptions u4
    document ids i8[n_docs] | null marks u1[n_docs] | ids per document u8[n_docs]
    word offset of each frame u4[n_frames + 1] | words u8[] | exceptions u8[]

Frames are coded on their own, so a decoder places the words of all frames at once.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import simple8b
from skein.llm.token_counts import texts
from skein.llm.words import in_slabs, unit_ids

MAGIC = b"S8B1"
FILE_SCHEMA = "file int, block int, first long, n_ids long, payload binary"


def encode_block(doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """One payload of all documents' ids, one after another, and how many each has."""
    words, frame_words, exceptions = simple8b.encode(ids)
    return b"".join(
        [
            MAGIC,
            struct.pack("<III", len(doc_ids), len(frame_words), len(exceptions)),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], "u1").tobytes(),
            lengths.astype("<u8").tobytes(),
            np.concatenate([[0], np.cumsum(frame_words)]).astype("<u4").tobytes(),
            words.astype("<u8").tobytes(),
            exceptions.astype("<u8").tobytes(),
        ]
    )


def decode_block(payload: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """``(document ids, ids per document, all ids)`` of one payload."""
    if payload[:4] != MAGIC:
        raise ValueError("not a token block")
    n_docs, n_frames, n_exceptions = struct.unpack_from("<III", payload, 4)
    at = 16

    def read(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(payload, kind, n, at)
        at += out.nbytes
        return out

    doc_ids, nulls, lengths = read("<i8", n_docs), read("u1", n_docs), read("<u8", n_docs).astype(np.int64)
    offsets = read("<u4", n_frames + 1).astype(np.int64)
    words = read("<u8", int(offsets[-1]))
    ids = simple8b.decode(words, np.diff(offsets), read("<u8", n_exceptions), int(lengths.sum()), np.uint32)
    return [None if z else int(d) for d, z in zip(doc_ids, nulls, strict=True)], lengths, ids


def _write(tokenizer: str, end_id: int, batches):
    file, first = TaskContext.get().partitionId(), 0
    for block, (docs, raws) in enumerate(in_slabs(batches, "doc_id", "raw")):
        ids, ends = unit_ids(tokenizer, raws, end_id)
        payload = encode_block(docs, ids, np.diff(ends, prepend=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([len(ids)]), pa.array([payload], pa.binary())],
            ["file", "block", "first", "n_ids", "payload"],
        )
        first += len(ids)


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, n_files: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Encode every text, end it with ``end_id`` and write the ids in ascending order of the document id.

    Ids must be long integers; null ids come first. Null texts are empty. Rows that repeat an
    id stand next to each other, ordered by text. Other columns are ignored; an empty table
    writes no block.
    """
    n = n_files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    raw = texts(docs, doc_id, text)
    dealt = raw.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "raw")
    blocks = dealt.mapInArrow(partial(_write, tokenizer, end_id), FILE_SCHEMA)
    blocks.write.option("compression", "zstd").parquet(path)


def _read(with_ids: bool, batches):
    for batch in batches:
        for first, payload in zip(batch.column("at").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            docs, lengths, ids = decode_block(payload)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            raw = memoryview(ids).cast("B")
            for a in range(0, len(docs), 1_000):
                part = slice(a, a + 1_000)
                own = [raw[4 * s : 4 * e] for s, e in zip(starts[part].tolist(), ends[part].tolist(), strict=True)]
                arrays = [
                    pa.array(docs[part], pa.int64()),
                    pa.array(starts[part] + first),
                    pa.array(lengths[part]),
                    pa.array([zlib.crc32(x) for x in own], pa.int64()),
                ]
                if with_ids:
                    arrays.append(pa.array([bytes(x) for x in own], pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, READ_NAMES[: len(arrays)])


READ_NAMES = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32, ids)`` of each document; ``start`` counts the ids of all documents before it.

    Every id is decoded; without ``with_ids`` they stay in the task. Only one number per file
    comes to the driver.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = blocks.groupBy("file").agg(F.sum("n_ids").alias("n")).orderBy("file").collect()
    starts, at = [], 0
    for file, n in sizes:
        starts.append((file, at))
        at += n
    starts = spark.createDataFrame(starts, "file int, before long")
    placed = blocks.join(F.broadcast(starts), "file").select((F.col("before") + F.col("first")).alias("at"), "payload")
    out = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return placed.mapInArrow(partial(_read, with_ids), out)
