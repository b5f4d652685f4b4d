"""Best-fit packing of documents into fixed-length sequences, hierarchically.

Each task cuts and packs its own pieces by best fit, largest first, and closes the bins that
are nearly full. Underfull bins then go through tree rounds as items of their own: groups of
at most ``GROUP`` bins are packed again by best fit, merged bins that became nearly full are
closed, the rest enter the next round with fewer groups, until one group holds them all or a
round no longer merges. Only ``(bin, used)`` pairs travel in the rounds, each written to as few
files as its size needs; pieces are placed at the end by joins on the bin.
"""

from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.token_counts import texts
from skein.llm.words import in_slabs, word_ids
from skein.runtime import materialize

#: Pieces a task packs at a time, and bins a group of a tree round holds at most (about).
LOCAL, GROUP = 100_000, 40_000
#: A bin with less free room than this share of a sequence is closed.
NEARLY_FULL = 1 / 256
#: A round that merges a smaller share of its bins than this is the last.
LEAST_GAIN = 0.01
MAX_ROUNDS = 24


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and what each bin uses; largest first, into the fullest bin that has room.

    Bins wait in stacks by free room; the set of non-empty stacks is one integer, whose lowest
    set bit from the item's length on names the tightest fit.
    """
    order = np.argsort(-lengths, kind="stable")
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    where, offset, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            stack = stacks[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(used)
            used.append(0)
        where[i], offset[i] = b, used[b]
        used[b] += size
        if room > size:
            stacks[room - size].append(b)
            rooms |= 1 << (room - size)
    return where, offset, np.asarray(used, np.int64)


PIECE = "piece int, start long, length long, ids_crc32 long, bin long, bin_offset long, bin_used long, ids binary"


def _pack_locally(tokenizer: str, capacity: int, end_id: int, keep_ids: bool, doc_type, batches):
    first = TaskContext.get().partitionId() << 40
    docs: list = []
    columns: list[tuple] = []  # per slab: number of the document, piece, start, length, crc
    ids: list[bytes | None] = []
    n = 0

    def flush():
        nonlocal first, docs, columns, ids, n
        doc, piece, start, length, crc = (np.concatenate(c) for c in zip(*columns, strict=True))
        where, offset, used = best_fit(length, capacity)
        for a in range(0, n, 10_000):
            part = slice(a, a + 10_000)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([docs[d] for d in doc[part].tolist()], doc_type),
                    pa.array(piece[part], pa.int32()),
                    pa.array(start[part], pa.int64()),
                    pa.array(length[part], pa.int64()),
                    pa.array(crc[part], pa.int64()),
                    pa.array(where[part] + first),
                    pa.array(offset[part]),
                    pa.array(used[where[part]]),
                    pa.array(ids[part] if keep_ids else [None] * len(doc[part]), pa.binary()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "bin_offset", "bin_used", "ids"],
            )
        first += len(used)
        docs, columns, ids, n = [], [], [], 0

    for doc, raws in in_slabs(batches, "doc_id", "raw"):
        flat, ends = word_ids(tokenizer, raws, end_id)
        size = np.diff(ends, prepend=0)
        pieces = -(-size // capacity)
        own = np.repeat(np.arange(len(doc)), pieces)
        piece = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(size[own] - start, capacity)
        at = (ends - size)[own] + start
        view = memoryview(flat).cast("B")
        cut = [view[4 * a : 4 * (a + m)] for a, m in zip(at.tolist(), length.tolist(), strict=True)]
        columns.append((own + len(docs), piece, start, length, np.fromiter(map(zlib.crc32, cut), np.int64, len(cut))))
        if keep_ids:
            ids += map(bytes, cut)
        docs += doc
        n += len(own)
        if n >= LOCAL:
            yield from flush()
    if n:
        yield from flush()


def _merge(capacity: int, bins: pd.DataFrame) -> pd.DataFrame:
    bins = bins.sort_values(["used", "bin"], ascending=[False, True])
    where, offset, used = best_fit(bins["used"].to_numpy(), capacity)
    ids = bins["bin"].to_numpy()
    name = np.zeros(len(used), np.int64)
    name[where[offset == 0]] = ids[offset == 0]
    return pd.DataFrame({"bin": ids, "into": name[where], "base": offset, "into_used": used[where]})


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    keep_ids: bool = False,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece, with ``ids`` on request.

    A document is its ids followed by ``end_id``; null and empty texts are the end id alone.
    Documents longer than ``capacity`` are cut into pieces of that length, of which only the
    last may be shorter. Rows that repeat an id are packed like others. Other columns are
    ignored; an empty table yields no pieces. Ids of one sequence need not follow any order.
    """
    raw = texts(docs, doc_id, text)
    schema = T.StructType([raw.schema["doc_id"], *T._parse_datatype_string(PIECE).fields])
    doc_type = to_arrow_type(raw.schema["doc_id"].dataType)
    pieces = raw.mapInArrow(partial(_pack_locally, tokenizer, capacity, end_id, keep_ids, doc_type), schema)
    # without ids a piece is a few numbers: they go to one file per core
    pieces = materialize(pieces, "pieces") if keep_ids else materialize(pieces.drop("ids"), "pieces", compact=True)

    full = capacity - max(0, math.floor(capacity * NEARLY_FULL))
    open_bins = pieces.where((F.col("bin_offset") == 0) & (F.col("bin_used") < full)).select(
        "bin", F.col("bin_used").alias("used")
    )
    n = open_bins.count()
    placed = None
    for k in range(MAX_ROUNDS):
        groups = math.ceil(n / GROUP)
        if n < 2:
            break
        merged = (
            open_bins.withColumn("grp", F.pmod(F.xxhash64("bin", F.lit(k)), F.lit(groups)))
            .groupBy("grp")
            .applyInPandas(lambda g: _merge(capacity, g[["bin", "used"]]), "bin long, into long, base long, into_used long")
        )
        merged = materialize(merged, "merged", rows=n)
        if placed is None:
            placed = merged.select("bin", "into", "base")
        else:
            later = merged.select(F.col("bin").alias("into"), F.col("into").alias("next"), F.col("base").alias("more"))
            placed = placed.join(later, "into", "left").select(
                "bin", F.coalesce("next", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")
            )
        open_bins = merged.where((F.col("base") == 0) & (F.col("into_used") < full)).select(
            F.col("into").alias("bin"), F.col("into_used").alias("used")
        )
        left = open_bins.count()
        if groups == 1 or left > n * (1 - LEAST_GAIN):
            break
        n = left
    if placed is not None:
        pieces = pieces.join(placed, "bin", "left")
    else:
        pieces = pieces.withColumns({"into": F.lit(None).cast("long"), "base": F.lit(0)})
    return pieces.select(
        *["doc_id", "piece", "start", "length", "ids_crc32"],
        F.coalesce("into", "bin").alias("sequence_id"),
        (F.col("bin_offset") + F.coalesce("base", F.lit(0))).cast("long").alias("offset"),
        *(["ids"] if keep_ids else []),
    )
