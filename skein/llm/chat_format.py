"""Chat formatting by columnar byte assembly, and its reader.

Turn ``k`` of a conversation is written as

    <|im_start|>ROLE NEWLINE TEXT <|im_end|> NEWLINE

without the spaces. Inside roles and texts each ``<``, any number of backslashes and ``|`` gets
one more backslash, so no content holds a control string and dropping one backslash restores
it. Roles also write a backslash as two and a line end as backslash and n.

Contents are escaped as columns in the JVM. Per batch, segment lengths and cumulative offsets
are computed in numpy, and headers and contents are scattered into one preallocated buffer that
becomes the Arrow column; the loss mask is the byte spans of the assistant's texts.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.runtime import shuffle_partitions

START, END = b"<|im_start|>", b"<|im_end|>\n"
#: Bytes assembled at a time, about.
SLAB = 4 << 20


def escaped(column):
    return F.regexp_replace(column, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    """Copy the ragged segments ``data[begin : begin + size]`` to the places ``at``."""
    total = int(size.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + inside] = data[np.repeat(begin, size) + inside]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, begins and sizes of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets[:-1], np.diff(offsets)


def assemble(conv: np.ndarray, role: pa.Array, text: pa.Array, loss: np.ndarray):
    """One buffer with the formatted conversations one after another, their offsets, and the loss spans inside each.

    ``conv`` numbers the conversation of each turn, ascending from 0; ``loss`` marks turns under the mask.
    """
    roles, role_at, role_n = _bytes_of(role)
    texts, text_at, text_n = _bytes_of(text)
    turn = len(START) + role_n + 1 + text_n + len(END)
    at = np.cumsum(turn) - turn
    out = np.empty(int(turn.sum()), np.uint8)
    for k, byte in enumerate(START):
        out[at + k] = byte
    _scatter(out, at + len(START), roles, role_at, role_n)
    body = at + len(START) + role_n
    out[body] = 10
    _scatter(out, body + 1, texts, text_at, text_n)
    for k, byte in enumerate(END):
        out[body + 1 + text_n + k] = byte
    n = int(conv[-1]) + 1 if len(conv) else 0
    heads = np.searchsorted(conv, np.arange(n))
    offsets = np.append(at[heads], len(out)) if n else np.zeros(1, np.int64)
    masked = np.flatnonzero(loss)
    spans = np.searchsorted(conv[masked], np.arange(n + 1))
    begin = (body + 1)[masked] - offsets[conv[masked]]
    return out, offsets, spans, begin, text_n[masked]


def _format(id_type, batches):
    def out(table: pa.Table):
        conv = table.column("conv_id").combine_chunks()
        key = conv.to_pylist()
        new = np.array([False, *(a != b for a, b in zip(key[1:], key[:-1], strict=True))], bool)
        number = np.cumsum(new)
        heads = np.flatnonzero(np.append(True, new[1:])) if len(key) else np.zeros(0, int)
        role, text = (table.column(c).combine_chunks() for c in ("role", "text"))
        loss = table.column("loss").combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        buffer, offsets, spans, begin, size = assemble(number, role, text, loss)
        lists = pa.py_buffer(spans.astype("<i4"))
        whole = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets.astype("<i4")), pa.py_buffer(buffer)])
        counts = np.diff(np.append(heads, len(key)))
        return pa.RecordBatch.from_arrays(
            [
                conv.take(pa.array(heads)),
                whole,
                pa.array(counts, pa.int64()),
                *[pa.Array.from_buffers(pa.list_(pa.int64()), len(heads), [None, lists], children=[pa.array(x, pa.int64())]) for x in (begin, size)],
            ],
            ["conv_id", "formatted", "n_turns", "loss_start", "loss_length"],
        )

    held, size = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            held.append(part)
            size += part.nbytes
            if size >= SLAB:
                table = pa.Table.from_batches(held)
                key = table.column("conv_id").to_pylist()
                cut = len(key)
                while cut and key[cut - 1] == key[-1]:  # the last conversation may go on
                    cut -= 1
                if cut:
                    yield out(table.slice(0, cut))
                held, size = table.slice(cut).to_batches(), 0
    if held:
        yield out(pa.Table.from_batches(held))


def format_chats(turns: DataFrame, masked_role: str = "assistant") -> DataFrame:
    """``(conv_id, formatted, n_turns, loss_start, loss_length)`` of each conversation of ``turns (conv_id, turn, role, text)``.

    ``formatted`` is UTF-8 bytes; the two arrays hold the byte spans of the masked role's texts.
    Turns go by their number, equal or null numbers by role and text, nulls first. Null roles
    and texts are empty; rows without a conversation form one of their own. A conversation is
    one value, so it must fit in memory; other columns are ignored.
    """
    n = shuffle_partitions(turns.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    safe_role = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select(
        "conv_id",
        escaped(safe_role).cast("binary").alias("role"),
        escaped(F.col("text")).cast("binary").alias("text"),
        (F.col("role") == masked_role).alias("loss"),
    )
    id_type = turns.schema["conv_id"].dataType
    longs = T.ArrayType(T.LongType())
    schema = T.StructType(
        [
            T.StructField("conv_id", id_type),
            T.StructField("formatted", T.BinaryType()),
            T.StructField("n_turns", T.LongType()),
            T.StructField("loss_start", longs),
            T.StructField("loss_length", longs),
        ]
    )
    arrow_id = to_arrow_type(id_type)
    return rows.mapInArrow(lambda batches: _format(arrow_id, batches), schema)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, as they were."""
    out = []
    for part in formatted.split(START.decode())[1:]:
        role, body = part.split("\n", 1)
        out.append((_unescaped_role(role), unescaped(body.removesuffix(END.decode()))))
    return out


def _read(batches):
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            rows = []
            for raw, starts, lengths in zip(*[part.column(c).to_pylist() for c in ("formatted", "loss_start", "loss_length")], strict=True):
                text = raw.decode()
                turns = read_turns(text)
                loss = "".join(unescaped(raw[a : a + n].decode()) for a, n in zip(starts, lengths, strict=True))
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append(
                    (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text))
                )
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part.column("conv_id"), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)


def read_chats(formatted: DataFrame) -> DataFrame:
    """What the output says: turns, their digest, the text under the loss mask and its digest, and the length in code points."""
    schema = T.StructType(
        [
            formatted.schema["conv_id"],
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )
    return formatted.select("conv_id", "formatted", "loss_start", "loss_length").mapInArrow(_read, schema)
