"""Removal of passages that repeat across or within documents, over the whole corpus.

A window is ``n`` consecutive words of one document; a word goes if a window that covers it
also starts earlier in the corpus. Repeats are found by suffix automata of reference shards.
The corpus is its own reference, of no bounded size, so its shards are not broadcast: each
shard, the passages around one anchor, meets its documents' passages by a shuffle, and they
stream through the shard's automaton in corpus order, each adding itself as it is matched. A
state knows where its words ended for the first time, so a window is removed if that was
elsewhere. Only passages equal to an earlier one of the shard need no automaton. Against a
reference of bounded size, ``reference_spans`` broadcasts the automata to all documents.

A window's anchor is the least hash of the 8-word runs inside it, so equal windows share it and
neighbouring windows mostly do. The steps:

1. Anchors are counted. Two maps of ``MAP_BITS`` bits, broadcast and of that size whatever the
   input, mark those that repeat and those with over ``CROWD`` places; a bit set by chance only
   costs work.
2. Tasks cut windows with repeated anchors from documents, some million words at a time, let
   them through automata of their own shards, and send what occurred there first: a passage
   that a third of all documents hold costs one row per task, not one per document. Windows
   with a crowded anchor stand alone, in the shard of their own ``n`` words: no shard's
   automaton holds more than the surroundings of ``CROWD`` places.
3. Shards match what they get, row by row in order; rows are not held.
4. Removed intervals and texts meet by document.

Words compare by 40 bits of their hash next to 64 bits of the anchor.
"""

from __future__ import annotations

import contextlib
import ctypes
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.automaton import SuffixAutomaton, spans
from skein.llm.token_counts import texts
from skein.runtime import shuffle_partitions

#: Words of an anchor's run; words of a task's own shards; places of an anchor beyond which its windows are dealt on their own.
RUN, CHUNK, CROWD = 8, 1_500_000, 2048
#: Bits of each map of anchors, and slices that they are made in.
MAP_BITS, SLICES = 1 << 27, 256
ODD = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio
#: Bytes of a word's hash that travel.
WIDTH = 5


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD
    return x ^ (x >> np.uint64(29))


def _runs(hashes: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of each run of ``n`` values, by doubling."""
    out, have, power = None, 0, None
    part, size, base = hashes, 1, ODD | np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if out is None:
                    out, have, power = part, size, base
                else:
                    m = len(hashes) - have - size + 1
                    out = out[:m] * base + part[have : have + m]
                    have += size
            if have == n:
                return out
            part = part[: len(part) - size] * base + part[size:]
            base = base * base
            size *= 2


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each run of ``n`` values."""
    size = 1
    while 2 * size <= n:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (n - size)], values[n - size :]) if n > size else values


def _intervals(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions in ``at``, and lengths, of the runs of consecutive values within a group."""
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (group[1:] != group[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(at)))


def _bit_of(anchors: np.ndarray) -> np.ndarray:
    return (anchors >> np.uint64(64 - MAP_BITS.bit_length() + 1)).astype(np.int64)


class _Chunk:
    """The windows of some documents: hashes, anchors, and where each starts."""

    def __init__(self, n: int, docs: list[tuple[int, np.ndarray]]):
        docs.sort(key=lambda d: d[0])
        self.words = np.concatenate([h for _, h in docs])
        sizes = np.array([len(h) for _, h in docs])
        ends = np.cumsum(sizes)
        number = np.repeat(np.arange(len(docs)), sizes)
        self.at = np.flatnonzero(np.arange(len(self.words)) + n <= ends[number])
        self.number = number[self.at]
        self.doc = np.array([d for d, _ in docs], np.int64)[self.number]
        self.start = self.at - (ends - sizes)[self.number]
        with np.errstate(over="ignore"):
            self.runs = _mixed(_runs(self.words, RUN))
        self.anchors = _least(self.runs, n - RUN + 1)[self.at]

    def anchor_runs(self, n: int) -> np.ndarray:
        """The runs that are the anchor of a window around them, each place of its own."""
        inside = n - RUN + 1
        largest = np.zeros(len(self.runs) + inside - 1, np.uint64)  # by place, of the anchors of windows that start there
        largest[self.at + inside - 1] = self.anchors
        around = ~_least(~largest, inside)
        return self.runs[around == self.runs]

    def keep(self, chosen: np.ndarray) -> None:
        for name in ("at", "number", "doc", "start", "anchors"):
            setattr(self, name, getattr(self, name)[chosen])

    def passages(self, n: int, crowded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, first window and number of windows of each passage: neighbouring windows of one anchor, or one window of a crowded one."""
        with np.errstate(over="ignore"):
            own = _mixed(_runs(self.words, n)[self.at]) ^ _mixed(self.anchors)
        key = np.where(crowded, own, self.anchors)
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (self.number[1:] != self.number[:-1]) | (self.at[1:] != self.at[:-1] + 1) | crowded[1:]
        head = np.flatnonzero(new)
        return key[head], head, np.diff(np.append(head, len(key)))

    def periodic(self, n: int, head: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which passages hold their anchor at two places: the others hold no window twice."""
        long = size + n - RUN
        ends = np.cumsum(long)
        place = np.repeat(self.at[head] - (ends - long), long) + np.arange(ends[-1])
        same = self.runs[place] == np.repeat(self.anchors[head], long)
        return (size > 1) & (np.add.reduceat(same, ends - long, dtype=np.int64) > 1)


def _documents(n: int, batches):
    """Chunks of documents of at least ``n`` words, with their ids and word hashes."""
    docs, size = [], 0
    for batch in batches:
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            words = raw.split()
            if doc is None or len(words) < n:
                continue
            docs.append((doc, np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))))
            size += len(words)
            if size >= CHUNK:
                yield _Chunk(n, docs)
                docs, size = [], 0
    if docs:
        yield _Chunk(n, docs)


def _anchors(n: int, batches):
    """Each chunk's distinct anchors, and how many places of it each has."""
    for chunk in _documents(n, batches):
        found, counts = np.unique(chunk.anchor_runs(n), return_counts=True)
        # sorted by anchor, so rows of a slice follow each other
        part = (_bit_of(found) // (MAP_BITS // SLICES)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(found.view(np.int64)), pa.array(counts.astype(np.int32))], ["slice", "anchor", "places"])


def _slice(batches):
    """The bits of each slice whose anchors repeat, and those whose anchors are crowded."""
    size = MAP_BITS // SLICES

    def out(part, anchors, places):
        order = np.argsort(anchors, kind="stable")
        anchors, places = anchors[order], places[order].astype(np.int64)
        heads = np.flatnonzero(np.append(True, anchors[1:] != anchors[:-1]))
        total, bit = np.add.reduceat(places, heads), _bit_of(anchors[heads]) - part * size
        packed = []
        for least in (1, CROWD):
            bits = np.zeros(size, bool)
            bits[bit[total > least]] = True
            packed.append(zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *[pa.array([p], pa.binary()) for p in packed]], ["slice", "repeated", "crowded"])

    now, held, counts = None, [], []
    for batch in batches:
        parts = batch.column("slice").to_numpy()
        anchors = batch.column("anchor").to_numpy().view(np.uint64)
        places = batch.column("places").to_numpy()
        heads = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])).tolist() if len(parts) else []
        for a, b in zip(heads, [*heads[1:], len(parts)], strict=True):
            if parts[a] != now:
                if now is not None:
                    yield out(now, np.concatenate(held), np.concatenate(counts))
                now, held, counts = int(parts[a]), [], []
            held.append(anchors[a:b])
            counts.append(places[a:b])
    if now is not None:
        yield out(now, np.concatenate(held), np.concatenate(counts))


def _maps(raw: DataFrame, n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The maps of repeated and of crowded anchors, ``MAP_BITS / 8`` bytes each on the driver whatever the input."""
    found = raw.mapInArrow(lambda batches: _trimmed(_anchors(n, batches)), "slice int, anchor long, places int")
    slices = found.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_slice, "slice int, repeated binary, crowded binary")
    out = np.zeros(MAP_BITS // 8, np.uint8), np.zeros(MAP_BITS // 8, np.uint8)
    size = MAP_BITS // SLICES // 8
    for part, *packed in slices.toLocalIterator():
        for bits, own in zip(out, packed, strict=True):
            bits[part * size : (part + 1) * size] = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(own)), np.uint8)
    return out


def _marked(bits: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    bit = _bit_of(anchors)
    return (bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8) & 1).astype(bool)


ROWS = "anchor long, doc_id long, start int, n int, words binary"


def _rows(anchor, doc, start, n, words):
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor, pa.int64()), pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(n, pa.int32()), words],
        ["anchor", "doc_id", "start", "n", "words"],
    )


class _Shard:
    """Passages of one anchor, in the order of their places.

    The first is held as it is; the automaton is made when another one comes that is not equal
    to it. ``by_automaton`` and ``by_equality`` count the windows that each found.
    """

    def __init__(self, n: int):
        self.n, self.seen, self.automaton = n, {}, None
        self.by_automaton = self.by_equality = 0

    def repeats(self, doc: int, start: int, passage: bytes, periodic: bool = False) -> list[int] | range | tuple:
        """The windows of the passage, by their place in it, that start earlier in the shard; a ``periodic`` one may repeat itself."""
        before = self.seen.get(passage)
        if before is not None:
            # a repeated row of one document starts no earlier than itself
            out = range(len(passage) // WIDTH - self.n + 1) if before != (doc, start) else ()
            self.by_equality += len(out)
            return out
        if self.seen and self.automaton is None:
            self.automaton = SuffixAutomaton()
            ((first, place),) = self.seen.items()
            self.automaton.repeats(_word_hashes(first), self.n, *place)
        self.seen[passage] = doc, start
        if self.automaton is None:
            if not periodic:
                return ()
            self.automaton = SuffixAutomaton()
        out = self.automaton.repeats(_word_hashes(passage), self.n, doc, start)
        self.by_automaton += len(out)
        return out


def _word_hashes(passage: bytes) -> list[int]:
    raw = np.frombuffer(passage, "u1").reshape(-1, WIDTH)
    wide = np.zeros((len(raw), 8), "u1")
    wide[:, :WIDTH] = raw
    return wide.view("<u8").ravel().tolist()


def _runs_of(places) -> list[tuple[int, int]]:
    """First value and length of each run of consecutive values."""
    out: list[list[int]] = []
    for x in places:
        if out and out[-1][0] + out[-1][1] == x:
            out[-1][1] += 1
        else:
            out.append([x, 1])
    return [tuple(run) for run in out]


def _trimmed(rows):
    """``rows``, after which the worker gives freed memory back: it is kept for later stages, which need far less."""
    yield from rows
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def _windows(n: int, maps, batches):
    """Of each chunk, what occurs there first, as passages; and what does not, which is settled, as rows without words."""
    repeated, crowded = maps.value
    for chunk in _documents(n, batches):
        chunk.keep(np.flatnonzero(_marked(repeated, chunk.anchors)))
        if not len(chunk.at):
            continue
        key, head, size = chunk.passages(n, _marked(crowded, chunk.anchors))
        order = np.argsort(key, kind="stable")  # documents ascend in a chunk, so places ascend in a shard
        ordered = key[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        shard = np.cumsum(new) - 1
        # a passage alone in its shard is sent as it is, unless it may repeat itself
        periodic = chunk.periodic(n, head, size)[order]
        alone = (np.bincount(shard)[shard] == 1) & ~periodic
        rows = order[~alone]
        gone, fresh = [], []
        raw = np.ascontiguousarray(chunk.words.astype("<u8").view("u1").reshape(-1, 8)[:, :WIDTH]).tobytes()
        at, docs, starts = chunk.at[head[rows]].tolist(), chunk.doc[head[rows]].tolist(), chunk.start[head[rows]].tolist()
        now, own = None, None
        columns = (shard[~alone].tolist(), docs, starts, head[rows].tolist(), size[rows].tolist(), at, periodic[~alone].tolist())
        for k, doc, start, h, m, a, twice in zip(*columns, strict=True):
            if k != now:
                now, own = k, _Shard(n)
            found = own.repeats(doc, start, raw[a * WIDTH : (a + m + n - 1) * WIDTH], twice)
            if len(found) == m:
                gone.append((h, m))
            elif not found:
                fresh.append((h, m))
            else:
                left = set(found)
                gone += [(h + x, long) for x, long in _runs_of(found)]
                fresh += [(h + x, long) for x, long in _runs_of([x for x in range(m) if x not in left])]
        if gone:
            at, long = (np.array(c) for c in zip(*gone, strict=True))
            with np.errstate(over="ignore"):
                anywhere = _mixed((chunk.doc[at] + at).view(np.uint64))  # settled rows need no shard
            yield _rows(anywhere.view(np.int64), chunk.doc[at], chunk.start[at], long, pa.nulls(len(at), pa.binary()))
        alone = order[alone]
        sent = np.concatenate([head[alone], np.array([h for h, _ in fresh], np.int64)])
        long = np.concatenate([size[alone], np.array([m for _, m in fresh], np.int64)])
        # parts of a passage stay in its shard
        shard_of = key[np.searchsorted(head, sent, side="right") - 1] if len(sent) else key[:0]
        for k in range(0, len(sent), 20_000):
            part = slice(k, k + 20_000)
            yield _passages(n, chunk, shard_of[part], sent[part], long[part])


def _passages(n: int, chunk: _Chunk, key: np.ndarray, head: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    long = size + n - 1
    ends = np.cumsum(long)
    place = np.repeat(chunk.at[head] - (ends - long), long) + np.arange(ends[-1])
    raw = np.ascontiguousarray(chunk.words[place].astype("<u8").view("u1").reshape(-1, 8)[:, :WIDTH])
    offsets = (np.append(0, ends) * WIDTH).astype("<i4")
    blob = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return _rows(key.view(np.int64), chunk.doc[head], chunk.start[head], size, blob)


REMOVED = "doc_id long, start int, n int"


def _removed(n: int, batches):
    """Intervals of windows that start earlier in their shard; rows come by shard, document and start, and none is held but by a shard's automaton."""
    now, shard = None, None
    for whole in batches:
        words = whole.column("words")
        settled = whole.filter(words.is_null())
        if settled.num_rows:
            yield pa.RecordBatch.from_arrays([settled.column(c) for c in ("doc_id", "start", "n")], ["doc_id", "start", "n"])
        batch = whole.filter(words.is_valid())
        if not batch.num_rows:
            continue
        anchor = batch.column("anchor").to_numpy()
        heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        sizes = np.diff(np.append(heads, len(anchor)))
        # shards of one row have nothing to match; the first and last may go on in other batches
        wanted = sizes > 1
        wanted[0] = wanted[-1] = True
        rows = np.flatnonzero(np.repeat(wanted, sizes))
        columns = [batch.column(c).to_numpy()[rows].tolist() for c in ("anchor", "doc_id", "start")]
        passages = batch.column("words").take(pa.array(rows)).to_numpy(zero_copy_only=False).tolist()
        out: list[tuple] = []
        for key, doc, start, passage in zip(*columns, passages, strict=True):
            if key != now:
                now, shard = key, _Shard(n)
            found = shard.repeats(doc, start, passage)
            if found:
                out += [(doc, start + a, m) for a, m in ([(0, len(found))] if isinstance(found, range) else _runs_of(found))]
        if out:
            doc, start, size = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], ["doc_id", "start", "n"])


def _packed(batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            batch = whole.slice(k, 512)
            rows = batch.num_rows
            packed = [pack(raw) for raw in batch.column("raw").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([1] * rows, pa.int8()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.int32()), pa.array(packed, pa.binary()), batch.column("others")],
                ["doc_id", "kind", "start", "n", "raw", "others"],
            )


def _kept(n: int, batches):
    unpack = zstandard.ZstdDecompressor().decompress
    doc_now, starts, lengths = None, [], []
    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            batch = whole.slice(k, 512)
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "kind", "start", "n", "raw")]
            rows, counts, gone, kept = [], [], [], []
            for row, (doc, kind, start, length, raw) in enumerate(zip(*columns, strict=True)):
                if doc != doc_now:
                    doc_now, starts, lengths = doc, [], []
                if kind == 0:  # intervals come before the texts of their document
                    starts.append(start)
                    lengths.append(length)
                    continue
                own = unpack(raw)
                words = own.split()
                total = len(words)
                if starts and doc is not None:
                    at, to = np.array(starts), np.array(starts) + np.array(lengths) + n - 1
                    cover = np.zeros(total + 1, np.int64)
                    np.add.at(cover, np.minimum(at, total), 1)
                    np.add.at(cover, np.minimum(to, total), -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                rows.append(row)
                counts.append(total)
                gone.append(total - len(words))
                kept.append(b" ".join(words))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([columns[0][r] for r in rows], pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(gone, pa.int64()),
                        pa.array(kept, pa.binary()),
                        batch.column("others").take(pa.array(rows)),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept", "others"],
                )


def removed_windows(docs: DataFrame, n: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, start, n)``: runs of window starts whose windows start earlier in the corpus."""
    if n <= RUN:
        raise ValueError(f"windows have over {RUN} words")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    raw = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    maps = spark.sparkContext.broadcast(_maps(raw, n, parts))
    sent = raw.mapInArrow(lambda batches: _trimmed(_windows(n, maps, batches)), ROWS)
    dealt = sent.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc_id", "start")
    return dealt.mapInArrow(lambda batches: _trimmed(_removed(n, batches)), REMOVED)


#: Words of a reference that one automaton holds, and automata that documents stream through at a time.
SHARD_WORDS, AT_ONCE = 100_000, 20


def _statistics(n: int, automata, batches):
    for batch in batches:
        out = []
        for doc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("raw").to_pylist(), strict=True):
            words = raw.split()
            for automaton in automata:
                out.extend((doc, a, b - a) for a, b in spans(automaton.value.statistics(words), n))
        if out:
            doc, start, size = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int32()), pa.array(size, pa.int32())], ["doc_id", "start", "n"])


def reference_spans(docs: DataFrame, reference: DataFrame, n: int = 20, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, start, n)``: maximal spans of words of each document whose windows of ``n`` words occur in ``reference (text)``.

    The reference is cut into shards of ``SHARD_WORDS`` words, each text with the ``n - 1``
    words before the cut; their automata are broadcast, ``AT_ONCE`` at a time, and every
    document streams through each. A reference of any size is matched; documents are read once
    for every ``AT_ONCE`` shards of it. Spans of several shards may overlap.
    """
    spark = docs.sparkSession
    raw = texts(docs, doc_id, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    out, held = None, []

    def streamed(out):
        found = raw.mapInArrow(partial(_statistics, n, list(held)), REMOVED)
        held.clear()
        return found if out is None else out.unionByName(found)

    shard, size = [], 0
    for (body,) in reference.select(F.coalesce(F.col(text), F.lit(""))).toLocalIterator():
        own = body.encode().split()
        for a in range(0, max(len(own), 1), SHARD_WORDS):
            piece = own[max(0, a - n + 1) : a + SHARD_WORDS]
            if size + len(piece) > SHARD_WORDS and shard:
                held.append(spark.sparkContext.broadcast(SuffixAutomaton(shard)))
                shard, size = [], 0
                if len(held) == AT_ONCE:
                    out = streamed(out)
            shard.append(piece)
            size += len(piece)
    held.append(spark.sparkContext.broadcast(SuffixAutomaton(shard)))
    return streamed(out)


def substring_dedup(docs: DataFrame, n: int = 20, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for every row of ``docs``; ``kept`` is the words that stay, joined by one space.

    Earlier means a smaller document id, or an earlier start in the same document; windows are
    judged on the input. Null and empty texts have no words, texts of under ``n`` words keep
    all. Rows that repeat an id are one document: a position removed in one is removed in all.
    Rows without an id have no order and keep all their words. ``carry`` names columns to pass
    on in a struct ``others``; the rest are ignored.
    """
    parts = shuffle_partitions(docs.sparkSession)
    others = F.struct(*[F.col(c) for c in carry] or [F.lit(None).cast("int").alias("none")]).alias("others")
    raw = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"), others
    )
    kind_of_others = raw.schema["others"].dataType
    mixed = f"doc_id long, kind tinyint, start int, n int, raw binary, others {kind_of_others.simpleString()}"
    gone = removed_windows(docs, n, doc_id, text).select(
        "doc_id",
        F.lit(0).cast("tinyint").alias("kind"),
        "start",
        "n",
        F.lit(None).cast("binary").alias("raw"),
        F.lit(None).cast(kind_of_others).alias("others"),
    )
    both = gone.unionByName(raw.mapInArrow(_packed, mixed))
    dealt = both.repartition(parts, "doc_id").sortWithinPartitions("doc_id", "kind")
    out = f"doc_id long, n_words long, n_removed long, kept binary, others {kind_of_others.simpleString()}"
    # a task writes the rows of several parts, one after the other: each file that an executor opens costs a helper process
    files = min(parts, max(2 * docs.sparkSession.sparkContext.defaultParallelism, parts // 4))
    found = dealt.mapInArrow(partial(_kept, n), out).coalesce(files)
    return found if carry else found.drop("others")
