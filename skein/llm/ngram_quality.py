"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model counts runs of ``ORDER`` bytes, white space included, with line ends around each
text. Counts are sharded by the third and fourth byte of a run, so a shard alone knows all
continuations of its runs down to three bytes; the two lowest orders are tables of at most
2**16 entries and travel to every task.

There are two models, for cross-fitting: documents fall in two halves by a hash of their id,
and a half is scored by the model that the trusted documents of the other half train. So no
document is scored by a model that has seen it, and every trusted one calibrates.

Training counts every trusted document: tasks count in chunks, shards add up. Scoring joins
counts by shard: each chunk of documents asks once for every distinct run it holds, the shard
answers with log-probabilities, and the chunk's documents, which went straight to the chunk's
task, are summed up there. What travels grows with the distinct runs of a chunk, not with its
length. A chunk holds documents of one half and ``CHUNK_BYTES`` of text, or one longer text.

A document is rejected if its perplexity is above its language's threshold, a quantile of the
trusted documents of that language: the lower end of a confidence interval around ``QUANTILE``,
which few documents widen, so that a handful of mislabelled ones do not set it. Nor shall a
handful of good ones: a threshold is at least the language's median times the same quantile of
all trusted documents' perplexities over their own languages' medians.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from skein.llm.parts import pack_parts, unpack_parts
from skein.llm.token_counts import texts
from skein.runtime import materialize, rows_with, shuffle_partitions

ORDER = 5
#: Bytes of text in a chunk and in a row of texts, about.
CHUNK_BYTES, ROW_BYTES = 48 << 20, 2 << 20
#: Models, each trained on what the others score.
HALVES = 2
#: Share of trusted documents to keep, and standard errors of that share by which a threshold is lower.
QUANTILE, ERRORS = 0.99, 1.645
#: Labels up to this many rows are broadcast (16 bytes a row); more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
EDGE = b"\n"
U8 = np.uint64


def runs_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``ORDER`` bytes of each text between line ends, one for each byte and one for its end, and how many each text has."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    pad = EDGE * (ORDER - 1)
    a = np.frombuffer(b"".join([pad + t + EDGE for t in texts]), np.uint8).astype(U8)
    n = len(a) - ORDER + 1
    out = np.zeros(n, U8)
    for j in range(ORDER):
        out = (out << U8(8)) | a[j : j + n]
    heads = np.cumsum(sizes + ORDER - 1) - (sizes + ORDER - 1)
    inside = np.arange(n) - np.repeat(heads, sizes + ORDER - 1)[:n] < np.repeat(sizes, sizes + ORDER - 1)[:n]
    return out[inside], sizes


def shard_of(grams: np.ndarray, n_shards: int) -> np.ndarray:
    """By the third and fourth byte."""
    pair = (grams >> U8(8)) & U8(0xFFFF)
    return ((pair * U8(40503)) >> U8(4)) % U8(n_shards)


def _gram_parts(grams: np.ndarray, *more: bytes) -> bytes:
    """Ascending runs as differences, with what belongs to them."""
    return pack_parts(np.diff(grams, prepend=U8(0)).astype("<u8").tobytes(), *more)


def _grams(part: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(part, "<u8"), dtype=U8)


class _Distinct:
    """Distinct runs of a chunk and how often each occurs."""

    def __init__(self):
        self.grams, self.counts = np.zeros(0, U8), np.zeros(0, np.int64)

    def add(self, grams: np.ndarray) -> None:
        codes, uniques = pd.factorize(grams)
        self._merge(uniques, np.bincount(codes, minlength=len(uniques)))

    def _merge(self, grams, counts):
        both = np.concatenate([self.grams, grams])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], np.concatenate([self.counts, counts])[order]
        heads = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        self.grams, self.counts = both[heads], np.add.reduceat(counts, heads) if len(heads) else counts

    def by_shard(self, n_shards: int):
        shard = shard_of(self.grams, n_shards)
        order = np.argsort(shard, kind="stable")
        ends = np.searchsorted(shard[order], np.arange(n_shards + 1))
        for s in range(n_shards):
            own = order[ends[s] : ends[s + 1]]
            if len(own):
                yield s, self.grams[own], self.counts[own]


def _slabs(batches, *columns: str):
    """``(half, rows of columns, bytes)``: rows of one half in lists of about ``ROW_BYTES`` of text; the first column is the text."""
    held: dict[int, list] = {h: [] for h in range(HALVES)}
    sizes = dict.fromkeys(held, 0)
    for whole in batches:
        for a in range(0, whole.num_rows, 256):
            batch = whole.slice(a, 256)
            for half, *row in zip(*[batch.column(c).to_pylist() for c in ("half", *columns)], strict=True):
                held[half].append(row)
                sizes[half] += len(row[0])
                if sizes[half] >= ROW_BYTES:
                    yield half, held[half], sizes[half]
                    held[half], sizes[half] = [], 0
    for half, rows in held.items():
        if rows:
            yield half, rows, sizes[half]


COUNTED = "shard int, payload binary"


def _count(n_shards: int, batches):
    """Runs of the documents of each half, as shards of the other half's model."""
    found, sizes = [_Distinct() for _ in range(HALVES)], [0] * HALVES

    def flush(half):
        for s, grams, counts in found[half].by_shard(n_shards):
            yield pa.RecordBatch.from_arrays(
                [pa.array([(1 - half) * n_shards + s], pa.int32()), pa.array([_gram_parts(grams, counts.astype("<u8").tobytes())], pa.binary())], ["shard", "payload"]
            )
        found[half], sizes[half] = _Distinct(), 0

    for half, rows, n in _slabs(batches, "raw"):
        found[half].add(runs_of([r[0] for r in rows])[0])
        sizes[half] += n
        if sizes[half] >= CHUNK_BYTES:
            yield from flush(half)
    for half in range(HALVES):
        yield from flush(half)


def _suffixes(grams: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct last ``n`` bytes of distinct runs, and how many runs end in each."""
    return np.unique(grams & U8((1 << 8 * n) - 1), return_counts=True)


def shard_orders(grams: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per order from ``ORDER`` down to 3 the distinct runs of a shard with their counts; below ``ORDER``, of distinct bytes before them."""
    out = {ORDER: (grams, counts)}
    for n in range(ORDER - 1, 2, -1):
        out[n] = _suffixes(out[n + 1][0], n)
    return out


ADDED = "shard int, payload binary, stats array<struct<kind:int,key:int,n:long>>"


def _add(batches):
    """Whole counts of each shard, with its shares of the count-of-counts (kind = order) and of the lowest runs (kind 2)."""
    now, found = None, _Distinct()

    def flush():
        orders = shard_orders(found.grams, found.counts)
        stats = [
            {"kind": n, "key": i, "n": int((c == i).sum())} for n, (_, c) in orders.items() for i in (1, 2, 3, 4)
        ]
        pairs, n_before = _suffixes(orders[3][0], 2)
        stats += [{"kind": 2, "key": int(k), "n": int(v)} for k, v in zip(pairs, n_before, strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([now], pa.int32()),
                pa.array([_gram_parts(found.grams, found.counts.astype("<u8").tobytes())], pa.binary()),
                pa.array([stats], pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int32()), ("n", pa.int64())]))),
            ],
            ["shard", "payload", "stats"],
        )

    for batch in batches:
        for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            if shard != now:
                if now is not None:
                    yield flush()
                now, found = shard, _Distinct()
            deltas, counts = unpack_parts(payload)
            found._merge(_grams(deltas), np.frombuffer(counts, "<u8").astype(np.int64))
    if now is not None:
        yield flush()


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more; little text can make them zero, which would leave nothing to unseen runs."""
    y = n1 / max(n1 + 2 * n2, 1)
    d = [0.0, 1 - 2 * y * n2 / max(n1, 1), 2 - 3 * y * n3 / max(n2, 1), 3 - 4 * y * n4 / max(n3, 1)]
    return np.clip(d, [0.0, 0.01, 0.01, 0.01], [0.0, 0.999, 1.999, 2.999])


def level(grams: np.ndarray, counts: np.ndarray, discount: np.ndarray):
    """Of sorted runs: each one's own share, and the distinct contexts with what they leave to the lower order."""
    if not len(grams):
        return np.zeros(0), np.zeros(0, U8), np.zeros(0)
    context = grams >> U8(8)
    heads = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
    size = np.diff(np.append(heads, len(grams)))
    total = np.add.reduceat(counts, heads).astype(float)
    off = np.minimum(discount[np.minimum(counts, 3)], counts)
    left = np.add.reduceat(off, heads) / total
    return (counts - off) / np.repeat(total, size), context[heads], left


def lowest(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probabilities of the last byte after the byte before it, a table by pair; bytes never seen share what singles leave."""
    table = np.zeros(1 << 16)
    table[pairs.astype(np.int64)] = counts
    table = table.reshape(256, 256)
    before = (table > 0).sum(axis=0)  # distinct bytes before each byte
    n = [int((before == i).sum()) for i in (1, 2, 3, 4)]
    off = np.minimum(discounts(*n)[np.minimum(before, 3)], before)
    total = before.sum()
    one = (before - off) / total + off.sum() / total / 256 if total else np.full(256, 1 / 256)
    n = [int((counts == i).sum()) for i in (1, 2, 3, 4)]
    discount = discounts(*n)
    off = np.minimum(discount[np.minimum(table, 3).astype(int)], table)
    sums = table.sum(axis=1, keepdims=True)
    known = sums > 0
    safe = np.where(known, sums, 1)
    two = np.where(known, (table - off) / safe + off.sum(axis=1, keepdims=True) / safe * one[None, :], one[None, :])
    # no byte is impossible, however the discounts fell out
    return (0.999999 * two + 0.000001 / 256).ravel()


class ShardModel:
    """Log-probabilities of runs, from one shard's counts and the tables of the lowest orders."""

    def __init__(self, grams, counts, discount: dict[int, np.ndarray], low: np.ndarray):
        self.low, self.levels = low, {}
        for n, (g, c) in shard_orders(grams, counts).items():
            self.levels[n] = (g, *level(g, c, discount[n]))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """Minus the base-2 logarithm of the probability of each run's last byte after the bytes before it."""
        p = self.low[(grams & U8(0xFFFF)).astype(np.int64)]
        for n in sorted(self.levels):
            known, share, contexts, left = self.levels[n]
            if not len(known):
                continue
            own = grams & U8((1 << 8 * n) - 1)
            i = np.minimum(np.searchsorted(known, own), len(known) - 1)
            k = np.minimum(np.searchsorted(contexts, own >> U8(8)), len(contexts) - 1)
            seen = contexts[k] == own >> U8(8)
            p = np.where(seen, np.where(known[i] == own, share[i], 0.0) + left[k] * p, p)
        return -np.log2(p)


JOINED = "shard int, kind tinyint, chunk long, payload binary"


def _ask(n_shards: int, batches):
    for half, chunk, _, found in _chunks(batches, False):
        for s, grams, _ in found.by_shard(n_shards):
            yield pa.RecordBatch.from_arrays(
                [pa.array([half * n_shards + s], pa.int32()), pa.array([1], pa.int8()), pa.array([chunk]), pa.array([_gram_parts(grams)], pa.binary())],
                ["shard", "kind", "chunk", "payload"],
            )


def _chunks(batches, with_texts: bool):
    """``(half, chunk, rows of (raw, row), distinct runs)``: rows in slabs, or the distinct runs at the end of each chunk."""
    part, opened = None, 0
    now: dict[int, list] = {}  # by half: number of the chunk, bytes, distinct runs

    def numbered(batches):
        nonlocal part
        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column("part")[0].as_py() << 24
            yield batch

    for half, rows, n in _slabs(numbered(batches), "raw", *(["row"] if with_texts else [])):
        if half not in now:
            now[half] = [part + opened, 0, _Distinct()]
            opened += 1
        if with_texts:
            yield half, now[half][0], rows, None
        else:
            now[half][2].add(runs_of([r[0] for r in rows])[0])
        now[half][1] += n
        if now[half][1] >= CHUNK_BYTES:
            chunk, _, found = now.pop(half)
            if not with_texts:
                yield half, chunk, None, found
    for half, (chunk, _, found) in now.items():
        if not with_texts:
            yield half, chunk, None, found


ANSWERED = "chunk long, kind tinyint, rows array<{}>, payload binary"


def _answers(chunk, kind, rows, payload, row_type):
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), pa.array([kind], pa.int8()), pa.array([rows], pa.list_(row_type)), pa.array([payload], pa.binary())],
        ["chunk", "kind", "rows", "payload"],
    )


def _answer(n_shards, discount, low, row_type, batches):
    empty = np.zeros(0, U8), np.zeros(0, np.int64)
    now, model = None, None
    for batch in batches:
        for shard, kind, chunk, payload in zip(*[batch.column(c).to_pylist() for c in ("shard", "kind", "chunk", "payload")], strict=True):
            parts = unpack_parts(payload)
            if shard != now:  # the counts of a shard come before the questions
                counted = (_grams(parts[0]), np.frombuffer(parts[1], "<u8").astype(np.int64)) if kind == 0 else empty
                half = shard // n_shards
                now, model = shard, ShardModel(*counted, discount[half], low.value[half])
            if kind == 1:
                bits = model.bits(_grams(parts[0])).astype("<f4")
                yield _answers(chunk, 0, None, pack_parts(parts[0], bits.tobytes()), row_type)


def _send_texts(row_type, batches):
    pack = zstandard.ZstdCompressor(level=3).compress
    for _, chunk, rows, _ in _chunks(batches, True):
        sizes = np.array([len(r[0]) for r in rows], "<u8").tobytes()
        payload = len(rows).to_bytes(8, "little") + sizes + pack(b"".join([r[0] for r in rows]))
        yield _answers(chunk, 1, [r[1] for r in rows], payload, row_type)


def _score(row_type, batches):
    unpack = zstandard.ZstdDecompressor().decompress
    now, grams, bits, ready = None, [], [], False
    for batch in batches:
        for chunk, kind, rows, payload in zip(*[batch.column(c).to_pylist() for c in ("chunk", "kind", "rows", "payload")], strict=True):
            if chunk != now:
                now, grams, bits, ready = chunk, [], [], False
            if kind == 0:
                a, b = unpack_parts(payload)
                grams.append(_grams(a))
                bits.append(np.frombuffer(b, "<f4"))
                continue
            if not ready:
                grams = np.concatenate(grams) if grams else np.zeros(0, U8)
                bits = np.concatenate(bits) if bits else np.zeros(0, "<f4")
                order = np.argsort(grams, kind="stable")
                grams, bits, ready = grams[order], bits[order], True
            n = int.from_bytes(payload[:8], "little")
            sizes = np.frombuffer(payload, "<u8", n, 8).astype(np.int64)
            joined = unpack(payload[8 + 8 * n :]) if sizes.sum() else b""
            ends = np.cumsum(sizes)
            own, lengths = runs_of([joined[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)])
            codes, uniques = pd.factorize(own)
            at = np.minimum(np.searchsorted(grams, uniques), max(len(grams) - 1, 0))
            if not len(grams) or (grams[at] != uniques).any():
                raise RuntimeError("the documents changed between two reads: materialize them first")
            each = bits[at].astype(float)[codes]
            total = np.add.reduceat(each, np.cumsum(lengths) - lengths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, row_type), pa.array(sizes), pa.array(total / lengths)], ["row", "n_bytes", "bits"]
            )


def halved(docs: DataFrame) -> DataFrame:
    """``docs`` with the half that each row's id falls in."""
    return docs.withColumn("half", F.pmod(F.xxhash64("doc_id"), F.lit(HALVES)).cast("int"))


def train(trusted: DataFrame, n_shards: int) -> DataFrame:
    """``(shard, payload, stats)``: the counts of all texts of ``trusted (doc_id, raw)`` for both models, one row per shard of a model, written."""
    counted = halved(trusted).select("raw", "half").mapInArrow(partial(_count, n_shards), COUNTED)
    n = shuffle_partitions(trusted.sparkSession)
    return materialize(counted.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(_add, ADDED), "counts")


def perplexities(
    docs: DataFrame, trusted: DataFrame, doc_id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()
) -> DataFrame:
    """``(doc_id, *carry, text_hash, n_bytes, perplexity)`` of each row of ``docs`` under the model of ``trusted (doc_id, raw)``.

    Perplexity is per byte. Null and empty texts have none; rows with repeated or null ids are
    scored one by one, and all without an id fall in one half. ``carry`` names columns to pass
    on, ``text_hash`` is the XXH64 of the text. ``docs`` is read twice and must not change meanwhile.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    counts = train(trusted, n)
    # at most 2**16 rows of the lowest order and four per other order, for each model
    each = F.floor(F.col("shard") / n).cast("int").alias("half")
    stats = counts.select(each, F.explode("stats").alias("s")).groupBy("half", "s.kind", "s.key").agg(F.sum("s.n").alias("n")).toPandas()
    discount, low = [], []
    for half in range(HALVES):
        of = {k: dict(zip(g["key"], g["n"], strict=True)) for k, g in stats[stats["half"] == half].groupby("kind")}
        discount.append({k: discounts(*[int(of.get(k, {}).get(i, 0)) for i in (1, 2, 3, 4)]) for k in range(3, ORDER + 1)})
        pairs = of.get(2, {})
        low.append(lowest(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)))
    low = spark.sparkContext.broadcast(low)

    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    row = F.struct(F.col(doc_id).alias("doc_id"), *[F.col(c) for c in carry], F.xxhash64(body).alias("text_hash"))
    raw = halved(docs.select(F.col(doc_id).alias("doc_id"), row.alias("row"), body.alias("raw"))).drop("doc_id")
    raw = raw.withColumn("part", F.spark_partition_id().cast("long"))
    row_type = raw.schema["row"].dataType
    arrow_row, answered = to_arrow_type(row_type), ANSWERED.format(row_type.simpleString())
    model = counts.select("shard", F.lit(0).cast("tinyint").alias("kind"), F.lit(None).cast("long").alias("chunk"), "payload")
    # both readings take the same columns, so that a shuffle below them deals rows alike
    asked = model.unionByName(raw.mapInArrow(partial(_ask, n), JOINED))
    answers = (
        asked.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(partial(_answer, n, discount, low, arrow_row), answered)
    )
    sent = raw.mapInArrow(partial(_send_texts, arrow_row), answered)
    schema = T.StructType([raw.schema["row"], T.StructField("n_bytes", T.LongType()), T.StructField("bits", T.DoubleType())])
    scored = answers.unionByName(sent).repartition(n, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(partial(_score, arrow_row), schema)
    return scored.select("row.*", "n_bytes", F.when(F.col("n_bytes") > 0, F.round(F.pow(F.lit(2.0), "bits"), 6)).alias("perplexity"))


#: Steps in which quantiles are told apart.
STEPS = 1000


def quantile_of(n: int, share: float) -> float:
    """The quantile of ``n`` values that is the lower end of a confidence interval around ``share``, in ``STEPS``."""
    return max(math.ceil((share - ERRORS * math.sqrt(share * (1 - share) / n)) * STEPS), 1) / STEPS


def upper(calibrating: DataFrame, share: float = QUANTILE) -> DataFrame:
    """``(lang, upper, middle)`` of ``calibrating (lang, perplexity)``: the values at ``quantile_of`` the language's rows and in their middle.

    One partial aggregate holds the values at all quantiles that a size can ask for.
    """
    least, most = round(quantile_of(1, share) * STEPS), round(share * STEPS)
    at = F.ceil((share - ERRORS * F.sqrt(F.lit(share * (1 - share)) / F.count("*"))) * STEPS).cast("int")
    own = F.percentile_approx("perplexity", [k / STEPS for k in range(least, most + 1)], 100_000)
    place = F.greatest(F.least(at, F.lit(most)) - least + 1, F.lit(1))
    return calibrating.groupBy("lang").agg(F.element_at(own, place).alias("upper"), F.percentile_approx("perplexity", 0.5, 100_000).alias("middle"))


def thresholds(calibrating: DataFrame, share: float = QUANTILE) -> DataFrame:
    """``(lang, threshold)`` of ``calibrating (lang, perplexity)``, and a row whose ``lang`` is null and ``any`` true for all others."""
    own = materialize(upper(calibrating, share).select(F.col("lang").alias("of"), "upper", "middle"), "thresholds")
    if own.count() <= BROADCAST_LABELS:  # one language may hold most rows
        own = F.broadcast(own)
    relative = calibrating.join(own, F.col("lang").eqNullSafe(F.col("of"))).select(F.lit("").alias("lang"), (F.col("perplexity") / F.col("middle")).alias("perplexity"))
    spread = upper(relative, share).select(F.col("upper").alias("spread"))
    by_language = own.join(F.broadcast(spread), F.lit(True)).select(F.col("of").alias("lang"), F.greatest("upper", F.col("middle") * F.col("spread")).alias("threshold"), F.lit(False).alias("any"))
    pooled = upper(calibrating.withColumn("lang", F.lit("")), share)
    return by_language.unionByName(pooled.select(F.lit(None).cast("string").alias("lang"), F.col("upper").alias("threshold"), F.lit(True).alias("any")))


def quality(
    docs: DataFrame, labels: DataFrame, share: float = QUANTILE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``(doc_id, lang, text_hash, n_bytes, perplexity, threshold, kept)`` for every row of ``docs``.

    Trusted are the documents that ``labels (doc_id, quality, toxic)`` call good and not toxic;
    rows that repeat such an id are all trusted. Null and empty texts have no perplexity and
    are rejected; a text of white space only, or one of any length, is scored like any other.
    Null languages form one language. A language without trusted documents has the threshold
    of all of them; without any trusted document there is no threshold and every text stays.
    Rows that repeat an id or have none are judged one by one, each by its own text and
    language; an empty table gives no rows. Other columns are ignored, whatever their names.
    """
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("labelled")).distinct()
    good = materialize(good, "trusted", compact=True)
    if good.count() <= BROADCAST_LABELS:
        good = F.broadcast(good)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    fitting = texts(own).join(good, F.col("doc_id") == F.col("labelled"), "left_semi")
    scored = materialize(perplexities(own, fitting, carry=("lang",)), "perplexities", compact=True)
    calibrating = scored.where("perplexity IS NOT NULL").join(good, F.col("doc_id") == F.col("labelled"), "left_semi").select("lang", "perplexity")
    found = materialize(thresholds(calibrating, share), "thresholds")
    by_language = found.where("NOT any").select(F.col("lang").alias("of_lang"), F.col("threshold").alias("own"))
    if by_language.count() <= BROADCAST_LABELS:
        by_language = F.broadcast(by_language)
    pooled = found.where("any").select(F.col("threshold").alias("pooled"))
    known = scored.join(by_language, F.col("lang").eqNullSafe(F.col("of_lang")), "left").join(F.broadcast(pooled), F.lit(True), "left")
    known = known.withColumn("threshold", F.coalesce("own", "pooled"))
    kept = F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))
    return known.select("doc_id", "lang", "text_hash", "n_bytes", "perplexity", "threshold", kept.alias("kept"))


def kept_rows(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns.

    The verdict is a function of a row's half, text and language, so rows are found again by
    id, text and language: a row that repeats an id, or has none, goes by its own text.
    """
    stays = quality(docs, labels, doc_id=doc_id, text=text, lang=lang).where("kept").select("doc_id", "lang", "text_hash")
    return rows_with(docs, [F.col(doc_id), F.col(lang), F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary"))], stays)
