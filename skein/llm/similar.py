"""Near-duplicates by word shingles: links at an exact Jaccard similarity, and their components.

Texts are told apart by their sets of distinct shingle hashes; equal sets are one node. Texts
that may be similar are brought together by their ``KEYS`` least shingle hashes: two texts of
similarity ``s`` share none of them with probability ``(1 - s) ** KEYS`` at most, 6 in 100 000
at 0.8. Among texts that share a key, wide SimHash fingerprints of the distinct shingles leave
out what is far from similar: the radius is six standard deviations of the estimate beyond the
distance of similarity ``s``, so that what is lost is less than by the keys, also for sets of a
few shingles, where ties of bits make distances larger.

Pairs of a key are pruned by a pivot distance table, that of ``simhash``. At this radius random
reference fingerprints discard nothing, since all distances to them are near half the bits; the
references are ``PIVOTS`` fingerprints of the key itself, each the farthest from those before:
a text is near the references of its own group of copies and far from those of others, so pairs
of different groups differ by more than the radius in some coordinate and are not compared.

Fingerprints only choose candidates. What they leave of a key is a group whose texts are read
again, and two texts are linked if the Jaccard similarity of their shingle sets is ``s`` or
more. A group gives a forest of links, never all pairs.

Keys that over ``CROWD`` texts share are found by a partial aggregate and their rows dealt by
that key and each other of their ``DEALT`` least hashes instead; two texts share fewer than two
of these with a probability of 2 in 100 000 at 0.8, less than none of ``KEYS``. What is then still crowded is dealt into blocks, so
that any two of its rows meet in a part of some ``CROWD`` rows, and groups of over ``HELD``
hashes likewise: no link depends on the size of a group, but the rows dealt grow with its
square over the bound.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.simhash import BROADCAST_KEYS, SEED, SLAB, PivotTable, shingle_hashes, split_crowded
from skein.llm.token_counts import texts
from skein.operators.components import connected_components
from skein.runtime import materialize, rows_with, shuffle_partitions

KEYS, DEALT, CROWD, WORDS = 6, 9, 2048, 4
#: Reference fingerprints of a key.
PIVOTS = 8
#: Shingle hashes that a group's texts have together before the group is dealt in parts.
HELD = 1 << 22
BITS = 64 * WORDS
#: Odd multipliers that spread one hash over the words of a fingerprint.
SPREAD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def radius_of(similarity: float) -> int:
    """Bits that fingerprints of texts of this Jaccard similarity differ in, plus six standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(BITS * share + 6 * math.sqrt(BITS * share * (1 - share)))


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text in ascending order."""
    return np.unique(np.array(shingle_hashes(raw, k), np.uint64))


def node_of(hashes: np.ndarray) -> int:
    """The name of a shingle set, equal for equal sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def sketch(raw: bytes, k: int) -> tuple[int, int, bytes, list[int]]:
    """The name and size of a text's shingle set, its wide fingerprint and its least hashes."""
    hashes = shingle_set(raw, k)
    ones = np.zeros(BITS, np.int64)
    with np.errstate(over="ignore"):
        for a in range(0, len(hashes), SLAB // 4):
            wide = hashes[a : a + SLAB // 4, None] * SPREAD[None, :]
            wide = (wide ^ (wide >> np.uint64(31))) * SPREAD[1]
            wide ^= wide >> np.uint64(33)
            bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1)
            ones += bits.sum(axis=0, dtype=np.uint32)
    fp = np.packbits(ones * 2 > len(hashes)).tobytes()
    return node_of(hashes), len(hashes), fp, hashes[:DEALT].view(np.int64).tolist()


SKETCHES = "text_hash long, node long, size long, fp binary, keys array<long>"


def _sketches(k: int, batches):
    for batch in batches:
        found = [sketch(raw, k) for raw in batch.column("raw").to_pylist()]
        node, size, fp, keys = zip(*found, strict=True) if found else ((), (), (), ())
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), *[pa.array(c, t) for c, t in zip((node, size, fp, keys), kinds, strict=True)]],
            ["doc_id", "text_hash", "node", "size", "fp", "keys"],
        )


def _sets(k: int, batches):
    for batch in batches:
        sets = [shingle_set(raw, k) for raw in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([node_of(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "hashes"]
        )


def _distance(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int32)


def references(fps: np.ndarray) -> np.ndarray:
    """``PIVOTS`` of these fingerprints, each the farthest from those chosen before."""
    chosen, far = [0], _distance(fps[0], fps)
    while len(chosen) < PIVOTS and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distance(fps[chosen[-1]], fps))
    return fps[chosen]


def forest(fps: np.ndarray, radius: int, table: PivotTable | None = None):
    """Links ``(first, member)`` of the components of these fingerprints; each row is searched from once."""
    if len(fps) == 2:
        if _distance(fps[0], fps[1:])[0] <= radius:
            yield 0, 1
        return
    table = table or PivotTable(fps, references(fps))
    left = np.arange(len(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            near = table.linked(np.full(len(left), front.pop()), left, radius)
            for member in left[near].tolist():
                front.append(member)
                yield root, member
            left = left[~near]


def exact_forest(sets: list[np.ndarray], similarity: float):
    """Links of the components of these sorted shingle sets, by their Jaccard similarity; each is searched from once."""
    sizes = np.array([len(x) for x in sets])
    left = np.arange(len(sets))
    while len(left) > 1:
        root, left = left[0], left[1:]
        front = [root]
        while front and len(left):
            at = front.pop()
            one, n = sets[at], sizes[at]
            # sets of very different sizes are not similar
            may = np.flatnonzero(np.minimum(sizes[left], n) >= similarity * np.maximum(sizes[left], n) - 1e-9)
            if not n or not len(may):
                continue
            many = np.concatenate([sets[i] for i in left[may]])
            hits = one[np.minimum(np.searchsorted(one, many), n - 1)] == many
            starts = np.cumsum(sizes[left[may]]) - sizes[left[may]]
            both = np.add.reduceat(hits, starts, dtype=np.int64)
            near = may[both >= similarity * (n + sizes[left[may]] - both) - 1e-9]
            for member in left[near].tolist():
                front.append(member)
                yield root, member
            left = np.delete(left, near)


LINKS = "a long, b long, g long"


def _runs(batches, *columns):
    """The rows of each run of equal values in the first column, as lists of the others."""
    now, rows = None, [[] for _ in columns[1:]]
    for batch in batches:
        for key, *values in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
            if key != now:
                if rows[0]:
                    yield rows
                now, rows = key, [[] for _ in values]
            for column, value in zip(rows, values, strict=True):
                column.append(value)
    if rows[0]:
        yield rows


def _batches(links):
    """Record batches of links ``(a, b, g)``."""
    held = []
    for link in links:
        held.append(link)
        if len(held) >= 50_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], ["a", "b", "g"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held, strict=True)], ["a", "b", "g"])


def _links(radius: int, batches):
    """Links between fingerprints inside runs of equal keys; ``g`` names a component by its members, whatever the key."""

    def links():
        for nodes, fps in _runs(batches, "key", "node", "fp"):
            table = np.frombuffer(b"".join(fps), np.uint64).reshape(-1, WORDS)
            groups = {}
            for i, j in forest(table, radius):
                groups.setdefault(i, []).append(j)
            for i, members in groups.items():
                g = node_of(np.sort(np.array([nodes[i], *[nodes[j] for j in members]], np.int64)))
                yield from ((nodes[i], nodes[j], g) for j in members)

    yield from _batches(links())


def _verified(similarity: float, batches):
    """Links between shingle sets inside runs of equal groups."""

    def links():
        for nodes, raw in _runs(batches, "g", "node", "hashes"):
            for i, j in exact_forest([np.frombuffer(x, np.uint64) for x in raw], similarity):
                yield nodes[i], nodes[j], 0

    yield from _batches(links())


def in_blocks(rows: DataFrame, key: str, weight: Column, most: int) -> DataFrame:
    """``rows`` of ``(key, node)``, where those of keys that weigh over ``most`` are dealt into blocks.

    The new key is a pair of blocks of half that weight each, so any two rows of a key meet.
    """
    heavy = rows.groupBy(key).agg(F.sum(weight).alias("w")).where(F.col("w") > most)
    heavy = materialize(heavy.select(key, F.ceil(F.col("w") * 2 / most).cast("long").alias("blocks")), "heavy", compact=True)
    found = heavy.limit(BROADCAST_KEYS + 1).count()
    if not found:
        return rows
    side = F.broadcast(heavy) if found <= BROADCAST_KEYS else heavy
    others = [c for c in rows.columns if c != key]
    dealt = rows.join(side, key).withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select(F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other")).alias(key), *others)
    return rows.join(side, key, "left_anti").select(key, *others).unionByName(dealt)


def similar_groups(
    docs: DataFrame, k: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(doc_id, text_hash, component_id)``: the smallest id that links between similar texts reach, for every row of ``docs``.

    ``text_hash`` is the XXH64 of the text, by which rows that share an id are told apart.

    A-Z is put in lower case, words are cut at ASCII white space; fewer than ``k`` words are one
    shingle. Null and empty texts equal each other, and texts of any length are read whole. Rows
    without an id join groups and never name one; a group of such rows only has a null id. Rows
    that repeat an id each go by their own text. Other columns are ignored; an empty table gives
    no rows.
    """
    n = shuffle_partitions(docs.sparkSession)
    raw = texts(docs, doc_id, text).withColumn("text_hash", F.xxhash64("raw"))
    schema = T.StructType([raw.schema["doc_id"], *T.StructType.fromDDL(SKETCHES).fields])
    found = materialize(raw.mapInArrow(partial(_sketches, k), schema), "sketches", compact=True)
    first = {c: F.min(c).alias(c) for c in ("doc_id", "text_hash", "size", "fp", "keys")}
    nodes = materialize(found.groupBy("node").agg(*first.values()), "nodes", compact=True)
    radius = radius_of(similarity)

    def solved(keyed: DataFrame) -> DataFrame:
        return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(partial(_links, radius), LINKS)

    calm, crowded = split_crowded(nodes.select(F.explode(F.slice("keys", 1, KEYS)).alias("key"), "node", "fp", "keys"), ["key"], CROWD)
    near = solved(calm)
    if crowded is not None:
        others = crowded.select(F.col("key").alias("one"), "node", "fp", F.explode("keys").alias("two")).where("one <> two")
        finer = others.select(F.xxhash64(F.least("one", "two"), F.greatest("one", "two")).alias("key"), "node", "fp")
        finer = materialize(finer.dropDuplicates(["key", "node"]), "finer")
        near = near.unionByName(solved(in_blocks(finer, "key", F.lit(1), CROWD)))
    members = near.select("g", F.explode(F.array("a", "b")).alias("node")).distinct()
    members = materialize(members.join(nodes.select("node", "size", "text_hash"), "node"), "candidates", compact=True)
    wanted = members.select("text_hash").distinct()
    sets = raw.select("text_hash", "raw").join(wanted, "text_hash", "left_semi").dropDuplicates(["text_hash"])
    sets = materialize(sets.mapInArrow(partial(_sets, k), "node long, hashes binary"), "sets")
    parts = in_blocks(members.select("g", "node", "size"), "g", F.col("size"), HELD).select("g", "node")
    groups = parts.join(sets, "node").repartition(n, "g").sortWithinPartitions("g")
    parts = connected_components(groups.mapInArrow(partial(_verified, similarity), LINKS), "a", "b")
    linked = materialize(parts.join(nodes.select("node", "doc_id"), "node"), "linked", compact=True)
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = linked.select("node", "component").join(least, "component").select("node", "component_id")
    labelled = nodes.select("node", "doc_id").join(named, "node", "left").select("node", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.select("doc_id", "text_hash", "node").join(labelled, "node", "left").select("doc_id", "text_hash", "component_id")


def near_dedup(docs: DataFrame, k: int = 5, similarity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names: of each group the smallest id.

    Rows without an id stay only beside none with one. Rows are found again by id and text, so
    one that repeats an id stays or goes with its own text, and repeats of a row that stays stay.
    """
    stays = similar_groups(docs, k, similarity, doc_id, text).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    own = F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    return rows_with(docs, [F.col(doc_id), own], stays.select("doc_id", "text_hash"))
