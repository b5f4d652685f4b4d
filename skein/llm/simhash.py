"""SimHash near-duplicates: exact links within a Hamming radius, and their components.

Distinct fingerprints are brought together by pigeonhole keys: of six blocks of bits, at least
three agree between fingerprints that differ in at most three bits, so each fingerprint is
dealt by the twenty choices of three blocks. Inside a key, pairs are pruned by pivot distance
tables: the Hamming distances of each fingerprint to ``PIVOTS`` reference fingerprints differ
by at most the radius between linked fingerprints (triangle inequality), so pairs whose
largest coordinate difference is greater are discarded and only survivors are compared: of
unrelated fingerprints that share a key, under one pair in a hundred survives. Over a whole
corpus distances to a pivot crowd around half the bits and cannot choose candidates without
looking at all pairs, which is why the keys come first.

A key gives a forest of links, never all pairs. Keys of more than ``CROWD`` fingerprints go
through a second level of keys on their other bits; there a key fixes 48 bits, so it holds at
most 65 536 fingerprints, whatever the input.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.token_counts import texts
from skein.operators.components import connected_components
from skein.runtime import materialize, shuffle_partitions

PIVOTS, CROWD = 32, 4096
#: Shingle hashes counted at a time.
SLAB = 1 << 18
SEED = 42


def _masks(bits: list[int]) -> list[int]:
    """The choices of three of six blocks of the given bit positions, as masks."""
    blocks = [sum(1 << b for b in part.tolist()) for part in np.array_split(np.asarray(bits), 6)]
    return [a | b | c for a, b, c in combinations(blocks, 3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = _masks(list(range(64)))
#: For each key of the first level, the keys on the bits it leaves open.
OPEN_MASKS = [_masks([b for b in range(64) if not mask >> b & 1]) for mask in MASKS]
REFERENCES = np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(PIVOTS)], np.uint64)


def shingle_hashes(raw: bytes, k: int) -> list[int]:
    """XXH64 of each run of ``k`` words, A-Z in lower case; fewer words are one run, no words are none."""
    words = raw.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip((ends - size).tolist(), ends[k - 1 :].tolist(), strict=False)]


def fingerprint(raw: bytes, k: int = 3) -> int:
    """The bits set in over half of the shingle hashes, repeats included."""
    hashes = shingle_hashes(raw, k)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), SLAB):
        part = np.array(hashes[a : a + SLAB], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def _fingerprints(k: int, batches):
    for batch in batches:
        found = [fingerprint(raw, k) for raw in batch.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"]
        )


def fingerprints(docs: DataFrame, k: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fp)``: each text's fingerprint as a signed long; null counts as empty, whose fingerprint is zero."""
    raw = texts(docs, doc_id, text)
    schema = T.StructType([raw.schema["doc_id"], T.StructField("fp", T.LongType())])
    return raw.mapInArrow(partial(_fingerprints, k), schema)


class PivotTable:
    """Hamming distances of fingerprints, each of one or more words, to reference fingerprints.

    ``asked`` and ``verified`` count the pairs that were given and those that were compared.
    """

    def __init__(self, fps: np.ndarray, references: np.ndarray = REFERENCES):
        self.fps = fps.reshape(len(fps), -1)
        self.at = np.empty((len(fps), len(references)), np.int16)
        for k, reference in enumerate(references.reshape(len(references), -1)):
            self.at[:, k] = np.bitwise_count(self.fps ^ reference).sum(axis=1, dtype=np.int16)
        self.asked = self.verified = 0

    def linked(self, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
        """Which of the pairs ``(i, j)`` are within the radius."""
        keep = np.ones(len(i), bool)
        for a in range(0, self.at.shape[1], 8):  # a few coordinates at a time, on what is left
            rows = np.flatnonzero(keep)
            far = np.abs(self.at[i[rows], a : a + 8] - self.at[j[rows], a : a + 8]).max(axis=1, initial=0) > radius
            keep[rows[far]] = False
        rows = np.flatnonzero(keep)
        self.asked += len(i)
        self.verified += len(rows)
        keep[rows] = np.bitwise_count(self.fps[i[rows]] ^ self.fps[j[rows]]).sum(axis=1, dtype=np.int16) <= radius
        return keep


def _forest(table: PivotTable, rows: np.ndarray, radius: int):
    """Links ``(first, member)`` of each component among ``rows``, by a search that visits each row once."""
    left = rows[np.argsort(table.at[rows, 0], kind="stable")]
    while len(left) > 1:
        root, left = left[:1], left[1:]
        front, reached = root, []
        while len(front) and len(left):
            one, front = front[0], front[1:]
            # rows are sorted by their distance to the first pivot: a window of it holds all linked rows
            key = table.at[left, 0].astype(np.int64)
            a, b = np.searchsorted(key, [table.at[one, 0] - radius, table.at[one, 0] + radius + 1])
            near = a + np.flatnonzero(table.linked(np.full(b - a, one), left[a:b], radius))
            if len(near):
                reached.append(left[near])
                front = np.concatenate([front, left[near]])
                left = np.delete(left, near)
        for members in reached:
            yield np.full(len(members), root[0]), members


def _links(radius: int, batches):
    """Links inside each run of equal keys; a run is bounded, so the last one of a batch can wait for the next."""

    def out(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def solve(columns):
        choice, key, fp, node = columns
        new = np.append(True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1]))
        sizes = np.diff(np.append(np.flatnonzero(new), len(node)))
        rows = np.flatnonzero(np.repeat(sizes, sizes) > 1)
        if not len(rows):
            return
        group = np.repeat(np.arange(len(sizes)), sizes)[rows]
        fp, node, sizes = fp[rows].view(np.uint64), node[rows], sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        table = PivotTable(fp)
        small = np.repeat(sizes, sizes) <= 8
        for step in range(1, 8):  # all pairs of keys with up to eight rows
            i = np.flatnonzero((group[:-step] == group[step:]) & small[:-step])
            i = i[table.linked(i, i + step, radius)]
            if len(i):
                yield out(node[i], node[i + step])
        for s in np.flatnonzero(sizes > 8).tolist():
            for a, b in _forest(table, np.arange(starts[s], starts[s] + sizes[s]), radius):
                yield out(node[a], node[b])

    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "key", "fp", "node")]
        if carry is not None:
            columns = [np.concatenate(pair) for pair in zip(carry, columns, strict=True)]
        last = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1])
        cut = len(last) - int(last.sum())
        if cut:
            yield from solve([c[:cut] for c in columns])
        carry = [c[cut:] for c in columns]
    if carry is not None:
        yield from solve(carry)


LINKS = "a long, b long"
#: Crowded keys are broadcast up to this many, after they are counted; more are joined by a shuffle.
BROADCAST_KEYS = 100_000


def _keyed(rows: DataFrame, masks: list[int], base: int = 0) -> DataFrame:
    keys = F.array(
        *[F.struct(F.lit(base + k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)]
    )
    return rows.select(F.explode(keys).alias("k"), "fp", "node").select("k.choice", "k.key", "fp", "node")


def fingerprint_links(nodes: DataFrame, radius: int = 3, crowd: int = CROWD) -> DataFrame:
    """Links ``(a, b)`` between nodes of distinct fingerprints, which connect all within the radius.

    ``nodes`` is ``(fp, node)``, one row per fingerprint. The radius is at most three.
    """
    if not 0 <= radius <= 3:
        raise ValueError("keys of three blocks in six hold a radius of at most three")
    n = shuffle_partitions(nodes.sparkSession)

    def solved(keyed: DataFrame) -> DataFrame:
        dealt = keyed.repartition(n, "choice", "key").sortWithinPartitions("choice", "key")
        return dealt.mapInArrow(partial(_links, radius), LINKS)

    keyed = _keyed(nodes, MASKS)
    calm, crowded = split_crowded(keyed, ["choice", "key"], crowd)
    links = solved(calm)
    if crowded is None:
        return links
    # a crowded key's rows meet again by their fixed bits and three of six blocks of the other bits
    finer = F.coalesce(*[F.when(F.col("choice") == k, F.array(*[F.lit(_signed(mask | m)) for m in OPEN_MASKS[k]])) for k, mask in enumerate(MASKS)])
    dealt = crowded.select("choice", "fp", "node", F.posexplode(finer).alias("m", "mask")).select(
        (F.col("choice") * 20 + F.col("m")).alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp", "node"
    )
    return links.unionByName(solved(dealt))


def split_crowded(keyed: DataFrame, key: list[str], crowd: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``crowd`` rows, and those of other keys, if there are any.

    Keys are counted by a partial aggregate, so no task sees all rows of a crowded one.
    """
    heavy = keyed.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > crowd).select(*key)
    heavy = materialize(heavy, "crowded", compact=True)
    found = heavy.limit(BROADCAST_KEYS + 1).count()
    if not found:
        return keyed, None
    side = F.broadcast(heavy) if found <= BROADCAST_KEYS else heavy
    return keyed.join(side, key, "left_anti"), keyed.join(side, key, "left_semi")


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints that differ in at most ``radius`` bits are linked; the component is the
    smallest document id that links reach. Equal fingerprints are one node, named by the
    fingerprint, so copies cost one row of a partial aggregate and rows that repeat an id each
    go by their own text. Null and empty texts have fingerprint zero, linked like any other;
    texts of any length are read whole. Rows without an id link like others and never name a
    component; a component of such rows only is null. Other columns are ignored, whatever
    their names; an empty table gives no rows.
    """
    found = materialize(fingerprints(docs, k, doc_id, text), "fingerprints", compact=True)
    nodes = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes", compact=True)
    parts = connected_components(fingerprint_links(nodes.select("fp", F.col("fp").alias("node")), radius), "a", "b")
    linked = parts.join(nodes, parts["node"] == nodes["fp"]).select("fp", "component", "least")
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    named = linked.join(smallest, "component").select("fp", "smallest")
    labelled = nodes.join(named, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return found.join(labelled, "fp", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
