import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import substring_dedup
from skein.llm.automaton import SuffixAutomaton, spans


def brute(docs, n):
    """Words kept of ``{id: words}``."""
    seen, gone = {}, {d: set() for d in docs}
    for d in sorted(docs):
        for s in range(len(docs[d]) - n + 1):
            key = tuple(docs[d][s : s + n])
            if key in seen:
                gone[d].update(range(s, s + n))
            else:
                seen[key] = (d, s)
    return {d: [w for i, w in enumerate(ws) if i not in gone[d]] for d, ws in docs.items()}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", max_size=14), max_size=6), st.text("abc", max_size=14))
def test_matching_statistics(texts, query):
    found = SuffixAutomaton(texts).statistics(query)
    for i, size in enumerate(found, 1):
        best = max((k for k in range(i + 1) if any(query[i - k : i] in t for t in texts)), default=0)
        assert size == best


def test_spans():
    assert spans([1, 2, 3, 4, 0, 1, 3], 3) == [(0, 4), (4, 7)]


def texts(rows):
    return {d: " ".join(w) for d, w in rows.items()}


def run(spark, rows, n=20, schema="doc_id long, text string", **more):
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, schema), n, **more)
    return {r.doc_id: r for r in found.collect()}


def corpus(seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(45)]
    docs = {}
    for d in range(60):
        words = [f"w{rng.randrange(40)}" if rng.random() < 0.6 else f"r{rng.random()}" for _ in range(rng.randrange(0, 90))]
        if rng.random() < 0.5:
            at = rng.randrange(len(words) + 1)
            a, b = sorted(rng.sample(range(46), 2))
            words[at:at] = passage[a:b]
        if docs and rng.random() < 0.2:
            words = list(docs[rng.choice(list(docs))])
            if words and rng.random() < 0.5:
                words[rng.randrange(len(words))] = "changed"
        docs[d] = words
    docs[60] = ["x"] * 25
    docs[61] = ["x", "y"] * 30
    docs[62] = ["y", "x"] * 15 + ["z"] * 22
    return docs


def test_against_brute_force(spark, monkeypatch):
    for seed, chunk, crowd in ((1, 300, 2048), (2, 1_500_000, 2048), (3, 200, 3), (4, 1_500_000, 2)):
        docs = corpus(seed)
        want = brute(docs, 20)
        for name, value in (("CHUNK", chunk), ("CROWD", crowd)):
            monkeypatch.setattr(substring_dedup, name, value)
        rows = list(texts(docs).items())
        random.Random(seed).shuffle(rows)
        got = {d: r.kept.decode().split() for d, r in run(spark, rows).items()}
        assert got == want


def hashed(words):
    return np.array(words, "<u8").view("u1").reshape(-1, 8)[:, : substring_dedup.WIDTH].tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.lists(st.integers(1, 3), min_size=4, max_size=18)), max_size=8))
def test_a_shard_finds_what_starts_earlier(passages):
    n, seen, want, starts = 4, {}, [], {}
    rows = []
    for doc, words in sorted(passages, key=lambda p: p[0]):
        start = starts.get(doc, 0)
        starts[doc] = start + len(words)
        rows.append((doc, start, words))
    shard = substring_dedup._Shard(n)
    for doc, start, words in rows:
        for k in range(len(words) - n + 1):
            if seen.setdefault(tuple(words[k : k + n]), (doc, start + k)) != (doc, start + k):
                want.append((doc, start + k))
    got = [(d, s + k) for d, s, words in rows for k in shard.repeats(d, s, hashed(words), True)]
    assert got == want
    assert shard.by_automaton + shard.by_equality == len(want)


def test_repeated_rows_of_a_document_are_no_earlier():
    shard, words = substring_dedup._Shard(3), [1, 2, 3, 4, 5]
    assert list(shard.repeats(7, 0, hashed(words))) == []
    assert list(shard.repeats(7, 0, hashed(words))) == []
    assert list(shard.repeats(7, 0, hashed([9, 2, 3, 4]))) == []  # the same place of another row of the document
    assert list(shard.repeats(7, 3, hashed([1, 2, 3]))) == [0]


class Maps:
    def __init__(self, *value):
        self.value = value


def settled(docs, crowd):
    """What the tasks and the shards settle of a corpus in one chunk, with the counts of how."""
    import pyarrow as pa

    full, none = np.full(substring_dedup.MAP_BITS // 8, 255, np.uint8), np.zeros(substring_dedup.MAP_BITS // 8, np.uint8)
    shards = []
    plain = substring_dedup._Shard

    class Counted(plain):
        def __init__(self, n):
            super().__init__(n)
            shards.append(self)

    substring_dedup._Shard = Counted
    try:
        rows = [(d, " ".join(w).encode()) for d, w in docs.items()]
        batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.binary())], ["doc_id", "raw"])
        sent = pa.Table.from_batches(substring_dedup._windows(20, Maps(full, full if crowd else none), iter([batch])))
        sent = sent.sort_by([("anchor", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        found = [tuple(r.values()) for out in substring_dedup._removed(20, iter(sent.to_batches(max_chunksize=37))) for r in out.to_pylist()]
    finally:
        substring_dedup._Shard = plain
    return {(d, s + k) for d, s, m in found for k in range(m)}, sum(s.by_automaton for s in shards), sum(s.by_equality for s in shards), sent


def test_windows_are_removed_by_automata():
    docs = corpus(6)
    seen, want = {}, set()
    for d in sorted(docs):
        for s in range(len(docs[d]) - 19):
            key = tuple(docs[d][s : s + 20])
            if seen.setdefault(key, (d, s)) != (d, s):
                want.add((d, s))
    found, by_automaton, by_equality, _ = settled(docs, False)
    assert found == want
    assert by_automaton > 0.2 * len(want)
    assert by_automaton + by_equality == len(want)
    assert settled(docs, True)[0] == want


def run_hash(words):
    own = np.array([xxhash.xxh64_intdigest(w.encode()) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        return int(substring_dedup._mixed(substring_dedup._runs(own, len(words)))[0])


def test_a_crowded_anchor_is_dealt_by_window():
    rng = random.Random(2)
    # eight words whose run has a small hash, so that it is the anchor of the windows around it
    hot = min(([f"h{rng.random()}" for _ in range(8)] for _ in range(2000)), key=run_hash)
    docs = {d: [f"r{rng.random()}" for _ in range(25)] + hot + [f"r{rng.random()}" for _ in range(25)] for d in range(300)}
    _, _, _, calm = settled(docs, False)
    _, _, _, dealt = settled(docs, True)
    largest = lambda t: max(np.unique(t.column("anchor").to_numpy(), return_counts=True)[1])
    assert largest(calm) > 30  # the windows around the hot run share it
    assert largest(dealt) == 1


def test_edge_cases(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, long), (5, long), (None, long), (7, "a " * 19), (8, "b" * 100_000)]
    found = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in found)
    assert got == [(-1, 30, 0), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 30, 0), (5, 30, 30), (5, 30, 30), (7, 19, 0), (8, 1, 0)]
    assert run(spark, []) == {}


def test_clashing_columns_are_carried(spark):
    rows = [(1, "a b", "x", 5, "k", "t"), (2, None, None, None, None, None)]
    schema = "doc_id long, text string, raw string, n int, kept string, anchor string"
    found = run(spark, rows, schema=schema, carry=("raw", "n", "kept", "anchor"))
    assert found[1].others.asDict() == {"raw": "x", "n": 5, "kept": "k", "anchor": "t"}
    assert found[2].others.kept is None


def test_bounded_reference(spark):
    reference = spark.createDataFrame([(" ".join(f"w{i}" for i in range(40)),), (None,)], "text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(f"w{i}" for i in range(5, 30)) + " b"), (2, "w1 w2"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in substring_dedup.reference_spans(docs, reference, 20).collect()] == [(1, 1, 25)]


def test_a_reference_of_many_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", 50)
    monkeypatch.setattr(substring_dedup, "AT_ONCE", 2)
    words = [f"w{i}" for i in range(400)]
    reference = spark.createDataFrame([(" ".join(words),)], "text string")
    docs = spark.createDataFrame([(1, " ".join(words[30:140])), (2, " ".join(words[::2]))], "doc_id long, text string")
    found = substring_dedup.reference_spans(docs, reference, 20).collect()
    assert {r.doc_id for r in found} == {1}
    covered = {k for r in found for k in range(r.start, r.start + r.n)}
    assert covered == set(range(110))


def test_few_files_and_freed_memory(spark):
    import subprocess
    import sys

    docs = spark.createDataFrame([(k, f"w{k} " * 30) for k in range(200)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        found = substring_dedup.substring_dedup(docs, 20)
        assert found.rdd.getNumPartitions() == 16 and found.count() == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # what a stage freed in small pieces does not stay with the worker
    code = """
import psutil
from skein.llm.substring_dedup import _trimmed
def rows():
    held = [bytes(5000) for _ in range(40_000)]
    kept = held[-1]
    yield kept
    del held
    yield kept
for kept in _trimmed(rows()):
    pass
assert psutil.Process().memory_info().rss < 180e6, psutil.Process().memory_info().rss
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60)
