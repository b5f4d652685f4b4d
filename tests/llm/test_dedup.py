import hashlib
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from skein.llm import exact_dedup, similar, simhash
from skein.operators.components import connected_components

SCHEMA = "doc_id long, text string, keep_id long, fp string"
LONG = " ".join(f"word{i % 97}x{i}" for i in range(20_000))
ROWS = [
    (5, "a  b", 0, "x"), (2, "a\n\tb", 0, "x"), (9, "a b", 0, None), (3, None, 0, "x"), (4, "", 0, "x"), (None, "a b", 0, "x"),
    (7, "A b", 0, "x"), (2, "a\n\tb", 0, "x"), (8, LONG, 1, "y"), (1, LONG, 1, "y"), (None, "only null", 1, "z"), (12, " ", 1, "z"),
]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(normal(t), []).append(d)
    out = []
    for d, t, *_ in rows:
        own = groups[normal(t)]
        keep = min((x for x in own if x is not None), default=None)
        out.append((d, keep, len(own), d == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    for least in (64, 3):  # the broadcast side decides groups of three and more
        monkeypatch.setattr(exact_dedup, "LEAST_COPIES", least)
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()]
        assert sorted(got, key=repr) == expected(ROWS)
    assert exact_dedup.exact_groups(docs.limit(0)).collect() == []


def test_exact_dedup_keeps_columns(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    # the two rows of document 2 are the same document; the group of null ids keeps its row
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 2, 3, 7, 12]
    again = spark.createDataFrame([(1, "a", 0, ""), (1, "b", 0, ""), (0, "b", 0, "")], SCHEMA)
    assert sorted((r.doc_id, r.text) for r in exact_dedup.exact_dedup(again).collect()) == [(0, "b"), (1, "a")]


def test_frequent_digests_come_through_the_tree(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "WIDTH", 2)
    rows = spark.range(0, 3000, 1, 23).selectExpr("if(id % 3 = 0, 'hot', if(id % 10 = 1, 'warm', cast(id AS string))) AS text_sha256")
    found = {r.hash for r in exact_dedup.frequent_digests(rows).collect()}
    want = {r.h for r in spark.sql("SELECT xxhash64(x) AS h FROM VALUES ('hot'), ('warm') AS t(x)").collect()}
    assert want <= found
    assert len(found) <= exact_dedup.CANDIDATES
    assert exact_dedup.frequent_digests(rows.limit(0)).collect() == []


def test_rows_keep_columns_of_any_name(spark):
    schema = "doc_id long, text string, row string, own0 int, its0 int, `a.b` string, text_sha256 string, hash int"
    docs = spark.createDataFrame([(1, "a", "r", 1, 2, "d", "s", 3), (2, "a", "r", 1, 2, "d", "s", 3), (2, "b", None, None, None, None, None, None)], schema)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, "a"), (2, "b")]


def test_exact_dedup_uses_no_python(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_fingerprint(text, k):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    runs = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    ones = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(runs))


def components(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(300)}" for _ in range(120)) for _ in range(12)]
    rows = []
    for i in range(90):
        words = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2, 30])):
            words[rng.randrange(len(words))] = f"n{rng.random()}"
        rows.append((i, " ".join(words)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "One two"), (104, "one  TWO"), (105, "É x y z"), (106, "é x y z"), (107, LONG), (107, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    fps = {d: brute_fingerprint(t, 3) for d, t in rows}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    want = components(links, fps)
    got = simhash.near_duplicates(docs, 3, 3).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{fps[d]:016x}", want[d]) for d in fps}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_null_ids_never_name_a_component(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "x y z q")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, 5), (5, 5), (None, None)}


def test_crowded_keys(spark):
    rng = np.random.default_rng(1)
    points = set()
    for base in rng.integers(0, 2**63, 6).tolist():
        for _ in range(120):
            x = base
            for b in rng.integers(0, 64, rng.integers(1, 7)).tolist():
                x ^= 1 << b
            points.add(x)
    points = sorted(points)
    nodes = spark.createDataFrame([(int(np.uint64(x).view(np.int64)), k) for k, x in enumerate(points)], "fp long, node long")
    links = [(a, b) for a in range(len(points)) for b in range(a + 1, len(points)) if (points[a] ^ points[b]).bit_count() <= 3]
    want = components(links, range(len(points)))
    for crowd in (4096, 9):
        found = {r.node: r.component for r in connected_components(simhash.fingerprint_links(nodes, 3, crowd), "a", "b").collect()}
        assert {n: found.get(n, n) for n in want} == want


def test_rows_that_repeat_an_id_go_by_their_own_text(spark):
    a = [f"a{i}" for i in range(60)]
    b = [f"b{i}" for i in range(60)]
    rows = [(3, " ".join(a)), (5, " ".join(a + ["x"])), (5, " ".join(b)), (9, "something else"), (None, " ".join(b + ["x"])), (None, "lost")]
    docs = spark.createDataFrame([(*r, "y", 1, "z") for r in rows], "doc_id long, text string, node string, fp int, own0 string")
    kept = similar.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == sorted([(-1, "lost"), (3, rows[0][1]), (5, rows[2][1]), (9, "something else")])
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fps = [f"{brute_fingerprint(t, 3):016x}" for _, t in rows]
    assert len({fps[0], fps[2], fps[3], fps[5]}) == 4
    assert got[5, fps[2]] == 5 and got[3, fps[0]] == 3 and got[None, fps[5]] is None


def test_a_row_without_id_links_others(spark):
    one, two, three = 0b0, 0b111, 0b111111
    nodes = spark.createDataFrame([(one, one), (two, two), (three, three)], "fp long, node long")
    assert {r.component for r in connected_components(simhash.fingerprint_links(nodes, 3), "a", "b").collect()} == {0}


def unrelated(n, words, rng):
    return rng.integers(0, 2**63, (n, words)).astype(np.uint64) * np.uint64(2) + rng.integers(0, 2, (n, words)).astype(np.uint64)


def test_pivots_discard_most_unrelated_pairs_of_a_key():
    rng = np.random.default_rng(5)
    fps = unrelated(400, 1, rng)[:, 0] & ~np.uint64(simhash.MASKS[3])  # they share a key, hence half the bits
    table = simhash.PivotTable(fps)
    i, j = np.triu_indices(400, 1)
    assert not table.linked(i, j, 3).any()
    assert table.verified < 0.01 * table.asked


def test_references_of_a_key_discard_pairs_of_other_groups():
    rng = np.random.default_rng(6)
    fps = np.repeat(unrelated(6, similar.WORDS, rng), 50, axis=0)
    for row in fps:  # copies differ in some 16 of 256 bits
        for bit in rng.integers(0, 256, 8).tolist():
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    radius = similar.radius_of(0.8)
    table = simhash.PivotTable(fps, similar.references(fps))
    i, j = np.triu_indices(300, 1)
    near = table.linked(i, j, radius)
    assert (near == (i // 50 == j // 50)).all()
    assert table.verified == near.sum()  # no pair of two groups is compared
    plain = simhash.PivotTable(fps, unrelated(8, similar.WORDS, rng))
    plain.linked(i, j, radius)
    assert plain.verified == plain.asked  # random references discard nothing at this radius
    links = list(similar.forest(fps, radius))
    assert len(links) == 294 and set(components(links, range(300)).values()) == {0, 50, 100, 150, 200, 250}


def test_pivots_discard_no_linked_pair():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = a.copy()
    for _ in range(3):
        b ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
    table = simhash.PivotTable(np.concatenate([a, b]))
    assert table.linked(np.arange(500), np.arange(500, 1000), 3).all()


def test_similar_groups(spark, monkeypatch):
    rng = random.Random(7)
    base = [[f"w{rng.random()}" for _ in range(150)] for _ in range(10)]
    rows = []
    for i in range(60):
        words = list(rng.choice(base))
        if i % 2:
            words[rng.randrange(150)] = "changed"
        rows.append((i, " ".join(words)))
    rows += [(200, None), (201, ""), (202, "only three words"), (203, "ONLY three  words"), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def shingles(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {d: shingles(t) for d, t in rows if d is not None}
    links = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(links, sets)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got.pop(None) == want[0]
    assert got == want
    kept = [r.doc_id for r in similar.near_dedup(docs).collect()]
    assert sorted(kept) == sorted(set(want.values()))
    assert similar.similar_groups(docs.limit(0)).collect() == []


def test_crowded_similar_keys_stream_past_leaders():
    rng = np.random.default_rng(4)
    one = rng.integers(0, 2**63, similar.WORDS).astype(np.uint64)
    far = rng.integers(0, 2**63, similar.WORDS).astype(np.uint64)
    late = rng.integers(0, 2**63, similar.WORDS).astype(np.uint64)
    import pyarrow as pa

    n = similar.CROWD + 50
    fps = [(late if i > n - 9 else one if i % 3 else far).tobytes() for i in range(n)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array(range(n)), pa.array(fps, pa.binary())], ["key", "node", "fp"])
    links = [(a, b) for out in similar._links(10, iter([batch])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    want = components(links, range(n))
    assert set(want.values()) == {0, 1, n - 8}


def test_crowded_similar_keys_are_dealt_anew(spark, monkeypatch):
    rng = random.Random(11)
    shared = [f"s{rng.random()}" for _ in range(30)]
    rows = []
    for i in range(40):
        base = [f"w{i // 4}x{k}" for k in range(150)]
        base[10:40] = shared
        if i % 4:
            base[rng.randrange(60, 150)] = "changed"
        rows.append((i, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: i - i % 4 for i in range(40)}
    for crowd in (4096, 6):
        monkeypatch.setattr(similar, "CROWD", crowd)
        assert {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()} == want


def test_similar_groups_are_exact_at_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):  # one change in the middle of n words takes five shingles away on either side
        for n in (44, 47, 48, 49, 52, 90, 95):
            words = [f"w{rng.random()}" for _ in range(n)]
            rows.append((len(rows), " ".join(words)))
            for at in [20] if n < 60 else [20, 60]:
                words[at] = "changed"
            rows.append((len(rows), " ".join(words)))
    rows.append((len(rows), "a b c d e f " * 30))  # repeats weigh nothing
    rows.append((len(rows), "a b c d e f " * 90))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    links = [(d, d + 1) for d in range(0, len(rows), 2) if len(sets[d] & sets[d + 1]) >= 0.8 * len(sets[d] | sets[d + 1])]
    assert 0 < len(links) < len(rows) // 2
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got == components(links, sets)


def test_blocks_bring_all_pairs_together(spark):
    rows = [(1, i) for i in range(200)] + [(2, i) for i in range(200, 230)]
    dealt = similar.in_blocks(spark.createDataFrame(rows, "key long, node long"), "key", F.lit(1), 32).collect()
    parts = {}
    for r in dealt:
        parts.setdefault(r.key, set()).add(r.node)
    assert {(a, b) for p in parts.values() for a in p for b in p} == {(a, b) for k, a in rows for j, b in rows if k == j}
    assert max(map(len, parts.values())) < 64
    assert len(dealt) == 200 * 13 + 30


def test_late_rows_of_a_crowded_run_meet_members():
    import pyarrow as pa

    def bits(n):
        return np.packbits([1] * n + [0] * (similar.BITS - n)).tobytes()

    n = similar.CROWD + 2  # leader, members 8 bits away, and a late row 8 bits from a member only
    fps = [bits(0)] + [bits(8)] * (n - 2) + [bits(16)]
    batch = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array(range(n)), pa.array(fps, pa.binary())], ["key", "node", "fp"])
    links = [(a, b) for out in similar._links(10, iter([batch])) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    assert set(components(links, range(n)).values()) == {0}


def test_long_chains_in_crowded_keys_hold(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{rng.random()}" for _ in range(400)]
    # neighbours are similar, ends of the chain are not, and all share the least hashes of what stays
    rows = [(i, " ".join(words[:300] + [f"c{j}" if j < i * 8 else w for j, w in enumerate(words[300:])])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similar, "CROWD", 4)
    monkeypatch.setattr(similar, "HELD", 1500)
    assert {r.component_id for r in similar.similar_groups(docs).collect()} == {0}


def test_pairs_that_share_one_crowded_least_hash(spark, monkeypatch):
    rng = random.Random(9)

    def passage():
        return [f"p{rng.random()}" for _ in range(5)]

    hot = min((passage() for _ in range(5000)), key=lambda w: similar.shingle_set(" ".join(w).encode(), 5)[0])
    for _ in range(60_000):  # a pair at 0.8 with nothing but the hot passage in both least six
        one = [f"w{rng.random()}" for _ in range(125)] + hot
        two = list(one)
        two[3], two[20], two[50] = (f"c{rng.random()}" for _ in range(3))
        a, b = (similar.shingle_set(" ".join(w).encode(), 5) for w in (one, two))
        if len(set(a[:6].tolist()) & set(b[:6].tolist())) == 1 < len(set(a[:9].tolist()) & set(b[:9].tolist())):
            break
    else:
        raise AssertionError("no such pair")
    rows = [(0, " ".join(one)), (1, " ".join(two))]
    rows += [(i, " ".join([f"f{rng.random()}" for _ in range(125)] + hot)) for i in range(2, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(similar, "CROWD", 3)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(docs).collect()}
    assert got == {i: max(i, 0) if i != 1 else 0 for i in range(9)}
