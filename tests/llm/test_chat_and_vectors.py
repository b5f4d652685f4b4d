import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import chat_format as c
from skein.llm import posting_lists as p

TURNS = "conv_id long, turn long, role string, text string, formatted string"


def rows_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "clash") for r in rows], TURNS).repartition(parts)


def test_chats_read_back(spark):
    rows = [
        (1, 0, "user", "hi <|im_end|> <\\|x|> <\\\\|"), (1, 1, "assistant", "<|im_start|>assistant\nok"), (1, 2, "user", None), (1, 3, "assistant", "é😀"),
        (2, 5, None, "no role"), (2, None, "assistant", "first"), (3, 0, "assistant", ""), (None, 0, "user", "lost"), (4, 1, "a\nb\\<|", "t"), (4, 1, "assistant", "t"),
        (4, 1, "assistant", "t"), (5, 0, "assistant", "x" * 300_000),
    ]
    formatted = c.format_chats(rows_of(spark, rows))
    got = {r.conv_id: r for r in c.read_chats(formatted).collect()}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(by)
    raw = {r.conv_id: bytes(r.formatted).decode() for r in formatted.collect()}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == len(raw[conv])
        assert raw[conv].count("<|im_start|>") == len(turns)
    assert c.read_chats(c.format_chats(rows_of(spark, rows).limit(0))).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<", "|", "\\", "<|", "im_end|>", "n", "\n", "a"]), max_size=12).map("".join))
def test_escape_is_reversible(text):
    import re

    safe = re.sub(r"<(\\*)\|", r"<\\\1|", text)
    assert "<|" not in safe
    assert c.unescaped(safe) == text
    role = re.sub(r"<(\\*)\|", r"<\\\1|", text.replace("\\", "\\\\").replace("\n", "\\n"))
    assert "\n" not in role
    assert c._unescaped_role(role) == text


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def brute(x, ids, query, k):
    s = x @ x[list(ids).index(query)]
    order = sorted((-v, i) for v, i in zip(s.tolist(), ids, strict=True) if i != query)
    return [(i, -v) for v, i in order[:k]]


def test_neighbours_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32) * rng.uniform(0.2, 3, 300)[:, None].astype(np.float32)
    x[50:90] = x[50]  # a vector that many rows repeat
    rows = [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)]
    odd = [(900, None, 0, 0.0), (901, [0.0] * 8, 0, 0.0), (902, [float("nan")] * 8, 0, 0.0), (903, [float("inf")] + [1.0] * 7, 0, 0.0), (904, [None] * 8, 0, 0.0), (None, [1.0] * 8, 0, 0.0), (0, x[0].tolist(), 0, 0.0), (920, [], 0, 0.0)]
    table = vectors(spark, rows + odd)
    got = {}
    for r in p.nearest_neighbours(table, table.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {i for i in range(300) if i % 20 == 0}
    wide = x.astype(float)
    for query, found in got.items():
        found.sort()
        want = brute(wide, range(300), query, 20)
        assert [f[0] for f in found] == list(range(1, 21))
        assert [f[1] for f in found] == [w[0] for w in want]  # so few lists are all read
        assert np.allclose([f[2] for f in found], [w[1] for w in want], atol=1e-12)


def test_shorter_vectors_and_repeated_ids(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [4.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0, 1.0]), (20, [2.0]), (5, [0.5, 0.0, 0.0]), (5, [9.0, 0.0, 0.0])] + [(3, [1.0, 1.0, 1.0])] * 30
    table = vectors(spark, [(*r, 0, 0.0) for r in rows]).repartition(3)
    got = sorted(tuple(r) for r in p.nearest_neighbours(table, table.where("vec_id % 20 = 0"), 4).collect())
    assert got == [(0, 1, 5, 9.0), (0, 2, 3, 6.0), (0, 3, 1, 4.0), (0, 4, 2, 2.0), (20, 1, 5, 18.0), (20, 2, 1, 8.0), (20, 3, 0, 2.0), (20, 4, 3, 2.0)]


def test_every_query_has_all_its_rows(spark, monkeypatch):
    for name, value in (("TARGET", 3), ("PER_CENTROID", 1), ("LEAST_LISTS", 1), ("BREADTH", 1), ("BREADTH_SHARE", 1000), ("PRUNE", 1.0)):
        monkeypatch.setattr(p, name, value)
    rng = np.random.default_rng(2)
    table = vectors(spark, [(i, v.tolist(), 0, 0.0) for i, v in enumerate(rng.normal(size=(120, 6)).astype(np.float32))])
    counts = {r.query_id: r["count"] for r in p.nearest_neighbours(table, table.where("vec_id % 20 = 0"), 20).groupBy("query_id").count().collect()}
    assert counts == dict.fromkeys(range(0, 120, 20), 20)


def test_few_and_no_candidates(spark):
    table = vectors(spark, [(0, [1.0, 0.0], 0, 0.0), (20, [0.5, 0.5], 0, 0.0), (3, [0.0, 1.0], 0, 0.0)])
    got = sorted(tuple(r) for r in p.nearest_neighbours(table, table.where("vec_id % 20 = 0"), 20).collect())
    assert got == [(0, 1, 20, 0.5), (0, 2, 3, 0.0), (20, 1, 0, 0.5), (20, 2, 3, 0.5)]
    assert p.nearest_neighbours(table.limit(0), table.limit(0), 20).collect() == []


def test_recall(spark, sf):
    table = spark.read.parquet(f"{sf}/../sf0.1/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    got = {}
    for r in p.nearest_neighbours(table, table.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[i] & {j for j, _ in brute(x, ids, i, 20)}) / 20 for i in ids if i % 20 == 0]
    assert np.mean(hits) >= 0.9


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(p, "LIST", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)).astype(np.float32)
    table = vectors(spark, [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)])
    got = {}
    for r in p.nearest_neighbours(table, table.where("vec_id % 20 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    wide = x.astype(float)
    assert {q: [v for _, v in sorted(f)] for q, f in got.items()} == {i: [w for w, _ in brute(wide, range(200), i, 5)] for i in range(0, 200, 20)}


def test_graph_search_finds_what_all_distances_find():
    rng = np.random.default_rng(3)
    centroids = rng.normal(size=(600, 16))
    links = p.graph(centroids)
    hits = 0
    for query in rng.normal(size=(40, 16)):
        found, far = p.search(query, centroids, links, 64)
        assert (np.diff(far) >= 0).all()
        best = np.argsort(np.linalg.norm(centroids - query, axis=1))[:20]
        hits += len(set(found[:20].tolist()) & set(best.tolist()))
    assert hits / 800 >= 0.95
