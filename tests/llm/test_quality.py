import math
import random
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from skein.llm import ngram_quality as q

SCHEMA = "doc_id long, text string, lang string, bits double"


def brute_model(texts):
    """Interpolated modified Kneser-Ney over bytes, by dictionaries."""
    n = q.ORDER
    counts = {n: Counter()}
    for t in texts:
        raw = b"\n" * (n - 1) + t + b"\n"
        counts[n].update(raw[i : i + n] for i in range(len(raw) - n + 1))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def tables(k):
        c = counts[k]
        by = Counter(c.values())
        d = q.discounts(by[1], by[2], by[3], by[4])
        total, left = defaultdict(float), defaultdict(float)
        for g, x in c.items():
            total[g[:-1]] += x
            left[g[:-1]] += min(d[min(x, 3)], x)
        return c, d, total, left

    levels = {k: tables(k) for k in counts}

    def probability(gram):
        p = 1 / 256
        for k in range(1, n + 1):
            c, d, total, left = levels[k]
            own = gram[n - k :]
            context = own[:-1]
            if context in total:
                x = c.get(own, 0)
                p = (x - min(d[min(x, 3)], x)) / total[context] + left[context] / total[context] * p
            if k == 2:
                p = 0.999999 * p + 0.000001 / 256
        return p

    def perplexity(t):
        raw = b"\n" * (n - 1) + t + b"\n"
        bits = [-math.log2(probability(raw[i : i + n])) for i in range(len(raw) - n + 1)]
        return 2 ** (sum(bits) / len(bits))

    return perplexity


TEXTS = ["the cat sat on the mat", "the dog sat on the log", "a cat and a dog", "über den Fluß", "the\ncat  ran", "on and on and on"] * 3


def halves(spark, ids):
    rows = q.halved(spark.createDataFrame([(i,) for i in ids], "doc_id long")).collect()
    return {r.doc_id: r.half for r in rows}


def brute_quality(spark, rows, labels):
    """``(id, text, lang) -> (perplexity, threshold, kept)`` and whether there is any trusted document."""
    good = {d for d, quality, toxic in labels if quality == 1 and not toxic and d is not None}
    half = halves(spark, {d for d, *_ in rows})
    models = [brute_model([(t or "").encode() for d, t, _ in rows if d in good and half[d] != h]) for h in range(2)]
    found = {(d, t, lang): models[half[d]](t.encode()) if t else None for d, t, lang in rows}
    by = defaultdict(list)
    for d, t, lang in rows:
        if d in good and t:
            by[lang].append(found[d, t, lang])

    def cut(values):
        values = sorted(values)
        return values[max(math.ceil(q.quantile_of(len(values), q.QUANTILE) * len(values)) - 1, 0)]

    pooled = cut([x for own in by.values() for x in own]) if by else None
    middle = {lang: sorted(own)[math.ceil(len(own) / 2) - 1] for lang, own in by.items()}
    spread = cut([x / middle[lang] for lang, own in by.items() for x in own]) if by else None
    out = {}
    for key, x in found.items():
        own = by.get(key[2])
        at = max(cut(own), middle[key[2]] * spread) if own else pooled
        out[key] = (x, at, x is not None and (at is None or x <= at + 1e-6))
    return out


def test_perplexity_against_brute_force(spark):
    trusted = [(i, t.encode()) for i, t in enumerate(TEXTS)]
    rows = [(1, "the cat ran on"), (2, "ZZZ!! QQQ!!"), (3, None), (4, ""), (None, "a dog"), (2, " \n"), (9, "the cat sat on the mat " * 400), (10, "日本")]
    docs = spark.createDataFrame([(d, t, "en", 0.0) for d, t in rows], SCHEMA).repartition(3)
    got = q.perplexities(docs, spark.createDataFrame(trusted, "doc_id long, raw binary"), carry=("lang",)).collect()
    half = halves(spark, [d for d, _ in rows] + [d for d, _ in trusted])
    models = [brute_model([t for d, t in trusted if half[d] != h]) for h in range(2)]
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_bytes): r.perplexity for r in got}
    for d, t in rows:
        raw = (t or "").encode()
        want = models[half[d]](raw) if raw else None
        found = by[(d, len(raw))]
        assert found is None if want is None else abs(found - want) < 1e-4 * want


def test_thresholds_and_verdicts_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [["haus", "der", "wald", "und", "ein"], ["the", "cat", "and", "house", "a"]]
    rows, labels = [], []
    for i in range(160):
        lang = ["de", "en", None][min(i % 7, 2)]
        text = " ".join(rng.choice(words[lang == "en"]) for _ in range(rng.randrange(1, 30)))
        rows.append((i, text if i % 11 else "".join(chr(rng.randrange(33, 90)) for _ in range(20)), lang))
        labels.append((i, int(i % 11 != 0), int(i % 13 == 0)))
    rows += [(500, "the cat", "fr"), (1, None, "de"), (1, "QX!" * 9, "de"), (3, "the house", "de"), (None, "a cat and a cat", "en"), (None, "#!§$" * 5, "en"), (None, "", "en"), (600, "the " * 40_000, "en")]
    labels += [(None, 1, 0), (1, 1, 0), (999, 1, 0)]
    want = brute_quality(spark, rows, labels)
    docs = spark.createDataFrame([(*r, k, "own", "id") for k, r in enumerate(rows)], "doc_id long, text string, lang string, half int, __own string, part string").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for chunk, row in ((q.CHUNK_BYTES, q.ROW_BYTES), (600, 100)):
        monkeypatch.setattr(q, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(q, "ROW_BYTES", row)
        got = q.quality(docs, table).collect()
        assert len(got) == len(rows)
        sizes = defaultdict(list)
        for (d, t, lang), w in want.items():
            sizes[d, lang, len((t or "").encode())].append(w)
        for r in got:
            near = [w for w in sizes[r.doc_id, r.lang, r.n_bytes] if (w[0] is None) == (r.perplexity is None) and (w[0] is None or abs(w[0] - r.perplexity) < 1e-4 * w[0])]
            assert near and abs(near[0][1] - r.threshold) < 1e-4 * r.threshold and near[0][2] == r.kept
    stay = q.kept_rows(docs, table)
    assert stay.columns == docs.columns
    assert sorted(r.half for r in stay.collect()) == [k for k, r in enumerate(rows) if want[r][2]]


def test_probabilities_sum_to_one():
    grams, _ = q.runs_of([t.encode() for t in TEXTS])
    u, c = np.unique(grams, return_counts=True)
    orders = q.shard_orders(u, c)
    discount = {n: q.discounts(*[int((x == i).sum()) for i in (1, 2, 3, 4)]) for n, (_, x) in orders.items()}
    low = q.lowest(*q._suffixes(orders[3][0], 2))
    model = q.ShardModel(u, c, discount, low)
    for context in (b"the ", b"zzzz", b"\n\n\n\n", b"atxx"):
        every = np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], np.uint64)
        assert abs(np.exp2(-model.bits(every)).sum() - 1) < 1e-6


def test_quality_rejects_junk_and_keeps_prose_in_each_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.1/documents.parquet")
    labels = spark.read.parquet(f"{sf}/../sf0.1/labels.parquet")
    rows = q.quality(docs, labels).join(labels, "doc_id")
    found = rows.groupBy("lang", "quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count_distinct("threshold").alias("n")).collect()
    assert len({r.lang for r in found}) == 4
    for r in found:
        assert r.n == 1
        assert r.kept > 0.97 if r.quality else r.kept < 0.1


def test_quantile_of_few_and_many():
    assert q.quantile_of(1, 0.99) < 0.9 < q.quantile_of(30, 0.99) < q.quantile_of(3000, 0.99) <= 0.99


def test_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some text", "en", 0.0), (2, None, None, 0.0), (None, "x", "de", 1.0)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.doc_id: (r.kept, r.threshold) for r in q.quality(docs, labels).collect()}
    assert got == {1: (True, None), 2: (False, None), None: (True, None)}
    assert q.quality(docs.limit(0), labels).collect() == []


def test_labels_are_joined_beyond_the_broadcast_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t, "en", 0.0) for i, t in enumerate(TEXTS)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(TEXTS))] + [(0, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    want = {r.doc_id: r.perplexity for r in q.quality(docs, labels).collect()}
    monkeypatch.setattr(q, "BROADCAST_LABELS", 1)
    assert {r.doc_id: r.perplexity for r in q.quality(docs, labels).collect()} == want


def test_chunks_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(q, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(q, "ROW_BYTES", 500)
    rng = random.Random(1)
    rows = [("word " * rng.randrange(1, 60)).encode() for _ in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array([7] * 400, pa.int64()), pa.array([k % 3 % 2 for k in range(400)], pa.int32()), pa.array(rows, pa.binary()), pa.array(range(400))], ["part", "half", "raw", "row"])
    sizes, held = Counter(), []
    for half, chunk, slab, _ in q._chunks(iter([batch]), True):
        assert chunk >> 24 == 7
        sizes[half, chunk] += sum(len(r) for r, _ in slab)
        held += [k for _, k in slab]
    assert sorted(held) == list(range(400))
    longest = max(map(len, rows))
    assert len(sizes) > 10 and max(sizes.values()) < 3000 + 500 + longest
    # the questions are asked by the same chunks
    assert {(h, c) for h, c, _, _ in q._chunks(iter([batch]), False)} == set(sizes)
