from pyspark.sql import functions as F

import corpus_pipeline as pipeline




def planted(spark, sf):
    """Real documents and, after them, planted ones."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = sorted((r for r in docs.collect() if r.doc_id < 60 and len(r.text.split()) > 120), key=lambda r: r.doc_id)
    one, two, three = good[0], good[1], good[2]
    near = one.text.split(" ")
    near[len(near) // 2] = "changed"
    passage = " ".join(two.text.split()[:60])
    rows = [
        (10_001, one.text.replace(" ", "  ", 1), one.lang, "s", 1),
        (10_002, " ".join(near), one.lang, "s", 1),
        # words of its own order, so that it is no near copy of the text they are from, and a passage of another
        (10_003, " ".join(reversed(three.text.split())) + "\n" + passage, three.lang, "s", 1),
        (10_004, None, "en", None, None),
        (10_005, "", None, "s", 0),
    ]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)), one, two, three


def test_stages(spark, sf):
    docs, one, two, three = planted(spark, sf)
    columns = docs.columns
    now = docs
    left = {}
    for name, stage in pipeline.STAGES:
        now = pipeline.materialize(stage(spark, now, sf))
        left[name] = now
        if name != "best-fit packing":
            assert now.columns == columns
            assert dict(now.dtypes) == dict(docs.dtypes)
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in left.items()}
    assert {10_004, 10_005}.isdisjoint(ids["quality classifier"])
    assert one.doc_id in ids["exact dedup"] and 10_001 not in ids["exact dedup"]
    assert 10_002 in ids["exact dedup"] and 10_002 not in ids["simhash near-dedup"]
    texts = {r.doc_id: r for r in left["substring dedup"].collect()}
    assert texts[two.doc_id].text.split()[:30] == two.text.split()[:30]
    assert " ".join(two.text.split()[:60]) not in " ".join(texts[10_003].text.split())
    assert texts[10_003].n_chars == len(texts[10_003].text)
    assert ids["best-fit packing"] == set(texts)


def test_run_and_empty(spark, sf):
    rows = pipeline.run(spark, sf)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows.columns)
    assert rows.count() > 0
    now = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        now = pipeline.materialize(stage(spark, now, sf))
    assert now.count() == 0


def test_stages_with_odd_rows_and_names(spark, sf):
    docs, one, two, three = planted(spark, sf)
    long = "word of a text " * 30_000
    more = [(None, one.text, one.lang, None, 1), (None, None, None, None, None), (two.doc_id, two.text, two.lang, "s", 1), (two.doc_id, "", two.lang, "s", 1), (20_000, long, "en", "s", 1), (20_001, three.text, None, None, None)]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    clash = ["__own", "__id", "__hash", "row", "own0", "half", "node", "kind", "start", "others", "raw", "bin"]
    docs = docs.select("*", *[F.lit(k).alias(c) for k, c in enumerate(clash)])
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        now = pipeline.materialize(stage(spark, now, sf))
        assert now.columns == docs.columns and dict(now.dtypes) == dict(docs.dtypes)
        rows = now.collect()
        assert all(r[c] == k for r in rows for k, c in enumerate(clash))
        # a row without text goes, though a good document has its id
        assert not [r for r in rows if not r.text]
        if name != "quality classifier":  # of a text that rows of several ids hold, one id stays
            assert {r.doc_id for r in rows if r.text == one.text} <= {one.doc_id}
        assert two.doc_id in {r.doc_id for r in rows}
    assert pipeline.STAGES[-1][1](spark, now, sf).count() >= now.count()
