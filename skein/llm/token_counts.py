"""Token counts by a two-tier lookup on the map side, without a shuffle of pre-tokens.

A first pass counts the pre-tokens of every text, each task keeping its most frequent ones;
the ``TIER`` most frequent overall are encoded once and broadcast as a table of lengths of at
most ``TIER`` entries of at most ``LONGEST`` bytes. The second pass sums lengths per text:
frequent pre-tokens come from that table, the others from a bounded cache in each Python
worker that asks the tokenizer. The table only saves work; any choice of entries gives the
same counts.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.words import Cache, hf_ids, id_cache

TIER = 32_768
LONGEST = 40
#: Pre-tokens a task reports, and the entries it holds at most while counting.
PER_TASK, HELD = 8_192, 400_000


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, raw)``: each text as UTF-8 bytes, null as empty."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")
    )


def _frequent(batches):
    counts: Counter = Counter()
    for batch in batches:
        for raw in batch.column(0).to_pylist():
            counts.update(raw.split())
            if len(counts) > HELD:
                counts = Counter(dict(counts.most_common(HELD // 4)))
    top = [(w, n) for w, n in counts.most_common(PER_TASK) if len(w) <= LONGEST]
    yield pa.RecordBatch.from_arrays(
        [pa.array([w for w, _ in top], pa.binary()), pa.array([n for _, n in top], pa.int64())], ["word", "n"]
    )


def frequent_words(raw: DataFrame) -> list[bytes]:
    """The ``TIER`` most frequent pre-tokens over all texts, by what each task finds frequent."""
    top = (
        raw.select("raw")
        .mapInArrow(_frequent, "word binary, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(TIER)
    )
    return [bytes(r.word) for r in top.select("word").collect()]


_tiers: dict[tuple, Cache] = {}


def _lengths(path: str, tier) -> Cache:
    """The worker's two tiers, kept while the broadcast table stays the same."""
    key = (path, tier.id if hasattr(tier, "id") else id(tier))
    if key not in _tiers:
        _tiers.clear()
        misses = id_cache(path, False, limit=300_000).make
        _tiers[key] = Cache(lambda w: len(misses(w)) // 4, limit=1_000_000, fixed=dict(zip(*tier.value, strict=True)))
    return _tiers[key]


def _count(path: str, tier, batches):
    lengths = _lengths(path, tier)
    for batch in batches:
        sizes, counts = [], []
        for raw in batch.column("raw").to_pylist():
            sizes.append(len(raw))
            counts.append(sum(map(lengths.__getitem__, raw.split())))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``.

    ``tokenizer`` is the path, on driver and executors, of a tokenizers file whose vocabulary
    drops white space between words. Counts are those of the library without added special
    tokens, truncation or padding. Null and empty texts have no bytes and no tokens; repeated
    rows and null ids are counted like any other; other columns are ignored, an empty table
    yields an empty result.
    """
    raw = texts(docs, doc_id, text)
    words = frequent_words(raw)
    tier = docs.sparkSession.sparkContext.broadcast((words, [len(hf_ids(tokenizer, w)) // 4 for w in words]))
    schema = T.StructType(
        [
            T.StructField("doc_id", raw.schema["doc_id"].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )
    counted = raw.mapInArrow(partial(_count, tokenizer, tier), schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
