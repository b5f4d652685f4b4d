"""Exact dedup with a heavy-hitter split, in DataFrame operations only.

The digests of all texts are written once. Misra-Gries sketches (``approx_top_k_accumulate``,
the frequent-items sketch) of the map tasks are combined in a tree of ``WIDTH`` branches, so no
task reads more than that many of them, and name at most ``CANDIDATES`` digests; an exact partial
aggregate verifies each one's size and winner. These winners, a table bounded by ``CANDIDATES``
rows, are broadcast, so copies of a frequent text are decided on the map side. All other digests
have few copies each and are grouped by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.runtime import materialize, rows_with

#: Digests the sketch reports, and the counters it holds.
CANDIDATES, COUNTERS = 512, 8192
#: Sketches that one task combines, and levels below the last: enough for 32**4 tasks.
WIDTH, LEVELS = 32, 3
#: Groups of fewer copies than this go through the ordinary shuffle.
LEAST_COPIES = 64


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, text_sha256)`` of each text with every run of white space as one space; null counts as empty."""
    return docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("text_sha256"))


def digest(text: str):
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(normal.cast("binary"), 256)


def frequent_digests(rows: DataFrame) -> DataFrame:
    """At most ``CANDIDATES`` hashes of digests that ``rows (text_sha256)`` hold often, by sketches of the tasks combined in a tree."""
    branch = F.spark_partition_id().alias("branch")
    sketches = rows.groupBy(branch).agg(F.expr(f"approx_top_k_accumulate(xxhash64(text_sha256), {COUNTERS})").alias("sketch"))
    combined = F.expr(f"approx_top_k_combine(sketch, {COUNTERS})").alias("sketch")
    for _ in range(LEVELS):
        sketches = sketches.groupBy(F.floor(F.col("branch") / WIDTH).alias("branch")).agg(combined)
    # grouped, since a task without rows has no sketch to combine
    return sketches.groupBy(F.lit(0).alias("all")).agg(combined).select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {CANDIDATES}).item")).alias("hash"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Of equal texts the row with the smallest id stays. Rows without an id lose to rows with
    one; where a group has only null ids, ``keep_id`` is null and all its rows stay. Rows that
    repeat the winning id are the same document and share its verdict. Null text equals empty text.
    """
    all_rows = materialize(digests(docs, doc_id, text), "digests", compact=True)
    candidates = frequent_digests(all_rows)
    grouped = [F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")]
    winners = (
        all_rows.join(F.broadcast(candidates), F.xxhash64("text_sha256") == F.col("hash"), "left_semi")
        .groupBy("text_sha256")
        .agg(*grouped)
        .where(F.col("group_size") >= LEAST_COPIES)
    )
    # at most CANDIDATES rows, whatever the input
    winners = F.broadcast(materialize(winners, "winners"))
    frequent = all_rows.join(winners, "text_sha256")
    rest = all_rows.join(winners, "text_sha256", "left_anti")
    small = rest.groupBy("text_sha256").agg(*grouped)
    decided = frequent.unionByName(rest.join(small, "text_sha256"))
    return decided.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns and whole texts.

    Rows are found again by id and digest, so a row that repeats another document's id, or has
    none, goes by its own text.
    """
    stays = exact_groups(docs, doc_id, text).where("kept").select("doc_id", "text_sha256")
    return rows_with(docs, [F.col(doc_id), digest(text)], stays)
