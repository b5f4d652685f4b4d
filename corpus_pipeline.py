"""The corpus pipeline: documents to packed sequences.

Each stage is a function of ``(spark, docs, sf_dir)``; what it returns is written as Parquet
and read again as the next one's ``docs``. All but the last return the columns of documents,
and more columns that ``docs`` may have, whatever their names. An empty table passes through.

Rows are told apart by id and text: one that repeats an id, or has none, is judged by its own
text in the first three stages; the fourth takes rows of one id for one document and leaves
rows without an id as they are, since they have no place in the order of the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import exact_dedup, ngram_quality, packing, similar, substring_dedup
from skein.llm.queries import tokenizer
from skein.runtime import materialize, table

#: The stages hold models and searches that SQL cannot express.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is above their language's threshold go, and those without text; each row by its own text."""
    return ngram_quality.kept_rows(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are similar in five-word shingles the one with the smallest id stays: SimHash pivots choose, exact similarity decides."""
    return similar.near_dedup(docs, k=5, similarity=0.8)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that started earlier go; texts without such passages stay as they are, texts of nothing else go. Rows without an id stay whole."""
    others = tuple(c for c in docs.columns if c != "doc_id")
    found = substring_dedup.substring_dedup(docs, 20, carry=others)
    text = F.when(F.col("n_removed") > 0, F.col("kept").cast("string")).otherwise(F.col("others.text"))
    n_chars = F.when(F.col("n_removed") > 0, F.length(F.col("kept").cast("string")).cast("long")).otherwise(F.col("others.n_chars"))
    new = {"text": text, "n_chars": n_chars}
    left = found.where("n_removed = 0 OR n_removed < n_words")
    return left.select(*[new.get(c, F.col("doc_id" if c == "doc_id" else f"others.{c}")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), 2048, end_id=0)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("substring dedup", substrings),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
