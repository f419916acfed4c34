"""A corpus pipeline of the llm operators: language ID, near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the
last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import common, language, minhash, packing, substring_dedup
from terravane.llm.queries import PIECES, WORD_BPE

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no language that can be told: null, without a letter, below even odds, or in
    letters of which the labelled texts have less than half."""
    model = language.train(docs, PIECES)
    return language.predict(docs.select(*COLUMNS), model).where("lang_pred <> 'und' AND score >= 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, that of the smallest doc_id; of a row stated twice, one."""
    docs = docs.select(*COLUMNS)
    if common.has_odd_keys(docs):
        docs = docs.dropDuplicates(["doc_id", "text"])
    kept = minhash.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hashed = docs.withColumn("_own", F.xxhash64(F.coalesce("text", F.lit(""))))
    return hashed.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left_semi").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts runs of 20 words or more that an earlier document holds; other texts stay as they are."""
    return substring_dedup.cut(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece's place in a sequence of at most 4096 tokens."""
    return packing.pack(docs, WORD_BPE)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("minhash", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]
#: SQL can express neither the fitted language model nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's are written and read again by the next.

    A null doc_id comes before all others; rows stated twice go on once; null and empty texts go with
    language ID, which keeps nothing where no row has both a text and a language. An empty table gives no
    rows. Columns other than those of `documents` aren't read.
    """
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
