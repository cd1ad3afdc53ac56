"""From raw documents to token ids in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``, under any
names. Null and empty texts: judged by the quality rules as they are, equal to one another, near to nothing, without
words or ids. Rows without doc_id can't be named by a duplicate or a hit and stay. Repeated rows: one stays from the second
stage on. Ties of copies: the smallest doc_id stays. Empty tables give empty results. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simplicia.llm import common, decontaminate, exact_dedup, near_dedup, piece_transducer, quality_rules
from simplicia.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, trained on the labelled ones among ``docs``, scores at 0.3 or more."""
    model = quality_rules.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep_quality(docs, model, threshold=0.3)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of equal texts."""
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies: five words, similarity of 0.8 or more."""
    return near_dedup.drop_near_duplicates(docs, size=5, percent=80)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, the ids of the text (packed little-endian unsigned 32-bit), their number and whether they decode to it."""
    return piece_transducer.with_pieces(docs, tokenizer("piece_bpe_32k.model"))


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("near dedup", near), ("benchmark decontamination", contamination), ("sentencepiece", encode)]

#: SQL has neither the trained classifier nor the transducer; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written before the next reads them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = common.write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            common.forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), "round_trip")
