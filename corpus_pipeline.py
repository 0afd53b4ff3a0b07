"""A corpus from raw documents to token ids, in five stages. Each takes (spark, docs, sf_dir) and works on all
that the stage before kept; between stages the documents are written as Parquet and read again.

All but the last return the columns of their input, extra ones included, whatever these are called. Null and
empty texts: the classifier judges them as empty; they link with nothing, so near-duplicate removal keeps them;
nothing repeats in them; the mix takes no document without a word. Rows repeated: of rows of one doc_id and text
the near-duplicate stage keeps one, and rows without a doc_id all stay there. Null sources and languages are
sites and sources of their own. Very long texts are worked through whole; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoflux.llm import jaccard_join, mixing, quality, suffix_dedup, unigram
from cartoflux.llm.common import Staging


#: Repeated passages are found from so many bytes on, and go if they have so many words.
REPEATS, REPEATED_WORDS = suffix_dedup.Shape(length=200, window=136, gram=24), 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, by five words and 0.8, the document of the smallest doc_id stays."""
    return jaccard_join.one_of_each_group(docs, n=5, percent=80)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more, all of whose strings of 200 bytes stand in the corpus twice, are taken out."""
    return suffix_dedup.deduplicated(docs, REPEATS, REPEATED_WORDS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand in the mix as often as their source's target asks for."""
    return mixing.mixed(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document of the mix, and the digest of what they decode to."""
    coded = unigram.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", "n_tokens", "n_fallback", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", encoding_stage),
]

#: Components, suffixes and Viterbi paths have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = Staging(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, function) in enumerate(STAGES):
        docs = stage.table(function(spark, docs, sf_dir), f"stage{number}")
        if number:
            stage.drop(f"stage{number - 1}")
    return docs
