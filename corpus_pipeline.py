"""From raw documents to token files: the stages of the training-data pipeline, in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolith.llm import decontam, mixing, quality, simhash, tokens
from astrolith.llm.common import written

#: A document stays if its quality score reaches this.
LEAST_QUALITY = 0.3
#: Near copies have fingerprints of five-word shingles of which any of the WORDS 64-bit words differs in at
#: most DISTANCE bits, by which they are found, and which differ in at most TOTAL of all 192 (a similarity of 0.8).
DISTANCE, WORDS, TOTAL = 8, 3, 38
#: The weights of the sources by code point, in turn, and the most copies of a source.
WEIGHTS, CAP = (1, 2, 3), 3.0
TOKENIZER, END_ID = "byte_bpe_50k.json", 2


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labelled ones of docs, scores too low go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    # Statistics of all documents are a few numbers each; texts are not shuffled to find the labelled ones.
    stats = written(quality.statistics_of(docs, "doc_id", "text"), "statistics")
    model = quality.learn(stats, labels, train=~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs, model, least=LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id stays."""
    return simhash.near_dedup(docs, distance=DISTANCE, shingle=5, words=WORDS, total=TOTAL, keyed=WORDS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, up to edits of a fifth of its words, go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once, or up to three times."""
    return mixing.mix(docs, list(WEIGHTS), cap=CAP)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' documents: doc_id, start, n_tokens and ids_crc32 of each."""
    import public_tokenizers

    return tokens.encode_corpus(docs, public_tokenizers.path(TOKENIZER), END_ID)


STAGES = [
    ("quality_classifier", keep_quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("token_binary", token_files),
]

#: Classifier, fingerprints and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the whole documents table; each stage is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
