"""A training corpus from raw documents: five stages, each a function (spark, docs, sf_dir) -> DataFrame.

language       Documents whose language is not recognised go: null texts, texts without a letter, and scores under the
               threshold that calibration sets.
toxicity       Documents with a score of 0.3 or more go.
near_copies    Of documents that links of five-word shingles (Jaccard 0.75 or more) connect, the one with the smallest id
               stays. Rows that share an id are told apart by their sets, and of rows with one id and set one stays. Documents without words or without an id are nobody's
               copy and stay.
decontaminate  Benchmark passages are cut out of texts, and n_chars is set anew; no document goes.
encode         SentencePiece segmentations of each document: doc_id, samples, round_trip.

All but the last keep every column of the documents. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logtide.llm import decontaminate, language_id, toxicity
from logtide.llm.common import kept, table
from logtide.llm.jaccard_join import one_of_each
from logtide.llm.queries import tokenizer_path
from logtide.llm.sentencepiece_sampling import sampled_segmentations


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(spark, docs, language_id.learn(docs))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(spark, docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(spark, docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.cleaned(spark, docs, table(spark, sf_dir, "benchmark"))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sampled_segmentations(spark, docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("language", recognised), ("toxicity", not_toxic), ("near_copies", one_of_each_group), ("decontaminate", without_benchmark), ("encode", segmented)]

#: Classifiers and sampled segmentations are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = kept(docs)
    return docs
