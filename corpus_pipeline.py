"""The corpus pipeline: five stages that follow one another over the documents.

Each stage works on all rows its predecessor kept. Decisions are by id: rows that share an id stay or go together (copies of
one id and text become one row), and rows with a null id pass the filters and the near-duplicate stage. The mix decides by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skywave.llm.bpe import decode, encode
from skywave.llm.common import stored, table
from skywave.llm.lang_id import UNKNOWN, fit_language_model, predict_language
from skywave.llm.mixing import mix
from skywave.llm.ngram_join import ngram_join
from skywave.llm.quality import quality_select

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts whose predicted language has no larger share than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5


def _chosen(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The documents with an id in chosen(chosen_id); a merge at every size, as the list grows with the corpus."""
    return docs.join(chosen.hint("merge"), docs.doc_id == chosen.chosen_id, "left_semi").select(*COLUMNS)


def _nameless(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is null").select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling against the labelled good ones keeps."""
    picked = quality_select(docs, table(spark, sf_dir, "labels"))
    return _chosen(docs, picked.where("kept").select(F.col("doc_id").alias("chosen_id")).distinct()).union(_nameless(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model recognises."""
    labelled = docs.where("lang is not null and doc_id is not null").select(F.col("doc_id").alias("id"), "lang", "text")
    told = predict_language(docs, fit_language_model(labelled)).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") > LEAST_LANGUAGE_SCORE))
    return _chosen(docs, told.select(F.col("doc_id").alias("chosen_id")).distinct()).union(_nameless(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest id."""
    groups = ngram_join(docs, k=5, percent=80)
    first = _chosen(docs, groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("chosen_id")).distinct())
    rest = F.struct(*[c for c in COLUMNS if c not in ("doc_id", "text")])
    single = first.groupBy("doc_id", "text").agg(F.min(rest).alias("rest")).select("doc_id", "text", "rest.*")
    return single.select(*COLUMNS).union(_nameless(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a row stands as many times as the mix takes it, whatever id it has."""
    keyed = stored(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_key")), "mix-rows")
    taken = mix(keyed, key_col="row_key").where("taken > 0").select(F.col("row_key").alias("chosen_key"), (F.col("taken") / F.col("size")).cast("int").alias("times"))
    chosen = keyed.join(taken.hint("merge"), keyed.row_key == taken.chosen_key)
    return chosen.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*COLUMNS)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the mix's documents, encoded and decoded again."""
    # stored in between: chained in one task, each core would keep two Python workers with a tokenizer
    decoded = decode(stored(encode(docs), "pipeline-ids"))
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing),
    ("BPE encoding and decoding", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs, "pipeline")
    return docs


#: The models of the first two stages and the tokenizer cannot be told in SQL; tests hold each stage against brute force.
ORACLE_SQL = None
