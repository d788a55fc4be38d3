"""From documents to packed training sequences: filter, deduplicate, redact, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from larkspur.llm.inputs import columns_of, table
from larkspur.llm.language import UNKNOWN, fit_network, predict_language
from larkspur.llm.ngram_join import ngram_join
from larkspur.llm.queries import TOXIC_FROM, packed_documents, scored_toxicity
from larkspur.llm.secret_spans import find_secrets, fit_field
from larkspur.session import stage

#: What stands in a text where a secret was.
REDACTED = "[SECRET]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of being toxic is below the bound."""
    return scored_toxicity(docs, sf_dir).where(F.col("p_toxic") < TOXIC_FROM).select(columns_of(docs))


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows: those without a letter go."""
    predicted = predict_language(docs, fit_network(docs))
    return predicted.where(F.col("lang_pred") != UNKNOWN).select(columns_of(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, once if row and text are repeated.

    Different texts under one id all stay; of rows with one id and text the one whose other columns read least in JSON
    stays. Documents without an id link with nothing and stay.
    """
    joined = ngram_join(docs)
    chosen = stage(joined.where("id = component").select(F.col("id").alias("doc_id")).distinct(), "kept")
    known = docs.join(chosen, "doc_id", "left_semi")
    others = [c for c, name in zip(columns_of(docs), docs.columns) if name not in ("doc_id", "text")]
    read = F.to_json(F.struct(F.lit(0), *others))
    once = known.groupBy("doc_id", "text").agg(F.min_by(F.struct(*columns_of(docs)), read).alias("kept")).select("kept.*")
    return once.select(columns_of(docs)).union(docs.where("doc_id IS NULL"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and their length counted anew."""
    found = find_secrets(docs, fit_field(docs.select("doc_id", "text")), redact=REDACTED)
    changed = F.size("spans") > 0
    n_chars = F.when(changed, F.char_length("text")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(columns_of(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_copies", drop_near_copies),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: The models of three stages are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
