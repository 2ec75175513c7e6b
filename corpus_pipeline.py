"""From raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, sf_dir); all but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.bpe import encode
from weftgraph.llm.common import Named, ensure_checkpoint_dir, table
from weftgraph.llm.decontamination import decontaminate
from weftgraph.llm.exact_dedup import drop_exact_copies
from weftgraph.llm.language_id import UNKNOWN, fit_languages, identify_languages
from weftgraph.llm.similar import drop_similar
from weftgraph.llm.simhash import drop_near_duplicates

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those that the operator flags as ambiguous; lang is the language found.

    Columns may have any names: they are read under names of the stage's own.
    """
    named = Named(docs)
    doc_id, text, lang = named.at("doc_id"), named.at("text"), named.at("lang")
    others = tuple(c for c in named.rows.columns if c not in (doc_id, lang))
    found = identify_languages(named.rows, fit_languages(named.rows, doc_id, text, lang), doc_id, text, keep=others)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & ~F.col("ambiguous"))
    return named.back(kept.withColumnsRenamed({"doc_id": doc_id, "lang_pred": lang}))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest doc_id stays.

    First by fingerprints at most 2 bits apart, as the operator's query links them;
    then by a similarity of 0.8 or more of five-word shingles, as most near copies
    differ in more bits.
    """
    return drop_similar(drop_near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that consist of little else go. n_chars is that of the text left."""
    named = Named(docs)
    doc_id, text, n_chars = named.at("doc_id"), named.at("text"), named.at("n_chars")
    others = tuple(c for c in named.rows.columns if c not in (doc_id, text, n_chars))
    found = decontaminate(named.rows, table(spark, sf_dir, "benchmark"), doc_id, text, keep=others).filter(~F.col("dropped"))
    return named.back(found.withColumn(n_chars, F.length("text").cast(docs.schema["n_chars"].dataType)).withColumnsRenamed({"doc_id": doc_id, "text": text}))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of the bytes they decode to."""
    coded = encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, decode_back=True)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("byte_level_bpe", byte_bpe),
]

#: Language identification, fingerprints and merges have no SQL; a test holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is a checkpoint in the shared folder, which the next one reads."""
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = docs.checkpoint()
    return docs
