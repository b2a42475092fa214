"""Stages of the document pipeline. Each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of ``docs``. Rows that agree in id and text are one
document listed several times; a stage keeps or drops them together, except that near-dedup
keeps one row of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import bpe, decontam, hdlang, linededup, resemblance
from wattloom.llm.common import digest_key, fresh, table
from wattloom.llm.queries import tokenizer_path

#: A text whose cosine with every language is below this is none of them.
LEAST_LIKENESS = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no known language: without a letter, null, or unlike every profile. ``lang`` becomes the prediction.

    Profiles are learned from the rows' own labels; without any label nothing is known and nothing rejected.
    """
    prototypes = [(r["lang"], list(r["profile"])) for r in hdlang.fit(docs).collect()]
    if not prototypes:
        return docs
    lang, score = fresh(docs, "lang_pred", "score")
    found = hdlang.predict(docs, prototypes, docs.columns, lang_name=lang, score_name=score)
    kept = found.where((F.col(lang) != "und") & (F.col(score) >= LEAST_LIKENESS))
    return kept.select(*(F.col(lang).alias(c) if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of three lines or of 50 words, however these are laid out; a document of which nothing but blanks is left by that goes, as it is all repeats."""
    removed, = fresh(docs, "removed")
    out = linededup.dedup(docs, passages=True, removed_name=removed)
    cut = F.col(removed) > 0
    out = out.where(~(cut & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")))
    size = F.when(cut, F.char_length("text")).otherwise(F.col("n_chars"))
    return out.select(*(size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of every group of near-duplicates the document with the smallest id (of equal ids that with the smallest text digest).

    Near-duplicates have a similarity of 0.8 or more in five-word shingles. Candidates are SimHash fingerprints within four
    bits, as in op6, and, as these do not reach so far as 0.8, texts that share a MinHash band.
    """
    key, = fresh(docs, "key_")
    marked = docs.withColumn(key, digest_key(F.col("doc_id"), F.col("text")))
    kept = resemblance.first_of_each(marked, key).select(F.col("key").alias(key))
    return marked.join(kept, key).dropDuplicates([key]).select(*(F.col(f"`{c}`") for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what was kept, with the digests of ids and of the decoded text: doc_id, n_tokens, ids_sha256, decoded_sha256, ids."""
    return bpe.round_trip(docs, tokenizer_path(), with_ids=True)
