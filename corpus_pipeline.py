"""Toxicity, language ID, MinHash near-duplicates, repeated substrings, packing: from raw documents to packed ones.

Each stage takes whole texts of any length and rows with nulls in any column. All but the last return the columns of documents; others,
whatever their names, are dropped. An empty table goes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import DOC_BITS, BitFilter, crc_mod, cut, discard, give_back, passed, stored, table
from netloom.llm.langid import UNKNOWN, fit_language_id, predict_language
from netloom.llm.minhash import near_duplicates
from netloom.llm.packing import character_cuts, pack
from netloom.llm.suffixes import remove_repeats
from netloom.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a bin.
CAPACITY = 8192


def _stage(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A stage that begins with what those before it have left of the executors' memory given back."""

    @wraps(f)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        give_back(spark)
        return f(spark, docs, sf_dir)

    return begun


def _carried(docs: DataFrame, id_name: str = "row") -> DataFrame:
    """The documents as one struct each, which an operator hands through as a row's id, and their text."""
    return docs.select(F.struct(*COLUMNS).alias(id_name), "text")


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below 0.5; those with null or empty texts stay, repeated rows each. Learns from the labelled documents as op5 does."""
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0)
    scored = score_toxicity(_carried(docs), fit_toxicity(docs, labels), "row")
    return scored.where("score < 0.5").select("row.*")


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language: texts that are null or without a letter go. Repeated rows are judged each. Learns from documents' own languages as op4 does."""
    model = fit_language_id(docs.where(crc_mod("doc_id", 4) != 2))
    return predict_language(_carried(docs), model, "row").where(F.col("lang_pred") != UNKNOWN).select("row.*")


@_stage
def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id. Texts without words stay, and rows with a null id.

    Ids should be unique: rows are removed by id, so rows that share the kept id all stay, even with equal texts."""
    gone = cut(near_duplicates(docs).where("not kept").select("doc_id").distinct())
    keyed = docs.select(F.xxhash64("doc_id").alias("key"), *COLUMNS)
    known = BitFilter(gone.select(F.xxhash64("doc_id").alias("key")), DOC_BITS)
    # Only documents that may go are shuffled.
    stay = passed(keyed, known, True).join(gone, "doc_id", "left_anti")
    return passed(keyed, known, False).select(*COLUMNS).union(stay.select(*COLUMNS))


@_stage
def repeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of windows of 200 bytes that occur elsewhere; a character that is cut goes whole.

    A null text becomes the empty one. Repeated rows are copies of one another, so that each loses all but texts shorter than a window."""
    out = remove_repeats(docs, carry=["lang", "source"], as_text=True)
    return out.select("doc_id", F.col("kept").alias("text"), "carry.lang", "carry.source", F.length("kept").cast("long").alias("n_chars"))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in bins of 8192 bytes, none with two of a source or of a duplicate cluster (texts that are equal but for case and white space).

    Documents without text have one row without a bin; null sources meet nothing; repeated rows are packed each."""
    words = F.regexp_replace(F.lower("text"), r"\s+", " ")
    items = docs.select("doc_id", "source", F.octet_length("text").alias("n_bytes"), F.xxhash64(words).alias("cluster"), character_cuts("text", CAPACITY).alias("cuts"))
    return pack(items, "n_bytes", CAPACITY, cuts_col="cuts")


STAGES = [("toxicity", toxicity), ("language", language), ("near_duplicates", near_duplicate), ("repeats", repeated), ("packing", packing)]

#: Trained models, components and packing are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force, and the models against labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents; each stage's result is written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
