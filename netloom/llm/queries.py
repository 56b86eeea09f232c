"""The registered queries of this subpackage: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.common import crc_mod, new_path, table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(mod: int, rest: int):
    """Whether a row isn't learned from: those of one remainder, and those without an id."""
    return F.coalesce(crc_mod("doc_id", mod) == rest, F.lit(True)).alias("held_out")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.llm.packing import character_cuts, pack

    words = F.regexp_replace(F.lower("text"), r"\s+", " ")
    items = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("n_bytes"), F.xxhash64(words).alias("cluster"), character_cuts("text", 8192).alias("cuts"))
    return pack(items, "n_bytes", 8192, cuts_col="cuts")


def op2_inner_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.llm.mips import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.where(F.col("vec_id") % 20 == 0), vectors, k=20)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.llm.bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.llm.langid import fit_language_id, predict_language

    docs = table(spark, sf_dir, "documents")
    model = fit_language_id(docs.where(crc_mod("doc_id", 4) != 2))
    return predict_language(docs, model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.llm.toxicity import fit_toxicity, score_toxicity

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(crc_mod("doc_id", 5) != 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.llm.chains import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.llm.pivots import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op9_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.llm.token_orc import token_positions, write_token_orc

    path = new_path(spark, "tokens")
    write_token_orc(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_positions(spark, path)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.llm.suffixes import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_inner_product_search": op2_inner_product_search,
    "op3_bpe": op3_bpe,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_substring_chains": op7_substring_chains,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_token_orc": op9_token_orc,
    "op10_suffix_dedup": op10_suffix_dedup,
}

#: SQL for those that SQL can express; the rest are tested against brute force.
ORACLE_SQL: dict[str, str] = {}
