"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelab.session import table


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import licences

    return licences.digest(licences.licence_scan(table(spark, sf_dir, "documents")))


def remainder(n: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import token_files

    return token_files.write_and_read(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import bpe

    return bpe.digest(bpe.encode(table(spark, sf_dir, "documents"), with_decoded=True))


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import copies

    return copies.near_copies(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import languages

    docs = table(spark, sf_dir, "documents")
    profiles = languages.prototypes(docs.where(remainder(4) != 2))
    found = languages.identify(docs, profiles)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import scoring

    found = scoring.score_texts(table(spark, sf_dir, "documents"), remainder(7) != 2)
    return found.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import leaks

    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(remainder(5) != 0))
    found = toxicity.score(docs, model)
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import pages

    return pages.extract_pages(table(spark, sf_dir, "pages"))


def op10_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import vectors

    return vectors.near_copies(table(spark, sf_dir, "embeddings"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import chat

    return chat.digest(chat.format_conversations(table(spark, sf_dir, "conversations")), "conv_id")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import divergence

    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirelab.llm import prefix_trie

    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


OPERATORS = (op1_licence_scan, op2_token_files, op3_bpe, op4_near_copies, op5_language_id, op6_lm_scoring, op7_decontamination, op8_toxicity, op9_extract_pages, op10_vector_copies, op11_chat_format, op12_source_divergence, op13_prefix_trie)
QUERIES = {f.__name__: f for f in OPERATORS}


def _sql() -> dict[str, str]:
    from quirelab.llm import chat, divergence, prefix_trie

    return {"op11_chat_format": chat.SQL, "op12_source_divergence": divergence.SQL, "op13_prefix_trie": prefix_trie.SQL}


SQL: dict[str, str] = _sql()
