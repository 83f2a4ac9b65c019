"""The queries of the corpus operators and, where SQL can state it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import audio, decontaminate, htmlmain, langid, pieces, pii, simhash, tokencount, toolcalls, toxicity
from netlens.llm.common import table


def op1_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` as a call or a result, linked, ordered, validated and serialised."""
    return toolcalls.link(table(spark, sf_dir, "conversations"))


def tool_calls_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exchanges of ``conversations`` as tool messages of which each call waits for the next one: sorted, linked and validated."""
    found = toolcalls.link(toolcalls.as_tool_messages(table(spark, sf_dir, "conversations")), plain=False)
    result = F.regexp_extract("canonical", r'(?s)"result":(.*)\}$', 1)
    return found.select("conv_id", "call_id", "kind", "name", "turn", "round", "result_turn", "valid", F.when(F.col("result_turn").isNotNull(), result).alias("result"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of personal data in every document, and the terms that reveal them."""
    return pii.report(pii.found_spans(table(spark, sf_dir, "documents")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document as the library of word_bpe_49k.json counts them."""
    return tokencount.token_counts(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a ten-word window of a benchmark item."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as a medium, with digests and audio features of what is read back."""
    return audio.media(table(spark, sf_dir, "documents"))


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmlmain.extract(table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies for every document: 3-word shingles, links at two bits or fewer."""
    found = simhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def op10_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded merge-dropout segmentation of every document, with its round trip."""
    return pieces.encode(table(spark, sf_dir, "documents"), with_ids=False)


QUERIES = {f.__name__: f for f in (op1_tool_call_linking, tool_calls_out_of_order, op2_toxicity, op3_pii_sanitisation, op4_language_id, op5_token_counts, op6_benchmark_decontamination, op7_audio_features, op8_html_main_text, op9_simhash_near_dedup, op10_sentencepiece_dropout)}
ORACLE_SQL: dict[str, str] = {"op1_tool_call_linking": toolcalls.ORACLE, "tool_calls_out_of_order": toolcalls.ORDER_ORACLE, "op6_benchmark_decontamination": decontaminate.ORACLE}
