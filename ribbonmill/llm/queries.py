"""The registered queries of this subpackage: name -> callable(spark, folder); SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ribbonmill.llm import encoding, markup, mixing, pairs, quality, repetition, scans, sentences, splitting, truncation
from ribbonmill.session import spread
from ribbonmill.sources.tables import table

def _wide(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spread(table(spark, d, name))


Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(_wide(spark, d, "answers_llama3_natural"))


def p1_by_source(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(_wide(spark, d, "answers_llama3_natural"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.found(_wide(spark, d, "chunk"), _wide(spark, d, "answers_llama3_natural"), table(spark, d, "sentence_scope"))


def p2_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.all_units(_wide(spark, d, "chunk"), _wide(spark, d, "answers_llama3_natural"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.found(_wide(spark, d, "chunk"), table(spark, d, "split_limit"))


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(_wide(spark, d, "chunk"), table(spark, d, "split_limit")).dropDuplicates(["chunk_id", "piece_no"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.found(_wide(spark, d, "chunk"), table(spark, d, "common_word"))


def p5_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.document_statistics(_wide(spark, d, "chunk"), table(spark, d, "common_word"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.found(_wide(spark, d, "chunk"))


def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    return markup.clean_table(_wide(spark, d, "chunk"))


def p7_slots(spark: SparkSession, d: str) -> DataFrame:
    return markup.slot_table(_wide(spark, d, "chunk"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(_wide(spark, d, "chunk"))


def p3_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(_wide(spark, d, "chunk"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(_wide(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_wide(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_wide(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.found(_wide(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.shares(_wide(spark, d, "documents"))


def p10_perplexity(spark: SparkSession, d: str) -> DataFrame:
    return repetition.perplexities(_wide(spark, d, "documents"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(_wide(spark, d, "answers_llama3_natural"), table(spark, d, "common_word"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(f)}


_SPACE = r"\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SINGLE = r"\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}"


def oracle_sql() -> dict[str, str]:
    """The other operators are models, automata or tokenizers, which SQL can't express; their tests are in tests/llm."""
    return {
        "p4_found": f"SELECT DISTINCT chunk_id FROM chunk JOIN split_limit USING (content_type) WHERE len(regexp_extract_all(chunk_text, '[{_SINGLE}]|[^{_SPACE}{_SINGLE}]+')) > max_tokens",
    }
