"""Prompts from retrieved passages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribbonmill.operators.cleaning import section_label


def user_messages(ranks: DataFrame, passages: DataFrame, queries: DataFrame, no_think: bool = False) -> DataFrame:
    """query_id, message: numbered sources with their headers, in rank order, then the question. Missing values read None."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    head = F.concat(F.lit("[SOURCE "), F.col("rank").cast("string"), F.lit(" — type: "), s("source_type"), F.lit(" — recency: "), s("recency_weight"), F.lit(" — "), s("title"), F.lit(" ("), s("pub_year"), F.lit(") — §"), section_label(F.col("section_h2"), F.col("section_h1")), F.lit("]\n"), F.col("chunk_text"), F.lit("\n"))
    j = ranks.select("query_id", "chunk_id", "rank").join(passages, "chunk_id").select("query_id", F.struct("rank", head.alias("t")).alias("x"))
    j = j.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("body")).join(queries.select("query_id", "query"), "query_id")
    return j.select("query_id", F.concat(F.lit("SOURCES:\n"), F.col("body"), F.lit("\nQUESTION: "), F.col("query"), F.lit("\n\n/no_think" if no_think else "")).alias("message"))


def chat(messages: DataFrame, system: str) -> DataFrame:
    """query_id, messages: the system's and the user's part."""
    part = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return messages.select("query_id", F.array(part("system", F.lit(system)), part("user", F.col("message"))).alias("messages"))
