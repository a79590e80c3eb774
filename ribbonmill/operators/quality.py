"""Checks of a passage table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribbonmill.functions import token_count


def token_stats(passages: DataFrame, text: str = "chunk_text", short: int = 80, long: int = 512) -> DataFrame:
    """n, min, median, mean and max tokens, cut to integers, and how many passages are short or long."""
    t = passages.select(token_count(F.col(text)).cast("long").alias("k"))
    return t.agg(
        F.count("*").alias("n"), F.min("k").alias("min_tokens"), F.floor(F.percentile("k", F.lit(0.5))).alias("median_tokens"), F.floor(F.avg("k")).alias("mean_tokens"), F.max("k").alias("max_tokens"), F.count_if(F.col("k") < short).alias("short"), F.count_if(F.col("k") > long).alias("long"),
    )


def missing_fields(passages: DataFrame) -> DataFrame:
    """Of each document the passages without a year or section, and the distinct weights in thousandths."""
    w = F.round(F.col("recency_weight") * 1000).cast("long")
    return passages.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("pub_year").isNull()).alias("no_year"), F.count_if(F.col("section_h2").isNull()).alias("no_section"), F.array_join(F.transform(F.array_sort(F.collect_set(w)), lambda x: x.cast("string")), ",").alias("weights"),
    )


def reachability(ranks: DataFrame, expected: DataFrame, depth: int = 3, cutoff: float = 0.647) -> DataFrame:
    """check, passed, total: reachable queries (query_id, fragments) of which a fragment is in the id of a best document; queries without fragments must score under the cutoff."""
    e = expected.select("query_id", F.filter(F.coalesce("fragments", F.array().cast("array<string>")), lambda x: x.isNotNull()).alias("fragments"))
    near = (F.col("rank") <= depth) & F.exists("fragments", lambda f: F.contains(F.col("doc_id"), f))
    j = e.join(ranks, "query_id", "left").groupBy("query_id").agg(
        F.max(F.size("fragments") > 0).alias("reachable"), F.max(F.coalesce(near, F.lit(False))).alias("hit"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top")
    )
    ok = F.when(F.col("reachable"), F.col("hit")).otherwise(F.coalesce(F.col("top") < cutoff, F.lit(True)))
    return j.groupBy(F.when(F.col("reachable"), "reachable").otherwise("unreachable").alias("check")).agg(F.count_if(ok).alias("passed"), F.count("*").alias("total"))
