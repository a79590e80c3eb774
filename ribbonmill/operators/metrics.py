"""Evaluation: recall and reciprocal rank, rollups, abstention, percentiles, gold drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ribbonmill.session import cut

DEPTHS = (1, 3, 5, 10)


def evaluate(gold: DataFrame, ranks: DataFrame, depths: tuple[int, ...] = DEPTHS, each: DataFrame | None = None) -> DataFrame:
    """query_id, query_type, mrr, recall_k of answerable gold queries; misses count as 0, as does an empty relevant set. each: a small table of the settings that ranks has."""
    g = gold.where("answerable").select("query_id", "query_type", F.array_distinct("relevant_chunk_ids").alias("rel"))
    by = [] if each is None else each.columns
    if by:
        g = g.crossJoin(F.broadcast(each))  # a row a setting
    e = g.select("*", F.explode_outer("rel").alias("chunk_id"))
    deep = max(depths)
    j = e.join(ranks.where(F.col("rank") <= deep).select(*by, "query_id", "chunk_id", "rank"), [*by, "query_id", "chunk_id"], "left")
    n = F.greatest(F.first(F.size("rel")), F.lit(1))
    return j.groupBy(*by, "query_id", "query_type").agg(
        F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"),
        *[F.round(F.count_if(F.col("rank") <= k) / n, 6).alias(f"recall_{k}") for k in depths],
    )


def summarise(rows: DataFrame, by: tuple[str, ...] = ("query_type",), depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """Means over all queries and by type in one pass; the overall row has type 'all'."""
    cols = ["mrr", *[f"recall_{k}" for k in depths]]
    out = rows.rollup(*by).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in cols])
    return out.withColumn(by[-1], F.coalesce(by[-1], F.lit("all")))


def negative_top1(gold: DataFrame, ranks: DataFrame) -> DataFrame:
    """queries, min, max and mean best score of unanswerable queries; those without results count as queries only."""
    j = gold.where("NOT answerable").select("query_id").join(ranks.where("rank = 1").select("query_id", "score"), "query_id", "left")
    return j.agg(F.count("*").alias("queries"), F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.round(F.avg("score"), 6).alias("mean_score"))


def percentile_p90(rows: DataFrame, value: str, by: str) -> DataFrame:
    """by, n, median, p90 (the element at nine tenths of the sorted values, not between two), max.

    Ranks come from counts of distinct values, so that no group is sorted as a whole row by row.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(by).orderBy(value)
    c = c.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(by)))
    at = F.least(F.col("n"), F.floor(0.9 * F.col("n")) + 1)
    pick = lambda pos: F.min(F.when(F.col("upto") >= pos, F.col(value)))
    return c.groupBy(by).agg(
        F.max("n").alias("n"), F.round((pick(F.floor((F.col("n") + 1) / 2)) + pick(F.floor(F.col("n") / 2) + 1)) / 2, 6).alias("median"), F.round(pick(at), 6).alias("p90"), F.round(F.max(value), 6).alias("max_value"),
    )


def stride_sample(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Every ⌊rows / n⌋-th row in the order of key, the first n of them.

    The keys are written in ranges; a range's rows are numbered only if it holds one of the n, from the rows of
    the ranges before it, of which there is one a task.
    """
    ids = cut(rows.select(key).repartitionByRange(key).withColumn("_r", F.spark_partition_id()))
    ranges = [(r["_r"], r["n"]) for r in ids.groupBy("_r").agg(F.count("*").alias("n")).orderBy("_r").collect()]
    total = sum(c for _, c in ranges)
    step = max(total // n, 1)
    at, before = {}, 0
    for r, c in ranges:
        if any(before <= i * step < before + c for i in range(n)):
            at[r] = before
        before += c
    if not at:
        return rows.select(key).where("false")
    first = F.create_map(*[F.lit(x) for pair in at.items() for x in pair])
    i = F.row_number().over(Window.partitionBy("_r").orderBy(key)) - 1 + first[F.col("_r")]
    picked = ids.where(F.col("_r").isin(*at)).withColumn("_i", i)
    return picked.where((F.col("_i") % step == 0) & (F.col("_i") / step < n)).select(key)
