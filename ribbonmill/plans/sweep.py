"""Sweeps of one parameter: the two pools are searched once, all settings are fused and scored in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribbonmill.operators import fusion, metrics
from ribbonmill.operators.retrieve import Index, pools


def _values(index: Index, name: str, values: list) -> DataFrame:
    return index.passages.sparkSession.createDataFrame([(float(v),) for v in values], f"{name} double")


def _score(gold: DataFrame, fused: DataFrame, index: Index, each: DataFrame, cap=5) -> DataFrame:
    (name,) = each.columns
    top = fusion.cap_per_group(fused, index.passages, cap, 10, query=[name, "query_id"])
    rows = metrics.evaluate(gold, top, (5, 10), each)
    return rows.groupBy(name).agg(F.count("*").alias("n"), F.round(F.avg("mrr"), 6).alias("mrr"), F.round(F.avg("recall_5"), 6).alias("recall_5"), F.round(F.avg("recall_10"), 6).alias("recall_10"))


def alpha(gold: DataFrame, index: Index, values: list[float]) -> DataFrame:
    each = _values(index, "alpha", values)
    d, s = pools(gold, index, 50)
    return _score(gold, fusion.weighted(d, s, F.col("alpha"), groups=index.passages, each=each), index, each)


def rrf_k(gold: DataFrame, index: Index, values: list[int]) -> DataFrame:
    each = _values(index, "rrf_k", values)
    return _score(gold, fusion.reciprocal_rank([*pools(gold, index, 50)], F.col("rrf_k"), groups=index.passages, each=each), index, each)


def pool(gold: DataFrame, index: Index, values: list[int]) -> DataFrame:
    each = _values(index, "pool", values)
    return _score(gold, fusion.reciprocal_rank([*pools(gold, index, max(values))], groups=index.passages, each=each, counts=F.col("rank") <= F.col("pool")), index, each)


def cap(gold: DataFrame, index: Index, values: list[int]) -> DataFrame:
    each = _values(index, "cap", values)
    return _score(gold, fusion.reciprocal_rank([*pools(gold, index, 50)], groups=index.passages, each=each), index, each, F.col("cap"))
