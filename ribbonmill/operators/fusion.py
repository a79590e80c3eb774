"""Fusing two ranked lists of each query, capping groups, reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ribbonmill.functions import places, round6, tokens
from ribbonmill.operators.topk import ranked


def _lists(lists: list[DataFrame], query: list[str], key: str, groups: DataFrame | None, group: str) -> tuple[DataFrame, list[str]]:
    """The rows of all lists (_list: whose), partitioned by the query alone, so that what follows moves nothing; the columns that stand for a row of the result, with groups also the row's group."""
    u = reduce(DataFrame.union, [x.select(*query, key, "score", "rank", F.lit(i).alias("_list")) for i, x in enumerate(lists)])
    if groups is not None:
        u = u.join(groups.select(key, group, F.lit(True).alias("_in")), key, "left")
    return u.repartition(*query), [*query, key, *([] if groups is None else [group, "_in"])]


def _in_order(df: DataFrame, query: list[str], key: str) -> DataFrame:
    """df with its rank in each query; keys without a group are left out then."""
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy(*query).orderBy(F.desc("score"), F.asc(key))))
    return df.where("_in").drop("_in") if "_in" in df.columns else df


def reciprocal_rank(lists: list[DataFrame], k: int | Column = 60, query: str | list[str] = "query_id", key: str = "chunk_id", groups: DataFrame | None = None, group: str = "doc_id", each: DataFrame | None = None, counts: Column | None = None) -> DataFrame:
    """query, key, score, rank: the sum over lists of 1 / (k + rank); ranks start at 1.

    groups (key, group): the result has each row's group. each: a small table of settings, for each of which the lists are fused; k, and counts (which rows count), may be columns of it.
    """
    q = [query] if isinstance(query, str) else query
    kk = k if isinstance(k, Column) else F.lit(k)
    u, own = _lists(lists, q, key, groups, group)
    if each is not None:
        u, own, q = u.crossJoin(F.broadcast(each)), [*each.columns, *own], [*each.columns, *q]
    u = u if counts is None else u.where(counts)
    return _in_order(u.groupBy(*own).agg(round6(F.sum(F.lit(1.0) / (kk + F.col("rank")))).alias("score")), q, key)


def weighted(dense: DataFrame, sparse: DataFrame, alpha: float | Column = 0.5, query: str | list[str] = "query_id", key: str = "chunk_id", groups: DataFrame | None = None, group: str = "doc_id", each: DataFrame | None = None) -> DataFrame:
    """query, key, score, rank: alpha times the dense list's scores over their own range (1 where all are equal), plus the rest times the sparse one's; what isn't in a list has 0 there.

    groups and each: as in ``reciprocal_rank``; alpha may be a column of each.
    """
    q = [query] if isinstance(query, str) else query
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    u, own = _lists([dense, sparse], q, key, groups, group)
    w = Window.partitionBy(*q, "_list")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    u = u.withColumn("x", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(1.0)))
    part = lambda i: F.coalesce(F.max(F.when(F.col("_list") == i, F.col("x"))), F.lit(0.0))
    both = u.groupBy(*own).agg(part(0).alias("d"), part(1).alias("s"))
    if each is not None:
        both, own, q = both.crossJoin(F.broadcast(each)), [*each.columns, *own], [*each.columns, *q]
    return _in_order(both.select(*own, round6(a * F.col("d") + (1 - a) * F.col("s")).alias("score")), q, key)


def cap_per_group(ranks: DataFrame, groups: DataFrame, cap: int | Column = 5, k: int | Column = 10, query: str | list[str] = "query_id", key: str = "chunk_id", group: str = "doc_id") -> DataFrame:
    """ranks with the best ``cap`` of each group, the best ``k`` of those, ranked anew. Keys without a group are left out; ranks that have the group aren't joined with groups. Raises where k is under 1."""
    if isinstance(k, int) and k < 1:
        raise ValueError("k must be 1 or more")
    q = [query] if isinstance(query, str) else query
    j = ranks if group in ranks.columns else ranks.join(groups.select(key, group), key).repartition(*q)
    n = F.row_number().over(Window.partitionBy(*q, group).orderBy("rank"))
    j = j.withColumn("_n", n).where(F.col("_n") <= (cap if isinstance(cap, Column) else F.lit(cap))).drop("_n")
    j = j.withColumn("rank", F.row_number().over(Window.partitionBy(*q).orderBy("rank")))
    return j.where(F.col("rank") <= (k if isinstance(k, Column) else F.lit(k)))


def rerank(ranks: DataFrame, scores: DataFrame, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """ranks in the order of another scorer (query, key, rerank_score), stable: equal ones keep their order. Both scores remain."""
    j = ranks.join(scores, [query, key], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(float("-inf"))))
    w = Window.partitionBy(query).orderBy(F.desc("rerank_score"), F.asc("rank"))
    return j.withColumn("retrieval_rank", F.col("rank")).withColumn("rank", F.row_number().over(w))


def overlap_scores(queries: DataFrame, ranks: DataFrame, texts: DataFrame, query: str = "query_id", query_text: str = "query", key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """query, key, rerank_score: share of a query's distinct tokens in the text; stands in for a cross-encoder."""
    terms = sorted({t for r in queries.select(F.explode(tokens(F.col(query_text))).alias("t")).distinct().collect() for t in r})
    # of a text only the places of the queries' terms move
    j = ranks.select(query, key).join(texts.select(key, places(F.col(text), terms).alias("_t")), key).join(queries.select(query, F.size(F.array_distinct(tokens(F.col(query_text)))).alias("_n"), places(F.col(query_text), terms).alias("_q")), query)
    share = F.size(F.array_intersect("_q", "_t")) / F.greatest("_n", F.lit(1))
    return j.select(query, key, round6(share).alias("rerank_score"))


def with_safety_net(first: DataFrame, net: DataFrame, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """first, and behind it what net has besides, in net's order, ranked on."""
    more = net.join(first.select(query, key), [query, key], "left_anti").select(query, key, (F.col("rank") + 1_000_000).alias("rank"), F.lit(True).alias("from_net"))
    u = first.select(query, key, "rank", F.lit(False).alias("from_net")).union(more)
    return u.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("rank")))


__all__ = ["reciprocal_rank", "weighted", "cap_per_group", "rerank", "overlap_scores", "with_safety_net", "ranked"]
