"""From a pool of passages to an answer: rerank, cap, safety net, generate; and what is reported of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribbonmill.operators import fusion
from ribbonmill.operators.cleaning import REFUSAL, is_abstention
from ribbonmill.operators.retrieve import Index, Params, fuse, pools
from ribbonmill.session import cut, few

#: A cap that no document reaches.
NO_CAP = 1_000_000


def pool_of(queries: DataFrame, index: Index, pool: int = 50) -> DataFrame:
    """query_id, chunk_id, doc_id, score, rank: the best ``pool`` passages of each query, documents uncapped."""
    d, s = pools(queries, index, pool)
    return fusion.cap_per_group(fuse(d, s, Params(), index.passages), index.passages, NO_CAP, pool)


def reranked(queries: DataFrame, pooled: DataFrame, passages: DataFrame, cap: int = 5, k: int = 10, scorer: Callable | None = None) -> DataFrame:
    """The pool in the order of a scorer (queries, ranks, passages -> query_id, chunk_id, rerank_score), capped and cut to k."""
    scores = (scorer or fusion.overlap_scores)(queries, pooled, passages)
    return fusion.cap_per_group(fusion.rerank(pooled, scores), passages, cap, k)


def answer_sources(queries: DataFrame, index: Index, k: int = 10, pool: int = 50, cap: int = 5, net: int = 5, scorer: Callable | None = None) -> DataFrame:
    """query_id, chunk_id, from_net, rank: what a model is given: the reranked pool, capped, and behind it those of the pool's own best ``net``, capped likewise, that it left out."""
    pooled = cut(pool_of(queries, index, pool))  # about pool rows a query, read three times
    top = reranked(queries, pooled, index.passages, cap, k, scorer)
    own = fusion.cap_per_group(pooled, index.passages, cap, net)
    return fusion.with_safety_net(top, own).select("query_id", "chunk_id", "from_net", "rank")


def extractive(text: Column) -> Column:
    """A stand-in for a model: the text of the best source."""
    return F.trim(text)


def answers(queries: DataFrame, sources: DataFrame, passages: DataFrame, generate: Callable[[Column], Column] = extractive) -> DataFrame:
    """query_id, answer, n_sources: a query without sources gets the refusal."""
    n = cut(sources.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.max(F.when(F.col("rank") == 1, F.col("chunk_id"))).alias("chunk_id")))  # a row a query
    best = passages.select("chunk_id", F.col("chunk_text").alias("_t")).join(few(n.select("chunk_id", "query_id")), "chunk_id").select("query_id", "_t")
    j = queries.select("query_id").join(n.select("query_id", "n_sources"), "query_id", "left").join(best, "query_id", "left")
    return j.select("query_id", F.coalesce(generate(F.col("_t")), F.lit(REFUSAL)).alias("answer"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"))


def answered(rows: DataFrame, text: str = "answer") -> DataFrame:
    """The rows that answer: neither null nor the refusal."""
    return rows.where(F.col(text).isNotNull() & ~is_abstention(F.col(text)))


def behaviour(rows: DataFrame, answerable: str = "answerable", category: str = "query_type", text: str = "answer") -> DataFrame:
    """expected (answer or abstain), category (null: all), n, as_expected."""
    expected = F.when(F.col(answerable), "answer").otherwise("abstain")
    right = F.when(F.col(answerable), ~is_abstention(F.col(text))).otherwise(is_abstention(F.col(text)))
    x = rows.where(F.col(answerable).isNotNull()).select(expected.alias("expected"), F.coalesce(category, F.lit("none")).alias("category"), right.alias("ok"))
    out = x.rollup("expected", "category").agg(F.count("*").alias("n"), F.count_if("ok").alias("as_expected"))
    return out.where("expected is not null").withColumn("category", F.coalesce("category", F.lit("all")))


def over_abstention(rows: DataFrame, hits: DataFrame, text: str = "answer") -> DataFrame:
    """hit (a relevant passage was retrieved), answers, abstained: of answerable queries. hits: query_id, hit."""
    x = rows.where("answerable").join(hits, "query_id", "left").select(F.coalesce("hit", F.lit(False)).alias("hit"), is_abstention(F.col(text)).alias("no"))
    return x.groupBy("hit").agg(F.count("*").alias("answers"), F.count_if("no").alias("abstained"))


def harness(queries: DataFrame, done: DataFrame, index: Index, generate: Callable[[Column], Column] = extractive) -> DataFrame:
    """query_id, answer, n_sources of the queries that have no answer yet: run again after a stop, it goes on where it was."""
    todo = queries.join(done.select("query_id").where("query_id is not null").distinct(), "query_id", "left_anti")
    return answers(todo, answer_sources(todo, index), index.passages, generate)
