"""Exact and approximate search of vectors."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribbonmill.functions import norm
from ribbonmill.operators import topk


def search(queries: DataFrame, vectors: DataFrame, k: int = 50, query: str = "query_id", query_vector: str = "vector", key: str = "chunk_id", vector: str = "vector") -> DataFrame:
    """query, key, score, rank: the k vectors of largest inner product with each query's. Null vectors match nothing."""
    src = topk.tasks(vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null"))
    kind = dict(vectors.dtypes)[key]
    asked = queries.select(F.col(query).alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null")
    parts, names = [], []
    for rows in topk.blocks(asked, "q", topk.HELD):
        same: dict[tuple, list] = {}
        for r in rows:
            same.setdefault(tuple(r["v"]), []).append(r["q"])
        m, base = np.array(list(same)), len(names)
        names += same.values()

        def run(batches: Iterator[pa.RecordBatch], m=m, base=base) -> Iterator[pa.RecordBatch]:
            best = topk.Best(len(m), k)
            for b in batches:
                if not len(b):
                    continue
                first = best.see(b.column(0))
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
                for i in range(0, len(x), topk.ROWS):
                    part = np.ascontiguousarray(x[i : i + topk.ROWS].T)
                    for a in range(0, len(m), topk.QUERIES):
                        best.add(a, first + i, m[a : a + topk.QUERIES] @ part)
            yield from best.batches(base)

        parts.append(src.mapInArrow(run, f"u int, id {kind}, score double"))
    if not parts:
        return queries.select(F.col(query), F.lit(None).cast(kind).alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    return topk.merged(reduce(DataFrame.union, parts), k, names, queries.schema[query], query, key)


#: Bound of the sample of vectors on which the lists' centres are fitted.
SAMPLE = 20_000


def centres(vectors: DataFrame, k: int = 10, vector: str = "vector", lists: int | None = None, recall: float = 0.95, seed: int = 17) -> tuple[np.ndarray, int]:
    """Centres of an inverted file's lists, and how many of its nearest lists a query must probe.

    The centres are the means of a k-means of unit vectors on at most SAMPLE of them, about the root of their
    number. The number of probes is the least by which as many sampled vectors, as queries against the sample, find
    the share ``recall`` of their k nearest; vectors without structure need most lists, clustered ones a few.
    """
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    n = rows.count()
    rows = rows.orderBy(F.xxhash64("v")).limit(SAMPLE) if n > SAMPLE else rows
    x = np.array([r[0] for r in rows.collect()]) if n else np.zeros((1, 1))
    order = np.random.default_rng(seed).permutation(len(x))
    c = x[order[: lists or max(1, min(1024, round(len(x) ** 0.5)))]]
    for _ in range(8):
        near = (x @ c.T).argmax(1)
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        length = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(length > 0, s / np.maximum(length, 1e-12), c)
    asked = x[order[-500:]]
    best = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    at = np.argsort(np.argsort(-(asked @ c.T), axis=1, kind="stable"), axis=1)  # the rank of each list for each query
    near = (x @ c.T).argmax(1)
    rank = np.sort(at[np.arange(len(asked))[:, None], near[best]].ravel())
    return c, int(rank[min(len(rank) - 1, int(np.ceil(recall * len(rank))))]) + 1


def approximate(queries: DataFrame, vectors: DataFrame, k: int = 10, query: str = "query_id", key: str = "chunk_id", vector: str = "vector", lists: int | None = None, recall: float = 0.95) -> DataFrame:
    """Approximate search by an inverted file: every vector is in the list of its nearest centre, and a query is compared exactly with as many lists as reach ``recall`` on a sample.

    Only rows in the lists probed are compared, and each task passes on k a query of them; recall is measured by
    ``agreement``. Queries are taken in blocks, as in the exact search.
    """
    c, probes = centres(vectors, k, vector, lists, recall)
    kinds = dict(queries.dtypes)[query], dict(vectors.dtypes)[key]
    src = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    asked = queries.select(F.col(query).alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    parts = []
    for rows in topk.blocks(asked, "q"):
        names, m = [r["q"] for r in rows], np.array([r["v"] for r in rows])
        probed = np.argsort(-(m @ c.T), axis=1, kind="stable")[:, :probes]
        by_list = {j: np.flatnonzero((probed == j).any(1)) for j in range(len(c))}

        def run(batches: Iterator[pd.DataFrame], m=m, names=names, by_list=by_list) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                x, ids = np.stack(b["v"].to_numpy()), b["id"].to_numpy()
                near = (x @ c.T).argmax(1)
                for j in np.unique(near):
                    at, q = np.flatnonzero(near == j), by_list[int(j)]
                    if len(q):
                        yield topk.candidates(ids[at], m[q] @ x[at].T, [names[i] for i in q], k)

        parts.append(src.mapInPandas(run, f"query {kinds[0]}, id {kinds[1]}, score double"))
    if not parts:
        return search(queries, vectors, k, query, vector, key, vector)
    out = topk.ranked(reduce(DataFrame.union, parts), "query", "id", k)
    return out.select(F.col("query").alias(query), F.col("id").alias(key), "score", "rank")


def agreement(exact: DataFrame, other: DataFrame, query: str = "query_id", key: str = "chunk_id") -> DataFrame:
    """query, same_top, recall, jaccard of two ranked lists."""
    a = exact.groupBy(query).agg(F.collect_set(key).alias("a"), F.min(F.when(F.col("rank") == 1, F.col(key))).alias("ta"))
    b = other.groupBy(query).agg(F.collect_set(key).alias("b"), F.min(F.when(F.col("rank") == 1, F.col(key))).alias("tb"))
    both = F.size(F.array_intersect("a", "b"))
    return a.join(b, query, "left").select(query, F.coalesce(F.col("ta") == F.col("tb"), F.lit(False)).alias("same_top"), F.coalesce(both / F.size("a"), F.lit(0.0)).alias("recall"), F.coalesce(both / F.size(F.array_union("a", "b")), F.lit(0.0)).alias("jaccard"))


def norms(vectors: DataFrame, vector: str = "vector") -> DataFrame:
    """vectors, min, max, mean norm, and how many are off unit length by more than a hundredth."""
    n = norm(F.col(vector))
    r = lambda c, name: F.round(c, 6).alias(name)
    return vectors.agg(F.count("*").alias("vectors"), r(F.min(n), "min_norm"), r(F.max(n), "max_norm"), r(F.avg(n), "mean_norm"), F.count_if(~n.between(0.99, 1.01)).alias("off_unit"))


def same_group_cosine(vectors: DataFrame, group: str, vector: str = "vector") -> DataFrame:
    """same_group, pairs, mean_cosine of unit vectors over all ordered pairs of different rows, without forming a pair.

    The sum of cosines of all pairs of a set is the squared norm of its sum; so only a sum a group moves.
    """
    v = vectors.select(F.col(group).alias("g"), F.posexplode(F.col(vector)).alias("i", "x")).where("g is not null")
    sums = v.groupBy("g", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("own"), F.count("*").alias("n"))
    per = sums.groupBy("g").agg(F.sum(F.col("s") * F.col("s")).alias("sq"), F.sum("own").alias("own"), F.max("n").alias("n"))
    same = per.agg(F.sum(F.col("sq") - F.col("own")).alias("c"), F.sum(F.col("n") * (F.col("n") - 1)).alias("p"))
    total = sums.groupBy("i").agg(F.sum("s").alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("sq"))
    every = per.agg(F.sum("sq").alias("sq_g"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"))
    one = same.select(F.lit(True).alias("same_group"), F.col("p").cast("long").alias("pairs"), F.round(F.col("c") / F.nullif("p", F.lit(0)), 6).alias("mean_cosine"))
    cross = F.col("n") * F.col("n") - F.col("n2")
    two = total.crossJoin(every).select(F.lit(False).alias("same_group"), cross.cast("long").alias("pairs"), F.round((F.col("sq") - F.col("sq_g")) / F.nullif(cross, F.lit(0)), 6).alias("mean_cosine"))
    return one.union(two)
