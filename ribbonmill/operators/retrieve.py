"""Retrieval of passages for batches of queries: search, fuse, cap."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribbonmill.functions import hash_vector
from ribbonmill.operators import dense, fusion, sparse
from ribbonmill.session import cut

MODES = ("dense", "sparse", "hybrid", "rrf")


@dataclass(frozen=True)
class Params:
    """Retrieval parameters with their defaults."""

    mode: str = "hybrid"
    top_k: int = 10
    pool: int = 50
    cap: int = 5
    rrf_k: int = 60
    alpha: float = 0.5


@dataclass
class Index:
    """The tables retrieval reads: passages (chunk_id, doc_id, chunk_text) and their vectors (chunk_id, vector)."""

    passages: DataFrame
    vectors: DataFrame

    @classmethod
    def of(cls, passages: DataFrame, encode=hash_vector) -> Index:
        """An index whose vectors an encoder (a function of a column) makes of the texts. Both are stored, as each is read several times."""
        stored = cut(passages.select("chunk_id", "doc_id", "chunk_text", encode(F.col("chunk_text")).alias("vector")))
        return cls(stored.drop("vector"), stored.select("chunk_id", "vector"))


def pools(queries: DataFrame, index: Index, pool: int, encode=hash_vector) -> tuple[DataFrame, DataFrame]:
    """(dense, sparse) candidate lists of queries (query_id, query)."""
    asked = queries.select("query_id", encode(F.col("query")).alias("vector"))
    return dense.search(asked, index.vectors, pool), sparse.search(queries, index.passages, pool)


def fuse(d: DataFrame, s: DataFrame, p: Params, passages: DataFrame) -> DataFrame:
    """One ranked list of two, by the mode; a fused one has doc_id."""
    if p.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if p.mode == "dense":
        return d
    if p.mode == "sparse":
        return s
    return fusion.weighted(d, s, p.alpha, groups=passages) if p.mode == "hybrid" else fusion.reciprocal_rank([d, s], p.rrf_k, groups=passages)


def retrieve(queries: DataFrame, index: Index, p: Params = Params(), encode=hash_vector) -> DataFrame:
    """query_id, chunk_id, doc_id, score, rank. A query without results has no rows."""
    if p.mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    d, s = pools(queries, index, p.pool, encode)
    out = fusion.cap_per_group(fuse(d, s, p, index.passages), index.passages, p.cap, p.top_k)
    return out.select("query_id", "chunk_id", "doc_id", "score", "rank")
