"""Exact top-k of a block of queries against all rows.

Each task scores its rows against the block, holds the k best of each query (``Best``) and passes them on at its
end; ``merged`` makes one ranked list of the tasks'. What moves is k rows a query and task, whatever the number of
rows. The queries of a block travel with the function; larger query sets are taken block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField
from pyspark.sql.window import Window

BLOCK = 1024
#: Queries whose k best a task holds at once.
HELD = 16_384
#: Queries, and rows, whose scores are computed in one step.
QUERIES, ROWS = 128, 2048
#: Scores that are equal at six decimals differ by less.
MARGIN = 1.1e-6


def blocks(queries: DataFrame, key: str, size: int = BLOCK) -> Iterator[list]:
    """The rows of queries, at most about ``size`` at a time, in blocks by a hash of the key."""
    n = queries.count()
    k = max(1, -(-n // size))
    for i in range(k):
        rows = queries.where(F.pmod(F.xxhash64(F.col(key)), F.lit(k)) == i).collect()
        if rows:
            yield sorted(rows, key=lambda r: str(r[key]))


def candidates(ids: np.ndarray, scores: np.ndarray, names: list, k: int, least: float | None = None) -> pd.DataFrame:
    """query, id, score of the rows of a batch (scores: queries by rows) that may be in a query's k best."""
    s = np.round(scores, 6) + 0.0
    ids = np.asarray(ids, dtype=object)
    if s.shape[1] > k:
        kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
        hit = s >= kth
    else:
        hit = np.ones(s.shape, bool)
    if least is not None:
        hit &= s > least
    q, r = np.nonzero(hit)
    return pd.DataFrame({"query": pd.Series([names[i] for i in q], dtype=object), "id": pd.Series(ids[r], dtype=object), "score": s[q, r]})


def ranked(df: DataFrame, query: str, key: str, k: int, score: str = "score") -> DataFrame:
    """The k best rows of each query with rank 1 to k: by score, then key."""
    w = Window.partitionBy(query).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def round_half_up(x: np.ndarray) -> np.ndarray:
    """At six decimals, halves away from 0 as in SQL."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5), x) / 1e6 + 0.0


class Best:
    """The k best of a task's rows for each of n queries: by score at six decimals, then id.

    A row is held if it isn't under the k-th best score seen so far. The rows held are cut to the k best when
    there are over three times as many, so memory is bounded by n and k. ``floor``: the least score that counts.
    """

    def __init__(self, n: int, k: int, floor: float = float(np.finfo(float).min)):
        self.n, self.k = n, k
        self.least = np.full(n, floor)
        self.held: dict[int, list[tuple]] = {}
        self.count: dict[int, int] = {}
        self.ids: list[pa.Array] = []
        self.rows = 0

    def see(self, ids: pa.Array) -> int:
        """Takes on the ids of a batch; the number of its first row."""
        if self.rows > max(1 << 20, 2 * self.n * self.k):
            self._forget()
        self.ids.append(ids)
        self.rows += len(ids)
        return self.rows - len(ids)

    def add(self, a: int, first: int, scores: np.ndarray) -> None:
        """scores: of the queries from a on, by the rows from first on."""
        low, (m, n) = self.least[a : a + len(scores)], scores.shape
        if a not in self.held and n > self.k:
            np.maximum(low, np.partition(scores, n - self.k, axis=1)[:, n - self.k] - MARGIN, out=low)
        q, r = np.divmod(np.flatnonzero(scores >= low[:, None]), n)
        self.held.setdefault(a, []).append((q, r + first, scores[q, r]))
        self.count[a] = self.count.get(a, 0) + len(q)
        if self.count[a] > 3 * self.k * m:
            self._cut(a)

    def _cut(self, a: int) -> None:
        q, r, s = (np.concatenate(x) for x in zip(*self.held[a]))
        s = round_half_up(s)
        order = np.lexsort((-s, q))
        q, r, s = q[order], r[order], s[order]
        start = np.searchsorted(q, np.arange(q[-1] + 1 if len(q) else 0))
        end = np.append(start[1:], len(q))
        kth, over = np.full(len(start), -np.inf), np.zeros(len(start), bool)
        full = np.flatnonzero(end - start >= self.k)
        kth[full] = s[start[full] + self.k - 1]
        at = np.arange(len(q)) - start[q]
        # queries whose k-th score more rows share: of those the first by id
        full = np.flatnonzero(end - start > self.k)
        over[full] = s[start[full] + self.k] == kth[full]
        tie = np.flatnonzero(over[q] & (s == kth[q]))
        if len(tie):
            r[tie] = r[tie][np.lexsort((self._order(r[tie]), q[tie]))]
        keep = at < self.k
        self.held[a], self.count[a] = [(q[keep], r[keep], s[keep])], int(keep.sum())
        low = self.least[a : a + len(kth)]
        np.maximum(low, kth - MARGIN, out=low)

    def _all(self) -> pa.Array:
        if len(self.ids) > 1:
            self.ids = [pa.concat_arrays(self.ids)]
        return self.ids[0]

    def _order(self, rows: np.ndarray) -> np.ndarray:
        return pc.rank(self._all().take(pa.array(rows)), tiebreaker="first").to_numpy()

    def _forget(self) -> None:
        """Drops the ids of rows that aren't held any more."""
        for a in self.held:
            self._cut(a)
        used = np.unique(np.concatenate([x[1] for h in self.held.values() for x in h] or [np.zeros(0, int)]))
        self.ids, self.rows = [self._all().take(pa.array(used))], len(used)
        self.held = {a: [(q, np.searchsorted(used, r), s) for q, r, s in h] for a, h in self.held.items()}

    def batches(self, base: int) -> Iterator[pa.RecordBatch]:
        """u (number of a query, from base on), id, score."""
        for a in self.held:
            self._cut(a)
            (q, r, s), *_ = self.held[a]
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array((q + a + base).astype(np.int32)), self._all().take(pa.array(r)), pa.array(s)], ["u", "id", "score"])


def merged(parts: DataFrame, k: int, names: list[list], field: StructField, query: str, key: str) -> DataFrame:
    """query, key, score, rank of u, id, score: the k best of each u, once for each of names[u]. field: that of the queries' key."""
    kind, name_kind = dict(parts.dtypes)["id"], to_arrow_type(field.dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        t = pa.Table.from_batches(got).sort_by([("u", "ascending"), ("score", "descending"), ("id", "ascending")]).combine_chunks()
        u = t["u"].to_numpy()
        rank = np.arange(len(u)) - np.searchsorted(u, u) + 1
        at = np.flatnonzero(rank <= k)
        n = np.array([len(x) for x in names])
        at = np.repeat(at, n[u[at]])
        new = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        which = np.arange(len(at)) - np.repeat(new, np.diff(np.append(new, len(at))))
        begin = np.concatenate([[0], np.cumsum(n)[:-1]])[u[at]]
        q = pa.array([y for x in names for y in x], name_kind).take(pa.array(begin + which))
        t = pa.Table.from_arrays([q, t["id"].take(pa.array(at)), t["score"].take(pa.array(at)), pa.array(rank[at].astype(np.int32))], ["query", "id", "score", "rank"])
        yield from t.to_batches(10_000)

    out = parts.repartition("u").mapInArrow(run, f"query {field.dataType.simpleString()}, id {kind}, score double, rank int")
    return out.select(F.col("query").alias(query), F.col("id").alias(key), "score", "rank")


def tasks(df: DataFrame) -> DataFrame:
    """df in no more parts than there are cores: each part passes on k rows a query."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)
