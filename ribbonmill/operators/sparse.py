"""BM25 over an inverted index of plain tables, and search of query blocks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribbonmill.functions import tokens, words
from ribbonmill.operators import topk
from ribbonmill.session import cut


@dataclass(frozen=True)
class BM25:
    """Parameters: saturation, length normalisation, and the share of the mean idf that replaces a negative one."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25


def postings(df: DataFrame, key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """term, key, tf."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def lengths(df: DataFrame, key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """key, dl: tokens of each text."""
    return df.select(key, F.size(tokens(F.col(text))).cast("long").alias("dl"))


def _read(df: DataFrame, key: str, text: str, asked: list[str] | None) -> DataFrame:
    """One pass over the texts: term, df, dl of each batch, where the row without a term has the number of texts and of their tokens; with ``asked`` also, where df is null, id, dl, t, f of each text: the places in asked of the terms that it holds, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(b)
            if not n:
                continue
            row, at, known = words(b.column(1))
            dl = np.bincount(row, minlength=n)
            pair, tf = np.unique(row * max(len(known), 1) + at, return_counts=True)
            row, at = np.divmod(pair, max(len(known), 1))
            df = np.bincount(at, minlength=len(known))
            some = np.flatnonzero(df)
            cols = [pa.array([*pa.array(known, pa.string()).take(pa.array(some)).to_pylist(), None], pa.string()), pa.array([*df[some], n], pa.int64()), pa.array([*[0] * len(some), dl.sum()], pa.int64())]
            if asked is None:
                yield pa.RecordBatch.from_arrays(cols, ["term", "df", "dl"])
                continue
            m = len(cols[0])
            none = [pa.nulls(m, x) for x in (b.column(0).type, pa.list_(pa.int32()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*cols, *none], ["term", "df", "dl", "id", "t", "f"])
            place = pc.index_in(pa.array(known, pa.string()), pa.array(asked, pa.string())).fill_null(-1).to_numpy()[at]
            hit = place >= 0
            off = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=n))]).astype(np.int32))
            t, f = (pa.ListArray.from_arrays(off, pa.array(x[hit].astype(np.int32))) for x in (place, tf))
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()), pa.array(dl.astype(np.int64)), b.column(0), t, f], ["term", "df", "dl", "id", "t", "f"])

    src = df.select(F.col(key).alias("id"), F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    return src.mapInArrow(run, "term string, df long, dl long" + ("" if asked is None else f", id {dict(src.dtypes)['id']}, t array<int>, f array<int>"))


def _weighed(counts: DataFrame, p: BM25) -> DataFrame:
    d = cut(counts.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")))
    total = d.where("term is null").select(F.col("df").alias("n"), (F.col("dl") / F.col("df")).alias("mean"))  # one row
    raw = d.where("term is not null").crossJoin(F.broadcast(total)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    low = raw.select((p.epsilon * F.avg("raw")).alias("low"))  # one row
    idf = F.when(F.col("raw") < 0, F.col("low")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(low)).select("term", "df", idf.alias("idf"), "mean")


def corpus_stats(df: DataFrame, text: str = "chunk_text", p: BM25 = BM25()) -> DataFrame:
    """term, df, idf, mean (tokens of a text) of every term, in one pass over the texts; a negative idf is replaced by epsilon times the mean over all terms."""
    return _weighed(_read(df, text, text, None), p)


def term_stats(df: DataFrame, text: str = "chunk_text", p: BM25 = BM25()) -> DataFrame:
    """term, df, idf of every term."""
    return corpus_stats(df, text, p).select("term", "df", "idf")


def search(queries: DataFrame, df: DataFrame, k: int = 50, query: str = "query_id", query_text: str = "query", key: str = "chunk_id", text: str = "chunk_text", p: BM25 = BM25()) -> DataFrame:
    """query, key, score, rank: the k best texts of each query. Texts that share no term with it aren't results.

    One pass over the texts counts the terms' texts and takes out how often each text has a query's terms; these
    postings are stored, and each task multiplies them by the queries' weights, for all queries alike. Queries that
    share terms are taken together, so that a step multiplies by those terms only; a task passes on k rows a query.

    Null and blank texts count in the number of texts and match nothing; a null or blank query has no results.
    """
    kind = dict(df.dtypes)[key]
    counted: dict = {}
    for r in queries.select(F.col(query).alias("q"), tokens(F.col(query_text)).alias("t")).collect():
        counted.setdefault(r["q"], Counter()).update(r["t"])
    often = Counter(t for c in counted.values() for t in c)
    same: dict[tuple, list] = {}
    for q, c in counted.items():
        if c:
            same.setdefault(tuple(sorted(c.items(), key=lambda x: (-often[x[0]], x[0]))), []).append(q)
    if not same:
        return queries.select(F.col(query), F.lit(None).cast(kind).alias(key), F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    asked = sorted(same, key=lambda x: [(-often[t], t) for t, _ in x])  # queries of one wording, and so of the same terms, come together
    terms = list(often)
    place = {t: i for i, t in enumerate(terms)}
    read = cut(_read(df, key, text, terms))
    own_terms = df.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    stats = _weighed(read.where("df is not null"), p).join(own_terms, "term", "left_semi").collect()
    idf, mean = np.zeros(len(terms)), stats[0]["mean"] if stats else 1.0
    for r in stats:
        idf[place[r["term"]]] = r["idf"]
    src = topk.tasks(read.where("df is null").select("id", "dl", "t", "f"))
    parts = []
    for at in range(0, len(asked), topk.HELD):
        rows = [[(place[t], n * idf[place[t]]) for t, n in c] for c in asked[at : at + topk.HELD]]
        groups = []
        for a in range(0, len(rows), topk.QUERIES):
            own = np.unique([t for c in rows[a : a + topk.QUERIES] for t, _ in c])
            w, there = np.zeros((2, len(rows[a : a + topk.QUERIES]), len(own)))
            for i, c in enumerate(rows[a : a + topk.QUERIES]):
                j = np.searchsorted(own, [t for t, _ in c])
                w[i, j], there[i, j] = [x for _, x in c], 1
            groups.append((a, own, w, there if (w[there > 0] <= 0).any() else None))
        n_terms = len(terms)

        def run(batches: Iterator[pa.RecordBatch], groups=groups, n=len(rows), base=at) -> Iterator[pa.RecordBatch]:
            positive = all(g[3] is None for g in groups)
            best = topk.Best(n, k, 5e-324 if positive else float(np.finfo(float).min))
            for b in batches:
                if not len(b):
                    continue
                first = best.see(b.column(0))
                dl, off = b.column(1).to_numpy(), b.column(2).offsets.to_numpy()
                t, f = (b.column(i).flatten().to_numpy() for i in (2, 3))
                off, doc = off - off[0], np.repeat(np.arange(len(b)), pc.list_value_length(b.column(2)).to_numpy())
                part = f * (p.k1 + 1) / (f + p.k1 * (1 - p.b + p.b * dl[doc] / mean))
                for i in range(0, len(b), topk.ROWS):
                    j = min(i + topk.ROWS, len(b))
                    s = np.zeros((n_terms, j - i))
                    s[t[off[i] : off[j]], doc[off[i] : off[j]] - i] = part[off[i] : off[j]]
                    for a, own, w, there in groups:
                        x = s[own]
                        score = w @ x
                        if not positive:
                            score[(w != 0 if there is None else there) @ (x > 0).astype(float) == 0] = -np.inf
                        best.add(a, first + i, score)
            yield from best.batches(base)

        parts.append(src.mapInArrow(run, f"u int, id {kind}, score double"))
    return topk.merged(reduce(DataFrame.union, parts), k, [same[c] for c in asked], queries.schema[query], query, key)
