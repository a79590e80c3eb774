"""Column functions, all built of JVM-side expressions unless a docstring says otherwise."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Lower-case tokens between white space; null and blank texts have none."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != "")


def token_count(c: Column) -> Column:
    """Number of tokens."""
    return F.size(tokens(c))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(dot(v, v))


def bound(c: Column, f) -> Column:
    """f(c) with c computed once, however often f uses it."""
    return F.transform(F.array(c), f)[0]


def l2_normalise(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return bound(F.struct(v.alias("v"), norm(v).alias("n")), lambda s: F.transform(s["v"], lambda x: F.when(s["n"] > 0, x.cast("double") / s["n"]).otherwise(F.lit(0.0))))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The tokens of lower-case texts without nulls, as ``tokens`` has them: of each token the number of its text and of its word, and the words."""
    parts = pc.ascii_split_whitespace(texts)
    codes = parts.flatten().dictionary_encode()
    at, known = codes.indices.to_numpy(), codes.dictionary.to_pylist()
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy())
    if "" in known:  # before the first and behind the last white space
        there = at != known.index("")
        at, row = at[there], row[there]
    return row, at, known


def _hash_vectors(texts: pa.Array) -> pa.Array:
    row, at, known = words(texts)
    digit = np.array([hashlib.md5(w.encode()).digest()[0] >> 4 for w in known], int)
    v = np.bincount(row * 16 + digit[at], minlength=16 * len(texts)).reshape(-1, 16).astype(float)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    v = np.divide(v, n, out=np.zeros_like(v), where=n > 0)
    return pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, 16, dtype=np.int32)), pa.array(v.ravel()))


def hash_vector(c: Column) -> Column:
    """A stand-in for an encoder: token counts over the 16 first hexadecimal digits of the tokens' md5, at length 1. In Arrow batches: a word is hashed once a batch."""
    encode = F.arrow_udf(_hash_vectors, "array<double>").asNondeterministic()  # else a filter would compute it once more
    return encode(F.lower(F.coalesce(c, F.lit(""))))


def places(c: Column, terms: list[str]) -> Column:
    """The places in terms of a text's tokens, each once. In Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        row, at, known = words(texts)
        place = pc.index_in(pa.array(known, pa.string()), pa.array(terms, pa.string())).fill_null(-1).to_numpy()[at]
        row, place = np.divmod(np.unique(row[place >= 0] * max(len(terms), 1) + place[place >= 0]), max(len(terms), 1))
        off = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(place.astype(np.int32)))

    return F.arrow_udf(run, "array<int>").asNondeterministic()(F.lower(F.coalesce(c, F.lit(""))))


def present(c: Column) -> Column:
    """The string, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def round6(c: Column) -> Column:
    """Scores are compared and ranked at six decimals, so that the order of summation doesn't matter."""
    return F.round(c, 6)
