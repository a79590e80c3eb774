"""Repetition inside a single document, and n-gram perplexity.

The share of repeated text. A document is a row of tokens: words, or characters in scripts without
spaces, without case, spacing, list numbers and marks. A token is repeated if it lies in a phrase of
``PHRASE`` words (twice as many characters in unspaced scripts) that occurred before in the document, or
in a line or sentence of at least ``SHORT`` words that did. Single words and ordinary turns of phrase are
shorter than that. The share is that of repeated tokens.

Perplexity. A modified Kneser-Ney trigram model is counted in Spark, over hashes of the n-grams, and kept
as tables by hash that hold every entry and are joined, nowhere collected or broadcast as a whole: each
distinct trigram gets its log probability once, which the documents' trigrams are then joined with. Documents
outside their language's band of perplexity are rejected. A corpus model doesn't see what a document itself repeats: see README for how far the bands
find repetitive documents, and why the share above decides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribbonmill.session import cut

PHRASE, SHORT = 8, 4
#: Scripts without spaces between words.
UNSPACED = "฀-๿぀-ヿ㐀-鿿"
_TOKEN = re.compile(rf"[{UNSPACED}]|[^\W_](?:[^\W_{UNSPACED}]|[̀-ͯऀ-ॿ‌‍])*|\n|[.!?。！？।]+(?=\s|$|[{UNSPACED}\"'”’»」])")
_LIST_NUMBER = re.compile(r"^[ \t]*(?:\(?\d{1,3}[.)]|\(\d+\)|[-*•–—+☐])[ \t]+", re.M)
_UNSPACED = re.compile(f"[{UNSPACED}]")
_BREAKS = re.compile("\r\n?|[\x0b\x0c\x85\u2028\u2029]")


def tokens(text: str) -> tuple[list[str], list[int]]:
    """Tokens of a text and the unit (line or sentence) each is in."""
    t = _LIST_NUMBER.sub("", _BREAKS.sub("\n", text)).lower()
    out, unit, u = [], [], 0
    for x in _TOKEN.findall(t):
        if x[0].isalnum() or x[0] > "ऀ" and x[0] not in "।。！？":
            out.append(x)
            unit.append(u)
        else:
            u += 1
    return out, unit


def repeated_share(text: str | None) -> float:
    """Share of a text's tokens that repeat earlier text; 0 for null, empty and blank texts."""
    if not text:
        return 0.0
    w, unit = tokens(text)
    n = len(w)
    if n < 2 * SHORT:
        return 0.0
    unspaced = sum(1 for x in w if len(x) == 1 and _UNSPACED.match(x)) > 0.5 * n
    size, short = (2 * PHRASE, 3 * SHORT) if unspaced else (PHRASE, SHORT)
    hit = bytearray(n)
    ids: dict[str, int] = {}
    a = np.fromiter((ids.setdefault(x, len(ids)) for x in w), np.uint64, n)
    if n > size:
        h = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + a[i : n - size + 1 + i] + np.uint64(1)
        _, first, back = np.unique(h, return_index=True, return_inverse=True)
        for i in np.flatnonzero(first[back] < np.arange(len(h))):
            hit[i : i + size] = b"\x01" * size
    seen: set[tuple[str, ...]] = set()
    i = 0
    while i < n:
        j = i
        while j < n and unit[j] == unit[i]:
            j += 1
        if j - i >= short:
            k = tuple(w[i:j])
            if k in seen:
                hit[i:j] = b"\x01" * (j - i)
            seen.add(k)
        i = j
    if unspaced:  # characters count there, not words
        return sum(len(x) for x, y in zip(w, hit) if y) / sum(map(len, w))
    return sum(hit) / n


def shares(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, repeated_share of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"k": b["k"], "repeated_share": [repeated_share(t) for t in b["t"]]})

    src = documents.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInPandas(run, f"k {src.schema['k'].dataType.simpleString()}, repeated_share double").withColumnRenamed("k", key)


def found(documents: DataFrame, least: float = 0.3, key: str = "doc_id") -> DataFrame:
    """Keys of the documents of which at least ``least`` is repeated."""
    return shares(documents, key).where(F.col("repeated_share") >= least).select(key).distinct()


# the model

_K = np.uint64(0x9E3779B97F4A7C15)


def _hashes(text: str) -> np.ndarray:
    w, _ = tokens(text)
    return np.fromiter((xxhash.xxh64_intdigest(x) for x in ["<s>", "<s>", *w]), np.uint64, len(w) + 2)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K + b
    return x ^ (x >> np.uint64(31))


def ngram_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """o (order), h (hash), p (its context's hash), s (hash without its first word), n: all n-grams of orders 1 to 3, combined by task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = {1: [], 2: [], 3: []}
            for t in b["t"]:
                h = _hashes(t)
                if len(h) < 3:
                    continue
                bi = _mix(h[:-1], h[1:])
                parts[1].append(np.stack([h[2:], np.zeros(len(h) - 2, np.uint64), np.zeros(len(h) - 2, np.uint64)]))
                parts[2].append(np.stack([bi[1:], h[1:-1], h[2:]]))
                parts[3].append(np.stack([_mix(bi[:-1], h[2:]), bi[:-1], bi[1:]]))
            for o, x in parts.items():
                if x:
                    v = np.concatenate(x, 1)
                    _, i, n = np.unique(v[0], return_index=True, return_counts=True)
                    yield pd.DataFrame({"o": np.int32(o), "h": v[0][i].view(np.int64), "p": v[1][i].view(np.int64), "s": v[2][i].view(np.int64), "n": n.astype(np.int64)})

    raw = documents.select(F.col(text).alias("t")).where("t is not null").mapInPandas(run, "o int, h long, p long, s long, n long")
    return raw.groupBy("o", "h").agg(F.first("p").alias("p"), F.first("s").alias("s"), F.sum("n").alias("n"))


class Model:
    """Tables of all n-grams of a corpus, none dropped: discounted probabilities of trigrams and bigrams (a3, a2: h, v), back-off weights of their contexts (g3, g2), probabilities of words (p1)."""

    def __init__(self, tables: dict[str, DataFrame], unknown: float, grams: DataFrame) -> None:
        self.tables, self.unknown, self.grams = tables, unknown, grams

    def get(self, df: DataFrame, name: str, h: str, default: float) -> DataFrame:
        """df with column name: the table's value at hash h, or the default."""
        t = self.tables[name].select(F.col("h").alias(h), F.col("v").alias(name))
        return df.join(t, h, "left").withColumn(name, F.coalesce(name, F.lit(default)))

    def scores(self, grams: DataFrame) -> DataFrame:
        """h, v: the log probability of each trigram of grams, which is what ngram_counts gives."""
        bi = grams.where("o = 2").select("h", "p", F.col("s").alias("w"))
        bi = self.get(self.get(self.get(bi, "a2", "h", 0.0), "g2", "p", 1.0), "p1", "w", self.unknown)
        bi = bi.select(F.col("h").alias("s"), (F.col("a2") + F.col("g2") * F.col("p1")).alias("p2"))
        tri = grams.where("o = 3").select("h", "p", "s")
        tri = self.get(self.get(tri, "a3", "h", 0.0), "g3", "p", 1.0).join(bi, "s")
        return tri.select("h", F.log(F.greatest(F.col("a3") + F.col("g3") * F.col("p2"), F.lit(1e-12))).alias("v"))

    def perplexity(self, text: str | None) -> float | None:
        """Perplexity of a text; null without tokens."""
        one = self.grams.sparkSession.createDataFrame([(text,)], "text string")
        return _by_text(one.withColumnRenamed("text", "t"), self.scores(ngram_counts(one))).agg(F.max("perplexity")).first()[0]


def _text_id() -> list[Column]:
    """Two hashes of a text that together identify it."""
    return [F.xxhash64("t").alias("t1"), F.crc32(F.encode("t", "utf-8")).alias("t2")]


def _by_text(texts: DataFrame, scores: DataFrame) -> DataFrame:
    """t1, t2, perplexity of each text in column t that has tokens. A text given more than once weighs all its n-grams more, which leaves their mean."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, grams, counts = [], [], []
            for i, t in enumerate(b["t"]):
                h = _hashes(t)
                if len(h) < 3:
                    continue
                g, n = np.unique(_mix(_mix(h[:-2], h[1:-1]), h[2:]), return_counts=True)
                keys.append(np.full(len(g), i))
                grams.append(g)
                counts.append(n)
            if keys:
                k = np.concatenate(keys)
                yield pd.DataFrame({"t1": b["t1"].to_numpy()[k], "t2": b["t2"].to_numpy()[k], "h": np.concatenate(grams).view(np.int64), "n": np.concatenate(counts).astype(np.int32)})

    src = texts.where("t is not null").select(*_text_id(), "t")
    grams = src.mapInPandas(run, "t1 long, t2 long, h long, n int")
    total = grams.join(scores, "h").groupBy("t1", "t2").agg(F.sum(F.col("n") * F.col("v")).alias("v"), F.sum("n").alias("n"))
    return total.select("t1", "t2", F.exp(-F.col("v") / F.col("n")).alias("perplexity"))


def _discounts(c: dict[int, int]) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (max(1, c.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    return max(0.1, 1 - 2 * y * n2 / n1), max(0.1, 2 - 3 * y * n3 / n2), max(0.1, 3 - 4 * y * n4 / n3)


def train(documents: DataFrame) -> Model:
    """The modified Kneser-Ney model of a corpus: counts and tables over all of it."""
    grams = cut(ngram_counts(documents))
    tri, bi = grams.where("o = 3"), grams.where("o = 2")
    # continuation counts: distinct words before
    bi = cut(bi.join(tri.groupBy(F.col("s").alias("h")).agg(F.count("*").alias("c")), "h", "left").select("h", "p", "s", F.coalesce("c", F.lit(1)).alias("n")))
    uni = cut(grams.where("o = 1").select("h").join(grams.where("o = 2").groupBy(F.col("s").alias("h")).agg(F.count("*").alias("n")), "h", "left").select("h", F.coalesce("n", F.lit(1)).alias("n")))
    tables: dict[str, DataFrame] = {}
    for name, df in (("3", tri), ("2", bi)):
        d1, d2, d3 = _discounts({r["n"]: r["c"] for r in df.where("n <= 4").groupBy("n").agg(F.count("*").alias("c")).collect()})
        d = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        ctx = df.groupBy("p").agg(F.sum("n").alias("total"), F.sum(d).alias("lost"))
        tables["a" + name] = df.join(ctx, "p").select("h", ((F.col("n") - d) / F.col("total")).alias("v"))
        tables["g" + name] = ctx.select(F.col("p").alias("h"), (F.col("lost") / F.col("total")).alias("v"))
    t = uni.agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    total, kinds = (t["n"] or 0) + 1, (t["k"] or 0) + 1
    tables["p1"] = uni.select("h", ((F.col("n") - 0.75) / total + 0.75 * (kinds - 1) / total / kinds).alias("v"))
    return Model(tables, 0.75 * (kinds - 1) / total / kinds + 1e-9, grams)


def perplexities(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: Column | None = None, low: float = 0.02, high: float = 0.98, model: Model | None = None) -> DataFrame:
    """key, lang, perplexity, lower, upper, rejected: bands are the quantiles low and high of each language."""
    texts = documents.select(F.col(text).alias("text"))
    own = model is None
    model = model or train(texts)
    language = F.coalesce(F.lower(F.trim(F.col("lang"))) if lang is None else lang, F.lit(""))
    src = documents.select(F.col(key).alias("k"), language.alias("lang"), F.col(text).alias("t"))
    by = _by_text(src, model.scores(model.grams if own else ngram_counts(texts)))
    p = cut(src.select("k", "lang", *_text_id()).join(by, ["t1", "t2"], "left").select("k", "lang", "perplexity"))
    band = p.groupBy("lang").agg(F.percentile_approx("perplexity", [low, high], 1000).alias("b"))
    out = p.join(F.broadcast(band), "lang", "left")  # a row a language
    return out.select(F.col("k").alias(key), "lang", "perplexity", F.col("b")[0].alias("lower"), F.col("b")[1].alias("upper"), F.coalesce((F.col("perplexity") < F.col("b")[0]) | (F.col("perplexity") > F.col("b")[1]), F.lit(False)).alias("rejected"))
