"""Encoding a corpus with a public byte-level BPE tokenizer, by tree concatenation.

A text up to ``leaf_chars`` is encoded as it is. A longer one is cut into leaves, where it can at a
white space after another character: the tokenizer's own splitting never joins across that place, so
nothing is left to repair there. Long unsplit text has leaves cut inside; leaves are encoded in
parallel as rows of their own and then joined pairwise up a tree, each level of which halves the parts.
At a join a window around it is decoded and encoded again, and grows until its first token is the left
part's and its last token the right part's, in both cases at the same character; beyond these tokens the
parts are then right as they are. The ids are exactly those of the whole text. A text, its leaves and
its ids always fit in a row, as the text does in the table.

Where all of a text's cuts are at white space nothing needs repair, so the faster of two libraries encodes its leaves,
as it does texts of one leaf; the other one, which tells where tokens end, serves texts with a cut inside.

Null and empty texts both give an empty list. Special tokens' strings are ordinary text.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies are; a parameter of every function here.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
#: Longest text, or leaf, that is encoded at once, and the first window of a join, in tokens to either side.
LEAF_CHARS = 4096
WINDOW = 8


@functools.lru_cache(maxsize=4)
def tokenizer(folder: str = TOKENIZERS, name: str = NAME) -> Any:
    """The tokenizer, once a process."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{folder}/{name}.json")
    t.encode_special_tokens = True
    return t


#: Fixed value: how byte-level vocabularies of this kind split a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def fast(folder: str = TOKENIZERS, name: str = NAME) -> Callable[[list[str]], list[list[int]]]:
    """ids of each of some texts; from the vocabulary's file of ranks if there is one, else from the tokenizer."""
    ranks = f"{folder}/{name}.tiktoken"
    if not os.path.exists(ranks):
        t = tokenizer(folder, name)
        return lambda texts: [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
    import base64

    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    e = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return lambda texts: [e.encode_ordinary(x) for x in texts]


def is_free(text: str, cut: int) -> bool:
    """Whether no token can go across the cut."""
    return text[cut] in " \n" and not text[cut - 1].isspace()


def encode(t: Any, text: str) -> tuple[list[int], list[int]]:
    """ids and, for each, the character it ends at (tokens inside a character end at the one's end)."""
    e = t.encode(text, add_special_tokens=False)
    return e.ids, [o[1] for o in e.offsets]


def leaf_cuts(text: str, leaf_chars: int) -> list[int]:
    """Ends of the leaves: before a white space that follows another character if there is one in the leaf's second half, else anywhere."""
    cuts, a, n = [], 0, len(text)
    while n - a > leaf_chars:
        b = a + leaf_chars
        k = next((i for i in range(b, a + leaf_chars // 2, -1) if text[i] in " \n" and not text[i - 1].isspace()), b)
        cuts.append(k)
        a = k
    return [*cuts, n]


def join(t: Any, text: str, left: list[int], left_ends: list[int], right: list[int], right_ends: list[int], cut: int) -> tuple[list[int], list[int]]:
    """The encoding of text from those of text[:cut] and text[cut:]; ends count from the start of each part."""
    if not left or not right or is_free(text, cut):
        return left + right, left_ends + [cut + e for e in right_ends]
    k = WINDOW
    while True:
        i, j = max(0, len(left) - k), min(len(right), k)
        # a window begins and ends where a token ends with a whole character
        while i > 0 and left_ends[i - 1] == left_ends[i]:
            i -= 1
        while j < len(right) and right_ends[j - 1] == right_ends[j]:
            j += 1
        a = left_ends[i - 1] if i else 0
        b = cut + right_ends[j - 1]
        ids, ends = encode(t, text[a:b])
        ends = [a + e for e in ends]
        whole_left, whole_right = i == 0, j == len(right)
        half = max(1, k // 2)
        ok_left = whole_left or (ids[:half] == left[i:i + half] and ends[:half] == left_ends[i:i + half])
        ok_right = whole_right or (ids[-half:] == right[max(0, j - half):j] and ends[-half:] == [cut + e for e in right_ends[max(0, j - half):j]])
        if ok_left and ok_right:
            return left[:i] + ids + right[j:], left_ends[:i] + ends + [cut + e for e in right_ends[j:]]
        k *= 2


def merge_tree(t: Any, text: str, parts: list[tuple[list[int], list[int]]], cuts: list[int]) -> list[int]:
    """ids of text from the encodings of its leaves, joined pairwise level by level."""
    nodes = [(a, b, *p) for a, b, p in zip([0, *cuts], cuts, parts)]
    while len(nodes) > 1:
        up = []
        for x, y in zip(nodes[::2], nodes[1::2]):
            ids, ends = join(t, text[x[0]:y[1]], x[2], x[3], y[2], y[3], x[1] - x[0])
            up.append((x[0], y[1], ids, ends))
        if len(nodes) % 2:
            up.append(nodes[-1])
        nodes = up
    return nodes[0][2] if nodes else []


def encode_text(text: str | None, folder: str = TOKENIZERS, name: str = NAME, leaf_chars: int = LEAF_CHARS) -> list[int]:
    """ids of one text, by the tree, in one process."""
    if not text:
        return []
    cuts = leaf_cuts(text, leaf_chars)
    leaves = [text[a:b] for a, b in zip([0, *cuts], cuts)]
    if all(is_free(text, c) for c in cuts[:-1]):
        return [i for x in fast(folder, name)(leaves) for i in x]
    t = tokenizer(folder, name)
    return merge_tree(t, text, [encode(t, x) for x in leaves], cuts)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """key, ids: one row per row of df, repeated keys included, whatever its other columns.

    Short texts never leave their partition. The leaves of long ones are spread over all tasks and come
    together again by row.
    """
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run = fast(folder, name)
        for b in batches:
            if len(b):
                yield pd.DataFrame({"k": b["k"], "ids": run([x or "" for x in b["t"]])})

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r, r2, k, n, x in zip(b["r"], b["r2"], b["k"], b["n"], b["t"]):
                cuts = leaf_cuts(x, leaf_chars)
                free = all(is_free(x, c) for c in cuts[:-1])
                rows += [(r, r2, k, n, i, free, x[a:c]) for i, (a, c) in enumerate(zip([0, *cuts], cuts))]
            if rows:
                yield pd.DataFrame(rows, columns=["r", "r2", "k", "n", "i", "free", "leaf"])

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        run, t = fast(folder, name), tokenizer(folder, name)
        for b in batches:
            es = [(x, []) if f else encode(t, leaf) for f, leaf, x in zip(b["free"], b["leaf"], run([x if f else "" for f, x in zip(b["free"], b["leaf"])]))]
            yield b.assign(ids=[e[0] for e in es], ends=[e[1] for e in es])

    def rejoin(b: pd.DataFrame) -> pd.DataFrame:
        b = b.drop_duplicates("i").sort_values("i")
        if b["free"].iloc[0]:
            ids = [int(i) for x in b["ids"] for i in x]
        else:
            text_, cuts, at = "".join(b["leaf"]), [], 0
            for x in b["leaf"]:
                at += len(x)
                cuts.append(at)
            ids = merge_tree(tokenizer(folder, name), text_, [(list(i), list(e)) for i, e in zip(b["ids"], b["ends"])], cuts)
        return pd.DataFrame({"k": [b["k"].iloc[0]], "n": [b["n"].iloc[0]], "ids": [ids]})

    is_long = F.coalesce(F.length("t") > leaf_chars, F.lit(False))
    a = src.where(~is_long).mapInPandas(short, f"k {kind}, ids array<int>")
    # leaves meet again by a hash of their row; equal rows are encoded once and come out as often as they are
    whole = src.where(is_long).groupBy("k", "t").agg(F.count("*").alias("n"))
    parts = whole.select(F.xxhash64("k", "t").alias("r"), F.xxhash64(F.lit("second"), "k", "t").alias("r2"), "k", "n", "t")
    parts = parts.mapInPandas(cut_up, f"r long, r2 long, k {kind}, n long, i int, free boolean, leaf string").repartition("r", "i")
    b = parts.mapInPandas(leaves, f"r long, r2 long, k {kind}, n long, i int, free boolean, leaf string, ids array<int>, ends array<int>")
    b = b.groupBy("r", "r2").applyInPandas(rejoin, f"k {kind}, n long, ids array<int>")
    return a.union(b.select("k", "ids", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("k", "ids")).withColumnRenamed("k", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME, keep: tuple[str, ...] = (), leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """key, keep, tokens of every row of df: counted where the row is, so that no text and no ids move."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            texts = [x or "" for x in b["t"]]
            small = fast(folder, name)([x if len(x) <= leaf_chars else "" for x in texts])
            yield b.drop(columns="t").assign(tokens=[len(i) if len(x) <= leaf_chars else len(encode_text(x, folder, name, leaf_chars)) for x, i in zip(texts, small)])

    src = df.select(F.col(key).alias("k"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(keep)], F.col(text).alias("t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "t")
    out = src.mapInPandas(run, f"{schema}, tokens int")
    return out.select(F.col("k").alias(key), *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], "tokens")
