"""Splitting oversized items at natural boundaries, by dynamic programming over boundary positions.

A token is a character of a script without spaces, or a longest run of other characters that aren't
white space. A cut after token i costs by what stands there: nothing between paragraphs, little at line
ends and sentence ends, more at clauses, most between words or characters. Among all ways to cut that
keep every piece under the limit, the overlap included, the one with the least sum of cut costs and
squared imbalance of sizes is taken. Where natural boundaries lie too far apart for any piece to reach
the next, evenly spaced token positions between them are allowed as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters that are one token each.
SINGLE = "฀-๿぀-ヿ㐀-鿿"
TOKEN = re.compile(rf"[{SINGLE}]|[^\s{SINGLE}]+")
ONE = re.compile(f"[{SINGLE}]")
#: A boundary: (text after the token before it, cost of a cut there), the first that matches counts.
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE, INSIDE = 0.0, 0.6, 1.0, 4.0, 8.0, 10.0
SENTENCE_END = re.compile(r"[.?!。？！।][\"'”’»」』)\]]*$")
ABBREVIATION = re.compile(r"^(?:\W*(?:dr|prof|ms|mr|mrs|st|vs|e\.g|i\.e|cf|figs?|no|sect|suppl|approx|incl|pp?|ca|bzw|dra|[a-z]))\.$", re.I)
PIECE_COST = 2.0


def count_tokens(text: str) -> int:
    """Number of tokens of a text."""
    return len(text.split()) if text.isascii() else len(TOKEN.findall(text))


def _boundaries(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, float]]:
    """(number of tokens before the cut, cost) of the natural boundaries."""
    out = []
    for i in range(1, len(spans)):
        a, b = spans[i - 1][1], spans[i][0]
        gap = text[a:b]
        if "\n" in gap:
            out.append((i, PARAGRAPH if gap.count("\n") > 1 else LINE))
            continue
        c = text[a - 1]
        if c in ".?!。？！।\"'”’»」』)]":
            word = text[spans[i - 1][0]:a]
            if SENTENCE_END.search(word) and (gap or c in "。？！") and not ABBREVIATION.match(word):
                out.append((i, SENTENCE))
        elif c in ",;:，；：、،":
            out.append((i, CLAUSE))
        elif gap and ONE.match(text[a - 1]) and ONE.match(text[b]):
            out.append((i, SENTENCE))
    return out


def cuts(text: str, max_tokens: int, overlap: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Token spans of the text, and the token counts at which pieces end, the last being all tokens.

    overlap is held below max_tokens, so that each piece brings at least one new token.
    """
    if max_tokens < 1:
        raise ValueError("max_tokens must be 1 or more")
    overlap = max(0, min(overlap, max_tokens - 1))
    spans = [m.span() for m in TOKEN.finditer(text)]
    n = len(spans)
    if n <= max_tokens:
        return spans, [n]
    room = max_tokens - overlap
    cand = _boundaries(text, spans)
    spread = max(1, room // 12)
    full, prev = [(0, 0.0)], 0
    for pos, cost in [*cand, (n, 0.0)]:
        if pos - prev > room // 2:
            full += [(x, INSIDE if spans[x - 1][1] == spans[x][0] else SPACE) for x in range(prev + spread, pos, spread)]
        full.append((pos, cost))
        prev = pos
    pieces = -(-(n - overlap) // room)
    ideal = n / pieces
    best = [0.0] + [float("inf")] * (len(full) - 1)
    back = [0] * len(full)
    lo = 0
    for j in range(1, len(full)):
        p, cost = full[j]
        if p < overlap:  # the next piece begins with that many tokens of this one
            continue
        while lo < j and p - full[lo][0] > (max_tokens if lo == 0 else room):
            lo += 1
        i = j - 1
        least, arg = float("inf"), lo
        while i >= lo:
            d = (p - full[i][0]) / ideal - 1
            v = best[i] + 6 * d * d
            if v < least:
                least, arg = v, i
            i -= 1
        if least < float("inf"):
            best[j], back[j] = least + cost + PIECE_COST, arg
    at, ends = len(full) - 1, []
    while at:
        ends.append(full[at][0])
        at = back[at]
    return spans, ends[::-1]


def split_text(text: str, max_tokens: int, overlap: int) -> list[tuple[str, int, int]]:
    """(piece, tokens, start) in order: start is the piece's first character in the text."""
    spans, ends = cuts(text, max_tokens, overlap)
    if not spans:
        return []
    overlap = max(0, min(overlap, max_tokens - 1))
    out, first = [], 0
    for e in ends:
        a, b = spans[first][0], spans[e - 1][1]
        out.append((text[a:b], e - first, a))
        first = max(0, e - overlap)
    return out


def split_items(df: DataFrame, limits: DataFrame, key: str = "chunk_id", text: str = "chunk_text", kind: str = "content_type", section: str = "section_h2") -> DataFrame:
    """key, piece_no, section, token_count, start_pos, piece of every item over its kind's limit.

    Items whose kind is null or has no limit, null and empty texts and items within the limit give no
    rows. Rows delivered twice give their pieces twice. limits (kind, max_tokens, overlap_tokens) is a
    fixed table of a row per kind and is broadcast.
    """
    lim = F.broadcast(limits.select(F.col(kind).alias("_kind"), "max_tokens", "overlap_tokens").dropDuplicates(["_kind"]))
    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(kind).alias("_kind"), F.col(section).alias("s"))
    src = src.where(F.col("t").isNotNull()).join(lim, "_kind").where(F.length("t") > F.col("max_tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, s, m, o in zip(b["k"], b["t"], b["s"], b["max_tokens"], b["overlap_tokens"]):
                if count_tokens(t) > m:
                    rows += [(k, i, s, n, a, p) for i, (p, n, a) in enumerate(split_text(t, int(m), int(o)))]
            if rows:
                yield pd.DataFrame(rows, columns=["k", "piece_no", "s", "token_count", "start_pos", "piece"])

    kinds = {c: src.schema[c].dataType.simpleString() for c in ("k", "s")}
    out = src.mapInPandas(run, f"k {kinds['k']}, piece_no int, s {kinds['s']}, token_count int, start_pos int, piece string")
    return out.withColumnRenamed("k", key).withColumnRenamed("s", section)


def found(chunk: DataFrame, limits: DataFrame) -> DataFrame:
    """Keys of the items that were split."""
    return split_items(chunk, limits).where("piece_no = 0").select("chunk_id").distinct()
