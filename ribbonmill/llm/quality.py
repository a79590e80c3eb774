"""Per-document text statistics, and an ordered rule list that tells prose from lists, tables and junk.

The same plain statistics are taken of each document and of each of its lines: numbers of words and
characters, mean word length, shares of symbols, digits, letters, capitals and common words, closing
punctuation, and how the line before ended. They come from one Arrow pass over the texts: as SQL functions over
lines they took about ten times the CPU.

The rule list is induced by incremental reduced-error pruning: rules of one class after another are grown
condition by condition on two thirds of the labelled lines by information gain, and pruned on the other
third. The labelled documents are made here, from at most ``SAMPLE`` texts of the table at hand: prose of the
corpus as it is, wrapped, or put one sentence to a line; lists and tables of its words and phrases in many
layouts; junk of several kinds; and mixtures, so that each line's kind is known. The learned thresholds
become a CASE expression, which Spark applies natively to the statistics of a document's lines; a document
is of the kind that holds most of its characters, and prose unless more than half of them aren't.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribbonmill.session import hash_sample

#: Bound of the sample of texts from which labelled documents are made.
SAMPLE = 1500
KINDS = ("junk", "table", "list", "prose")
#: Scripts without spaces, and Indic ones, whose words common_word doesn't hold.
OTHER_SCRIPT = r"[฀-๿぀-ヿ㐀-鿿ऀ-ॿ]"
STATISTICS = ("words", "mean_word_length", "symbol_ratio", "punctuated_line_share", "common_word_share")
#: Statistics of a line. The first is its length, by which it counts; d_ are those of its document; ended, before: closing marks of it and of the line before.
FEATURES = ("chars", "words", "mean_word_length", "symbol_ratio", "common_word_share", "digit_ratio", "letter_ratio", "word_ratio", "capital_share", "mixed_share", "longest", "gaps", "bullet", "ended", "punctuated", "before", "before_chars", "lower", "script_ratio", "d_words", "d_mean_word_length", "d_symbol_ratio", "d_punctuated_line_share", "d_common_word_share", "d_lines")

_OTHER = re.compile(OTHER_SCRIPT)
_WORD = re.compile(r"[^\W_][^\W_'’-]*(?:['’-][^\W_]+)*")
_LINES = re.compile("[\n\r\x0b\x0c\x85\u2028\u2029]+")
_GAP = re.compile(r"\||\t|;|\S {2,}(?=\S)")
_BULLET = re.compile(r"(?:[-–—*•◦▪·+☐☑□■→‣✓]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)])\s+(?=\S)")
_END = re.compile(r"[.!?。！？।…][\"'”’»)\]」』]*(?:\s*\[[^\]]*\])?$")
_PUNCTUATED = re.compile(r"[.!?。！？।…,;:][\"'”’»)\]」』]*$")
_SYMBOLS = re.compile(r"[\W_]+")
_ASCII_SYMBOLS = bytes(i for i in range(33, 127) if not chr(i).isalnum())


def common_words(common: DataFrame) -> list[str]:
    """The common words; common_word is a fixed table of about a hundred rows."""
    return sorted({r[0].strip().lower() for r in common.select("word").where("word is not null").collect()} - {""})


def _line(line: str, common: frozenset[str]) -> tuple[list[float], tuple[float, ...]]:
    """The statistics of a line by itself, in the order of FEATURES, and its numbers of words, of their letters, of symbols and of common words."""
    chars = "".join(line.split())
    c = len(chars)
    words = _WORD.findall(line)
    n = len(words)
    length = sum(map(len, words))
    known = len(list(filter(common.__contains__, map(str.lower, words))))
    capitals = mixed = letters = 0
    for w in words:
        if w.isalpha() or not any(map(str.isdigit, w)):
            letters += len(w) if len(w) > 2 else 0
            capitals += w[0].isupper()
        elif not w.isdigit():
            mixed += 1
    if chars.isascii():
        symbols, script, signs = c - len(chars.encode().translate(None, _ASCII_SYMBOLS)), 0, 0
    else:
        rest = "".join(_SYMBOLS.findall(chars))
        script = len(_OTHER.findall(chars))
        signs = len(_OTHER.findall(rest)) if script else 0  # vowel signs and the like are letters
        symbols = len(rest) - signs
    digits = sum(map(chars.count, "0123456789"))
    longest = max(map(len, line.split()))
    gaps = len(_GAP.findall(line)) if "|" in line or "\t" in line or ";" in line or "  " in line else 0
    m = max(1, n)
    own = [c, n, length / m, symbols / c, known / m, digits / c, (c - symbols - digits) / c, (letters + signs) / c, capitals / m, mixed / m, longest, gaps, _BULLET.match(line) is not None, _END.search(line, max(0, len(line) - 60)) is not None, _PUNCTUATED.search(line, max(0, len(line) - 60)) is not None]
    return own, (n, length, symbols, known, script)


def line_statistics(text: str | None, common: frozenset[str]) -> tuple[tuple[float, ...], list[tuple[float, ...]]]:
    """STATISTICS of a text, and FEATURES of each of its lines that aren't blank; null and blank texts have 0 in all and no lines."""
    if not text or not text.strip():
        return (0,) + (0.0,) * (len(STATISTICS) - 1), []
    lines = [x for x in map(str.strip, _LINES.split(text)) if x]
    own = [_line(x, common) for x in lines]
    n, length, symbols, known, _ = map(sum, zip(*(s for _, s in own)))
    doc = (n, length / max(1, n), symbols / sum(v[0] for v, _ in own), sum(v[14] for v, _ in own) / len(own), known / max(1, n))
    out = []
    ended, before = 1, 0
    for x, (v, s) in zip(lines, own):
        out.append((*v, ended, before, x[0].islower(), s[4] / v[0], *doc, len(lines)))
        ended, before = v[13], v[0]
    return doc, out


def statistics(df: DataFrame, common: list[str], key: str = "chunk_id", text: str = "chunk_text", used: Iterable[str] = FEATURES) -> DataFrame:
    """key, STATISTICS and lines (the used FEATURES of one line after another, a flat array) of every row of df."""
    words = frozenset(common)
    at = [FEATURES.index(c) for c in used]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            docs, lines = zip(*(line_statistics(t, words) for t in b["t"]))
            out = pd.DataFrame(docs, columns=list(STATISTICS))
            out.insert(0, "k", b["k"].to_numpy())
            # a flat array of numbers costs far less to pass on than one of structs
            every = np.array([v for x in lines for v in x], np.float32).reshape(-1, len(FEATURES))[:, at].ravel()
            out["lines"] = np.split(every, np.cumsum([len(x) * len(at) for x in lines])[:-1])
            yield out

    src = df.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInPandas(run, f"k {kind}, words int, " + ", ".join(f"{c} double" for c in STATISTICS[1:]) + ", lines array<float>").withColumnRenamed("k", key)


# labelled documents


def _is_seed(text: str, common: frozenset[str]) -> bool:
    """Whether a text is prose beyond doubt: nearly all of it stands in long lines of common words, or of another script, that close with a mark or go on."""
    doc, lines = line_statistics(text, common)
    whole = sum(v[0] for v in lines)
    plain = sum(v[0] for v in lines if v[1] > 7 and v[10] < 60 and (v[11] < 3 or v[4] > 0.1) and not v[12] and (v[4] > 0.1 and v[6] > 0.7 or v[13] and v[7] > 0.35) or v[18] > 0.3 and v[0] > 25 and not v[12])
    return len(text) > 120 and plain > 0.9 * whole


def labelled(texts: list[str], common: frozenset[str], n: int = 4000, seed: int = 7) -> list[list[tuple[str, str]]]:
    """n made documents, each a list of (lines, kind), from a bounded list of texts of the corpus."""
    r = random.Random(seed)
    plain = [t for t in texts if _is_seed(t, common)] or ["No text was given here, so this sentence stands for prose. It was written by hand."]
    latin = [t for t in plain if not re.search(OTHER_SCRIPT, t)]
    phrases = [p.strip() for t in latin for p in re.findall(r"(?:of|with|by|in|to|for) ((?:[A-Za-z0-9-]+ ){1,3}[A-Za-z0-9-]+)", t) if not any(w.lower() in common for w in p.split())] or ["red apples", "blue plums"]
    nouns = [w for t in latin for w in re.findall(r"\b[a-z]{5,}\b", t)] or ["apple", "plum"]
    spans = [p for t in latin for p in re.findall(r"(?<=[a-z] )([a-z-]+ (?:with|who|of|on|to|in|from|under|for|a) (?:[a-zA-Z0-9-]+ ){1,3}[a-zA-Z0-9-]+)", t)] or phrases
    short = [p.strip() for t in plain if re.search(OTHER_SCRIPT, t) for p in re.split(r"[。，、；।,;.!?！？\n ]+", t) if 3 < len(p.strip()) < 24] or phrases
    num = lambda: r.choice((f"{r.random() * 99:.1f}", f"{r.randrange(100)}%", f"{r.randrange(300)} ({r.randrange(99)})", "-", "NR", str(r.randrange(99))))

    def prose() -> str:
        t = r.choice(plain)
        k = r.random()
        if r.random() < 0.3:  # that stops anywhere
            t = t[: r.randrange(len(t) // 2, len(t))].strip()
        if re.search(OTHER_SCRIPT, t) or k < 0.5:
            return t
        if k < 0.8:
            out, line = [], ""
            width = r.randrange(45, 95)
            for w in t.split():
                if len(line) + len(w) > width:
                    out.append(line)
                    line = ""
                line = f"{line} {w}".strip()
            return "\n".join([*out, line])
        return re.sub(r"(?<=[a-z)][.?!]) (?=[A-Z])", "\n", re.sub(r"\.(?= [A-Z])", ";", t) if k > 0.93 else t)

    def items() -> str:
        marks = r.choice(("- ", "• ", "•\t", "* ", "– ", "+ ", "☐ ", "{}. ", "({}) ", "{}) ", "", "", ""))
        end = r.choice(("", "", ";", ",", "."))
        if r.random() < 0.12:  # items in other scripts
            return "\n".join(marks.format(i + 1) + r.choice(short) + (end if end != "." else "") for i in range(r.randrange(4, 30)))
        if r.random() < 0.25:  # items with common words in them
            return r.choice(("", "", "Criteria:\n", "Who may take part\n")) + "\n".join(marks.format(i + 1) + r.choice(spans) + end for i in range(r.randrange(4, 60)))
        form = r.choice(("{p}", "{p}: {w}", "{w} {n} mg, weekly", "{p} >= {n}", "prior {w} within {n} months", "{w} (grade {n})", "{x}"))
        k = r.randrange(4, 45)
        head = r.choice(("", "", "Criteria:\n", "Schemes in use\n"))
        pick = lambda: r.choice(("{p}", "{p}: {w}", "{w} {n} mg, weekly", "{p} >= {n}")) if form == "{x}" else form
        return head + "\n".join(marks.format(i + 1) + pick().format(p=r.choice(phrases), w=r.choice(nouns), n=r.randrange(99)) + end for i in range(k))

    def cells() -> str:
        sep = r.choice((" | ", "\t", ";", "  "))
        c, k = r.randrange(2, 6), r.randrange(3, 30)
        rows = [[r.choice(phrases)[:30] if i else "Name", *[num() if i else f"Arm {x}" for x in range(c)]] for i in range(k)]
        if sep == " | ":
            out = [f"| {' | '.join(x)} |" for x in rows]
            if r.random() < 0.5:
                out.insert(1, "|" + "---|" * (c + 1))
        else:
            out = [f"{x[0]:<34}" + "".join(f"{y:>12}" for y in x[1:]) if sep == "  " else sep.join(x) for x in rows]
        return r.choice(("", "Table 3. values by arm\n")) + "\n".join(out)

    def junk() -> str:
        k, n = r.randrange(7), r.randrange(40, 140)
        if k == 0:
            return " ".join(f"{r.getrandbits(32):08x}" for _ in range(n // 2))
        if k == 1:
            return "".join(r.choice("ABCDEFGHabcdefgh0123456789+/xyzXYZQWqw") for _ in range(n * 6))
        if k == 2:
            return " ".join("".join(r.choice("0123456789abcdefgxyz%^~#=:;") for _ in range(r.randrange(2, 11))) for _ in range(n))
        if k == 3:
            return "\n".join(r.choice("=-_|.*~") * r.randrange(30, 140) if r.random() < 0.7 else r.choice(("-|", ". ", "+-")) * r.randrange(20, 60) for _ in range(r.randrange(2, 9)))
        if k == 4:
            nav = "Home Login Print Share Menu Back Next Top Help PDF RSS Cookies Search Contact » › | Sitemap About".split()
            return " ".join(r.choice(nav) for _ in range(n))
        if k == 5:
            return "\n".join(" ".join(str(x * s) for x in range(r.randrange(2, 20))) for s in (r.choice((5, 10, 20)) for _ in range(r.randrange(3, 12))))
        return " ".join(r.choice(("Ã©", "Ã¼", "â€™", "Â±", "ï¿½", "â‰¥", "Ã¤")) * r.randrange(1, 4) + r.choice("nrstlx") for _ in range(n))

    make = {"prose": prose, "list": items, "table": cells, "junk": junk}
    out = []
    for i in range(n):
        kind = ("prose", "list", "table", "junk", "prose", "mix")[i % 6]
        if kind != "mix":
            out.append([(make[kind](), kind)])
            continue
        other = r.choice(("list", "table", "junk"))
        doc = [(prose(), "prose"), (make[other](), other)]
        out.append(doc if r.random() < 0.8 else doc[::-1])
    return out


# incremental reduced-error pruning

Rule = list[tuple[int, str, float]]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    m = np.ones(len(x), bool)
    for f, op, v in rule:
        m &= x[:, f] >= v if op == ">=" else x[:, f] < v
    return m


def _grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, most: int = 5) -> Rule:
    """Conditions added one at a time, each of the greatest information gain."""
    rule: Rule = []
    inside = np.ones(len(x), bool)
    while len(rule) < most and (inside & ~y).any():
        p0, n0 = w[inside & y].sum(), w[inside].sum()
        best = (1e-9, None)
        wi, yi = w[inside], w[inside] * y[inside]
        for f in range(x.shape[1]):
            v = x[inside, f]
            order = np.argsort(v, kind="stable")
            s = v[order]
            edge = np.flatnonzero(np.diff(s)) + 1  # a threshold before each new value
            if not len(edge):
                continue
            n, p = np.cumsum(wi[order])[edge - 1], np.cumsum(yi[order])[edge - 1]
            for op, pp, nn in (("<", p, n), (">=", p0 - p, n0 - n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 1e-9, pp * (np.log2(pp / np.maximum(nn, 1e-12)) - np.log2(p0 / n0)), -1)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], (f, op, float((s[edge[i] - 1] + s[edge[i]]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _covers([best[1]], x)
    return rule


def induce(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, classes: tuple[str, ...] = KINDS, seed: int = 3) -> list[tuple[str, Rule]]:
    """Ordered rules (class, conditions) from rows of weights w; the last class is the default and has none."""
    out: list[tuple[str, Rule]] = []
    rng = np.random.default_rng(seed)
    w = np.ones(len(x)) if w is None else w
    left = np.ones(len(x), bool)
    for c in classes[:-1]:
        failed = 0
        while failed < 8 and len(out) < 60:  # another split may find what one missed
            idx = rng.permutation(np.flatnonzero(left))
            if not (y[idx] == c).any():
                break
            g, p = idx[: len(idx) * 2 // 3], idx[len(idx) * 2 // 3 :]
            rule = _grow(x[g], y[g] == c, w[g])
            value = lambda r: (lambda m: (w[p][m & (y[p] == c)].sum() - w[p][m & (y[p] != c)].sum()) / max(1e-9, w[p][m].sum()))(_covers(r, x[p]))  # noqa: B023, E731
            rule = max((rule[: i + 1] for i in range(len(rule))), key=value, default=[])  # of equals the shortest
            hit = _covers(rule, x) & left
            if not rule or value(rule) < 0.9 or (_covers(rule, x[p]) & (y[p] == c)).sum() < 4 or not (hit & (y == c)).any():
                failed += 1
                continue
            out.append((c, rule))
            left &= ~hit
    return [*out, (classes[-1], [])]


def to_sql(rules: list[tuple[str, Rule]], names: Sequence[str] = FEATURES, values: dict[str, str] | None = None) -> str:
    """The rule list as a CASE expression over names; values: what it gives for each class instead of its name."""
    value = values or {c: f"'{c}'" for c, _ in rules}
    when = " ".join(f"WHEN {' AND '.join(f'{names[f]} {op} {float(v)!r}F' for f, op, v in r)} THEN {value[c]}" for c, r in rules if r)
    return f"CASE {when} ELSE {value[rules[-1][0]]} END" if when else value[rules[-1][0]]


def learn(texts: Iterable[str], common: list[str]) -> list[tuple[str, Rule]]:
    """The rules over a line's statistics, learned from documents made of the texts."""
    x, y, w = lines_of(labelled(sorted(texts), frozenset(common)), frozenset(common))
    return induce(x, y, w)


def lines_of(docs: list[list[tuple[str, str]]], common: frozenset[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FEATURES, kind and weight of each line; a document's lines weigh 1 together, each by its length."""
    x, y, w = [], [], []
    for doc in docs:
        rows = line_statistics("\n".join(t for t, _ in doc), common)[1]
        total = sum(v[0] for v in rows)
        x += rows
        y += [k for t, k in doc for p in _LINES.split(t) if p.strip()]
        w += [v[0] / total for v in rows]
    return np.array(x), np.array(y), np.array(w)


def classify(df: DataFrame, common_word: DataFrame, key: str = "chunk_id", text: str = "chunk_text") -> DataFrame:
    """key, STATISTICS and text_kind of every row, repeated ones once. Null and blank texts are junk: they hold no statement."""
    common = common_words(common_word)
    sample = hash_sample(df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("length(t) > 120"), df.count(), "k", SAMPLE).select("t").collect()
    rules = learn([r[0] for r in sample], common)
    used = ["chars", *sorted({FEATURES[f] for _, r in rules for f, _, _ in r} - {"chars"})]
    # the flat array holds the numbers of one line after another; a row for each, summed up again before anything moves
    case = to_sql(rules, [f"lines[i + {used.index(c)}]" if c in used else "" for c in FEATURES])
    each = statistics(df, common, key, text, used).select(key, *STATISTICS, F.explode(F.expr(f"if(size(lines) > 0, sequence(0, size(lines) - 1, {len(used)}), array(-1))")).alias("i"), "lines")
    each = each.select(key, *STATISTICS, F.expr(f"if(i < 0, null, {case})").alias("kind"), F.expr("if(i < 0, 0F, lines[i])").cast("double").alias("chars"))
    sums = each.groupBy(key, *STATISTICS).agg(*[F.sum(F.when(F.col("kind") == k, F.col("chars")).otherwise(F.lit(0.0))).alias(f"_{k}") for k in KINDS])
    others = [F.col(f"_{k}") for k in KINDS[:-1]]
    kind = F.when(sum(others, F.col("_prose")) == 0, "junk").when(F.col("_prose") >= sum(others, F.lit(0.0)), "prose")
    for k, c in zip(KINDS, others):
        kind = kind.when(c == F.greatest(*others), k)
    return sums.select(key, *STATISTICS, kind.alias("text_kind"))


def document_statistics(chunk: DataFrame, common_word: DataFrame) -> DataFrame:
    """chunk_id, the statistics and text_kind of every chunk."""
    return classify(chunk, common_word).distinct()


def found(chunk: DataFrame, common_word: DataFrame) -> DataFrame:
    """chunk_id, text_kind of chunks recorded as prose that mostly aren't."""
    rows = classify(chunk.where("content_type = 'prose'"), common_word)
    return rows.where("text_kind != 'prose'").select("chunk_id", "text_kind").distinct()
