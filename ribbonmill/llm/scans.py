"""Noise in text from scanned pages: its kinds, and repaired text of continuous paragraphs.

Words. All words of the corpus are counted. The frequent ones are the dictionary: words that make up at
least one in DICTIONARY words of the corpus, of which there are no more than DICTIONARY. Every word
retrieves candidates from the dictionary through inverted joins over character q-grams (at their places
from the start and from the end) and over its visual skeleton; gradient-boosted trees, trained on
dictionary words with synthetic reading errors, rank them. A word is misread if its best candidate wins
and is far more frequent.

Lines. One classifier decides whether a hyphen at a line end joins two parts of a word, from what the
dictionary knows of the joined word, the hyphenated word and the parts; another whether a line is
furniture of the page, from its words shared with the title and journal of its document, its form and
its neighbours. Both are trained on lines made from a bounded sample of the corpus.

Null and empty texts have no noise; they are their own repair. Rows delivered twice count once.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribbonmill.llm.boosting import Boosted
from ribbonmill.llm.truncation import distinct_answers
from ribbonmill.session import cut, hash_sample

#: Bound of the dictionary, which is broadcast, and of the samples that train the classifiers.
DICTIONARY = 200_000
SAMPLE = 1200
#: What is printed and what is read for it.
CONFUSIONS = (("e", "c"), ("c", "e"), ("o", "0"), ("l", "1"), ("i", "1"), ("l", "i"), ("i", "l"), ("s", "5"), ("g", "q"), ("g", "9"), ("h", "b"), ("b", "h"), ("t", "f"), ("f", "t"), ("m", "rn"), ("rn", "m"), ("w", "vv"), ("in", "m"), ("li", "h"), ("u", "ii"), ("d", "cl"), ("cl", "d"), ("b", "6"), ("z", "2"), ("n", "u"), ("u", "n"), ("y", "v"), ("ri", "n"), ("n", "ri"), ("nn", "m"), ("fi", "h"))
#: Symbols that fonts of scanned pages give for others.
SYMBOLS = {"¼": "=", "þ": "+"}
SYMBOL = re.compile(r"(?<=\s)¼(?=\s*[\d.<])|(?<=\d)þ")
HYPHENS = "-‐‑¬\xad"
WORD = re.compile(r"[^\W_]+(?:[-‐‑][^\W_]+)*")
LETTERED = re.compile(r"\d*[^\W\d_][^\W_]*(?:[-‐‑][^\W_]+)*")
HAS_BREAK = re.compile(rf"[{HYPHENS}][ \t]*\n")
BREAK_HYPHEN = re.compile(rf"(?P<left>[^\W_]+(?:[-‐‑][^\W_]+)*)(?P<mark>[{HYPHENS}])[ \t]*$")
FIRST = re.compile(r"[^\W\d_]+")
SKIPPED = re.compile(rf"[^\W_]*[{HYPHENS}][ \t]*\n\s*[^\W_]*")
OTHER_SCRIPT = re.compile("[ऀ-ॿ฀-๿぀-ヿ㐀-鿿]")
_SKELETONS = ((("vv", "w"), ("rn", "m"), ("nn", "m"), ("in", "m"), ("ii", "u"), ("li", "h"), ("cl", "d")), (("vv", "w"), ("ii", "u"), ("li", "h"), ("cl", "d"), ("rn", "m"), ("in", "m"), ("nn", "m")))
TAG = re.compile(r"<[/!]?[a-zA-Z][^<>]{0,200}>|&(?:amp;)*#?\w{2,8};")
_CLASS = str.maketrans("0c1i5q9bf62", "oellsgghthz")
PAGE = re.compile(r"\W{0,3}(?:page|p\.|seite|s\.|pág\.)?\s*\d{1,4}(?:\s*(?:/|of)\s*\d{1,4})?\s*[|\-—–·]{0,2}", re.I)
PAGE_AT_END = re.compile(r"^\d{1,4}(?:\s{2,}|\s*[|·]\s*)(?=\S)|(?<=\S)(?:\s{2,}|\s*[|·]\s*)\d{1,4}$")
VOLUME = re.compile(r"\b\d{1,3}\s+\((?:19|20)\d\d\)$")
AUTHORS = re.compile(r"^[^\W\d_][\w'-]+ (?:and [^\W\d_][\w'-]+:|et al\.) \S", re.I)
ENDS = re.compile(r"[.?!:;,][\"'”’»)\]]*$")


def skeletons(word: str) -> set[str]:
    """The word as its shapes, in two orders of replacing: what is easily read for each other is equal."""
    out = set()
    for order in _SKELETONS:
        w = word
        for a, b in order:
            w = w.replace(a, b)
        out.add(w.translate(_CLASS))
    return out


def grams(word: str) -> list[str]:
    """Keys of the inverted index: 3-grams with their places from either end, and the skeleton."""
    w = f"^{word}$"
    n = len(w) - 2
    return [f"{i}{w[i:i + 3]}" for i in range(n)] + [f"{w[i:i + 3]}-{n - 1 - i}" for i in range(n)] + ["~" + x for x in skeletons(word)]


def visual_cost(read: str, printed: str) -> float:
    """Edit distance in which a listed confusion costs a fifth of another edit."""
    n, m = len(read), len(printed)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if i == j == 0:
                continue
            best = 1e9
            if i:
                best = d[i - 1][j] + 1
            if j:
                best = min(best, d[i][j - 1] + 1)
            if i and j:
                best = min(best, d[i - 1][j - 1] + (read[i - 1] != printed[j - 1]))
                for a, b in _BY_LAST.get((printed[j - 1], read[i - 1]), ()):
                    if printed.endswith(a, 0, j) and read.endswith(b, 0, i):
                        best = min(best, d[i - len(b)][j - len(a)] + 0.2)
            d[i][j] = best
    return d[n][m]


_BY_LAST: dict[tuple[str, str], list[tuple[str, str]]] = {}
for _a, _b in CONFUSIONS:
    _BY_LAST.setdefault((_a[-1], _b[-1]), []).append((_a, _b))


def pair_features(read: str, printed: str, n_read: float, n_printed: float, shared: float) -> tuple[float, ...]:
    """What the ranking knows of a word and a candidate."""
    cost = visual_cost(read, printed)
    return (
        cost,
        cost / max(1, len(printed)),
        abs(len(read) - len(printed)),
        float(not skeletons(read).isdisjoint(skeletons(printed))),
        float(any(c.isdigit() for c in read) and printed.isalpha()),
        min(6.0, float(np.log10((n_printed + 1) / (n_read + 1)))),
        float(len(printed)),
        float(read[:1] == printed[:1]),
        float(read[-1:] == printed[-1:]),
        shared,
    )


def word_counts(df: DataFrame, text: str = "chunk_text") -> DataFrame:
    """w, n: every word of the corpus in lower case, and parts of hyphenated words; words joined over a hyphen that ends a line count 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[str] = Counter()
        for b in batches:
            for t in b["t"]:
                if "<" in t or "&" in t:
                    t = TAG.sub(" ", t)
                if "\n" in t and HAS_BREAK.search(t):
                    for m in SKIPPED.findall(t.lower()):
                        c["".join(WORD.findall(m))] += 0  # to be judged, though it proves nothing
                    t = SKIPPED.sub(" ", t)
                c.update(LETTERED.findall(t.lower()))
            if len(c) > 300_000:  # a task's table stays small
                yield pd.DataFrame({"w": list(c), "n": list(c.values())})
                c = Counter()
        if c:
            yield pd.DataFrame({"w": list(c), "n": list(c.values())})

    raw = df.select(F.col(text).alias("t")).where("t is not null").mapInPandas(run, "w string, n long")
    raw = raw.where(~F.col("w").rlike("^[0-9-]+$"))
    parts = raw.select(F.explode(F.array_union(F.array("w"), F.when(F.col("w").contains("-"), F.filter(F.split("w", "-"), lambda x: x.rlike(r"\p{L}"))).otherwise(F.array()))).alias("w"), "n")
    return parts.groupBy("w").agg(F.sum("n").alias("n"))


def train_ranker(words: dict[str, int], seed: int = 11) -> Boosted:
    """Ranking model from at most SAMPLE dictionary words with synthetic reading errors; true neighbours are negatives."""
    r = random.Random(seed)
    pool = sorted(words, key=lambda w: (-words[w], w))[: 4 * SAMPLE]
    index: dict[str, list[str]] = {}
    for w in pool:
        for g in grams(w):
            index.setdefault(g, []).append(w)

    def near(w: str, k: int = 4) -> list[tuple[str, float]]:
        c: Counter[str] = Counter()
        gs = grams(w)
        for g in gs:
            for x in index.get(g, ())[:400]:
                c[x] += 1
        c.pop(w, None)
        return [(x, n / len(gs)) for x, n in c.most_common(k)]

    rows, label = [], []
    alpha = [w for w in pool if w.isalpha() and w.isascii() and len(w) > 1][:SAMPLE]
    for w in alpha:
        read = w
        for _ in range(1 + (r.random() < 0.2)):
            ops = [(a, b) for a, b in CONFUSIONS if a in read]
            if ops:
                a, b = r.choice(ops)
                i = r.choice([m.start() for m in re.finditer(re.escape(a), read)])
                read = read[:i] + b + read[i + len(a):]
        n = r.choice((1, 1, 2, 5, max(1, words[w] // 200)))
        if read != w and read not in words:
            gs = set(grams(w))
            rows.append(pair_features(read, w, n, words[w], sum(g in gs for g in grams(read)) / len(grams(read))))
            label.append(1)
            for x, s in near(read):
                if x != w:
                    rows.append(pair_features(read, x, n, words[x], s))
                    label.append(0)
        # rare but right: a dictionary word, as if it were rare, and an inflected one, against its neighbours
        for x, s in near(w):
            rows.append(pair_features(w, x, n, words[x], s))
            label.append(0)
        for y in (w + "s", w + "ed", w[:-1], w + "ly", "un" + w):
            if y not in words and len(y) > 2:
                rows.append(pair_features(y, w, n, words[w], 0.6))
                label.append(0)
    if not rows:
        rows, label = [(0.0,) * 10], [0]
    return Boosted().fit(np.array(rows), np.array(label))


def corrections(vocabulary: DataFrame, least: int, model: Boosted, ratio: float = 8.0) -> DataFrame:
    """w, printed: each misread word, of any length, in scripts with letter case, and what was printed."""
    usable = vocabulary.where(F.col("w").rlike(r"^[\p{Ll}0-9]*\p{Ll}[\p{Ll}0-9]*$") & (F.length("w") > 1))

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, n, g) for w, n in zip(b["w"], b["n"]) for g in grams(w)]
            if rows:
                yield pd.DataFrame(rows, columns=["w", "n", "g"])

    read = usable.mapInPandas(keyed, "w string, n long, g string")
    printed = usable.where((F.col("n") >= least) & F.col("w").rlike(r"^\p{Ll}{2,}$")).mapInPandas(keyed, "w string, n long, g string").select(F.col("w").alias("printed"), F.col("n").alias("n_printed"), "g")
    pairs = read.join(printed, "g").where((F.col("w") != F.col("printed")) & (F.col("n_printed") >= ratio * F.col("n")) & (F.abs(F.length("w") - F.length("printed")) <= 2))
    shared = pairs.groupBy("w", "n", "printed", "n_printed").agg((F.count("*") / (2 * F.length("w") + 1)).alias("shared"), F.bool_or(F.startswith("g", F.lit("~"))).alias("alike"))
    shared = shared.where("alike OR shared >= 0.2")

    @F.pandas_udf("double")
    def ranked(w: pd.Series, p: pd.Series, n: pd.Series, m: pd.Series, s: pd.Series) -> pd.Series:
        x = [pair_features(*v) for v in zip(w, p, n, m, s)]
        return pd.Series(model.predict(np.array(x)) if x else [], dtype=float)

    scored = shared.withColumn("p", ranked("w", "printed", "n", "n_printed", "shared")).where("p >= 0.5")
    return scored.groupBy("w").agg(F.max_by("printed", F.struct("p", "n_printed", "printed")).alias("printed"))


# lines


def join_features(left: str, mark: str, right: str, known) -> tuple[float, ...]:
    """What the classifier knows of two parts around a hyphen at a line end."""
    low, nxt = left.lower(), right.lower()
    last = re.split("[-‐‑]", low)[-1]
    return (
        float(low + nxt in known or last + nxt in known),
        float(f"{low}-{nxt}" in known or f"{last}-{nxt}" in known),
        float(last in known),
        float(nxt in known),
        float(mark != "-"),
        float(left[-1].isalpha()),
        float(right[:1].islower()),
        float(min(len(last), len(nxt))),
    )


def train_joins(words: dict[str, int], seed: int = 5) -> Boosted:
    """Classifier of hyphens at line ends, from dictionary words cut in two and hyphenated words at their own hyphen."""
    r = random.Random(seed)
    ranked = sorted(words, key=lambda w: (-words[w], w))
    rows, label = [], []
    for w in [x for x in ranked if x.isalpha() and len(x) > 5][:SAMPLE]:
        i = r.randrange(2, len(w) - 2)
        known = words if r.random() < 0.85 else (words.keys() - {w})
        rows.append(join_features(w[:i], r.choice("---‐¬\xad"), w[i:], known))
        label.append(1)
    for w in [x for x in ranked if "-" in x.strip("-")][:SAMPLE]:
        a, b = w.rsplit("-", 1)
        if b and b[0].isalpha() and a:
            known = words if r.random() < 0.85 else (words.keys() - {w})
            rows.append(join_features(a, "-", b, known))
            label.append(0)
            rows.append(join_features(a.upper() + "2", "-", b, known))
            label.append(0)
    if not rows:
        rows, label = [(0.0,) * 8], [0]
    return Boosted(trees=20, depth=3).fit(np.array(rows), np.array(label))


def _words(x: str) -> list[str]:
    return re.findall(r"[^\W_]+", x.lower())


def line_features(line: str, before: str, after: str, title: str, journal: str, edge: bool) -> tuple[float, ...]:
    """What the classifier knows of a line: its document's words in it, its form, and the pair it makes with its neighbours."""
    flat = " ".join(line.split())
    bare = PAGE_AT_END.sub("", line.strip())
    ws = _words(bare)
    n = max(1, len(ws))
    own = frozenset(_words(title))
    low = flat.lower()
    start = " ".join(title.lower().split())[:18]
    return (
        sum(w in own for w in ws) / n if own else -1.0,
        float(bool(start) and start in low),
        float(bool(journal) and " ".join(journal.lower().split()) in low),
        float(VOLUME.search(" ".join(bare.split())) is not None),
        float(AUTHORS.match(" ".join(bare.split())) is not None),
        float(" | " in flat or " · " in flat),
        float(PAGE_AT_END.search(line.strip()) is not None),
        float(ENDS.search(flat) is not None),
        float(before != "" and not re.search(r"[.?!][\"'”’»)\]]*$", before)),
        float(after[:1].islower()),
        float(flat.isupper()),
        float(len(ws)),
        float("  " in bare),
        float(edge),
        float(sum(w[:1].isupper() for w in bare.split()) / n),
    )


_NAMES = ("Alder", "Birkhoff", "Castell", "Dunmore-Hale", "Eversley", "Falkenrath")


def _fakes(r: random.Random, title: str, journal: str) -> str:
    """A made header or footer line of a document."""
    t = " ".join(title.split()[: r.randrange(4, 11)])
    j = journal or r.choice(("Journal of Made Names", "Annals of Samples", "Sample Care Reports"))
    x = r.choice((f"{j} {r.randrange(1, 90)} ({r.randrange(1998, 2026)})", f"{j} {r.randrange(1, 90)} ({r.randrange(1998, 2026)})", f"{t} | {j}", f"{r.choice(_NAMES)} and {r.choice(_NAMES)}: {t}", f"{r.choice(_NAMES)} et al. {t}", f"{j} · {t[:20]}", f"{r.choice(_NAMES)} et al. {t}"))
    if r.random() < 0.3:
        x = x.upper()
    if r.random() < 0.25:
        x = x.replace(" ", "  ")
    k = r.random()
    return f"{r.randrange(1, 99)}   {x}" if k < 0.12 else f"{x}   {r.randrange(1, 99)}" if k < 0.24 else x


def train_lines(rows: list[tuple[str, str, str]], seed: int = 9) -> Boosted:
    """Classifier of furniture lines from (text, title, journal) of a bounded sample: made headers put between real lines, and the real lines."""
    r = random.Random(seed)
    x, y = [], []
    for text, title, journal in rows:
        lines = [v for v in text.split("\n") if v.strip()]
        if len(lines) == 1 and len(text) > 300:  # wrap it
            w, lines, line = text.split(), [], ""
            width = r.randrange(45, 95)
            for v in w:
                if len(line) + len(v) > width:
                    lines.append(line)
                    line = ""
                line = f"{line} {v}".strip()
        if len(lines) < 3 or not title:
            continue
        t, j = (title if r.random() < 0.95 else ""), (journal if r.random() < 0.55 else "")
        for i in r.sample(range(len(lines)), min(5, len(lines))):
            v = lines[i]
            own = frozenset(_words(title))
            if VOLUME.search(v) or " | " in v or "·" in v or sum(w in own for w in _words(v)) > 0.6 * len(_words(v)):
                continue
            x.append(line_features(v, lines[i - 1] if i else "", lines[i + 1] if i + 1 < len(lines) else "", t, j, i in (0, len(lines) - 1)))
            y.append(0)
        i = r.randrange(len(lines))
        i = r.choice((0, len(lines), i, i))
        x.append(line_features(_fakes(r, title, journal), lines[i - 1] if i else "", lines[i] if i < len(lines) else "", t, j, i in (0, len(lines))))
        y.append(1)
        said = f"{r.choice(_NAMES)} et al. {lines[r.randrange(len(lines))].strip()[: r.randrange(25, 70)]}"  # a sentence that cites
        x.append(line_features(said, lines[i - 1] if i else "", lines[i] if i < len(lines) else "", t, j, i in (0, len(lines))))
        y.append(0)
        x.append(line_features(r.choice(("Results", "Methods", "Study design", "Conclusions", "Patients and methods")), lines[i - 1] if i else "", lines[i] if i < len(lines) else "", t, j, i == 0))
        y.append(0)
    if not x:
        x, y = [(0.0,) * 15], [0]
    return Boosted(trees=30, depth=3).fit(np.array(x), np.array(y))


_NUMERIC = re.compile(r"[\d\s.%()-]+")


def page_features(line: str, before: str, after: str, edge: bool) -> tuple[float, ...]:
    """What the classifier knows of a line that has the form of a page number: its form and the pairs it makes with its neighbours."""
    numeric = [float(_NUMERIC.fullmatch(z) is not None and PAGE.fullmatch(z) is None) for z in (before, after)]
    alike = [float(z != "" and PAGE.fullmatch(z) is not None) for z in (before, after)]
    wordy = [sum(map(str.isalpha, z)) / max(1, len(z)) for z in (before, after)]
    return (*numeric, *alike, *wordy, float(before == ""), float(after == ""), float(ENDS.search(before) is not None), float(after[:1].islower()), float(line.isdigit()), float(len(line)), float(edge))


def train_pages(rows: list[tuple[str, str, str]], seed: int = 6) -> Boosted:
    """Classifier of printed page numbers among lines of their form, from texts of a bounded sample: numbers put between real lines, and numbers within made columns."""
    r = random.Random(seed)
    x, y = [], []
    for text, _, _ in rows:
        lines = [v.strip() for v in text.split("\n") if v.strip()]
        if len(lines) < 2:
            w = text.split()
            lines = [" ".join(w[i : i + 10]) for i in range(0, len(w), 10)]
        n = r.randrange(1, 999)
        page = r.choice((f"{n}", f"{n}", f"- {n} -", f"Page {n}", f"p. {n}", f"Page {n} of {n + r.randrange(90)}", f"{n}/{n + r.randrange(90)}"))
        if len(lines) > 1 and PAGE.fullmatch(page):
            i = r.choice((0, len(lines), r.randrange(len(lines) + 1), r.randrange(len(lines) + 1)))
            before, after = lines[i - 1] if i else "", lines[i] if i < len(lines) else ""
            x.append(page_features(page, before, after, i in (0, len(lines))))
            y.append(1)
        cell = lambda: r.choice((f"{r.random() * 99:.1f}", f"{r.randrange(100)}%", f"{r.randrange(300)} ({r.randrange(99)})", f"{r.randrange(99)}.{r.randrange(9)} {r.randrange(99)}"))
        around = [cell(), cell()]
        k = r.random()
        if k < 0.3:
            around[r.randrange(2)] = r.choice(lines)
        elif k < 0.4:
            around[r.randrange(2)] = ""
        elif k < 0.5:
            around[r.randrange(2)] = str(r.randrange(400))
        if PAGE.fullmatch(str(n)):
            x.append(page_features(str(n), *around, "" in around))
            y.append(0)
    if not x:
        x, y = [(0.0,) * 13], [0]
    return Boosted(trees=20, depth=3).fit(np.array(x), np.array(y))


class Reader:
    """The dictionary and the line classifiers, as tasks use them."""

    def __init__(self, known: frozenset[str], joins: Boosted, lines: Boosted, pages: Boosted) -> None:
        self.known, self.joins, self.lines, self.pages = known, joins, lines, pages

    def readable(self, words: list[str]) -> bool:
        """Whether most words are in the dictionary; junk isn't read."""
        known = sum(x in self.known or "-" in x and all(p in self.known or p.isdigit() for p in x.split("-")) for x in words)
        return known >= max(4, 0.5 * len(words))

    def furniture(self, lines: list[str], title: str | None, journal: str | None) -> dict[int, set[str]]:
        """Index of each furniture line: its kinds."""
        out: dict[int, set[str]] = {}
        full = [i for i, v in enumerate(lines) if v.strip()]
        if len(full) < 2:
            return out
        for k, i in enumerate(full):
            v = lines[i].strip()
            last = v[-1]
            if v[0] == "|" and last == "|":
                continue
            if len(v) < 24 and PAGE.fullmatch(v):
                before = lines[full[k - 1]].strip() if k else ""
                after = lines[full[k + 1]].strip() if k + 1 < len(full) else ""
                if self.pages.score_one(page_features(v, before, after, k in (0, len(full) - 1))) >= 0.5:
                    out[i] = {"page_number"}
                continue
            volume = last == ")" and VOLUME.search(v)
            if not volume and ENDS.search(v[-3:]):
                continue
            form = volume or " | " in v or "·" in v or "  " in v or v.isupper() or AUTHORS.match(v)
            if not form or "\t" in v or len(re.findall(r"\S\s{3,}(?=\S)", v)) > 1:
                continue
            if sum(map(str.isalpha, v)) < (0.5 if volume else 0.72) * len("".join(v.split())):
                continue
            before = lines[full[k - 1]].strip() if k else ""
            after = lines[full[k + 1]].strip() if k + 1 < len(full) else ""
            if self.lines.score_one(line_features(v, before, after, title or "", journal or "", k in (0, len(full) - 1))) >= 0.5:
                out[i] = {"running_header"} | ({"page_number"} if PAGE_AT_END.search(v) else set())
        return out

    def breaks(self, lines: list[str], furniture: dict[int, set[str]]) -> list[tuple[int, int, str, str]]:
        """(line, next line, left part, right part) of each word split by a hyphen that isn't its own."""
        out = []
        body = [i for i, v in enumerate(lines) if v.strip() and i not in furniture]
        for i, j in zip(body, body[1:]):
            end = lines[i].rstrip(" \t")
            m = BREAK_HYPHEN.search(end, max(0, len(end) - 60)) if end[-1:] in HYPHENS else None
            if not m or not m["left"][-1].isalpha():
                continue
            f = FIRST.match(lines[j].lstrip())
            if f and self.joins.score_one(join_features(m["left"], m["mark"], f[0], self.known)) >= 0.5:
                out.append((i, j, m["left"], f[0]))
        return out

    def noise(self, text: str, title: str | None, journal: str | None) -> tuple[set[str], set[str]]:
        """Kinds of noise but for misread words, and the words that aren't in the dictionary; both empty for junk."""
        kinds: set[str] = set()
        body = text
        if "\n" in text:
            lines = text.split("\n")
            fur = self.furniture(lines, title, journal)
            for k in fur.values():
                kinds |= k
            hy = self.breaks(lines, fur)
            if hy:
                kinds.add("hyphenation")
            if fur or any(c in text for c in HYPHENS):
                body = join_lines(lines, fur, hy)
        if "<" in body or "&" in body:
            body = TAG.sub(" ", body)
        found = LETTERED.findall(body.lower())
        new = {w for w in set(found) - self.known if w.isascii() or all(c.upper() != c for c in w if c.isalpha())}
        parts = {p for w in new for p in (w.split("-") if "-" in w else (w,))} - self.known
        unknown = {w for w in parts if len(w) > 1 and not w.isdigit()}
        symbol = ("¼" in text or "þ" in text) and SYMBOL.search(text)
        if (kinds or unknown or symbol) and not self.readable(found):
            return set(), set()
        if symbol:
            kinds.add("misread")
        return kinds, unknown


def join_lines(lines: list[str], furniture: dict[int, set[str]], hyphens: list[tuple[int, int, str, str]], paragraphs: bool = False) -> str:
    """The lines without furniture and with split words joined; as continuous paragraphs if asked for."""
    keep = dict(enumerate(lines))
    for i in furniture:
        keep.pop(i)
    joined = {i: j for i, j, _, _ in hyphens}
    out, i = "", 0
    order = sorted(keep)
    skip_space = False
    for pos, i in enumerate(order):
        v = keep[i].strip() if paragraphs else keep[i]
        if skip_space and not v.strip():
            continue
        if skip_space:
            v = v.lstrip()
        skip_space = False
        if i in joined:
            out += BREAK_HYPHEN.sub(lambda m: m["left"], v)
            skip_space = True
            continue
        if not paragraphs or pos + 1 == len(order):
            out += v + "\n"
            continue
        nxt = next((keep[k].strip() for k in order[pos + 1:] if keep[k].strip()), "")
        own = BREAK_HYPHEN.search(v)
        goes_on = v and nxt and (not re.search(r"[.?!:][\"'”’»)\]]*$", v) or nxt[0].islower()) and len(v) > 25
        if own and nxt[:1].isalpha():
            out, skip_space = out + v, True
        elif goes_on and (keep[order[pos + 1]].strip() or furniture.get(i + 1) or nxt[0].islower()):
            out, skip_space = out + v + " ", True
        elif v and keep[order[pos + 1]].strip() and len(v) > 25 and not v.startswith(("-", "•", "*", "|")):
            out += v + " "
        else:
            out += v + "\n"
    return out.strip("\n")


def repair(text: str, title: str | None, journal: str | None, reader: Reader, printed: dict[str, str]) -> str:
    """The text as continuous paragraphs: without furniture, split words joined, misread words replaced."""
    lines = text.split("\n")
    fur = reader.furniture(lines, title, journal)
    body = join_lines(lines, fur, reader.breaks(lines, fur), paragraphs=True)
    body = SYMBOL.sub(lambda m: SYMBOLS[m[0]], body)

    def word(m: re.Match) -> str:
        p = printed.get(m[0].lower())
        return m[0] if not p else p.upper() if m[0].isupper() and len(m[0]) > 2 else p.capitalize() if m[0][0].isupper() else p

    return re.sub(r"[^\W_]+", word, body) if printed else body


def prepare(chunk: DataFrame) -> tuple[Reader, DataFrame]:
    """The reader of a corpus, and its corrections (w, printed)."""
    vocabulary = cut(word_counts(chunk))
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    least = max(6, -(-total // DICTIONARY))
    words = {r["w"]: r["n"] for r in vocabulary.where(F.col("n") >= least).collect()}
    fixes = cut(corrections(vocabulary, least, train_ranker(words)))
    frequent = vocabulary.where(F.col("n") >= least).select("w")
    for r in fixes.join(frequent, "w", "left_semi").collect():  # within the dictionary's bound
        words.pop(r["w"], None)
    rows = chunk.where("length(chunk_text) > 200 AND content_type = 'prose'").select("chunk_id", "chunk_text", F.coalesce("title", F.lit("")).alias("t"), F.coalesce("journal", "guideline_version", F.lit("")).alias("j"))
    sample = [tuple(r) for r in hash_sample(rows, chunk.count(), "chunk_id", SAMPLE).select("chunk_text", "t", "j").collect()]
    sample.sort()
    return Reader(frozenset(words), train_joins(words), train_lines(sample), train_pages(sample)), fixes


def observed(chunk: DataFrame, reader: Reader) -> DataFrame:
    """chunk_id, kind, w: kinds of noise (w null) and words unknown to the dictionary (kind null)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, t, title, j in zip(b["k"], b["t"], b["title"], b["journal"]):
                kinds, words = reader.noise(t, title, j)
                rows += [(k, x, None) for x in kinds] + [(k, None, w) for w in words]
            if rows:
                yield pd.DataFrame(rows, columns=["k", "kind", "w"])

    src = chunk.where("chunk_text is not null").select(F.col("chunk_id").alias("k"), F.col("chunk_text").alias("t"), "title", "journal")
    return src.mapInPandas(run, f"k {src.schema['k'].dataType.simpleString()}, kind string, w string").withColumnRenamed("k", "chunk_id")


def noise(chunk: DataFrame) -> tuple[DataFrame, DataFrame, Reader]:
    """(chunk_id, kind; chunk_id, w, printed; the reader)."""
    reader, fixes = prepare(chunk)
    seen = cut(observed(chunk, reader))
    misread = seen.where("w is not null").select("chunk_id", "w").distinct().join(fixes, "w")
    kinds = seen.where("kind is not null").select("chunk_id", "kind").union(misread.select("chunk_id", F.lit("misread"))).distinct()
    return kinds, misread, reader


def found(chunk: DataFrame) -> DataFrame:
    """chunk_id, noise."""
    return noise(chunk)[0].select("chunk_id", F.col("kind").alias("noise"))


def repaired(chunk: DataFrame) -> DataFrame:
    """chunk_id, noise (sorted kinds), repaired: one row per chunk_id; texts without noise come out as they are."""
    kinds, misread, reader = noise(chunk)
    by = kinds.groupBy("chunk_id").agg(F.array_sort(F.collect_set("kind")).alias("noise"))
    fixes = misread.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "printed"))).alias("fixes"))
    order = ["loaded_at"] if "loaded_at" in chunk.columns else []
    rows = distinct_answers(chunk.select("chunk_id", "chunk_text", "title", "journal", *order), "chunk_id").join(by, "chunk_id", "left").join(fixes, "chunk_id", "left")

    @F.pandas_udf("string")
    def mend(t: pd.Series, n: pd.Series, title: pd.Series, journal: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or k is None else repair(x, a, b, reader, dict(m) if m is not None else {}) for x, k, a, b, m in zip(t, n, title, journal, f)], dtype=object)

    return rows.select("chunk_id", F.coalesce("noise", F.array().cast("array<string>")).alias("noise"), mend("chunk_text", "noise", "title", "journal", "fixes").alias("repaired"))
