"""Broken prompt and response pairs.

A multi-label linear classifier over hashed n-grams of the answer and features of the pair decides the
defects refusal, copied_query, wrong_language and truncated. Among the features are the language of
either text and by how much it is the likelier one, the words they share, and how the answer ends: its
marks and the end rate of its last trigram (module truncation). It is trained on synthetic responses
made from at most ``SAMPLE`` rows of the table: copies of queries, whole or changed or introduced;
answers swapped between languages; refused ones, written here or taken from short answers to queries
recorded as unanswerable; ones truncated inside a word or sentence, with and without a mark; and sound
ones, short replies and reservations followed by an answer among them. The threshold of each label is
calibrated on a third of the made pairs that is held out.

What is defined by form alone is checked exactly: empty answers; a refusal is a defect only where answerable
is true; a language can be wrong only where a query is given, and of a real answer, neither refused
nor copied.

Null queries, answers and answerables are allowed. Rows delivered twice count once.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ribbonmill.llm import truncation
from ribbonmill.session import cut, hash_sample

SAMPLE = 4000
LABELS = ("refusal", "copied_query", "wrong_language", "truncated")
#: How an answer ends, from the module truncation.
ENDS = ("cut", "end_rate", "evident", "half", "few", "echo", "closed", "marked")
DIM = 1 << 14
#: Placeholders, without marks and spaces.
PLACEHOLDERS = frozenset("none null na nan nil undefined empty tbd todo blank noanswer noresponse notapplicable pending error".split())
#: Refusals in several languages, as a seed.
REFUSALS = (
    "I cannot answer this question from the given context.", "I am unable to answer that.", "I'm sorry, but I can't help with that.", "Sorry, I do not know.",
    "As an AI assistant, I cannot provide medical advice.", "As a language model I should not give advice. Please ask a doctor.", "The provided documents do not contain enough information to answer.",
    "There is not enough information in the sources.", "No answer can be given on this basis.", "It is not possible to say from the material.", "None of the passages addresses this point.",
    "I must decline to respond.", "I would rather not speculate.", "Unfortunately nothing in the text speaks to this.", "The context is insufficient for an answer.", "My apologies, I have no answer to that.",
    "Les documents ne permettent pas de répondre à cette question.", "Je ne peux pas répondre à cette question.", "Les sources ne contiennent pas assez d'informations.",
    "Die Quellen enthalten keine ausreichenden Angaben zu dieser Frage.", "Ich kann diese Frage nicht beantworten.", "Leider kann ich dazu nichts sagen.",
    "Las fuentes no contienen información suficiente para responder.", "No puedo responder a esta pregunta.", "Lo siento, no lo sé.",
    "所提供的资料不足以回答这个问题。", "我无法回答这个问题。", "抱歉，资料中没有相关信息。", "提供された資料からは回答できません。", "申し訳ありませんが、この質問にはお答えできません。", "資料には十分な情報がありません。",
    "दिए गए स्रोतों में इस प्रश्न का उत्तर नहीं है।", "मैं इस प्रश्न का उत्तर नहीं दे सकता।", "क्षमा करें, पर्याप्त जानकारी नहीं है।", "แหล่งข้อมูลที่ให้มาไม่เพียงพอที่จะตอบคำถามนี้", "ขออภัย ไม่สามารถตอบคำถามนี้ได้",
)
RESERVATIONS = ("I cannot give a figure for one of these; the remaining points are covered.", "One source is insufficient here, unlike the following ones.", "Although part of this cannot be answered, the rest can.", "I do not know the exact dose, but the passages say the following.", "There is no information on costs; otherwise:")
_WORD = re.compile(r"[฀-๿぀-ヿ㐀-鿿]|[^\W\d_](?:[^\W\d_]|[ऀ-ॿ'’])*|\d+")
_SCRIPTS = (("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿]")), ("hi", re.compile("[ऀ-ॿ]")), ("th", re.compile("[฀-๿]")), ("ru", re.compile("[Ѐ-ӿ]")), ("ar", re.compile("[؀-ۿ]")), ("ko", re.compile("[가-힯]")))
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")


def words(text: str) -> list[str]:
    """Words in lower case, single characters in unspaced scripts, numbers as 0."""
    return ["0" if w.isdigit() else w for w in _WORD.findall(text.lower())]


def is_empty(answer: str | None) -> bool:
    """Null, blank or only a placeholder."""
    bare = re.sub(r"[\W_]+", "", (answer or "").lower())
    return bare == "" or bare in PLACEHOLDERS


#: Question and function words of languages of Latin script, beside those of common_word.
FUNCTION_WORDS = {
    "en": "what which when how why does did should is are can could would has have been who their these any more most",
    "fr": "quand quelle quel quels comment pourquoi faut il elle que qui après avant avec sont ont été cette ces par sous sur selon aucune",
    "es": "qué cuándo cómo cuál cuáles después antes tiene debe frente fue hay sobre según esta este unos entre sus",
    "de": "wie wann welche welcher warum wird werden nach vor beim vergleich oder kann sind wurde einer eines zum zur keine unter laut",
}


class Languages:
    """Language of a text: by script, and among languages of Latin script by common words and character trigrams, learned from texts by their common words.

    Words that several languages share as they are, such as names, say nothing and are left out.
    """

    def __init__(self, common: list[tuple[str, str]], texts: list[str]) -> None:
        self.lists: dict[str, set[str]] = {k: set(v.split()) for k, v in FUNCTION_WORDS.items()}
        for lang, w in common:
            self.lists.setdefault(lang, set()).add(w)
        seen: dict[str, Counter[str]] = {k: Counter() for k in self.lists}
        for t in texts:
            for s in re.split(r"(?<=[.?!])\s+|\n", t):
                ws = words(s)
                hits = sorted(((len(set(ws) & v), k) for k, v in self.lists.items()), reverse=True)
                if hits[0][0] >= 3 and hits[0][0] >= 2 * hits[1][0]:
                    seen[hits[0][1]].update(w for w in ws if w.isalpha())
        self.names = sorted(self.lists)
        langs = Counter(w for c in seen.values() for w in c)
        self.neutral = {w for w, n in langs.items() if n > 1 and not any(w in v for v in self.lists.values())}
        counts: dict[str, Counter[str]] = {k: Counter() for k in self.names}
        for k, c in seen.items():
            for w, n in c.items():
                if w not in self.neutral:
                    for g in self._grams(w):
                        counts[k][g] += n
            for w in self.lists[k]:
                for g in self._grams(w):
                    counts[k][g] += 3
        self.memo: dict[str, list[float] | None] = {}
        every = sorted(set().union(*counts.values()))
        self.logs = {g: np.array([np.log((counts[k][g] + 0.5) / (sum(counts[k].values()) + 0.5 * len(every))) for k in self.names]) for g in every}

    @staticmethod
    def _grams(w: str) -> list[str]:
        return [f" {w} "[i : i + 3] for i in range(len(w))]

    def _word(self, w: str) -> list[float] | None:
        """What a word adds to each language, or None where nothing is known of it."""
        if len(self.memo) > 100_000:
            self.memo.clear()
        if w not in self.memo:
            total, known = np.zeros(len(self.names)), False
            if w.isalpha() and w not in self.neutral:
                total = np.array([4.0 * (w in self.lists[k]) for k in self.names])
                for g in self._grams(w):
                    v = self.logs.get(g)
                    if v is not None:
                        total, known = total + v, True
            self.memo[w] = total.tolist() if known else None
        return self.memo[w]

    def scores(self, text: str) -> tuple[str, dict[str, float]]:
        """The likeliest language ("" if nothing is known) and what each language of Latin script scores a word."""
        latin = len(_LATIN.findall(text))
        best, n = "", 0
        if not text.isascii():
            for k, p in _SCRIPTS:
                c = len(p.findall(text)) * (3 if k in ("ja", "zh") else 1)
                if c > n:
                    best, n = ("ja" if k == "zh" and _SCRIPTS[0][1].search(text) else k), c
        if n * 2 > latin:
            return best, {}
        rows = [v for v in map(self._word, words(text)) if v is not None]
        if not rows:
            return "", {}
        total = [sum(c) / len(rows) for c in zip(*rows)]
        return self.names[total.index(max(total))], dict(zip(self.names, total))

    def of(self, text: str) -> str:
        return self.scores(text)[0]


def dense(query: str | None, answer: str, lang: Languages, end: dict[str, float], asked: tuple | None = None) -> list[float]:
    """Features of the pair; end: ENDS of the answer; asked: words and language of the query, if they are at hand."""
    a = words(answer)
    q, lq = asked or (words(query or ""), lang.of(query) if query else "")
    ca, cq = Counter(a), Counter(q)
    shared = sum(min(n, ca[w]) for w, n in cq.items())
    inside = sum(n for w, n in ca.items() if w in cq)
    n = len(a)
    cov_q, cov_a = shared / max(1, len(q)), inside / max(1, n)
    both = min(cov_q, cov_a) if q else 0.0
    la, each = lang.scores(answer)
    other = bool(la and lq) and la != lq
    margin = min(3.0, each[la] - each[lq] if la in each and lq in each else 3.0) if other else 0.0
    real = float(n >= 5)
    return [
        1.0,
        float(bool(q)),
        cov_q if q else 0.0,
        cov_a if q else 0.0,
        15 * max(0.0, both - 0.6),
        6.0 * (both >= 0.7),
        float(bool(q)) * min(n - inside, 20) / 20,
        6 * real * other,
        2 * real * margin,
        float(other) - real * other,
        min(3.0, np.log1p(n) / 2),
        float(n > 40),
        float(n < 30),
        min(2.0, sum(map(str.isdigit, answer)) / max(1, n) * 4),
        float("[SOURCE" in answer or "(SOURCE" in answer),
        *[(6.0 if k == "cut" else 1.0) * end[k] for k in ENDS],
    ]


def hashed(answer: str) -> np.ndarray:
    """Slots of the answer's word n-grams of one and two words, and of its last one, two and three words."""
    w = words(answer)
    grams = {*w, *map(" ".join, zip(w, w[1:])), *(f"{i} last {' '.join(w[-i:])}" for i in (1, 2, 3))}
    return np.fromiter({zlib.crc32(x.encode()) % DIM for x in grams}, np.int64)


class Classifier:
    """One weight vector a label over dense features and hashed n-grams, scaled by the root of their number; AdaGrad on the logistic loss."""

    def __init__(self) -> None:
        self.wd = np.zeros((0, len(LABELS)))
        self.wh = np.zeros((DIM, len(LABELS)))
        self.cut = np.full(len(LABELS), 0.5)

    def score(self, d: list[float], h: np.ndarray) -> np.ndarray:
        z = np.asarray(d) @ self.wd + (self.wh[h].sum(0) / np.sqrt(len(h)) if len(h) else 0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, rows: list[tuple[list[float], np.ndarray, np.ndarray]], epochs: int = 12, seed: int = 1) -> Classifier:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(rows))
        held, used = order[: len(rows) // 3], order[len(rows) // 3 :]
        k = len(rows[0][0])
        self.wd = np.zeros((k, len(LABELS)))
        gd, gh = np.full((k, len(LABELS)), 1e-6), np.full((DIM, len(LABELS)), 1e-6)
        for _ in range(epochs):
            for i in rng.permutation(used):
                d, h, y = rows[i]
                e = self.score(d, h) - y
                g = np.outer(d, e)
                gd += g * g
                self.wd -= 0.3 * g / np.sqrt(gd)
                if len(h):
                    v = e / np.sqrt(len(h))
                    gh[h] += v * v
                    self.wh[h] -= 0.3 * v / np.sqrt(gh[h]) + 1e-4 * self.wh[h]
        p = np.array([self.score(rows[i][0], rows[i][1]) for i in held])
        y = np.array([rows[i][2] for i in held])
        for j in range(len(LABELS)):
            best = (-1.0, 0.5)
            for c in np.linspace(0.2, 0.9, 29):
                hit = p[:, j] >= c
                f1 = 2 * (hit & (y[:, j] > 0)).sum() / max(1, hit.sum() + (y[:, j] > 0).sum())
                if f1 > best[0] + 1e-9 or abs(f1 - best[0]) < 1e-9 and abs(c - 0.5) < abs(best[1] - 0.5):
                    best = (f1, float(c))
            self.cut[j] = best[1]
        return self


def _break(text: str, r: random.Random) -> str | None:
    """The text cut inside a word or sentence, or None where no such place was found."""
    for _ in range(8):
        i = r.randrange(min(40, len(text) - 1), len(text)) if len(text) > 60 else 0
        if i and text[i - 1].isalnum() and (text[i].isalnum() or text[i] == " " and text[i + 1 : i + 2].islower()):
            return text[:i] + r.choice(("", "", "", "", "…", "...", " [...]"))
    return None


Made = tuple[str | None, str, tuple[int, int, int, int]]


def make_pairs(rows: list[tuple[str | None, bool | None, str, bool]], lang: Languages, seed: int = 13) -> list[Made]:
    """(query, answer, labels) made from (query, answerable, answer, whether its end is sound) rows."""
    r = random.Random(seed)
    asked = [x[0] for x in rows if x[0]]
    if not asked:
        asked = ["What does this text say?"]
    weak, sound = [], []
    for q, ok, a, whole in rows:
        if is_empty(a):
            continue
        w = words(a)
        n, known = len(w), set(words(q or ""))
        cov = sum(x in known for x in w) / max(1, n)
        cjk = any(p.search(a) for _, p in _SCRIPTS)
        if ok is False and 5 <= n <= (60 if cjk else 32) and cov < 0.6 and not re.match(r"^[\W\d]*\d", a) and a.count("\n") == 0:
            weak.append(a)
        elif n > (60 if cjk else 45) and cov < 0.5 and whole:
            sound.append((q, a, lang.of(a)))
    by_lang: dict[str, list[str]] = {}
    for _, a, k in sound:
        by_lang.setdefault(k, []).append(a)
    refusals = [*REFUSALS * 3, *weak[: SAMPLE // 4]]
    out: list[Made] = []
    tails = ("", "", "", " Please rephrase the query.", " Consider asking a specialist.", " More context is needed.", " [SOURCE 1]")
    heads = ("", "", "", "", "Answer: ", "Hmm. ", "**Answer:** ")
    language = {q: lang.of(q) for q in set(asked)}
    for a in refusals:
        q = r.choice(asked) if r.random() < 0.9 else None
        out.append((q, r.choice(heads) + a + r.choice(tails), (1, 0, 0, 0)))
    for q in r.sample(asked, min(len(asked), SAMPLE // 5)):
        w = q.split()
        v = r.choice((q, q.upper(), q.lower().rstrip("?？ "), q.rstrip("?？") + ".", "  ".join(w), " ".join(w[1:]) if len(w) > 3 else q, f"{q}\n\n{q}", f"Sure! {q}", f'You asked: "{q}"', f"Your question was: {q.rstrip('?')}…", f'"{q}"', f"Question: {q}"))
        out.append((q, v, (0, 1, 0, 0)))
        # begins with the query but answers it
        same = [a for a in (r.choice(sound)[1] for _ in range(8) if sound) if lang.of(a) == language[q]]
        if same:
            out.append((q, f"{q}\n\n{same[0]}", (0, 0, 0, 0)))
    for q, a, k in sound[: SAMPLE // 2]:
        q0 = q if q and language[q] == k else None
        p = r.random()
        if p < 0.15:
            a = f"{r.choice(RESERVATIONS)}\n\n{a}"
        elif p < 0.55:
            if b := _break(a, r):
                out.append((q0, b, (0, 0, 0, 1)))
            continue
        elif p < 0.65:
            a = re.match(r".+?(?<![^\W\d_]\.[^\W\d_])[.?!。！？।](?=\s|[぀-鿿]|$)|.+", a, re.S)[0]
            if len(words(a)) < 8:
                continue
        out.append((q0, a, (0, 0, 0, 0)))
    langs = [k for k in by_lang if k]
    for q in r.sample(asked, min(len(asked), SAMPLE // 5)):
        others = [k for k in langs if k != language[q]]
        if others:
            a = r.choice(by_lang[r.choice(others)])
            if r.random() < 0.6:  # as often as the languages are
                a = next((x for x, k in ((x[1], x[2]) for x in (r.choice(sound) for _ in range(20))) if k and k != language[q]), a)
            b = _break(a, r) if r.random() < 0.3 else None
            out.append((q, b or a, (0, 0, 1, int(b is not None))))
    for a in ("Yes", "No", "31%", "HR 0.93", "4 cycles", "6.2 months [SOURCE 1]", "Yes, for early disease", "tamoxifen", "Twice a day.", "letrozole 2.5 mg"):
        for _ in range(15):
            out.append((r.choice(asked), a, (0, 0, 0, 0)))
    for q in r.sample(asked, min(len(asked), SAMPLE // 10)):  # short replies in the words of the query
        w = q.rstrip("?？. ").split()
        out.append((q, r.choice((r.choice(w), f"Yes, for {' '.join(w[-r.randrange(2, 5) :])}", f"No, not in {' '.join(w[-r.randrange(2, 5) :])}")), (0, 0, 0, 0)))
    return out


def train(one: DataFrame, ends: DataFrame, counts: DataFrame, total: int, common_word: DataFrame) -> tuple[Classifier, Languages]:
    """The classifier and the languages, from a bounded sample in the order of a hash; total is the number of rows."""
    spark = one.sparkSession
    rows = hash_sample(one.where("answer is not null").select("query", "answerable", "answer", "answer_id"), total, "answer_id", SAMPLE)
    # an end is sound where its trigram is no cut's and it is closed by a mark, or is one of natural ends
    rows = rows.join(ends.select(F.col("k").alias("answer_id"), (~F.coalesce("cut", F.lit(True)) & (F.col("closed") | (F.col("end_rate") > 0.2))).alias("whole")), "answer_id", "left")
    rows = [(x["query"], x["answerable"], x["answer"], bool(x["whole"])) for x in rows.orderBy(F.xxhash64("answer_id"), "answer_id").collect()]
    common = sorted({(x[0], x[1].lower()) for x in common_word.where("lang is not null and word is not null").collect()})
    lang = Languages(common, [x[2] for x in rows])
    made = make_pairs(rows, lang)
    pairs = spark.createDataFrame([(i, q, a) for i, (q, a, _) in enumerate(made)], "answer_id long, query string, answer string")
    seen = {x["k"]: x for x in truncation.judged(truncation.prepared(pairs), counts, own=False).collect()}
    x = [(dense(q, a, lang, {k: seen[i][k] or 0.0 for k in ENDS}), hashed(a), np.array(y, float)) for i, (q, a, y) in enumerate(made)]
    return Classifier().fit(x), lang


def defects(answers: DataFrame, common_word: DataFrame) -> DataFrame:
    """answer_id, defect: a row per defect of each pair."""
    one = cut(truncation.with_query(truncation.distinct_answers(answers).withColumn("given", F.col("query"))).select("answer_id", "query", "given", "answerable", "answer"))
    base = truncation.prepared(one)
    counts = cut(truncation.trigram_counts(base))
    ends = cut(truncation.judged(base, counts).select("k", *ENDS))
    model, lang = train(one, ends, counts, one.count(), common_word)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple] = {}

        def asked(q: str) -> tuple:
            if q not in known:
                if len(known) > 20_000:
                    known.clear()
                known[q] = (words(q), lang.of(q))
            return known[q]

        for b in batches:
            out = []
            for k, q, given, ok, a, *end in zip(b["answer_id"], b["query"], b["given"], b["answerable"], b["answer"], *(b[c] for c in ENDS)):
                if is_empty(a):
                    out.append((k, "empty"))
                    continue
                q = q if isinstance(q, str) else None
                d = dense(q, a, lang, {c: v if v == v and v is not None else 0.0 for c, v in zip(ENDS, end)}, asked(q) if q else None)
                refusal, copied, wrong, truncated = map(bool, model.score(d, hashed(a)) >= model.cut)
                if copied:
                    out.append((k, "copied_query"))
                elif refusal:
                    if ok is not None and ok == ok and bool(ok):
                        out.append((k, "refusal"))
                elif wrong and isinstance(given, str):
                    out.append((k, "wrong_language"))
                if truncated:
                    out.append((k, "truncated"))
            if out:
                yield pd.DataFrame(out, columns=["answer_id", "defect"])

    src = one.join(ends.withColumnRenamed("k", "answer_id"), "answer_id")
    return src.mapInPandas(run, "answer_id long, defect string").distinct()


def found(answers: DataFrame, common_word: DataFrame) -> DataFrame:
    return defects(answers, common_word)
