"""Sentence units across languages and scripts.

Rules over character properties, one pass over the marks of a text: a line break ends a unit; so does a
sentence mark of any script (Unicode's Sentence_Break classes STerm and ATerm) with the closers (its closing
and final punctuation) and citations behind it, unless an abbreviation, an initial, a date or a number explains
it, or a quotation holds it that goes on or is part of a longer sentence; and so does, in Thai, a space between two
Thai characters. Marks other than . ? ! need no space after them.

Abbreviations are suppressed by language: those of every language, and those of the languages whose function
words a record holds (or all of them, where it holds none).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Line breaks (a pair counts once).
BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
#: Marks that end a sentence, in any script.
MARK = regex.compile(r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}]+")
NARROW = frozenset(".?!")
#: Quotation marks and their closers.
QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"', "›": "‹", "‹": "›"}
QUOTE = re.compile('["“”„«»「」『』]|\n[ \t]*\n')
CLOSER = regex.compile(r"[\p{Pe}\p{Pf}\"'*_`]")
CITATION = re.compile(r"[ \t ]*(?:\[(?:SOURCES? ?)?\d+(?:(?:, ?|; ?| and | ?[-–] ?)(?:SOURCES? ?)?\d+)*\]|\((?:SOURCES? ?)\d+(?:(?:, ?|; ?| and | ?[-–] ?)(?:SOURCES? ?)?\d+)*\))", re.I)
THAI_SPACE = re.compile("(?<=[฀-๿])[  ]+(?=[฀-๿])")
WORD_BEFORE = re.compile(r"[^\s()\[\]{}\"“”„«»‘’'<>|/,;:]+$")
#: Abbreviations after which a sentence goes on, in any language and by language.
COMMON = frozenset("dr prof ms mr mrs st vs cf ca fig figs p pp vol nr no.s e.g i.e sect approx abb".split())
GOES_ON = {
    "en": frozenset("sec suppl incl eq ref refs tab dept resp viz al.d nos".split()),
    "de": frozenset("bzw z.b u.a d.h evtl ggf inkl vgl bd hr usw.d".split()),
    "fr": frozenset("env mme mlle p.ex art ex fr".split()),
    "es": frozenset("dra sra sr srta p.ej ej núm aprox".split()),
    "hi": frozenset("डॉ श्री प्रो".split()),
}
#: Function words by which the languages of a record are told.
FUNCTION_WORDS = {
    "en": frozenset("the of and was were with for that by from is not but which".split()),
    "de": frozenset("der die und das mit den nicht ein eine von zu bei im auf wurde".split()),
    "fr": frozenset("le les des et une dans pour est du par chez la sur aux".split()),
    "es": frozenset("el los las del con para una por se la que en y".split()),
}
_LATIN_WORD = re.compile(r"[a-zà-ÿ]+")
_EVERY = frozenset().union(COMMON, *GOES_ON.values())


#: Abbreviations that may stand last in a sentence; it then ends if a new one plainly begins.
MAY_END = frozenset("max min avg etc al a.m p.m q.d b.i.d t.i.d u.s e.u u.k inc ltd jr sr usw jan feb mar apr jun jul aug sep sept oct nov dec ph.d m.d".split())
#: German months, after an ordinal day.
MONTHS = ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember", "Jänner")


def _quote_spans(text: str) -> list[tuple[int, int]]:
    """(open, close) of each closed quotation; a paragraph break or a missing closer undoes one."""
    spans: list[tuple[int, int]] = []
    start, closers = -1, ""
    for m in QUOTE.finditer(text):
        c, i = m[0], m.start()
        if len(c) > 1 or c == "\n":
            start = -1
        elif start >= 0:
            if c in closers:
                spans.append((start, i))
                start = -1
        elif c in QUOTES:
            start, closers = i, QUOTES[c]
    return spans


def suppressed_in(text: str) -> frozenset[str]:
    """The abbreviations to suppress in a record: those of any language and of the languages it is in."""
    ws = Counter(_LATIN_WORD.findall(text.lower()))
    hits = {k: sum(ws[w] for w in v) for k, v in FUNCTION_WORDS.items()}
    best = max(hits.values())
    known = [k for k, n in hits.items() if n and 3 * n >= best]
    if "ऀ" <= max(text) and any("ऀ" <= c <= "ॿ" for c in text):
        known.append("hi")
    return COMMON.union(*(GOES_ON[k] for k in known)) if known else _EVERY


def _begins(text: str, q: int) -> bool:
    """Whether what stands at q looks like the start of a sentence in a script with letter case."""
    c = text[q]
    if c.islower():
        word = re.match(r"[\w-]+", text[q:q + 24])[0]
        return any(x.isdigit() or x.isupper() for x in word)
    return True


def _explained(text: str, s: int, e: int, line_start: int, q: int, line_end: int, cited: bool, goes_on: frozenset[str]) -> bool:
    """Whether the single full stop at s is part of an abbreviation, initial, ordinal or list number."""
    m = WORD_BEFORE.search(text, max(line_start, s - 24), s)
    if not m:
        return text[line_start:s].strip() == ""
    word, first = m[0], m.start()
    low = word.lower()
    at_end = q >= line_end
    if word.isdigit() and (text[line_start:first].strip() in ("", "-", "*", "(") or (not at_end and text.startswith(MONTHS, q))):
        return not at_end
    if at_end or cited:
        return False
    if low in goes_on:
        return True
    if low == "no":
        return text[q].isdigit()
    if low in MAY_END or re.fullmatch(r"(?:[a-z]\.)+[a-z]", low):
        return not (_begins(text, q) and not text[q].isdigit() and text[q] not in "(,;:")
    if len(word) == 1 and word.isalpha() and word.isascii():
        return word.isupper() or word in "pzudsvoie"
    return text[q] in ",;:"


def unit_ends(text: str | None) -> list[int]:
    """End of each unit: the number of characters through its last non-space character. Null and blank texts have none."""
    if not text:
        return []
    ends: set[int] = set()
    spans = _quote_spans(text)
    opens = {o for o, _ in spans}
    k = 0
    goes_on = suppressed_in(text) if "." in text else COMMON
    pos, n = 0, len(text)
    while pos <= n:
        br = BREAK.search(text, pos)
        stop = br.start() if br else n
        body = text[pos:stop].rstrip()
        line_end = pos + len(body)
        if body:
            ends.add(line_end)
            for m in MARK.finditer(text, pos, line_end):
                s, e = m.span()
                wide = any(c not in NARROW for c in m[0])
                if not wide and m[0].count(".") >= 2 and not set(m[0]) - {"."}:
                    continue
                while k < len(spans) and spans[k][1] < s:
                    k += 1
                span = spans[k] if k < len(spans) and spans[k][0] < s else None
                p = e
                if span:
                    if text[e:span[1]].strip():
                        continue
                    p = span[1] + 1
                while p < line_end and p not in opens and CLOSER.match(text, p):
                    p += 1
                quoted = any(c in "\"'”’»」』" for c in text[e:p])
                if p > line_end:
                    continue
                if not wide and p < line_end and not text[p].isspace() and not CITATION.match(text, p, line_end):
                    if not (text.startswith("<", p) or "぀" <= text[p] <= "鿿" or "฀" <= text[p] <= "๿"):
                        continue
                cited = False
                while c := CITATION.match(text, p, line_end):
                    p, cited = c.end(), True
                q = p
                while q < line_end and text[q].isspace():
                    q += 1
                if m[0] == "." and not quoted and _explained(text, s, e, pos, q, line_end, cited, goes_on):
                    continue
                if q < line_end and not cited:
                    nxt = text[q]
                    if nxt in ",，、;；:：":
                        continue
                    if span and span[0] < s:
                        before = text[pos:span[0]].rstrip()[-1:]
                        led = before in tuple(",:：，;")
                        if not led and (not _begins(text, q) or (nxt.isalpha() and not nxt.isupper() and not nxt.islower())):
                            continue
                    elif quoted and not _begins(text, q):
                        continue
                ends.add(p)
            if "฀" <= max(body):
                for m in THAI_SPACE.finditer(text, pos, line_end):
                    if not any(o < m.start() < c for o, c in spans):
                        ends.add(m.start())
        if not br:
            break
        pos = br.end()
    return sorted(ends)


def sentence_units(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, unit_no, start_pos, end_pos, unit: the units of each text, in order; together they are the text.

    Space between units belongs to the unit after it, space at the end to the last. end_pos leaves out
    spaces at a unit's end. A null, empty or blank text has no units; repeated rows give repeated units.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, nos, starts, stops, units = [], [], [], [], []
            for k, t in zip(b["k"], b["t"]):
                e = unit_ends(t)
                a = 0
                for i, x in enumerate(e):
                    keys.append(k)
                    nos.append(i)
                    starts.append(a)
                    stops.append(x)
                    units.append(t[a:x] if i + 1 < len(e) else t[a:])
                    a = x
            if keys:
                yield pd.DataFrame({"k": keys, "unit_no": nos, "start_pos": starts, "end_pos": stops, "unit": units})

    src = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    kind = src.schema["k"].dataType.simpleString()
    return src.mapInPandas(run, f"k {kind}, unit_no int, start_pos int, end_pos int, unit string").withColumnRenamed("k", key)


def records(chunk: DataFrame, answers: DataFrame) -> DataFrame:
    """src_table, record_key, text of both tables; repeated rows remain."""
    a = chunk.select(F.lit("chunk").alias("src_table"), F.col("chunk_id").alias("record_key"), F.col("chunk_text").alias("text"))
    b = answers.select(F.lit("answers_llama3_natural").alias("src_table"), F.col("answer_id").cast("string").alias("record_key"), F.col("answer").alias("text"))
    return a.unionByName(b)


def all_units(chunk: DataFrame, answers: DataFrame) -> DataFrame:
    """src_table, record_key, unit_no, start_pos, end_pos, unit of every record, each record once."""
    rows = records(chunk, answers).dropDuplicates(["src_table", "record_key"])
    units = sentence_units(rows.select(F.struct("src_table", "record_key").alias("key"), "text"), "key", "text")
    return units.select("key.src_table", "key.record_key", "unit_no", "start_pos", "end_pos", "unit")


def found(chunk: DataFrame, answers: DataFrame, scope: DataFrame) -> DataFrame:
    """src_table, record_key, end_pos of the records in scope."""
    wanted = scope.select("src_table", "record_key").distinct()
    rows = records(chunk, answers).join(wanted, ["src_table", "record_key"], "left_semi")
    rows = rows.dropDuplicates(["src_table", "record_key"])
    units = sentence_units(rows.select(F.struct("src_table", "record_key").alias("key"), "text"), "key", "text")
    return units.select("key.src_table", "key.record_key", "end_pos")
