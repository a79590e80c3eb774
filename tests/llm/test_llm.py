"""The operators that prepare text for language models, on small cases and edge cases."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from ribbonmill.llm import boosting, encoding, markup, mixing, pairs, quality, repetition, scans, sentences, splitting, truncation

ANSWERS = "answer_id bigint, query_id string, query string, query_type string, answerable boolean, answer string, source string, loaded_at timestamp"
T = datetime(2026, 1, 1)


def answers(spark, rows):
    return spark.createDataFrame([(i, f"q{i}", q, "t", ok, a, s, T) for i, (q, ok, a, s) in enumerate(rows)], ANSWERS)


def test_truncation(spark):
    full = "The trial showed a clear benefit for patients with early disease. No new harm was seen after two years."
    rows = [("why?", True, full, "a")] * 6 + [("why?", True, f"{full}\n{full}", "a")] * 4
    rows += [("why?", True, full + " The trial showed a clear ben", "b"), ("why?", True, full + " The trial showed a clear", "b"), ("why?", True, "31%", "b"), ("why?", True, "", "b"), ("why?", True, None, None), ("what is it like in the end", True, "What is it like in the end", "b")]
    df = answers(spark, rows)
    df = df.union(df.where("answer_id = 10"))  # delivered twice
    assert {r[0] for r in truncation.found(df).collect()} == {10, 11}
    by = {r["source"]: (r["answers"], r["truncated"]) for r in truncation.by_source(df).collect()}
    assert by["b"] == (5, 2) and by["a"] == (2, 0)
    assert truncation.found(df.where("false")).count() == 0
    assert truncation.found(df.withColumn("n", F.lit(1)).withColumn("k", F.lit("x")).withColumn("level", F.lit(2))).count() == 2


def test_truncation_by_trigrams(spark):
    """Closed texts are cut only on evidence, short replies only in half a word, and the share of cuts is the same on more rows."""
    refusal = "It is impossible to tell on the basis of this material."
    body = "Blood was drawn between 7.5 and 9.25 hours after the dose of zotrelide. The dose was kept. The dose was kept for all of the patients."
    for times in (60, 600):
        rows = [("why?", True, f"{h} {refusal}{t}", "a") for h in ("Hmm.", "So:", "Answer:") for t in ("", " Please rephrase the query.", " [SOURCE 1]")]
        rows += [("why?", True, f"Case {w}.\n{body} Dose group{w} did well.", "a") for w in ("x" * (i + 1) for i in range(times))]
        n = len(rows)
        rows += [("why?", True, "The dose was kept. Blood was drawn between 9.", "b"), ("why?", True, "We saw 4.2 here. The dose was kept. The dose was ke", "b"), ("why?", True, "zotrelide", "b"), ("why?", True, "zotreli", "b"), ("why?", True, "The dose was kept.", "b"), ("why?", True, "The dose was kept for all of the pat…", "b")]
        got = {r[0] - n for r in truncation.found(answers(spark, rows)).collect()}
        assert got == {0, 1, 3, 5}


@pytest.mark.parametrize(
    ("text", "units"),
    [
        ("Dr. Ford saw 3.5 vs. 4.1 mm. Then he left.", ["Dr. Ford saw 3.5 vs. 4.1 mm.", "Then he left."]),
        ('He wrote: "It works. No harm." [SOURCE 2] Next one.', ['He wrote: "It works. No harm." [SOURCE 2]', "Next one."]),
        ('"Is it safe?" asked the group. p53 rose.', ['"Is it safe?" asked the group.', "p53 rose."]),
        ("A. B. Ford et al. New line.\n\n1. Item. two\nRest…  and on", ["A. B. Ford et al.", "New line.", "1. Item.", "two", "Rest…  and on"]),
        ("「減量は可能か？」と尋ねた。次。", ["「減量は可能か？」と尋ねた。", "次。"]),
        ("委员会写道：“有效。安全。”约一半。", ["委员会写道：“有效。安全。”", "约一半。"]),
        ("पहला वाक्य। दूसरा!", ["पहला वाक्य।", "दूसरा!"]),
        ("ผู้ป่วย 12 คน ดีขึ้น ยา abc ดี", ["ผู้ป่วย 12 คน", "ดีขึ้น", "ยา abc ดี"]),
        ("The dose was max. Then more came.", ["The dose was max.", "Then more came."]),
        ("Le traitement dure env. Deux mois et une dose par jour.", ["Le traitement dure env. Deux mois et une dose par jour."]),
        ("They had it with env. Then the rest of it.", ["They had it with env.", "Then the rest of it."]),
        *[(f"aa{m} bb{m}", [f"aa{m}", f"bb{m}"]) for m in "؟។။։።॥．｡۔‼"],
        ("Am 13. Mai wurde z. B. nichts. Ende", ["Am 13. Mai wurde z. B. nichts.", "Ende"]),
    ],
)
def test_sentences(text, units):
    ends = sentences.unit_ends(text)
    assert [text[a:b].strip() for a, b in zip([0, *ends], ends)] == units


def test_sentence_units_hold_the_text(spark):
    texts = ["  a. B c?\r\n\n d ", "", None, " \n ", "x" * 50_000, "one"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    out = sentences.sentence_units(df.withColumn("unit", F.lit("clash")), "k", "text").orderBy("k", "unit_no").collect()
    for k in (0, 4, 5):
        assert "".join(r["unit"] for r in out if r["k"] == k) == texts[k]
    assert {r["k"] for r in out} == {0, 4, 5}
    assert sentences.sentence_units(df.where("false"), "k", "text").count() == 0


def test_boosting():
    x = np.random.default_rng(0).random((600, 3))
    y = (x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)
    m = boosting.Boosted(trees=40, depth=3).fit(x[:400], y[:400])
    assert ((m.predict(x[400:]) > 0.5) == y[400:]).mean() > 0.9
    assert abs(m.score_one(tuple(x[0])) - m.predict(x[:1])[0]) < 1e-12


def test_scans(spark):
    base = "The patients were treated with the medicine for several months and the disease was confined to the breast in women under forty years. "
    title, journal = "Cost of medicine for patients", "Journal of Samples"
    rows = [(f"c{i}", base * 3, title, journal, "prose") for i in range(12)]
    noisy = "The pafients were treated with the medi-\ncine for several months and the disease\n\nJournal of Samples 12 (2020)\n\nwas confined to the brcast in women under\nforty years. p53 status is breast-\n" + "7\n"
    rows += [("n", noisy, title, journal, "prose"), ("e", "", None, None, "prose"), ("z", None, None, None, "prose"), ("j", "x9#f ~~2 b6bd7 c1^ " * 30, title, journal, "prose")]
    df = spark.createDataFrame(rows, "chunk_id string, chunk_text string, title string, journal string, content_type string").withColumn("guideline_version", F.lit(None).cast("string")).withColumn("w", F.lit(1))
    got = {(r["chunk_id"], r["noise"]) for r in scans.found(df).collect()}
    assert ("n", "misread") in got and ("n", "page_number") in got and ("n", "hyphenation") in got
    assert {k for k, _ in got} == {"n"}
    fixed = {r["chunk_id"]: r["repaired"] for r in scans.repaired(df).collect()}
    assert "patients were treated with the medicine for several months" in fixed["n"] and fixed["c0"] == base * 3 and fixed["e"] == "" and fixed["z"] is None
    assert scans.found(df.where("false")).count() == 0
    assert scans.visual_cost("rnonth", "month") == pytest.approx(0.2) and scans.visual_cost("abc", "abc") == 0


def test_splitting(spark):
    r = random.Random(2)
    for _ in range(200):
        words = [r.choice(("alpha", "b.", "c;", "中文字", "ไทย", "x" * r.randrange(1, 30))) + r.choice((" ", " ", "\n", "\n\n")) for _ in range(r.randrange(0, 300))]
        text, m = "".join(words), r.randrange(1, 60)
        o = r.randrange(0, m)
        pieces = splitting.split_text(text, m, o)
        toks = splitting.TOKEN.findall(text)
        assert all(splitting.count_tokens(p) == n <= m for p, n, _ in pieces)
        rebuilt = []
        for i, (p, _, a) in enumerate(pieces):
            t = splitting.TOKEN.findall(p)
            assert text[a:a + len(p)] == p
            assert i == 0 or t[:min(o, len(rebuilt))] == (rebuilt[-o:] if o else [])
            rebuilt += t[o if i else 0:]
        assert rebuilt == toks
    lim = spark.createDataFrame([("prose", 5, 2)], "content_type string, max_tokens int, overlap_tokens int")
    df = spark.createDataFrame([("a", "one two. three four five six seven", "prose", "S"), ("b", "short", "prose", None), ("c", None, "prose", None), ("d", "x " * 99, None, None)], "chunk_id string, chunk_text string, content_type string, section_h2 string")
    out = splitting.split_items(df.withColumn("k", F.lit(1)), lim).orderBy("piece_no").collect()
    assert {x["chunk_id"] for x in out} == {"a"} and all(x["token_count"] <= 5 and x["section_h2"] == "S" for x in out)
    assert [x[0] for x in splitting.found(df.union(df), lim).collect()] == ["a"]


def test_quality(spark, data):
    c, w = spark.read.parquet(f"{data}/chunk.parquet"), spark.read.parquet(f"{data}/common_word.parquet")
    rows = [
        ("list", "Criteria:\n" + "\n".join(f"- prior drug{i} within {i} months" for i in range(20)), "prose"),
        ("table", "Name;A;B\n" + "\n".join(f"item {i};{i}%;{i}.5" for i in range(20)), "prose"),
        ("junk", " ".join(f"{i * 7919:08x}" for i in range(40)), "prose"),
        ("prose", "The patients were treated for two years and most of them were well at the end of the trial. " * 4, "prose"),
        ("null", None, "prose"),
        ("other", "- a\n- b", "table"),
    ]
    extra = spark.createDataFrame(rows, "chunk_id string, chunk_text string, content_type string")
    got = {r["chunk_id"]: r["text_kind"] for r in quality.found(c.select("chunk_id", "chunk_text", "content_type").union(extra), w).collect()}
    assert got["list"] == "list" and got["table"] == "table" and got["junk"] == "junk" and got["null"] == "junk" and "prose" not in got and "other" not in got
    s = {r["chunk_id"]: r for r in quality.document_statistics(extra, w).collect()}
    assert s["prose"]["words"] == 76 and s["prose"]["punctuated_line_share"] == 1.0 and s["null"]["words"] == 0
    assert quality.found(extra.where("false"), w).count() == 0
    texts = [r[0] for r in c.where("content_type = 'prose'").orderBy("chunk_id").select("chunk_text").collect()]
    case = quality.to_sql(quality.learn(texts, quality.common_words(w)))
    assert case.startswith("CASE WHEN") and sum(x in case for x in quality.STATISTICS) >= 3


def test_pairs(spark, data):
    a, w = spark.read.parquet("/root/testdata/sf0.01/answers_llama3_natural.parquet"), spark.read.parquet(f"{data}/common_word.parquet")
    q = "What is the recommended first treatment for node-positive disease in older women?"
    rows = [(q, True, "n/a", "s"), (q, True, None, "s"), (q, True, q.upper(), "s"), (q, True, "I cannot answer this question from the given context.", "s"), (q, False, "I cannot answer this question from the given context.", "s"), (q, True, "La guía recomienda el tratamiento cuando hay afectación de los ganglios. No hubo diferencias en la supervivencia tras dos años.", "s"), (None, True, "La guía recomienda el tratamiento cuando hay afectación de los ganglios.", "s"), (q, True, "31%", "s"), (q, None, "Yes", "s")]
    extra = answers(spark, rows).withColumn("answer_id", F.col("answer_id") + 10_000_000)
    got = {(r[0] - 10_000_000, r[1]) for r in pairs.found(a.unionByName(extra), w).where("answer_id >= 10000000").collect()}
    assert got == {(0, "empty"), (1, "empty"), (2, "copied_query"), (3, "refusal"), (5, "wrong_language")}
    assert pairs.is_empty(" ​") and not pairs.is_empty("No")


def test_pairs_are_the_models(spark, data, monkeypatch):
    """Without the model none of its four labels comes out; only what is empty does."""
    a, w = spark.read.parquet("/root/testdata/sf0.01/answers_llama3_natural.parquet"), spark.read.parquet(f"{data}/common_word.parquet")
    with_model = {r[0]: r[1] for r in pairs.found(a, w).groupBy("defect").count().collect()}
    assert set(with_model) == {"empty", *pairs.LABELS}
    monkeypatch.setattr(pairs.Classifier, "fit", lambda self, rows: setattr(self, "cut", np.full(len(pairs.LABELS), 2.0)) or setattr(self, "wd", np.zeros((len(rows[0][0]), len(pairs.LABELS)))) or self)
    without = {r[0]: r[1] for r in pairs.found(a, w).groupBy("defect").count().collect()}
    assert without == {"empty": with_model["empty"]}


def test_markup(spark):
    rows = [("a", "d", "<p>x &amp; y</p>\n<li>one", "prose"), ("b", "d", "## Head\n**bold** text", "prose"), ("c", "d", "== H ==\n[[A|b]] ''it''", None), ("e", "d", r"\section{T} $x^2$ 5\%", "table"), ("f", "d", "costs $5 and $6 in arm_4 & arm_7, n < 3 and p > 2 in {C} * or #\n* item\n| a | b |\n|---|---|\n=====", "prose"), ("g", "d", "<b>x</b>", "figure_caption"), ("h", None, None, "prose"), ("i", "d", "", "prose")]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_text string, content_type string")
    assert {(r[0], r[1]) for r in markup.found(df.union(df)).collect()} == {("a", "html"), ("b", "markdown"), ("c", "wiki"), ("e", "latex")}
    out = {r["chunk_id"]: r["clean_text"] for r in markup.clean_table(df).collect()}
    assert out["a"] == "x & y\n\n- one" and out["b"] == "## Head\nbold text" and out["c"] == "## H\nb it" and out["e"] == "# T\n $x^2$ 5%" and out["f"] == rows[4][2] and out["h"] is None
    assert markup.found(df.where("false")).count() == 0
    assert "```r\nx <- 1\n```" in markup.clean("a\n```r\nx <- 1\n```\n<br>b")


def test_markup_by_its_class(spark):
    """Tags of no known element are markup only through a class that holds both, in order and nested on all pages of their host."""
    rows = [
        ("a1", "a", "<sect1>One <xterm id='1'>term</xterm> here.</sect1>"), ("a2", "a", "<sect1>Two</sect1> and <xterm>x</xterm>"),
        ("b1", "b", "<sect1>One"), ("b2", "b", "Two</sect1>"),  # equal counts over the host, but never on one page
        ("c1", "c", "<aa>one <bb>two</aa> three</bb>"),  # badly nested
        ("d1", "d", "n <five and m> six, <figno> 3"),
    ]
    df = spark.createDataFrame([(*r, "prose") for r in rows], "chunk_id string, doc_id string, chunk_text string, content_type string")
    assert {(r[0], r[1]) for r in markup.found(df).collect()} == {("a1", "html"), ("a2", "html")}
    out = {r["chunk_id"]: r["clean_text"] for r in markup.clean_table(df).collect()}
    assert out["a1"] == "One term here." and out["a2"] == "Two and x" and all(out[k] == t for k, _, t in rows[2:])
    got = {(r["chunk_id"], r["path"], r["slot"]) for r in markup.slot_table(df).collect()}
    assert {("a1", "weak_tag sect1", "One  here."), ("a1", "weak_tag sect1/weak_tag xterm", "term"), ("a2", "weak_tag xterm", "x")} <= got
    valid = {(r["host"], r["token"]): r["valid"] for r in markup.classes(markup.occurrences(df)).collect()}
    assert valid["a", "weak_tag sect1<"] and not any(v for (h, _), v in valid.items() if h in "bcd")


def test_encoding(spark):
    t = encoding.tokenizer()
    r = random.Random(3)
    for k in range(600):
        a = r.choice(("abc", "aAbB01 ", "ACGT", "👍é", "中文的了", "  \n\ta", "'s't're ", "-=_*")) + r.choice(("x", " ", "文"))
        x = "".join(r.choice(a) for _ in range(r.randrange(1, 700))) if k % 3 else a * r.randrange(1, 200)
        assert encoding.encode_text(x, leaf_chars=r.choice((7, 40, 150))) == t.encode(x, add_special_tokens=False).ids
    rows = [(1, ""), (2, None), (3, "hello world"), (4, "q" * 20_000), (5, "<|endoftext|>"), (3, "hello world")]
    got = encoding.encode_corpus(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1))).collect()
    for d, x in rows:
        assert [g["ids"] for g in got if g["doc_id"] == d][0] == t.encode(x or "", add_special_tokens=False).ids
    assert len(got) == 6 and [g["ids"] for g in got if g["doc_id"] == 2] == [[]]
    long = [(1, "word and more " * 900), (1, "word and more " * 900), (1, "y" * 9000 + " é" * 3000), (2, "中" * 9000)]  # equal rows, and another text under one key
    df = spark.createDataFrame(long, "doc_id bigint, text string")
    want = sorted(t.encode(x, add_special_tokens=False).ids for _, x in long)
    assert sorted(g["ids"] for g in encoding.encode_corpus(df).collect()) == want
    assert sorted(g["tokens"] for g in encoding.token_counts(df).collect()) == sorted(map(len, want))


def test_mixing(spark):
    r = random.Random(1)
    docs = [(i, f" {r.choice('AABC')} ", "x") for i in range(3000)]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("source", F.when(F.col("doc_id") == 7, None).otherwise(F.col("source")))
    sizes = "size"
    df = df.withColumn(sizes, (1 + F.col("doc_id") % 50).cast("int"))
    targets = spark.createDataFrame([("a", 0.2, 1), ("b", 0.5, 2), ("c", 0.3, 1), ("zz", 0.0, 3)], "source string, target_share double, max_repeats int")
    used, report = mixing.mix(df, targets, sizes)
    rep = {x["source"]: x for x in report.collect()}
    assert abs(rep["a"]["actual_tokens"] - rep["a"]["target_tokens"]) <= 25 and rep["zz"]["actual_tokens"] == 0
    assert abs(rep["b"]["actual_tokens"] - min(rep["b"]["target_tokens"], 2 * rep["b"]["available_tokens"])) <= 25
    assert rep["c"]["actual_tokens"] == rep["c"]["available_tokens"] < rep["c"]["target_tokens"]
    assert used.where("repeats > 2 OR doc_id = 7").count() == 0 and used.select("doc_id").distinct().count() == used.count()
    assert mixing.mix(df.where("false"), targets, sizes)[0].count() == 0
    three = spark.createDataFrame([(1, "a", "x y"), (1, "a", "x y"), (2, "A ", "z")], "doc_id bigint, source string, text string")  # a row delivered twice stays two rows
    used, report = mixing.mix(three, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert sorted((x["doc_id"], x["tokens"]) for x in used.collect()) == [(1, 2), (1, 2), (2, 1)] and report.first()["actual_tokens"] == 5


def test_repetition(spark):
    sentence = "Order the medicine online today for the best price. "
    other = "A quite different sentence number {} tells of river, stone and tree in its own words. "
    assert repetition.repeated_share(sentence * 5) == pytest.approx(0.8)
    assert repetition.repeated_share("".join(other.format(i) for i in ("one",)) + sentence) == 0
    assert repetition.repeated_share("1. Alpha beta gamma delta.\n2. ALPHA  beta gamma delta!") == 0.5
    assert repetition.repeated_share("中文的句子在这里重复了很多次，非常无聊。" * 4) > 0.7
    assert [repetition.repeated_share(x) for x in (None, "", " \n", "a a a")] == [0, 0, 0, 0]
    df = spark.createDataFrame([(1, sentence * 9, "EN"), (2, other, None), (3, None, "en"), (4, "", "en"), (1, sentence * 9, "EN")], "doc_id bigint, text string, lang string")
    assert [r[0] for r in repetition.found(df).collect()] == [1]
    p = repetition.perplexities(df).collect()
    assert len(p) == 5 and all(x["perplexity"] is None or x["perplexity"] > 0 for x in p) and [x["perplexity"] for x in p if x["doc_id"] == 3] == [None]
    m = repetition.train(df.select("text"))
    assert m.perplexity(sentence) < m.perplexity("stone river unknown words entirely")


def test_perplexity_keeps_all_entries(spark):
    """Against dictionaries that hold every n-gram, on more than a million of them."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(r.choices(words, k=3000)), "en") for i in range(350)]
    n3, p3, p2, p1 = {}, {}, {}, {}
    for _, t, _ in docs:
        w = ["<s>", "<s>", *t.split()]
        for g in zip(w, w[1:], w[2:]):
            n3[g] = n3.get(g, 0) + 1
    assert len(n3) > 1_000_000
    n2 = {}
    for g in n3:
        n2[g[1:]] = n2.get(g[1:], 0) + 1
    n1 = {}
    for g in n2:
        n1[g[1]] = n1.get(g[1], 0) + 1
    total, kinds = sum(n1.values()) + 1, len(n1) + 1
    for g, n in n1.items():
        p1[g] = (n - 0.75 + 0.75 * (kinds - 1) / kinds) / total
    for counts, out, lower in ((n2, p2, lambda g: p1[g[1]]), (n3, p3, lambda g: p2[g[1:]])):
        c = {}
        for n in counts.values():
            c[n] = c.get(n, 0) + 1
        d, all_, lost = repetition._discounts(c), {}, {}
        for g, n in counts.items():
            all_[g[:-1]] = all_.get(g[:-1], 0) + n
            lost[g[:-1]] = lost.get(g[:-1], 0) + d[min(n, 3) - 1]
        for g, n in counts.items():
            out[g] = (n - d[min(n, 3) - 1] + lost[g[:-1]] * lower(g)) / all_[g[:-1]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(4)
    got = {x["doc_id"]: x["perplexity"] for x in repetition.perplexities(df).collect()}
    for i, t, _ in docs[::50]:
        w = ["<s>", "<s>", *t.split()]
        assert got[i] == pytest.approx(np.exp(-np.mean([np.log(p3[g]) for g in zip(w, w[1:], w[2:])])))


def test_markup_classes(spark):
    """Opening and closing tokens are lexed apart: crossing and stray ones are in no valid class, and the template leaves them."""
    rows = [("a", "d", "x *one <b>two* three</b> y", "prose"), ("b", "e", "x *one <b>two</b> three* y", "prose"), ("c", "f", "<p>P 5* and *more", "prose"), ("d", "g", "*a**b*", "prose"), ("e", "h", "*it* <i>x</i>", "prose"), ("f", "h", "a *b <i>c* d</i>", "prose")]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_text string, content_type string")
    assert {(r[0], r[1]) for r in markup.found(df).collect()} == {("a", "html"), ("b", "html"), ("b", "markdown"), ("c", "html"), ("e", "html"), ("e", "markdown"), ("f", "html")}
    weak = {(r["host"], r["token"], r["valid"]) for r in markup.classes(markup.occurrences(df).where("weak")).collect()}
    assert {("d", "weak_star<?", False), ("d", "weak_star>?", False), ("e", "weak_star<", True), ("e", "weak_star>", True), ("f", "weak_star<?", False), ("f", "weak_star>?", False), ("h", "weak_star<", True), ("h", "weak_star<?", False)} <= weak
    assert {r["host"]: r["tokens"] for r in markup.template(markup.occurrences(df)).collect()} == {h: ["weak_star<", "weak_star>"] for h in ("e", "h")}
    out = {r["chunk_id"]: r["clean_text"] for r in markup.clean_table(df).collect()}
    assert out["a"] == "x *one two* three y" and out["b"] == "x one two three y" and out["c"] == "P 5* and *more" and out["e"] == "it x" and out["f"] == "a *b c* d"


def test_markup_template_deduction(spark):
    """All tokens of a host form classes; one that isn't ordered or nested is divided; a tag that is never closed counts only through its class."""
    hosts = {
        "class": ["<figno> one {{a}} two [[b]]"] * 3,
        "order": ["<figno> one {{a}} two [[b]]"] * 2 + ["[[b]] one {{a}} two <figno>"],
        "nesting": [r"<figno> one \foo {{a}} two ''' [[b]]"] * 3 + [r"\foo x '''"],  # \foo and ''' reach over a gap of the others
        "nested": [r"<figno> one \foo ''' {{a}} two [[b]]"] * 3 + [r"\foo x '''"],
        "pages": ["<figno> one {{a}} two [[b]]"] * 2,
        "closed": ["<figno> one {{a}} two [[b]]"] * 3 + ["end</figno>"],
        "alone": ["<figno> one <pageno> two <lineno>"] * 3,
        "crossing": ["a *b <xx>c* d</xx>"],
        "deep": ["<div>a <div>b <b>c</b> d</div></div> <i>e"],
    }
    rows = [(f"{h}{i}", h, t, "prose") for h, ts in hosts.items() for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_text string, content_type string")
    got = markup.found(df).collect()
    assert {r["chunk_id"] for r in got if r["markup"] == "html"} == {"class0", "class1", "class2", "nested0", "nested1", "nested2", "deep0"}
    assert not any(r["chunk_id"].startswith(("alone", "crossing")) for r in got)
    c = markup.classes(markup.occurrences(df)).collect()
    size = {(r["host"], r["token"]): r["size"] for r in c}
    assert size["class", "wiki_template"] == 3 and size["order", "wiki_template"] == size["nesting", "wiki_template"] == 1 and size["nested", "wiki_template"] == 3 and size["nested", "latex_command"] == 2
    assert len({r["path"] for r in c if r["host"] == "deep" and r["token"] == "<div>"}) == 2
    out = {r["chunk_id"]: r["clean_text"] for r in markup.clean_table(df).collect()}
    assert out["class0"] == "one  two b" and "<figno>" in out["order0"] and "<figno>" in out["nesting0"] and out["crossing0"] == hosts["crossing"][0]
    slot = {(r["path"], r["slot"]) for r in markup.slot_table(df.where("doc_id = 'deep'")).collect()}
    assert slot == {("html div", "a "), ("html div/html div", "b  d"), ("html div/html div/html b", "c")}


def test_pairs_hash_whole_answers():
    head, tail = "肝" * 1000, "尾声结束"
    assert len(pairs.words(head + tail)) > 1000
    assert set(pairs.hashed(tail)) <= set(pairs.hashed(head + tail))


def test_scans_page_numbers_by_their_neighbours():
    texts = [(" ".join(f"word{i} of the text {j} goes on and on." for i in range(12)), "t", "j") for j in range(200)]
    m = scans.train_pages(texts)
    f = lambda line, before, after, edge=False: m.score_one(scans.page_features(line, before, after, edge)) >= 0.5
    assert f("12", "The text goes on", "to the next page.") and f("- 12 -", "It ends here.", "", True)
    assert not f("12", "45.1", "33%") and not f("12", "14 (3)", "9.5")


def test_scans_judge_long_lines_and_words():
    """What was beyond a bound of length is treated like what was under it."""
    class Yes:
        def score_one(self, x):
            return 1.0

    reader = scans.Reader(frozenset(), Yes(), Yes(), Yes())
    for n in (100, 129, 131, 400):
        head = "Journal of Made Names  " + "x" * (n - 23)
        assert reader.furniture(["A line of text that goes on", head, "and ends here."], "t", None) == {1: {"running_header"}}
