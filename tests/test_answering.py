"""Answering, figures in documents, review of gold and metadata: small and edge cases, and their queries against SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from ribbonmill import registry
from ribbonmill.operators import answering, captions, chunking, dense, figures, review, sparse
from ribbonmill.operators.cleaning import REFUSAL
from ribbonmill.sources import files


def one(spark, column, lists=False, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) or lists else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


def test_segments(spark):
    f = lambda body, blocks: [(x["text"], x["is_figure"]) for x in one(spark, figures.segments(F.col("b"), F.col("k")), b=body, k=blocks)]
    assert f("a FIG1 b FIG2", ["FIG2", "FIG1", "none"]) == [("a ", False), ("FIG1", True), (" b ", False), ("FIG2", True)]
    assert f("FIG1\n \nFIG2 tail", ["FIG1", "FIG2"]) == [("FIG1", True), ("FIG2", True), (" tail", False)]
    assert f("text", []) == [("text", False)] and f(None, ["x"]) == [("", False)]


def test_kept_figures(spark):
    rows = [("d", 1, "x", 300, 300), ("d", 2, "x", 300, 300), ("d", 3, "x", 10, 300), ("d", 4, "y", None, None), ("e", 1, "x", 300, 300), ("e", 0, "x", 10, 10)]
    df = spark.createDataFrame(rows, "doc_id string, i int, t string, w int, h int")
    got = {(r["doc_id"], r["i"]): r["reason"] for r in figures.kept(df, "t", F.col("w"), F.col("h")).collect()}
    assert got == {("d", 1): None, ("d", 2): "duplicate", ("d", 3): "too small", ("d", 4): None, ("e", 1): None, ("e", 0): "too small"}
    assert figures.kept(df.where("false"), "t", F.col("w"), F.col("h")).count() == 0


def test_all_placeholder_formats():
    fig = lambda n: {"figure_no": n, "filename": f"f{n}.png", "action": "caption", "summary": f"S{n}", "enriched": None, "metadata": "{}"}
    text = "<!-- image -->\n![](figures/f2.png)\n![image](x/f3.png)\n![Figure from oncology document: z](f4.png)\n![a caption made before](figures/f5.png)\n![other](other.png)"
    out, made, lost = captions.inject(text, [fig(n) for n in range(1, 7)])
    assert made == 5 and [x["figure_no"] for x in lost] == [6] and all(f"![S{n}](figures/f{n}.png)" in out for n in range(1, 6)) and "![other](other.png)" in out
    again, made, lost = captions.inject(out, [fig(n) for n in range(1, 6)])
    assert again == out and made == 5 and not lost


def test_written_array_and_positions(spark, tmp_path):
    import json

    df = spark.createDataFrame([(2, "b\n"), (1, None)], "i int, t string")
    assert files.write_array(df, str(tmp_path / "a.json"), "i") == 2
    assert json.load(open(tmp_path / "a.json")) == [{"i": 1}, {"i": 2, "t": "b\n"}] and files.write_array(df.where("false"), str(tmp_path / "e.json")) == 0
    v = spark.createDataFrame([(f"c{i}", [float(i)]) for i in range(9)], "chunk_id string, vector array<double>")
    p = spark.createDataFrame([("x", "c0", 1)], "term string, chunk_id string, tf int")
    files.write_index(p, p.select("chunk_id"), p.select("term"), v, str(tmp_path / "index"))
    at = files.read_index(spark, str(tmp_path / "index"))["positions"].collect()
    assert len({(r["file"], r["position"]) for r in at}) == 9 and {r["chunk_id"] for r in at} == {f"c{i}" for i in range(9)}


def test_answers(spark):
    q = spark.createDataFrame([("a",), ("b",)], "query_id string")
    p = spark.createDataFrame([("c1", " text ", 1)], "chunk_id string, chunk_text string, answer int")  # a clashing name
    s = spark.createDataFrame([("a", "c1", False, 1)], "query_id string, chunk_id string, from_net boolean, rank int")
    assert {tuple(r) for r in answering.answers(q, s, p).collect()} == {("a", "text", 1), ("b", REFUSAL, 0)}
    rows = spark.createDataFrame([(True, "t", REFUSAL), (True, None, "yes"), (False, "t", REFUSAL), (False, "t", None), (None, "t", "x")], "answerable boolean, query_type string, answer string")
    got = {tuple(r) for r in answering.behaviour(rows).collect()}
    assert {("answer", "all", 2, 1), ("abstain", "all", 2, 1), ("answer", "t", 1, 0), ("answer", "none", 1, 1)} <= got
    assert answering.answered(rows).count() == 2


def test_review(spark):
    gold = spark.createDataFrame([("q", "alpha beta gamma", True, ["d_chunk_0", "gone_chunk_1"], "chunk states delta 12.5")], "query_id string, query string, answerable boolean, relevant_chunk_ids array<string>, notes string")
    p = spark.createDataFrame([("d_chunk_0", "d", "alpha beta gamma"), ("d_chunk_1", "d", "delta 12.5 alpha beta gamma"), ("d_chunk_2", "d", None)], "chunk_id string, doc_id string, chunk_text string")
    r = review.drift(gold, p)
    assert {(x["chunk_id"], x["share"], x["valid"], x["missing"]) for x in r.collect()} == {("d_chunk_0", 0.6, True, False), ("gone_chunk_1", 0.0, False, True)}
    assert [tuple(x) for x in review.drift_counts(r).collect()] == [("d", 0, 1)] and review.proposals(r, p).count() == 0
    assert review.deep_merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 4}, "e": 5}) == {"a": {"b": 4, "c": 2}, "d": 3, "e": 5}
    assert one(spark, review.nfkc(F.col("t")), t="ﬁ²") == "fi2" and one(spark, review.nfkc(F.col("t")), t=None) is None
    assert one(spark, review.context(F.col("t"), F.col("a")), t="x" * 2000, a="") == "FIRST-PAGE TEXT:\n" + "x" * 1500
    assert one(spark, review.same_lists(F.col("a"), F.col("b")), a=["B ", "a"], b=["A", "b"]) and not one(spark, review.same_lists(F.col("a"), F.col("b")), lists=True, a=None, b=["b"])


def test_packing_is_linear_and_exact(spark):
    text = "\n".join(f"w{i} x y" for i in range(3000))
    g = one(spark, chunking.pack(F.split("t", "\n"), 10, "\n"), t=text)
    assert len(g) == 1000 and all(len(x.split()) == 9 for x in g) and "\n".join(g) == text
    assert one(spark, chunking.pack(F.split("t", "\n"), 2, "\n"), t="a b c\nd") == ["a b c", "d"]


def test_suppressed_by_levels(spark):
    heads = [(1, "A"), (2, "References"), (3, "x"), (2, "B"), (1, "Funding"), (2, "y"), (2, "References"), (3, "z"), (1, "C"), (3, "Funding"), (3, "d")]
    df = spark.createDataFrame([("k", i, n, h) for i, (n, h) in enumerate(heads)], "doc_id string, section_no int, level int, heading string")
    got = [r["suppressed"] for r in chunking.suppressed(df).orderBy("section_no").collect()]
    assert got == [False, True, True, False, True, True, True, True, False, True, False]


def test_sparse_edges(spark):
    p = spark.createDataFrame([("a", "x y y", 1), ("b", "x", 2), ("c", None, 3), ("d", " ", 4)], "chunk_id string, chunk_text string, score int")
    q = spark.createDataFrame([("1", "Y x"), ("2", None), ("3", "zzz")], "query_id string, query string")
    got = [(r["query_id"], r["chunk_id"], r["rank"]) for r in sparse.search(q, p, 5).orderBy("rank").collect()]
    assert {x[0] for x in got} == {"1"} and got[0][1] == "a"
    assert sparse.search(q, p.where("false"), 5).count() == 0 and sparse.search(q.where("false"), p, 5).count() == 0


def test_approximate_search(spark):
    import numpy as np

    r = np.random.default_rng(1)
    c = r.standard_normal((20, 16))
    x = np.repeat(c, 40, axis=0) + 0.2 * r.standard_normal((800, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([(i, [float(t) for t in row]) for i, row in enumerate(x)], "chunk_id int, vector array<double>")
    q = v.where("chunk_id % 40 = 0").withColumnRenamed("chunk_id", "query_id")
    a = dense.agreement(dense.search(q, v, 10), dense.approximate(q, v, 10)).collect()
    assert sum(t["recall"] for t in a) / len(a) >= 0.9
    assert dense.centres(v)[1] <= 14  # of 28 lists: clustered vectors need a part of them
    assert dense.approximate(q.where("false"), v).count() == 0


NAMES = ("line_pack", "numeric_flags", "numeric_totals", "labelling_sheet", "behaviour", "gold_drift", "drift_counts", "drift_proposals", "review_filter", "missing_report", "build_meta", "meta_context", "list_conflicts", "encoded_keys", "figure_blocks", "figure_segments", "figure_filter", "heal_json", "harness_run", "known_ids", "merge_lists", "defensive_merge", "chunk_with_figures", "tier_summary", "valid_extractions", "without_figures", "boilerplate_totals", "check_report", "next_to_do", "ungrounded_tokens", "answer_sources", "rerank_delta", "retrieval_quality")


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in os.listdir(data):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{data}/{t}'")
    b = con.execute(registry.oracle_sql()[name])
    cols = [x[0] for x in b.description]
    rows = registry.queries()[name](spark, data).select(*[f"`{c}`" for c in cols]).collect()
    plain = lambda r: repr([round(float(x), 6) if isinstance(x, float) else int(x) if hasattr(x, "__index__") and not isinstance(x, bool) else x for x in r])
    assert sorted(map(plain, rows)) == sorted(map(plain, b.fetchall()))
