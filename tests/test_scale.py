"""Retrieval for many queries: texts are read once, whatever the number of queries, and the best rows are exact."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ribbonmill import registry
from ribbonmill.operators import dense, sparse, topk

#: Queries, and how often they may read the passages after the index is stored.
ONE_PASS = {"retrieve_hybrid": 0, "extractive_answers": 0, "safety_net": 0, "side_by_side": 0, "sweep_alpha": 0, "sweep_rrf_k": 0, "answer_sources": 0, "harness_inputs": 1, "over_abstention": 0, "prompt_text": 1, "rerank_delta": 0, "retrieval_quality": 0, "retrieve_rrf": 0, "harness_run": 0, "jaccard_overlap": 0, "metrics_rollup": 0, "negative_top1": 0, "recall_mrr": 0, "rerank_overlap": 0}


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with more queries than one block had."""
    d = tmp_path_factory.mktemp("many")
    for t in ("chunk", "answers_llama3_natural"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    g = spark.read.parquet("/root/testdata/sf0.001/gold.parquet").dropDuplicates(["query_id"])
    n = -(-1100 // g.count())
    g.crossJoin(spark.range(n)).withColumn("query", F.concat("query", F.lit(" "), F.col("id"))).withColumn("query_id", F.concat("query_id", F.lit("_"), F.col("id"))).drop("id").write.parquet(f"{d}/gold.parquet")
    return str(d)


@pytest.mark.parametrize("name", ONE_PASS)
def test_texts_are_read_once(spark, many, name):
    df = registry.queries()[name](spark, many)
    assert df._jdf.queryExecution().executedPlan().toString().count("/chunk.parquet]") <= ONE_PASS[name]
    assert df.count()


@pytest.mark.parametrize(("rows", "k", "floor"), [(5000, 7, None), (300, 50, None), (5000, 7, 5e-324), (3, 5, None)])
def test_best_is_exact(rows, k, floor):
    """Against sorting everything, with many ties at six decimals, ids out of order and queries whose rows are all equal."""
    rng = np.random.default_rng(3)
    scores = np.round(rng.integers(-3, 60, (9, rows)) / 10, 1) + rng.uniform(-4e-7, 4e-7, (9, rows))
    scores[0], scores[1, 4:] = 0.5, -np.inf
    ids = [f"c{i}" for i in rng.permutation(rows)]
    best = topk.Best(9, k, *([] if floor is None else [floor]))
    for a in range(0, rows, 700):
        first = best.see(pa.array(ids[a : a + 700]))
        for q in (0, 4, 8):
            best.add(q, first, scores[q : q + 4, a : a + 700])
        best._forget()
    got = {}
    for b in best.batches(0):
        for r in b.to_pylist():
            got.setdefault(r["u"], []).append((-r["score"], r["id"]))
    for q in range(9):
        want = sorted((-topk.round_half_up(s), i) for s, i in zip(scores[q], ids) if s >= (floor or -1e300))[:k]
        assert sorted(got.get(q, [])) == want


def test_equal_queries_and_low_weights(spark):
    """Queries of equal words share their work; a term in half or more of the texts may weigh nothing and still finds its texts."""
    p = spark.createDataFrame([(f"c{i}", "a b" if i < 3 else "a c") for i in range(6)], "chunk_id string, chunk_text string")
    q = spark.createDataFrame([(1, "B a"), (2, "a b"), (3, "b"), (4, "z")], "query_id bigint, query string")
    rows = sparse.search(q, p, 4).orderBy("query_id", "rank").collect()
    by = {i: [(r["chunk_id"], r["score"], r["rank"]) for r in rows if r["query_id"] == i] for i in (1, 2, 3, 4)}
    assert by[1] == by[2] and [x[0] for x in by[1]] == ["c0", "c1", "c2", "c3"] and by[3] == [("c0", 0.0, 1), ("c1", 0.0, 2), ("c2", 0.0, 3)] and not by[4]
    v = spark.createDataFrame([(f"c{i}", [1.0, float(i % 2)]) for i in range(9)], "chunk_id string, vector array<double>")
    a = spark.createDataFrame([(7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, None)], "query_id bigint, vector array<double>")
    got = [(r["query_id"], r["chunk_id"], r["rank"]) for r in dense.search(a, v, 2).orderBy("query_id", "rank").collect()]
    assert got == [(7, "c0", 1), (7, "c1", 2), (8, "c0", 1), (8, "c1", 2)]


def test_one_pass_over_vectors(spark):
    """More queries than two blocks had are searched in one pass."""
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    q = e.limit(100).crossJoin(spark.range(21)).select(F.concat_ws("_", "chunk_id", "id").alias("query_id"), "vector")
    assert dense.search(q, e, 3)._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
