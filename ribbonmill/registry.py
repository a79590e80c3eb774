"""All registered queries of the core: name -> callable(spark, folder), and SQL that computes the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ribbonmill.functions import hash_vector, token_count, tokens
from ribbonmill.operators import answering, chunking, cleaning, dense, figures, fusion, grounding, incremental, metadata, metrics, quality, review, sparse
from ribbonmill.operators.retrieve import Index, Params, pools, retrieve
from ribbonmill.plans import sweep
from ribbonmill.session import cut, few, spread
from ribbonmill.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def passages(spark: SparkSession, d: str, *cols: str, of: DataFrame | None = None) -> DataFrame:
    """Passages, each once: rows delivered twice are equal but for loaded_at. of: a stored table; only passages whose chunk_id it has."""
    c = table(spark, d, "chunk").select(*(cols or ("chunk_id", "doc_id", "chunk_text")))
    if of is not None:
        return c.join(few(of.select("chunk_id").distinct()), "chunk_id", "left_semi").dropDuplicates(["chunk_id"])
    return (c if cols else spread(c, "chunk_id")).dropDuplicates(["chunk_id"])  # what is spread by the id isn't moved again


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gold").dropDuplicates(["query_id"])


def answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "answers_llama3_natural").drop("loaded_at").dropDuplicates(["answer_id"])


def meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document_meta").dropDuplicates(["doc_id"])


# SQL parts

C = "c AS (SELECT * FROM chunk QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at) = 1)"
G = "g AS (SELECT * FROM gold QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY query_id) = 1)"
A = "a AS (SELECT * FROM answers_llama3_natural QUALIFY row_number() OVER (PARTITION BY answer_id ORDER BY loaded_at) = 1)"
M = "m AS (SELECT * FROM document_meta QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY doc_id) = 1)"
TOK = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda x: x <> '')"
STATS = f"""tok AS (SELECT chunk_id, unnest({TOK.format('chunk_text')}) AS term FROM c),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM tok GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len({TOK.format('chunk_text')})) AS av FROM c),
dl AS (SELECT chunk_id, len({TOK.format('chunk_text')}) AS dl FROM c),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
rawidf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, n),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rawidf) ELSE raw END AS idf FROM rawidf)"""
BM = f"""qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({TOK.format('query')}) AS term FROM g) GROUP BY ALL),
bmall AS (SELECT query_id, tf.chunk_id, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / av)))), 6) AS score
 FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl ON dl.chunk_id = tf.chunk_id, n GROUP BY ALL),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bmall QUALIFY rank <= 50)"""


def _vec(text: str) -> str:
    s = f"array_to_string(list_transform({TOK.format(text)}, lambda x: substr(md5(x), 1, 1)), '')"
    return f"list_transform(['0','1','2','3','4','5','6','7','8','9','a','b','c','d','e','f'], lambda h: CAST(length({s}) - length(replace({s}, h, '')) AS DOUBLE))"


DENSE = f"""cv0 AS (SELECT chunk_id, {_vec('chunk_text')} AS v FROM c), qv0 AS (SELECT query_id, {_vec('query')} AS v FROM g),
cv AS (SELECT chunk_id, v, sqrt(list_inner_product(v, v)) AS nv FROM cv0), qv AS (SELECT query_id, v, sqrt(list_inner_product(v, v)) AS nv FROM qv0),
dall AS (SELECT query_id, chunk_id, round(coalesce(list_inner_product(list_transform(qv.v, lambda x: CASE WHEN qv.nv > 0 THEN x / qv.nv ELSE 0 END), list_transform(cv.v, lambda x: CASE WHEN cv.nv > 0 THEN x / cv.nv ELSE 0 END)), 0), 6) AS score FROM qv, cv),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dall QUALIFY rank <= 50)"""
BASE = f"WITH {C}, {G}, {STATS}, {BM}, {DENSE}"
RRF = "SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM sparse) GROUP BY ALL"
SCALED = """dn AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS d FROM dense WINDOW w AS (PARTITION BY query_id)),
sn AS (SELECT query_id, chunk_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS s FROM sparse WINDOW w AS (PARTITION BY query_id))"""
HYBRID = "SELECT query_id, chunk_id, round({a} * coalesce(d, 0) + (1 - {a}) * coalesce(s, 0), 6) AS score FROM dn FULL JOIN sn USING (query_id, chunk_id)"


def _capped(fused: str, extra: str = "") -> str:
    return f"""fu AS ({fused}), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu),
cp AS (SELECT fr.*, c.doc_id FROM fr JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) <= 5),
top AS (SELECT query_id, chunk_id, doc_id, score, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM cp) WHERE rn <= 10){extra}"""


METRIC = """rel AS (SELECT query_id, query_type, list_distinct(relevant_chunk_ids) AS rel FROM g WHERE answerable),
ev AS (SELECT rel.query_id, rel.query_type, round(coalesce(1.0 / min(rank), 0), 6) AS mrr,
 round(count(*) FILTER (rank <= 1) / greatest(any_value(len(rel)), 1), 6) AS recall_1, round(count(*) FILTER (rank <= 3) / greatest(any_value(len(rel)), 1), 6) AS recall_3,
 round(count(*) FILTER (rank <= 5) / greatest(any_value(len(rel)), 1), 6) AS recall_5, round(count(*) FILTER (rank <= 10) / greatest(any_value(len(rel)), 1), 6) AS recall_10
 FROM rel LEFT JOIN top ON top.query_id = rel.query_id AND list_contains(rel.rel, top.chunk_id) GROUP BY rel.query_id, rel.query_type)"""
ROLL = "SELECT coalesce(query_type, 'all') AS query_type, count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg(recall_1), 6) AS recall_1, round(avg(recall_3), 6) AS recall_3, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10 FROM ev GROUP BY ROLLUP (query_type)"


def _index(spark: SparkSession, d: str) -> Index:
    return Index.of(passages(spark, d))


# search and fusion


@register(f"WITH {C}, {STATS} SELECT term, df, round(idf, 6) AS idf FROM idf")
def bm25_term_stats(spark, d):
    return sparse.term_stats(passages(spark, d)).select("term", "df", F.round("idf", 6).alias("idf"))


@register(f"WITH {C}, {STATS} SELECT term, count(*) AS chunks, CAST(sum(tf) AS BIGINT) AS occurrences, CAST(max(tf) AS BIGINT) AS max_tf FROM tf GROUP BY term")
def bm25_postings(spark, d):
    return sparse.postings(passages(spark, d)).groupBy("term").agg(F.count("*").alias("chunks"), F.sum("tf").alias("occurrences"), F.max("tf").alias("max_tf"))


@register(f"WITH {C}, {G}, {STATS}, {BM} SELECT query_id, chunk_id, score, rank FROM sparse WHERE rank <= 10")
def sparse_topk(spark, d):
    r = sparse.search(gold(spark, d), passages(spark, d), 10)
    return r.withColumn("rank", F.col("rank").cast("long"))


@register(
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, vec_id, round(list_inner_product(q.v, CAST(embedding AS DOUBLE[])), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(q.v, CAST(embedding AS DOUBLE[])), 6) DESC, vec_id) AS rank
FROM q, embeddings QUALIFY rank <= 10"""
)
def dense_topk(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    r = dense.search(q, e.withColumnRenamed("embedding", "vector"), 10, key="vec_id")
    return r.withColumn("rank", F.col("rank").cast("long"))


@register()
def dense_approximate(spark, d):
    """Approximate search of the same queries; recall is in dense_agreement."""
    e = table(spark, d, "embeddings").withColumnRenamed("embedding", "vector")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return dense.approximate(q, e, 10, key="vec_id")


@register()
def dense_agreement(spark, d):
    a, b = dense_topk(spark, d), dense_approximate(spark, d)
    return dense.agreement(a, b, key="vec_id")


@register("SELECT count(*) AS vectors, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm, round(avg(n), 6) AS mean_norm, count(*) FILTER (NOT n BETWEEN 0.99 AND 1.01) AS off_unit FROM (SELECT sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings)")
def vector_norms(spark, d):
    return dense.norms(table(spark, d, "embeddings"), "embedding")


@register(
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT a.label = b.label AS same_group, count(*) AS pairs, round(avg(list_inner_product(a.v, b.v)), 6) AS mean_cosine FROM e a, e b WHERE a.vec_id <> b.vec_id GROUP BY 1"""
)
def same_group_cosine(spark, d):
    return dense.same_group_cosine(table(spark, d, "embeddings"), "label", "embedding")


@register(f"{BASE} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({RRF})")
def rrf_fusion(spark, d):
    a, b = pools(gold(spark, d), _index(spark, d), 50)
    return fusion.reciprocal_rank([a, b]).withColumn("rank", F.col("rank").cast("long"))


@register(f"{BASE}, {SCALED} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({HYBRID.format(a='0.5')})")
def weighted_fusion(spark, d):
    a, b = pools(gold(spark, d), _index(spark, d), 50)
    return fusion.weighted(a, b).withColumn("rank", F.col("rank").cast("long"))


def _retrieval(mode: str):
    def run(spark, d):
        return retrieve(gold(spark, d), _index(spark, d), Params(mode=mode)).withColumn("rank", F.col("rank").cast("long"))

    run.__name__ = f"retrieve_{mode}"
    return run


for _mode, _sql in (("dense", "SELECT query_id, chunk_id, score FROM dense"), ("sparse", "SELECT query_id, chunk_id, score FROM sparse"), ("hybrid", HYBRID.format(a="0.5")), ("rrf", RRF)):
    register(f"{BASE}, {SCALED}, {_capped(_sql)} SELECT * FROM top")(_retrieval(_mode))


@register(
    f"""{BASE}, {SCALED}, {_capped(HYBRID.format(a='0.5'))},
q AS (SELECT query_id, list_distinct({TOK.format('query')}) AS qt FROM g),
s AS (SELECT top.*, round(len(list_intersect(qt, {TOK.format('chunk_text')})) / greatest(len(qt), 1), 6) AS rerank_score FROM top JOIN q USING (query_id) JOIN c USING (chunk_id))
SELECT query_id, chunk_id, score, rerank_score, rank AS retrieval_rank, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank FROM s"""
)
def rerank_overlap(spark, d):
    g, p = gold(spark, d), passages(spark, d)
    i = Index.of(p)
    r = cut(retrieve(g, i))
    out = fusion.rerank(r, fusion.overlap_scores(g, r, i.passages))
    return out.select("query_id", "chunk_id", "score", "rerank_score", F.col("retrieval_rank").cast("long").alias("retrieval_rank"), F.col("rank").cast("long").alias("rank"))


@register(
    f"""{BASE}, {SCALED}, {_capped(HYBRID.format(a='0.5'))},
ra AS (SELECT query_id, chunk_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS rn FROM top) WHERE rn <= 5),
net AS (SELECT query_id, chunk_id, rank FROM top WHERE rank <= 5 AND NOT EXISTS (SELECT 1 FROM ra WHERE ra.query_id = top.query_id AND ra.chunk_id = top.chunk_id))
SELECT query_id, chunk_id, from_net, row_number() OVER (PARTITION BY query_id ORDER BY from_net, rank) AS rank FROM (SELECT query_id, chunk_id, rank, false AS from_net FROM ra UNION ALL SELECT query_id, chunk_id, rank, true FROM net)"""
)
def safety_net(spark, d):
    r = cut(retrieve(gold(spark, d), _index(spark, d)))
    first = r.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where("rank <= 5")
    out = fusion.with_safety_net(first, r.where("rank <= 5"))
    return out.select("query_id", "chunk_id", "from_net", F.col("rank").cast("long").alias("rank"))


# evaluation


@register(f"{BASE}, {SCALED}, {_capped(HYBRID.format(a='0.5'))}, {METRIC} SELECT * FROM ev")
def recall_mrr(spark, d):
    return metrics.evaluate(gold(spark, d), retrieve(gold(spark, d), _index(spark, d)))


@register(f"{BASE}, {SCALED}, {_capped(HYBRID.format(a='0.5'))}, {METRIC} {ROLL}")
def metrics_rollup(spark, d):
    return metrics.summarise(recall_mrr(spark, d))


@register(f"{BASE}, {SCALED}, {_capped(HYBRID.format(a='0.5'))} SELECT count(*) AS queries, min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS mean_score FROM (SELECT query_id FROM g WHERE NOT answerable) LEFT JOIN (SELECT query_id, score FROM top WHERE rank = 1) USING (query_id)")
def negative_top1(spark, d):
    return metrics.negative_top1(gold(spark, d), retrieve(gold(spark, d), _index(spark, d)))


def _sweep_sql(values: list, fused: str, name: str) -> str:
    """One statement for all settings: a setting is a prefix of the query id."""
    parts = ", ".join(f"({v})" for v in values)
    return f"""{BASE}, {SCALED}, p AS (SELECT CAST(col0 AS DOUBLE) AS {name} FROM (VALUES {parts})), fu AS ({fused}),
fr AS (SELECT *, row_number() OVER (PARTITION BY {name}, query_id ORDER BY score DESC, chunk_id) AS rank FROM fu),
cp AS (SELECT fr.*, c.doc_id FROM fr JOIN c USING (chunk_id) QUALIFY row_number() OVER (PARTITION BY {name}, query_id, doc_id ORDER BY rank) <= 5),
top AS (SELECT {name}, query_id, chunk_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY {name}, query_id ORDER BY rank) AS rn FROM cp) WHERE rn <= 10),
rel AS (SELECT {name}, query_id, list_distinct(relevant_chunk_ids) AS rel FROM g, p WHERE answerable),
ev AS (SELECT rel.{name}, rel.query_id, round(coalesce(1.0 / min(rank), 0), 6) AS mrr, round(count(*) FILTER (rank <= 5) / greatest(any_value(len(rel)), 1), 6) AS recall_5, round(count(*) FILTER (rank <= 10) / greatest(any_value(len(rel)), 1), 6) AS recall_10
 FROM rel LEFT JOIN top ON top.{name} = rel.{name} AND top.query_id = rel.query_id AND list_contains(rel.rel, top.chunk_id) GROUP BY ALL)
SELECT {name}, count(*) AS n, round(avg(mrr), 6) AS mrr, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10 FROM ev GROUP BY {name}"""


@register(_sweep_sql(["0.0", "0.25", "0.5", "0.75", "1.0"], "SELECT alpha, query_id, chunk_id, round(alpha * coalesce(d, 0) + (1 - alpha) * coalesce(s, 0), 6) AS score FROM (SELECT * FROM dn FULL JOIN sn USING (query_id, chunk_id)), p", "alpha"))
def sweep_alpha(spark, d):
    return sweep.alpha(gold(spark, d), _index(spark, d), [0.0, 0.25, 0.5, 0.75, 1.0])


@register(_sweep_sql(["10", "30", "60", "100"], "SELECT rrf_k, query_id, chunk_id, round(sum(1.0 / (rrf_k + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM sparse), p GROUP BY ALL", "rrf_k"))
def sweep_rrf_k(spark, d):
    return sweep.rrf_k(gold(spark, d), _index(spark, d), [10, 30, 60, 100])


@register(_sweep_sql(["10", "20", "50"], "SELECT pool, query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM dense UNION ALL SELECT query_id, chunk_id, rank FROM sparse), p WHERE rank <= pool GROUP BY ALL", "pool"))
def sweep_pool(spark, d):
    return sweep.pool(gold(spark, d), _index(spark, d), [10, 20, 50])


@register(_sweep_sql(["1", "2", "5", "10"], f"SELECT cap, query_id, chunk_id, score FROM ({RRF}), p", "cap").replace("ORDER BY rank) <= 5)", "ORDER BY rank) <= cap)"))
def sweep_cap(spark, d):
    return sweep.cap(gold(spark, d), _index(spark, d), [1, 2, 5, 10])


@register(
    f"""WITH {C}, {G}, {DENSE}, t AS (SELECT query_type, max(score) FILTER (rank = 1) AS s FROM g LEFT JOIN dense USING (query_id) GROUP BY g.query_id, query_type)
SELECT query_type AS tier, count(*) AS queries, round(min(s), 4) AS min_score, round(max(s), 4) AS max_score, round(avg(s), 4) AS mean_score, round(median(s), 4) AS median_score FROM t GROUP BY 1"""
)
def tier_summary(spark, d):
    """The best vector score of each query, by type."""
    g, i = gold(spark, d), _index(spark, d)
    top = dense.search(g.select("query_id", hash_vector(F.col("query")).alias("vector")), i.vectors, 1).select("query_id", "score")
    s = g.select("query_id", F.col("query_type").alias("tier")).join(top, "query_id", "left")
    r = lambda c, n: F.round(c, 4).alias(n)
    return s.groupBy("tier").agg(F.count("*").alias("queries"), r(F.min("score"), "min_score"), r(F.max("score"), "max_score"), r(F.avg("score"), "mean_score"), r(F.percentile("score", F.lit(0.5)), "median_score"))


@register(
    f"""WITH {A} SELECT answerable, count(*) AS n, count(*) FILTER (trim(answer) = '{cleaning.REFUSAL}') AS abstained FROM a GROUP BY answerable"""
)
def abstention(spark, d):
    a = answers(spark, d).where("true")
    return a.groupBy("answerable").agg(F.count("*").alias("n"), F.count_if(cleaning.is_abstention(F.col("answer"))).alias("abstained"))


@register(
    f"""{BASE}, {SCALED}, {_capped(HYBRID.format(a='0.5'))}, h AS (SELECT g.query_id, query_type, count(top.chunk_id) > 0 AS hit FROM g LEFT JOIN top ON top.query_id = g.query_id AND list_contains(relevant_chunk_ids, top.chunk_id) WHERE answerable GROUP BY ALL)
SELECT coalesce(query_type, 'all') AS query_type, count(*) AS n, count(*) FILTER (hit) AS supported FROM h GROUP BY ROLLUP (query_type)"""
)
def support_by_type(spark, d):
    e = recall_mrr(spark, d).withColumn("hit", F.col("mrr") > 0)
    return e.rollup("query_type").agg(F.count("*").alias("n"), F.count_if("hit").alias("supported")).withColumn("query_type", F.coalesce("query_type", F.lit("all")))


@register(
    """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(median(value), 6) AS median, round(min(value) FILTER (i = least(n, CAST(floor(0.9 * n) AS BIGINT) + 1)), 6) AS p90, round(max(value), 6) AS max_value FROM e GROUP BY 1"""
)
def latency_percentiles(spark, d):
    return metrics.percentile_p90(table(spark, d, "events"), "value", "event_type")


@register(f"WITH {C}, o AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS i, count(*) OVER () AS n FROM c) SELECT chunk_id FROM o WHERE i % greatest(n // 10, 1) = 0 AND i // greatest(n // 10, 1) < 10")
def stride_sample(spark, d):
    return metrics.stride_sample(passages(spark, d), "chunk_id")


# cleaning and labelling

_TITLED = "'# ' || doc_id || chr(10) || coalesce(chunk_text, '')"


@register(f"WITH {C} SELECT chunk_id, md5(translate(chunk_text, 'þ¼' || chr(6) || chr(21) || chr(20) || chr(3) || chr(19), '+=±≥<')) AS fixed FROM c WHERE chunk_text LIKE '%þ%' OR chunk_text LIKE '%¼%'")
def clean_glyphs(spark, d):
    c = passages(spark, d).where(F.col("chunk_text").contains("þ") | F.col("chunk_text").contains("¼"))
    return c.select("chunk_id", F.md5(cleaning.fix_glyphs(F.col("chunk_text"))).alias("fixed"))


_LINES = "string_split(coalesce(chunk_text, ''), chr(10))"


@register(f"WITH {C} SELECT chunk_id, md5(array_to_string(list_filter({_LINES}, lambda x: NOT regexp_matches(x, '\\(20\\d\\d\\)$')), chr(10))) AS kept, len(list_filter({_LINES}, lambda x: regexp_matches(x, '\\(20\\d\\d\\)$'))) AS removed FROM c WHERE NOT regexp_matches(coalesce(chunk_text, ''), '[\\r\\x0b\\x0c\\x{{85}}\\x{{2028}}\\x{{2029}}]')")
def strip_boilerplate(spark, d):
    """With a pattern of this corpus: lines that end in a year in brackets."""
    p = (r"\(20\d\d\)$",)
    c = passages(spark, d).withColumn("t", F.coalesce("chunk_text", F.lit(""))).where(~F.col("t").rlike(r"[\r\u000B\u000C\u0085\u2028\u2029]"))
    return c.select("chunk_id", F.md5(cleaning.strip_boilerplate(F.col("t"), p)).alias("kept"), cleaning.boilerplate_lines(F.col("t"), p).cast("long").alias("removed"))


@register(
    f"""WITH {C} SELECT section_h2, count(*) AS n, bool_or(regexp_matches(trim(section_h2), '(?i)^(author contributions?|references?|bibliography|funding|acknowledge?ments?|conflicts? of interest|competing interests?|data availability( statement)?|supplementary material(s)?|disclosures?)\\b')) AS junk FROM c WHERE section_h2 IS NOT NULL GROUP BY 1"""
)
def junk_headings(spark, d):
    c = passages(spark, d, "chunk_id", "section_h2").where("section_h2 is not null")
    return c.groupBy("section_h2").agg(F.count("*").alias("n"), F.bool_or(cleaning.is_junk_heading(F.col("section_h2"))).alias("junk"))


@register(f"WITH {C} SELECT content_type AS recorded, CASE WHEN starts_with(trim(chunk_text), '|') AND instr(substr(trim(chunk_text), 2), '|') > 0 THEN 'table' WHEN starts_with(trim(chunk_text), '![') THEN 'figure_caption' ELSE 'prose' END AS seen, count(*) AS n, count(*) FILTER (regexp_replace(chunk_text, '[\\s\\-|]', '', 'g') = '') AS noise FROM c GROUP BY ALL")
def content_type(spark, d):
    c = passages(spark, d, "chunk_id", "content_type", "chunk_text")
    return c.groupBy(F.col("content_type").alias("recorded"), cleaning.content_type(F.col("chunk_text")).alias("seen")).agg(F.count("*").alias("n"), F.count_if(cleaning.is_table_noise(F.col("chunk_text"))).alias("noise"))


@register(f"WITH {M} SELECT doc_id, CASE WHEN pub_year IS NULL THEN 0.7 WHEN pub_year <= 2015 THEN 0.5 WHEN pub_year >= 2024 THEN 1.0 ELSE round(0.5 + 0.5 * (pub_year - 2015) / 9.0, 3) END AS weight FROM m")
def recency_weight(spark, d):
    return meta(spark, d).select("doc_id", cleaning.recency_weight(F.col("pub_year")).alias("weight"))


@register(f"WITH {C} SELECT doc_id, content_type, count(*) AS n FROM c GROUP BY ALL")
def chunk_counts(spark, d):
    return passages(spark, d, "chunk_id", "doc_id", "content_type").groupBy("doc_id", "content_type").agg(F.count("*").alias("n"))


@register(f"WITH {C}, t AS (SELECT len({TOK.format('chunk_text')}) AS k FROM c) SELECT count(*) AS n, CAST(min(k) AS BIGINT) AS min_tokens, CAST(median(k) AS BIGINT) AS median_tokens, CAST(floor(avg(k)) AS BIGINT) AS mean_tokens, CAST(max(k) AS BIGINT) AS max_tokens, count(*) FILTER (k < 80) AS short, count(*) FILTER (k > 512) AS long FROM t".replace("CAST(median(k) AS BIGINT)", "CAST(floor(median(k)) AS BIGINT)"))
def token_stats(spark, d):
    return quality.token_stats(passages(spark, d))


@register(f"WITH {C} SELECT doc_id, count(*) AS n, count(*) FILTER (pub_year IS NULL) AS no_year, count(*) FILTER (section_h2 IS NULL) AS no_section, array_to_string(list_sort(list_distinct(list(CAST(round(recency_weight * 1000) AS BIGINT)))), ',') AS weights FROM c GROUP BY doc_id")
def missing_fields(spark, d):
    return quality.missing_fields(passages(spark, d, "chunk_id", "doc_id", "pub_year", "section_h2", "recency_weight"))


@register(f"WITH {C} SELECT chunk_id, CASE WHEN coalesce(section_h2, '') <> '' THEN section_h2 WHEN coalesce(section_h1, '') <> '' THEN section_h1 ELSE '—' END AS label, substr(chunk_text, 1, 600) AS snippet FROM c WHERE contains(lower(chunk_text), 'ki-67')")
def keyword_search(spark, d):
    c = passages(spark, d, "chunk_id", "section_h1", "section_h2", "chunk_text").where(F.contains(F.lower("chunk_text"), F.lit("ki-67")))
    return c.select("chunk_id", cleaning.section_label(F.col("section_h2"), F.col("section_h1")).alias("label"), F.substring("chunk_text", 1, 600).alias("snippet"))


@register(f"WITH {C} SELECT doc_id, chunk_id, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS i FROM c QUALIFY i BETWEEN 3 AND 7")
def slice_rows(spark, d):
    c = passages(spark, d, "chunk_id", "doc_id")
    return c.select("doc_id", "chunk_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")) - 1).cast("long").alias("i")).where("i between 3 and 7")


@register(f"WITH {C} SELECT doc_id, any_value(title) IS NULL AS untitled, min(chunk_id) AS first_chunk FROM c GROUP BY doc_id")
def first_samples(spark, d):
    return passages(spark, d, "chunk_id", "doc_id", "title").groupBy("doc_id").agg(F.any_value("title", True).isNull().alias("untitled"), F.min("chunk_id").alias("first_chunk"))


# chunking: each paper as a marked-up document made of its passages

_H = "h AS (SELECT doc_id, chunk_id, coalesce(section_h2, 'Body') AS heading, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) - 1 AS i FROM c)"


def _papers(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, text: a header of level i mod 3 + 1 and the flattened passage, for each passage in order."""
    c = passages(spark, d, "chunk_id", "doc_id", "section_h2", "chunk_text")
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    line = F.concat(F.repeat(F.lit("#"), ((F.row_number().over(w) - 1) % 3 + 1).cast("int")), F.lit(" "), F.coalesce("section_h2", F.lit("Body")), F.lit("\n"), F.regexp_replace(F.coalesce("chunk_text", F.lit("")), r"\s+", " "))
    return c.select("doc_id", "chunk_id", line.alias("line")).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "line"))), lambda x: x["line"]), "\n").alias("text"))


@register(f"WITH {C}, {_H} SELECT doc_id, i AS section_no, i % 3 + 1 AS level, trim(heading) AS heading FROM h")
def header_sections(spark, d):
    return chunking.sections(_papers(spark, d)).select("doc_id", F.col("section_no").cast("long").alias("section_no"), F.col("level").cast("long").alias("level"), "heading")


@register(f"WITH {C}, {_H} SELECT doc_id, i AS section_no, trim(first_value(heading) OVER (PARTITION BY doc_id, i // 3 ORDER BY i)) AS section_h1, CASE WHEN i % 3 >= 1 THEN trim(nth_value(heading, 2) OVER (PARTITION BY doc_id, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) END AS section_h2, CASE WHEN i % 3 = 2 THEN trim(heading) END AS section_h3 FROM h")
def breadcrumbs(spark, d):
    return chunking.breadcrumbs(chunking.sections(_papers(spark, d))).select("doc_id", F.col("section_no").cast("long").alias("section_no"), "section_h1", "section_h2", "section_h3")


@register(
    f"""WITH RECURSIVE {C}, {_H}, l AS (SELECT doc_id, i, CAST(i % 3 + 1 AS INTEGER) AS level, trim(heading) ILIKE 'Limitations' OR trim(heading) ILIKE 'References%' AS junk FROM h),
f AS (SELECT doc_id, i, CASE WHEN regexp_matches((SELECT trim(heading) FROM h WHERE h.doc_id = l.doc_id AND h.i = 0), '(?i)^references?\\b') THEN level ELSE 0 END AS j FROM l WHERE i = 0
UNION ALL SELECT l.doc_id, l.i, CASE WHEN regexp_matches((SELECT trim(heading) FROM h WHERE h.doc_id = l.doc_id AND h.i = l.i), '(?i)^(author contributions?|references?|bibliography|funding|disclosures?)\\b') THEN CASE WHEN f.j = 0 THEN l.level ELSE least(f.j, l.level) END WHEN f.j > 0 AND l.level <= f.j THEN 0 ELSE f.j END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)
SELECT doc_id, i AS section_no, j > 0 AS suppressed FROM f"""
)
def suppressed_sections(spark, d):
    return chunking.suppressed(chunking.sections(_papers(spark, d))).select("doc_id", F.col("section_no").cast("long").alias("section_no"), "suppressed")


@register(
    f"""WITH RECURSIVE {C}, l0 AS (SELECT chunk_id, unnest(string_split(chunk_text, chr(10))) AS line, generate_subscripts(string_split(chunk_text, chr(10)), 1) AS p FROM c),
l AS (SELECT chunk_id, line, len({TOK.format('line')}) AS k, row_number() OVER (PARTITION BY chunk_id ORDER BY p) AS i FROM l0 WHERE trim(line) <> ''),
f AS (SELECT chunk_id, i, 0 AS g, k AS n FROM l WHERE i = 1 UNION ALL SELECT l.chunk_id, l.i, CASE WHEN f.n + l.k <= 40 THEN f.g ELSE f.g + 1 END, CASE WHEN f.n + l.k <= 40 THEN f.n + l.k ELSE l.k END FROM f JOIN l ON l.chunk_id = f.chunk_id AND l.i = f.i + 1)
SELECT chunk_id, CAST(g AS BIGINT) AS group_no, md5(string_agg(line, chr(10) ORDER BY i)) AS text FROM f JOIN l USING (chunk_id, i) GROUP BY chunk_id, g"""
)
def line_pack(spark, d):
    """Passages packed from their lines into groups of at most 40 tokens."""
    c = passages(spark, d)
    x = c.select("chunk_id", F.posexplode(chunking.pack(F.filter(F.split("chunk_text", r"\n"), lambda x: F.trim(x) != ""), 40, "\n")).alias("group_no", "text"))
    return x.select("chunk_id", F.col("group_no").cast("long").alias("group_no"), F.md5("text").alias("text"))


_FOLD = """l AS (SELECT doc_id, i, CAST(i % 3 + 1 AS INTEGER) AS level, regexp_matches(trim(heading), '(?i)^(author contributions?|references?|bibliography|funding|acknowledge?ments?|conflicts? of interest|competing interests?|data availability( statement)?|supplementary material(s)?|disclosures?)\\b') AS junk FROM h),
f AS (SELECT doc_id, i, CASE WHEN junk THEN level ELSE 0 END AS j FROM l WHERE i = 0
UNION ALL SELECT l.doc_id, l.i, CASE WHEN l.junk THEN CASE WHEN f.j = 0 THEN l.level ELSE least(f.j, l.level) END WHEN f.j > 0 AND l.level <= f.j THEN 0 ELSE f.j END FROM f JOIN l ON l.doc_id = f.doc_id AND l.i = f.i + 1)"""


@register(
    f"""WITH RECURSIVE {C}, {M}, {_H}, {_FOLD},
b AS (SELECT h.doc_id, i, trim(first_value(heading) OVER w) AS section_h1, CASE WHEN i % 3 >= 1 THEN trim(nth_value(heading, 2) OVER w) END AS section_h2, CASE WHEN i % 3 = 2 THEN trim(heading) END AS section_h3, trim(regexp_replace(coalesce(chunk_text, ''), '\\s+', ' ', 'g')) AS body
 FROM h JOIN c USING (chunk_id) WINDOW w AS (PARTITION BY h.doc_id, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
k AS (SELECT b.*, len({TOK.format('body')}) AS n FROM b JOIN f USING (doc_id, i) WHERE j = 0 AND body <> ''),
s0 AS (SELECT doc_id, i, unnest(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(57345), 'g'), chr(57345))) AS t, generate_subscripts(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(57345), 'g'), chr(57345)), 1) AS p FROM k WHERE n > 512),
s AS (SELECT doc_id, i, trim(t) AS t, len({TOK.format('t')}) AS n, row_number() OVER (PARTITION BY doc_id, i ORDER BY p) AS p FROM s0 WHERE trim(t) <> ''),
pk AS (SELECT doc_id, i, p, 0 AS g, n FROM s WHERE p = 1 UNION ALL SELECT s.doc_id, s.i, s.p, CASE WHEN pk.n + s.n <= 512 THEN pk.g ELSE pk.g + 1 END, CASE WHEN pk.n + s.n <= 512 THEN pk.n + s.n ELSE s.n END FROM pk JOIN s ON s.doc_id = pk.doc_id AND s.i = pk.i AND s.p = pk.p + 1),
x AS (SELECT doc_id, i, 0 AS sub, body AS t FROM k WHERE n <= 512 UNION ALL SELECT doc_id, i, g, string_agg(s.t, ' ' ORDER BY p) FROM pk JOIN s USING (doc_id, i, p) GROUP BY doc_id, i, g),
y AS (SELECT *, CASE WHEN starts_with(trim(t), '|') AND instr(substr(trim(t), 2), '|') > 0 THEN 'table' WHEN starts_with(trim(t), '![') THEN 'figure_caption' ELSE 'prose' END AS content_type, CAST(len({TOK.format('t')}) AS BIGINT) AS token_count FROM x WHERE regexp_replace(t, '[\\s\\-|]', '', 'g') <> ''),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, sub) - 1 AS no FROM y WHERE token_count >= 80 OR content_type = 'figure_caption')
SELECT z.doc_id || '_chunk_' || lpad(CAST(no AS VARCHAR), CAST(greatest(4, length(CAST(no AS VARCHAR))) AS INTEGER), '0') AS chunk_id, z.doc_id, section_h1, section_h2, section_h3, content_type, md5(t) AS chunk_text, token_count, m.title, m.pub_year, m.source_type FROM z JOIN b USING (doc_id, i) LEFT JOIN m ON m.doc_id = z.doc_id""".replace("\\\\", "\\")
)
def chunk_documents(spark, d):
    """The papers cut into passages again, with their metadata."""
    c = chunking.chunk_documents(_papers(spark, d), meta(spark, d).select("doc_id", "title", "pub_year", "source_type"), most=512, least=80)
    return c.drop("page_hint").withColumn("chunk_text", F.md5("chunk_text")).withColumn("token_count", F.col("token_count").cast("long"))


@register(f"WITH {C}, {M} SELECT c.chunk_id, m.doc_id IS NULL AS unknown, m.pub_year, m.source_type FROM c LEFT JOIN m USING (doc_id)")
def chunk_metadata_left(spark, d):
    m = meta(spark, d).select("doc_id", "pub_year", "source_type", F.lit(True).alias("known"))
    return passages(spark, d, "chunk_id", "doc_id").join(m, "doc_id", "left").select("chunk_id", F.col("known").isNull().alias("unknown"), "pub_year", "source_type")


# metadata


@register(f"WITH {M} SELECT doc_id, left(lower(regexp_replace(regexp_replace(coalesce(title, 'untitled'), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 50) || '_' || left(md5(doc_id), 8) AS slug FROM m")
def slug_ids(spark, d):
    return meta(spark, d).select("doc_id", metadata.slug_id(F.coalesce("title", F.lit("untitled")), F.col("doc_id")).alias("slug"))


@register(f"WITH {M} SELECT doc_id, regexp_replace(nullif(regexp_extract(doi, '10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+', 0), ''), '[.,;)]+$', '') AS doi, nullif(regexp_extract(substr('Version ' || coalesce(guideline_version, ''), 1, 3000), '(?i)version\\s+(\\d+\\.\\d{{4}})', 0), '') AS version FROM m")
def doi_extract(spark, d):
    return meta(spark, d).select("doc_id", metadata.find_doi(F.col("doi")).alias("doi"), metadata.find_version(F.concat(F.lit("Version "), F.coalesce("guideline_version", F.lit("")))).alias("version"))


@register(f"WITH {M} SELECT doc_id, array_to_string(list_filter(list_transform(coalesce(cancer_subtype, []), lambda x: trim(x)), lambda x: x IS NOT NULL AND lower(x) NOT IN ('null', 'none', '')), '|') AS subtypes FROM m")
def list_fields(spark, d):
    return meta(spark, d).select("doc_id", F.array_join(metadata.list_field(F.col("cancer_subtype")), "|").alias("subtypes"))


@register(
    f"""WITH {M}, t AS (SELECT doc_id, lower(coalesce(source_type, '') || ' ' || coalesce(title, '') || ' ' || coalesce(notes, '')) AS t FROM m)
SELECT doc_id, CASE WHEN contains(t, 'randomized controlled trial') OR contains(t, 'clinical trial, phase iii') OR contains(t, 'clinical trial, phase ii') THEN 'rct' WHEN contains(t, 'meta-analysis') THEN 'meta_analysis' WHEN contains(t, 'systematic review') THEN 'review' WHEN contains(t, 'practice guideline') THEN 'guideline' WHEN contains(t, 'review') THEN 'review' END AS kind,
CASE WHEN contains(t, 'breast neoplasm') THEN 'Breast' WHEN contains(t, 'lung neoplasm') THEN 'Lung' WHEN contains(t, 'colorectal') THEN 'Colorectal' WHEN contains(t, 'prostate') THEN 'Prostate' WHEN contains(t, 'ovarian') THEN 'Ovarian' END AS cancer FROM t"""
)
def source_type(spark, d):
    t = F.concat_ws(" ", F.coalesce("source_type", F.lit("")), F.coalesce("title", F.lit("")), F.coalesce("notes", F.lit("")))
    return meta(spark, d).select("doc_id", metadata.source_type(t).alias("kind"), metadata.cancer_type(t).alias("cancer"))


_FIELDS = ("title", "source_type", "journal", "doi")
_CONF = " + ".join(f"CAST(coalesce(trim(m.{f}), '') <> '' AND coalesce(trim(l.{f}), '') <> '' AND lower(trim(m.{f})) <> lower(trim(l.{f})) AS INTEGER)" for f in _FIELDS)
_LLM = "l AS (SELECT doc_id, max(title) AS title, min(source_type) AS source_type, max(journal) AS journal, max(doi) AS doi FROM c GROUP BY doc_id)"


@register(
    f"""WITH {C}, {M}, {_LLM} SELECT doc_id, {', '.join(f"CASE WHEN coalesce(trim(m.{f}), '') <> '' THEN m.{f} ELSE l.{f} END AS {f}" for f in _FIELDS)}, {_CONF} AS conflicts, ({_CONF}) > 0 OR coalesce(m._llm_confidence, 0) < 0.85 AS needs_review FROM m FULL JOIN l USING (doc_id)"""
)
def defensive_merge(spark, d):
    """document_meta against what the passages say of their paper."""
    m = meta(spark, d)
    said = passages(spark, d, "chunk_id", "doc_id", *_FIELDS).groupBy("doc_id").agg(F.max("title").alias("title"), F.min("source_type").alias("source_type"), F.max("journal").alias("journal"), F.max("doi").alias("doi"))
    said = said.join(m.select("doc_id", F.col("_llm_confidence").alias("confidence")), "doc_id", "left")
    out = metadata.defensive_merge(m, said, list(_FIELDS))
    return out.select("doc_id", *_FIELDS, F.size("conflicts").alias("conflicts"), "needs_review")


@register(f"WITH {C}, {M}, {_LLM} SELECT doc_id, {', '.join(f'coalesce(CASE WHEN trim(m.{f}) <> {chr(39) * 2} THEN m.{f} END, CASE WHEN trim(l.{f}) <> {chr(39) * 2} THEN l.{f} END) AS {f}' for f in _FIELDS)} FROM m FULL JOIN l USING (doc_id)")
def precedence_fill(spark, d):
    said = passages(spark, d, "chunk_id", "doc_id", *_FIELDS).groupBy("doc_id").agg(F.max("title").alias("title"), F.min("source_type").alias("source_type"), F.max("journal").alias("journal"), F.max("doi").alias("doi"))
    return metadata.precedence_fill([meta(spark, d), said], list(_FIELDS))


@register(f"WITH {M} SELECT _needs_review AS needs_review, count(*) AS n, count(*) FILTER (len(coalesce(_conflicts, [])) > 0) AS conflicted FROM m GROUP BY 1")
def review_counts(spark, d):
    return meta(spark, d).groupBy(F.col("_needs_review").alias("needs_review")).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.size("_conflicts"), F.lit(0)) > 0).alias("conflicted"))


@register(f"WITH {C}, {M} SELECT DISTINCT doc_id FROM c WHERE doc_id NOT IN (SELECT doc_id FROM m WHERE NOT _needs_review)")
def unlocked_documents(spark, d):
    return metadata.unlocked(passages(spark, d, "chunk_id", "doc_id").select("doc_id").distinct(), meta(spark, d))


# figures


_FIG = "f AS (SELECT DISTINCT doc_id, x.\"index\" AS i, x.filename AS filename, x.status AS status, x.clinical_extraction.figure_type AS ft, x.clinical_extraction.clinical_relevance AS cr, x.clinical_extraction.summary AS summary FROM (SELECT doc_id, unnest(figures) AS x FROM extraction_log))"


def _figures(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "extraction_log").select("doc_id", F.explode("figures").alias("x"))
    return x.select("doc_id", F.col("x.index").alias("i"), "x.filename", "x.status", F.col("x.clinical_extraction.figure_type").alias("ft"), F.col("x.clinical_extraction.clinical_relevance").alias("cr"), F.col("x.clinical_extraction.summary").alias("summary")).distinct()


@register(f"WITH {_FIG} SELECT doc_id, i, CASE WHEN coalesce(trim(ft), '') = '' OR length(trim(ft)) > 40 OR contains(lower(ft), 'e.g.') THEN 'Other' ELSE trim(ft) END AS figure_type, CASE WHEN lower(trim(cr)) NOT IN ('null', 'none', '') THEN cr END AS relevance, count(*) AS n FROM f GROUP BY ALL")
def sanitised_figures(spark, d):
    return _figures(spark, d).groupBy("doc_id", "i", cleaning.figure_type(F.col("ft")).alias("figure_type"), cleaning.null_words(F.col("cr")).alias("relevance")).agg(F.count("*").alias("n"))


@register("SELECT status, count(DISTINCT doc_id) AS documents, CAST(sum(figures_found) AS BIGINT) AS figures, CAST(sum(tables_found) AS BIGINT) AS tables FROM (SELECT DISTINCT doc_id, status, figures_found, tables_found FROM extraction_log) GROUP BY status")
def extraction_summary(spark, d):
    x = table(spark, d, "extraction_log").select("doc_id", "status", "figures_found", "tables_found").distinct()
    return x.groupBy("status").agg(F.count_distinct("doc_id").alias("documents"), F.sum("figures_found").alias("figures"), F.sum("tables_found").alias("tables"))


@register(f"WITH {_FIG} SELECT coalesce(status, 'none') AS status, count(*) AS n, count(*) FILTER (coalesce(summary, '') = '') AS without_summary FROM f GROUP BY 1")
def caption_totals(spark, d):
    return _figures(spark, d).groupBy(F.coalesce("status", F.lit("none")).alias("status")).agg(F.count("*").alias("n"), F.count_if(F.coalesce("summary", F.lit("")) == "").alias("without_summary"))


_PLACEHOLDER = "CASE " + " ".join(f"WHEN regexp_matches(chunk_text, '{p}') THEN '{n}'" for n, p in cleaning.PLACEHOLDERS) + " ELSE 'unknown' END"


@register(f"WITH {C} SELECT {_PLACEHOLDER} AS format, count(*) AS n FROM c GROUP BY 1")
def placeholder_formats(spark, d):
    return passages(spark, d).groupBy(cleaning.placeholder_format(F.col("chunk_text")).alias("format")).agg(F.count("*").alias("n"))


_TRIAL = r"\b[A-Z]{5,}(?:-[A-Z])?-\d{2}\b"


@register(f"WITH {C}, k AS (SELECT DISTINCT doc_id, content_type = 'prose' AS prose, unnest(regexp_extract_all(chunk_text, '{_TRIAL}')) AS code FROM c WHERE content_type IS NOT NULL) SELECT doc_id, code FROM k WHERE prose EXCEPT SELECT doc_id, code FROM k WHERE NOT prose")
def ungrounded_tokens(spark, d):
    """Names of trials in a paper's prose that its tables and captions don't hold; names are compared, so that no paper's text is put together."""
    c = passages(spark, d, "chunk_id", "doc_id", "content_type", "chunk_text").where("content_type is not null")
    k = c.select("doc_id", (F.col("content_type") == "prose").alias("prose"), F.explode(F.array_distinct(F.regexp_extract_all("chunk_text", F.lit(r"(?<![A-Za-z0-9_])([A-Z]{5,}(?:-[A-Z])?-\d{2})(?![A-Za-z0-9_])"), F.lit(1)))).alias("code"))
    return k.where("prose").select("doc_id", "code").distinct().join(k.where("NOT prose"), ["doc_id", "code"], "left_anti")


@register(f"WITH {A} SELECT answer_id, answer_id AS n, kind FROM a, (VALUES ('fenced'), ('bare fence'), ('in prose'), ('no braces'), ('trailing comma')) v(kind)")
def heal_json(spark, d):
    """Replies of several shapes, read back: in a fence of either kind, within prose, without braces."""
    n = F.col("answer_id").cast("string")
    shapes = {
        "fenced": F.concat(F.lit('```json\n{"n": '), n, F.lit("}\n```")),
        "bare fence": F.concat(F.lit('```\n{"n": '), n, F.lit("}\n```")),
        "in prose": F.concat(F.lit('Here it is: {"n": '), n, F.lit("} as asked.")),
        "no braces": F.concat(F.lit('"n": '), n),
        "trailing comma": F.concat(F.lit('"n": '), n, F.lit(",")),
    }
    rows = answers(spark, d).select("answer_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("raw")) for k, v in shapes.items()])).alias("x"))
    return rows.select("answer_id", F.from_json(cleaning.heal_json(F.col("x.raw")), "n bigint")["n"].alias("n"), "x.kind")


@register(f"WITH {A} SELECT answer_id, trim(answer) AS reply FROM a WHERE answer IS NOT NULL AND NOT regexp_matches(answer, '[\\s\\x{{200b}}]$|^[\\s\\x{{200b}}]|^$')")
def think_strip(spark, d):
    a = answers(spark, d).where("answer is not null").where(~F.col("answer").rlike(r"[\s​]$|^[\s​]|^$"))
    return a.select("answer_id", cleaning.strip_thinking(F.concat(F.lit("<think>let me\nsee</think>"), F.col("answer"))).alias("reply"))


@register()
def think_strip_all(spark, d):
    """think_strip over all answers, those that are null, empty or have white space around them as well; tested by brute force instead of SQL."""
    return answers(spark, d).select("answer_id", cleaning.strip_thinking(F.concat(F.lit("<think>let me\nsee</think>"), F.col("answer"))).alias("reply"))


# grounding

_MASK = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '(\\d)\\.(\\d)', '\\1' || chr(57344) || '\\2', 'g'), '(\\d)\\.(\\d)', '\\1' || chr(57344) || '\\2', 'g'), '(\\s)\\.(\\d)', '\\1' || chr(57344) || '\\2', 'g'), '(?i)\\b(vs|e\\.g|i\\.e|approx|ca|cf|al|fig|no|ref)\\.', '\\1' || chr(57344), 'g')"
_SENT = f"list_filter(list_transform(string_split(regexp_replace({_MASK.format('answer')}, '([.!?])\\s+([A-Z0-9(\\[])', '\\1' || chr(57345) || '\\2', 'g'), chr(57345)), lambda x: regexp_replace(replace(x, chr(57344), '.'), '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_CITE = "list_sort(list_distinct(list_transform(flatten(list_transform(regexp_extract_all({0}, '(?i)[\\[(]\\s*sources?\\b[^\\])]*[\\])]'), lambda m: regexp_extract_all(m, '\\d+'))), lambda x: CAST(x AS INTEGER))))"
_CLAIMS = f"cl AS (SELECT answer_id, unnest(range(len({_SENT}))) AS claim_index, unnest({_SENT}) AS claim FROM a WHERE answer IS NOT NULL)"


@register(f"WITH {A}, {_CLAIMS} SELECT answer_id, claim_index, md5(claim) AS claim, array_to_string({_CITE.format('claim')}, ',') AS cited FROM cl")
def claims(spark, d):
    c = grounding.claims(answers(spark, d))
    return c.select("answer_id", F.col("claim_index").cast("long").alias("claim_index"), F.md5("claim").alias("claim"), F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited"))


@register(f"WITH {A} SELECT answer_id, len({_SENT}) AS sentences FROM a WHERE answer IS NOT NULL")
def sentences(spark, d):
    return answers(spark, d).where("answer is not null").select("answer_id", F.size(grounding.sentences(F.col("answer"))).cast("long").alias("sentences"))


@register(f"WITH {A} SELECT answer_id, array_to_string({_CITE.format('answer')}, ',') AS cited FROM a WHERE answer IS NOT NULL")
def citations(spark, d):
    return answers(spark, d).where("answer is not null").select("answer_id", F.array_join(F.transform(grounding.citations(F.col("answer")), lambda x: x.cast("string")), ",").alias("cited"))


@register(f"WITH {A}, {_CLAIMS} SELECT count(DISTINCT answer_id) AS answers, count(*) AS claims, count(*) FILTER (len({_CITE.format('claim')}) = 0) AS uncited, round(count(*) / count(DISTINCT answer_id), 6) AS claims_per_answer FROM cl")
def claim_totals(spark, d):
    return grounding.claim_totals(grounding.claims(answers(spark, d)))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """answer_id, position, text: the gold passages of an answer's query, in the order of their ids."""
    g = gold(spark, d).select("query_id", F.explode(F.array_distinct("relevant_chunk_ids")).alias("chunk_id"))
    g = g.join(passages(spark, d), "chunk_id").withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    return answers(spark, d).select("answer_id", "query_id").join(g, "query_id").select("answer_id", "position", F.col("chunk_text").alias("text"))


_SRC = "s AS (SELECT query_id, chunk_text AS text, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS position FROM (SELECT query_id, unnest(list_distinct(relevant_chunk_ids)) AS chunk_id FROM g) JOIN c USING (chunk_id)), sn AS (SELECT query_id, count(*) AS n FROM s GROUP BY 1)"


@register(f"WITH {A}, {C}, {G}, {_CLAIMS}, {_SRC}, k AS (SELECT cl.answer_id, claim_index, {_CITE.format('claim')} AS cited, coalesce(n, 0) AS n FROM cl JOIN a USING (answer_id) LEFT JOIN sn USING (query_id)) SELECT answer_id, claim_index, len(list_filter(cited, lambda i: i < 1 OR i > n)) AS invalid, CASE WHEN len(cited) = 0 THEN n ELSE len(list_filter(cited, lambda i: i BETWEEN 1 AND n)) END AS sources FROM k")
def evidence(spark, d):
    c = grounding.claims(answers(spark, d))
    src = _sources(spark, d)
    n = src.groupBy("answer_id").agg(F.count("*").alias("n"))
    e = grounding.evidence(c, src).join(n, "answer_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return e.select("answer_id", F.col("claim_index").cast("long").alias("claim_index"), F.col("invalid_citations").cast("long").alias("invalid"), F.when(F.size("cited") == 0, F.col("n")).otherwise(F.size("cited") - F.col("invalid_citations")).cast("long").alias("sources"))


def _numbers(text: str) -> str:
    """SQL: the numbers of a text as strings, by the same masks."""
    t = f"coalesce({text}, '')"
    for p in (r"(?i)[\[(]\s*sources?\b[^\])]*[\])]", r"(?i)\bsources?\s+\d+", r"(?m)^\s*\d+[.)]\s+", r"\pL+\d+/\d+|\pL[-/]?\d[\d,]*(?:\.\d+)?\pL*|\d[\d,]*(?:\.\d+)?%?\pL+"):
        t = f"regexp_replace({t}, '{p}', '  ', 'g')"
    return f"list_transform(regexp_extract_all({t}, '\\$?\\d[\\d,]*(?:\\.\\d+)?%?'), lambda x: regexp_replace(x, ',+$', ''))"


_BARE = "regexp_replace({0}, '[$%,]', '', 'g')"
_VALUES = "list_transform({0}, lambda y: TRY_CAST(" + _BARE.format("y") + " AS DOUBLE))"
_PLACES = "length(regexp_extract(" + _BARE.format("x") + ", '\\.(\\d+)$', 1))"
_LOST = f"list_filter({{0}}, lambda x: len(list_filter({{1}}, lambda e: e = CAST({_BARE.format('x')} AS DOUBLE) OR abs(round_even(e * pow(10, {_PLACES}), 0) / pow(10, {_PLACES}) - CAST({_BARE.format('x')} AS DOUBLE)) < 1e-9)) = 0)"
_FLAGS = f"""{{claims}}, {{src}}, tx AS (SELECT query_id, list(text ORDER BY position) AS texts FROM s GROUP BY 1),
e AS (SELECT cl.answer_id, claim_index, claim, {_CITE.format('claim')} AS cited, coalesce(texts, []) AS texts FROM cl JOIN a USING (answer_id) LEFT JOIN tx USING (query_id)),
e2 AS (SELECT *, CASE WHEN len(cited) = 0 THEN texts ELSE list_transform(list_filter(cited, lambda i: i::INT BETWEEN 1 AND len(texts)), lambda i: texts[i::INT]) END AS picked FROM e),
e3 AS (SELECT answer_id, claim_index, {_numbers('claim')} AS ns, {_VALUES.format(_numbers("array_to_string(picked, chr(10))"))} AS ev, {_VALUES.format(_numbers("array_to_string(texts, chr(10))"))} AS every FROM e2),
fl AS (SELECT answer_id, claim_index, CAST(len(ns) AS BIGINT) AS n_numbers, {_LOST.format('ns', 'ev')} AS lost, {_LOST.format('ns', 'every')} AS nowhere FROM e3)"""
_FLAGS = f"WITH {A}, {C}, {G}, " + _FLAGS.format(claims=_CLAIMS, src=_SRC)
_FLAG = "CASE WHEN len(lost) = 0 THEN 'grounded' WHEN len(nowhere) = 0 THEN 'miscited' ELSE 'unsupported' END"


@register(f"{_FLAGS} SELECT answer_id, claim_index, n_numbers, array_to_string(lost, ' ') AS unmatched, {_FLAG} AS flag FROM fl")
def numeric_flags(spark, d):
    """Numbers of claims against the gold passages."""
    f = grounding.numeric_flags(grounding.claims(answers(spark, d)), _sources(spark, d))
    return f.select("answer_id", F.col("claim_index").cast("long").alias("claim_index"), F.col("n_numbers").cast("long").alias("n_numbers"), F.array_join("unmatched", " ").alias("unmatched"), "flag")


_CT = "list_distinct(list_concat(regexp_extract_all(lower(regexp_replace({0}, 'chunk_\\d+', ' ', 'g')), '[a-z][a-z0-9-]{{3,}}'), regexp_extract_all(regexp_replace({0}, 'chunk_\\d+', ' ', 'g'), '\\d+\\.\\d+|\\d+%|\\d{{3,}}')))"


@register(f"WITH {C}, {G}, x AS (SELECT query_id, {_CT.format('query')} AS q, unnest(list_distinct(relevant_chunk_ids)) AS chunk_id FROM g) SELECT query_id, chunk_id, round(CASE WHEN len(q) = 0 THEN 0 ELSE len(list_intersect(q, {_CT.format('chunk_text')})) / len(q) END, 6) AS containment FROM x JOIN c USING (chunk_id)")
def drift(spark, d):
    g = gold(spark, d).select("query_id", grounding.content_tokens(F.col("query")).alias("q"), F.explode(F.array_distinct("relevant_chunk_ids")).alias("chunk_id"))
    j = g.join(passages(spark, d), "chunk_id")
    return j.select("query_id", "chunk_id", F.round(grounding.containment(F.col("q"), grounding.content_tokens(F.col("chunk_text"))), 6).alias("containment"))


@register(f"WITH {C}, {G} SELECT query_id, x AS chunk_id, c.chunk_id IS NULL AS missing FROM (SELECT query_id, unnest(list_distinct(relevant_chunk_ids)) AS x FROM g) LEFT JOIN c ON c.chunk_id = x")
def gold_references(spark, d):
    g = gold(spark, d).select("query_id", F.explode(F.array_distinct("relevant_chunk_ids")).alias("chunk_id"))
    return g.join(passages(spark, d, "chunk_id").withColumn("there", F.lit(True)), "chunk_id", "left").select("query_id", "chunk_id", F.col("there").isNull().alias("missing"))


# incremental, set operations, prompts


@register(f"WITH {A}, {G} SELECT query_id FROM g WHERE query_id NOT IN (SELECT query_id FROM a WHERE query_id IS NOT NULL)")
def resume_anti(spark, d):
    return incremental.remaining(gold(spark, d), answers(spark, d), "query_id").select("query_id")


@register("SELECT answer_id, epoch_us(max(loaded_at)) AS loaded_us FROM answers_llama3_natural GROUP BY answer_id")
def upsert_latest(spark, d):
    return incremental.latest(table(spark, d, "answers_llama3_natural").select("answer_id", "answer", "loaded_at"), "answer_id", "loaded_at").select("answer_id", F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("loaded_us"))


@register("SELECT md5(text) AS hash, count(*) AS copies, min(doc_id) AS kept FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_content(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("kept"))


@register(f"WITH {G}, {C}, {STATS}, {BM} SELECT query_id, len(list_intersect(r, s)) AS both, len(list_distinct(list_concat(r, s))) AS either FROM (SELECT query_id, list_distinct(relevant_chunk_ids) AS r FROM g) JOIN (SELECT query_id, list(chunk_id) AS s FROM sparse WHERE rank <= 10 GROUP BY 1) USING (query_id)")
def jaccard_overlap(spark, d):
    s = sparse_topk(spark, d).groupBy("query_id").agg(F.collect_set("chunk_id").alias("s"))
    j = gold(spark, d).select("query_id", F.array_distinct("relevant_chunk_ids").alias("r")).join(s, "query_id")
    return j.select("query_id", F.size(F.array_intersect("r", "s")).cast("long").alias("both"), F.size(F.array_union("r", "s")).cast("long").alias("either"))


@register(
    f"""WITH {C}, {G}, {STATS}, {BM}, x AS (SELECT sparse.*, c.*, g.query FROM sparse JOIN c USING (chunk_id) JOIN g USING (query_id) WHERE rank <= 3)
SELECT query_id, md5('SOURCES:' || chr(10) || string_agg('[SOURCE ' || rank || ' — type: ' || coalesce(source_type, 'None') || ' — recency: ' || CAST(CAST(round(recency_weight * 1000) AS BIGINT) AS VARCHAR) || ' — ' || coalesce(title, 'None') || ' (' || coalesce(CAST(pub_year AS VARCHAR), 'None') || ') — §' || CASE WHEN coalesce(section_h2, '') <> '' THEN section_h2 WHEN coalesce(section_h1, '') <> '' THEN section_h1 ELSE '—' END || ']' || chr(10) || chunk_text || chr(10), chr(10) ORDER BY rank) || chr(10) || 'QUESTION: ' || any_value(query)) AS prompt FROM x GROUP BY query_id"""
)
def prompt_text(spark, d):
    from ribbonmill.operators import prompt

    r = cut(sparse_topk(spark, d).where("rank <= 3"))
    c = passages(spark, d, "chunk_id", "chunk_text", "source_type", "recency_weight", "title", "pub_year", "section_h1", "section_h2", of=r)
    c = c.withColumn("recency_weight", F.round(F.col("recency_weight") * 1000).cast("long"))
    return prompt.user_messages(r, c, gold(spark, d)).select("query_id", F.md5("message").alias("prompt"))


@register("SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def lookup_rollup(spark, d):
    """The plain lookup joins and a rollup on the shared tables."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@register()
def caption_documents(spark, d):
    """The captions of the extraction log put into documents made of each paper's captions and image comments."""
    from ribbonmill.operators import captions

    log = table(spark, d, "extraction_log").dropDuplicates(["doc_id"])
    p = passages(spark, d, "chunk_id", "doc_id", "content_type", "chunk_text").where("content_type = 'figure_caption'")
    docs = p.groupBy("doc_id").agg(F.concat_ws("\n\n<!-- image -->\n\n", F.array_sort(F.collect_list("chunk_text"))).alias("text"))
    return captions.caption_documents(docs, log)


@register(
    f"""WITH {C}, p AS (SELECT doc_id, chunk_text AS t FROM c WHERE content_type = 'figure_caption' AND chunk_text IS NOT NULL), d AS (SELECT doc_id, bool_or(contains(t, '<!-- FIGURE_METADATA:')) AS again, count(*) - 1 AS comments FROM p GROUP BY 1),
r AS (SELECT DISTINCT doc_id, regexp_extract(unnest(regexp_extract_all(t, '!\\[[^\\]]*\\]\\(([^)]*)\\)', 1)), '[^/]*$') AS name FROM p),
f0 AS (SELECT DISTINCT doc_id, x."index" AS i, coalesce(x.status = 'skipped', false) AS gone, regexp_extract(x.filename, '[^/]*$') AS name FROM (SELECT doc_id, unnest(figures) AS x FROM extraction_log)),
f AS (SELECT f0.*, coalesce(r.name IS NOT NULL AND f0.name <> '', false) AS named FROM f0 LEFT JOIN r ON r.doc_id = f0.doc_id AND r.name = f0.name),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, named ORDER BY i NULLS LAST) AS n FROM f), u AS (SELECT d.doc_id, o.i IS NOT NULL AS there, coalesce(named OR (NOT again AND n <= comments), false) AS used, coalesce(gone, true) AS gone FROM d LEFT JOIN o USING (doc_id))
SELECT doc_id, count(*) FILTER (used) AS replaced, count(*) FILTER (there AND NOT used AND NOT gone) AS orphans FROM u GROUP BY 1""".replace("\\\\", "\\")
)
def caption_counts(spark, d):
    """Of each paper's captions: figures put in place, by name and otherwise by order, and those without a place."""
    return caption_documents(spark, d).select("doc_id", F.col("replaced").cast("long").alias("replaced"), F.col("orphans").cast("long").alias("orphans"))


@register(
    f"""{BASE}, {SCALED}, {_capped(HYBRID.format(a='0.5'))}, e AS (SELECT query_id, CASE WHEN answerable THEN coalesce(relevant_doc_ids, []) ELSE [] END AS fr FROM g),
j AS (SELECT e.query_id, any_value(len(fr)) > 0 AS reachable, coalesce(bool_or(rank <= 3 AND list_contains(fr, doc_id)), false) AS hit, max(score) FILTER (rank = 1) AS best FROM e LEFT JOIN top USING (query_id) GROUP BY 1)
SELECT CASE WHEN reachable THEN 'reachable' ELSE 'unreachable' END AS "check", count(*) FILTER (CASE WHEN reachable THEN hit ELSE coalesce(best < 0.647, true) END) AS passed, count(*) AS total FROM j GROUP BY 1"""
)
def retrieval_quality(spark, d):
    """Whether a gold query's documents are found, and unanswerable queries score low."""
    r = retrieve(gold(spark, d), _index(spark, d))
    return quality.reachability(r, gold(spark, d).select("query_id", F.when(F.col("answerable"), F.col("relevant_doc_ids")).alias("fragments")))


# answering


_POOL = f"""{BASE}, {SCALED}, fu AS ({HYBRID.format(a='0.5')}), pool AS (SELECT fu.*, c.doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fu JOIN c USING (chunk_id) QUALIFY rank <= 50),
qt0 AS (SELECT query_id, list_distinct({TOK.format('query')}) AS qt FROM g),
sc AS (SELECT pool.*, round(len(list_intersect(qt, {TOK.format('chunk_text')})) / greatest(len(qt), 1), 6) AS rs FROM pool JOIN qt0 USING (query_id) JOIN c USING (chunk_id)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rank) AS r2 FROM sc),
rc AS (SELECT * FROM rr QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY r2) <= 5),
rt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY r2) AS rn FROM rc) WHERE rn <= 10),
oc AS (SELECT * FROM pool QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY rank) <= 5),
ot AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rn FROM oc) WHERE rn <= 10),
fin AS (SELECT query_id, chunk_id, from_net, row_number() OVER (PARTITION BY query_id ORDER BY from_net, rn) AS rank FROM (SELECT query_id, chunk_id, false AS from_net, rn FROM rt UNION ALL
 SELECT query_id, chunk_id, true, rn FROM ot WHERE rn <= 5 AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.query_id = ot.query_id AND rt.chunk_id = ot.chunk_id)))"""


@register(f"{_POOL} SELECT * FROM fin")
def answer_sources(spark, d):
    """What a model is given for each gold query: pool of 50, reranked, capped, and the safety net."""
    return answering.answer_sources(gold(spark, d), _index(spark, d)).withColumn("rank", F.col("rank").cast("long"))


@register(f"{_POOL} SELECT query_id, md5(coalesce(trim(chunk_text), '{cleaning.REFUSAL}')) AS answer, coalesce(n, 0) AS n_sources FROM g LEFT JOIN (SELECT query_id, count(*) AS n, any_value(chunk_id) FILTER (rank = 1) AS chunk_id FROM fin GROUP BY 1) USING (query_id) LEFT JOIN c USING (chunk_id)")
def extractive_answers(spark, d):
    """The answering path with the best source as the answer; a query without sources gets the refusal."""
    g, i = gold(spark, d), _index(spark, d)
    return answering.answers(g, answering.answer_sources(g, i), i.passages).withColumn("answer", F.md5("answer"))


_BY = """rel AS (SELECT query_id, query_type, list_distinct(relevant_chunk_ids) AS rel FROM g WHERE answerable),
{0} AS (SELECT rel.query_id, rel.query_type, round(coalesce(1.0 / min(rn), 0), 6) AS mrr, round(count(*) FILTER (rn <= 5) / greatest(any_value(len(rel)), 1), 6) AS r5 FROM rel LEFT JOIN {1} t ON t.query_id = rel.query_id AND list_contains(rel.rel, t.chunk_id) GROUP BY ALL)"""


@register(f"{_POOL}, {_BY.format('eb', 'ot')}, {_BY.format('er', 'rt').partition(chr(10))[2]} SELECT coalesce(eb.query_type, 'all') AS query_type, count(*) AS n, round(avg(eb.r5), 6) AS base_recall_5, round(avg(er.r5), 6) AS reranked_recall_5, round(avg(eb.mrr), 6) AS base_mrr, round(avg(er.mrr), 6) AS reranked_mrr FROM eb JOIN er USING (query_id) GROUP BY ROLLUP (eb.query_type)")
def rerank_delta(spark, d):
    """One pool in two orders: recall and reciprocal rank by query type, before and after the reranker."""
    g, i = gold(spark, d), _index(spark, d)
    pooled = cut(answering.pool_of(g, i))
    base = metrics.evaluate(g, fusion.cap_per_group(pooled, i.passages, 5, 10)).select("query_id", F.col("recall_5").alias("b5"), F.col("mrr").alias("bm"))
    new = metrics.evaluate(g, answering.reranked(g, pooled, i.passages)).select("query_id", "query_type", "recall_5", "mrr")
    r = lambda c, n: F.round(F.avg(c), 6).alias(n)
    out = new.join(base, "query_id").rollup("query_type").agg(F.count("*").alias("n"), r("b5", "base_recall_5"), r("recall_5", "reranked_recall_5"), r("bm", "base_mrr"), r("mrr", "reranked_mrr"))
    return out.withColumn("query_type", F.coalesce("query_type", F.lit("all")))


@register(f"{BASE}, {SCALED}, {_capped(HYBRID.format(a='0.5'))} SELECT query_id, md5(string_agg(rank || '|' || chunk_id || '|' || doc_id || '|' || coalesce(nullif(section_h2, ''), nullif(section_h1, ''), '—') || '|' || coalesce(title, '') || '|' || coalesce(CAST(pub_year AS VARCHAR), '') || '|' || coalesce(source_type, '') || '|' || chunk_text, chr(10) ORDER BY rank)) AS passages, count(*) AS n FROM top JOIN c USING (chunk_id, doc_id) WHERE rank <= 5 AND query_id IN (SELECT query_id FROM g WHERE answerable) GROUP BY query_id")
def harness_inputs(spark, d):
    """Answerable queries with their five best passages, eight fields each, as the input of a model's harness."""
    r = retrieve(gold(spark, d), _index(spark, d)).where("rank <= 5").drop("doc_id").join(gold(spark, d).where("answerable").select("query_id"), "query_id", "left_semi")
    r = cut(r)
    p = passages(spark, d, "chunk_id", "doc_id", "chunk_text", "section_h1", "section_h2", "title", "pub_year", "source_type", of=r)
    r = few(r).join(p, "chunk_id")
    e = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat_ws("|", F.col("rank").cast("string"), "chunk_id", "doc_id", cleaning.section_label(F.col("section_h2"), F.col("section_h1")), e("title"), e("pub_year"), e("source_type"), "chunk_text")
    return r.groupBy("query_id").agg(F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n")).alias("passages"), F.count("*").alias("n"))


_ANSWERED = f"answer IS NOT NULL AND trim(answer) <> '{cleaning.REFUSAL}'"


@register(f"{_FLAGS}, w AS (SELECT fl.* FROM fl JOIN a USING (answer_id) WHERE {_ANSWERED}) SELECT count(*) AS claims, count(*) FILTER (n_numbers > 0) AS with_numbers, count(*) FILTER ({_FLAG} = 'miscited') AS miscited, count(*) FILTER ({_FLAG} = 'unsupported') AS unsupported FROM w")
def numeric_totals(spark, d):
    """Claims of answers that aren't refusals: checked, with numbers, miscited, unsupported."""
    f = grounding.numeric_flags(grounding.claims(answering.answered(answers(spark, d))), _sources(spark, d))
    return f.agg(F.count("*").alias("claims"), F.count_if(F.col("n_numbers") > 0).alias("with_numbers"), F.count_if(F.col("flag") == "miscited").alias("miscited"), F.count_if(F.col("flag") == "unsupported").alias("unsupported"))


@register(f"WITH {A}, {C}, {G}, {_CLAIMS}, {_SRC} SELECT answer_id, query_id, coalesce(query_type, '') AS query_type, claim_index, md5(claim) AS claim_text, array_to_string({_CITE.format('claim')}, ',') AS cited_sources, coalesce(n, 0) AS sources_seen, '' AS label_verdict, '' AS label_note FROM cl JOIN a USING (answer_id) LEFT JOIN sn USING (query_id) WHERE {_ANSWERED}")
def labelling_sheet(spark, d):
    """A row per claim of each answer, with empty fields for a verdict and a note."""
    a = answering.answered(answers(spark, d))
    n = _sources(spark, d).groupBy("answer_id").agg(F.count("*").alias("sources_seen"))
    c = grounding.claims(a).join(a.select("answer_id", "query_id", "query_type"), "answer_id").join(n, "answer_id", "left")
    return c.select("answer_id", "query_id", F.coalesce("query_type", F.lit("")).alias("query_type"), F.col("claim_index").cast("long").alias("claim_index"), F.md5("claim").alias("claim_text"), F.array_join(F.transform("cited", lambda x: x.cast("string")), ",").alias("cited_sources"), F.coalesce("sources_seen", F.lit(0)).alias("sources_seen"), F.lit("").alias("label_verdict"), F.lit("").alias("label_note"))


@register(f"WITH {A}, b AS (SELECT CASE WHEN answerable THEN 'answer' ELSE 'abstain' END AS expected, coalesce(query_type, 'none') AS category, coalesce(trim(answer) = '{cleaning.REFUSAL}', false) AS no, answerable FROM a WHERE answerable IS NOT NULL) SELECT expected, coalesce(category, 'all') AS category, count(*) AS n, count(*) FILTER (no <> answerable) AS as_expected FROM b GROUP BY GROUPING SETS ((expected, category), (expected))")
def behaviour(spark, d):
    """Whether answers were given where one was expected, and refused where not, by query type."""
    return answering.behaviour(answers(spark, d))


@register(
    f"""{BASE}, {SCALED}, {_capped(HYBRID.format(a='0.5'))}, {A}, h AS (SELECT g.query_id, count(top.chunk_id) > 0 AS hit FROM g LEFT JOIN top ON top.query_id = g.query_id AND list_contains(relevant_chunk_ids, top.chunk_id) WHERE answerable GROUP BY 1)
SELECT coalesce(hit, false) AS hit, count(*) AS answers, count(*) FILTER (trim(answer) = '{cleaning.REFUSAL}') AS abstained FROM a LEFT JOIN h USING (query_id) WHERE answerable GROUP BY 1"""
)
def over_abstention(spark, d):
    """Refusals of answerable queries, apart by whether a relevant passage had been retrieved."""
    return answering.over_abstention(answers(spark, d), recall_mrr(spark, d).select("query_id", (F.col("mrr") > 0).alias("hit")))


@register(f"{_POOL}, {A} SELECT query_id, md5(coalesce(trim(chunk_text), '{cleaning.REFUSAL}')) AS answer, coalesce(n, 0) AS n_sources FROM g LEFT JOIN (SELECT query_id, count(*) AS n, any_value(chunk_id) FILTER (rank = 1) AS chunk_id FROM fin GROUP BY 1) USING (query_id) LEFT JOIN c USING (chunk_id) WHERE query_id NOT IN (SELECT query_id FROM a WHERE query_id IS NOT NULL AND answerable)")
def harness_run(spark, d):
    """The answering path over the gold queries that have no answer meant to answer yet."""
    return answering.harness(gold(spark, d), answers(spark, d).where("answerable"), _index(spark, d)).withColumn("answer", F.md5("answer"))


@register(f"WITH {M} SELECT doc_id, CASE WHEN doi IS NOT NULL THEN doc_id ELSE left(lower(regexp_replace(regexp_replace(coalesce(title, 'untitled'), '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 50) || '_' || left(md5(doc_id), 8) END AS id FROM m")
def known_ids(spark, d):
    """Ids of papers: the known one of those with a DOI, a slug for the others."""
    m = meta(spark, d).select("doc_id", "title", "doi")
    return metadata.document_ids(m, m.where("doi is not null").select("doc_id", F.col("doc_id").alias("id")), F.coalesce("title", F.lit("untitled")), F.col("doc_id"), "doc_id").select("doc_id", "id")


_LISTED = "list_filter(list_transform(coalesce({0}, []), lambda x: trim(x)), lambda x: x IS NOT NULL AND lower(x) NOT IN ('null', 'none', ''))"
_SORTED = "list_sort(list_transform({0}, lambda x: lower(trim(x))))"


@register(
    f"""WITH {C}, {M}, l AS (SELECT doc_id, max(title) AS title, min_by({_LISTED.format('cancer_subtype')}, chunk_id) AS s FROM c GROUP BY 1),
j AS (SELECT doc_id, m.title AS mt, l.title AS lt, {_LISTED.format('m.cancer_subtype')} AS ms, coalesce(l.s, []) AS ls, m._llm_confidence AS conf, m.notes IS NOT NULL AS err FROM m LEFT JOIN l USING (doc_id))
SELECT doc_id, array_to_string(CASE WHEN len(ms) > 0 THEN ms ELSE ls END, '|') AS subtypes, CAST(coalesce(trim(mt), '') <> '' AND coalesce(trim(lt), '') <> '' AND lower(trim(mt)) <> lower(trim(lt)) AS INTEGER) + CAST(len(ms) > 0 AND len(ls) > 0 AND {_SORTED.format('ms')} <> {_SORTED.format('ls')} AS INTEGER) AS conflicts,
 (coalesce(trim(mt), '') <> '' AND coalesce(trim(lt), '') <> '' AND lower(trim(mt)) <> lower(trim(lt))) OR (len(ms) > 0 AND len(ls) > 0 AND {_SORTED.format('ms')} <> {_SORTED.format('ls')}) OR coalesce(conf, 0) < 0.85 OR err AS needs_review FROM j"""
)
def merge_lists(spark, d):
    """The merge with a list field and an error flag; notes stand for the error of a reply."""
    m = meta(spark, d)
    said = passages(spark, d, "chunk_id", "doc_id", "title", "cancer_subtype").groupBy("doc_id").agg(F.max("title").alias("title"), F.min_by(F.struct(metadata.list_field(F.col("cancer_subtype")).alias("s")), "chunk_id").alias("x"))
    said = m.select("doc_id", F.col("_llm_confidence").alias("confidence"), F.col("notes").alias("error")).join(said, "doc_id", "left").withColumn("cancer_subtype", F.col("x.s"))
    out = metadata.defensive_merge(m, said, ["title"], lists=("cancer_subtype",), error="error")
    return out.select("doc_id", F.array_join("cancer_subtype", "|").alias("subtypes"), F.size("conflicts").alias("conflicts"), "needs_review")


# review of gold queries and metadata

_IGNORED = "[" + ", ".join(f"'{w}'" for w in review.NOTE_WORDS) + "]"
_DRIFT = f"""WITH {C}, {G}, w0 AS (SELECT query_id, coalesce(notes, '') || '  ' || coalesce(query, '') AS t, relevant_chunk_ids AS ids FROM g WHERE answerable),
w AS (SELECT query_id, list_filter({_CT.format('t')}, lambda x: NOT list_contains({_IGNORED}, x)) AS want, ids FROM w0),
x AS (SELECT query_id, want, unnest(ids) AS chunk_id, generate_subscripts(ids, 1) - 1 AS no FROM w WHERE len(want) > 0),
dr AS (SELECT x.*, c.chunk_id IS NULL AS missing, CASE WHEN c.chunk_id IS NULL THEN 0.0 ELSE round(len(list_intersect(want, {_CT.format("coalesce(chunk_text, '')")})) / len(want), 6) END AS share FROM x LEFT JOIN c USING (chunk_id)),
v AS (SELECT *, share >= 0.4 AS valid, regexp_replace(chunk_id, '^(.*)_chunk_.*$', '\\1') AS doc_id FROM dr)"""


@register(f"{_DRIFT} SELECT query_id, chunk_id, CAST(no AS BIGINT) AS no, share, missing, valid FROM v")
def gold_drift(spark, d):
    """Cited passages against the tokens of their gold entry: share, and whether it reaches 0.40."""
    return review.drift(gold(spark, d), passages(spark, d)).select("query_id", "chunk_id", F.col("no").cast("long").alias("no"), "share", "missing", "valid")


@register(f"{_DRIFT}, e AS (SELECT query_id, bool_and(valid) AS ok, min_by(doc_id, no) AS doc_id FROM v GROUP BY 1) SELECT doc_id, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS drifted FROM e GROUP BY 1")
def drift_counts(spark, d):
    return review.drift_counts(review.drift(gold(spark, d), passages(spark, d)))


@register(f"{_DRIFT} SELECT query_id, v.chunk_id, c.chunk_id AS proposed, round(len(list_intersect(want, {_CT.format('chunk_text')})) / len(want), 6) AS share, row_number() OVER (PARTITION BY query_id, v.chunk_id ORDER BY round(len(list_intersect(want, {_CT.format('chunk_text')})) / len(want), 6) DESC, c.chunk_id) AS rank FROM v JOIN c USING (doc_id) WHERE NOT valid QUALIFY rank <= 2")
def drift_proposals(spark, d):
    """For each drifted passage the two of its document that hold most of the entry's tokens."""
    p = passages(spark, d)
    return review.proposals(review.drift(gold(spark, d), p), p).withColumn("rank", F.col("rank").cast("long"))


@register(f"WITH {G}, f AS (SELECT min(relevant_doc_ids[1]) AS d FROM g WHERE len(relevant_doc_ids) > 0) SELECT query_id FROM g, f WHERE list_contains(relevant_doc_ids, d)")
def review_filter(spark, d):
    """The gold queries of one document."""
    g = gold(spark, d)
    first = g.where(F.size("relevant_doc_ids") > 0).select(F.min(F.get("relevant_doc_ids", F.lit(0))).alias("d"))
    return g.crossJoin(F.broadcast(first)).where(F.array_contains("relevant_doc_ids", F.col("d"))).select("query_id")


_EMPTY = ", ".join(f"CASE WHEN coalesce(trim({f}), '') = '' THEN '{f}' END" for f in ("title", "source_type", "population", "line_of_therapy"))


@register(f"WITH {M} SELECT doc_id, array_to_string(list_filter([{_EMPTY}], lambda x: x IS NOT NULL), ',') AS missing FROM m")
def missing_report(spark, d):
    return review.missing(meta(spark, d)).withColumn("missing", F.array_join("missing", ","))


@register(
    f"""WITH {C}, {M}, {_LLM}, t AS (SELECT m.*, lower(coalesce(m.title, '') || ' ' || coalesce(m.notes, '')) AS t FROM m),
o AS (SELECT doc_id, title, journal, doi, CASE WHEN coalesce(trim(source_type), '') <> '' THEN source_type WHEN contains(t, 'randomized controlled trial') OR contains(t, 'clinical trial, phase iii') OR contains(t, 'clinical trial, phase ii') THEN 'rct' WHEN contains(t, 'meta-analysis') THEN 'meta_analysis' WHEN contains(t, 'systematic review') THEN 'review' WHEN contains(t, 'practice guideline') THEN 'guideline' WHEN contains(t, 'review') THEN 'review' END AS source_type,
 CASE WHEN trim(cancer_type) <> '' THEN cancer_type ELSE 'Breast' END AS cancer_type, len(coalesce(cancer_subtype, [])) AS subtypes, coalesce(_llm_confidence, 0) AS conf FROM t)
SELECT doc_id, {', '.join(f"CASE WHEN coalesce(trim(o.{f}), '') <> '' THEN o.{f} ELSE l.{f} END AS {f}" for f in _FIELDS)}, coalesce(cancer_type, 'Breast') AS cancer_type, coalesce(subtypes, 0) AS subtypes, ({_CONF.replace('m.', 'o.')}) > 0 OR coalesce(conf, 0) < 0.85 AS needs_review FROM o FULL JOIN l USING (doc_id)"""
)
def build_meta(spark, d):
    """Metadata from blank to merged: defaults, the type its texts hint at, then what the passages say, and whether a review is needed."""
    m = review.with_defaults(meta(spark, d))
    hint = metadata.source_type(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("notes", F.lit(""))))
    off = m.withColumn("source_type", F.when(F.coalesce(F.trim("source_type"), F.lit("")) != "", F.col("source_type")).otherwise(hint))
    said = passages(spark, d, "chunk_id", "doc_id", *_FIELDS).groupBy("doc_id").agg(F.max("title").alias("title"), F.min("source_type").alias("source_type"), F.max("journal").alias("journal"), F.max("doi").alias("doi"))
    said = said.join(m.select("doc_id", F.col("_llm_confidence").alias("confidence")), "doc_id", "left")
    out = metadata.defensive_merge(off, said, list(_FIELDS)).join(m.select("doc_id", "cancer_type", F.size("cancer_subtype").alias("n")), "doc_id", "left")
    return out.select("doc_id", *_FIELDS, F.coalesce("cancer_type", F.lit("Breast")).alias("cancer_type"), F.coalesce("n", F.lit(0)).cast("long").alias("subtypes"), "needs_review")


@register(f"WITH {C}, {M}, p AS (SELECT doc_id, min_by(chunk_text, chunk_id) AS t FROM c GROUP BY 1) SELECT doc_id, md5(CASE WHEN coalesce(notes, '') <> '' THEN 'ABSTRACT:' || chr(10) || notes || chr(10) || chr(10) ELSE '' END || 'FIRST-PAGE TEXT:' || chr(10) || substr(coalesce(t, ''), 1, 1500)) AS context FROM m LEFT JOIN p USING (doc_id)")
def meta_context(spark, d):
    """What a model is shown of each paper: its notes as the abstract and the start of its first passage."""
    p = passages(spark, d).groupBy("doc_id").agg(F.min_by("chunk_text", "chunk_id").alias("t"))
    return meta(spark, d).join(p, "doc_id", "left").select("doc_id", F.md5(review.context(F.col("t"), F.col("notes"))).alias("context"))


@register(f"WITH {C}, {M}, l AS (SELECT doc_id, any_value(cancer_subtype) AS s FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY chunk_id) = 1) GROUP BY 1) SELECT doc_id, list_sort(list_transform(coalesce(m.cancer_subtype, []), lambda x: lower(trim(x)))) = list_sort(list_transform(coalesce(s, []), lambda x: lower(trim(x)))) AS same FROM m JOIN l USING (doc_id)")
def list_conflicts(spark, d):
    """Whether a paper's list of subtypes agrees with its first passage's, but for case, blanks and order."""
    f = passages(spark, d, "chunk_id", "doc_id", "cancer_subtype").groupBy("doc_id").agg(F.min_by(F.struct("cancer_subtype"), "chunk_id").alias("x")).select("doc_id", F.col("x.cancer_subtype").alias("s"))
    return meta(spark, d).join(f, "doc_id").select("doc_id", review.same_lists(F.col("cancer_subtype"), F.col("s")).alias("same"))


@register(f"WITH {M} SELECT doc_id, to_base64(encode(doi)) AS doi64, url_encode(replace(doi, ' ', '')) AS doi_url FROM m")
def encoded_keys(spark, d):
    """DOIs as they go into a request."""
    return meta(spark, d).select("doc_id", F.base64("doi").alias("doi64"), F.url_encode(F.replace("doi", F.lit(" "), F.lit(""))).alias("doi_url"))


@register()
def normalised_titles(spark, d):
    """Titles in Unicode's compatibility form; SQL has no such function, tested on a fixture."""
    return meta(spark, d).select("doc_id", review.nfkc(F.col("title")).alias("title"))


# figures

_BLOCKS = r"""f AS (SELECT DISTINCT doc_id, x."index" AS i, x AS f FROM (SELECT doc_id, unnest(figures) AS x FROM extraction_log)),
q AS (SELECT doc_id, i, f, f.extraction_metadata AS em FROM f WHERE coalesce(f.status, '') <> 'skipped' AND coalesce(f.filename, '') <> '' AND f.extraction_metadata IS NOT NULL),
b AS (SELECT DISTINCT doc_id, i, '![' || coalesce(nullif(f.caption_text, ''), 'Figure from oncology document: ' || regexp_replace(f.filename, '\.[^.]*$', '')) || '](figures/' || f.filename || ')' || chr(10) || '<!-- FIGURE_METADATA: {"figure_id": ' || QUO(em.figure_id) || ', "figure_type": ' || QUO(em.figure_type) || ', "extraction_status": ' || QUO(em.extraction_status) || ', "grounding_flags": [' || array_to_string(list_transform(coalesce(em.grounding_flags, []), lambda z: QUO(z)), ', ') || ']} -->' || coalesce(chr(10) || nullif(f.clinical_extraction.enriched_text, ''), '') AS b FROM q)"""


def _blocks_sql() -> str:
    out = _BLOCKS
    for x in ("em.figure_id", "em.figure_type", "em.extraction_status", "z"):
        out = out.replace(f"QUO({x})", f"coalesce('\"' || replace(replace({x}, '\\', '\\\\'), '\"', '\\\"') || '\"', 'null')")
    return out


@register(f"WITH {_blocks_sql()} SELECT doc_id, i, md5(b) AS block FROM b")
def figure_blocks(spark, d):
    """The exact text of each captioned figure."""
    f = table(spark, d, "extraction_log").select("doc_id", F.explode("figures").alias("f"))
    return f.select("doc_id", F.col("f.index").alias("i"), F.md5(figures.block(F.col("f"))).alias("block")).where("block is not null").distinct()


@register(
    f"""WITH {_blocks_sql()}, s AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, b) AS n, b FROM b),
u AS (SELECT doc_id, n * 2 - 1 AS k, 'Before figure ' || n || '.' AS t, false AS fig FROM s UNION ALL SELECT doc_id, n * 2, b, true FROM s UNION ALL SELECT doc_id, max(n) * 2 + 1, 'End.', false FROM s GROUP BY doc_id)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS segment_no, fig AS is_figure, md5(t) AS segment FROM u"""
)
def figure_segments(spark, d):
    """Documents made of each log's figure blocks and text around them, cut at the blocks again."""
    log = table(spark, d, "extraction_log").dropDuplicates(["doc_id"])
    b = log.select("doc_id", F.explode("figures").alias("f")).select("doc_id", F.col("f.index").alias("i"), figures.block(F.col("f")).alias("b")).where("b is not null").distinct()
    each = F.array_sort(F.collect_list(F.struct("i", "b")))
    text = F.concat(F.array_join(F.transform(each, lambda x, n: F.concat(F.lit("Before figure "), (n + 1).cast("string"), F.lit(".\n"), x["b"])), "\n"), F.lit("\nEnd."))
    docs = b.groupBy("doc_id").agg(text.alias("text"))
    return figures.split_documents(docs, log).select("doc_id", F.col("segment_no").cast("long").alias("segment_no"), "is_figure", F.md5(F.regexp_replace("segment", r"^\n+|\n+$", "")).alias("segment"))


@register(f"WITH {_blocks_sql()} SELECT doc_id, count(*) AS figures, count(*) + 1 AS others, min(md5(b)) AS first_figure FROM b GROUP BY 1")
def chunk_with_figures(spark, d):
    """Documents of figure blocks and text cut into passages, each figure a passage of its own."""
    log = table(spark, d, "extraction_log").dropDuplicates(["doc_id"])
    t = F.array_join(F.transform("blocks", lambda b, n: F.concat(F.lit("Before figure "), (n + 1).cast("string"), F.lit(".\n"), b)), "\n")
    docs = figures.block_lists(log).select("doc_id", F.concat(F.lit("# Figures\n"), t, F.lit("\nEnd.")).alias("text"))
    c = chunking.chunk_documents(docs, least=0, log=log)
    fig = F.col("content_type") == "figure_caption"
    return c.groupBy("doc_id").agg(F.count_if(fig).alias("figures"), F.count_if(~fig).alias("others"), F.min(F.when(fig, F.md5("chunk_text"))).alias("first_figure"))


@register("""WITH f AS (SELECT DISTINCT doc_id, x."index" AS i, x.size[1] AS w, x.size[2] AS h, coalesce(x.docling_context, '') AS t FROM (SELECT doc_id, unnest(figures) AS x FROM extraction_log)),
s AS (SELECT *, coalesce(w < 250 OR h < 200, false) AS small FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, small, md5(t) ORDER BY i) AS n FROM s)
SELECT doc_id, i, CASE WHEN small THEN 'too small' WHEN n > 1 THEN 'duplicate' END AS reason, CASE WHEN small OR n > 1 THEN 'skipped' ELSE 'saved' END AS kept_status FROM r""")
def figure_filter(spark, d):
    """Figures kept by size and content; the log has no bytes, so the context stands for them."""
    x = table(spark, d, "extraction_log").select("doc_id", F.explode("figures").alias("f"))
    x = x.select("doc_id", F.col("f.index").alias("i"), F.get("f.size", F.lit(0)).alias("w"), F.get("f.size", F.lit(1)).alias("h"), F.coalesce("f.docling_context", F.lit("")).alias("t")).distinct()
    return figures.kept(x, "t", F.col("w"), F.col("h")).select("doc_id", "i", "reason", "kept_status")


@register("""WITH f AS (SELECT DISTINCT doc_id, x."index" AS i, x.clinical_extraction AS e FROM (SELECT doc_id, unnest(figures) AS x FROM extraction_log)) SELECT doc_id, count(*) AS figures, count(*) FILTER (e IS NOT NULL) AS extracted, count(*) FILTER (e.figure_id IS NOT NULL AND e.figure_type IS NOT NULL AND e.summary IS NOT NULL) AS valid FROM f GROUP BY 1""")
def valid_extractions(spark, d):
    """Extractions read back from JSON by the schema, and those that hold every required field."""
    schema = "figure_id string, figure_type string, summary string, clinical_relevance string, enriched_text string"
    x = table(spark, d, "extraction_log").select("doc_id", F.explode("figures").alias("f")).select("doc_id", F.col("f.index").alias("i"), F.from_json(F.to_json("f.clinical_extraction"), schema, {"mode": "PERMISSIVE"}).alias("e")).distinct()
    ok = F.col("e.figure_id").isNotNull() & F.col("e.figure_type").isNotNull() & F.col("e.summary").isNotNull()
    return x.groupBy("doc_id").agg(F.count("*").alias("figures"), F.count_if(F.col("e").isNotNull()).alias("extracted"), F.count_if(ok).alias("valid"))


@register(f"WITH {C} SELECT doc_id, count(*) AS n FROM c WHERE content_type IS NULL OR content_type <> 'figure_caption' GROUP BY 1")
def without_figures(spark, d):
    """Passages of each paper with figures switched off."""
    return chunking.without_figures(passages(spark, d, "chunk_id", "doc_id", "content_type"), True).groupBy("doc_id").agg(F.count("*").alias("n"))


@register(f"WITH {C} SELECT coalesce(doc_id, 'all') AS doc_id, CAST(sum(len(list_filter({_LINES}, lambda x: regexp_matches(x, '\\(20\\d\\d\\)$')))) AS BIGINT) AS removed FROM c GROUP BY ROLLUP (doc_id)".replace("\\\\", "\\"))
def boilerplate_totals(spark, d):
    """Boilerplate lines by paper and in all, with the pattern of strip_boilerplate."""
    c = passages(spark, d).select("doc_id", cleaning.boilerplate_lines(F.col("chunk_text"), (r"\(20\d\d\)$",)).alias("n"))
    return c.rollup("doc_id").agg(F.sum("n").alias("removed")).withColumn("doc_id", F.coalesce("doc_id", F.lit("all")))


# checks

@register(f"{BASE}, r AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ({RRF})) SELECT query_id, rank, max(chunk_id) FILTER (src = 's') AS sparse, max(chunk_id) FILTER (src = 'd') AS dense, max(chunk_id) FILTER (src = 'r') AS fused FROM (SELECT query_id, chunk_id, rank, 's' AS src FROM sparse UNION ALL SELECT query_id, chunk_id, rank, 'd' FROM dense UNION ALL SELECT query_id, chunk_id, rank, 'r' FROM r) WHERE rank <= 5 GROUP BY ALL")
def side_by_side(spark, d):
    """The five best passages of each query by BM25, by vectors and fused, next to each other."""
    a, b = pools(gold(spark, d), _index(spark, d), 50)
    a, b = cut(a), cut(b)
    every = [(fusion.reciprocal_rank([a, b]), "fused"), (b, "sparse"), (a, "dense")]
    u = None
    for x, n in every:
        y = x.where("rank <= 5").select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.lit(n).alias("src"))
        u = y if u is None else u.union(y)
    return u.groupBy("query_id", "rank").pivot("src", ["sparse", "dense", "fused"]).agg(F.max("chunk_id"))


@register("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), t AS (SELECT query_id, vec_id FROM q, embeddings QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(q.v, CAST(embedding AS DOUBLE[])), 6) DESC, vec_id) = 1) SELECT count(*) AS asked, count(*) FILTER (query_id = vec_id) AS itself FROM t""")
def self_retrieval(spark, d):
    """Whether a vector's nearest is itself."""
    return dense_topk(spark, d).where("rank = 1").agg(F.count("*").alias("asked"), F.count_if(F.col("query_id") == F.col("vec_id")).alias("itself"))


_TITLED_VEC = _vec("coalesce(title, '') || ' ' || coalesce(chunk_text, '')")


@register(
    f"""WITH {C}, {G}, cv0 AS (SELECT chunk_id, {_TITLED_VEC} AS v FROM c), qv0 AS (SELECT query_id, {_vec('query')} AS v FROM g), cv AS (SELECT chunk_id, v, sqrt(list_inner_product(v, v)) AS nv FROM cv0), qv AS (SELECT query_id, v, sqrt(list_inner_product(v, v)) AS nv FROM qv0),
dall AS (SELECT query_id, chunk_id, round(coalesce(list_inner_product(list_transform(qv.v, lambda x: CASE WHEN qv.nv > 0 THEN x / qv.nv ELSE 0 END), list_transform(cv.v, lambda x: CASE WHEN cv.nv > 0 THEN x / cv.nv ELSE 0 END)), 0), 6) AS score FROM qv, cv)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dall QUALIFY rank <= 10"""
)
def second_vectors(spark, d):
    """A second vector set: titles before the texts on one side, plain queries on the other."""
    p = passages(spark, d, "chunk_id", "title", "chunk_text")
    v = p.select("chunk_id", hash_vector(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("chunk_text", F.lit("")))).alias("vector"))
    q = gold(spark, d).select("query_id", hash_vector(F.col("query")).alias("vector"))
    return dense.search(q, spread(v), 10).withColumn("rank", F.col("rank").cast("long"))


@register(f"WITH {C}, {G} SELECT 'passages' AS metric, CAST(count(*) AS BIGINT) AS value FROM c UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM c UNION ALL SELECT 'without year', count(*) FROM c WHERE pub_year IS NULL UNION ALL SELECT 'short', count(*) FROM c WHERE len({TOK.format('chunk_text')}) < 80 UNION ALL SELECT 'queries', count(*) FROM g UNION ALL SELECT 'missing references', count(*) FROM (SELECT DISTINCT query_id, unnest(relevant_chunk_ids) AS x FROM g) WHERE x NOT IN (SELECT chunk_id FROM c)")
def check_report(spark, d):
    """One table of all checks' counts; the passages' come from a single pass."""
    c = passages(spark, d, "chunk_id", "doc_id", "pub_year", "chunk_text").agg(F.count("*").alias("passages"), F.count_distinct("doc_id").alias("documents"), F.count_if(F.col("pub_year").isNull()).alias("without year"), F.count_if(token_count(F.col("chunk_text")) < 80).alias("short"))
    g = gold(spark, d).agg(F.count("*").alias("queries"))
    m = gold_references(spark, d).agg(F.count_if("missing").alias("missing references"))
    rows = [x.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in x.columns]), F.array(*[F.col(f"`{n}`").cast("long") for n in x.columns]))).alias("metric", "value")) for x in (c, g, m)]
    return rows[0].union(rows[1]).union(rows[2])


@register(f"WITH {A}, {G} SELECT query_id FROM g WHERE query_id NOT IN (SELECT query_id FROM a WHERE query_id IS NOT NULL AND answerable) ORDER BY query_id LIMIT 10")
def next_to_do(spark, d):
    """The first ten queries without an answer that was meant to answer, in order of their ids."""
    return incremental.remaining(gold(spark, d), answers(spark, d).where("answerable"), "query_id").select("query_id").orderBy("query_id").limit(10)
