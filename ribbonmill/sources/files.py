"""Reading and writing files: documents, JSON lines, indexes, replies of online services, models as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "chunk_id string, doc_id string, title string, pub_year int, pub_month int, recency_weight double, source_type string, journal string, doi string, guideline_version string, cancer_type string, cancer_subtype array<string>, population string, line_of_therapy string, drug_focus array<string>, drug_class string, section_h1 string, section_h2 string, section_h3 string, content_type string, page_hint int, chunk_text string, token_count int"
META = "doc_id string, title string, pub_year int, pub_month int, source_type string, journal string, doi string, guideline_version string, cancer_type string, cancer_subtype array<string>, population string, line_of_therapy string, drug_focus array<string>, drug_class string, notes string, _needs_review boolean, _llm_confidence double, _conflicts array<struct<field:string,offline:string,llm:string>>"
GOLD = "query_id string, query string, query_type string, answerable boolean, relevant_chunk_ids array<string>, relevant_doc_ids array<string>, notes string"
ANSWER = "query_id string, query string, query_type string, answerable boolean, answer string"


def raw_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """path, stem, content of the matching files."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return f.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("stem"), "content")


def parse_documents(raw: DataFrame, parse: Callable[[bytes], str]) -> DataFrame:
    """path, stem, text, status: a parser for each file; one that fails makes a failed row, never a failed job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, s, c in zip(b["path"], b["stem"], b["content"]):
                try:
                    rows.append((p, s, parse(c), "ok"))
                except Exception as e:
                    rows.append((p, s, None, f"failed: {type(e).__name__}"))
            if rows:
                yield pd.DataFrame(rows, columns=["path", "stem", "text", "status"])

    return raw.mapInPandas(run, "path string, stem string, text string, status string")


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's name), text of Markdown files."""
    f = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return f.select(F.regexp_extract(F.input_file_name(), r"([^/]+?)\.md$", 1).alias("doc_id"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document that is an array or an object."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_array(df: DataFrame, path: str, order: str | None = None) -> int:
    """Writes the rows as one JSON array, as other programs expect it, and returns their number; rows come to the driver a partition at a time. For result tables, not for corpora."""
    rows = (df.orderBy(order) if order else df).select(F.to_json(F.struct("*")).alias("j"))
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for r in rows.toLocalIterator():
            f.write(("," if n else "") + "\n" + r["j"])
            n += 1
        f.write("\n]\n")
    return n


def write_index(postings: DataFrame, lengths: DataFrame, stats: DataFrame, vectors: DataFrame, folder: str) -> None:
    """The index as tables; postings by term, so that a search reads its terms only."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    for name, df in (("lengths", lengths), ("term_stats", stats), ("vectors", vectors)):
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    # where each vector is: its file and place, so that a row can be found from a hit and a hit from a row
    stored = vectors.sparkSession.read.parquet(f"{folder}/vectors")
    key = stored.columns[0]
    at = stored.select(key, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("position"))
    at.write.mode("overwrite").parquet(f"{folder}/positions")


def read_index(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in ("postings", "lengths", "term_stats", "vectors", "positions")}


def bibliographic_record(reply: Column) -> Column:
    """title, journal, year, month, doi of a bibliographic service's JSON reply; the first date there is."""
    r = F.from_json(reply, "message struct<title:array<string>,`container-title`:array<string>,DOI:string,`published-print`:struct<`date-parts`:array<array<int>>>,`published-online`:struct<`date-parts`:array<array<int>>>,issued:struct<`date-parts`:array<array<int>>>>")["message"]
    date = F.coalesce(*[F.get(r[k]["date-parts"], F.lit(0)) for k in ("published-print", "published-online", "issued")])
    return F.struct(F.get(r["title"], F.lit(0)).alias("title"), F.get(r["container-title"], F.lit(0)).alias("journal"), F.get(date, F.lit(0)).alias("year"), F.get(date, F.lit(1)).alias("month"), r["DOI"].alias("doi"))


def article_record(reply: Column) -> Column:
    """title, journal, year, abstract, subjects, kinds of an article service's XML reply."""
    x = lambda p: F.xpath_string(reply, F.lit(p))
    n = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.struct(
        n(x("//ArticleTitle")).alias("title"), n(x("//Journal/Title")).alias("journal"), F.xpath_int(reply, F.lit("//PubDate/Year")).alias("year"), F.array_join(F.xpath(reply, F.lit("//AbstractText/text()")), " ").alias("abstract"),
        F.xpath(reply, F.lit("//DescriptorName/text()")).alias("subjects"), F.xpath(reply, F.lit("//PublicationType/text()")).alias("kinds"),
    )


def with_model(df: DataFrame, column: str, out: str, call: Callable[[list[str]], list[str]]) -> DataFrame:
    """df with a column that a model (a function of a batch of texts) makes of another; nulls stay null."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            there = b[column].notna()
            b[out] = None
            if there.any():
                b.loc[there, out] = call(list(b.loc[there, column]))
            yield b

    return df.mapInPandas(run, schema)
