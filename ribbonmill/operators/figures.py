"""Figures in documents: which are kept, and bodies cut at exact figure blocks, so that a figure is a passage of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kept(figures: DataFrame, content: str, width: Column, height: Column, key: str = "doc_id", order: str = "i", least: tuple[int, int] = (250, 200)) -> DataFrame:
    """figures with kept_status (saved or skipped) and reason: small ones and, within a document, all but the first of equal content are skipped; unknown sizes count as large."""
    small = F.coalesce((width < least[0]) | (height < least[1]), F.lit(False))
    x = figures.withColumn("_small", small).withColumn("_md5", F.md5(F.coalesce(F.col(content), F.lit(""))))
    # only a figure that was large enough can make a later one a duplicate
    n = F.row_number().over(Window.partitionBy(key, "_small", "_md5").orderBy(order))
    reason = F.when(F.col("_small"), "too small").when(n > 1, "duplicate")
    return x.withColumn("reason", reason).withColumn("kept_status", F.when(F.col("reason").isNull(), "saved").otherwise("skipped")).drop("_small", "_md5")


def quoted(c: Column) -> Column:
    """A string as JSON writes it (quotes and backslashes escaped), null as null."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')), F.lit("null"))


def block(fig: Column) -> Column:
    """The exact text that stands for a captioned figure in its document; null for one that was skipped, or has no file or metadata. The format is fixed."""
    m = fig["extraction_metadata"]
    json = F.concat(F.lit('{"figure_id": '), quoted(m["figure_id"]), F.lit(', "figure_type": '), quoted(m["figure_type"]), F.lit(', "extraction_status": '), quoted(m["extraction_status"]), F.lit(', "grounding_flags": ['), F.array_join(F.transform(F.coalesce(m["grounding_flags"], F.array().cast("array<string>")), quoted), ", "), F.lit("]}"))
    summary = F.coalesce(F.nullif(fig["caption_text"], F.lit("")), F.concat(F.lit("Figure from oncology document: "), F.regexp_replace(fig["filename"], r"\.[^.]*$", "")))
    text = F.concat(F.lit("!["), summary, F.lit("](figures/"), fig["filename"], F.lit(")\n<!-- FIGURE_METADATA: "), json, F.lit(" -->"))
    more = F.nullif(fig["clinical_extraction"]["enriched_text"], F.lit(""))
    whole = F.concat(text, F.coalesce(F.concat(F.lit("\n"), more), F.lit("")))
    return F.when((F.coalesce(fig["status"], F.lit("")) != "skipped") & (F.coalesce(fig["filename"], F.lit("")) != "") & m.isNotNull(), whole)


def segments(body: Column, blocks: Column) -> Column:
    """(text, is_figure) pieces of a body at the first occurrence of each block, in order; blank gaps are left out."""
    body, blocks = F.coalesce(body, F.lit("")), F.coalesce(blocks, F.array().cast("array<string>"))
    spans = F.array_sort(F.filter(F.transform(blocks, lambda b: F.struct(F.instr(body, b).alias("a"), F.length(b).alias("n"))), lambda s: s["a"] > 0))
    piece = lambda t, f: F.struct(t.alias("text"), F.lit(f).alias("is_figure"))
    first = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<text:string,is_figure:boolean>>").alias("out"))
    gap = lambda at, end: F.substring(body, at, end - at)
    blank = lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")) == ""

    def step(acc: Column, s: Column) -> Column:
        between = gap(acc["at"], s["a"])
        before = F.when((s["a"] > acc["at"]) & ~blank(between), F.array(piece(between, False))).otherwise(F.array().cast("array<struct<text:string,is_figure:boolean>>"))
        return F.struct((s["a"] + s["n"]).alias("at"), F.concat(acc["out"], before, F.array(piece(F.substring(body, s["a"], s["n"]), True))).alias("out"))

    def finish(acc: Column) -> Column:
        rest = gap(acc["at"], F.length(body) + 1)
        return F.when(blank(rest), acc["out"]).otherwise(F.array_append(acc["out"], piece(rest, False)))

    return F.when(F.size(spans) == 0, F.array(piece(body, False))).otherwise(F.aggregate(spans, first, step, finish))


def block_lists(log: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, blocks: the blocks of each document's figures in order. A document's figures, some dozens, are one array."""
    b = log.select(key, F.explode("figures").alias("f")).select(key, F.col("f.index").alias("i"), block(F.col("f")).alias("b")).where("b is not null").distinct()
    return b.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("blocks"))


def split_documents(docs: DataFrame, log: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, segment_no, is_figure, segment of each document, cut at the blocks of its log's figures."""
    j = docs.select(key, text).join(block_lists(log, key), key, "left")
    return j.select(key, F.posexplode(segments(F.col(text), F.col("blocks"))).alias("segment_no", "s")).select(key, "segment_no", "s.is_figure", F.col("s.text").alias("segment"))
