"""From marked-up documents to passages: sections, breadcrumbs, suppression, packing, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ribbonmill.functions import token_count
from ribbonmill.operators.cleaning import is_junk_heading, is_table_noise

HEADER = r"^(#{1,3})[ \t]+(.+?)\s*$"


def sections(docs: DataFrame, key: str = "doc_id", text: str = "text", keep_preamble: bool = False) -> DataFrame:
    """key, section_no from 0, level 1 to 3, heading, body: text up to the next header, without blank ends.

    Text before the first header is left out unless kept (as level 0 without heading); deeper headers
    stay in the body. Only rows of one document are ever in one window.
    """
    lines = docs.select(key, F.posexplode(F.split(F.col(text), r"\R")).alias("line_no", "line"))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("line").rlike(HEADER)
    lines = lines.withColumn("n", F.sum(hit.cast("int")).over(w)).withColumn("h", hit)
    g = lines.groupBy(key, "n").agg(
        F.max(F.when(F.col("h"), F.length(F.regexp_extract("line", HEADER, 1)))).alias("level"),
        F.max(F.when(F.col("h"), F.regexp_extract("line", HEADER, 2))).alias("heading"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("h"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n").alias("body"),
    )
    g = g.withColumn("body", F.regexp_replace("body", r"^\s+|\s+$", ""))
    g = g.select(key, (F.col("n") - 1).alias("section_no"), F.coalesce("level", F.lit(0)).alias("level"), "heading", "body")
    return g if keep_preamble else g.where("section_no >= 0")


def breadcrumbs(secs: DataFrame, titles: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """secs with section_h1, h2 and h3; h1 starts as the document's title; a header clears the levels below it."""
    w = Window.partitionBy(key).orderBy("section_no").rowsBetween(Window.unboundedPreceding, 0)
    at = {i: F.last(F.when(F.col("level") == i, F.struct("section_no", "heading")), ignorenulls=True).over(w) for i in (1, 2, 3)}
    x = secs.select("*", *[at[i].alias(f"_{i}") for i in (1, 2, 3)])
    no = lambda i: F.coalesce(F.col(f"_{i}.section_no"), F.lit(-1))
    title = F.lit(None).cast("string")
    if titles is not None:
        x, title = x.join(titles.select(key, F.col("title").alias("_title")), key, "left"), F.col("_title")
    return x.select(*secs.columns, F.coalesce("_1.heading", title).alias("section_h1"), F.when(no(2) > no(1), F.col("_2.heading")).alias("section_h2"), F.when((no(3) > no(2)) & (no(3) > no(1)), F.col("_3.heading")).alias("section_h3"))


def with_suppressed(secs: DataFrame, key: str = "doc_id") -> DataFrame:
    """secs with suppressed: whether the section lies under a junk heading.

    A junk heading suppresses what follows up to a heading of its level or a higher one that is no junk, so a
    section is suppressed if, for some level, the last junk heading of that level comes after the last other
    heading of that level or a higher one.
    """
    w = Window.partitionBy(key).orderBy("section_no").rowsBetween(Window.unboundedPreceding, 0)
    junk, level = is_junk_heading(F.col("heading")), F.col("level")
    last = lambda hit: F.coalesce(F.max(F.when(hit, F.col("section_no"))).over(w), F.lit(-1))
    under = [last(junk & (level == i)) > last(~junk & (level <= i)) for i in (1, 2, 3)]
    return secs.withColumn("suppressed", under[0] | under[1] | under[2])


def suppressed(secs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, section_no, suppressed."""
    return with_suppressed(secs, key).select(key, F.col("section_no").cast("int").alias("section_no"), "suppressed")


def without_figures(passages: DataFrame, exclude: bool, kind: str = "content_type") -> DataFrame:
    """passages, without figure captions if they are switched off."""
    return passages.where(F.coalesce(kind, F.lit("")) != "figure_caption") if exclude else passages


def pack(pieces: Column, most: int, joiner: str) -> Column:
    """Pieces put together in order while a group stays within ``most`` tokens; a larger piece stays whole. The joiner is white space, so counts add up."""
    empty = F.array().cast("array<string>")
    first = F.struct(empty.alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        grown = F.struct(a["done"].alias("done"), F.when(a["cur"] == "", x).otherwise(F.concat(a["cur"], F.lit(joiner), x)).alias("cur"), (a["n"] + token_count(x)).cast("int").alias("n"))
        anew = F.struct(F.array_append(a["done"], a["cur"]).alias("done"), x.alias("cur"), token_count(x).cast("int").alias("n"))
        return F.when((a["cur"] == "") | (a["n"] + token_count(x) <= most), grown).otherwise(anew)

    return F.aggregate(pieces, first, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.array_append(a["done"], a["cur"])))


def subsplit(body: Column, most: int = 512) -> Column:
    """A body within the limit whole; else packed paragraphs, what is still too large packed lines, then packed sentences."""
    filled = lambda xs: F.filter(F.transform(xs, lambda x: F.trim(x)), lambda x: x != "")

    def again(groups: Column, pattern: str, joiner: str) -> Column:
        return F.flatten(F.transform(groups, lambda g: F.when(token_count(g) <= most, F.array(g)).otherwise(pack(filled(F.split(g, pattern)), most, joiner))))

    out = again(F.array(body), r"\n\n+", "\n\n")
    out = again(out, r"\n", "\n")
    return again(out, r"(?<=[.!?])\s+", " ")


def chunk_documents(docs: DataFrame, metadata: DataFrame | None = None, key: str = "doc_id", text: str = "text", most: int = 512, least: int = 80, log: DataFrame | None = None) -> DataFrame:
    """chunk_id, key, section_h1..h3, content_type, page_hint, chunk_text, token_count, and the metadata's columns.

    With an extraction log, bodies are first cut at the exact blocks of its captioned figures: each is a passage of
    its own, whatever its size, and what stands around it is packed apart.

    Sections under junk headings, empty bodies, table noise and pieces under ``least`` tokens (figures but)
    are left out. Ids count the kept pieces of a document. Documents without metadata have nulls.
    """
    from ribbonmill.operators.cleaning import content_type

    secs = sections(docs, key, text)
    titles = metadata.select(key, "title") if metadata is not None and "title" in metadata.columns else None
    x = breadcrumbs(with_suppressed(secs, key), titles, key).where("NOT suppressed AND body != ''")
    if log is not None:
        from ribbonmill.operators.figures import block_lists, segments

        x = x.join(block_lists(log, key), key, "left").select("*", F.posexplode(segments(F.col("body"), F.col("blocks"))).alias("seg", "s"))
        x = x.select("*", F.col("s.is_figure").alias("fig")).withColumn("body", F.regexp_replace("s.text", r"^\s+|\s+$", ""))
    else:
        x = x.withColumn("seg", F.lit(0)).withColumn("fig", F.lit(False))
    pieces = F.when(F.col("fig"), F.array("body")).otherwise(subsplit(F.col("body"), most))
    x = x.select(key, "section_no", "section_h1", "section_h2", "section_h3", "seg", "fig", F.posexplode(pieces).alias("sub", "chunk_text"))
    x = x.where(~is_table_noise(F.col("chunk_text"))).withColumn("content_type", F.when(F.col("fig"), "figure_caption").otherwise(content_type(F.col("chunk_text")))).withColumn("token_count", token_count(F.col("chunk_text")))
    x = x.where((F.col("token_count") >= least) | (F.col("content_type") == "figure_caption"))
    no = F.row_number().over(Window.partitionBy(key).orderBy("section_no", "seg", "sub")) - 1
    x = x.withColumn("chunk_id", F.format_string("%s_chunk_%04d", F.col(key), no)).withColumn("page_hint", F.lit(None).cast("int"))
    cols = ["chunk_id", key, "section_h1", "section_h2", "section_h3", "content_type", "page_hint", "chunk_text", "token_count"]
    out = x.select(*cols)
    return out if metadata is None else out.join(metadata.select(key, *[c for c in metadata.columns if c not in cols]), key, "left")
