"""Figure captions: what replaces each figure, and putting captions into marked-up documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribbonmill.operators.cleaning import figure_type, null_words, ungrounded_codes

DEFAULT_SUMMARY = "Figure from oncology document"
_COMMENT = re.compile(r"<!--\s*image.*?-->", re.I | re.S)
_OTHER = re.compile(r"!\[[^\]]*\]\((?P<path>[^)]*)\)")
_METADATA = re.compile(r"\n<!-- FIGURE_METADATA:[^\n]*-->")


def extraction_status(extraction: Column) -> Column:
    """failed without an extraction, partial without a summary, else success."""
    return F.when(extraction.isNull(), "failed").when(F.coalesce(F.trim(extraction["summary"]), F.lit("")) == "", "partial").otherwise("success")


def replacements(log: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """doc_id, figure_no, filename, action, summary, enriched, metadata (JSON) of each figure of an extraction log.

    Skipped figures are removed; extracted ones get their caption, failed ones a fallback that keeps its
    metadata. With documents (doc_id, text), code names the document doesn't hold are in the metadata.
    Repeated rows count once; null members are allowed.
    """
    x = log.select("doc_id", F.explode("figures").alias("f")).dropDuplicates(["doc_id", "f"])
    x = x.join(documents.select("doc_id", F.col("text").alias("_t")), "doc_id", "left") if documents is not None else x.withColumn("_t", F.lit(None).cast("string"))
    e = F.col("f.clinical_extraction")
    action = F.when(F.col("f.status") == "skipped", "remove").when(e.isNotNull(), "caption").otherwise("fallback")
    flags = ungrounded_codes(F.concat_ws(" ", e["summary"], e["enriched_text"]), F.col("_t"))
    meta = F.to_json(F.struct(F.coalesce(e["figure_id"], F.concat(F.lit("fig_"), F.col("f.index"))).alias("figure_id"), figure_type(e["figure_type"]).alias("figure_type"), extraction_status(e).alias("extraction_status"), F.when(F.col("_t").isNotNull(), flags).alias("grounding_flags")))
    return x.select("doc_id", F.col("f.index").alias("figure_no"), F.col("f.filename").alias("filename"), action.alias("action"), null_words(e["summary"]).alias("summary"), null_words(e["enriched_text"]).alias("enriched"), meta.alias("metadata"))


def render(item: dict, folder: str = "figures") -> str:
    """The block that stands for a figure; nothing for a removed one."""
    if item["action"] == "remove":
        return ""
    block = f"![{item['summary'] or DEFAULT_SUMMARY}]({folder}/{item['filename'] or 'figure.png'})\n<!-- FIGURE_METADATA: {item['metadata']} -->"
    return f"{block}\n{item['enriched']}" if item["enriched"] else block


def inject(text: str, items: list[dict], folder: str = "figures") -> tuple[str, int, list[dict]]:
    """(text with captions, replacements made, figures that found no place).

    In a fresh document image comments are matched by order, other images by file name; one captioned
    before is matched by file name only, so that a second run changes nothing.
    """
    again = "<!-- FIGURE_METADATA:" in text
    text = _METADATA.sub("", text)
    for i in items if again else ():
        if i["enriched"]:
            text = text.replace("\n" + i["enriched"], "", 1)
    left = sorted(items, key=lambda i: (i["figure_no"] is None, i["figure_no"]))
    made = 0

    def comment(m: re.Match) -> str:
        nonlocal made
        if again or not left:
            return m[0]
        made += 1
        return render(left.pop(0), folder)

    def image(m: re.Match) -> str:
        nonlocal made
        name = m["path"].rsplit("/", 1)[-1]
        for k, i in enumerate(left):
            if i["filename"] and i["filename"].rsplit("/", 1)[-1] == name:
                made += 1
                return render(left.pop(k), folder)
        return m[0]

    text = _OTHER.sub(image, text)
    return _COMMENT.sub(comment, text), made, [i for i in left if i["action"] != "remove"]


def caption_documents(documents: DataFrame, log: DataFrame, folder: str = "figures", heading: str = "## Recovered figures") -> DataFrame:
    """doc_id, text, replaced, orphans: captions put in; figures without a place stand under a heading at the end."""
    item = F.struct("figure_no", "filename", "action", "summary", "enriched", "metadata")
    items = replacements(log, documents).groupBy("doc_id").agg(F.collect_list(item).alias("items"))  # the figures of one document

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t, xs in zip(b["doc_id"], b["text"], b["items"]):
                figs = [x if isinstance(x, dict) else x.asDict() for x in (xs if xs is not None else [])]
                out, made, lost = inject(t or "", figs, folder)
                if lost:
                    out = f"{out}\n\n{heading}\n\n" + "\n\n".join(render(i, folder) for i in lost)
                rows.append((d, out, made, len(lost)))
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "text", "replaced", "orphans"])

    src = documents.select("doc_id", "text").join(items, "doc_id", "left")
    return src.mapInPandas(run, "doc_id string, text string, replaced int, orphans int")
