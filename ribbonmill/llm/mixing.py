"""Mixing sources to target weights by hash-threshold histograms.

Each source's budget is its target share of the total size, the tokens of all documents whose source is
listed. A source is used whole as often as its budget holds it, max_repeats times at most; the rest of
the budget is filled with the documents whose hash lies under a threshold. The threshold is found
without sorting: tokens are summed by source and hash bucket, the bucket in which the running sum passes
the rest is refined by the next bits of the hash, and so on until a bucket holds one document. Of the
two sets on either side of the last document, the one nearer to the budget is taken.

A source that isn't listed, or null, isn't used. A listed source without documents, or out of reach,
comes out with what it has. Null and empty texts have no tokens and are never needed, so they aren't in
the mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ribbonmill.llm.encoding import token_counts
from ribbonmill.session import cut

#: Bits of the hash that a level of the histogram resolves, and levels.
BITS, LEVELS = 12, 5


def plain_source(c: Column) -> Column:
    """A source without stray case and blanks."""
    return F.lower(F.regexp_replace(c, r"(?U)^[\s ]+|[\s ]+$", ""))


def sized(documents: DataFrame, targets: DataFrame, tokens: str = "tokens", key: str = "doc_id") -> DataFrame:
    """key, source, tokens, h: the documents of listed sources, from a table with their tokens; h has BITS * LEVELS bits. targets is a fixed table and is broadcast. A repeated row stays a row of its own."""
    listed = F.broadcast(targets.select(plain_source(F.col("source")).alias("source")).distinct())
    d = documents.select(key, plain_source(F.col("source")).alias("source"), F.col(tokens).cast("long").alias("tokens")).join(listed, "source", "left_semi")
    return d.select(key, "source", "tokens", F.shiftrightunsigned(F.xxhash64(F.lit("mix"), key), 64 - BITS * LEVELS).alias("h")).where("tokens > 0")


def thresholds(docs: DataFrame, rest: dict[str, float]) -> dict[str, int]:
    """source: h under which documents are taken so that their tokens come nearest to rest. One small job a level for all sources."""
    spark = docs.sparkSession
    # source -> (prefix of the hash that is settled, tokens under it)
    at = {s: (0, 0.0) for s, r in rest.items() if r > 0}
    out = {s: 0 for s in rest}
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("prefix", T.LongType()), T.StructField("under", T.DoubleType()), T.StructField("rest", T.DoubleType())])
    for level in range(1, LEVELS + 1):
        if not at:
            break
        state = F.broadcast(spark.createDataFrame([(s, p, u, float(rest[s])) for s, (p, u) in at.items()], schema))  # a row a source
        bits = BITS * (LEVELS - level)
        b = docs.join(state, "source").where(F.shiftrightunsigned("h", bits + BITS) == F.col("prefix"))
        b = b.groupBy("source", F.shiftrightunsigned("h", bits).alias("bucket"), "under", "rest").agg(F.sum("tokens").alias("tokens"))
        w = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 2**BITS rows a source
        b = b.withColumn("sum", F.col("under") + F.sum("tokens").over(w))
        hit = b.where(F.col("sum") > F.col("rest")).groupBy("source").agg(F.min_by(F.struct("bucket", "tokens", "sum"), "bucket").alias("x"))
        found = {r["source"]: r["x"] for r in hit.collect()}
        nxt = {}
        for s, (p, _) in at.items():
            if s not in found:
                out[s] = (p + 1) << (bits + BITS)  # all of it fits
                continue
            x = found[s]
            under = x["sum"] - x["tokens"]
            if level == LEVELS:
                out[s] = (x["bucket"] + (x["sum"] - rest[s] < rest[s] - under)) << bits
            else:
                nxt[s] = (x["bucket"], under)
        at = nxt
    return out


def mix(documents: DataFrame, targets: DataFrame, tokens: str | None = None, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """tokens: the column that has them, if they are counted already. Returns (key, source, tokens, repeats of each document in the mix; source, target_share, target_tokens, available_tokens, max_repeats, actual_tokens, actual_share, share_of_size)."""
    if tokens is None:  # only listed sources' texts are encoded; the counts stay beside their rows
        listed = F.broadcast(targets.select(plain_source(F.col("source")).alias("_s")).distinct())
        rows = documents.join(listed, plain_source(F.col("source")) == F.col("_s"), "left_semi")
        documents, tokens = token_counts(rows, key, keep=("source",)), "tokens"
    docs = cut(sized(documents, targets, tokens, key))
    # fixed table: a row a source
    want = {r["s"]: (r["t"] or 0.0, max(0, r["m"] or 0)) for r in targets.select(plain_source(F.col("source")).alias("s"), F.col("target_share").alias("t"), F.col("max_repeats").alias("m")).where("s is not null").collect()}
    have = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = float(sum(have.values()))
    whole, rest = {}, {}
    for s, (share, most) in want.items():
        n = have.get(s, 0)
        budget = share * total
        whole[s] = min(most, int(budget // n)) if n else 0
        rest[s] = budget - whole[s] * n if n and whole[s] < most else 0.0
    cuts = thresholds(docs, rest)
    spark = documents.sparkSession
    plan = F.broadcast(spark.createDataFrame([(s, whole[s], cuts.get(s, 0)) for s in want] or [("", 0, 0)], "source string, whole int, cut long"))
    used = docs.join(plan, "source").withColumn("repeats", F.col("whole") + (F.col("h") < F.col("cut")).cast("int")).where("repeats > 0")
    used = used.select(key, "source", "tokens", "repeats")
    actual = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual_tokens"))
    rows = [(s, float(t), t * total, int(have.get(s, 0)), m) for s, (t, m) in want.items()]
    report = spark.createDataFrame(rows, "source string, target_share double, target_tokens double, available_tokens long, max_repeats int").join(actual, "source", "left")
    a = F.coalesce("actual_tokens", F.lit(0))
    everything = F.sum(a).over(Window.partitionBy())  # over a row a source
    share = F.coalesce(a / F.nullif(everything, F.lit(0)), F.lit(0.0))
    size = (a / F.lit(total)) if total else F.lit(0.0)
    return used, report.select("source", "target_share", "target_tokens", "available_tokens", "max_repeats", a.alias("actual_tokens"), share.alias("actual_share"), size.alias("share_of_size"))
