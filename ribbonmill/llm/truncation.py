"""Text cut off by field limits: trigrams inside texts against trigrams at ends.

All of it is Spark SQL. A text is a row of tokens: words (digits folded to 0), single characters of
scripts that put no spaces between words, and marks; a citation after a sentence mark is left out. A
*trigram* is the last three tokens up to a position; where the token is one Han, kana or Thai character it
is the last seven, about as much text. A trigram occurs *at an end* where a line ends, or a text that
closes with a sentence mark or a citation, and *inside* where the line goes on; the ends of other texts,
some of which are cuts, are evidence for neither. A trigram also occurs inside where its last word is the
beginning of a longer word, so that half a word is judged by the words it may be half of. Each text leaves its
own end out, and equal texts count once.

The last trigram of each text is joined with these counts. Its *end rate* is the share of occurrences at
ends, smoothed with the rates of its last two tokens, its last token and the kind of that token (all
measured on the corpus), each worth ``PRIOR`` occurrences: a trigram seen often speaks for itself, one
never seen is judged by its shorter ends. Rates are compared, never counts, so what is cut doesn't depend on
the size of the corpus.

A text is cut where its last trigram is frequent inside and (nearly) never at an end: an end rate of at
most ``MAX_END_RATE``. Where a text closes with a sentence mark or a citation, the trigram's own rate must also
be under ``CONFIDENT`` with 95 % confidence (Wilson's bound), and it must go on in lower case or a number more
often than not ("vs.", "9."). An exact check follows: placeholders and repeats of the query are no cases, and
of replies of at most ``SHORT`` tokens only those that end in half a word of the corpus are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ribbonmill.session import cut

#: Characters of scripts without spaces between words.
UNSPACED = r"฀-๿぀-ヿ㐀-䶿一-鿿"
#: Marks that a cutter may leave behind.
CUT_MARK = r"(?:[…�]|\.\.\.|\[\.\.\.\]|\[…\]|\[(?i:truncated|cut|more)\]|\((?i:truncated|cut)\))[\s​]*$"
TOKEN = rf"[{UNSPACED}]|[\p{{L}}\p{{M}}\p{{N}}]+|\n|[^\s]"
#: Marks that end a sentence, with what may close after them.
END_MARK = "[.?!。？！।．؟][\"'”’»」』)\\]“*_]*\\s*$"
CITED = r"(?:\[[^\[\]]*\]|\((?i:sources?)[^()]*\))\s*$"
#: Citations after a sentence's mark.
CITED_SENTENCE = r"([.?!。？！।][\"'”’»」』)]*)(?:[ \t]*(?:\[[^\[\]\n]*\]|\((?i:sources?)[^()\n]*\)))+"
#: A trigram that ends a line or a text at most this often is one that goes on.
MAX_END_RATE = 0.02
#: Where a text is closed by a mark, the end rate must be under this with 95 % confidence as well.
CONFIDENT = 0.05
#: Occurrences that a shorter gram's rate is worth.
PRIOR = 3.0
#: Tokens of a short reply, such as a value or a name.
SHORT = 9


def normal_ends(c: Column) -> Column:
    """The text with one kind of line break, no spaces at its end and each Thai sentence space as a line break."""
    c = F.regexp_replace(c, r"\r\n?|[\u000B\u000C\u0085  ]", "\n")
    c = F.regexp_replace(c, r"[\s ​﻿]+$", "")
    return F.regexp_replace(c, r"(?<=[฀-๿]) +(?=[฀-๿])", "\n")


def tokens(c: Column) -> Column:
    """Tokens of a text, in order."""
    c = F.regexp_replace(c, r"\p{N}+", "0")
    return F.regexp_extract_all(F.regexp_replace(c, r"\s*\n\s*", "\n"), F.lit(f"({TOKEN})"), F.lit(1))


def distinct_answers(df: DataFrame, key: str = "answer_id", text: str = "answer") -> DataFrame:
    """Rows delivered twice count once: one row per key, the earliest delivery."""
    order = "loaded_at" if "loaded_at" in df.columns else key
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*others), F.coalesce(F.col(order).cast("string"), F.lit(""))).alias("r")).select(key, "r.*")


def _grams(t: DataFrame) -> DataFrame:
    """t with c3, c2, c1 and c0: hashes of what stands before w, the token last, in its last gram, pair, token and kind of token; from the six tokens before it, a to f."""
    wide = F.col("w").rlike(f"^[{UNSPACED}]$")
    kind = F.when(wide, 1).when(F.col("w").rlike(r"^[\p{L}\p{M}\p{N}]"), 2).when(F.col("w").rlike("^[.?!。？！।．؟]"), 3).when(F.col("w").rlike("^[\"'”’»」』)\\]]"), 4).otherwise(5)
    h = lambda level, *c: F.xxhash64(F.lit(level), *c)
    return t.select(
        "*",
        F.when(wide, h(3, "a", "b", "c", "d", "e", "f")).otherwise(h(3, "e", "f")).alias("c3"),
        F.when(wide, h(2, "c", "d", "e", "f")).otherwise(h(2, "f")).alias("c2"),
        F.when(wide, h(1, "e", "f")).otherwise(h(1)).alias("c1"),
        h(0, kind).alias("c0"),
    )


_BEFORE = "abcdef"


def prepared(df: DataFrame, key: str = "answer_id", text: str = "answer", query: str | None = "query") -> DataFrame:
    """k, n (text without cut marks and end spaces) and what is seen on a text by itself; read several times, so written once."""
    q = F.col(query) if query else F.lit(None).cast("string")
    base = df.select(F.col(key).alias("k"), F.col(text).alias("a"), q.alias("q"))
    base = base.withColumn("marked", F.coalesce(F.col("a").rlike(CUT_MARK), F.lit(False)))
    base = base.withColumn("n", normal_ends(F.regexp_replace(F.coalesce("a", F.lit("")), CUT_MARK, "")))
    bare = F.regexp_replace(F.lower("n"), r"[^\p{L}\p{N}\p{M}]+", "")
    asked = F.regexp_replace(F.lower(F.coalesce("q", F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", "")
    return cut(
        base.select(
            "k", "n", "marked", F.col("a").isNull().alias("none"), (bare == "").alias("blank"),
            ((asked != "") & (F.length(bare) <= 2 * F.length(asked) + 60) & F.endswith(bare, F.right(asked, F.lit(12)))).alias("echo"),
            (F.col("n").rlike(END_MARK) | F.col("n").rlike(CITED)).alias("closed"),
            F.xxhash64("n").alias("id"), F.xxhash64(F.lit("second"), "n").alias("id2"),
        )
    )


def _padded(base: DataFrame) -> DataFrame:
    """id, id2, own, o (tokens), p (lower-cased tokens after six line breaks), m (number of tokens) of each distinct text; own: its end counts as one."""
    texts = base.where("n != ''").groupBy("n", "id", "id2", F.col("closed").alias("own")).agg(F.lit(1)).withColumn("o", tokens(F.regexp_replace("n", CITED_SENTENCE, "$1")))
    start = F.array(*[F.lit("\n")] * len(_BEFORE))
    return texts.select("id", "id2", "own", F.concat(start, F.transform("o", F.lower)).alias("p"), F.size("o").alias("m"), "o")


def trigram_counts(base: DataFrame) -> DataFrame:
    """c (hash of what stands before, by level), w (last word), n, e, o (occurrences; of these at ends; going on), p (occurrences of longer words that begin so before the same words)."""
    shifted = [F.slice("p", i + 1, F.col("m")).alias(c) for i, c in enumerate(_BEFORE + "w")]
    # each position with the six tokens before it and the one after it, from parallel arrays
    at = _padded(base).select("own", F.explode(F.arrays_zip(*shifted, F.slice("o", F.lit(2), F.col("m")).alias("nx"))).alias("s")).select("own", "s.*")
    at = at.where((F.col("w") != "\n") & (F.col("nx").isNotNull() | F.col("own")))
    line = F.coalesce(F.col("nx") == "\n", F.lit(True))
    on = F.coalesce(F.col("nx").rlike(r"^[\p{Ll}0,;:.%/)-]"), F.lit(False))
    rows = _grams(at.select(*_BEFORE, "w", line.cast("long").alias("line"), on.cast("long").alias("on")))
    # sums combine before the shuffle, so a hot gram is small there
    levels = rows.selectExpr("stack(4, c3, w, c2, w, c1, w, c0, '') as (c, w)", "line", "on")
    counts = levels.groupBy("c", "w").agg(F.count("*").alias("n"), F.sum("line").alias("e"), F.sum("on").alias("o"))
    # beginnings of a gram's last word: rows of distinct grams, not of occurrences
    begun = F.expr("if(w rlike '^[\\\\p{L}\\\\p{M}]{2,}$', sequence(1, length(w)), array(length(w)))")
    each = counts.select("c", "w", "n", "e", "o", F.explode(begun).alias("i"))
    whole = F.col("i") == F.length("w")
    one = lambda x: F.when(whole, F.col(x)).otherwise(F.lit(0)).alias(x)
    each = each.select("c", F.left("w", F.col("i")).alias("w"), one("n"), one("e"), one("o"), F.when(whole, F.lit(0)).otherwise(F.col("n")).alias("p"))
    return each.groupBy("c", "w").agg(*[F.sum(x).alias(x) for x in "neop"])


def judged(base: DataFrame, counts: DataFrame, own: bool = True, max_end_rate: float = MAX_END_RATE, prior: float = PRIOR, short: int = SHORT) -> DataFrame:
    """k, level, seen, end_rate, half, evident, few, echo, closed, marked, cut of each row of base. own: its texts are among the counted ones."""
    tail = _grams(_padded(base).select("id", "id2", (F.col("own").cast("int") * int(own)).alias("own"), *[F.element_at("p", F.col("m") + i).alias(c) for i, c in enumerate(_BEFORE)], F.element_at("p", -1).alias("w")))
    ends = tail.selectExpr("stack(4, 3, c3, w, 2, c2, w, 1, c1, w, 0, c0, '') as (level, c, w)", "id", "id2", "own")
    zero, no = F.lit(0), F.lit(False)
    seen = ends.join(counts, ["c", "w"], "left")
    seen = seen.groupBy("id", "id2").agg(F.max("own").alias("own"), *[F.coalesce(F.max(F.when(F.col("level") == i, F.col(c))), zero).alias(f"{c}{i}") for i in range(4) for c in "neop"])
    # a text's own end is no evidence
    others = lambda i: F.greatest(F.col(f"n{i}") - F.col("own"), zero)
    at_end = lambda i: F.greatest(F.col(f"e{i}") - F.col("own"), zero)
    rate: Column = at_end(0) / F.greatest(others(0), F.lit(1))
    level = F.lit(0)
    for i in (1, 2, 3):
        rate = (at_end(i) + prior * rate) / (others(i) + F.col(f"p{i}") + prior)
        level = F.when(others(i) + F.col(f"p{i}") > 0, i).otherwise(level)
    n3, share = F.nullif(others(3), zero), at_end(3) / F.nullif(others(3), zero)
    z2 = F.lit(1.645**2)
    upper = (share + z2 / (2 * n3) + F.sqrt(z2) * F.sqrt(share * (1 - share) / n3 + z2 / (4 * n3 * n3))) / (1 + z2 / n3)
    scored = seen.select(
        "id", "id2", level.alias("level"), n3.alias("seen"), rate.alias("end_rate"),
        F.coalesce((rate <= max_end_rate) & (upper <= CONFIDENT) & (F.col("o3") / n3 > 0.5), no).alias("evident"),
        # the word is no word of its own: it stands before something no oftener than one time in twenty that it begins a longer one
        ((F.col("p1") > 0) & (F.col("n1") - F.col("e1") <= 0.05 * F.col("p1"))).alias("half"),
    )
    few = ~F.col("n").contains("\n") & (F.size(tokens(F.col("n"))) <= short) & ~F.col("n").rlike(f"[{UNSPACED}ऀ-ॿ]") & ~F.col("marked")
    j = base.join(scored, ["id", "id2"], "left").withColumn("few", few)
    hit = F.when(F.col("closed"), F.col("evident")).otherwise(F.col("end_rate") <= max_end_rate) & (~F.col("few") | F.col("half"))
    is_cut = F.when(F.col("none") | F.col("blank"), None).otherwise(~F.col("echo") & hit)
    fill = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return j.select("k", fill("level", 0), fill("seen", 0), fill("end_rate", 0.0), fill("half", False), fill("evident", False), "few", "echo", "closed", "marked", is_cut.alias("cut"))


def truncation_scores(df: DataFrame, key: str = "answer_id", text: str = "answer", query: str | None = "query", max_end_rate: float = MAX_END_RATE, prior: float = PRIOR, short: int = SHORT) -> DataFrame:
    """key, end_rate, seen, level (3, 2, 1 or 0: of the longest gram seen), half (ends in half a word), cut: one row per key with a text.

    ``cut`` is null for null and blank texts. Equal texts count once in the statistics. Other columns of
    df, clashing names included, don't matter. An empty table gives no rows.
    """
    base = prepared(df, key, text, query)
    rows = judged(base, trigram_counts(base), True, max_end_rate, prior, short)
    return rows.select(F.col("k").alias(key), "level", "seen", "end_rate", "half", "cut")


def with_query(df: DataFrame, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """df with a missing query filled from the other answers to the same query_id."""
    known = df.where(F.col(query).isNotNull() & F.col(query_id).isNotNull()).groupBy(query_id).agg(F.min(query).alias("_known_query"))
    return df.join(known, query_id, "left").withColumn(query, F.coalesce(query, "_known_query")).drop("_known_query")


def found(df: DataFrame, key: str = "answer_id") -> DataFrame:
    """Keys of the texts that were cut."""
    return truncation_scores(with_query(distinct_answers(df, key)), key).where("cut").select(key).distinct()


def by_source(df: DataFrame, key: str = "answer_id", source: str = "source", text: str = "answer") -> DataFrame:
    """source, answers, truncated, share: over each source's distinct answers; a null source is a source of its own."""
    one = with_query(distinct_answers(df, key))
    s = truncation_scores(one, key, text)
    each = one.join(s, key).select(F.col(source).alias("source"), F.col(text).alias("x"), F.coalesce("cut", F.lit(False)).alias("cut")).where("x is not null")
    each = each.groupBy("source", "x").agg(F.max("cut").alias("cut"))
    return each.groupBy("source").agg(F.count("*").alias("answers"), F.count_if("cut").alias("truncated"), F.round(F.count_if("cut") / F.count("*"), 6).alias("share"))
