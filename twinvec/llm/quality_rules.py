"""Quality rules with thresholds read from mergeable quantile sketches (DataFrame functions only).

Each document gets integer statistics and four rates. A sketch is a histogram of a rate with fixed-width
bins (1/1000 for shares, a tenth of a character for the mean word length), so it has a bounded number of
cells, is exact to one bin, and merges by adding counts: sketches per (language, source) are added up to
sketches per language and for the whole corpus. The thresholds are quartile fences of the sketch,
``q75 + fence * max(q75 - q25, least spread)``, and replace fixed cutoffs. They are joined back to the documents.

Defined results: a null text is empty; a null language or source is the group ``''``; a document that fails
the base rules is dropped and does not enter the sketches; a group of fewer than ``min_docs`` documents uses
its language's sketch, a language of fewer uses the corpus's; repeated rows are judged alike; extra columns of
the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinvec.llm.registry import register, table
from twinvec.session import checkpoint

BLANKS = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: rate: (numerator, denominator, bins per unit, least spread in bins, fence on the low side too)
RATES = {
    "symbols": ("n_symbols", "word_chars", 1000, 10, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1000, 250, False),
    "repeats": ("n_repeat_words", "n_words", 1000, 150, False),
    "word_length": ("word_chars", "n_words", 10, 10, True),
}
MIN_WORDS, MAX_REPEAT_PERCENT, FENCE, MIN_DOCS, SALTS = 50, 50, 3, 50, 32


def words_of(text: Column) -> Column:
    """Maximal runs of characters other than ASCII blanks."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def statistics(docs: DataFrame, window: int = 3) -> DataFrame:
    """``doc_id, lang, source`` and the integer statistics of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
                    words_of(text).alias("words"),
                    F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, BLANKS, " " * len(BLANKS))) != "").alias("lines"))
    d = d.select("doc_id", "lang", "source", F.size("words").cast("long").alias("n_words"),
                 F.array_join("words", "").alias("packed"),
                 F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
                 F.size("lines").cast("long").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    # Windows as (hash, start), sorted: equal windows become neighbours.
    at = F.when(F.size("h") >= window, F.sequence(F.lit(0), F.size("h") - window)).otherwise(F.array().cast("array<int>"))
    d = d.select("doc_id", "lang", "source", "n_words", "n_lines", "n_dup_lines",
                 F.length("packed").cast("long").alias("word_chars"),
                 (F.length("packed") - F.length(F.translate("packed", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 F.sort_array(F.transform(at, lambda i: F.struct(
                     F.xxhash64(*[F.get("h", i + j) for j in range(window)]).alias("k"), i.alias("i")))).alias("w"))
    same = lambda x, j: F.coalesce(F.get("w", j)["k"] == x["k"], F.lit(False))
    starts = F.sort_array(F.transform(F.filter("w", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")),
        lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return d.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                    covered.alias("n_repeat_words"))


def _bin(rate: str) -> Column:
    num, den, per_unit, _, _ = RATES[rate]
    return F.expr(f"({num} * {per_unit}) div greatest({den}, 1)")


def sketches(stats: DataFrame) -> DataFrame:
    """Mergeable sketch per group: ``lang, source, rate, bin, n``."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), _bin(r).alias("bin")) for r in RATES])).alias("x")
    return (stats.where(~F.col("base_failed")).select("lang", "source", rates)
            .groupBy("lang", "source", "x.rate", "x.bin").agg(F.count(F.lit(1)).alias("n")))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """Merge sketches to the level ``by`` and read the quartiles: ``by, rate, docs, q25, q75`` (in bins)."""
    merged = sketch.groupBy(*by, "rate", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "rate")  # at most one row per bin
    run = merged.select(*by, "rate", "bin", F.sum("n").over(w).alias("docs"),
                        F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    at = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * q, F.col("bin")))
    return run.groupBy(*by, "rate").agg(F.first("docs").alias("docs"), at(1).alias("q25"), at(3).alias("q75"))


def thresholds(sketch: DataFrame, fence: int = FENCE, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row per (lang, source) with ``<rate>_lo`` and ``<rate>_hi`` in bins."""
    def level(by, name):
        return quartiles(sketch, by).select(*by, "rate", F.struct("docs", "q25", "q75").alias(name))
    t = (level(["lang", "source"], "own").join(level(["lang"], "by_lang"), ["lang", "rate"])
         .join(level([], "all"), "rate"))
    used = (F.when(F.col("own.docs") >= min_docs, F.col("own")).when(F.col("by_lang.docs") >= min_docs, F.col("by_lang"))
            .otherwise(F.col("all")))
    t = t.select("lang", "source", "rate", used.alias("u"))
    cols = []
    for r, (_, _, _, spread, low) in RATES.items():
        wide = fence * F.greatest(F.col("u.q75") - F.col("u.q25"), F.lit(spread))
        cols.append(F.max(F.when(F.col("rate") == r, F.col("u.q75") + wide)).alias(f"{r}_hi"))
        if low:
            cols.append(F.max(F.when(F.col("rate") == r, F.col("u.q25") - wide)).alias(f"{r}_lo"))
    return t.groupBy("lang", "source").agg(*cols)


def judge(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
          fence: int = FENCE, min_docs: int = MIN_DOCS) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every document."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    stats = checkpoint(statistics(docs).withColumn("base_failed", failed))
    t = thresholds(sketches(stats), fence, min_docs)
    within = F.lit(True)
    for r, (_, _, _, _, low) in RATES.items():
        within = within & (_bin(r) <= F.col(f"{r}_hi"))
        if low:
            within = within & (_bin(r) >= F.col(f"{r}_lo"))
    # A group whose documents all fail has no thresholds, hence the left join; a salt spreads a hot source.
    t = t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    stats = stats.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)).cast("int"))
    return stats.join(t, ["lang", "source", "salt"], "left").select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce(~F.col("base_failed") & within, F.lit(False)).alias("kept"))


_RATES_SQL = " UNION ALL ".join(
    f"SELECT lang, source, '{r}' AS rate, ({n} * {u}) // greatest({d}, 1) AS bin FROM st WHERE NOT base_failed"
    for r, (n, d, u, _, _) in RATES.items())


def _quart_sql(name: str, by: str) -> str:
    k = f"{by}, " if by else ""
    return f"""{name}_run AS (SELECT {k}rate, bin, sum(n) OVER (PARTITION BY {k}rate) AS docs,
    sum(n) OVER (PARTITION BY {k}rate ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto
  FROM (SELECT {k}rate, bin, sum(n) AS n FROM sk GROUP BY {k}rate, bin)),
{name} AS (SELECT {k}rate, any_value(docs) AS docs, min(bin) FILTER (upto * 4 >= docs) AS q25,
    min(bin) FILTER (upto * 4 >= docs * 3) AS q75 FROM {name}_run GROUP BY {k}rate)"""


_SPREAD_SQL = "CASE rate " + " ".join(f"WHEN '{r}' THEN {s}" for r, (_, _, _, s, _) in RATES.items()) + " END"
_WITHIN_SQL = " AND ".join(
    f"({n} * {u}) // greatest({d}, 1) <= {r}_hi" + (f" AND ({n} * {u}) // greatest({d}, 1) >= {r}_lo" if low else "")
    for r, (n, d, u, _, low) in RATES.items())
_FENCE_SQL = ", ".join(f"max(q75 + wide) FILTER (rate = '{r}') AS {r}_hi, max(q25 - wide) FILTER (rate = '{r}') AS {r}_lo"
                       for r in RATES)

SQL = rf"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
st0 AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(array_to_string(ws, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
st AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM st0),
sk AS (SELECT lang, source, rate, bin, count(*) AS n FROM ({_RATES_SQL}) GROUP BY ALL),
{_quart_sql('qo', 'lang, source')}, {_quart_sql('ql', 'lang')}, {_quart_sql('qa', '')},
u AS (SELECT qo.lang, qo.source, rate,
    CASE WHEN qo.docs >= {MIN_DOCS} THEN qo.q25 WHEN ql.docs >= {MIN_DOCS} THEN ql.q25 ELSE qa.q25 END AS q25,
    CASE WHEN qo.docs >= {MIN_DOCS} THEN qo.q75 WHEN ql.docs >= {MIN_DOCS} THEN ql.q75 ELSE qa.q75 END AS q75
  FROM qo JOIN ql USING (lang, rate) JOIN qa USING (rate)),
th AS (SELECT lang, source, {_FENCE_SQL}
  FROM (SELECT *, {FENCE} * greatest(q75 - q25, {_SPREAD_SQL}) AS wide FROM u) GROUP BY lang, source)
SELECT doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND {_WITHIN_SQL}, false) AS kept
FROM st LEFT JOIN th USING (lang, source)"""


@register("op9_quality_rules", SQL)
def op9_quality_rules(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"))
