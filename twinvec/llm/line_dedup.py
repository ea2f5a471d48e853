"""Line dedup by winnowing (DataFrame functions only).

A document is its list of ``\n``-split lines. Every window of ``window`` consecutive lines selects the smallest of
its line hashes (leftmost on ties) as a fingerprint, so two equal runs of at least ``window`` lines always
select the same one. Fingerprints are counted; those that occur once cannot belong to a repeated run and are left
out. A fingerprint that recurs is extended to both sides: each window that selected it is compared, by the hash of
all its lines, with the first place where the same window occurs. A window that is not at its first place is a
repeat; overlapping repeats join to runs, and the lines of every later run are deleted. The first copy stays.

Grouping by the whole window instead of pairing positions keeps a passage of any number of copies linear.

Defined results: order is (doc_id, text hash, line); a null text has no lines and stays null; an empty text is one empty
line; rows equal in id and text are one document and get the same answer; texts shorter than the window are
unchanged; a null id sorts first; other columns pass through, ``n_lines`` and ``n_removed`` replace columns of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinvec.llm.registry import register, table
from twinvec.session import checkpoint

WINDOW = 3


def fingerprints(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, doc_id, mark`` and the windows ``at (start, key)`` that selected the mark, one row per fingerprint."""
    d = docs.where("text is not null").select(
        F.xxhash64("doc_id", "text").alias("row"), "doc_id",
        F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("h")).where(F.size("h") >= window)
    part = lambda i: F.slice("h", i + 1, window)
    d = d.select("row", "doc_id", F.explode(F.transform(
        F.sequence(F.lit(0), F.size("h") - window),
        lambda i: F.struct(i.alias("start"), (i + F.array_position(part(i), F.array_min(part(i))) - 1).alias("place"),
                           F.array_min(part(i)).alias("mark"),
                           F.xxhash64(*[F.get("h", i + j) for j in range(window)]).alias("key")))).alias("w"))
    return d.select("row", "doc_id", "w.start", "w.place", "w.mark", "w.key")


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``row, starts``: where windows begin whose lines all occur earlier."""
    marks = checkpoint(fingerprints(docs, window))
    # A mark's windows lie in one row and place; it recurs if it has two places.
    place = F.struct("row", "place")
    again = marks.groupBy("mark").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("mark")
    w = marks.join(again, "mark", "left_semi")
    at = F.struct("doc_id", "row", "start")
    first = w.groupBy("key").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first <> last").select("key", "first")
    later = w.join(first, "key").where(~F.struct("doc_id", "row", "start").eqNullSafe(F.col("first")))
    return later.groupBy("row").agg(F.array_sort(F.collect_set("start")).alias("starts"))


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with later runs deleted from ``text``, plus ``n_lines`` and ``n_removed``."""
    cut = repeats(docs, window).select(F.col("row").alias("k"), "starts")
    d = docs.select(F.struct("*").alias("own"), F.xxhash64("doc_id", "text").alias("k")).join(cut, "k", "left")
    # Covered lines, once for each document: every start stands for its window.
    lost = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + window - 1))))
    d = d.select("own", lost.alias("lost"), F.split("own.text", "\n").alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    text = F.when(F.col("lost").isNull(), F.col("own.text")).otherwise(
        F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    new = {"n_lines": F.coalesce(F.size("lines"), F.lit(0)).cast("long"),
           "n_removed": F.coalesce(F.size("lost"), F.lit(0)).cast("long")}
    own = [text.alias(c) if c == "text" else F.col("own")[c].alias(c) for c in docs.columns if c not in new]
    return d.select(*own, *[v.alias(k) for k, v in new.items()])


SQL = f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, array_to_string(x[i:i + {WINDOW - 1}], chr(10)) AS k
  FROM (SELECT doc_id, x, unnest(range(1, len(x) - {WINDOW - 2})) AS i FROM l)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS p FROM r WHERE n > 1),
k AS (SELECT doc_id, p, x[p] AS line FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS p FROM l)),
s AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS t, count(*) AS n FROM k ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(len(x), 0)::BIGINT AS n_lines, (coalesce(len(x), 0) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN l USING (doc_id) LEFT JOIN s USING (doc_id)"""


@register("op7_line_dedup", SQL)
def op7_line_dedup(spark, sf_dir):
    d = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
