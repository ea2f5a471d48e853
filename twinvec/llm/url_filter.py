"""URL filter: host rules, and empirical-Bayes host reputation where no rule fits (DataFrame functions only).

Labelled page outcomes (bad or not) are counted per host, registered domain and public suffix. At every level
the rate is shrunk by a beta-binomial prior towards the posterior mean of the level above (suffix towards the
corpus, domain towards suffix, host towards domain); the prior's weight is estimated from the spread of the
level's groups by the method of moments. A host is blocked if the lower bound of its posterior,
``mean - z * sd``, is above ``max_bad``.

Registered domain: the last two labels of the host; suffix: the last label (no suffix list is at hand).
Defined results: a null url or one without ``://`` has empty host and path, belongs to the group ``''`` and is judged
by it like any host; a page without outcome adds nothing to the counts; several outcomes of a page count as bad
if one is; with no labels at all every page is allowed; repeated pages are judged alike; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinvec.llm.registry import register, table
from twinvec.session import checkpoint

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the contract, (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
Z, MAX_BAD, SALTS, MIN_WEIGHT, MAX_WEIGHT = 1.645, 0.3, 32, 1.0, 10_000.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits the host or a domain above it and starts the path: struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later cases win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def prior_weight(groups: DataFrame, mean: str) -> float:
    """Weight of a beta prior from the spread of the groups' rates ``k / n`` about ``mean`` (method of moments)."""
    p = F.col(mean)
    v = p * (1 - p)
    s = groups.where("n > 0").agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - p, 2)).alias("between"), F.avg(v).alias("v"),
        F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("groups")).first()
    if not s["groups"] or s["groups"] < 2 or not s["v"]:
        return MAX_WEIGHT
    room = s["total"] - s["squares"] / s["total"] - (s["groups"] - 1)
    rho = (s["between"] - s["v"] * (s["groups"] - 1)) / (s["v"] * room) if room > 0 else 0.0
    return min(MAX_WEIGHT, max(MIN_WEIGHT, (1 - rho) / rho)) if rho > 0 else MAX_WEIGHT


def reputation(counts: DataFrame, z: float = Z) -> DataFrame:
    """``host, n_pages, n, k`` to ``host, n_pages, mean, bound``: shrunk rate of bad pages and its lower posterior bound."""
    label = lambda n: F.substring_index("host", ".", -n)
    hosts = counts.withColumn("domain", label(2)).withColumn("suffix", label(1))
    total = counts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = (total["k"] or 0) / total["n"] if total["n"] else 0.0
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("up", F.lit(overall))
    post = lambda m: (F.col("k") + m * F.col("up")) / (F.col("n") + m)
    suffixes = suffixes.select("suffix", post(prior_weight(suffixes, "up")).alias("up"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.select("domain", post(prior_weight(domains, "up")).alias("up"))
    hosts = checkpoint(hosts.join(domains, "domain"))
    m = prior_weight(hosts, "up")
    mean = post(m)
    return hosts.select("host", "n_pages", mean.alias("mean"),
                        (mean - z * F.sqrt(mean * (1 - mean) / (F.col("n") + m + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, max_bad: float = MAX_BAD,
          salts: int = SALTS) -> DataFrame:
    """Verdict for every row of ``pages (page_id, url)`` from ``outcomes (page_id, bad)``.

    A hot host is spread: its counts are combined before the shuffle, and the join back runs on
    (host, salt of the page) with ``salts`` copies of each host's row.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = outcomes.where("bad is not null").groupBy("page_id").agg(F.max("bad").cast("int").alias("bad"))
    counts = checkpoint(p.join(bad, "page_id", "left").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k")))
    rep = reputation(counts, z).select("host", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
                                       (F.col("bound") > max_bad).alias("bad_host"))
    salted = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return salted.join(rep, ["host", "salt"]).select("page_id", "host", "path", rule.alias("r"), "bad_host").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"))


def _weight_sql(name: str, src: str) -> str:
    return f"""{name} AS (SELECT CASE WHEN g < 2 OR v IS NULL OR v = 0 THEN {MAX_WEIGHT} WHEN room <= 0 OR (b - v * (g - 1)) <= 0 THEN {MAX_WEIGHT}
    ELSE least({MAX_WEIGHT}, greatest({MIN_WEIGHT}, (1 - (b - v * (g - 1)) / (v * room)) / ((b - v * (g - 1)) / (v * room)))) END AS m
  FROM (SELECT sum(n * power(k / n - up, 2)) AS b, avg(up * (1 - up)) AS v, sum(n) - sum(n * n) / sum(n) - (count(*) - 1) AS room,
    count(*) AS g FROM {src} WHERE n > 0))"""


_RULES_SQL = "CASE " + " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))) + " END"

SQL = rf"""WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (SELECT doc_id AS page_id, max((quality = 0 OR toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
    count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k FROM p LEFT JOIN o USING (page_id) GROUP BY host),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT sum(k) / sum(n) FROM h) AS up FROM h GROUP BY suffix),
{_weight_sql('ms', 's0')},
s AS (SELECT suffix, (k + m * up) / (n + m) AS up FROM s0, ms),
d0 AS (SELECT domain, any_value(up) AS up, sum(n) AS n, sum(k) AS k FROM h JOIN s USING (suffix) GROUP BY domain),
{_weight_sql('md', 'd0')},
d AS (SELECT domain, (k + m * up) / (n + m) AS up FROM d0, md),
h0 AS (SELECT host, n, k, up FROM h JOIN d USING (domain)),
{_weight_sql('mh', 'h0')},
b AS (SELECT host, q - {Z} * sqrt(q * (1 - q) / (n + m + 1)) > {MAX_BAD} AS bad_host
  FROM (SELECT host, n, m, (k + m * up) / (n + m) AS q FROM h0, mh))
SELECT page_id, host, path, {_RULES_SQL} AS rule,
  CASE {_RULES_SQL} {' '.join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES)} ELSE CASE WHEN bad_host THEN 'block' ELSE 'allow' END END AS verdict
FROM p JOIN b USING (host)"""


@register("op3_url_filter", SQL)
def op3_url_filter(spark, sf_dir):
    """Outcomes: the row of ``labels`` whose id is the page's; bad: low quality or toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return judge(table(spark, sf_dir, "pages"), outcomes)
