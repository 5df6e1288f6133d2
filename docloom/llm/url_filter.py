"""Operator 9, url filters: explicit rules, then empirical-Bayes host reputation; DataFrame operations only.

Labelled pages (bad or not) are counted by host, registered domain (last two labels) and suffix (last label).
Each level's rate is shrunk towards the level above through a beta-binomial prior whose strength is estimated
from the counts by the method of moments: global -> suffix -> domain -> host. A host is blocked when the lower
posterior bound of its bad rate (mean minus ``Z`` standard deviations) exceeds ``TOLERANCE``; unseen hosts carry
the prior alone. Rules come first; the longest fitting rule decides.

Defined results: null urls and urls without ``://`` have empty host and path and are judged by the prior; a null
or unlabelled page adds no evidence; empty tables give empty results. Only one row of four moments per level
reaches the driver.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import table

#: (rule, verdict): host up to the first slash, then the start of the path.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
TOLERANCE, Z = 0.5, 1.645
#: Bounds of a prior's strength, in pseudo-observations.
WEAKEST, STRONGEST = 1.0, 1000.0


def url_host(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: len(r[0])):
        at, start = rule.split("/", 1)
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _strength(counts: DataFrame) -> tuple[float, float]:
    """(rate, prior strength) of a level's counts (n, bad), by moments of the beta-binomial."""
    m = counts.agg(
        F.count(F.lit(1)).alias("g"), F.sum("n").alias("n"), F.sum("bad").alias("y"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("yy"),
    ).first()
    if not m["n"]:
        return 0.0, WEAKEST
    p = m["y"] / m["n"]
    spread = m["n"] - m["nn"] / m["n"] - (m["g"] - 1)
    if not 0 < p < 1 or spread <= 0:
        return p, STRONGEST
    rho = ((m["yy"] - m["y"] * p) / (p * (1 - p)) - (m["g"] - 1)) / spread
    return p, min(STRONGEST, max(WEAKEST, 1 / max(rho, 1e-9) - 1))


def host_levels(host: Column) -> tuple[Column, Column]:
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def host_reputation(hosts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """hosts(host) and outcomes(host, bad 0/1) -> one row per host with its posterior mean and lower bound."""
    domain, suffix = host_levels(F.col("host"))
    by_host = outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    levels = by_host.withColumns({"domain": domain, "suffix": suffix})
    by_domain = levels.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    (rate, m_suffix), (_, m_domain), (_, m_host) = _strength(by_suffix), _strength(by_domain), _strength(by_host)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return (
        hosts.select("host").distinct().withColumns({"domain": domain, "suffix": suffix})
        .join(by_suffix.select("suffix", F.col("n").alias("ns"), F.col("bad").alias("bs")), "suffix", "left")
        .join(by_domain.select("domain", F.col("n").alias("nd"), F.col("bad").alias("bd")), "domain", "left")
        .join(by_host.select("host", F.col("n").alias("nh"), F.col("bad").alias("bh")), "host", "left")
        .withColumn("mu", (zero("bs") + m_suffix * rate) / (zero("ns") + m_suffix))
        .withColumn("mu", (zero("bd") + m_domain * F.col("mu")) / (zero("nd") + m_domain))
        .withColumn("a", zero("bh") + m_host * F.col("mu"))
        .withColumn("b", zero("nh") - zero("bh") + m_host * (1 - F.col("mu")))
        .withColumn("bad_mean", F.col("a") / (F.col("a") + F.col("b")))
        .withColumn("bad_low", F.col("bad_mean") - Z * F.sqrt(F.col("bad_mean") * (1 - F.col("bad_mean")) / (F.col("a") + F.col("b") + 1)))
        .select("host", "bad_mean", "bad_low")
    )


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """pages(page_id, url), outcomes(page_id, bad) -> page_id, host, path, rule, verdict, bad_low."""
    urls = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    seen = urls.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id").select("host", "bad")
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    return (
        urls.join(host_reputation(urls, seen), "host").withColumn("_fit", fit)
        .select("page_id", "host", "path", F.col("_fit.rule").alias("rule"),
                F.coalesce("_fit.verdict", F.when(F.col("bad_low") > tolerance, "block").otherwise("allow")).alias("verdict"),
                F.round("bad_low", 6).alias("bad_low"))
    )


def op9_url_filter(spark, sf_dir):
    """Evidence: the labels whose doc_id names a page; bad means toxic."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.filter("toxic IS NOT NULL").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.expr("cast(toxic = 1 as int)")).alias("bad"))
    return judge_urls(table(spark, sf_dir, "pages"), outcomes).drop("bad_low")


def _moments(level: str) -> str:
    return f"""(SELECT CASE WHEN coalesce(sum(n), 0) = 0 THEN 1.0
      WHEN sum(bad) = 0 OR sum(bad) = sum(n) OR sum(n) - sum(n * n)::DOUBLE / sum(n) - (count(*) - 1) <= 0 THEN 1000.0
      ELSE least(1000.0, greatest(1.0, 1 / greatest(1e-9, ((sum(bad * bad / n::DOUBLE) - sum(bad) * (sum(bad)::DOUBLE / sum(n)))
        / ((sum(bad)::DOUBLE / sum(n)) * (1 - sum(bad)::DOUBLE / sum(n))) - (count(*) - 1))
        / (sum(n) - sum(n * n)::DOUBLE / sum(n) - (count(*) - 1))) - 1)) END FROM {level})"""


OP9_SQL = f"""
WITH u AS (SELECT page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
o AS (SELECT doc_id AS page_id, max((toxic = 1)::INT) AS bad FROM labels WHERE toxic IS NOT NULL GROUP BY 1),
h AS (SELECT host, count(*)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM u JOIN o USING (page_id) GROUP BY 1),
l AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM h),
d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM l GROUP BY 1, 2),
s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM d GROUP BY 1),
k AS (SELECT coalesce((SELECT sum(bad)::DOUBLE / sum(n) FROM s), 0.0) AS rate, {_moments('s')} AS ms, {_moments('d')} AS md, {_moments('h')} AS mh),
x AS (SELECT DISTINCT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM u),
m AS (SELECT x.host, (coalesce(d.bad, 0) + k.md * ((coalesce(s.bad, 0) + k.ms * k.rate) / (coalesce(s.n, 0) + k.ms))) / (coalesce(d.n, 0) + k.md) AS mu,
    coalesce(h.bad, 0) AS hb, coalesce(h.n, 0) AS hn, k.mh AS mh
  FROM x LEFT JOIN s USING (suffix) LEFT JOIN d USING (domain) LEFT JOIN h USING (host), k),
p AS (SELECT host, (hb + mh * mu) / (hn + mh) AS q, hn + mh AS t FROM m),
r(rule, host, start, verdict) AS (VALUES {', '.join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in RULES)}),
f AS (SELECT u.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM u JOIN r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.start) GROUP BY 1)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, CASE WHEN q - {Z} * sqrt(q * (1 - q) / (t + 1)) > {TOLERANCE} THEN 'block' ELSE 'allow' END) AS verdict
FROM u JOIN p USING (host) LEFT JOIN f USING (page_id)
"""
