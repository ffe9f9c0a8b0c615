"""URL filter: longest matching rule first, else the host's reputation.

Reputation is empirical Bayes. Labelled page outcomes (bad or not) are counted by host and shrunk through
beta-binomial priors: the suffix's rate towards the rate of all, the registered domain's towards its suffix's, the
host's towards its domain's. How hard each level shrinks is estimated from the counts (analysis of variance of the
rates). A host is blocked when the lower bound of its posterior bad rate is above a threshold.

A rule is (host, path, verdict); it fits its host and all subdomains if the url's path starts with the rule's. The
longest host + path wins, block before allow on a tie. A null url, or one without ``://``, has empty host and path:
no rule fits it and it is judged by the rate of all. Pages without label use the prior of the nearest level seen.
Null page_ids have no outcome; repeated rows are judged each; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.llm.common import LOWER, UPPER, cut, small, table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Second-level labels that belong to the public suffix when the top level has two letters.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: A host is blocked if its bad rate is above THRESHOLD with the certainty that Z stands for.
THRESHOLD, Z = 0.5, 1.645
#: As many rules at most are matched as literals in the row; more are joined.
MOST_RULES = 1000


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^?#]*)", 1)
    host = F.translate(F.substring_index(after, "/", 1), UPPER, LOWER)
    return host, F.substring(after, F.char_length(host) + 1, F.char_length(after))


def domain(host: Column) -> Column:
    parts = F.split(host, r"\.")
    deep = (F.size(parts) >= 3) & (F.char_length(F.element_at(parts, -1)) == 2) & F.get(parts, F.size(parts) - 2).isin(*SECOND_LEVEL)
    return F.when(deep, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def suffix(host: Column, registered: Column) -> Column:
    return F.when(registered.contains("."), F.substring(registered, F.char_length(F.substring_index(registered, ".", 1)) + 2, F.char_length(registered))).otherwise(registered)


def concentration(level: DataFrame, parent: float | str) -> float:
    """Pseudo-count of the beta prior over groups (n, bad), by the variance of their rates about the parent's."""
    p = F.lit(parent) if isinstance(parent, float) else F.col(parent)
    r = level.agg(F.sum("n"), F.sum(F.col("n") * F.col("n")), F.count("*"), F.sum(F.col("n") * (F.col("bad") / F.col("n") - p) ** 2), F.sum(F.col("n") * p * (1 - p))).first()
    total, squares, groups, spread, within = (float(x or 0) for x in r)
    if total == 0 or within == 0 or groups < 2 or total - squares / total - groups + 1 <= 0:
        return 1.0
    v = within / total
    rho = (spread - (groups - 1) * v) / (v * (total - squares / total - groups + 1))
    return 1 / min(max(rho, 1e-4), 0.99) - 1


def reputation(pages: DataFrame, outcomes: DataFrame, z: float = Z) -> tuple[DataFrame, float]:
    """Per host seen (host, n, bad, rate, bound), and the rate of all. ``outcomes``: (page_id, bad 0 or 1)."""
    host, _ = url_parts(F.col("url"))
    registered = domain(F.col("host"))
    judged = outcomes.select(F.col("page_id").alias("_page"), F.col("bad").cast("double").alias("bad"))
    hosts = (
        pages.select(F.col("page_id").alias("_page"), host.alias("host")).join(judged, "_page", "left")
        .groupBy("host").agg(F.count("bad").cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
        .withColumn("domain", registered).withColumn("suffix", suffix(F.col("host"), F.col("domain")))
    )
    hosts = cut(hosts)
    domains = cut(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad = domains.agg(F.sum("n"), F.sum("bad")).first()
    base = (float(bad or 0) + 0.5) / (float(n or 0) + 1)

    def shrunk(level: DataFrame, prior: float | str) -> tuple[DataFrame, float]:
        m = concentration(level.filter("n > 0"), prior)
        p = F.lit(prior) if isinstance(prior, float) else F.col(prior)
        return level.withColumn("rate", (F.col("bad") + m * p) / (F.col("n") + m)), m

    suffixes, _ = shrunk(suffixes, base)
    domains, _ = shrunk(domains.join(suffixes.select("suffix", F.col("rate").alias("prior")), "suffix"), "prior")
    hosts, m = shrunk(hosts.join(domains.select("domain", F.col("rate").alias("prior")), "domain"), "prior")
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + m + 1))
    return hosts.withColumn("bound", F.col("rate") - z * sd).select("host", "n", "bad", "rate", "bound"), base


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))
    found = F.lit(None).cast("struct<rule:string,said:string>")
    for h, p, verdict in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("said"))).otherwise(found)
    return found


def rules_joined(urls: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """(host, path, fit) of the urls (host, path) that a rule fits, as ``rule_of`` says, for any number of rules.

    A rule is met by an end of the host and a start of the path as long as some rule of that host's path.
    """
    known = urls.sparkSession.createDataFrame(list(rules), "h string, p string, said string")
    known = cut(known.groupBy("h", "p").agg(F.min_by("said", F.struct(F.col("said") != "block", "said")).alias("said")))
    lengths = known.groupBy("h").agg(F.collect_set(F.char_length("p")).alias("lengths"))
    parts = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    asked = urls.distinct().select("host", "path", F.explode(ends).alias("h")).join(small(lengths), "h")
    asked = asked.select("host", "path", "h", F.explode("lengths").alias("length")).filter(F.col("length") <= F.char_length("path"))
    found = asked.select("host", "path", "h", F.substring(F.col("path"), F.lit(1), F.col("length")).alias("p")).join(small(known), ["h", "p"])
    order = F.struct(-F.char_length("h") - F.char_length("p"), F.col("said") != "block", "h", "p")
    return found.groupBy("host", "path").agg(F.min_by(F.struct(F.concat("h", "p").alias("rule"), "said"), order).alias("fit"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, bad_rate, bad_bound) for every page."""
    known, base = reputation(pages, outcomes)
    host, path = url_parts(F.col("url"))
    known = known.select(F.col("host").alias("_host"), "rate", "bound")
    urls = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    if len(rules) > MOST_RULES:
        urls = urls.join(small(cut(rules_joined(urls.select("host", "path"), rules))), ["host", "path"], "left")
    else:
        urls = urls.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    return (
        urls.join(known, F.col("host") == F.col("_host"), "left")
        .select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.said", F.when(F.col("bound") > threshold, "block").otherwise("allow")).alias("verdict"), F.coalesce("rate", F.lit(base)).alias("bad_rate"), F.col("bound").alias("bad_bound"))
    )


def op8_judge_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the label of the same number; a toxic one is bad."""
    outcomes = table(spark, sf_dir, "labels").filter("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("toxic").alias("bad"))
    return judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_judge_urls": op8_judge_urls}

_FITS = "((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
_RULES = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
ORACLE_SQL: dict[str, str] = {
    "op8_judge_urls": f"""
WITH parts AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), '{UPPER}', '{LOWER}') AS host,
         substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/]*')) + 1) AS path FROM parts),
outcome AS (SELECT doc_id, max(toxic)::DOUBLE AS bad FROM labels WHERE toxic IS NOT NULL GROUP BY doc_id),
hosts AS (
  SELECT *, CASE WHEN contains(dom, '.') THEN substr(dom, instr(dom, '.') + 1) ELSE dom END AS suf FROM (
    SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0) AS bad,
      CASE WHEN regexp_matches(host, '\\.({"|".join(SECOND_LEVEL)})\\.[^.][^.]$') THEN regexp_extract(host, '[^.]*\\.[^.]*\\.[^.]*$')
           WHEN contains(host, '.') THEN regexp_extract(host, '[^.]*\\.[^.]*$') ELSE host END AS dom
    FROM split LEFT JOIN outcome ON page_id = doc_id GROUP BY host)),
base AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS p FROM hosts),
s0 AS (SELECT suf, sum(n) AS n, sum(bad) AS bad, any_value(p) AS p FROM hosts, base GROUP BY suf),
sm AS (SELECT 1 / least(greatest(coalesce((spread - (g - 1) * v) / (v * (t - sq / t - g + 1)), 0.5), 1e-4), 0.99) - 1 AS m FROM (
  SELECT sum(n) t, sum(n * n) sq, count(*) g, sum(n * pow(bad / n - p, 2)) spread, sum(n * p * (1 - p)) / sum(n) v FROM s0 WHERE n > 0)),
s1 AS (SELECT suf, (bad + m * p) / (n + m) AS p FROM s0, sm),
d0 AS (SELECT dom, h.suf, sum(n) AS n, sum(bad) AS bad, any_value(p) AS p FROM hosts h JOIN s1 USING (suf) GROUP BY dom, h.suf),
dm AS (SELECT 1 / least(greatest(coalesce((spread - (g - 1) * v) / (v * (t - sq / t - g + 1)), 0.5), 1e-4), 0.99) - 1 AS m FROM (
  SELECT sum(n) t, sum(n * n) sq, count(*) g, sum(n * pow(bad / n - p, 2)) spread, sum(n * p * (1 - p)) / sum(n) v FROM d0 WHERE n > 0)),
d1 AS (SELECT dom, (bad + m * p) / (n + m) AS p FROM d0, dm),
h0 AS (SELECT host, n, bad, p FROM hosts JOIN d1 USING (dom)),
hm AS (SELECT 1 / least(greatest(coalesce((spread - (g - 1) * v) / (v * (t - sq / t - g + 1)), 0.5), 1e-4), 0.99) - 1 AS m FROM (
  SELECT sum(n) t, sum(n * n) sq, count(*) g, sum(n * pow(bad / n - p, 2)) spread, sum(n * p * (1 - p)) / sum(n) v FROM h0 WHERE n > 0)),
h1 AS (SELECT host, (bad + m * p) / (n + m) AS rate, n + m + 1 AS k FROM h0, hm),
rep AS (SELECT host AS seen, CASE WHEN rate - {Z} * sqrt(rate * (1 - rate) / k) > {THRESHOLD} THEN 'block' ELSE 'allow' END AS said FROM h1)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{h}{p}'" for h, p, _ in _RULES)} END AS rule,
  CASE {" ".join(f"WHEN {_FITS.format(h=h, p=p)} THEN '{v}'" for h, p, v in _RULES)} ELSE said END AS verdict
FROM split LEFT JOIN rep ON host = seen"""
}
