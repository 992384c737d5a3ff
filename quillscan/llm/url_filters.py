"""Judgement of urls: rules on hosts and paths, and reputations of hosts by empirical Bayes where no rule fits.

The outcomes that reputations learn from are pages with a label, here those that a rule decides. A level's pages with
a label follow a beta-binomial law around the level above it: host, registered domain, suffix, all. How strongly a
level holds to the one above (its concentration) is estimated from the spread of the rates by moments. A host's
posterior then is a beta law; a page is blocked if the lower bound of its host's rate of blocked pages is above LIMIT.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.llm.common import saved

#: Rules as (verdict, host, path); a rule fits its host and all subdomains, and paths that start with its own.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: A host is blocked if its rate of blocked pages is above LIMIT by SPREADS standard deviations of the posterior: whatever its shape, at least SPREADS^2 / (1 + SPREADS^2) = 90 % of it lies above then (Cantelli).
LIMIT, SPREADS = 0.5, 3.0
#: Least and largest share of variance between the members of a level; where nothing can be estimated, USUAL holds.
LEAST, MOST, USUAL = 0.001, 0.9, 0.1
#: Second levels under two-letter suffixes that registrars sell names below (co.uk).
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Hosts that are broadcast at most.
MOST_SENT = 100_000


def host_of(url: Column) -> Column:
    """What stands after the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A(?:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What stands after the host up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A(?:.*?)://[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """The longest rule that fits, as a struct of rule (host and path) and verdict, or null. Of rules of one length, that with the longer host."""
    ordered = sorted(RULES if rules is None else rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1], r[0]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column) -> Column:
    """A struct of suffix and registered domain (one label more) of a host; users and ports aside. An address or a bare suffix is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r"(?<!:):\d*$", "")
    bare = F.regexp_replace(bare, r"\.+$", "")
    labels = F.split(bare, r"\.")
    n = F.size(labels)
    last, second = F.element_at(labels, -1), F.coalesce(F.get(labels, n - 2), F.lit(""))
    deep = (n >= 3) & (F.length(last) == 2) & second.isin(SECOND)
    of = F.when(deep, 2).otherwise(1)
    join = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.least(k, n)), ".")
    address = bare.rlike(r"^\d+(\.\d+){3}$|:")
    return F.struct(F.when(address, F.lit("")).otherwise(join(of)).alias("suffix"), F.when(address, bare).otherwise(join(of + 1)).alias("domain"))


def _spread(level: DataFrame, above: list[str]) -> Column:
    """The share of variance between a level's members (bad of n) within `above`, by moments pooled over them; a row."""
    per = level.where("n > 0").groupBy(*above).agg(F.sum("bad").alias("k"), F.sum("n").alias("s"), F.count("*").alias("m"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("bad").cast("double") * F.col("bad") / F.col("n")).alias("kk"))
    p = F.col("k") / F.col("s")
    among = F.col("kk") - F.col("k") * p - p * (1 - p) * (F.col("m") - 1)
    most = p * (1 - p) * (F.col("s") - F.col("nn") / F.col("s") - (F.col("m") - 1))
    return per.agg(F.sum(among).alias("among"), F.sum(most).alias("most")).select(F.when(F.col("most") > 0, F.least(F.greatest(F.col("among") / F.col("most"), F.lit(LEAST)), F.lit(MOST))).otherwise(USUAL).alias("rho"))


def reputations(hosts: DataFrame) -> DataFrame:
    """host, mean and lower (bound of the posterior rate of bad pages) for hosts (host, bad, n: pages with a label; both may be 0).

    Levels are joined by their keys; only the four concentrations and the rate of all, a number each, come to the driver.
    """
    own = saved(hosts.withColumn("_d", domain_of(F.col("host"))).select("host", "_d.suffix", "_d.domain", "bad", "n"), "hosts")
    add = [F.sum("bad").alias("bad"), F.sum("n").alias("n")]
    domains = saved(own.groupBy("suffix", "domain").agg(*add), "domains")
    suffixes = saved(domains.groupBy("suffix").agg(*add), "suffixes")
    whole = suffixes.agg(*add).first()
    rate = ((whole["bad"] or 0) + 1) / ((whole["n"] or 0) + 2)
    held = lambda level, above: 1 / level.transform(lambda x: _spread(x, above)).first()["rho"] - 1
    by_host, by_domain, by_suffix = held(own, ["suffix", "domain"]), held(domains, ["suffix"]), held(suffixes, [])
    toward = lambda mean, strength: (F.col("bad") + strength * mean) / (F.col("n") + strength)
    means = suffixes.select("suffix", toward(F.lit(rate), by_suffix).alias("mean"))
    means = saved(domains.join(means, "suffix").select("suffix", "domain", toward(F.col("mean"), by_domain).alias("mean")), "means")
    mean = toward(F.col("mean"), by_host)
    found = own.join(means, ["suffix", "domain"]).withColumn("_all", F.col("n") + by_host).withColumn("mean", mean)
    lower = F.col("mean") - SPREADS * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("_all") + 1))
    return found.select("host", "mean", F.round(lower, 9).alias("lower"))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each page (page_id, url); other columns are not read.

    Pages that a rule decides are the labelled ones. A null url, or one without ://, has an empty host and path. Rows that
    repeat an id are judged each. Hosts are counted before anything is shuffled; their verdicts are broadcast up to
    MOST_SENT, and joined with a split of hot hosts beyond.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_fit", fitting(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "_fit.rule", "_fit.verdict")
    bad = F.count(F.when(F.col("verdict") == "block", 1))
    hosts = rows.groupBy("host").agg(bad.alias("bad"), F.count("verdict").alias("n"))
    found = reputations(hosts).select("host", F.when(F.col("lower") > LIMIT, "block").otherwise("allow").alias("_method"))
    found = saved(found, "verdicts")
    met = rows.join(F.broadcast(found) if found.count() <= MOST_SENT else found, "host", "left")
    return met.select("page_id", "host", "path", "rule", F.coalesce("verdict", "_method").alias("verdict"))


def op13(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql_spread(level: str, above: str) -> str:
    return f"""SELECT 1 / CASE WHEN sum(most) > 0 THEN least(greatest(sum(among) / sum(most), {LEAST}), {MOST}) ELSE {USUAL} END - 1 AS held FROM (
  SELECT kk - k * (k / s) - (k / s) * (1 - k / s) * (m - 1) AS among, (k / s) * (1 - k / s) * (s - nn / s - (m - 1)) AS most FROM (
    SELECT sum(bad)::DOUBLE AS k, sum(n)::DOUBLE AS s, count(*) AS m, sum(n::DOUBLE * n) AS nn, sum(bad::DOUBLE * bad / n) AS kk FROM {level} WHERE n > 0 GROUP BY {above}))"""


_SQL_FITS = "\n".join(f"       WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
ORACLE = f"""
WITH u AS (SELECT page_id, translate(CASE WHEN contains(url, '://') THEN regexp_extract(url[position('://' IN url) + 3 :], '^[^/?#]*') ELSE '' END, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  CASE WHEN contains(url, '://') THEN regexp_extract(url[position('://' IN url) + 3 :], '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r AS (SELECT *, CASE
{_SQL_FITS} END AS rule FROM u),
v AS (SELECT *, CASE WHEN rule IN ({", ".join(f"'{h}{p}'" for x, h, p in RULES if x == "block")}) THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS decided FROM r),
h AS (SELECT host, regexp_extract(host, '[^.]*$') AS suffix, regexp_extract(host, '(?:[^.]*\\.)?[^.]*$') AS domain, count(*) FILTER (decided = 'block') AS bad, count(decided) AS n FROM v GROUP BY ALL),
d AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM d GROUP BY ALL),
a AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS rate FROM s),
hh AS ({_sql_spread("h", "suffix, domain")}), hd AS ({_sql_spread("d", "suffix")}), hs AS ({_sql_spread("s", "()")}),
ms AS (SELECT suffix, (bad + hs.held * a.rate) / (n + hs.held) AS mean FROM s, hs, a),
md AS (SELECT d.suffix, d.domain, (d.bad + hd.held * ms.mean) / (d.n + hd.held) AS mean FROM d JOIN ms USING (suffix), hd),
mh AS (SELECT h.host, (h.bad + hh.held * md.mean) / (h.n + hh.held) AS mean, h.n + hh.held AS total FROM h JOIN md USING (suffix, domain), hh),
f AS (SELECT host, CASE WHEN round(mean - {SPREADS} * sqrt(mean * (1 - mean) / (total + 1)), 9) > {LIMIT} THEN 'block' ELSE 'allow' END AS method FROM mh)
SELECT page_id, host, path, rule, coalesce(decided, method) AS verdict FROM v JOIN f USING (host)
"""
