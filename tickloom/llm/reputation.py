"""URL filters: rules where they fit, else the reputation of the host by empirical Bayes, in DataFrame operations only.

A page's host is judged by the outcomes of labelled pages. A host's rate of bad pages is shrunk towards that of its registered
domain, a domain's towards that of its public suffix, a suffix's towards that of all pages. On each level a node's outcomes are
beta-binomial around its parent's posterior mean m, with one strength M for the level:

    rate ~ Beta(M m, M (1 - m)),   posterior of the node: Beta(bad + M m, n - bad + M (1 - m))

M is fitted to all nodes of the level by moments: sum((bad - n m)^2 - n m (1 - m)) = rho sum(n (n - 1) m (1 - m)), M = 1 / rho - 1,
between MIN_STRENGTH and MAX_STRENGTH; DEFAULT_STRENGTH where no node has two labelled pages. A host is blocked if the lower
posterior bound of its rate, at CREDIBILITY, is above LIMIT: it is as good as sure that most of its pages are bad. Hosts without
labelled pages get the posterior of what they belong to. The bound is the quantile by cube roots (Wilson and Hilferty's, of F as
Paulson has it), whose probability is right within 0.005 for a sum of both parameters over 6, which MIN_STRENGTH ensures.

An outcome belongs to a page by its id; bad means quality 0 or toxic 1. The registered domain is the suffix and a label more; the
suffix is the last label, or the last two where those are a country's general ones (SECOND_LEVEL). A port, a user and a final dot
belong to the host but not to its domain. A numeric address is a domain of its own.

Pages are counted by host with partial sums; levels above work on a row a host, domain and suffix. A host, domain or suffix that
holds one in 20,000 of the rows or more meets its verdict by a broadcast, the others by shuffle. Rules are CASE branches, the
longest first, then by host and path: at most MAX_RULES, more is an error.

Defined results: a null url, or one without ``://``, has empty host and path; such pages are a host of their own. A page without
an id, or whose label says neither quality nor toxic, is unlabelled; of several labels of one id a bad one counts. Repeated pages
count and are returned each. Other columns are carried by filtered, whatever their names. Without labels the strengths
are the default and the rate of all pages is a half. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import looked_up, lower_ascii, table, written

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MAX_RULES = 500
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
MIN_STRENGTH, DEFAULT_STRENGTH, MAX_STRENGTH = 6.0, 20.0, 10_000.0
LIMIT = 0.5
CREDIBILITY = 0.95
#: The normal quantile of 1 - CREDIBILITY, 0.05.
Z = -1.6448536269514722


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url."""
    url = url.cast("string")
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host."""
    name = F.regexp_replace(F.substring_index(F.substring_index(host, "@", -1), ":", 1), r"\.$", "")
    last, two, three = (F.substring_index(name, ".", -n) for n in (1, 2, 3))
    wide = two.rlike(rf"^({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]$")
    number = name.rlike(r"^[0-9.]*$")
    return F.when(number, name).when(wide, three).otherwise(two), F.when(number, F.lit("")).when(wide, two).otherwise(last)


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; {MAX_RULES} at most")
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def outcomes(labels: DataFrame) -> DataFrame:
    """(page_id, bad): one row for each labelled id."""
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    return known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("long")).alias("bad"))


def _strength(nodes: DataFrame) -> float:
    """M of a level from (n, bad, prior) of its nodes."""
    n, b, m = F.col("n"), F.col("bad"), F.col("prior")
    got = nodes.where("n > 1").agg(F.sum((b - n * m) ** 2 - n * m * (1 - m)), F.sum(n * (n - 1.0) * m * (1 - m))).first()
    if not got[1]:
        return DEFAULT_STRENGTH
    rho = min(max(got[0] / got[1], 1 / (1 + MAX_STRENGTH)), 1 / (1 + MIN_STRENGTH))
    return 1 / rho - 1


def _mean(strength: float) -> Column:
    return (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength)


def lower_bound(a: Column, b: Column, z: float = Z) -> Column:
    """The quantile of Beta(a, b) whose probability is the normal one of z, which is below a half; 0 where that is as good as 0."""
    g, k = 1 - 1 / (9 * b), 1 - 1 / (9 * a)
    y = z * z
    c = 9 * k * k - y / a
    r = c / (9 * g * k + F.sqrt(F.greatest(F.lit(0.0), 81 * g * g * k * k - (9 * g * g - y / b) * c)))
    cube = F.pow(r, 3)
    return F.when((k <= 0) | (c <= 0), F.lit(0.0)).otherwise(a * cube / (b + a * cube))


def reputations(pages: DataFrame, judged: DataFrame, id_col: str = "page_id", url: str = "url") -> tuple[DataFrame, int]:
    """(host, n_pages, n, bad, mean, bound) of every host, and how many pages there are. judged: page_id, bad; one row for each id."""
    host = parts(F.col(url))[0]
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"))
    met = rows.where(F.col("page_id").isNotNull()).groupBy("page_id", "host").agg(F.count("*").alias("k")).join(judged.select(F.col("page_id").alias("i"), F.col("bad").alias("b")), F.col("page_id") == F.col("i"))
    zero = F.lit(0).cast("long")
    counts = rows.groupBy("host").agg(F.count("*").alias("n_pages")).select("host", "n_pages", zero.alias("n"), zero.alias("bad"))
    counts = counts.unionByName(met.groupBy("host").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("b")).alias("bad")).select("host", zero.alias("n_pages"), "n", "bad"))
    domain, suffix = levels(F.col("host"))
    hosts = counts.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n_pages", "n", "bad"))).select("host", domain.alias("domain"), suffix.alias("suffix"), "n_pages", "n", "bad")
    hosts = written(hosts, "hosts")
    domains = written(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("n_hosts")), "domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("n_domains"), F.sum("n_hosts").alias("n_hosts")), "suffixes")
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("n_domains").alias("domains"), F.sum("n_hosts").alias("hosts")).first()
    prior = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    suffixes = suffixes.withColumn("prior", F.lit(prior))
    suffixes = suffixes.select("suffix", "n_domains", _mean(_strength(suffixes)).alias("prior"))
    domains = written(looked_up(domains, suffixes, "suffix", "n_domains", total["domains"] or 0), "domain_priors")
    domains = domains.select("domain", "n_hosts", _mean(_strength(domains)).alias("prior"))
    hosts = written(looked_up(hosts, domains, "domain", "n_hosts", total["hosts"] or 0), "host_priors")
    m = _strength(hosts)
    bound = lower_bound(F.col("bad") + m * F.col("prior"), F.col("n") - F.col("bad") + m * (1 - F.col("prior")))
    return hosts.select("host", "n_pages", "n", "bad", _mean(m).alias("mean"), bound.alias("bound")), hosts.agg(F.sum("n_pages")).first()[0] or 0


def _decided(pages: DataFrame, judged: DataFrame, rules: Sequence[tuple[str, str, str]], limit: float, id_col: str, url: str, row: Column) -> DataFrame:
    hosts, total = reputations(pages, judged, id_col, url)
    host, path = parts(F.col(url))
    found = looked_up(pages.select(row.alias("row"), host.alias("host"), path.alias("path")), hosts, "host", "n_pages", total)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    return found.select("row", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("bound") > limit, "block").otherwise("allow")).alias("verdict"), "n", "bad", "mean", "bound")


def verdicts(pages: DataFrame, judged: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, n_labelled, n_bad, mean, bound) of every page; the last four are its host's."""
    out = _decided(pages, judged, rules, limit, id_col, url, F.col(id_col))
    return out.select(F.col("row").alias(id_col), "host", "path", "rule", "verdict", F.col("n").alias("n_labelled"), F.col("bad").alias("n_bad"), "mean", "bound")


def filtered(pages: DataFrame, judged: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, limit: float = LIMIT, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """The pages that are allowed, with their own columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns])
    return _decided(pages, judged, rules, limit, id_col, url, row).where(F.col("verdict") == "allow").select("row.*")


def query(spark, sf_dir):  # noqa: ANN001, ANN201
    out = verdicts(table(spark, sf_dir, "pages"), outcomes(table(spark, sf_dir, "labels")))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "bound")})


def _sql() -> str:
    case = {k: " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if k == 'rule' else v}'" for v, h, p in sorted(RULES, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2]), reverse=True)) for k in ("rule", "verdict")}
    rho = f"coalesce(1 / least(greatest((sum((bad - n * prior) ** 2 - n * prior * (1 - prior)) FILTER (n > 1)) / nullif(sum(n * (n - 1.0) * prior * (1 - prior)) FILTER (n > 1), 0), {1 / (1 + MAX_STRENGTH)}), {1 / (1 + MIN_STRENGTH)}) - 1, {DEFAULT_STRENGTH})"
    y = Z * Z
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p0 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM p0),
l AS (SELECT doc_id, max(CAST(coalesce(quality = 0, false) OR coalesce(toxic = 1, false) AS BIGINT)) AS b FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id),
h0 AS (SELECT host, count(b) AS n, coalesce(sum(b), 0) AS bad FROM p LEFT JOIN l ON p.page_id = l.doc_id GROUP BY host),
h1 AS (SELECT *, regexp_replace(split_part(string_split(host, '@')[-1], ':', 1), '\.$', '') AS name FROM h0),
h2 AS (SELECT *, string_split(name, '.') AS s, regexp_full_match(name, '[0-9.]*') AS number FROM h1),
h3 AS (SELECT *, regexp_full_match(array_to_string(s[-2:], '.'), '({'|'.join(SECOND_LEVEL)})\.[a-z][a-z]') AS wide FROM h2),
h AS (SELECT host, n, bad, CASE WHEN number THEN name WHEN wide THEN array_to_string(s[-3:], '.') ELSE array_to_string(s[-2:], '.') END AS domain,
  CASE WHEN number THEN '' WHEN wide THEN array_to_string(s[-2:], '.') ELSE s[-1] END AS suffix FROM h3),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
s1 AS (SELECT *, (sum(bad) OVER () + 0.5) / (sum(n) OVER () + 1) AS prior FROM s0),
ms AS (SELECT {rho} AS m FROM s1),
s2 AS (SELECT suffix, (bad + m * prior) / (n + m) AS prior FROM s1, ms),
d1 AS (SELECT d.*, s2.prior FROM d JOIN s2 USING (suffix)),
md AS (SELECT {rho} AS m FROM d1),
d2 AS (SELECT domain, (bad + m * prior) / (n + m) AS prior FROM d1, md),
h4 AS (SELECT h.*, d2.prior FROM h JOIN d2 USING (domain)),
mh AS (SELECT {rho} AS m FROM h4),
h5 AS (SELECT host, n, bad, (bad + m * prior) / (n + m) AS mean, bad + m * prior AS a, n - bad + m * (1 - prior) AS b FROM h4, mh),
h6 AS (SELECT *, 1 - 1 / (9 * b) AS g, 1 - 1 / (9 * a) AS k FROM h5),
h7 AS (SELECT *, 9 * k * k - {y} / a AS c FROM h6),
h8 AS (SELECT *, CASE WHEN k <= 0 OR c <= 0 THEN 0 ELSE pow(c / (9 * g * k + sqrt(greatest(0, 81 * g * g * k * k - (9 * g * g - {y} / b) * c))), 3) END AS cube FROM h7),
r AS (SELECT host, n AS n_labelled, bad AS n_bad, mean, a * cube / (b + a * cube) AS bound FROM h8)
SELECT page_id, host, path, CASE {case['rule']} END AS rule, coalesce(CASE {case['verdict']} END, CASE WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
  n_labelled, CAST(n_bad AS BIGINT) AS n_bad, round(mean, 6) AS mean, round(bound, 6) AS bound FROM p JOIN r USING (host)
"""


ORACLE = _sql()
