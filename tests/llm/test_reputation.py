"""URL reputation against plain Python on awkward pages, and its posterior bound against the beta distribution."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import reputation as R

URLS = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.ORG/es/1", "http://example.org/es/", "http://sub.example.org/en/12?x=/es/", "http://example.org/en/2", "http://notexample.org/en/1", "http://x.com/fr/1#f", "http://x.com/de/9", "http://x.com?/de/", "http://x.com#/de/", "http://u:p@shop.example.co.uk:80/a/b", "http://example.co.uk/?q", "http://10.0.0.1/x", "http://10.0.0.1:8080/y", "http://a.b.c.d./", "http://É.example.net/\n/z", "x://y://z/w", "http://localhost/", "http://" + "a." * 300 + "net/"]
COLUMNS = "page_id bigint, url string, html string, host string, row int, `a.b` string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[: next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))]
    path = rest[len(host) :]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]


def plain_rule(host, path):
    fit = [(len(h) + len(p), h + p, v) for v, h, p in R.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_levels(host):
    name = host.split("@")[-1].split(":")[0]
    name = name[:-1] if name.endswith(".") else name
    s = name.split(".")
    if not name.strip("0123456789."):
        return name, ""
    k = 2 if len(s) > 1 and s[-2] in R.SECOND_LEVEL and len(s[-1]) == 2 and s[-1].isascii() and s[-1].isalpha() else 1
    return ".".join(s[-k - 1 :]), ".".join(s[-k:])


def plain_strength(nodes):
    num = sum((b - n * m) ** 2 - n * m * (1 - m) for n, b, m in nodes if n > 1)
    den = sum(n * (n - 1) * m * (1 - m) for n, b, m in nodes if n > 1)
    return 1 / min(max(num / den, 1 / (1 + R.MAX_STRENGTH)), 1 / (1 + R.MIN_STRENGTH)) - 1 if den else R.DEFAULT_STRENGTH


def plain(pages, bad):
    hosts = {}
    for i, url in pages:
        c = hosts.setdefault(plain_parts(url)[0], [0, 0])
        if i is not None and i in bad:
            c[0] += 1
            c[1] += bad[i]
    above = {h: plain_levels(h) for h in hosts}
    domains, suffixes = {}, {}
    for h, (n, b) in hosts.items():
        for table, key in ((domains, above[h]), (suffixes, above[h][1])):
            c = table.setdefault(key, [0, 0])
            c[0] += n
            c[1] += b
    root = (sum(b for _, b in hosts.values()) + 0.5) / (sum(n for n, _ in hosts.values()) + 1)
    m = plain_strength([(n, b, root) for n, b in suffixes.values()])
    s = {k: (b + m * root) / (n + m) for k, (n, b) in suffixes.items()}
    m = plain_strength([(n, b, s[k[1]]) for k, (n, b) in domains.items()])
    d = {k: (b + m * s[k[1]]) / (n + m) for k, (n, b) in domains.items()}
    m = plain_strength([(n, b, d[above[h]]) for h, (n, b) in hosts.items()])
    return {h: (n, b, (b + m * d[above[h]]) / (n + m), b + m * d[above[h]], n - b + m * (1 - d[above[h]])) for h, (n, b) in hosts.items()}


def tail(a, b, x):
    """The probability below x of Beta(a, b), by adding up its density over the logit."""
    t = np.linspace(-60, 60, 400_001)
    log = a * -np.logaddexp(0, -t) + b * -np.logaddexp(0, t)
    w = np.exp(log - log.max())
    return w[t <= math.log(x / (1 - x))].sum() / w.sum()


@pytest.fixture(scope="module")
def table():
    rng = random.Random(5)
    urls = URLS + [f"http://{rng.choice(['bad', 'good', 'www', 'm'])}.site{rng.randint(0, 5)}.{rng.choice(['net', 'info', 'co.uk'])}/en/{i}" for i in range(400)] + [f"http://bad.farm.info/{i}" for i in range(60)]
    pages = [(i if i % 41 else None, u) for i, u in enumerate(urls)]
    labels = [(i, rng.randint(0, 1) if "good" not in (u or "") else 1, None if i % 3 else int("bad" in (u or "") and rng.random() < 0.97)) for i, u in enumerate(urls) if rng.random() < 0.8]
    labels += [(7, None, None), (8, 1, 1), (8, 1, 0), (None, 0, 1), (9999, 0, 1)]
    return [*pages, pages[30], pages[30]], labels


def frames(spark, table):
    pages, labels = table
    p = spark.createDataFrame([(i, u, "x" * 10, "clash", 1, "c") for i, u in pages], COLUMNS).repartition(3)
    return p, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_pages_against_plain_python(spark, table):
    pages, labels = frames(spark, table)
    bad = {}
    for i, q, t in table[1]:
        if i is not None and (q, t) != (None, None):
            bad[i] = max(bad.get(i, 0), int(q == 0 or t == 1))
    want = plain(table[0], bad)
    got = R.verdicts(pages, R.outcomes(labels)).collect()
    rows = []
    for r in got:
        n, b, mean, alpha, beta = want[r["host"]]
        assert (r["n_labelled"], r["n_bad"]) == (n, b) and abs(r["mean"] - mean) < 1e-9
        if r["bound"] > 1e-6 and alpha + beta > 6 and min(alpha, beta) > 1:
            assert abs(tail(alpha, beta, r["bound"]) - 0.05) < 0.006, (alpha, beta, r["bound"])
        rows.append((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]))
    bound = {r["host"]: r["bound"] for r in got}
    expected = []
    for i, u in table[0]:
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        expected.append((i, host, path, rule, verdict or ("block" if bound[host] > R.LIMIT else "allow")))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(rows, key=key) == sorted(expected, key=key)
    assert bound["bad.farm.info"] > R.LIMIT and all(b <= R.LIMIT for h, b in bound.items() if h.startswith("good"))


def test_allowed_pages_keep_their_columns(spark, table):
    pages, labels = frames(spark, table)
    kept = R.filtered(pages, R.outcomes(labels))
    allowed = R.verdicts(pages, R.outcomes(labels)).where("verdict = 'allow'")
    assert kept.columns == pages.columns and kept.count() == allowed.count() < pages.count()
    assert not kept.where("url LIKE '%bad.farm.info%'").count()


def test_no_labels_and_no_pages(spark, table):
    pages, labels = frames(spark, table)
    got = R.verdicts(pages, R.outcomes(labels.limit(0))).select("mean", "n_labelled").distinct().collect()
    assert [tuple(r) for r in got] == [(0.5, 0)]
    assert R.verdicts(pages.limit(0), R.outcomes(labels)).count() == 0
    with pytest.raises(ValueError):
        R.ruled(F.lit("a"), F.lit("/"), [("block", f"h{i}", "/") for i in range(R.MAX_RULES + 1)])


def test_bound_is_a_quantile(spark):
    cases = [(a, b) for a in (1.5, 4.0, 30.0, 400.0, 9000.0) for b in (2.0, 5.0, 60.0, 3000.0) if a + b > 6]
    got = spark.createDataFrame(cases, "a double, b double").select("a", "b", R.lower_bound(F.col("a"), F.col("b")).alias("x")).collect()
    for a, b, x in got:
        assert abs(tail(a, b, x) - 0.05) < 0.006, (a, b, x)
    few = spark.createDataFrame([(0.01, 6.0), (0.1, 900.0)], "a double, b double").select(R.lower_bound(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in few] == [0.0, 0.0]


def test_plan_has_no_python_and_deals_out_only_rare_hosts(spark, table):
    pages, labels = frames(spark, table)
    plan = R.verdicts(pages, R.outcomes(labels))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
