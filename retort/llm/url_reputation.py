"""URL filters: address rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted by host, and hosts roll up to registered domains and these to suffixes.
Each level is a beta-binomial: a group's bad rate is shrunk towards the posterior mean of the level above, with a strength
that the data give (moments of the groups' rates), at most MOST pages, so that a host with more labelled pages than that
always tells more than its neighbours. A host is blocked if its bad rate is over the limit with the given credibility: the
lower quantile of its posterior is the bound. The limit is the bad rate of all labelled pages unless one is given. Few bad
pages of many don't block, and a host without labels has its domain's rate. All levels are sums over one row a host, so a
host with a third of all pages costs one row a task in each shuffle. Verdicts and the levels above are joined by broadcast up to
a checked number of rows; beyond it, pages of one host, hosts of one domain and domains of one suffix are dealt to parts, as
hosts that show one labelled document are. Pages without a number or label add their host, but take no part in that join.

The quantile is that of a normal for the log-odds, with the beta's exact mean and variance of log-odds (digamma and trigamma
by their series), which built-in functions can express.

A rule is a host and a path; it fits that host and all its subdomains if the page's path starts with the rule's, and the
longest fitting rule decides. Suffixes are the last label unless given in suffixes (such as co.uk).

Defined cases: a null url, or one without ://, has empty host and path, and no rule fits it; its reputation is that of the
empty host. Pages without a label count for nothing but are judged. Without any labelled page no host is blocked. Repeated
rows count as often as they come and are each judged; null page_ids are kept; an url of any length is read whole; other
columns, also such as are named like results, are ignored; an empty table of pages gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retort.llm.common import ascii_lower, cut, spread_join

#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Most pages that the level above is worth; how sure it must be that a host is over the limit.
MOST, CREDIBLE = 50.0, 0.8
#: Fixed value: the standard normal's quantile at CREDIBLE.
Z = 0.8416212335729143
#: Hosts up to which their verdicts are broadcast.
MAX_HOSTS = 100_000


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    return ascii_lower(F.regexp_extract(u, "://([^/?#]*)", 1)), F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1)


def page_number(path: str = "path") -> Column:
    """The document that an address numbers: the digits that end its path, before an ending such as .html or /."""
    digits = F.regexp_extract(path, r"/([0-9]{1,18})(\.[a-z]+)?/?$", 1)
    return F.when(digits != "", digits.cast("long"))


def rule_columns(rules: tuple[tuple[str, str, str], ...], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit(f".{h}"))) & F.startswith(F.col(path), F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, mean: str) -> Column:
    """As an aggregate: how many pages the level above is worth, from the spread of the groups' rates beyond chance."""
    n, p, m = F.col("n").cast("double"), F.col("bad") / F.col("n"), F.col(mean)
    some = F.col("n") > 0
    chance = F.avg(F.when(some, m * (1 - m)))
    spread = F.sum(F.when(some, n * (p - m) * (p - m)))
    pages = F.sum(F.when(some, n)) - F.sum(F.when(some, n * n)) / F.sum(F.when(some, n))
    between = (spread - (F.count(F.when(some, n)) - 1) * chance) / pages
    worth = F.when((pages > 0) & (between > 0), chance / between - 1)
    return F.least(F.greatest(F.coalesce(worth, F.lit(MOST)), F.lit(2.0)), F.lit(MOST))


def _moments(x: Column) -> tuple[Column, Column]:
    """Digamma and trigamma: two steps of their recurrence, then the series."""
    y = x + 2
    psi = F.log(y) - 1 / (2 * y) - 1 / (12 * y * y) - 1 / x - 1 / (x + 1)
    return psi, 1 / y + 1 / (2 * y * y) + 1 / (6 * y * y * y) + 1 / (x * x) + 1 / ((x + 1) * (x + 1))


def _shrunk(groups: DataFrame, mean: str) -> DataFrame:
    """groups (n, bad, mean of the level above) with a and b of their beta posterior and rate, its mean."""
    strength = cut(groups.agg(_strength(groups, mean).alias("strength")))  # one row
    out = groups.crossJoin(F.broadcast(strength))
    out = out.withColumn("a", F.col("bad") + F.col("strength") * F.col(mean)).withColumn("b", F.col("n") - F.col("bad") + F.col("strength") * (1 - F.col(mean)))
    return out.withColumn("rate", F.col("a") / (F.col("a") + F.col("b"))).drop("strength")


def _with_level(rows: DataFrame, level: DataFrame, key: str, by: str, max_groups: int) -> DataFrame:
    """rows with the columns of the level above (cut beforehand): a broadcast up to max_groups, else a join that deals the rows
    of one key to parts, as one domain may have millions of hosts."""
    return rows.join(F.broadcast(level), key) if level.count() <= max_groups else spread_join(rows, level, key, by)


def reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = (), z: float = Z, max_groups: int = MAX_HOSTS) -> DataFrame:
    """outcomes: host, n and bad (0 or 1, or sums). Returns host, n, bad, a, b, rate, bound, all_rate."""
    hosts = outcomes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = F.substring_index("host", ".", -1)
    for s in sorted(suffixes, key=len):
        suffix = F.when((F.col("host") == s) | F.endswith(F.col("host"), F.lit(f".{s}")), s).otherwise(suffix)
    head = F.expr("left(host, greatest(length(host) - length(suffix) - 1, 0))")
    hosts = hosts.withColumn("suffix", suffix).withColumn("domain", F.concat_ws(".", F.when(head != "", F.substring_index(head, ".", -1)), "suffix"))
    hosts = cut(hosts)
    domains = cut(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    ends = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = cut(ends.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("all_rate")))
    ends = cut(_shrunk(cut(ends.crossJoin(F.broadcast(whole))), "all_rate")).select("suffix", F.col("rate").alias("suffix_rate"))
    domains = cut(_shrunk(cut(_with_level(domains, ends, "suffix", "domain", max_groups)), "suffix_rate")).select("domain", F.col("rate").alias("domain_rate"))
    hosts = _shrunk(cut(_with_level(hosts, domains, "domain", "host", max_groups)), "domain_rate")
    (ma, va), (mb, vb) = _moments(F.col("a")), _moments(F.col("b"))
    bound = 1 / (1 + F.exp(-(ma - mb - z * F.sqrt(va + vb))))
    return hosts.select("host", "n", "bad", "a", "b", "rate", bound.alias("bound")).crossJoin(F.broadcast(whole))  # one row


def filtered(pages: DataFrame, labels: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, limit: float | None = None, max_hosts: int = MAX_HOSTS) -> DataFrame:
    """page_id, host, path, rule, verdict of each page. labels: doc_id, quality, toxic; a page is bad if the document that
    its address numbers has quality 0 or is toxic."""
    host, path = host_and_path()
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"), F.lit(0))).alias("bad"))
    # one row a host and document before the join with labels
    counted = seen.withColumn("doc_id", page_number()).groupBy("host", "doc_id").agg(F.count("*").alias("pages"))
    # pages without a number or label add their host alone, so they take no part in the join
    known = spread_join(counted.where("doc_id is not null"), bad, "doc_id", "host").select("host", F.col("pages").alias("n"), (F.col("bad") * F.col("pages")).alias("bad"))
    outcomes = known.unionByName(seen.select("host", F.lit(0).alias("n"), F.lit(0).alias("bad")))
    over = F.col("all_rate") if limit is None else F.lit(limit)
    hosts = cut(reputation(outcomes).select("host", (F.col("bound") > over).alias("blocked")))
    if hosts.count() <= max_hosts:
        out = seen.join(F.broadcast(hosts), "host")
    else:  # each page's host has a row in hosts
        out = spread_join(seen.withColumn("_by", F.xxhash64("page_id", "path")), hosts, "host", "_by")
    rule, verdict = rule_columns(rules)
    named = F.when(F.col("blocked"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, named).alias("verdict"))


def _shrink_sql(name: str, source: str, keep: str, mean: str) -> str:
    some = "CASE WHEN n > 0 THEN {} END"
    m = mean
    return f"""
    {name}0 AS (SELECT CASE WHEN sum({some.format("1.0::DOUBLE * n")}) - sum({some.format("1.0::DOUBLE * n * n")}) / sum({some.format("1.0::DOUBLE * n")}) > 0 THEN
        (sum({some.format(f"n * (bad / n::DOUBLE - {m}) * (bad / n::DOUBLE - {m})")}) - (count({some.format("1")}) - 1) * avg({some.format(f"{m} * (1 - {m})")}))
        / (sum({some.format("1.0::DOUBLE * n")}) - sum({some.format("1.0::DOUBLE * n * n")}) / sum({some.format("1.0::DOUBLE * n")})) END AS between_, avg({some.format(f"{m} * (1 - {m})")}) AS chance FROM {source}),
    {name}1 AS (SELECT least(greatest(coalesce(CASE WHEN between_ > 0 THEN chance / between_ - 1 END, {MOST}::DOUBLE), 2.0::DOUBLE), {MOST}::DOUBLE) AS worth FROM {name}0),
    {name}2 AS (SELECT {keep}, bad + worth * {m} AS a, n - bad + worth * (1 - {m}) AS b FROM {source}, {name}1)"""


def _sql() -> str:
    psi = "ln({0} + 2) - 1 / (2 * ({0} + 2)) - 1 / (12 * ({0} + 2) * ({0} + 2)) - 1 / {0} - 1 / ({0} + 1)".format
    psi1 = "1 / ({0} + 2) + 1 / (2 * ({0} + 2) * ({0} + 2)) + 1 / (6 * ({0} + 2) * ({0} + 2) * ({0} + 2)) + 1 / ({0} * {0}) + 1 / (({0} + 1) * ({0} + 1))".format
    fit = "WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{v}'"
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    rule = "CASE " + " ".join(fit.format(h=h, p=p, v=h + p) for _, h, p in ordered) + " END"
    word = "CASE " + " ".join(fit.format(h=h, p=p, v=v) for v, h, p in ordered) + f" ELSE CASE WHEN bound > (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM es) THEN 'block' ELSE 'allow' END END"
    return f"""
    WITH seen AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    bad AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
    num AS (SELECT host, TRY_CAST(regexp_extract(path, '/([0-9]{{1,18}})(\\.[a-z]+)?/?$', 1) AS BIGINT) AS doc_id FROM seen),
    hs AS (SELECT host, CAST(count(bad) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad FROM num LEFT JOIN bad USING (doc_id) GROUP BY host),
    h1 AS (SELECT *, list_last(string_split(host, '.')) AS suffix, CASE WHEN contains(host, '.') THEN list_last(string_split(left(host, length(host) - length(list_last(string_split(host, '.'))) - 1), '.')) || '.' ELSE '' END || list_last(string_split(host, '.')) AS domain FROM hs),
    ds AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM h1 GROUP BY domain),
    es AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM ds GROUP BY suffix),
    es1 AS (SELECT *, (SELECT (sum(bad) + 1) / (sum(n) + 2) FROM es) AS all_rate FROM es),
    {_shrink_sql("e", "es1", "suffix", "all_rate")},
    ds1 AS (SELECT ds.*, a / (a + b) AS suffix_rate FROM ds JOIN e2 USING (suffix)),
    {_shrink_sql("d", "ds1", "domain", "suffix_rate")},
    hs1 AS (SELECT h1.*, a / (a + b) AS domain_rate FROM h1 JOIN d2 USING (domain)),
    {_shrink_sql("k", "hs1", "host", "domain_rate")},
    bounds AS (SELECT host, 1 / (1 + exp(-({psi("a")} - ({psi("b")}) - {Z} * sqrt({psi1("a")} + {psi1("b")})))) AS bound FROM k2)
    SELECT page_id, host, path, {rule} AS rule, {word} AS verdict FROM seen JOIN bounds USING (host)
    """


SQL = _sql()
