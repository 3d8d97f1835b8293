"""URL filters: rules first, then the reputation of the host.

A host's reputation is the posterior of a beta-binomial model whose prior is
shrunk from its suffix to its registered domain to the host itself, with
concentrations estimated from the data. All of it is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): a host and a path from its first slash.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Bounds of a prior's weight, in pages.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 500.0
#: A page counts as a bad outcome if its HTML has this many runs of stray marks.
STRAY = r"###|%%%|&&&|\$\$\$|\*\*\*|!! "
STRAY_RUNS = 5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: Suffixes of several labels under which unrelated sites register.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "me.uk", "com.au", "net.au", "org.au", "edu.au", "co.nz", "org.nz", "co.jp", "ne.jp", "or.jp", "ac.jp", "co.kr", "or.kr", "com.br", "net.br", "org.br",
    "com.cn", "net.cn", "org.cn", "com.tw", "com.hk", "com.sg", "co.in", "co.za", "com.mx", "com.ar", "com.tr", "co.il", "com.ua", "github.io", "gitlab.io", "blogspot.com", "wordpress.com", "herokuapp.com", "netlify.app", "vercel.app",
)
_SUFFIX = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
_ADDRESS = r"^(\[.*|[0-9]{1,3}(\.[0-9]{1,3}){3})$"


def bare_of(host: Column) -> Column:
    """A host without user, port and final dots."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?\.*$", "")


def suffix_of(host: Column) -> Column:
    """What a site is registered under; an address (IPv4, IPv6) stands for itself."""
    bare = bare_of(host)
    return F.when(bare.rlike(_ADDRESS), bare).otherwise(F.regexp_extract(bare, rf"(?:^|\.)({_SUFFIX}|[^.]*)$", 1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label before it, if there is one."""
    bare = bare_of(host)
    found = F.regexp_extract(bare, rf"([^.]+\.(?:{_SUFFIX}|[^.]*))$", 1)
    return F.when(bare.rlike(_ADDRESS) | (found == ""), bare).otherwise(found)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls.

    Meant for a list of up to some hundred rules: each is one condition.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, _, rest = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _spread(units: DataFrame) -> DataFrame:
    """One row: the prior's weight that explains how units (n, good) differ.

    The method of moments for beta-binomial counts; identical units give the
    most weight to the prior.
    """
    s = units.agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.count(F.lit(1)).alias("j"),
        F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("gg"),
    )
    p = F.col("good") / F.col("n")
    chance = p * (1 - p)
    between = F.col("gg") - F.col("good") * p
    free = F.col("n") - F.col("nn") / F.col("n") - (F.col("j") - 1)
    tied = F.when((chance > 0) & (free > 0), (between - chance * (F.col("j") - 1)) / (chance * free))
    weight = F.when(tied > 0, 1 / tied - 1).otherwise(F.lit(MOST_WEIGHT))
    return s.select(p.alias("mean"), F.least(F.greatest(F.coalesce(weight, F.lit(MOST_WEIGHT)), F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT)).alias("weight"))


def reputations(outcomes: DataFrame, deviations: float = 1.2816) -> DataFrame:
    """host and bound: the lower bound of each host's chance of a good page.

    ``outcomes``: host and good (0/1, null: not labelled). One row a host; hot
    hosts shrink by partial aggregation.
    """
    hosts = outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("good"))
    hosts = hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "good")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    # one row each: what the data say of the spread among suffixes, domains and hosts
    spreads = [_spread(u.where("n > 0")).select(F.struct("mean", "weight").alias(f"of_{k}")) for k, u in (("suffix", suffixes), ("domain", domains), ("host", hosts))]
    one = F.lit(1)
    known = spreads[0].withColumn("one", one)
    for s in spreads[1:]:
        known = known.join(s.withColumn("one", one), "one")
    mean = F.coalesce(F.col("of_suffix.mean"), F.lit(0.5))
    suffixes = suffixes.withColumn("one", one).join(known, "one").select(
        "suffix", ((F.col("good") + F.col("of_suffix.weight") * mean) / (F.col("n") + F.col("of_suffix.weight"))).alias("suffix_mean"),
        F.col("of_domain.weight").alias("domain_weight"), F.col("of_host.weight").alias("host_weight"),
    )
    domains = domains.join(suffixes, "suffix").select(
        "domain", "host_weight",
        ((F.col("good") + F.col("domain_weight") * F.col("suffix_mean")) / (F.col("n") + F.col("domain_weight"))).alias("domain_mean"),
    )
    total = F.col("n") + F.col("host_weight")
    post = (F.col("good") + F.col("host_weight") * F.col("domain_mean")) / total
    return hosts.join(domains, "domain").select("host", (post - deviations * F.sqrt(post * (1 - post) / (total + 1))).alias("bound"))


def judge(pages: DataFrame, good: Column, threshold: float = 0.5, deviations: float = 1.2816, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages``.

    ``good``: the labelled outcome of a page (0/1, null where there is none).
    Where no rule fits, a page is blocked if the lower bound of its host's
    posterior lies under ``threshold``. A null url and one without ``://`` have
    an empty host and path; the empty host has a reputation like any other.
    Repeated rows are judged alike; an empty table gives an empty result; other
    columns are ignored. Host reputations are joined by host; adaptive
    execution splits a host that holds many pages.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), good.alias("good"))
    known = reputations(split.select("host", "good"), deviations)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") < threshold, F.lit("block")).otherwise(F.lit("allow"))
    return split.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def plain_outcome(html: Column) -> Column:
    """Outcome of a page by its content: 0 with many runs of stray marks; null without HTML."""
    runs = F.regexp_count(html, F.lit(STRAY))
    return F.when(F.length(html) > 0, (runs < STRAY_RUNS).cast("int"))


SQL = rf"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         CASE WHEN length(html) > 0 THEN (len(regexp_extract_all(html, '###|%%%|&&&|\$\$\$|\*\*\*|!! ')) < 5)::INT END AS good
  FROM pages
), hosts AS (
  SELECT host, CASE WHEN regexp_matches(bare, '{_ADDRESS}') OR NOT contains(bare, '.') THEN bare ELSE regexp_extract(bare, '([^.]+\.(?:{_SUFFIX}|[^.]*))$', 1) END AS domain,
         CASE WHEN regexp_matches(bare, '{_ADDRESS}') THEN bare ELSE regexp_extract(bare, '(?:^|\.)({_SUFFIX}|[^.]*)$', 1) END AS suffix,
         count(good) AS n, coalesce(sum(good), 0)::BIGINT AS good
  FROM (SELECT host, good, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\.*$', '') AS bare FROM split) GROUP BY host, bare
), domains AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(good)::BIGINT AS good FROM domains GROUP BY ALL
), units AS (
  SELECT 's' AS kind, n, good FROM suffixes WHERE n > 0 UNION ALL SELECT 'd', n, good FROM domains WHERE n > 0
  UNION ALL SELECT 'h', n, good FROM hosts WHERE n > 0
), sums AS (
  SELECT kind, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good, count(*)::DOUBLE AS j, sum(n * n)::DOUBLE AS nn, sum(good * good / n::DOUBLE) AS gg FROM units GROUP BY kind
), parts AS (
  SELECT kind, good / n AS p, (good / n) * (1 - good / n) AS chance, gg - good * (good / n) AS between_units, n - nn / n - (j - 1) AS free, j FROM sums
), ties AS (
  SELECT kind, p, CASE WHEN chance > 0 AND free > 0 THEN (between_units - chance * (j - 1)) / (chance * free) END AS tied FROM parts
), spreads AS (
  SELECT kind, p, least(greatest(CASE WHEN tied > 0 THEN 1 / tied - 1 ELSE 500.0 END, 2.0), 500.0) AS weight FROM ties
), k AS (
  SELECT coalesce(max(p) FILTER (kind = 's'), 0.5) AS mean, coalesce(max(weight) FILTER (kind = 's'), 500.0) AS ws,
         coalesce(max(weight) FILTER (kind = 'd'), 500.0) AS wd, coalesce(max(weight) FILTER (kind = 'h'), 500.0) AS wh FROM spreads
), posts AS (
  SELECT h.host, h.n + k.wh AS total,
         (h.good + k.wh * ((d.good + k.wd * ((s.good + k.ws * k.mean) / (s.n + k.ws))) / (d.n + k.wd))) / (h.n + k.wh) AS post
  FROM hosts h JOIN domains d ON h.domain = d.domain JOIN suffixes s ON d.suffix = s.suffix, k
), ruled AS (
  SELECT s.page_id, s.host, s.path, p.post - 1.2816 * sqrt(p.post * (1 - p.post) / (p.total + 1)) AS bound,
         CASE WHEN (s.host = 'example.net' OR s.host LIKE '%.example.net') AND starts_with(s.path, '/en/') THEN 'example.net/en/'
              WHEN (s.host = 'example.com' OR s.host LIKE '%.example.com') AND starts_with(s.path, '/de/') THEN 'example.com/de/'
              WHEN (s.host = 'org' OR s.host LIKE '%.org') AND starts_with(s.path, '/fr/') THEN 'org/fr/'
              WHEN (s.host = 'net' OR s.host LIKE '%.net') AND starts_with(s.path, '/') THEN 'net/' END AS rule
  FROM split s LEFT JOIN posts p ON s.host = p.host
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN bound < 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
