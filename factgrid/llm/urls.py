"""URL filter: rules by host and path, and empirical-Bayes reputation of hosts. DataFrame functions only.

A host's share of good outcomes has a beta prior whose mean is its registered domain's posterior mean; the domain's prior
comes from the suffix in the same way, and the suffix's from all outcomes. The strength of each prior is estimated from how
much the children of a level differ from their parents: with n_i outcomes, share p_i and the parent's mean m, the expected sum
of n_i (p_i - m)^2 / (m (1 - m)) over k children with N outcomes is k + rho (N - k), and the strength is 1 / rho - 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "co.in", "com.br", "com.cn", "com.mx", "com.tr", "co.za", "co.kr")
MOST_RULES = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """Parameters: the least posterior bound, how many standard deviations it lies below the mean, and the range of rho."""

    least_bound: float = 0.5
    deviations: float = 1.645
    least_rho: float = 0.001
    most_rho: float = 0.5
    usual_rho: float = 0.1  # where no child has two outcomes


def host_of(url: str) -> Column:
    """After the first :// up to / ? # or the end, ASCII letters lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "://[^/?#]*([^?#]*)", 1)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column) -> Column:
    """The suffix with one more label; a host of no more labels than its suffix is its own domain."""
    labels = F.size(F.split(suffix, "[.]")) + 1
    parts = F.split(host, "[.]")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), ".")


def with_domains(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """hosts (one row each) with suffix and domain. suffixes: a table of names (`suffix`, lower case) under which domains are
    registered; of those that a host ends with the longest counts, without any the last label. Without a table, the fixed
    two-label suffixes and last labels."""
    if suffixes is None:
        found = hosts.withColumn("suffix", suffix_of(F.col("host")))
    else:
        parts = F.split("host", "[.]")
        ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        known = hosts.select("host", F.explode(ends).alias("suffix")).join(suffixes.select("suffix").distinct(), "suffix", "left_semi")
        longest = known.groupBy("host").agg(F.max_by("suffix", F.length("suffix")).alias("suffix"))
        found = hosts.join(longest, "host", "left").withColumn("suffix", F.coalesce("suffix", F.substring_index("host", ".", -1)))
    return found.withColumn("domain", domain_of(F.col("host"), F.col("suffix")))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, of equally long ones that with the longer host; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    ordered = sorted(rules, key=lambda r: (-len(r.text), -len(r.host), r.text))
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    return F.coalesce(*[F.when(fits(r), F.lit(r.text)) for r in ordered], F.lit(None).cast("string"))


def _strength(children: DataFrame, parent_mean: str, how: Reputation) -> float:
    """1 / rho - 1 from the children's n, good and their parent's mean; one row comes to the driver."""
    seen = children.where("n > 0")
    m, p = F.col(parent_mean), F.col("good") / F.col("n")
    s, k, n = seen.agg(F.sum(F.col("n") * (p - m) * (p - m) / (m * (1 - m))), F.count(F.lit(1)), F.sum("n")).first()
    rho = (s - k) / (n - k) if n and n > k else how.usual_rho
    rho = min(max(rho, how.least_rho), how.most_rho)
    return 1 / rho - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, url: str = "url", key: str = "page_id", how: Reputation = Reputation(), suffixes: DataFrame | None = None) -> DataFrame:
    """A row for each host of pages: host, n and good outcomes, the posterior's alpha and beta, and its bound.

    outcomes: rows of the key and `good` (0 or 1), each one outcome of the page, however often pages has that page; null good
    counts as none. A host without outcomes has its prior. Without any outcomes the mean of all is 1/2. The counts of the
    hosts are written once, to the shared folder.
    """
    judged = pages.select(F.col(key).alias("key"), host_of(url).alias("host")).distinct().join(outcomes.select(F.col(key).alias("key"), F.col("good").cast("long").alias("good")), "key", "left")
    hosts = judged.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    hosts = stored(with_domains(hosts, suffixes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    n, good = suffixes.agg(F.sum("n"), F.sum("good")).first()
    mean = ((good or 0) + 1) / ((n or 0) + 2)

    def posterior(rows: DataFrame, strength: float) -> DataFrame:
        k = F.lit(strength)
        return rows.withColumns({"alpha": k * F.col("prior") + F.col("good"), "beta": k * (1 - F.col("prior")) + F.col("n") - F.col("good")}).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))

    suffixes = suffixes.withColumn("prior", F.lit(mean))
    suffixes = posterior(suffixes, _strength(suffixes, "prior", how))
    domains = domains.join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix")
    domains = posterior(domains, _strength(domains, "prior", how))
    hosts = hosts.join(domains.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"])
    hosts = posterior(hosts, _strength(hosts, "prior", how))
    a, b = F.col("alpha"), F.col("beta")
    deviation = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return hosts.select("host", "n", "good", "alpha", "beta", (F.col("mean") - how.deviations * deviation).alias("bound"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], url: str = "url", key: str = "page_id", how: Reputation = Reputation(), suffixes: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), and n_outcomes, n_good and bound of the host.

    The longest fitting rule decides; else the host's posterior bound, block below least_bound. A null url, or one without
    ://, has an empty host and path, fits no rule and is judged as the host ''. Columns with the names of new ones are
    replaced; repeated rows are judged alike.
    """
    new = {"host", "path", "rule", "verdict", "n_outcomes", "n_good", "bound"}
    kept = [c for c in pages.columns if c.lower() not in new]
    source = pages.select(*[F.col(f"`{c}`") for c in {*kept, url, key}])
    reputation = host_reputation(source, outcomes, url, key, how, suffixes).select(F.col("host").alias("__host"), F.col("n").alias("n_outcomes"), F.col("good").alias("n_good"), "bound")
    split = source.withColumns({"__host": host_of(url), "__path": path_of(url)})
    joined = split.join(reputation, "__host", "left").withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("__rule") == r.text, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))
    verdict = F.coalesce(by_rule, F.when(F.col("bound") >= how.least_bound, "allow").otherwise("block"))
    return joined.select(*[F.col(f"`{c}`") for c in kept], F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), verdict.alias("verdict"), "n_outcomes", "n_good", "bound")


#: The rules of the query, as fixed by its contract.
RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"), Rule("block", "net", "/es/"), Rule("block", "net", "/fr/")]

_POSTERIOR = """{k} * prior + good AS alpha, {k} * (1 - prior) + n - good AS beta"""
_STRENGTH = """(SELECT 1 / least(greatest(CASE WHEN sum(n) > count(*) THEN (sum(n * (good / n - prior) * (good / n - prior) / (prior * (1 - prior))) - count(*)) / (sum(n) - count(*)) ELSE 0.1 END, 0.001), 0.5) - 1 AS k FROM {t} WHERE n > 0)"""
_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
ORACLE = f"""
WITH split AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS (SELECT host, CASE WHEN quality = 1 AND toxic = 0 THEN 1 WHEN quality IS NOT NULL THEN 0 END AS good FROM (SELECT DISTINCT page_id, host FROM split) LEFT JOIN labels ON page_id = doc_id),
labelled AS (SELECT host, count(good) AS n, coalesce(sum(good), 0) AS good, array_to_string(list_reverse(list_reverse(string_split(host, '.'))[:2]), '.') AS two,
         array_to_string(list_reverse(list_reverse(string_split(host, '.'))[:3]), '.') AS three, string_split(host, '.')[-1] AS one FROM judged GROUP BY host),
hosts AS (SELECT host, n, good, CASE WHEN two IN ({_TWO}) THEN three ELSE two END AS domain, CASE WHEN two IN ({_TWO}) THEN two ELSE one END AS suffix FROM labelled),
domains0 AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY domain, suffix),
suffixes0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM domains0 GROUP BY suffix),
suffixes1 AS (SELECT *, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM suffixes0) AS prior FROM suffixes0),
suffixes AS (SELECT suffix, alpha / (alpha + beta) AS mean FROM (SELECT suffix, {_POSTERIOR.format(k=_STRENGTH.format(t="suffixes1"))} FROM suffixes1)),
domains1 AS (SELECT domain, d.suffix, n, good, mean AS prior FROM domains0 d JOIN suffixes s ON d.suffix = s.suffix),
domains AS (SELECT domain, suffix, alpha / (alpha + beta) AS mean FROM (SELECT domain, suffix, {_POSTERIOR.format(k=_STRENGTH.format(t="domains1"))} FROM domains1)),
hosts1 AS (SELECT host, n, good, mean AS prior FROM hosts h JOIN domains d ON h.domain = d.domain AND h.suffix = d.suffix),
hosts2 AS (SELECT host, n, good, {_POSTERIOR.format(k=_STRENGTH.format(t="hosts1"))} FROM hosts1),
known AS (SELECT host, n, good, alpha / (alpha + beta) - 1.645 * sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))) AS bound FROM hosts2),
ruled AS (
  SELECT s.*, CASE
    WHEN (s.host = 'www.example.com' OR ends_with(s.host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (s.host = 'example.com' OR ends_with(s.host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (s.host = 'net' OR ends_with(s.host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (s.host = 'net' OR ends_with(s.host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (s.host = 'com' OR ends_with(s.host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM split s)
SELECT page_id, r.host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict,
  CAST(n AS BIGINT) AS n_outcomes, CAST(good AS BIGINT) AS n_good
FROM ruled r LEFT JOIN known k ON r.host = k.host
"""
