"""URL filter by Empirical-Bayes host reputation, by DataFrame functions alone.

Labelled outcomes of pages are counted by host, registered domain and suffix. Each level's share of good
pages is shrunk to the level above by a beta-binomial prior whose strength is estimated from the spread
between the level's members. A host passes if the lower bound of its posterior is high enough. Rules for
hosts and paths come first.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, teaches nothing and is judged by
the overall prior; very long urls are taken whole; rules of one length that both fit cannot differ; a host without labels gets its domain's prior, and so on up; without any label at all
nothing is known to be good and all is blocked; repeated rows are judged each; extra columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.shared import meet, only, written

#: (rule, verdict); a rule is a host, with all subdomains, and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Second-level names that with a country's two letters make one suffix.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Lowest share of good pages that the bound must reach, and its distance in standard deviations (5 %).
LEAST_GOOD, Z = 0.5, 1.6448536269514722
#: Pages that a prior counts for: at least, at most.
WEAKEST, STRONGEST = 2.0, 1000.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """The last labels of the host: a suffix of one, or of two such as co.uk, and one label more."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    two = (n > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL)
    kept = F.when(two, 2).otherwise(1)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), n), ".")
    return last(kept + 1), last(kept)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, says in sorted(rules, key=lambda r: len(r[0])):  # the longest is asked first
        own, slash, start = name.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + start))
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _strength(stats: DataFrame) -> float:
    """Pages that a prior counts for, by moments: n, good and mean (of the level above) of each member."""
    pooled = stats.where("n > 0").agg(
        F.sum("n").alias("n"),
        F.count("*").alias("g"),
        F.sum(F.col("mean") * (1 - F.col("mean")) * F.col("n")).alias("v"),
        F.sum((F.col("good") - F.col("n") * F.col("mean")) * (F.col("good") - F.col("n") * F.col("mean")) / F.col("n")).alias("s"),
    )
    n, g, v, s = pooled.first()
    if not n or not v or g < 2 or n <= g:
        return WEAKEST
    rho = (s / (v / n) - g) / (n - g)  # what the spread exceeds that of independent pages by
    return STRONGEST if rho <= 1 / (STRONGEST + 1) else min(max(1 / rho - 1, WEAKEST), STRONGEST)


def reputation(outcomes: DataFrame, z: float = Z) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """From (host, good 0/1) rows: tables of host, domain and suffix with their prior or bound, and the overall bound.

    hosts: host, bound. domains and suffixes: what a member without labels gets. A few sums per level go to the driver.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    counted = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = written(counted.select("host", "n", "good", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    n, good = hosts.agg(F.sum("n"), F.sum("good")).first()
    overall = (good + 1) / (n + 2) if n else 0.5

    def shrunk(level: DataFrame) -> tuple[DataFrame, float]:
        m = _strength(level)
        return level.withColumn("own", (F.col("good") + m * F.col("mean")) / (F.col("n") + m)), m

    def bound(mean: Column, count: Column | float) -> Column:
        return mean - z * F.sqrt(mean * (1 - mean) / (count + 1))

    sums = (F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes, strong = shrunk(hosts.groupBy("suffix").agg(*sums).withColumn("mean", F.lit(overall)))
    top_bound = overall - z * (overall * (1 - overall) / (strong + 1)) ** 0.5
    means = suffixes.select("suffix", F.col("own").alias("mean"))
    domains, m = shrunk(hosts.groupBy("domain", "suffix").agg(*sums).join(means, "suffix"))
    suffix_bounds = means.select("suffix", bound(F.col("mean"), F.lit(m)).alias("suffix_bound"))
    own = domains.select("domain", F.col("own").alias("mean"))
    ranked, m = shrunk(hosts.join(own, "domain"))
    domain_bounds = own.select("domain", bound(F.col("mean"), F.lit(m)).alias("domain_bound"))
    return ranked.select("host", bound(F.col("own"), F.col("n") + m).alias("host_bound")), domain_bounds, suffix_bounds, top_bound


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, least_good: float = LEAST_GOOD) -> DataFrame:
    """id, host, path, rule, verdict for every page. outcomes: (id, good 0/1) of labelled pages."""
    host, path = host_and_path(F.col(url_col))
    urls = only(pages, id_col, url_col).select(F.col(id_col), host.alias("host"), path.alias("path"))
    labelled = only(outcomes, id_col, "good").where("good is not null").join(urls.select(id_col, "host"), id_col)
    hosts, domains, suffixes, overall = reputation(labelled.where("host != ''").select("host", "good"))
    domain, suffix = domain_and_suffix(F.col("host"))
    # every distinct host's bound once; then the pages, of which one host may have a third, meet one short row each
    named = urls.groupBy("host").agg(F.count("*").alias("m")).select("host", "m", domain.alias("domain"), suffix.alias("suffix"))
    bounds = named.join(hosts, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left")
    bounds = written(bounds.select("host", "m", F.coalesce("host_bound", "domain_bound", "suffix_bound", F.lit(overall)).alias("bound")), "bounds")
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(says, F.when(F.col("bound") >= least_good, "allow").otherwise("block"))
    return meet(urls, bounds, "host", inner=True).select(id_col, "host", "path", rule.alias("rule"), verdict.alias("verdict"))
