"""URL filtering: explicit rules first, then an Empirical-Bayes host reputation.

Reputation: labelled page outcomes (good or not) are counted by host. A beta-binomial prior
runs down host <- registered domain <- suffix <- all pages: each level's expected rate is
its parent's posterior mean, and its prior strength comes from how much more than binomially
the children of that level differ (method of moments). A host is blocked when the upper
bound of its posterior rate of good pages, the 99 % quantile of its beta distribution, lies under
``min_good``; a host without outcomes has its domain's expectation, and so on up. Quantiles are
Wilson and Hilferty's: cube roots of the two gamma variates are taken as normal.

DataFrame operations only. Counts are aggregated before they are shuffled; the page-to-host
join is a plain equi-join, so a host with a third of all pages is split by skew handling.

Defined cases: null urls and urls without ``://`` have empty host and path and fit no rule;
they share the reputation of the empty host. Null outcomes count as none; repeated page ids
or outcomes count each time; with no outcomes at all every host has the prior 0.5 and is
allowed. Only the named columns are read, so any others may be there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.mx", "org.uk"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: prior strength limits: the share of variance between children
RHO_MIN, RHO_MAX = 0.001, 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; else empty."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    rest = F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule string, its action) of the longest fitting rule; ties to the longer host.

    ``rules``: (action, ``host/path``). A rule fits its host and all subdomains when the path
    starts with the rule's.
    """
    split = [(action, text, text.partition("/")[0], "/" + text.partition("/")[2]) for action, text in rules]
    split.sort(key=lambda r: (-len(r[1]), -len(r[2]), r[1]))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text, h, p in reversed(split):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def beta_quantile(a: Column, b: Column, z: float) -> Column:
    """Quantile of Beta(a, b) at the normal deviate ``z``; where b (or a) is too small for one, the end of the range."""
    p, q = 1 / (9 * a), 1 / (9 * b)
    spread = p * (1 - q) * (1 - q) + q * (1 - p) * (1 - p) - p * q * z * z
    below = (1 - q) * (1 - q) - q * z * z
    root = F.greatest(((1 - p) * (1 - q) + z * F.sqrt(F.greatest(spread, F.lit(0.0)))) / below, F.lit(0.0))
    ratio = root * root * root * a
    ok = (below > 0) & (q < 1) & (spread >= 0)
    return F.when(ok, ratio / (ratio + b)).otherwise(F.lit(1.0 if z > 0 else 0.0))


def _strength(children: DataFrame) -> float:
    """Prior strength of a level from (n, k, p): counts of each child, expected rate."""
    pq = F.col("p") * (1 - F.col("p"))
    x = F.col("k") / F.col("n") - F.col("p")
    r = children.where("n > 0").agg(
        F.sum(F.col("n") * x * x).alias("s"), F.sum(pq).alias("a"), F.sum(F.col("n") * pq).alias("b")
    ).first()
    if r["s"] is None or r["b"] - r["a"] <= 1e-9:
        rho = 0.1
    else:
        rho = min(max((r["s"] - r["a"]) / (r["b"] - r["a"]), RHO_MIN), RHO_MAX)
    return 1.0 / rho - 1.0


def reputation(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", z: float = 2.326) -> DataFrame:
    """(host, n, k, mean, lower, upper) of every host of ``pages``.

    ``outcomes``: (page_id, good 0/1), any number per page.
    """
    o = outcomes.select(F.col("page_id").alias("__id"), F.col("good").cast("long").alias("__good")).where("__good is not null")
    u = pages.select(F.col(id_col).alias("__id"), host_of(F.col(url_col).cast("string")).alias("host"))
    hosts = saved(
        u.join(o, "__id", "left")
        .groupBy("host")
        .agg(F.count("__good").alias("n"), F.coalesce(F.sum("__good"), F.lit(0)).alias("k"))
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("host")))
    )
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    all_n = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    m0 = (all_n["k"] + 0.5) / (all_n["n"] + 1.0)

    def expect(level: DataFrame, strength: float) -> DataFrame:
        return level.withColumn("m", (F.col("k") + strength * F.col("p")) / (F.col("n") + strength))

    suffixes = suffixes.withColumn("p", F.lit(m0))
    suffixes = expect(suffixes, _strength(suffixes))
    domains = domains.join(suffixes.select("suffix", F.col("m").alias("p")), "suffix")
    domains = expect(domains, _strength(domains))
    hosts = hosts.join(domains.select("domain", F.col("m").alias("p")), "domain")
    s = _strength(hosts)
    hosts = expect(hosts, s)
    a, b = F.col("m") * (F.col("n") + s), (1 - F.col("m")) * (F.col("n") + s)
    return hosts.select("host", "n", "k", F.col("m").alias("mean"), beta_quantile(a, b, -z).alias("lower"), beta_quantile(a, b, z).alias("upper"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
    min_good: float = 0.7, z: float = 2.326,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_outcomes, host_good, host_mean) for every page."""
    rep = reputation(pages, outcomes, id_col, url_col, z)
    url = F.col(url_col).cast("string")
    p = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumn("rule", rule).withColumn("action", action)
    by_host = F.when(F.col("upper") < min_good, F.lit("block")).otherwise(F.lit("allow"))
    return p.join(rep, "host").select(
        "page_id", "host", "path", "rule", F.coalesce("action", by_host).alias("verdict"),
        F.col("n").alias("host_outcomes"), F.col("k").alias("host_good"), F.round("mean", 6).alias("host_mean"),
    )
