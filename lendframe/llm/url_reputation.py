"""URL filter: listed rules first, and for all other pages an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted per host. Each level shrinks to
the one above it by a beta-binomial prior: suffix to the whole table, registered domain to
suffix, host to domain. A prior's weight comes from the spread of its groups (method of
moments). A page passes if the lower bound of its host's posterior reaches a
threshold. Hosts without outcomes inherit the posterior of their domain, suffix or
the whole. Only three numbers reach the driver.

Defined results: a url that is null or has no ``://`` has an empty host and path and is judged like
a host without outcomes. Null outcomes are left out. Without any outcome the prior mean is one half.
Repeated pages are judged one by one, and each repeated outcome counts. Of rules that fit, the longest wins. A very long url is one row like any
other. An empty table gives an empty result. Columns of the pages beside id and url are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lendframe.llm.common import stored

#: Suffixes of more than one label under which names are registered, the default of a parameter. Fixed values, from the
#: public list of such suffixes; others are the last label. Forms like ``*.ck`` and ``!www.ck`` are understood as in that list.
LONG_SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "ltd.uk", "net.uk", "org.uk", "plc.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au",
                 "ac.jp", "co.jp", "ne.jp", "or.jp", "co.nz", "govt.nz", "org.nz", "com.br", "gov.br", "org.br", "co.in", "gov.in",
                 "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "co.kr", "or.kr", "co.za", "com.mx", "com.tr", "com.ar", "com.sg",
                 "com.tw", "com.hk", "co.il", "github.io", "gitlab.io", "blogspot.com")
Z = 1.645
THRESHOLD = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    u = F.coalesce(url, F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")


def domain_levels(host: Column, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix: the longest suffix of the list that fits, else the last label, and one label more.

    ``*.x`` is every suffix of one label before ``x``; ``!a.x`` takes ``a.x`` back from it. The list is a parameter, not data.
    """
    label = F.split(F.regexp_replace(host, r":\d*$", ""), r"\.")
    n = F.size(label)

    def tail(m):
        return F.concat_ws(".", F.slice(label, F.greatest(n - m + 1, F.lit(1)), m))
    back = {s[1:] for s in suffixes if s.startswith("!")}
    wild = {s[2:] for s in suffixes if s.startswith("*.")}
    plain = {s for s in suffixes if s[:1] not in ("!", "*")}
    size = F.lit(1)
    for m in range(2, 2 + max([s.count(".") for s in suffixes], default=0)):
        size = F.when((n >= m) & (tail(m).isin(*plain) | tail(m - 1).isin(*wild)), m).otherwise(size)
    for s in back:
        size = F.when((host == s) | host.endswith("." + s), s.count(".")).otherwise(size)
    return tail(size + 1), tail(size)


def match_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct ``rule, verdict`` of the longest rule that fits, null if none does. A rule list is a parameter, not data."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        best = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def host_posteriors(outcomes: DataFrame, hosts: DataFrame, suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """``host, alpha, beta`` for every distinct host; ``outcomes``: host, good (0 or 1)."""
    seen = outcomes.filter("good is not null").groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    h = hosts.select("host").distinct().join(seen, "host", "full").na.fill(0, ["n", "k"])
    domain, suffix = domain_levels(F.col("host"), suffixes)
    h = stored(h.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "k"), "hosts")
    by_domain = stored(h.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = by_suffix.agg(F.sum("n"), F.sum("k")).first()
    mean = ((total[1] or 0) + 1.0) / ((total[0] or 0) + 2.0)

    s = stored(_posterior(by_suffix.withColumn("mu", F.lit(mean))), "suffix_posteriors")
    d = by_domain.join(s.select("suffix", F.col("mean").alias("mu")), "suffix")
    d = stored(_posterior(d), "domain_posteriors")
    return _posterior(h.join(d.select("suffix", "domain", F.col("mean").alias("mu")), ["suffix", "domain"])).select(
        "host", "alpha", "beta")


def _posterior(groups: DataFrame) -> DataFrame:
    """Beta posterior of each group around its parent mean ``mu``."""
    weight = prior_weight(groups)
    a, b = F.col("mu") * weight + F.col("k"), (1 - F.col("mu")) * weight + (F.col("n") - F.col("k"))
    return groups.withColumns({"alpha": a, "beta": b}).withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def prior_weight(groups: DataFrame) -> float:
    """Pseudo-counts of the prior from the overdispersion of n, k around mu."""
    n, k, mu = F.col("n").cast("double"), F.col("k").cast("double"), F.col("mu")
    v = mu * (1 - mu)
    r = groups.agg(F.sum((k - n * mu) * (k - n * mu) - n * v).alias("x"), F.sum(n * (n - 1) * v).alias("y")).first()
    rho = min(0.999, max(0.001, (r.x / r.y) if r.y else 0.5))
    return round((1 - rho) / rho, 9)


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id",
          url_col: str = "url", z: float = Z, threshold: float = THRESHOLD,
          suffixes: tuple[str, ...] = LONG_SUFFIXES) -> DataFrame:
    """id, ``host``, ``path``, ``rule``, ``verdict`` and the lower ``bound`` of the host's posterior, for every page."""
    p = pages.select(F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    post = host_posteriors(outcomes, p, suffixes)
    total = F.col("alpha") + F.col("beta")
    mean = F.col("alpha") / total
    bound = mean - z * F.sqrt(mean * (1 - mean) / (total + 1))
    bounds = stored(post.select("host", bound.alias("bound")), "bounds")
    j = p.withColumn("m", match_rules(F.col("host"), F.col("path"), rules)).join(bounds, "host")
    own = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return j.select(id_col, "host", "path", F.col("m.rule").alias("rule"),
                    F.coalesce(F.col("m.verdict"), own).alias("verdict"), "bound")
