"""URL filters: rules first, then the reputation of the host by empirical Bayes, in DataFrame operations only.

Pages that a rule decides are labelled outcomes (block = 1, allow = 0). Outcomes are counted by host, registered domain and
suffix: the suffix is the host's last label, or its last two where a country's label follows one of ``SECOND_LEVEL``; the
domain has one label more. Each level's rate is shrunk towards its parent through a beta prior:
parent mean m and strength s give a child with k of n blocked the posterior Beta(m s + k, (1 - m) s + n - k), whose mean is
the child's own children's prior mean. A level's strength is estimated by moments from the spread of its units' rates
(beta-binomial: the between-unit variance that is left after binomial noise). A page without a rule is blocked when the
lower posterior bound of its host's block rate reaches the threshold.

Everything is aggregated by host before any shuffle of pages; the joins of domains with suffixes, of hosts with domains and
of pages with host verdicts go through ``lookup``, which broadcasts the few hot keys (proven bound) and shuffles the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, hidden, lookup


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, where the path starts with ``path``; allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
)


#: Labels under which countries register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "gv", "mil", "ne", "net", "nom", "or", "org")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text of the longest rule that fits (the first listed of equal length), or null."""
    ordered = sorted(rules, key=lambda r: -len(r.text))
    fits = [((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in ordered]
    return F.coalesce(*[F.when(f, F.lit(r.text)) for f, r in zip(fits, ordered)], F.lit(None).cast("string"))


def verdict_of(rule: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.coalesce(*[F.when(rule == r.text, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))


def _labels(host: Column) -> Column:
    return F.split(F.regexp_replace(host, r"^.*@|:\d*$", ""), r"\.")


def _last(host: Column, n: Column) -> Column:
    """The last ``n`` labels, or all where there are fewer; user and port apart."""
    labels = _labels(host)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def _suffix_labels(host: Column) -> Column:
    return F.when(F.array_join(F.slice(_labels(host), -2, 2), ".").rlike(rf"^(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"), 2).otherwise(1)


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and the label before it."""
    return _last(host, _suffix_labels(host) + 1)


def suffix_of(host: Column) -> Column:
    return _last(host, _suffix_labels(host))


def reputation(hosts: DataFrame, least: float = 1.0, most: float = 1000.0) -> DataFrame:
    """``hosts(host, n, k)`` with the posterior ``a``, ``b`` of each host's block rate.

    Every level keeps counts only. The moments: for a unit with n outcomes of which k are blocked and parent mean m, an
    unbiased estimate of (rate - m)^2 is (k (k - 1) - 2 m k (n - 1) + m^2 n (n - 1)) / (n (n - 1)); averaged over units
    with weights n (n - 1) it gives the between-unit variance v, and the strength m (1 - m) / v - 1 within
    [``least``, ``most``]. No spread at all (v <= 0) gives ``most``.
    """
    pairs = F.col("n") * (F.col("n") - 1)

    def step(units: DataFrame) -> DataFrame:
        """Posteriors of units that carry their parent's mean in ``m``; one strength for the whole level."""
        m = F.col("m")
        square = F.col("k") * (F.col("k") - 1) - 2 * m * F.col("k") * (F.col("n") - 1) + m * m * pairs
        level = units.agg(F.avg("m").alias("m"), F.sum(square).alias("square"), F.sum(pairs).alias("weight")).first()  # one row
        if not level.weight:
            s = least
        elif level.square <= 0:
            s = most
        else:
            s = max(least, min(most, level.m * (1 - level.m) * level.weight / level.square - 1))
        return units.withColumn("a", m * s + F.col("k")).withColumn("b", (1 - m) * s + F.col("n") - F.col("k")).drop("m")

    sums = (F.sum("n").alias("n"), F.sum("k").alias("k"))
    hosts = hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = cut(hosts.groupBy("suffix", "domain").agg(*sums))
    suffixes = domains.groupBy("suffix").agg(*sums)
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()  # one row
    mean = (F.col("a") / (F.col("a") + F.col("b"))).alias("m")
    suffixes = cut(step(suffixes.withColumn("m", F.lit(((total.k or 0) + 0.5) / ((total.n or 0) + 1.0)))))
    domains = cut(step(lookup(domains, suffixes.select("suffix", mean), "suffix")))  # "com" may hold most domains
    return step(lookup(hosts, domains.select("domain", mean), "domain"))  # and one domain most hosts


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """Lower posterior bound of a Beta(a, b): the normal bound of the logit, which stays within 0 and 1."""
    centre = F.ln(a / b)
    spread = F.sqrt(1 / a + 1 / b)
    return 1 / (1 + F.exp(-(centre - z * spread)))


def judge(pages: DataFrame, url_col: str = "url", rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, z: float = 1.645) -> DataFrame:
    """The columns of ``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``block_bound``.

    ``block_bound`` is the lower posterior bound of the host's block rate; without a fitting rule it gives the verdict:
    block from ``threshold`` on. Null urls and urls without ``://`` have an empty host and path and are judged as the host
    ``""``. Columns of ``pages`` with one of these names give way; repeated pages are judged alike and each counts as an
    outcome. With no labelled outcome at all every host keeps the flat prior around 0.5 and is allowed.
    """
    url = F.col(url_col)
    rows = pages.withColumn("_url", url)
    rows = hidden(rows, "host", "path", "rule", "verdict", "block_bound").withColumn("host", host_of(F.col("_url"))).withColumn("path", path_of(F.col("_url"))).drop("_url")
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = cut(rows.withColumn("_ruled", verdict_of(F.col("rule"), rules)))
    labelled = F.col("_ruled").isNotNull().cast("long")
    hosts = rows.groupBy("host").agg(F.sum(labelled).alias("n"), F.sum((F.col("_ruled") == "block").cast("long")).alias("k"))
    hosts = cut(hosts.select("host", "n", F.coalesce("k", F.lit(0)).alias("k")))
    bounds = cut(reputation(hosts).select("host", lower_bound(F.col("a"), F.col("b"), z).alias("block_bound")))
    found = lookup(rows, bounds, "host")
    verdict = F.coalesce("_ruled", F.when(F.col("block_bound") >= threshold, "block").otherwise("allow"))
    names = [c for c in rows.columns if c not in ("host", "path", "rule", "_ruled")]
    return found.select(*names, "host", "path", "rule", verdict.alias("verdict"), "block_bound")
