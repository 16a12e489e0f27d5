"""URL filter: host reputation by empirical Bayes, and rules that come before it.

Labelled pages say how often a host's pages are good. A host with few labels leans
on its registered domain, that on its suffix, and that on all pages: each level's
posterior is the prior of the next, beta-binomial, with a strength that is estimated
from how much the rates of that level differ from their priors. A page is allowed
if the lower bound of its host's posterior reaches a threshold.

A rule names a host and a path; it fits that host and all its subdomains, and paths
that start with its own. The longest that fits decides.

* An address that is null or has no ``://`` has an empty host and path; so all such
  pages share one reputation. Ports and user names belong to the host; the suffix is
  the last label without the port, or the last two if a country's follows one of
  ``SECOND_LEVEL`` (``co.uk``); the registered domain has one label more, if there is one.
* A page with several labels counts each; labels without a quality or a toxicity, or
  for no page, none.
  Pages with equal ids are judged one by one. Without labels, all rest on the prior
  of one good and one bad page.
* Empty tables give none; other columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewright.llm.shared import shrunk, written

THRESHOLD = 0.5
# Labels under which many countries' registries hand out names.
SECOND_LEVEL = "ac", "co", "com", "edu", "gov", "net", "org"
# Standard deviations between the posterior's mean and its bound.
WIDTH = 1.645


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith(f".{self.host}")
        return host & F.col("path").startswith(self.path)


def parts(url: Column) -> tuple[Column, Column]:
    """Host, lower-cased, and path of an address."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _first_fit(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as a struct; a short list, tried in turn."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda rule: (len(rule.name), rule.name)):
        value = F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(rule.fits(), value).otherwise(chosen)
    return chosen


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """``host, n, good, mean, bound`` of every host.

    ``pages`` has ``page`` and ``host``, ``outcomes`` has ``page`` and ``good`` (0 or 1).
    """
    labelled = pages.join(outcomes, "page", "left").groupBy("host")
    hosts = labelled.agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    bare = F.regexp_replace("host", r":\d*$", "")
    names = F.split(bare, r"\.")
    country = (F.size(names) > 1) & (F.length(F.element_at(names, -1)) == 2)
    deep = country & F.get(names, F.size(names) - 2).isin(*SECOND_LEVEL)
    last = lambda count: F.array_join(F.slice(names, -F.least(F.size(names), count), count), ".")
    suffix, domain = last(F.when(deep, 2).otherwise(1)), last(F.when(deep, 3).otherwise(2))
    hosts = written(hosts.withColumns({"domain": domain, "suffix": suffix}), "hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)

    counted = lambda *by: hosts.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = shrunk(counted("suffix").withColumn("prior", F.lit(overall)))
    prior = suffixes.select("suffix", F.col("mean").alias("prior"))
    domains = shrunk(written(counted("domain", "suffix").join(prior, "suffix"), "domains"))
    prior = domains.select("domain", F.col("mean").alias("prior"))
    judged = shrunk(written(hosts.join(prior, "domain"), "host-priors"))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return judged.select("host", "n", "good", "mean", (F.col("mean") - WIDTH * spread).alias("bound"))


def judged(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[Rule],
    key: str = "page_id",
    url: str = "url",
    label_key: str = "doc_id",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``key, host, path, rule, verdict, posterior, bound`` of every page. A labelled page is good
    if its quality is 1 and it is not toxic."""
    host, path = parts(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{key}`").alias("page"), host.alias("host"), path.alias("path"))
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    outcomes = labels.filter("quality is not null and toxic is not null").select(
        F.col(f"`{label_key}`").alias("page"), good.cast("int").alias("good")
    )
    known = written(reputations(rows.select("page", "host"), outcomes), "reputations")
    found = rows.join(known.select("host", "mean", "bound"), "host").withColumn("fit", _first_fit(rules))
    earned = F.when(F.col("bound") >= threshold, "allow").otherwise("block")
    return found.select(
        F.col("page").alias(key),
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", earned).alias("verdict"),
        F.col("mean").alias("posterior"),
        "bound",
    )
