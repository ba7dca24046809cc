"""URL filters: fixed rules first, else the reputation of the host by empirical Bayes.

A host's bad outcomes among its labelled pages are shrunk through beta-binomial priors: the rate over all hosts is the
prior of a suffix (last label), a suffix's posterior that of its registered domains (last two labels), a domain's
that of its hosts. Each prior's strength comes from how much the rates of the level below differ beyond chance
(moments, between LEAST and MOST pages). A host is blocked if the lower bound of its bad rate, Z standard deviations
below the posterior mean, exceeds LIMIT. A host without labels has its domain's posterior as prior; hosts with the same
labels get the same verdict whatever their size, and only host counts meet in aggregates, so a host with a third of
all pages costs no more than its partial sums.

host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end. Both are
empty for a null url or one without `://`; such rows share the empty host. A rule fits its host and all subdomains if
the path starts with its path; the longest wins, of equal ones the first in order of text. Repeated rows get repeated results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Store, join_small

LEAST, MOST, Z, LIMIT = 2.0, 500.0, 1.645, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path)"""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"\A(?s:.*?)://", "")).otherwise(F.lit(""))
    return (F.translate(F.regexp_extract(rest, r"\A([^/?#]*)", 1), UPPER, LOWER),
            F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the `rules` (action, host and path) that fits, as (size, rule, action); null if none does."""
    fits = []
    for action, rule in rules:
        where, slash, start = rule.partition("/")
        fit = ((host == where) | host.endswith("." + where)) & path.startswith(slash + start)
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(action).alias("action"))))
    return F.array_max(F.array_compact(F.array(*fits))) if fits else F.lit(None).cast("struct<size:int,rule:string,action:string>")


def _strength(rate: Column, spread: Column, children: Column, pages: Column) -> Column:
    """Pages that a prior counts for: its rate's variance over the variance between children beyond chance, less one."""
    chance = rate * (1 - rate)
    between = spread / pages - chance * children / pages
    return F.when((pages > 0) & (between > 0), F.least(F.lit(MOST), F.greatest(F.lit(LEAST), chance / between - 1))).otherwise(F.lit(MOST))


def _level(nodes: DataFrame, parent: str) -> DataFrame:
    """Pages and bad pages of each parent, and the strength it has as a prior of `nodes`."""
    sums = nodes.groupBy(parent).agg(F.sum("pages").alias("p_pages"), F.sum("bad").alias("p_bad"), F.count(F.when(F.col("pages") > 0, 1)).alias("children"),
                                     F.sum(F.when(F.col("pages") > 0, F.col("bad") * F.col("bad") / F.col("pages")).otherwise(0.0)).alias("squares"))
    rate = (F.col("p_bad") + 0.5) / (F.col("p_pages") + 1)
    spread = F.col("squares") - 2 * rate * F.col("p_bad") + rate * rate * F.col("p_pages")
    return sums.select(parent, "p_pages", "p_bad", rate.alias("p_rate"), _strength(rate, spread, F.col("children"), F.col("p_pages")).alias("strength"))


def host_reputation(hosts: DataFrame) -> DataFrame:
    """host, domain, suffix, pages, bad, rate (posterior mean), bound from `hosts` (host, pages, bad), a row for each host."""
    labels = F.split("host", r"\.")
    h = hosts.select("host", "pages", "bad", F.element_at(labels, -1).alias("suffix"),
                     F.when(F.size(labels) > 1, F.concat(F.get(labels, F.size(labels) - 2), F.lit("."), F.element_at(labels, -1))).otherwise(F.col("host")).alias("domain"))
    domains = h.groupBy("domain", "suffix").agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad"))

    def posterior(prior: Column, strength: Column) -> Column:
        return (F.col("bad") + strength * prior) / (F.col("pages") + strength)

    top = _level(suffixes.withColumn("all", F.lit(0)), "all").first()
    m, s = (top["p_rate"], top["strength"]) if top else (0.5, MOST)
    suffixes = suffixes.select("suffix", posterior(F.lit(m), F.lit(s)).alias("m"))
    of_suffix = suffixes.join(_level(domains, "suffix").select("suffix", F.col("strength").alias("s")), "suffix")
    of_domain = (domains.join(of_suffix, "suffix").select("domain", posterior(F.col("m"), F.col("s")).alias("m"))
                 .join(_level(h, "domain").select("domain", F.col("strength").alias("s")), "domain"))
    h = h.join(of_domain, "domain").withColumn("rate", posterior(F.col("m"), F.col("s")))
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("pages") + F.col("s") + 1))
    return h.select("host", "domain", "suffix", "pages", "bad", "rate", (F.col("rate") - Z * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], store: Store | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, rate, bound: a row for each of `pages` (page_id, url).

    `outcomes` (url, bad) are labelled pages, bad 0 or 1; rows with a null are left out.
    """
    store = store or Store(pages.sparkSession)
    host, path = parsed(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    seen = outcomes.where("url IS NOT NULL AND bad IS NOT NULL").select(host.alias("host"), F.col("bad").cast("long").alias("bad"), F.lit(1).cast("long").alias("pages"))
    counts = (p.select("host", F.lit(0).cast("long").alias("bad"), F.lit(0).cast("long").alias("pages")).union(seen)
              .groupBy("host").agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad")))
    known = store.put(host_reputation(store.put(counts)).select("host", "rate", "bound"))
    d = join_small(p, known, "host").withColumn("fit", matched_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("bound") > LIMIT, F.lit("block")).otherwise(F.lit("allow"))
    return d.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.action", own).alias("verdict"),
                    F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound"))
