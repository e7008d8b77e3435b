"""URL filter: fixed rules first, then host reputation by empirical Bayes, from host to registered domain to suffix."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sayplace.llm.common import Workspace

#: A host of a third of all rows is spread over so many salts where rows meet its reputation.
SALTS = 16
#: Blocked: hosts whose share of bad pages is over WORST for certain, by so many standard deviations of the posterior.
WORST, DEVIATIONS = 0.5, 1.0
#: Strengths of priors, in pages: no weaker, no stronger.
WEAKEST, STRONGEST = 1.0, 1000.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.locate("://", url) > 0, F.translate(F.regexp_extract(after, "^([^/?#]*)", 1), UPPER, LOWER)), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ? # or the end."""
    after = F.substring(url, F.locate("://", url) + 3, F.length(url))
    return F.coalesce(F.when(F.locate("://", url) > 0, F.regexp_extract(after, "^[^/?#]*([^?#]*)", 1)), F.lit(""))


def rule_and_verdict(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A struct (rule, verdict) of the longest rule that fits; null where none does.

    rules: (verdict, host and path prefix), like ("block", "example.com/en/"). A rule fits its host and
    all subdomains if the path starts with the rule's.
    """
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + start)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix(host: Column, suffixes: Sequence[str]) -> Column:
    """The longest of the given public suffixes that the host ends with, else its last label."""
    out = F.regexp_extract(host, r"([^.]*)$", 1)
    for s in sorted(suffixes, key=lambda s: (s.count("."), s)):
        out = F.when((host == s) | host.endswith(f".{s}"), F.lit(s)).otherwise(out)
    return out


def domain(host: Column, suffix: Column) -> Column:
    """The registered domain: the suffix and one label more, or the host if it has none."""
    rest = F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1)
    return F.when(F.length(host) > F.length(suffix) + 1, F.concat(F.regexp_extract(rest, r"([^.]*)$", 1), F.lit("."), suffix)).otherwise(host)


def _strength(groups: DataFrame, by: list[str], mean: Column) -> DataFrame:
    """The prior's strength by the method of moments, over the children (n, bad) of each parent: how little their rates differ beyond chance."""
    n, p = F.col("n"), F.col("bad") / F.col("n")
    m = groups.filter("n > 0").withColumn("_mean", mean)
    sums = m.groupBy(*by).agg(
        F.sum(n).alias("sn"), F.sum(n * n).alias("snn"), F.sum(n * (p - F.col("_mean")) ** 2).alias("ss"), F.count(F.lit(1)).alias("k"), F.max("_mean").alias("mean"))
    spread = F.col("mean") * (1 - F.col("mean"))
    room = F.col("sn") - F.col("snn") / F.col("sn")
    between = F.when(room > 0, (F.col("ss") - (F.col("k") - 1) * spread) / room)
    strength = F.when((F.col("k") > 1) & (between > 0) & (spread > 0), spread / between - 1).otherwise(F.lit(STRONGEST))
    return sums.select(*by, F.least(F.greatest(strength, F.lit(WEAKEST)), F.lit(STRONGEST)).alias("strength"))


def reputation(ws: Workspace, outcomes: DataFrame, hosts: DataFrame, suffixes: Sequence[str], worst: float = WORST, deviations: float = DEVIATIONS) -> DataFrame:
    """Rows (host, n, bad, mean, low, verdict) for each host of hosts.

    outcomes: rows (host, bad) of labelled pages, bad 0 or 1. Each level's rate is shrunk by a beta prior
    with the posterior mean of the level above and a strength that fits its spread: suffixes to the whole,
    registered domains to their suffix, hosts to their domain. A host without labels has its prior. Its
    verdict is block where the posterior mean less some standard deviations is over worst.
    """
    all_hosts = hosts.select("host").distinct()
    counted = all_hosts.join(outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad")), "host", "left")
    counted = counted.withColumn("suffix", suffix(F.col("host"), suffixes)).withColumn("domain", domain(F.col("host"), F.col("suffix")))
    counted = ws.write(counted.select("host", "domain", "suffix", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad")))
    domains = counted.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = tops.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    overall = (total["bad"] + 1) / (total["n"] + 2) if total["n"] else 0.5
    top_strength = _strength(tops, [], F.lit(overall)).first()
    s0 = float(top_strength["strength"]) if top_strength and top_strength["strength"] is not None else STRONGEST
    posterior = lambda bad, n, mean, s: (bad + mean * s) / (n + s)
    tops = tops.select("suffix", posterior(F.col("bad"), F.col("n"), F.lit(overall), F.lit(s0)).alias("suffix_mean"))
    # Suffixes may be many; their tables meet by key like any other.
    domains = domains.join(tops, "suffix")
    s1 = _strength(domains, ["suffix"], F.col("suffix_mean")).withColumnRenamed("strength", "s1")
    domains = domains.join(s1, "suffix", "left").select(
        "domain", "suffix", posterior(F.col("bad"), F.col("n"), F.col("suffix_mean"), F.coalesce("s1", F.lit(STRONGEST))).alias("domain_mean"))
    leaves = counted.join(domains, ["domain", "suffix"])
    # The spread of hosts around their domains is fitted by suffix: most domains have too few hosts of their own.
    n, p = F.col("n"), F.col("bad") / F.col("n")
    fit = leaves.filter("n > 0").groupBy("suffix").agg(
        F.sum(n).alias("sn"), F.sum(n * n).alias("snn"), F.sum(n * (p - F.col("domain_mean")) ** 2).alias("ss"),
        F.sum(F.col("domain_mean") * (1 - F.col("domain_mean"))).alias("chance"), F.avg(F.col("domain_mean") * (1 - F.col("domain_mean"))).alias("spread"))
    between = (F.col("ss") - F.col("chance")) / F.col("sn")
    s2 = fit.select("suffix", F.least(F.greatest(F.when(between > 0, F.col("spread") / between - 1).otherwise(F.lit(STRONGEST)), F.lit(WEAKEST)), F.lit(STRONGEST)).alias("s2"))
    leaves = leaves.join(s2, "suffix", "left").withColumn("s2", F.coalesce("s2", F.lit(STRONGEST)))
    mean = posterior(F.col("bad"), F.col("n"), F.col("domain_mean"), F.col("s2"))
    leaves = leaves.withColumn("mean", mean)
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("s2") + 1))
    low = F.col("mean") - deviations * deviation
    return leaves.select("host", "n", "bad", "mean", low.alias("low"), F.when(low > worst, "block").otherwise("allow").alias("verdict"))


def judge(df: DataFrame, key: str, url: str, outcomes: DataFrame, rules: Sequence[tuple[str, str]], suffixes: Sequence[str] = ()) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for every row of df.

    outcomes: rows (id, bad), the labelled pages; null labels count for nothing, and each row of an id
    that repeats counts. The longest fitting rule decides; without one, the host's reputation. Null urls
    and urls without :// have an empty host and path, and the empty host has a reputation like any other.
    Repeated rows give repeated rows; other columns are left out. SQL functions only.
    """
    ws = Workspace(df.sparkSession, "url-filter")
    pages = df.select(F.col(key).alias("id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    pages = ws.write(pages)
    labelled = outcomes.select("id", "bad").filter("bad is not null").join(pages.select("id", "host"), "id").select("host", "bad")
    known = ws.write(reputation(ws, labelled, pages, suffixes).select("host", F.col("verdict").alias("by_host")))
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = pages.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    rows = salted.join(spread, ["host", "salt"]).withColumn("fit", rule_and_verdict(F.col("host"), F.col("path"), rules))
    return rows.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "by_host").alias("verdict"))
