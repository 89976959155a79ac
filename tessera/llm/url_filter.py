"""URL filter: list rules, then an Empirical-Bayes reputation of hosts. DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.storage import stored

# Public suffixes of two labels, below which one registers a name; a last label alone is always one.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "org.uk")

#: Rules are written into the plan as one expression; a longer list belongs in a table, to be joined by host.
MOST_RULES = 500


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case; empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "".join(chr(c) for c in range(65, 91))
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """A host without what may stand before `@` and without a port: what reputations go by."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def is_address(name: Column) -> Column:
    """Whether a name is an IP address, which no domain is registered for: four numbers, or anything in brackets."""
    return name.rlike(r"^([0-9]{1,3}\.){3}[0-9]{1,3}$") | name.startswith("[")


def with_domains(names: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Add `suffix` and `domain` to distinct hosts (name): the longest public suffix, and one label more.

    `suffixes` (suffix) lists the suffixes of several labels; where none fits, the last label is the suffix. An
    address is its own suffix and domain. The list is joined by the hosts' tails of up to as many labels as it has.
    """
    known = suffixes.filter("suffix is not null").select(F.lower("suffix").alias("tail")).distinct()
    most = known.agg(F.max(F.size(F.split("tail", r"\.")))).first()[0] or 1
    labels = F.size(F.split("name", r"\."))
    tails = names.filter(~is_address(F.col("name"))).select("name", F.explode(F.sequence(F.lit(1), F.least(labels, F.lit(most)))).alias("k"))
    tails = tails.withColumn("tail", F.call_function("substring_index", F.col("name"), F.lit("."), -F.col("k")))
    found = tails.join(known, "tail").groupBy("name").agg(F.max("k").alias("k"))
    k = F.coalesce("k", F.lit(1))
    tail = lambda n: F.when(is_address(F.col("name")), F.col("name")).otherwise(F.call_function("substring_index", F.col("name"), F.lit("."), -n))
    return names.join(found, "name", "left").withColumns({"suffix": tail(k), "domain": tail(k + 1)}).drop("k")


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and what it says; nulls where none fits.

    `rules`: pairs of `block` or `allow` and a rule such as `example.com/de/`. A rule fits its host and all
    subdomains of it, if the path starts with the rule's path.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be part of a plan")
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        text, verdict = F.when(fits, F.lit(rule)).otherwise(text), F.when(fits, F.lit(says)).otherwise(verdict)
    return text, verdict


def _strength(stats: DataFrame) -> tuple[float, float]:
    """Mean rate and prior strength a+b of the beta-binomial that the groups (n, bad) follow, by moments."""
    used = stats.filter("n > 0")
    total = used.agg(F.sum("n").alias("n"), F.sum("bad").alias("s"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s2"), F.count("*").alias("k")).first()
    if not total["k"]:
        return 0.0, 1.0
    n, s, k = float(total["n"]), float(total["s"]), total["k"]
    p = s / n
    free = n - float(total["n2"]) / n - (k - 1)
    if p in (0.0, 1.0) or free <= 0:
        return p, 1000.0
    rho = ((float(total["s2"]) - n * p * p) / (p * (1 - p)) - (k - 1)) / free
    rho = min(max(rho, 1 / 1001), 1 / 2)
    return p, 1 / rho - 1


def host_reputation(outcomes: DataFrame, suffixes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior share of bad pages by host.

    `outcomes`: rows (host, n, bad) with labelled counts, hosts without a label included (n = 0); `suffixes`: public
    suffixes (see `with_domains`). Hosts are taken by their names, without user and port. The share of a
    suffix is shrunk towards that of all pages, a registered domain's towards its suffix's, and a host's towards
    its domain's, each with a beta prior whose strength is estimated from that level's groups. Returns name, n,
    bad, mean and bound: the posterior mean less z posterior standard deviations.

    Only three rows of sums come to the driver. Counts are summed before any shuffle, so a host or suffix with
    most of all pages is one row by task. Without labels every mean is 0.
    """
    hosts = outcomes.groupBy(name_of(F.col("host")).alias("name")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # Stored tables keep the joins plain, so that Spark can split a host or domain that holds most of the rows.
    hosts = stored(with_domains(stored(hosts), suffixes))
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("dbad")))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dbad").alias("sbad"))
    mean, k_suffix = _strength(suffixes.select(F.col("sn").alias("n"), F.col("sbad").alias("bad")))
    _, k_domain = _strength(domains.select(F.col("dn").alias("n"), F.col("dbad").alias("bad")))
    _, k_host = _strength(hosts)
    suffixes = suffixes.select("suffix", ((F.col("sbad") + k_suffix * mean) / (F.col("sn") + k_suffix)).alias("smean"))
    domains = stored(domains.join(stored(suffixes), "suffix").select("domain", ((F.col("dbad") + k_domain * F.col("smean")) / (F.col("dn") + k_domain)).alias("dmean")))
    a = F.col("bad") + k_host * F.col("dmean")
    total = F.col("n") + F.lit(k_host)
    return (
        hosts.join(domains, "domain")
        .select("name", "n", "bad", (a / total).alias("mean"), total.alias("total"))
        .select("name", "n", "bad", "mean", (F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1))).alias("bound"))
    )


def filter_urls(
    pages: DataFrame,
    labels: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    most_bad: float = 0.3,
    z: float = 1.645,
    key: str = "page_id",
    url: str = "url",
    label_key: str = "doc_id",
    suffixes: DataFrame | None = None,
) -> DataFrame:
    """Judge every page's URL: by the longest list rule that fits, else by its host's reputation.

    `labels` has page outcomes (label_key, quality 0/1, toxic 0/1); a page is bad if its quality is 0 or it is
    toxic. A host is blocked when the posterior bound of its share of bad pages exceeds `most_bad`. `suffixes` (suffix)
    is a public suffix list; by default there are only TWO_LABEL_SUFFIXES and last labels.

    Returns key, host, path, rule, verdict, bad_mean and bad_bound, one row for each row of pages. A null URL or
    one without `://` has an empty host and path, no rule, and the reputation of the empty host. Labels that are
    null in both columns, or whose key is null or no page, don't count; a page with several label rows counts
    each. Other columns are not read; empty tables give an empty result or no labels.
    """
    seen = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    seen = seen.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = (F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("long")
    known = labels.filter(F.col(label_key).isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    # One row by page, so that repeated labels don't repeat pages.
    known = known.groupBy(F.col(label_key).alias("key")).agg(F.count("*").alias("n"), F.sum(bad).alias("bad"))
    outcomes = seen.join(known, "key", "left").select("host", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    if suffixes is None:
        suffixes = pages.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, TWO_LABEL_SUFFIXES))).alias("suffix"))
    reputation = host_reputation(outcomes, suffixes, z).select("name", F.col("mean").alias("bad_mean"), F.col("bound").alias("bad_bound"))
    rule, says = matching_rule(F.col("host"), F.col("path"), rules)
    judged = seen.withColumn("name", name_of(F.col("host"))).join(stored(reputation), "name", "left").withColumns({"rule": rule, "says": says})
    verdict = F.coalesce("says", F.when(F.col("bad_bound") > most_bad, "block").otherwise("allow"))
    return judged.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), "bad_mean", "bad_bound")
