"""URL filters by host suffix and path prefix.

Each URL is expanded into the expressions that a rule could have: a suffix of
its host, cut at a dot, followed by a prefix of its path. Suffixes and the
rules' hosts, and then expressions and rules, meet in equi-joins on the first
bytes of their SHA-256; the whole digest confirms a hit, and the longest rule
that fits decides.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources import materialize

#: Hex digits of the digest that the join uses; 8 are 4 bytes.
PREFIX_HEX = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty where it is null or has no ``://``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or
    the end, with A-Z in lower case; the path goes on up to ``?``, ``#`` or the
    end. Ports and user names are left in the host.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def filter_urls(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``df``.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A rule fits
    its host and all subdomains of it where the URL's path starts with the
    rule's path. The longest rule (host and path together) wins; among equally
    long ones the one with the longer host, then ``block``. Where none fits,
    rule is null and the verdict is ``default``. Columns of ``df`` that have
    one of the four names are replaced. Rules with a null host or path never
    fit; an empty table of rules gives every row the default.

    Each distinct pair of host and path is matched once, however many rows have
    it. A host's suffixes meet the rules' hosts first; the path is then cut
    only to the lengths that rules of these hosts have, so a URL gives one
    expression for each length of its own hosts' rules at most, however many
    rules there are. Nothing of rules or URLs goes to the driver.
    """
    host, path = host_and_path(F.col(url))
    named = df.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL")
    short = lambda c: F.left(c, F.lit(PREFIX_HEX))

    pairs = named.select("host", "path").distinct()
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), n -> substring_index(host, '.', -n))")
    suffixed = pairs.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).withColumn("digest", F.sha2("suffix", 256)).withColumn("short", short("digest"))
    of_host = rules.groupBy(F.col("host").alias("rule_host")).agg(F.collect_set(F.length("path")).alias("lengths"))
    of_host = of_host.withColumn("rule_digest", F.sha2("rule_host", 256)).withColumn("rule_short", short("rule_digest"))
    fits = suffixed.join(of_host, F.col("short") == F.col("rule_short")).where("digest = rule_digest").groupBy(F.col("host").alias("of_host")).agg(F.collect_list(F.struct("suffix", "lengths")).alias("fits"))
    fits = materialize(fits, "url-hosts")  # an exchange of its own, so that a host with very many paths can be split
    cut = F.expr("flatten(transform(fits, f -> transform(filter(f.lengths, n -> n <= length(path)), n -> concat(f.suffix, left(path, n)))))")
    expanded = pairs.join(fits, F.col("host") == F.col("of_host")).select("host", "path", F.explode(cut).alias("expression"))
    expanded = expanded.withColumn("digest", F.sha2("expression", 256)).withColumn("short", short("digest"))
    listed = rules.select(
        F.concat("host", "path").alias("rule"),
        F.length("host").alias("host_chars"),
        "verdict",
        F.sha2(F.concat("host", "path"), 256).alias("rule_digest"),
    ).withColumn("rule_short", short("rule_digest"))
    hits = expanded.join(listed, F.col("short") == F.col("rule_short")).where("digest = rule_digest")
    best = F.max(F.struct(F.length("rule").alias("chars"), "host_chars", "verdict", "rule"))
    decided = hits.groupBy("host", "path").agg(best.alias("best"))
    return named.join(decided, ["host", "path"], "left").select(
        *named.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
