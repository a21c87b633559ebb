"""URL filter rules by host suffix and path prefix, in DataFrame operations alone.

Every URL is expanded into (host suffix, path prefix) expressions: suffixes of as many labels, and prefixes of as many
characters, as some rule has. Expressions meet rules by an equi-join on the first four bytes of their SHA-256, then
the full digests are compared. The longest matching rule decides; of equally long ones block comes first. The rules are
broadcast only where there are at most `broadcast_rules` of them; more are joined by shuffle, spread by a salt.

A rule (host, path, verdict) fits its host and all subdomains when the URL's path starts with the rule's path. Host:
after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; path: from there up to '?', '#' or the end. A null
URL, or one without '://', has empty host and path. Without a rule the verdict is the default. Every input row gives one
output row, repeated ones too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindergrid.llm.common import lower_ascii

SALTS = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow", broadcast_rules: int = 100_000) -> DataFrame:
    """(page_id, host, path, rule, verdict, matched): rule is its host and path; matched is the number of rules that fit."""
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict").distinct()
    shape = rules.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"), F.collect_set(F.length("rule_path")).alias("chars")).first()
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    wanted = lambda sizes: F.array(*(F.lit(int(x)) for x in sorted(sizes))) if sizes else F.array().cast("array<int>")
    suffixes = F.transform(F.filter(wanted(shape.labels), lambda n: n <= F.size("labels")), lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), "."))
    prefixes = F.transform(F.filter(wanted(shape.chars), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    expanded = rows.withColumn("labels", labels).withColumn("suffix", F.explode_outer(suffixes)).withColumn("prefix", F.explode_outer(prefixes)).drop("labels")
    digest = lambda a, b: F.sha2(F.concat(a, F.lit("\n"), b), 256)
    expanded = expanded.withColumn("digest", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    rules = rules.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.conv(F.substring("rule_digest", 1, 8), 16, 10).cast("long"))
    if shape.n <= broadcast_rules:
        joined = expanded.join(F.broadcast(rules), "short", "left")
    else:
        rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = expanded.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(rules, ["short", "salt"], "left")
    fits = (F.col("digest") == F.col("rule_digest")) & (F.col("suffix") == F.col("rule_host")) & (F.col("prefix") == F.col("rule_path"))
    name = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(name).alias("n"), (F.col("verdict") == "block").alias("first"), name.alias("name"), F.col("verdict").alias("verdict"))
    best = joined.withColumn("hit", F.when(fits, order)).groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("hit").alias("hit"), F.count("hit").alias("matched"))
    return best.select("page_id", "host", "path", F.col("hit.name").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"), "matched")
