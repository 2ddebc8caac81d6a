"""URL rules by hash lookup, with DataFrame functions only.

Each URL is expanded into host-suffix and path-prefix expressions, as long as rules can
be: no more labels than the rules' hosts have, prefixes of the rules' path lengths only.
Expressions meet rules in an equi-join on the first four bytes of their SHA-256; whole
digests then confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
RULES = "host string, path string, verdict string"
#: Up to the first `://`; once there, a match does not go on to a later one.
_START = r"(?s)^(?>.*?://)"


def _ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end; empty without `://`."""
    return _ascii_lower(F.coalesce(F.regexp_extract(url, _START + "([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, _START + "[^/?#]*(/[^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def judge_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule, verdict, one row for each row of `pages`.

    A rule (host, path, verdict) fits its host and all subdomains where the path starts with
    the rule's. The longest rule (host and path) wins, among equally long ones that with
    the longer host, then `block`. Without a rule the verdict is `default`. A null URL or
    one without `://` has empty host and path; a null id stays; rows of equal ids are judged
    each for itself; columns other than these are left out; no rows give no rows.

    The expansion is bounded by the rules' longest host and their path lengths, so a URL of
    any length makes a bounded number of expressions; those lengths are the only thing read
    to the driver. Rules may be many: they are joined, and broadcast only if Spark finds
    them small enough.
    """
    kept = rules.select("host", "path", "verdict").na.drop()
    shapes = kept.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")
    ).first()
    labels, lengths = shapes["labels"] or 0, shapes["lengths"]

    expression = F.concat(F.col("host"), F.col("path"))
    known = kept.select(
        expression.alias("rule"),
        "verdict",
        F.length(expression).alias("size"),
        F.length("host").alias("host_size"),
        _digest(F.concat("host", F.lit("\n"), "path")).alias("rule_digest"),
    ).withColumn("prefix", F.substring("rule_digest", 1, 8))

    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    expressions = F.flatten(
        F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: _digest(F.concat(h, F.lit("\n"), p))))
    )
    pages = pages.select(
        F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("row", F.monotonically_increasing_id())
    asked = pages.select("*", F.explode_outer(expressions if labels else F.array().cast("array<string>")).alias("digest"))
    met = asked.withColumn("prefix", F.substring("digest", 1, 8)).join(known, "prefix", "left")
    found = F.when(
        F.col("digest") == F.col("rule_digest"),
        F.struct("size", "host_size", F.col("verdict").alias("verdict"), "rule"),
    )
    # `row` is unique, so a task's expressions of a page become one row before the shuffle.
    best = met.groupBy("row", "page_id", "host", "path").agg(F.max(found).alias("best"))
    return best.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
