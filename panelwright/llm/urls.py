"""URL rules by hashed expressions: host suffixes and path prefixes, short hashes joined, full digests confirmed.

Only DataFrame functions. A rule is known by the SHA-256 of host + path. A URL is expanded into those of its
(host suffix, path prefix) pairs that some rule could have: pairs of a label count and a path length that occur among the
rules. They meet the rules by an equality join on a short prefix of the digest; whole digests then decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"
#: Hex digits of a digest that the join compares.
SHORT = 8
#: Distinct (labels, path length) pairs that one pass expands a URL into; rules with more pairs take more passes.
SHAPES = 512


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    found = F.regexp_extract(_rest(url), "^[^/?#]*", 0)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def digest(host: Column, path: Column) -> Column:
    """Of an expression; a host has no `/`, so the text of both says where the path begins (a path is empty or begins so)."""
    return F.sha2(F.concat(host, path), 256)


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Digests of the pairs of the last `labels` labels of the host and the first `length` characters of the path."""
    known = F.array(*(F.struct(F.lit(k).alias("labels"), F.lit(n).alias("length")) for k, n in shapes))
    labels = F.size(F.split(host, r"\."))
    fits = F.filter(known, lambda s: (s["labels"] <= labels) & (s["length"] <= F.length(path)))
    suffix = lambda k: F.call_function("substring_index", host, F.lit("."), -k)
    return F.transform(fits, lambda s: digest(suffix(s["labels"]), F.substring(path, F.lit(1), s["length"])))


def _passes(shapes: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    return [shapes[k : k + SHAPES] for k in range(0, len(shapes), SHAPES)]


def prepared(rules: DataFrame) -> DataFrame:
    """labels, length, rank, digest, short, rule, verdict of each rule that a URL can fit.

    Longest first (characters of host and path together), then the longer host; two rules that are equal in both can't
    fit one URL. Of two verdicts for one (host, path), block holds.
    """
    host = F.translate(F.col("host").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rules.select(host.alias("host"), F.col("path").cast("string").alias("path"), "verdict")
    rows = rows.filter(F.col("host").rlike("^[^/?#]+$") & F.col("path").rlike("^(/[^?#]*)?$") & F.col("verdict").isin(ALLOW, BLOCK))
    rows = rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    rank = F.struct(F.length(rule).alias("all"), F.length("host").alias("host"))
    whole = digest(F.col("host"), F.col("path"))
    return rows.select(
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("length"), rank.alias("rank"),
        whole.alias("digest"), F.substring(whole, 1, SHORT).alias("short"), rule.alias("rule"), "verdict")


def judge(pages: DataFrame, rules: DataFrame, carry: tuple[str, ...] = (), otherwise: str = ALLOW, url_col: str = "url") -> DataFrame:
    """carry, host, path, rule, verdict of every row of `pages`: the longest rule that fits, else null and `otherwise`.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if the path starts with the
    rule's, in the middle of a segment as well. Rules that no URL can fit (no host, a host with `/`, `?` or `#`, a path
    that is null, has `?` or `#`, or is neither empty nor begins with `/`) or with another verdict are left out.
    Null URLs, and those without `://`, have an empty host and path, which no rule fits. Every row is judged for itself,
    so null or repeated ids don't matter; carried columns must not be named as the results are. No rows give no rows, no
    rules give `otherwise`. Distinct (host, path) pairs are judged once and joined back, so a URL or host that owns a
    third of the rows is expanded no more often than it has paths. Only the lengths among the rules reach the driver.
    """
    known = prepared(rules)
    pairs = sorted((r.labels, r.length) for r in known.select("labels", "length").distinct().collect())
    rows = pages.select(*carry, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not pairs:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(otherwise))
    urls = rows.select("host", "path").filter("host != ''").distinct()
    found = None
    for shapes in _passes(pairs):
        part = urls.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), shapes)).alias("own"))
        part = part.withColumn("short", F.substring("own", 1, SHORT)).join(known.drop("labels", "length"), "short").filter(F.col("own") == F.col("digest"))
        part = part.select("host", "path", F.struct("rank", "rule", "verdict").alias("hit"))
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("host", "path").agg(F.max("hit").alias("hit")).select("host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))
    return rows.join(best, ["host", "path"], "left").select(*carry, "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
