"""URL filters: hashed host-suffix and path-prefix expressions joined with rules, in DataFrame functions only.

Each distinct (host, path) becomes expressions: every suffix of the host at a label's border with a number of labels that some rule
has, times every prefix of the path of a length that some rule has. Expressions meet rules on the first 32 bits of their SHA-256; the full
digests then confirm, and the longest rule wins. The numbers of labels and the lengths are the rules' own, at most a few hundred
values, so no URL makes more expressions than the rules have shapes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 200_000


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://, or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://, or for null."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path joined, or null) and verdict (the rule's, else default).

    rules has host, path and verdict; of rules with the same host and path one that blocks wins; rules with nulls are left out. A rule fits its
    host and all subdomains where the URL's path starts with its path; the longest wins (host and path together), then a blocking one, then
    the greatest text. Null, empty and malformed URLs have empty host and path. Repeated rows and all columns stay; new columns whose
    names are taken get underscores in front. Without rules every URL gets the default. A very long URL makes no more
    expressions than the rules have shapes; an empty table gives no rows."""
    names = {}
    for want in ("host", "path", "rule", "verdict"):
        names[want] = free_name(pages, want)
    known = rules.filter("host is not null and path is not null and verdict is not null").select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    known = known.groupBy("rule_host", "rule_path").agg(F.min(F.struct((F.col("verdict") != "block").alias("milder"), "verdict")).alias("v")).select("rule_host", "rule_path", F.col("v.verdict").alias("rule_verdict"))
    shape = known.agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(F.size(F.split("rule_host", r"\.")))).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths")).first()
    split = pages.withColumns({names["host"]: url_host(F.col(url)), names["path"]: url_path(F.col(url))})
    if not shape["n"]:
        return split.withColumns({names["rule"]: F.lit(None).cast("string"), names["verdict"]: F.lit(default)})

    def digests(df: DataFrame, host: str, path: str) -> DataFrame:
        return df.withColumn("digest", F.sha2(F.concat(host, F.lit("\n"), path), 256)).withColumn("short", F.substring("digest", 1, 8))

    urls = split.select(F.col(names["host"]).alias("host"), F.col(names["path"]).alias("path")).distinct()
    labels, lengths = (F.array(*[F.lit(int(x)) for x in shape[k]]) for k in ("labels", "lengths"))
    parts = F.size(F.split("host", r"\."))
    made = (
        urls.withColumn("k", F.explode(F.filter(labels, lambda k: k <= parts)))
        .withColumn("suffix", F.expr("substring_index(host, '.', -k)"))
        .withColumn("m", F.explode(F.filter(lengths, lambda m: m <= F.length("path"))))
        .withColumn("prefix", F.expr("substring(path, 1, m)"))
    )
    made = digests(made, "suffix", "prefix").select("host", "path", "short", F.col("digest").alias("of"))
    held = digests(known, "rule_host", "rule_path")
    held = F.broadcast(held) if shape["n"] <= BROADCAST_RULES else held
    fits = made.join(held, "short").filter(F.col("of") == F.col("digest"))
    text = F.concat("rule_host", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(text).alias("n"), (F.col("rule_verdict") == "block").alias("b"), text.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    best = best.select(F.col("host").alias("_fit_host"), F.col("path").alias("_fit_path"), F.col("best.rule").alias("_fit_rule"), F.col("best.verdict").alias("_fit_verdict"))
    out = split.join(best, (F.col(names["host"]) == F.col("_fit_host")) & (F.col(names["path"]) == F.col("_fit_path")), "left")
    return out.select(*[F.col(f"`{c}`") for c in split.columns], F.col("_fit_rule").alias(names["rule"]), F.coalesce("_fit_verdict", F.lit(default)).alias(names["verdict"]))
