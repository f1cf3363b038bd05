"""Filtering by URL: a list of site rules first, association rules mined from labels for all other pages.

Every URL is a set of tokens (labels of the host, words of the path, names in the query; numbers are left out).
FP-growth over the labelled pages' sets, each with its outcome as one more item, gives token combinations; those with
enough support and confidence for the outcome block stand in an inverted index under their rarest token. A set is looked up by its
tokens, and a combination that it holds whole blocks it.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the site rules: verdict, host, path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
MIN_SUPPORT = 0.002
#: Pages that a combination must have at least, however few are labelled.
MIN_PAGES = 10
MIN_CONFIDENCE = 0.5
MIN_LIFT = 1.5
BLOCK = "outcome=block"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or where :// is missing."""
    host = F.regexp_extract(url, "^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or where :// is missing."""
    return F.coalesce(F.regexp_extract(url, "^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the host or above it and whose path begins the path, and its verdict; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, site, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(site + start)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    query = F.coalesce(F.regexp_extract(url, "\\?([^#]*)", 1), F.lit(""))
    named = [F.transform(F.split(host, "[.:@]"), lambda x: F.concat(F.lit("host:"), x)),
             F.transform(F.split(F.lower(path), "[^\\p{L}]+"), lambda x: F.concat(F.lit("path:"), x)),
             F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^([^=]*)", 1)))]
    return F.array_sort(F.array_distinct(F.filter(F.concat(*named), lambda x: ~x.endswith(":"))))


def mined_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT) -> DataFrame:
    """From (tokens, bad): combinations that foretell block: combo, confidence, under (the rarest of their tokens)."""
    items = labelled.select(F.when(F.col("bad"), F.concat(F.col("tokens"), F.array(F.lit(BLOCK)))).otherwise(F.col("tokens")).alias("items"))
    least = min(1.0, max(min_support, min_pages / max(1, items.count())))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.where((F.element_at("consequent", 1) == BLOCK) & (F.col("lift") >= min_lift))
    one = model.freqItemsets.where(F.size("items") == 1).select(F.element_at("items", 1).alias("token"), "freq")
    tokens = rules.select(F.array_sort("antecedent").alias("combo"), "confidence").withColumn("token", F.explode("combo"))
    return tokens.join(one, "token").groupBy("combo").agg(F.max("confidence").alias("confidence"), F.min(F.struct("freq", "token"))["token"].alias("under"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, **mining) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, rule_confidence.

    Pages under no site rule are blocked where a mined combination fits, else allowed. A page's label is that of its
    id: bad where toxic is 1 or quality 0. Null or unlabelled pages teach nothing and are still judged; null urls have
    empty host and path; repeated rows are judged each; without labels nothing is mined and all else is allowed.
    Sets of tokens are compared once each, so a host with many pages is one row of the search.
    """
    seen = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, says = site_rule(F.col("host"), F.col("path"), rules)
    seen = seen.select("page_id", "host", "path", rule.alias("rule"), says.alias("says"), url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    bad = labels.select(F.col("doc_id").alias("page_id"), ((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    bad = bad.groupBy("page_id").agg(F.max("bad").alias("bad"))
    mined = mined_rules(seen.join(bad, "page_id").select("tokens", "bad"), **mining)
    sets = seen.where(F.col("says").isNull()).select("tokens").distinct()
    found = sets.withColumn("under", F.explode("tokens")).join(mined, "under").where(F.size(F.array_except("combo", "tokens")) == 0)
    found = found.groupBy("tokens").agg(F.max("confidence").alias("rule_confidence"))
    return seen.join(found, "tokens", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("says", F.when(F.col("rule_confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.when(F.col("says").isNull(), F.col("rule_confidence")).alias("rule_confidence"))
