"""URL filters by association rules: FP-growth mines combinations of URL tokens that go with bad labels; rules pruned by
support, confidence, lift and chance match URLs by an inverted index. Hand-written rules on host and path come before them.

Support is a number of pages, the same whatever the corpus. Only bad pages are mined; how many labelled pages have a rule's
tokens is counted through the index.

Tokens that stand on the same bad pages, such as the names of one query, are mined as one, else a template of 25 names would
have 2 ** 25 combinations; each token alone, and each combination with all that stands for the same, are candidates as well.

A rule stands in the index under its rarest token; a URL meets only the rules under one of its own tokens and is checked for
the others. Verdicts are found once for each distinct URL.

Defined cases: a URL that is null or without `://` has an empty host and path and no tokens, so it is allowed; labels that
are null say nothing; a page with several labels is bad if one says so; repeated rows get a row each; without bad labels, or
with no others, there are no mined rules; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: (verdict, host, path): the host and all its subdomains, with paths that start so.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: A rule needs so many bad pages with its tokens, a share of bad ones among the pages with its tokens that is CONFIDENCE or more
#: and LIFT times that of all labelled pages (or has the others' share divided by LIFT, where that asks for less), and a chance
#: of such a share below CHANCE.
LEAST, CONFIDENCE, LIFT, CHANCE = 5, 0.7, 2.0, 1e-3


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)", 2)


def tokens(url: Column) -> Column:
    """Distinct tokens: labels of the host, words of the path (numbers as #), names in the query, the scheme."""
    url = F.coalesce(url, F.lit(""))
    named = lambda kind, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.lower(x)))
    words = F.transform(F.split(path(url), r"[^\p{L}\p{N}]+"), lambda x: F.regexp_replace(x, r"[0-9]+", "#"))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    parts = F.array_distinct(F.concat(named("scheme=", F.array(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))), named("host=", F.split(host(url), r"\.")), named("path=", words), named("query=", names)))
    return F.when(F.contains(url, F.lit("://")), parts).otherwise(F.array().cast("array<string>"))


def _fewest(least: int, chance: float, base: float) -> int:
    """Bad pages that a rule needs: if all its pages are bad, chance gives that with base to the power of their number."""
    return max(least, math.ceil(math.log(chance) / math.log(base) - 1e-9))


def _candidates(bad: DataFrame, needed: int) -> DataFrame:
    """items (sorted), both: combinations of tokens and the number of bad pages (page_id, items) that have them, if `needed` do."""
    bad = bad.select("items", F.monotonically_increasing_id().alias("row"))
    each = bad.select("row", F.explode("items").alias("item"))
    # Tokens of the same pages have the same number and sums of page hashes.
    marks = each.groupBy("item").agg(F.count("*").alias("both"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "row")).alias("b")).filter(F.col("both") >= needed)
    kinds = marks.groupBy("both", "a", "b").agg(F.min("item").alias("first"), F.array_sort(F.collect_list("item")).alias("every"))
    baskets = each.join(kinds.select(F.col("first").alias("item")), "item").groupBy("row").agg(F.collect_list("item").alias("items")).select("items")
    n = baskets.count()
    single = marks.select(F.array("item").alias("items"), "both")
    if not n:
        return single
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (needed - 0.5) / n)).fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("both"))
    whole = found.select("items", "both", F.explode("items").alias("first")).join(kinds.select("first", "every"), "first")
    whole = whole.groupBy("items", "both").agg(F.array_sort(F.flatten(F.collect_list("every"))).alias("whole")).select(F.col("whole").alias("items"), "both")
    return found.unionByName(whole).unionByName(single).groupBy("items").agg(F.max("both").alias("both"))


def mined(pages: DataFrame, labels: DataFrame, least: int = LEAST, confidence: float = CONFIDENCE, lift: float = LIFT, chance: float = CHANCE) -> DataFrame:
    """Rules: items (sorted), anchor (the rarest item), support, confidence."""
    bad = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad")).filter("bad is not null")
    rows = Scratch(pages.sparkSession, "url-rules").keep(pages.select("page_id", tokens(F.col("url")).alias("items")).join(bad, "page_id").filter(F.size("items") > 0).select("page_id", "items", "bad"))
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    if total.bad in (0, total.n):
        return pages.sparkSession.createDataFrame([], "items array<string>, anchor string, support double, confidence double")
    base = total.bad / total.n
    sets = _candidates(rows.filter("bad = 1"), _fewest(least, chance, base))
    single = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("item_freq"))
    each = sets.select("items", "both", F.explode("items").alias("item")).join(single, "item")
    sets = each.groupBy("items", "both").agg(F.min(F.struct("item_freq", "item"))["item"].alias("anchor"))
    # Pages with the same tokens and label count as one row.
    kinds = rows.groupBy(F.array_sort("items").alias("have"), "bad").agg(F.count("*").alias("k"))
    good = kinds.filter("bad = 0").select("have", "k", F.explode("have").alias("anchor")).join(sets, "anchor").filter(F.size(F.array_except("items", "have")) == 0)
    good = good.groupBy("items").agg(F.sum("k").alias("good"))
    rules = sets.join(good, "items", "left").withColumn("freq", F.col("both") + F.coalesce("good", F.lit(0)))
    share, raised = F.col("both") / F.col("freq"), min(lift * base, 1 - (1 - base) / lift)
    # Chernoff's bound of the binomial tail; with no good pages it is the tail itself.
    apart = F.col("both") * F.log(share / base) + F.when(F.col("freq") > F.col("both"), (F.col("freq") - F.col("both")) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    rules = rules.filter((share >= confidence) & (share >= raised) & (share > base) & (apart >= -math.log(chance) - 1e-9))
    return rules.select("items", "anchor", (F.col("both") / total.n).alias("support"), share.alias("confidence"))


def verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, least: int = LEAST, confidence: float = CONFIDENCE, lift: float = LIFT, chance: float = CHANCE) -> DataFrame:
    """page_id, host, path, rule, verdict of pages (page_id, url)."""
    pages = pages.select("page_id", "url")
    found = mined(pages, labels, least, confidence, lift, chance)
    urls = pages.filter("url is not null").select("url").distinct().select("url", tokens(F.col("url")).alias("tokens"))
    met = urls.select("url", "tokens", F.explode("tokens").alias("anchor")).join(found, "anchor").filter(F.size(F.array_except("items", "tokens")) == 0)
    blocked = met.groupBy("url").agg(F.max("confidence").alias("confidence"))
    # Pages without a URL would meet in one task.
    found = pages.filter("url is not null").join(blocked, "url", "left").unionByName(pages.filter("url is null").withColumn("confidence", F.lit(None).cast("double")))
    out = found.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "confidence")
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
