"""URL filtering by association rules (DataFrame and SQL functions only).

FP-growth mines combinations of URL tokens from a part of the labelled URLs. Rules that lead to the blocked
label and pass the support, confidence and lift limits there, and the confidence limit on the rest too, are matched by an inverted index: each
rule stands under its rarest token, URLs look up their tokens there, and a hit counts when the
URL holds every token of the rule. Given host and path rules come first, the longest one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cirrostrat.runtime import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCK = "label=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty where it is null or has no ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def url_tokens(url: Column) -> Column:
    """Distinct tokens: domain labels and suffixes, path words (digits as #), names of query parameters."""
    host, path = host_and_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.transform(F.filter(F.split(path, r"[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, r"\d+", "#")))
    names = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)="), F.lit(1)), lambda x: F.concat(F.lit("query:"), x))
    return F.array_distinct(F.concat(F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")), words, names))


def _distinct_tokens(baskets: DataFrame) -> DataFrame:
    """``baskets`` (items) without host suffixes that say what a longer one says: those found in the very same baskets as it."""
    keyed = baskets.withColumn("_b", F.monotonically_increasing_id())
    token = keyed.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    hosts = token.where(F.startswith("token", F.lit("host:")))
    up = hosts.select(F.concat(F.lit("host:"), F.regexp_extract("token", r"^host:[^.]*\.(.*)$", 1)).alias("token"), "n")
    same = hosts.join(up, ["token", "n"], "left_semi").select("token").distinct()
    kept = keyed.select("_b", F.explode("items").alias("token")).join(same, "token", "left_anti")
    return kept.groupBy("_b").agg(F.collect_list("token").alias("items")).select("items")


def mine_rules(labelled: DataFrame, support: float = 0.01, confidence: float = 0.5, lift: float = 1.2, implied: bool = True) -> DataFrame:
    """(tokens, confidence) of the rules that lead from URL tokens to ``blocked`` (labelled: url, blocked boolean).

    Without ``implied``, a host suffix found in the same URLs as a longer one is left out, so that nested suffixes do not double the itemsets.
    """
    baskets = labelled.where("url is not null and blocked is not null").select(
        F.concat(url_tokens(F.col("url")), F.when(F.col("blocked"), F.array(F.lit(_BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items")
    )
    baskets = baskets.where(F.size("items") > 0)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets if implied else _distinct_tokens(baskets))
    rules = model.associationRules.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == _BLOCK) & (F.col("lift") >= lift))
    return rules.select(F.array_sort("antecedent").alias("tokens"), "confidence")


def held_rules(labelled: DataFrame, confidence: float = 0.5, held: int = 4, **limits: float) -> DataFrame:
    """(tokens, confidence) of rules mined from the labelled URLs but every ``held``-th (by hash), whose confidence on those surely reaches the limit too.

    Surely: at the lower end of the score interval of two standard errors, so that no rule passes on a few URLs (four at least, at the limit of a half).
    The confidence is that on the held URLs.
    """
    known = labelled.where("url is not null and blocked is not null").withColumn("_held", F.pmod(F.xxhash64("url", F.lit(29)), F.lit(held)) == 0)
    rules = materialize(mine_rules(known.where("not _held"), confidence=confidence, implied=False, **limits), "rules")
    seen = known.where("_held")
    found = rule_matches(seen, rules).join(seen.select("url", "blocked"), "url").groupBy("needs").agg(F.avg(F.col("blocked").cast("int")).alias("confidence"), F.count("*").alias("n"))
    p, n = F.col("confidence"), F.col("n")
    low = (p + 2 / n - 2 * F.sqrt(p * (1 - p) / n + 1 / (n * n))) / (1 + 4 / n)
    return found.where(low >= confidence - 1e-9).select(F.col("needs").alias("tokens"), "confidence")


def rule_matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, needs) of the distinct urls that hold all the tokens that some rule needs, found through each rule's rarest token."""
    tokens = urls.where("url is not null").select("url").distinct().withColumn("tokens", url_tokens(F.col("url")))
    posted = tokens.select("url", F.explode("tokens").alias("token"))
    of_rules = rules.select("tokens", F.explode("tokens").alias("token"))
    wanted = of_rules.select("token").distinct()
    counts = posted.join(wanted, "token").groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("tokens").orderBy(F.coalesce("n", F.lit(0)), "token")
    index = of_rules.join(counts, "token", "left").withColumn("k", F.row_number().over(rarest)).where("k = 1").select("token", F.col("tokens").alias("needs"))
    hits = tokens.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return hits.where(F.size(F.array_except("needs", "tokens")) == 0).select("url", "needs")


def blocked_urls(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls of ``urls`` that some rule fits."""
    return rule_matches(urls, rules).select("url").distinct()


def judge(pages: DataFrame, given: Sequence[tuple[str, str, str]], labelled: DataFrame, **limits: float) -> DataFrame:
    """``pages`` (with a url) plus host, path, rule and verdict.

    ``given``: (host, path, verdict); such a rule fits its host and all subdomains where the path
    starts with its own, and the longest that fits wins. Other URLs are judged by the mined rules:
    block if one holds, else allow. Null URLs, and those without ``://``, have an empty host and path,
    which fits no rule, and are allowed. URLs that repeat are matched once. Columns of ``pages`` named like the four new ones are replaced.
    """
    host, path = host_and_path(F.col("url"))
    verdicts = blocked_urls(pages, materialize(held_rules(labelled, **limits), "rules")).select(F.col("url").alias("_u"), F.lit(True).alias("_b"))
    plain = pages.drop("host", "path", "rule", "verdict", "_u", "_b").withColumns({"host": host, "path": path})
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, verdict in sorted(given, key=lambda g: len(g[0]) + len(g[1])):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, said = F.when(fits, h + p).otherwise(rule), F.when(fits, verdict).otherwise(said)
    ruled = plain.withColumns({"rule": rule, "_said": said})
    mined = F.when(F.col("_b"), "block").otherwise("allow")
    return ruled.join(verdicts, F.col("url") == F.col("_u"), "left").withColumn("verdict", F.coalesce("_said", mined)).drop("_u", "_b", "_said")
