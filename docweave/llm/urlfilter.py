"""Operator 3: URL filters by given rules and by association rules; DataFrame functions and Spark's FP-growth.

A given rule (verdict, host, path) fits its host and all subdomains where the url's path starts with its
path; the longest rule wins. The urls that rules judge are the labelled ones: FP-growth mines frequent
combinations of their tokens and verdicts, and rules of MIN_SUPPORT and MIN_CONFIDENCE judge the other urls.
A mined rule is found by its rarest token (an inverted index) and then held against all of the url's tokens.
The mined rules number what the support bound lets through, whatever the input.

Defined cases: a null url, or one without ://, has empty host and path; without a fitting rule of either
sort the verdict is allow; ties between mined verdicts go to allow; repeated rows each get a result.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import durable

MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def parsed(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    at = F.instr(F.coalesce(F.col(url), F.lit("")), "://")
    rest = F.when(at > 0, F.substr(F.col(url), at + 3)).otherwise("")
    urls = urls.withColumn("dw_rest", rest).withColumn("dw_host", F.regexp_extract("dw_rest", "^[^/?#]*", 0))
    tail = F.substr(F.col("dw_rest"), F.length("dw_host") + 1)
    return urls.withColumns({"host": F.translate("dw_host", _UPPER, _LOWER), "path": F.regexp_extract(tail, "^[^?#]*", 0)}).drop("dw_rest", "dw_host")


def judged(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds rule and rule_verdict (null where none fits) by the given rules, a fixed short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return urls.withColumns({"rule": name, "rule_verdict": verdict})


def tokens(url: str = "url") -> Column:
    """Distinct tokens of a parsed url: host labels but the first (site names vary), path words, extension, query keys."""
    labels = F.split("host", "\\.")
    host = F.transform(F.slice(labels, F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0))), lambda x: F.concat(F.lit("host="), x))
    first = F.array(F.concat(F.lit("first="), F.get(labels, F.lit(0))))
    words = F.transform(F.filter(F.split(F.regexp_replace("path", "[0-9]+", "0"), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), "\\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key="), F.regexp_extract(x, "^[^=]*", 0)))
    return F.array_distinct(F.concat(first, host, words, keys))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame | None:
    """antecedent, anchor (its rarest token), verdict and confidence, from rows of items and a verdict."""
    if labelled.isEmpty():
        return None
    rows = labelled.select(F.concat("items", F.array(F.concat(F.lit("verdict="), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(rows)
    rules = model.associationRules.where(F.get("consequent", F.lit(0)).startswith("verdict="))
    rules = rules.select("antecedent", F.substr(F.get("consequent", F.lit(0)), F.lit(9)).alias("verdict"), "confidence")
    single = model.freqItemsets.where("size(items) = 1").select(F.col("items")[0].alias("token"), "freq")
    parts = rules.select("*", F.explode("antecedent").alias("token")).join(single, "token")
    return parts.groupBy("antecedent", "verdict", "confidence").agg(F.min_by("token", F.struct("freq", "token")).alias("anchor"))


def apply_mined(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """id and the best confidences of allowing and blocking rules, for urls (id, items) that some rule matches."""
    at = urls.select("id", "items", F.explode("items").alias("anchor"))
    hits = at.join(rules, "anchor").where(F.size(F.array_except("antecedent", "items")) == 0)
    best = lambda v: F.max(F.when(F.col("verdict") == v, F.col("confidence")))
    return hits.groupBy("id").agg(best("allow").alias("c_allow"), best("block").alias("c_block"))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, and how it came about (rule, mined or default)."""
    urls = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    urls = durable(judged(parsed(urls), rules).withColumn("items", tokens()).withColumn("id", F.xxhash64("url")))
    mined = mine(urls.where("rule_verdict is not null").select("items", F.col("rule_verdict").alias("verdict")))
    open_ = urls.where("rule_verdict is null").select("id", "items").distinct()
    if mined is None:
        urls = urls.withColumns({"c_allow": F.lit(None).cast("double"), "c_block": F.lit(None).cast("double")})
    else:
        urls = urls.join(apply_mined(open_, durable(mined)), "id", "left")
    by_mined = F.when(F.col("c_block") > F.coalesce("c_allow", F.lit(0.0)), "block").when(F.col("c_allow").isNotNull(), "allow")
    out = urls.withColumn("own", F.when(F.col("rule_verdict").isNull(), by_mined))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", "own", F.lit("allow")).alias("verdict"), F.when(F.col("rule").isNotNull(), "rule").when(F.col("own").isNotNull(), "mined").otherwise("default").alias("by"))
