"""URL filter: a list of host and path rules first, mined association rules for the rest.

URLs that a listed rule decides are the labelled examples. Spark's FP-growth mines token
combinations together with the verdict; rules verdict <- tokens that miss the support or confidence
limit, or whose subset already says the same with at least the same confidence, are pruned.
The kept rules match by an inverted index: each rule is posted under its rarest token, a URL looks
up its own tokens and checks the rest of the rule.

The index has a proven bound, whatever the input size: a URL has at most ``MAX_TOKENS`` tokens of
any use to a rule, so at most sum(C(MAX_TOKENS, k), k <= MAX_LENGTH) / min_support combinations
are frequent. It is broadcast on that ground.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.staging import stage

#: The scope list of the pages query: (host, path prefix, verdict).
PAGE_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
              ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Token classes, one token each: scheme, the last labels of the host, first path parts, suffix, query keys.
HOST_LABELS, PATH_PARTS, QUERY_KEYS = 4, 3, 3
MAX_TOKENS = 1 + HOST_LABELS + PATH_PARTS + 1 + QUERY_KEYS
MAX_LENGTH = 3
LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def url_host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; '' if there is none."""
    return F.expr(f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), {LOWER}), '')")


def url_path(url: str) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' if there is none."""
    return F.expr(f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')")


def rule_name(host: str, path: str) -> str:
    return host + path


def listed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits host (or a parent domain) and path; else null."""
    ordered = sorted(rules, key=lambda r: (-len(rule_name(r[0], r[1])), r))
    return F.coalesce(*[
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
               F.struct(F.lit(rule_name(h, p)).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in ordered])


def url_tokens(url: str, host: str, path: str) -> Column:
    """Distinct tokens of a URL: scheme, host labels from the right, path parts, suffix, query keys.

    Numbers stand as '0'. Parts beyond the class sizes above are of no use to a rule and left out.
    """
    return F.expr(f"""array_sort(array_distinct(filter(concat(
        array(concat('scheme=', regexp_extract({url}, '(?s)^(.*?)://', 1))),
        transform(slice(reverse(split({host}, '[.]')), 1, {HOST_LABELS}), (x, i) -> concat('host', i, '=', x)),
        transform(slice(filter(split({path}, '/'), x -> x != ''), 1, {PATH_PARTS}),
                  (x, i) -> concat('path', i, '=', regexp_replace(x, '[0-9]+', '0'))),
        array(concat('suffix=', regexp_extract({path}, '[.]([A-Za-z0-9]+)/?$', 1))),
        transform(slice(split(regexp_extract({url}, '(?s)[?]([^#]*)', 1), '&'), 1, {QUERY_KEYS}),
                  x -> concat('query=', split(x, '=')[0]))
    ), t -> not endswith(t, '='))))""")


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """``labelled``: tokens, verdict. Returns tokens (1 to MAX_LENGTH), verdict, confidence, support; pruned.

    A rule stays if its support and confidence reach the limits, its verdict is more likely with its
    tokens than without (lift above 1), and no rule of fewer of its tokens has at least its confidence.
    """
    baskets = labelled.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    rules = (model.associationRules
             .where(F.col("consequent")[0].startswith("verdict=") & (F.size("antecedent") <= MAX_LENGTH)
                    & ~F.exists("antecedent", lambda t: t.startswith("verdict=")) & (F.col("lift") > 1))
             .select(F.array_sort("antecedent").alias("tokens"), F.expr("substr(consequent[0], 9)").alias("verdict"),
                     "confidence", "support"))
    rules = stage(rules)
    # a shorter rule inside this one: joined through one shared token, both sides are bounded rule lists
    short = rules.select(F.explode("tokens").alias("__t"), F.col("tokens").alias("__s"),
                         F.col("verdict").alias("__v"), F.col("confidence").alias("__c"))
    long = rules.withColumn("__t", F.explode("tokens"))
    beaten = (long.join(short, "__t").where(
        (F.size("__s") < F.size("tokens")) & (F.size(F.array_except("__s", "tokens")) == 0)
        & (F.col("__v") == F.col("verdict")) & (F.col("__c") >= F.col("confidence")))
        .select("tokens", "verdict").distinct())
    return rules.join(beaten, ["tokens", "verdict"], "left_anti")


def inverted_index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """One posting per rule under its rarest token: token, rest, verdict, confidence, support."""
    frequency = labelled.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    posted = rules.withColumn("token", F.explode("tokens")).join(frequency, "token")
    best = posted.groupBy("tokens", "verdict", "confidence", "support").agg(F.min(F.struct("df", "token")).alias("__b"))
    return best.select(F.col("__b.token").alias("token"), "tokens", "verdict", "confidence", "support")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = PAGE_RULES, url: str = "url",
               min_support: float = 0.005, min_confidence: float = 0.8, default: str = "allow") -> DataFrame:
    """All columns of ``pages`` plus host, path, rule, verdict, mined (the tokens of the mined rule).

    A listed rule decides if one fits. Otherwise the matching mined rule of highest confidence, then
    support, then token order decides, ``default`` if none matches or there is nothing to mine.
    Null URLs and URLs without ``://`` have empty host and path and get ``default``. Each distinct
    URL is judged once; repeated rows get the same verdict. Input columns named like a result are
    replaced; no rows give no rows.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "mined")
    urls = (pages.select(F.col(url).alias("__url")).where(F.col("__url").isNotNull()).distinct()
            .withColumn("host", url_host("__url")).withColumn("path", url_path("__url"))
            .withColumn("__listed", listed_rule(F.col("host"), F.col("path"), rules))
            .withColumn("tokens", url_tokens("__url", "host", "path")))
    urls = stage(urls)
    labelled = urls.where("__listed is not null").select("tokens", F.col("__listed.verdict").alias("verdict"))
    index = stage(inverted_index(mine_rules(labelled, min_support, min_confidence), labelled))
    hits = (urls.where("__listed is null").select("__url", F.col("tokens").alias("__have"), F.explode("tokens").alias("token"))
            .join(F.broadcast(index), "token").where(F.size(F.array_except("tokens", "__have")) == 0)
            .groupBy("__url").agg(F.max(F.struct("confidence", "support", "tokens", "verdict")).alias("__hit")))
    judged = urls.join(hits, "__url", "left").select(
        "__url", "host", "path", F.col("__listed.rule").alias("rule"),
        F.coalesce("__listed.verdict", "__hit.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("__listed").isNull(), F.col("__hit.tokens")).alias("mined"))
    return (pages.join(judged, pages[url] == judged["__url"], "left").drop("__url")
            .withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")),
                          "verdict": F.coalesce("verdict", F.lit(default))}))
