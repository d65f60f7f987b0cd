"""URL filters: fixed rules first, then gradient-boosted trees on lexical features of the url.

Everything runs as DataFrame expressions and Spark's own tree learner; no Python touches a row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

ALLOW, BLOCK = "allow", "block"
MAX_RULES = 1000
FEATURES = ("url_length", "host_length", "path_length", "host_labels", "path_depth", "digit_ratio", "longest_digits", "hyphens",
            "other_marks", "entropy", "parameters", "has_fragment", "is_https", "tld_rate", "tld_share", "site_rate", "site_share")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or without ``://``."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that fits a url and its verdict, null where none does.

    A rule ``host/path`` fits its host and all subdomains if the url's path starts with the rule's. The longest
    rule wins; of equally long ones the first in alphabetical order. The rules become one expression, so there may be
    at most ``MAX_RULES`` of them.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # The last WHEN to be wrapped around is the first to be tried.
    for text, action in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    return F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0),
                       lambda acc, c: acc - F.when((F.length(c) > 0) & (share(c) > 0), share(c) * F.log2(share(c))).otherwise(0.0))


def lexical_features(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with ``host``, ``path``, the host's two suffixes and the numeric columns of FEATURES that need no statistics."""
    u = F.coalesce(F.col(url), F.lit(""))
    labels = F.split(F.col("host"), r"\.")
    tail = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - (n - 1), F.lit(1)), n))
    count = lambda pattern: F.regexp_count(u, F.lit(pattern)).cast("double")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return (urls.withColumn("host", url_host(F.col(url))).withColumn("path", url_path(F.col(url)))
            .withColumns({
                "tld": tail(1), "site": tail(3),
                "url_length": F.length(u).cast("double"), "host_length": F.length("host").cast("double"),
                "path_length": F.length("path").cast("double"), "host_labels": F.size(labels).cast("double"),
                "path_depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
                "digit_ratio": count("[0-9]") / F.greatest(F.length(u), F.lit(1)),
                "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(u, F.lit("([0-9]+)"), 1), F.length)), F.lit(0)).cast("double"),
                "hyphens": count("-"), "other_marks": count("[^A-Za-z0-9:/?#.&=-]"), "entropy": _entropy(u),
                "parameters": F.when(F.length(query) > 0, F.regexp_count(query, F.lit("&")) + 1).otherwise(0).cast("double"),
                "has_fragment": F.instr(u, "#").cast("boolean").cast("double"), "is_https": u.startswith("https:").cast("double")}))


def _suffix_rates(labelled: DataFrame, suffix: str) -> DataFrame:
    """Per suffix: number of labelled urls and of bad ones."""
    return labelled.groupBy(F.col(suffix).alias(f"{suffix}_key")).agg(F.count("*").alias(f"{suffix}_n"), F.sum("bad").alias(f"{suffix}_bad"))


def _with_rates(rows: DataFrame, stats: dict[str, DataFrame], rate: float, total: float, weight: float) -> DataFrame:
    """Smoothed bad rate and share of each suffix; a row's ``own_n`` labels, ``own_bad`` of them bad, do not count."""
    for suffix, stat in stats.items():
        seen, bad = (F.coalesce(f"{suffix}_{x}", F.lit(0)).cast("double") - F.col(f"own_{x}") for x in ("n", "bad"))
        rows = rows.join(stat, F.col(suffix) == F.col(f"{suffix}_key"), "left").withColumns(
            {f"{suffix}_rate": (bad + weight * rate) / (seen + weight), f"{suffix}_share": seen / total})
    return rows


def safe_threshold(held: DataFrame, least: float, precision: float) -> float:
    """The smallest threshold from ``least`` on above which held-out urls are bad at a rate of ``precision`` or more, beyond chance.

    ``held`` has ``p_block`` and ``bad``. Of each threshold, in hundredths, the lower end of the 95 per cent Wilson interval of the blocked urls'
    rate counts. Where no threshold will do, the result is above 1, so a model without signal blocks nothing.
    """
    cells = held.groupBy(F.floor(F.col("p_block") * 100).alias("cell")).agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).collect()  # at most 101 rows
    best = 2.0
    for t in range(math.ceil(100 * least), 101):
        n, bad = (sum(c[x] for c in cells if c["cell"] >= t) for x in ("n", "bad"))
        if n:
            z, p = 1.96, bad / n
            low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if low >= precision:
                return t / 100
    return best


def judge_urls(urls: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url", threshold: float = 0.5,
               train_rows: int | None = None, trees: int = 12, depth: int = 4, weight: float = 20.0, precision: float = 0.5) -> DataFrame:
    """``urls`` with ``host``, ``path``, ``rule``, ``p_block`` and ``verdict``.

    ``labelled`` (columns ``url`` and ``bad``, 0 or 1) gives the statistics of host suffixes and the training set. One half by a hash fits the
    trees and the other half gives their suffix rates, so that no label is among the features it trains and every label is used. With ``train_rows``
    only so many of the first half, those with the smallest hashes, fit the trees, and all others give the rates. The urls to judge get their rates from all labels but their own. A quarter of the sample, by a third
    hash, is held out of the fit: a url is blocked above the smallest threshold, ``threshold`` at least, at which held-out urls are bad at a rate of
    ``precision`` or more beyond chance, and none is if there is no such threshold. Where the sample holds a single class or none,
    ``p_block`` is the smoothed rate of all labels, held against ``threshold`` itself.
    A rule's verdict stands above the trees'. Null urls have empty parts, fit no rule and are judged by their features;
    repeated rows are judged alike; an empty table gives an empty result. Extra columns stay; those of the names made
    here are replaced.
    """
    made = {*FEATURES, "host", "path", "tld", "site", "rule", "verdict", "p_block", "bad", "own_n", "own_bad", "own_url", "held"}
    urls = urls.drop(*(c for c in urls.columns if c in made and c != url))
    known = labelled.select(F.col("url").alias(url), F.col("bad").cast("double").alias("bad")).where("bad is not null")
    known = stored(lexical_features(known, url), "url_labels")
    total, bad = known.agg(F.count("*"), F.coalesce(F.sum("bad"), F.lit(0.0))).first()
    rate = (bad + 1.0) / (total + 2.0)
    own = known.groupBy(F.col(url).alias("own_url")).agg(F.count("*").cast("double").alias("own_n"), F.sum("bad").alias("own_bad"))
    rows = lexical_features(urls, url).join(own, F.col(url) == F.col("own_url"), "left").drop("own_url").fillna(0.0, ["own_n", "own_bad"])
    for_trees = F.xxhash64(url, F.lit("part")) % 2 == 0
    sample = known.where(for_trees).orderBy(F.xxhash64(url), url, "bad")  # in one order, for the same trees in every run
    sample = stored(sample if train_rows is None else sample.limit(train_rows), "url_sample")
    classes = sample.where(F.xxhash64(url, F.lit("held")) % 4 != 0).agg(F.min("bad"), F.max("bad")).first()
    if tuple(classes) == (0.0, 1.0):
        last = sample.agg(F.max(F.xxhash64(url))).first()[0]
        outside = known.where(~(for_trees & (F.xxhash64(url) <= F.lit(last).cast("long"))))
        apart, stats = ({s: stored(_suffix_rates(rest, s), f"url_{name}_{s}") for s in ("tld", "site")} for name, rest in (("train", outside), ("all", known)))
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="lexical")
        held = (F.xxhash64(url, F.lit("held")) % 4 == 0).alias("held")
        train = sample.withColumns({"own_n": F.lit(0.0), "own_bad": F.lit(0.0)})
        train = stored(assemble.transform(_with_rates(train, apart, rate, float(max(1, outside.count())), weight)).select("lexical", "bad", held), "url_train")
        model = GBTClassifier(featuresCol="lexical", labelCol="bad", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=1).fit(train.where("not held"))
        model.setRawPredictionCol("").setPredictionCol("")
        score = lambda df: model.transform(df).withColumn("p_block", vector_to_array("probability")[1])
        threshold = safe_threshold(score(train.where("held")), threshold, precision)
        rows = score(assemble.transform(_with_rates(rows, stats, rate, float(total), weight)))
    else:
        rows = rows.withColumn("p_block", F.lit(rate))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    by_model = F.when(F.col("p_block") >= threshold, BLOCK).otherwise(ALLOW)
    return rows.withColumns({"rule": rule, "verdict": F.coalesce(verdict, by_model)}).select(
        *urls.columns, "host", "path", "rule", "p_block", "verdict")
