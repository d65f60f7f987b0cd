"""Quality classifier with hierarchical empirical Bayes: a document's own evidence, tempered by what its site and path are like.

A logistic model scores every document from its form. Site and path within it then get a posterior share of good documents each: the global
prior, fitted over all sites, shrinks a site's share, and the site's shrinks its paths', the more the fewer documents stand behind it. A document's log odds move by how
much its path differs from the whole.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FEATURES = ("log_words", "mean_word", "symbol_share", "capital_share", "digit_share", "mark_share", "distinct_share", "dup_line_share", "line_words")
EDGE = 1e-4


def form(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of FEATURES; null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    rows = docs.withColumn("words", F.split(text, r"[\x20\x09-\x0D]+")).withColumn("lines", F.filter(F.split(text, "\n"), lambda x: x != ""))
    size, letters = F.size("words").cast("double"), F.greatest(F.length(text), F.lit(1)).cast("double")
    return rows.withColumns({
        "log_words": F.log1p(size), "mean_word": letters / size, "symbol_share": count(r"[#*$%&|<>]") / size, "capital_share": count("[A-Z]{2,}") / size,
        "digit_share": count("[0-9]") / letters, "mark_share": count("[!?]") / size, "distinct_share": F.size(F.array_distinct("words")) / size,
        "dup_line_share": 1 - F.size(F.array_distinct("lines")) / F.greatest(F.size("lines"), F.lit(1)), "line_words": F.log1p(size / F.greatest(F.size("lines"), F.lit(1)))}).drop("words", "lines")


def odds(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, share: str, centre: Column, n: str) -> float:
    """How many documents the prior is worth (method of moments): large where groups differ no more than chance makes them.

    The spread of the groups' shares, weighted by size, less what sampling explains, against the spread that single documents have.
    """
    c = centre
    row = groups.agg(F.sum(F.col(n) * F.pow(F.col(share) - c, 2)).alias("between"), F.sum(c * (1 - c)).alias("chance"), F.sum(F.col(n) * c * (1 - c)).alias("within"),
                     F.count("*").alias("k")).first()
    if not row.k or not row.within:
        return 1e6
    extra = max((row.between - row.chance) / row.within, 1e-6)  # share of a document's variance that its group explains
    return min(max(1 / extra - 1, 1.0), 1e6)


def classify(docs: DataFrame, labels: DataFrame, site: Column, path: Column, threshold: float = 0.5, train_rows: int = 20_000) -> DataFrame:
    """``doc_id, site, path, p_document, p_site, p_path, p_good, kept`` of every row of ``docs``.

    ``labels`` has ``doc_id`` and ``quality`` (0 or 1); at most ``train_rows`` labelled documents, those with the smallest hashes, fit the model.
    Where these hold one class or none, documents say nothing of their own and have the labels' smoothed share. ``site`` and ``path`` are expressions over ``docs``; null
    ones form groups of their own. Sums behind the groups' posteriors go over all documents, each counted with its probability. Null and empty texts
    are scored as empty; repeated rows alike (each counts in the sums); labels that repeat or are null: the mean of a document's labels, rounded, counts.
    An empty table gives no rows, extra columns are ignored.
    """
    rows = form(docs.select("doc_id", "text", site.cast("string").alias("site"), path.cast("string").alias("path"))).drop("text")
    rows = stored(rows, "quality_form")
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("of_doc")).agg(F.round(F.avg("quality")).cast("double").alias("good"))
    sample = stored(rows.join(known, F.col("doc_id") == F.col("of_doc")).orderBy(F.xxhash64("doc_id"), *FEATURES).limit(train_rows), "quality_sample")
    total, good = sample.agg(F.count("*"), F.coalesce(F.sum("good"), F.lit(0.0))).first()
    if 0 < good < total:
        assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="form")
        model = LogisticRegression(featuresCol="form", labelCol="good", maxIter=50, regParam=0.01).fit(assemble.transform(sample).select("form", "good"))
        model.setRawPredictionCol("").setPredictionCol("")
        rows = model.transform(assemble.transform(rows)).withColumn("p_document", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("p_document", F.lit((good + 1) / (total + 2)))
    rows = stored(rows.select("doc_id", "site", "path", "p_document"), "quality_scores")

    paths = stored(rows.groupBy("site", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p_document").alias("sum")), "quality_paths")
    sites = paths.groupBy(F.col("site").alias("of_site")).agg(F.sum("n").alias("site_n"), F.sum("sum").alias("site_sum"))
    whole = sites.agg(F.sum("site_sum") / F.sum("site_n")).first()[0]
    if whole is None:
        return rows.select("*", *(F.lit(None).cast("double").alias(c) for c in ("p_site", "p_path", "p_good")), F.lit(None).cast("boolean").alias("kept"))
    top = strength(sites.withColumn("share", F.col("site_sum") / F.col("site_n")), "share", F.lit(whole), "site_n")
    sites = sites.withColumn("p_site", (F.col("site_sum") + top * whole) / (F.col("site_n") + top))
    paths = paths.join(sites, F.col("site").eqNullSafe(F.col("of_site"))).withColumn("share", F.col("sum") / F.col("n"))
    low = strength(paths, "share", F.col("p_site"), "n")
    paths = paths.select(F.col("site").alias("of_site"), F.col("path").alias("of_path"), "p_site", ((F.col("sum") + low * F.col("p_site")) / (F.col("n") + low)).alias("p_path"))
    joined = rows.join(paths, F.col("site").eqNullSafe(F.col("of_site")) & F.col("path").eqNullSafe(F.col("of_path")))
    p_good = 1 / (1 + F.exp(-(odds(F.col("p_document")) + odds(F.col("p_path")) - odds(F.lit(whole)))))
    return joined.withColumn("p_good", p_good).select("doc_id", "site", "path", "p_document", "p_site", "p_path", "p_good", (F.col("p_good") >= threshold).alias("kept"))
