"""Quality rules, decontamination, url filters, licence scans, classifier and their corner cases."""

import brute
import pytest
from conftest_helpers import rows
from pyspark.sql import functions as F

from tessera.llm import decontamination, license_scans, quality_classifier, quality_rules, url_filters
from tessera.llm.queries import URL_RULES


# ---------------------------------------------------------------- quality rules
def test_counts_equal_brute_force(docs, made):
    found = quality_rules.apply_rules(docs)
    want = sorted((d, *brute.quality_counts(t)) for d, t in made)
    assert rows(found, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert found.where("base_failed and kept").count() == 0


@pytest.mark.parametrize("n", [1, 7, 8, 9, 40])
def test_repeated_words_of_runs(n):
    import numpy as np

    assert quality_rules.repeated_words(np.zeros(n, np.int64), 8) == (n if n > 8 else 0)
    assert quality_rules.repeated_words(np.arange(n), 8) == 0


def test_limits_follow_each_source(spark):
    """Where half the words carry a mark in every text, that is no reason to go; elsewhere it is."""
    plain = " ".join(f"word{i} text{i}" for i in range(30))
    marked = " ".join(f"word{i} text{i}#" for i in range(30))
    table = [(i, plain.replace("word", f"w{i}"), "en", "prose") for i in range(300)] + [(i, marked.replace("word", f"w{i}"), "en", "tags") for i in range(300, 600)]
    table += [(600, marked, "en", "prose"), (601, marked, "en", "tags"), (602, plain, None, None), (603, None, "en", "prose"), (604, "", "xx", None)]
    kept = dict(rows(quality_rules.apply_rules(spark.createDataFrame(table, "doc_id long, text string, lang string, source string")), "doc_id", "kept"))
    assert all(kept[i] for i in range(600)) and not kept[600] and kept[601] and kept[602] and not kept[603] and not kept[604]


def test_verdicts_do_not_depend_on_partitions(docs):
    """Limits and verdicts are the same in every run and under every partitioning."""
    judged = [rows(quality_rules.apply_rules(d, min_rows=10).withColumn("failed", F.array_join("failed", ",")), "doc_id", "failed", "kept") for d in (docs, docs, docs.coalesce(1), docs.repartition(13))]
    assert judged[0] == judged[1] == judged[2] == judged[3] and any(r[1] for r in judged[0])


def test_sketched_quantiles_are_as_accurate_as_asked(spark):
    import random

    rng = random.Random(2)
    names = list(quality_rules.MEASURES)
    values = {g: sorted(0.0 if rng.random() < 0.05 else rng.lognormvariate(0, 2) for _ in range(3000)) for g in "ab"}
    table = [(g, *([v] * len(names))) for g, vs in values.items() for v in vs]
    df = spark.createDataFrame(table, "lang string, " + ", ".join(f"{m} double" for m in names)).withColumn("source", F.lit("s"))
    sketch = quality_rules.sketched(df, 0.01)
    for r in quality_rules.quantiles(sketch, 0.01, "lang").collect():
        for q, got in zip(quality_rules.QUANTILES, (r.q0, r.q1)):
            assert r.rows == 3000 and got == pytest.approx(values[r.lang][int(q * 3000) - 1], rel=0.0051)
    assert {r.rows for r in quality_rules.quantiles(sketch, 0.01).collect()} == {6000}


def test_keep_good_returns_the_rows_as_they_are(docs, none, made):
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and {r.n_words for r in kept.select("n_words").distinct().collect()} <= {"clash"}
    assert quality_rules.keep_good(none).collect() == [] and quality_rules.apply_rules(none).collect() == []


# ---------------------------------------------------------------- benchmark decontamination
ITEMS = [(1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf"), (2, "short item, five words only"), (3, None), (4, "..."),
         (5, "THE QUICK brown fox jumps over the lazy dog and runs away from É"), (None, "one more item of no id whatsoever"), (1, "short item, five words only")]
TEXTS = [(1, "x y z " + ITEMS[0][1].upper() + " tail"), (2, ITEMS[0][1]), (3, "short item FIVE words"), (4, " - short item; five/words only " + "filler " * 200), (5, None), (6, ""),
         (7, "the quick brown fox jumps over the lazy dog and runs away from é"), (8, "the quick brown fox jumps over the lazy dog and runs away from É"), (9, "one more item of no id whatsoever"),
         (2, ITEMS[0][1]), (2, "clean words"), (10, "a " * 5000 + "short item five words only")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_hit", "hit_doc", "key", "at", "window", "w", "word", "items")})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("hash", F.lit(1))


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_hits_equal_brute_force(texts, items, monkeypatch, limit):
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", limit)
    found = decontamination.scan(texts, items)
    got = rows(found.select("doc_id", "n_words", "n_hit", F.size("items").alias("k"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("sha"), "contaminated"),
               "doc_id", "n_words", "n_hit", "k", "sha", "contaminated")
    assert got == sorted(brute.benchmark_hits(TEXTS, ITEMS))


def test_documents_or_spans_go(texts, items, none):
    bad = {d for d, _, _, _, _, c in brute.benchmark_hits(TEXTS, ITEMS) if c}
    left = decontamination.decontaminate(texts, items)
    assert left.columns == texts.columns and [d for d, in rows(left, "doc_id")] == sorted(d for (d, *_, c) in brute.benchmark_hits(TEXTS, ITEMS) if not c)
    cut = decontamination.decontaminate(texts, items, remove="spans")
    assert cut.count() == len(TEXTS) and {r.text for r in cut.where("doc_id = 1").collect()} == {"x y z tail"}
    again = decontamination.scan(cut, items)
    assert again.where("contaminated").count() == 0 and bad
    assert decontamination.scan(texts, items.where("false")).where("contaminated").count() == 0
    assert decontamination.scan(texts.where("false"), items).collect() == []


# ---------------------------------------------------------------- url filters
URLS = [("https://www.Example.com/en/1", "www.example.com", "/en/1", "www.example.com/en/", "allow"), ("http://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
        ("http://a.example.com/en/x?y=/z#q", "a.example.com", "/en/x", "example.com/en/", "block"), ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("http://x.net/fr/", "x.net", "/fr/", "net/fr/", "block"), ("http://x.net/en/", "x.net", "/en/", None, None), ("http://com", "com", "", None, None),
        ("ftp://X.COM?a://b/c", "x.com", "", None, None), ("no scheme.com/", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("://\n.com/é", "\n.com", "/é", "com/", "allow"), ("http://ÀB.net/es/" + "x" * 5000, "Àb.net", "/es/" + "x" * 5000, "net/es/", "block")]


def test_urls_are_parted_and_ruled(spark):
    pages = spark.createDataFrame([(i, u[0]) for i, u in enumerate(URLS)], "page_id long, url string").withColumns({"host": F.lit("clash"), "bad": F.lit("clash"), "tld_key": F.lit("clash")})
    labelled = pages.select("url", F.lit(0).alias("bad"))
    got = url_filters.judge_urls(pages, labelled, URL_RULES)
    assert rows(got, "page_id", "host", "path", "rule") == [(i, *u[1:4]) for i, u in enumerate(URLS)]
    assert [r.verdict for r in got.orderBy("page_id").collect()] == [u[4] or "allow" for u in URLS]
    assert url_filters.judge_urls(pages.where("false"), labelled, URL_RULES).collect() == []
    assert url_filters.judge_urls(pages, labelled.where("false"), URL_RULES).where("verdict is null").count() == 0
    with pytest.raises(ValueError):
        url_filters.matching_rule(F.col("host"), F.col("path"), [("a/", "allow")] * 1001)


def test_trees_learn_on_held_out_urls(spark):
    def url(i):
        return f"http://www.site{i % 40}.example/{'x9' * (i % 5 + 6)}{i}?a={i}&b={i}&c=1" if i % 3 == 0 else f"https://site{i % 40}.example/page/about-{'abcdefg'[i % 7]}"

    table = spark.createDataFrame([(i, url(i), int(i % 3 == 0)) for i in range(1200)], "page_id long, url string, bad int")
    judged = url_filters.judge_urls(table.where("page_id % 4 = 0").drop("bad"), table.where("page_id % 4 <> 0").select("url", "bad"), [], trees=4, depth=3)
    right = judged.join(table.select("page_id", "bad"), "page_id").where((F.col("verdict") == "block") == (F.col("bad") == 1)).count()
    assert right >= 0.95 * 300


def test_labels_without_signal_block_nothing(spark):
    """Labels drawn by chance: nothing is blocked, though each labelled url is judged itself."""
    import random

    rng = random.Random(4)
    table = spark.createDataFrame([(f"https://site{i % 50}.example/page-{i:05d}", int(rng.random() < 0.15)) for i in range(4000)], "url string, bad int")
    judged = url_filters.judge_urls(table.select("url"), table, [])
    assert judged.where("verdict = 'block'").count() == 0 and judged.count() == 4000


def area_under_curve(scored):
    """Share of pairs of a bad and a good url that the scores order rightly."""
    bad, good = ([p for p, b in scored if b == x] for x in (1, 0))
    return sum((p > q) + (p == q) / 2 for p in bad for q in good) / (len(bad) * len(good))


@pytest.mark.parametrize("label", ["1 - quality", "toxic", "greatest(1 - quality, toxic)"])
def test_held_out_urls_of_the_given_tables(spark, label):
    """Urls of these pages say nothing of their documents' labels: on held-out urls the trees are near chance, and so they block none."""
    sf = "/root/testdata/sf0.1"
    number = F.regexp_extract(url_filters.url_path(F.col("url")), r"/(\d+)(?:\.\w+)?/?$", 1)
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("url", number.try_cast("long").alias("doc_id"))
    known = pages.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("url", "doc_id", F.expr(label).alias("bad"))
    judged = url_filters.judge_urls(known.where("doc_id % 2 = 1").drop("bad"), known.where("doc_id % 2 = 0"), []).join(known.select("doc_id", "bad"), "doc_id")
    scored = [(r.p_block, r.bad) for r in judged.collect()]
    assert len(scored) > 300 and 0.35 < area_under_curve(scored) < 0.65
    assert judged.where("verdict = 'block'").count() <= 0.02 * len(scored)


def test_suffix_rates_count_every_label(spark):
    """A site whose labelled urls all hash into the half that the trees' sample is drawn from, beyond that sample, is judged by its labels."""
    known = [(f"https://s{i % 30}.example/page-{i:06d}", int(i % 30 < 9)) for i in range(3000)]
    rare = spark.range(600).select(F.format_string("https://rare.example/page-%06d", "id").alias("url")).where(F.xxhash64("url", F.lit("part")) % 2 == 0)
    largest = rare.where(F.xxhash64("url") > 0).limit(100).withColumn("bad", F.lit(1))
    labelled = spark.createDataFrame(known, "url string, bad int").unionAll(largest)
    asked = spark.createDataFrame([("https://rare.example/page-900000",), ("https://s3.example/page-900001",), ("https://s20.example/page-900002",)], "url string")
    got = {r.url: r.verdict for r in url_filters.judge_urls(asked, labelled, [], train_rows=400, trees=4, depth=3).collect()}
    assert list(map(got.get, (r.url for r in asked.collect()))) == ["block", "block", "allow"]


def test_all_labelled_urls_take_part(spark, monkeypatch):
    """Beyond 20,000 urls too, one half of them fits the trees and the other gives their rates."""
    labelled = spark.range(42000).select(F.format_string("https://s%d.example/page-%06d", F.col("id") % 30, F.col("id")).alias("url"), (F.col("id") % 30 < 9).cast("int").alias("bad"))
    sizes, stored = {}, url_filters.stored

    def counted(df, name):
        out = stored(df, name)
        sizes[name] = out.count() if name == "url_sample" else out.agg(F.sum("site_n")).first()[0] if name == "url_train_site" else None
        return out

    monkeypatch.setattr(url_filters, "stored", counted)
    url_filters.judge_urls(labelled.limit(1).select("url"), labelled, [], trees=1, depth=1)
    half = labelled.where(F.xxhash64("url", F.lit("part")) % 2 == 0).count()
    assert half > 20000 and sizes["url_sample"] == half and sizes["url_train_site"] == 42000 - half


# ---------------------------------------------------------------- licence scans
def test_licences_of_lines_and_folders(spark):
    mit = license_scans.TEMPLATES[1][1]
    prose = "\n".join(f"Some words about the weather number {i} and of the sea." for i in range(40))
    files = [("a/LICENSE", mit, True), ("a/b/x.txt", prose, False), ("a/b/c/y.txt", prose + "\nLicensed under the Apache License, Version 2.0.\n" + prose, False), ("a/b/c/z.txt", None, None),
             ("a/b/c/LICENSE", "Released under the MIT License.", True), ("d/q.txt", "", False), ("LICENSE.other", "This work is licensed under the GNU General Public License, version 3.", True),
             (None, "Released under the MIT License.", False), ("a/b/c/z.txt", None, None), ("e/f.txt", "the License", False)]
    df = spark.createDataFrame(files, "path string, text string, is_licence_file boolean").withColumns({c: F.lit("clash") for c in ("line", "term", "score", "of_path", "depth", "giver", "near", "in_folder")})
    got = {(r.path, r.text): (r.own_licence, r.licence, r.inherited_from) for r in license_scans.scan(df).collect()}
    assert got == {("a/LICENSE", mit): ("MIT", "MIT", None), ("a/b/x.txt", prose): (None, "MIT", "a"), files[2][:2]: ("Apache-2.0", "Apache-2.0", None), ("a/b/c/z.txt", None): (None, "MIT", "a/b/c"),
                   files[4][:2]: ("MIT", "MIT", None), ("d/q.txt", ""): (None, "GPL-3.0", ""), files[6][:2]: ("GPL-3.0", "GPL-3.0", None), files[7][:2]: ("MIT", "MIT", None),
                   ("e/f.txt", "the License"): (None, "GPL-3.0", "")}
    assert license_scans.scan(df).count() == len(files) and license_scans.scan(df.where("false")).collect() == []


# ---------------------------------------------------------------- quality classifier
def test_sites_temper_documents(spark):
    good, bad = "Plain words stand here in lines.\nAnd some more of them follow there.", "BUY!!! NOW### 99$ $$$ BUY!!! NOW### 99$ $$$ BUY!!!"
    table = [(i, f"{good} n{i}" if i % 10 else f"{bad} {i}", "clean" if i < 400 else "mixed", "p") for i in range(600)] + [(i, f"{bad} {i}", "spam", "p") for i in range(600, 900)]
    table += [(900, None, None, None), (901, "", "clean", "p"), (902, good, "spam", "p"), (903, good, "clean", "p"), (903, good, "clean", "p")]
    docs = spark.createDataFrame(table, "doc_id long, text string, source string, lang string").withColumns({c: F.lit("clash") for c in ("site", "words", "n", "share", "form", "of_doc")})
    labels = spark.createDataFrame([(i, int(i < 600 and bool(i % 10))) for i in range(0, 900, 2)] + [(None, 1), (4, None)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_classifier.classify(docs, labels, F.col("source"), F.col("lang")).collect()}
    assert len(out) == 904 and sum(out[i].kept == bool(i < 600 and i % 10) for i in range(1, 900, 2)) >= 440
    assert out[902].p_good < out[903].p_good and out[902].p_path < out[903].p_path
    none = labels.where("false")
    assert quality_classifier.classify(docs, none, F.col("source"), F.col("lang")).where("kept is null").count() == 0
    assert quality_classifier.classify(docs.where("false"), labels, F.col("source"), F.col("lang")).collect() == []
