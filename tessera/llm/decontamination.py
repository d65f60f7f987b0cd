"""Benchmark decontamination: normalised test n-grams as a broadcast hash set, scanned against every training window.

DataFrame functions only. Windows are hashed for the join and compared word by word after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carry, lower_ascii, restore, stored

#: Whatever is neither a digit, a letter a-z or A-Z, nor outside ASCII.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS = 2_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` worked out once a row."""
    return F.transform(F.array(value), body)[0]


def parts_of(text: Column) -> Column:
    """A text, A-Z lower-cased, parted at gaps; the first and the last part may be empty."""
    # Spark's own lower-casing is far quicker, and does the same to texts of ASCII letters alone.
    return F.split(F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(lower_ascii(text)), GAP)


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(parts_of(F.coalesce(text, F.lit(""))), lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, size: int = 13) -> DataFrame:
    """``key, at, window, items``: every window of every item with the items it occurs in, each window once.

    ``key`` is the window's longest word, of equals the first in order, and ``at`` its first place in the window. An item of fewer than
    ``size`` words, but not none, is one window. Null texts have no words; a null ``item_id`` counts as ''.
    """
    item = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w")).where("size(w) > 0")
    item = item.withColumn("length", F.least(F.size("w"), F.lit(size)))
    windows = let(F.struct("w", "length"), lambda x: F.transform(
        F.sequence(F.lit(1), F.size(x["w"]) - x["length"] + 1), lambda i: F.slice(x["w"], i, x["length"])))
    each = item.select("item", F.explode(windows).alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))
    longest = F.array_max(F.transform("window", lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))["word"]
    return each.withColumn("key", longest).withColumn("at", (F.array_position("window", F.col("key")) - 1).cast("int"))


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """``hit_doc, hit_text, spans, items`` of the documents that hold a window; ``hit_text`` is a hash of the text.

    ``spans`` are the hit word ranges ``[first, end)``, merged and in order. The hash table of windows is keyed by their longest words, so that only
    places of those words are looked at, and there all words of the window are compared. It is broadcast after a count shows at most ``BROADCAST_WINDOWS``; a larger benchmark is joined by shuffling on the word. Hits alone shuffle.
    """
    windows = stored(benchmark_windows(benchmark, size), "benchmark_windows")
    total, shortest = windows.agg(F.count("*"), F.coalesce(F.min(F.length("key")), F.lit(0))).first()
    table = windows.select("key", "at", "window", "items", F.size("window").alias("n"))
    each = (docs.select("doc_id", F.xxhash64("text").alias("hit_text"), parts_of(F.col("text")).alias("w"))
            .select("doc_id", "hit_text", "w", F.posexplode("w").alias("place", "word")).where(F.length("word") >= shortest))
    hit = each.join(F.broadcast(table) if total <= BROADCAST_WINDOWS else table, F.col("word") == F.col("key"))
    hit = hit.where((F.col("place") >= F.col("at")) & (F.slice("w", F.greatest(F.col("place") - F.col("at") + 1, F.lit(1)), F.col("n")) == F.col("window")))
    # A text that begins with a gap has an empty first part.
    first = F.col("place") - F.col("at") - F.when(F.element_at("w", 1) == "", 1).otherwise(0)
    found = hit.select("doc_id", "hit_text", F.struct(first.alias("first"), (first + F.col("n")).alias("end")).alias("span"), "items")
    merge = lambda acc, s: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= s["first"]), F.concat(
        F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["first"].alias("first"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"))))
    ).otherwise(F.concat(acc, F.array(s)))
    spans = F.aggregate(F.array_sort("spans"), F.array().cast("array<struct<first:int,end:int>>"), merge)
    return (found.groupBy(F.col("doc_id").alias("hit_doc"), "hit_text").agg(F.collect_set("span").alias("spans"), F.collect_set("items").alias("items"))
            .select("hit_doc", "hit_text", spans.alias("spans"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("items")))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 13, min_percent: int = 5) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items``, ``spans`` and ``contaminated``; columns of those names are replaced.

    A document is contaminated if at least ``min_percent`` per cent of its words, and one at least, lie inside an occurrence of a
    benchmark window. Null and empty texts have no words and are clean. Rows that repeat a document are judged alike, an empty table on
    either side is fine, and rows of one ``doc_id`` with different texts are kept apart.
    """
    rows = docs.drop("n_words", "n_hit", "items", "spans", "contaminated", "hit_doc", "hit_text", "own_text")
    hits = find_hits(rows, benchmark, size)
    same = F.col("doc_id").eqNullSafe(F.col("hit_doc")) & (F.col("own_text") == F.col("hit_text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"])
    # The hash is a column of its own, so that texts nobody asks for stay out of the shuffle.
    joined = rows.withColumns({"n_words": F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"), "own_text": F.xxhash64("text")}).join(hits, same, "left")
    return (joined.withColumns({"n_hit": F.coalesce(n_hit, F.lit(0).cast("long")), "items": F.coalesce("items", F.array().cast("array<string>")),
                                "spans": F.coalesce("spans", F.array().cast("array<struct<first:int,end:int>>"))})
            .withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= min_percent * F.col("n_words")))
            .drop("hit_doc", "hit_text", "own_text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", size: int = 13, min_percent: int = 5) -> DataFrame:
    """The rows of ``docs`` without contaminated documents, or with the hit words of those documents cut out (``remove="spans"``).

    A cut word takes the gap after it along. Clean documents stay as they are.
    """
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    found = scan(carry(docs, "doc_id", "text"), benchmark, size, min_percent)
    if remove == "documents":
        return restore(found.where(~F.col("contaminated")), docs, "doc_id", "text")
    parts = F.struct(F.filter(F.split("text", GAP), lambda w: w != "").alias("w"), F.split("text", WORD).alias("g"), F.col("spans").alias("s"))
    keep = lambda p: F.concat(p["g"][0], F.array_join(F.transform(F.sequence(F.lit(0), F.size(p["w"]) - 1), lambda i: F.when(
        F.exists(p["s"], lambda s: (i >= s["first"]) & (i < s["end"])), "").otherwise(F.concat(p["w"][i], p["g"][i + 1]))), ""))
    cut = found.withColumn("text", F.when(F.col("contaminated"), let(parts, keep)).otherwise(F.col("text")))
    return restore(cut, docs, "doc_id", "text")
