"""N-gram Jaccard self-join by prefixes under several global token orders.

Two sets as similar as asked must share a token among the first few of each, under every order of all tokens. Prefixes under the first
order (rarest first) make buckets; a pair met there must also share prefix tokens under the other orders before its sets are fetched and compared.

Components need no pair twice: every bucket first compares its members with one of them, and only members that are then still in different
components are compared with each other. Exact copies are one member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from .common import carry, discard, partitions, restore, schema, sliced, squeezed, stored, text_bytes, unsqueezed
from .graph import components, keep_members, likely_members

SKETCH_BITS, BLOCK = 20, 4096
MAX_CACHED_WORDS = 100_000
#: Tokens of the sets that a task keeps while it compares pairs.
MAX_HELD_TOKENS = 1_000_000
SALT_ABOVE = 50_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams, words lower-cased (A-Z) and parted at white space."""

    def __init__(self, size: int):
        self.size, self.words = size, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: A-Z only, and exactly \x20 and \x09-\x0D
        if len(self.words) > MAX_CACHED_WORDS:
            self.words.clear()
        known, digest = self.words, xxhash.xxh3_64_intdigest
        for w in set(words).difference(known):
            known[w] = digest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.size, len(h))
        if not n:
            return h
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = out * _MIX[0] + h[i:len(h) - n + 1 + i]
        return np.unique(mixed(out))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1


def token_counts(docs: DataFrame, size: int) -> np.ndarray:
    """How many documents hold tokens of each of 2**SKETCH_BITS hash buckets: a sketch of fixed size, 8 MB on the driver.

    It only orders tokens, so its collisions cost time, never a result.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, total = Shingler(size), np.zeros(1 << SKETCH_BITS, np.int64)
        for part in sliced(parts):
            found = [shingle(t) for t in text_bytes(part.column("text"))]
            if found:
                buckets, times = np.unique((np.concatenate(found) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                total[buckets] += times
        blocks = [(i, total[i * BLOCK:(i + 1) * BLOCK]) for i in range(len(total) // BLOCK)]
        blocks = [(i, b.astype("<u4" if b.max() < 2**32 else "<u8").tobytes()) for i, b in blocks if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], ["block", "counts"])

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for part in parts:
            for i, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                totals[i] = totals.get(i, 0) + np.frombuffer(b, "<u4" if len(b) == 4 * BLOCK else "<u8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([t.tobytes() for t in totals.values()], pa.binary())], ["block", "counts"])

    block = schema("block int, counts binary")
    # Each task adds its blocks as they stream in and holds their totals only.
    summed = docs.select("text").mapInArrow(count, block).repartition(min(64, partitions(docs.sparkSession)), "block").mapInArrow(add, block)
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for i, b in summed.toLocalIterator():
        total[i * BLOCK:(i + 1) * BLOCK] = np.frombuffer(bytes(b), np.int64)
    return total


PROFILE = StructType([StructField("doc", LongType()), StructField("n", LongType()), StructField("copy_of", BinaryType()),
                      StructField("prefix", ArrayType(LongType())), StructField("salts", ArrayType(IntegerType())),
                      StructField("second", ArrayType(IntegerType())), StructField("third", ArrayType(IntegerType()))])


def profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row per document: set size, fingerprint of the set, and its prefixes under three orders.

    Orders: by the counts' sketch, rarest first; by the count's magnitude, then another hash; by a third hash alone. The last two serve
    as filters and keep 16 bits of each token. A text that the same task has met before has no prefixes: the first one stands for it.
    Rows without an id link with nothing, so they have none either and stand for no other.
    """
    counts = token_counts(docs, size)
    per_salt = max(SALT_ABOVE, 4 * int(counts.mean()))
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # of fixed size
    arrow = to_arrow_schema(PROFILE)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, met, counts = Shingler(size), set(), shared.value
        magnitude = np.frexp(counts)[1].astype(np.uint64)
        short = lambda tokens: np.unique(tokens >> np.uint64(48)).astype(np.int32)
        for part in sliced(parts):
            rows = []
            for doc, text in zip(part.column("doc_id").to_pylist(), text_bytes(part.column("text")), strict=True):
                s = shingle(text)
                if not len(s):
                    rows.append((doc, 0, None, None, None, None, None))
                    continue
                copy_of = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                if doc is None or copy_of in met:
                    rows.append((doc, len(s), copy_of, None, None, None, None))
                    continue
                met.add(copy_of)
                p, bucket = prefix_length(len(s), percent), (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
                first = s[np.lexsort((mixed(s, 1), counts[bucket]))[:p]]
                salts = 1 + counts[(first >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] // per_salt
                other = mixed(s, 2)
                second = short(other[np.lexsort((other, magnitude[bucket]))[:p]])
                third = short(np.sort(mixed(s, 3))[:p])
                rows.append((doc, len(s), copy_of, first.view(np.int64), salts.astype(np.int32), second, third))
            columns = list(zip(*rows, strict=True)) or [()] * len(PROFILE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return docs.select("doc_id", "text").mapInArrow(run, PROFILE)


def _may_link(x: Column, y: Column, percent: int) -> Column:
    """Whether two sets of ``n`` tokens that share the one at place ``at`` of their prefixes can be as similar as asked.

    If it is the first they share, no more tokens are common than it and those behind it in the set with fewer of them. A pair that fails at its
    first shared token fails at all others, so each meeting may be judged as if it were the first.
    """
    most = F.least(x["n"] - x["at"], y["n"] - y["at"])
    return 100 * most >= percent * (x["n"] + y["n"] - most)


LINK = StructType([StructField("a", LongType()), StructField("b", LongType())])


def verified(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets are as similar as asked. Only the texts of documents in some pair are sent, squeezed; sets, which are larger
    than their texts, are built where a pair's texts have met."""
    arrow = to_arrow_schema(LINK)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, known, held = Shingler(size), {}, 0  # sets of texts on the side of ``b``, for most pairs are with one of few leaders
        for part in sliced(parts):
            links = []
            for a, b, frame, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text_b")), unsqueezed(part.column("text_a")),
                                         unsqueezed(part.column("text_b")), strict=True):
                own, other = shingle(x), known.get(frame)
                if other is None:
                    if held > MAX_HELD_TOKENS:
                        known, held = {}, 0
                    other = known[frame] = shingle(y)
                    held += len(other)
                common = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(other) - common):
                    links.append((a, b))
            columns = list(zip(*links, strict=True)) or [()] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    members = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "join_members")
    texts = stored(squeezed(likely_members(docs.select("doc_id", "text"), "doc_id", members, "doc")), "join_texts")
    left, right = (x.select(F.col("doc_id").alias(f"doc_{s}"), F.col("text").alias(f"text_{s}")) for x, s in (
        (texts, "a"), (likely_members(texts, "doc_id", pairs, "b"), "b")))
    met = pairs.select("a", "b").join(left, F.col("a") == F.col("doc_a")).join(right, F.col("b") == F.col("doc_b"))
    links = stored(met.select("a", "b", "text_a", "text_b").mapInArrow(run, LINK), "join_links")
    discard(members, texts)
    return links


def join(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``docs``.

    Documents link when ``100 * intersection >= percent * union`` of their sets of ``size``-word shingles, words lower-cased (A-Z); a text
    of fewer words is one shingle. ``component_id`` is the smallest ``doc_id`` that links reach. Null and empty texts have no shingles and link with
    nothing. Rows of one ``doc_id`` are one document in the graph; a null ``doc_id`` links with nothing and has a null component.
    Extra columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = stored(profiles(docs, size, percent), "join_profiles")
    known = profile.where("doc is not null")
    # Narrow rows, for there are many: size of the set and place in the prefix in one number, and a salt of 0 where the token is not dealt out.
    place = known.select("doc", "n", F.posexplode(F.arrays_zip("prefix", "salts")).alias("at", "p")).select(
        F.col("p.prefix").alias("token"), "doc", (F.shiftleft("n", 32) + F.col("at")).alias("n_at"),
        F.when(F.col("p.salts") > 1, F.pmod(F.xxhash64("doc"), F.col("p.salts")) + 1).otherwise(0).cast("int").alias("salt"))
    whole = F.expr("count(*) over (partition by token, salt)")
    lead = F.expr("min(struct(doc, n_at)) over (partition by token, salt)")
    n_at = lambda x: (F.shiftright(x, 32).alias("n"), x.bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"))
    # A token that the counts show to be frequent is dealt out by salt; the leaders of its salts meet in a second round.
    met = place.withColumns({"members": whole, "lead": lead}).where("members > 1 or salt > 0")
    salted = stored(met.select("token", "doc", *n_at(F.col("n_at")), F.struct("lead.doc", *n_at(F.col("lead.n_at"))).alias("lead")), "join_buckets")
    leads = salted.select("token", "lead").distinct()
    top = leads.groupBy("token").agg(F.min("lead").alias("top"), F.count("*").alias("k")).where("k > 1")
    pair = lambda x, y: (F.greatest(x["doc"], y["doc"]).alias("a"), F.least(x["doc"], y["doc"]).alias("b"))
    me = F.struct("doc", "n", "at")
    star = salted.where((F.col("lead.doc") != F.col("doc")) & _may_link(me, F.col("lead"), percent)).select(*pair(me, F.col("lead")))
    tops = leads.join(top, "token").where((F.col("lead.doc") != F.col("top.doc")) & _may_link(F.col("lead"), F.col("top"), percent)).select(*pair(F.col("lead"), F.col("top")))
    pairs = passing(star.unionAll(tops).distinct(), known)
    links = verified(pairs, docs, size, percent)

    # Members of one bucket that are still apart.
    label = stored(components(links, "join_first"), "join_labels")
    apart = (salted.select("token", "doc", "n", "at").join(label, F.col("doc") == F.col("node"), "left")
             .select("token", "doc", "n", "at", F.coalesce("component", "doc").alias("component")))
    mixed_up = apart.groupBy("token").agg(F.count("*").alias("k"), F.min("component").alias("low"), F.max("component").alias("high")).where("k > 2 and low <> high")
    apart = stored(apart.join(mixed_up.select("token", "low"), "token"), "join_apart")
    # The component of a bucket's first member, mostly the largest, is never paired with itself.
    x, y = apart.where("component <> low").alias("x"), apart.alias("y")
    more = (x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component"))
                   & ((F.col("y.component") == F.col("y.low")) | (F.col("x.doc") > F.col("y.doc")))
                   & _may_link(F.struct("x.n", "x.at"), F.struct("y.n", "y.at"), percent))
            .select(F.greatest("x.doc", "y.doc").alias("a"), F.least("x.doc", "y.doc").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti"))
    second = passing(more, known)
    more_links = verified(second, docs, size, percent)

    first_of = known.where("copy_of is not null").groupBy("copy_of").agg(F.min("doc").alias("b"))
    copies = known.select("copy_of", F.col("doc").alias("a")).join(first_of, "copy_of").where("a <> b").select("a", "b")
    whole_graph = components(links.unionAll(more_links).unionAll(copies), "join_graph")
    sizes = stored(profile.select("doc", "n"), "join_sizes")
    discard(profile, salted, pairs, links, label, apart, second, more_links)
    return (sizes.join(whole_graph, F.col("doc") == F.col("node"), "left")
            .select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")))


def passing(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The pairs that share prefix tokens under the second and the third order as well. Only the prefixes of documents in some pair are shuffled."""
    pairs = stored(pairs, "join_met")
    members = stored(pairs.select(F.explode(F.array("a", "b")).alias("met")).distinct(), "join_met_members")
    some = stored(keep_members(profile.where("prefix is not null").select("doc", "second", "third"), "doc", members, "met"), "join_met_prefixes")
    side = lambda s: some.select(*(F.col(c).alias(f"{c}_{s}") for c in ("doc", "second", "third")))
    left = stored(pairs.join(side("a"), F.col("a") == F.col("doc_a")).join(side("b"), F.col("b") == F.col("doc_b"))
                  .where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")).select("a", "b"), "join_pairs")
    discard(pairs, members, some)
    return left


def keep_first(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the document with the smallest ``doc_id`` stays.

    Rows that repeat the ``doc_id`` that stays, and rows without a ``doc_id``, all stay.
    """
    gone = join(docs, size, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return restore(carry(docs, "doc_id").join(gone, F.col("doc_id") == F.col("gone"), "left_anti"), docs, "doc_id")
