"""The catalogue graph and question tables as views over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import lexicon as lx
from ..functions.matching import contains_join
from ..functions.ranking import seeded_hash, top_k
from ..schema import LEVELS, NODE_SCHEMA
from ..operators.understanding import assemble_intent, build_manufacturer_dim
from ..session import materialise
from ..sources.catalogue import Catalogue, store_catalogue

_CATALOGUES: dict[tuple[str, str], Catalogue] = {}
_FACTS: dict[tuple[str, str], DataFrame] = {}
_MAKERS: dict[tuple[str, str], DataFrame] = {}
_QUESTIONS: dict[tuple[str, str], DataFrame] = {}
_STRUCTURED: dict[tuple[str, str], DataFrame] = {}
_REQUESTS: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(df: DataFrame, **columns: Column) -> DataFrame:
    """Fill the node schema; properties not given are null."""
    columns["node_id"] = columns["tmtid"]
    return df.select(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in NODE_SCHEMA.fields])


def _flag(col: str) -> Column:
    return F.when(F.col(col) == "A", 0).when(F.col(col) == "N", 1).otherwise(2)


def _category(size: str) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c, _ in lx.NLEM_CATEGORY_PATTERNS]), (F.col(size) % 5 + 1).cast("int"))


def _ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Parts with their substance and dense ids, and the distinct (part, supplier, flag) facts."""
    part = table(spark, sf_dir, "part")
    # Distinct names are a fixed small vocabulary, so ranking them in one window is safe.
    names = part.select("p_name").distinct().withColumn(
        "vtm", (F.dense_rank().over(Window.orderBy("p_name")) + 5000000000000).cast("string"))
    words = part.select(F.split("p_name", " ")[1].alias("word")).distinct().withColumn(
        "subs", (F.dense_rank().over(Window.orderBy("word")) + 6000000000000).cast("string"))
    gp = (
        part.withColumn("word", F.split("p_name", " ")[1])
        .withColumn("gp", (F.col("p_partkey") + 1000000).cast("string"))
        .withColumn("gp_fsn", F.concat_ws(" ", "p_name", F.col("p_size").cast("string"), F.lit("mg"), F.lower("p_type")))
        .withColumn("dose", F.concat(F.col("p_size").cast("string"), F.lit(" mg"))))
    return names, words, gp, facts(spark, sf_dir)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct (part, supplier, flag) of the line items, stored once per application: nodes and edges are both made of them.

    One row of each part and supplier is marked as their ``first``, so that what there is once for the two need not be shuffled to be told apart again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS:
        # In order, so that the ids made of them lie in order too and take little room.
        names = ("l_partkey", "l_suppkey", "l_returnflag")
        found = table(spark, sf_dir, "lineitem").select(*names).repartition(*names[:2]).distinct()
        first = F.row_number().over(Window.partitionBy(*names[:2]).orderBy(names[2])) == 1
        _FACTS[key] = materialise(found.withColumn("first", first), "facts", compression="zstd")
    return _FACTS[key]


def build_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, words, gp, facts = _ids(spark, sf_dir)
    maker = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("l_suppkey"), F.concat_ws(", ", "s_name", "n_name").alias("maker")))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    generic = dict(name=F.col("p_name"), generic_name=F.col("p_name"), active_substance=F.col("word"),
                   strength=F.col("dose"), dosageform=F.col("p_type"), nlem=F.col("p_size") % 2 == 0,
                   nlem_category=_category("p_size"))
    parts = gp.withColumnRenamed("p_partkey", "l_partkey")
    units = facts.select("l_partkey", "l_returnflag").distinct().join(parts, "l_partkey")

    # Products and units of one pair leave the join together; names are written out after it, so that it shuffles keys and not names.
    made = (facts.join(parts, "l_partkey").join(maker, "l_suppkey")
            .withColumn("pair", F.col("l_partkey") * 1000000000 + F.col("l_suppkey"))
            .withColumn("lv", F.explode(F.when(F.col("first"), F.array(F.lit("TP"), F.lit("TPU"))).otherwise(F.array(F.lit("TPU")))))
            .withColumn("brand", F.concat_ws(" ", "p_brand", "p_name"))
            .withColumn("tp_fsn", F.concat(F.col("brand"), F.lit(" ("), F.col("maker"), F.lit(") ("), F.col("word"),
                                           F.lit(" "), F.col("dose"), F.lit(")"))))
    product = F.col("lv") == "TP"
    branded = dict(name=F.col("brand"), trade_name=F.col("brand"), generic_name=F.col("p_name"),
                   manufacturer=F.col("maker"), active_substance=F.col("word"), strength=F.col("dose"))
    levels = [
        _node(words, tmtid=F.col("subs"), level=F.lit("SUBS"), name=F.col("word"),
              fsn=F.concat("word", F.lit(" (SUBS)"))),
        _node(names, tmtid=F.col("vtm"), level=F.lit("VTM"), name=F.col("p_name"),
              fsn=F.concat("p_name", F.lit(" (VTM)")), active_substance=F.split("p_name", " ")[1]),
        _node(gp.join(vectors, "p_partkey", "left"), tmtid=F.col("gp"), level=F.lit("GP"), fsn=F.col("gp_fsn"),
              embedding_vec=F.col("embedding"), **generic),
        _node(units, tmtid=(F.col("l_partkey") * 4 + _flag("l_returnflag") + 20000000000000).cast("string"),
              level=F.lit("GPU"), fsn=F.concat_ws(" ", "gp_fsn", "l_returnflag"), **generic),
        _node(made, tmtid=F.when(product, F.col("pair") + 3000000000000000000).otherwise(
            F.col("pair") * 4 + _flag("l_returnflag") + 4000000000000000000).cast("string"), level=F.col("lv"),
              fsn=F.when(product, F.col("tp_fsn")).otherwise(F.concat_ws(" ", "tp_fsn", "l_returnflag")), **branded),
    ]
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    return nodes


def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names, words, gp, facts = _ids(spark, sf_dir)
    flags = facts.select("l_partkey", (F.col("l_partkey") * 1000000000 + F.col("l_suppkey")).alias("pair"), _flag("l_returnflag").alias("flag"), "first")
    flags = flags.withColumn("unit", F.col("l_partkey") * 4 + F.col("flag"))
    gp_id = (F.col("l_partkey") + 1000000).cast("string")
    gpu_id = (F.col("unit") + 20000000000000).cast("string")
    tp_id = (F.col("pair") + 3000000000000000000).cast("string")
    tpu_id = (F.col("pair") * 4 + F.col("flag") + 4000000000000000000).cast("string")
    # Suppliers of no part all make the same pair of nulls.
    products = flags.where("first and l_partkey is not null").select("l_partkey", "pair").unionAll(
        flags.where("l_partkey is null").select("l_partkey", "pair").distinct())
    linked = names.withColumn("word", F.split("p_name", " ")[1]).join(words, "word")
    pairs = [
        (linked.select(F.col("subs").alias("a"), F.col("vtm").alias("b")), "IS_ACTIVE_SUBSTANCE_OF", "HAS_ACTIVE_SUBSTANCE"),
        (gp.join(names, "p_name").select(F.col("gp").alias("a"), F.col("vtm").alias("b")), "HAS_VTM", "IS_VTM_OF"),
        (flags.select("l_partkey", "unit").distinct().sortWithinPartitions("unit").select(gp_id.alias("a"), gpu_id.alias("b")), "HAS_GENERIC_UNIT", "IS_GENERIC_UNIT_OF"),
        (products.select(gp_id.alias("a"), tp_id.alias("b")), "HAS_TRADE_PRODUCT", "IS_TRADE_PRODUCT_OF"),
        (flags.select(tp_id.alias("a"), tpu_id.alias("b")), "HAS_TRADE_UNIT", "IS_UNIT_OF_TRADE_PRODUCT"),
        (flags.select(gpu_id.alias("a"), tpu_id.alias("b")), "HAS_TRADE_EQUIVALENT", "IS_TRADE_EQUIVALENT_OF"),
    ]
    edges = None
    for df, forward, backward in pairs:
        both = df.select(F.explode(F.array(
            F.struct(F.col("a").alias("src_id"), F.col("b").alias("dst_id"), F.lit(forward).alias("type")),
            F.struct(F.col("b").alias("src_id"), F.col("a").alias("dst_id"), F.lit(backward).alias("type")))).alias("e")
        ).select(F.concat_ws("|", "e.src_id", "e.type", "e.dst_id").alias("edge_id"), "e.src_id", "e.dst_id", "e.type")
        edges = both if edges is None else edges.unionByName(both)
    return edges


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    """The stored catalogue of one data folder, built once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CATALOGUES:
        _CATALOGUES[key] = store_catalogue(build_nodes(spark, sf_dir), build_edges(spark, sf_dir))
    return _CATALOGUES[key]


def substances(cat: Catalogue) -> DataFrame:
    """One question per substance: (query_id, substance)."""
    return cat.nodes.where("level = 'SUBS'").select(F.col("tmtid").alias("query_id"), F.lower("name").alias("substance"))


def manufacturers(cat: Catalogue) -> DataFrame:
    """Distinct manufacturer names in the catalogue."""
    return cat.nodes.where("level = 'TP' and manufacturer is not null").select("manufacturer").distinct()


def sampled(df: DataFrame, keys: list[str], id_col: str, seed: str, n: int) -> DataFrame:
    """``n`` rows per key in the order of a seeded md5, with their rank ``r``."""
    return top_k(df.withColumn("_h", seeded_hash(seed, id_col)), keys, [F.col("_h"), F.col(id_col)], n, "r").drop("_h")


def manufacturer_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manufacturer names of the catalogue and the nations they come from, stored once per application: a match reads them three times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MAKERS:
        nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("manufacturer"))
        _MAKERS[key] = materialise(build_manufacturer_dim(manufacturers(catalogue(spark, sf_dir)).unionByName(nations)), "manufacturers")
    return _MAKERS[key]


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions asked about sampled nodes: (query_id, question, vec_id)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _QUESTIONS:
        return _QUESTIONS[key]
    cat = catalogue(spark, sf_dir)
    nodes = cat.nodes.select("tmtid", "level", "name", "trade_name", "manufacturer")
    node = sampled(nodes, ["level"], "tmtid", "q", 6)
    name = F.coalesce("trade_name", "name")
    # The nation part alone: a supplier number would itself read as a product id.
    nation = table(spark, sf_dir, "nation").select("n_name", F.lit(1).alias("k"))
    maker = sampled(nation, ["k"], "n_name", "m", 4).select(F.col("n_name").alias("tmtid"), "r")
    subs = node.where("level = 'SUBS'")
    brand = node.where("level = 'TP'")
    pairs = (
        subs.withColumn("p", F.floor((F.col("r") - 1) / 2))
        .groupBy("p").agg(F.min_by("name", "r").alias("a"), F.max_by("name", "r").alias("b"),
                          F.min_by("tmtid", "r").alias("tmtid"), F.count(F.lit(1)).alias("c"))
        .where("c = 2 and p < 2"))

    def ask(df: DataFrame, tag: str, phrase: str, *cols) -> DataFrame:
        return df.select(F.concat_ws("|", F.lit(tag), "tmtid").alias("query_id"),
                         F.format_string(phrase, *cols).alias("question"))

    own = F.regexp_extract("manufacturer", r"(NATION_\d+)$", 1)
    parts = [
        ask(node.where("r <= 2"), "id", "what is tmtid %s", "tmtid"),
        ask(node.where("r = 1"), "gone", "what is tmtid 9%s", F.substring("tmtid", 1, 6)),
        ask(node.where("r > 2 and r <= 4"), "name", "drug information about %s", name),
        ask(subs.where("r <= 3"), "list", "list drugs containing %s", "name"),
        ask(subs.where("r <= 3"), "count", "how many drugs containing %s", "name"),
        ask(subs.where("r <= 2"), "trade", "what are the trade names of %s", "name"),
        ask(subs.where("r <= 2"), "who", "who manufactures %s 28 mg", "name"),
        ask(maker.where("r <= 2"), "maker", "list drugs by manufacturer %s", "tmtid"),
        ask(maker.where("r = 3"), "makercount", "how many products by manufacturer %s", "tmtid"),
        ask(pairs, "compare", "compare %s vs %s", "a", "b"),
        ask(brand.where("r = 5"), "claim", "is %s made by %s", name, own),
        ask(brand.where("r = 6"), "denial", "is %s made by nobody", name),
    ]
    asked = parts[0]
    for p in parts[1:]:
        asked = asked.unionByName(p)
    n_vec = table(spark, sf_dir, "embeddings").count()
    asked = asked.withColumn("vec_id", F.pmod(F.conv(F.substring(F.md5("query_id"), 1, 6), 16, 10).cast("bigint"), F.lit(n_vec)))
    _QUESTIONS[key] = materialise(asked.coalesce(1), "questions")
    return _QUESTIONS[key]


def question_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The substances named by compare questions, as a model's slots would give them."""
    cat = catalogue(spark, sf_dir)
    asked = questions(spark, sf_dir).where("query_id like 'compare|%'").select("query_id", F.lower("question").alias("low"))
    names = cat.nodes.where("level = 'SUBS'").select(F.lower("name").alias("term")).distinct()
    found = contains_join(names, asked, text="low", key="query_id")
    drugs = found.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("multi_drug"))
    none, nil = F.lit(None).cast("string"), F.array().cast("array<string>")
    return drugs.select("query_id", *[none.alias(c) for c in ("brand", "drug", "manufacturer", "strength", "form")],
                        nil.alias("multi_brand"), "multi_drug", nil.alias("multi_manufacturer"), F.col("multi_drug").alias("entity_texts"))


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structured form of every fixture question."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STRUCTURED:
        _STRUCTURED[key] = materialise(assemble_intent(
            questions(spark, sf_dir), manufacturer_dim(spark, sf_dir), question_slots(spark, sf_dir)).coalesce(1), "structured")
    return _STRUCTURED[key]


def text_vectors(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    """Stands for an embedding model: gives every text the stored vector that its md5 picks."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()

    def embed(texts: DataFrame) -> DataFrame:
        pick = F.pmod(F.conv(F.substring(F.md5("text"), 1, 6), 16, 10).cast("bigint"), F.lit(n))
        return texts.withColumn("vec_id", pick).join(vectors, "vec_id").select("text", "embedding")

    return embed


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search requests about sampled nodes, with every kind of filter among them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _REQUESTS:
        node = sampled(catalogue(spark, sf_dir).nodes.drop("embedding_vec"), ["level"], "tmtid", "q", 6)
        r = F.col("r")
        levels = (F.when(r == 1, F.array(*[F.lit(lv) for lv in LEVELS])).when(r == 2, F.array(F.lit("TP"), F.lit("TPU")))
                  .when(r == 3, F.array(F.lit("GP"))))
        _REQUESTS[key] = materialise(node.select(
            F.concat(F.lit("r|"), "tmtid").alias("query_id"), F.coalesce("trade_name", "name").alias("text"), levels.alias("levels"),
            F.when(r == 3, F.lit(True)).alias("f_nlem"), F.when((r == 3) & (F.col("level") == "GPU"), "ก").alias("f_nlem_category"),
            F.when((r == 4) & F.col("manufacturer").isNotNull(), F.regexp_extract("manufacturer", r"(NATION_\d+)$", 1)).alias("f_manufacturer"),
            F.when(r == 5, F.col("tmtid")).alias("f_tmtid"), F.array(F.coalesce("generic_name", "name")).alias("seed_terms"),
            F.lit(0.4).alias("v_weight"), F.lit(0.35).alias("t_weight"), F.lit(0.25).alias("g_weight"),
            F.when(r % 2 == 0, "lookup").otherwise("retrieve").alias("strategy"), F.lit(10).alias("k"), F.lit(2).alias("hops"),
            "tmtid").coalesce(1), "search_requests")
    return _REQUESTS[key]


def request_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored vector for every search request, picked by md5."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = vectors.count()
    pick = F.pmod(F.conv(F.substring(F.md5("query_id"), 1, 6), 16, 10).cast("bigint"), F.lit(n))
    return search_requests(spark, sf_dir).select("query_id", pick.alias("vec_id")).join(vectors, "vec_id").select("query_id", "embedding")


def templated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One English question per part, in twelve phrasings."""
    part = table(spark, sf_dir, "part").withColumn("word", F.split("p_name", " ")[1]).withColumn("adj", F.split("p_name", " ")[0])
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    nation = F.concat(F.lit("NATION_"), (key % 25).cast("string"))
    letter = F.substring(F.lit("abcde"), (F.col("p_size") % 5 + 1).cast("int"), F.lit(1))
    phrases = [
        F.concat(F.lit("what is tmtid "), (key + 1000000).cast("string")), F.concat(F.lit("drug information about "), "p_name"),
        F.concat(F.lit("list drugs containing "), "word"), F.concat(F.lit("how many drugs containing "), "word", F.lit(" "), size, F.lit(" mg")),
        F.concat(F.lit("list drugs by manufacturer "), nation), F.concat(F.lit("compare "), "word", F.lit(" vs "), "adj"),
        F.concat(F.lit("is "), "p_brand", F.lit(" "), "p_name", F.lit(" made by "), nation, F.lit("?")),
        F.concat(F.lit("show all "), F.lower("p_type"), F.lit(" "), "p_name", F.lit(" in category "), letter),
        F.concat(F.lit("hello "), "p_name"), F.concat(F.lit("does "), "p_name", F.lit(" "), size, F.lit("mg exist in the nlem list")),
        F.concat(F.lit("what are the trade names of "), "word", F.lit(" "), size, F.lit(" mg")), F.concat(F.lit("who manufactures "), "p_name")]
    return part.select(F.concat(F.lit("p|"), key.cast("string")).alias("query_id"),
                       F.element_at(F.array(*phrases), (key % 12 + 1).cast("int")).alias("question"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templated questions and every user turn of the conversations."""
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select(
        F.concat_ws("|", F.lit("c"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("question"))
    return templated(spark, sf_dir).unionByName(turns)
