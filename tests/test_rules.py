"""Literal questions and what the rules must make of them."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.text import drop_doses, join_doses
from tessera.operators import context as cx, entities as en, understanding as un
from tessera.operators.filters import split_unsupported


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("v")).first()
    return row["v"]


@pytest.mark.parametrize("question, expected", [
    ("How many drugs does Pfizer make?", "count"), ("จำนวนยาของ Pfizer มีกี่ตัว", "count"), ("List all drugs by AstraZeneca", "list"),
    ("รายการยาทั้งหมด", "list"), ("Is paracetamol in the NLEM list?", "verify"), ("ยานี้อยู่ในบัญชียาหลักไหม", "verify"),
    ("paracetamol 500mg", "retrieve"), ("how many items are in this list", "count")])
def test_strategy(spark, question, expected):
    assert one(spark, un.strategy(F.col("q")), q=question) == expected


@pytest.mark.parametrize("question, expected", [
    ("amoxicillin vs ampicillin", True), ("compare paracetamol and ibuprofen", True), ("เปรียบเทียบยาสองชนิด", True), ("what is paracetamol?", False)])
def test_compare(spark, question, expected):
    assert one(spark, un.is_compare(F.col("q")), q=question) is expected


@pytest.mark.parametrize("question, flag, category", [
    ("is this drug in the NLEM list?", True, None), ("ยานี้อยู่ในบัญชียาหลักไหม", True, None), ("can this be reimbursed?", True, None),
    ("tell me about paracetamol", None, None), ("ยาในบัญชี ก", True, "ก"), ("drugs in category B", True, "ข"), ("paracetamol", None, None),
    ("ยาอยู่NLEM ไหม", True, None)])
def test_nlem(spark, question, flag, category):
    row = un.extract_filters(spark.createDataFrame([("a", question)], "query_id string, question string")).first()
    assert (row["nlem_filter"], row["nlem_category"]) == (flag, category)


@pytest.mark.parametrize("question, expected", [
    ("TMTID: 1234567", "1234567"), ("drug 123456", "123456"), ("what is paracetamol?", None), ("There are 12345 drugs", None)])
def test_id(spark, question, expected):
    assert one(spark, un.product_id(F.col("q")), q=question) == expected


@pytest.mark.parametrize("question, value, reason", [
    ("test question", "", "empty"), ("test question", "drug", "noise_term"), ("how many tablets", "how many tablets", "english_question"),
    ("what is paracetamol 500mg?", "paracetamol", None), ("ยา", "ขอข้อมูลยา", "thai_intent_fragment"), ("aspirin please", "ibuprofen", "not_in_question")])
def test_slot_value(spark, question, value, reason):
    assert one(spark, en.reject_reason(F.col("q"), F.lit("drug"), F.col("v")), q=question, v=value) == reason


def test_doses(spark):
    assert one(spark, join_doses(F.col("q")), q="Para 500 MG  and 5 μg/ 2 ml") == "Para 500mg and 5mcg/ 2ml"
    assert one(spark, drop_doses(F.col("q")), q="(para 500 mg)") == "para"


def test_unsupported(spark):
    asked = spark.createDataFrame([("a", "can i reimburse it"), ("b", "what is x"), ("c", " ")], "query_id string, question string")
    kept, refused = split_unsupported(asked)
    assert [r[0] for r in kept.collect()] == ["b"] and [r[0] for r in refused.collect()] == ["a"]
    assert split_unsupported(asked, enabled=True)[0].count() == 2


@pytest.mark.parametrize("question, action, limit", [("top 7 names", "list", 7), ("show 50 items", "list", 20), ("ขอ 3 ชื่อ", "list", 3), ("top 7", "lookup", 5), ("all", "list", 5)])
def test_requested_limit(spark, question, action, limit):
    assert one(spark, cx.requested_limit(F.col("q"), F.col("a")), q=question, a=action) == limit


def test_count_answer(spark):
    rows = spark.createDataFrame([("a", "12", "m"), ("b", "x", "m"), ("c", "3", "")], "query_id string, result string, count_mode string")
    answers = {r["query_id"]: r["answer"] for r in cx.render_counts(rows).collect()}
    assert "12" in answers["a"] and "ไม่พบ" in answers["b"] and answers["c"].startswith("ผลการนับ: 3")


def slots(spark, brand, brands, drugs):
    return spark.createDataFrame(
        [("a", brand, None, None, None, None, brands, drugs, [], [])],
        "query_id string, brand string, drug string, manufacturer string, strength string, form string, multi_brand array<string>, multi_drug array<string>, multi_manufacturer array<string>, entity_texts array<string>")


@pytest.mark.parametrize("question, tmtid, maker, brand, drugs, rule", [
    ("what is tmtid 1234567", "1234567", None, "tmtid 1234567", [], "brand_tmtid_conflict"), ("by Bayer", None, "Bayer", "bayer", [], "brand_manufacturer_conflict"),
    ("by Bayer", None, "Bayer", "made nicely", [], "brand_manufacturer_conflict"), ("compare a vs b", None, None, "xbrand", ["a"], "brand_compare_noise"),
    ("compare a vs b", None, None, "xbrand", [], None), ("about xbrand", None, None, "xbrand", ["a"], None)])
def test_slot_trust(spark, question, tmtid, maker, brand, drugs, rule):
    asked = spark.createDataFrame([("a", question, "retrieve", tmtid, maker)], "query_id string, question string, strategy string, id_lookup string, manufacturer string")
    trusted, dropped = en.slot_trust(slots(spark, brand, [brand], drugs), asked)
    assert [r["rule"] for r in dropped.collect()] == ([rule] if rule else [])
    row = trusted.first()
    assert (row["brand"], row["multi_brand"]) == ((None, []) if rule else (brand, [brand]))


def test_compare_split(spark):
    assert one(spark, F.concat_ws("|", en.split_parts(F.col("q"))), q="Paracetamol กับ Ibuprofen and paracetamol") == "Paracetamol|Ibuprofen"
