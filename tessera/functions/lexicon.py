"""Word lists, patterns and constants that decide results.

Everything below is a fixed value: it must keep exactly this content for the
answers to stay the same.
"""

from __future__ import annotations

# ---------------------------------------------------------------- tokens, doses
# Fixed values.
TOKEN = r"[A-Za-z0-9\-\./%]+|[฀-๿]+"
NUMBER = r"\d+(?:\.\d+)?"
DOSE_UNITS = ("mg", "mcg", "g", "ml", "iu", "%")
DOSE_UNIT_ALT = "mg|mcg|g|ml|iu|%"
DOSE_UNIT_ALL = "mg|mcg|μg|ug|g|ml|iu|%"
EDGE_MARKS = r"""^[ ,.;:()\[\]{}"']+|[ ,.;:()\[\]{}"']+$"""
UNIT_TOKEN = r"^\d+(?:\.\d+)?(?:mg|g|mcg|ml|iu|%)?$"
DOSE_PHRASE = r"\b\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml|iu|%)\b"
PREFIXED_ID = r"\b(?:tmtid|tmt-id|tmt)\s*[:#]?\s*(\d{5,10})\b"
BARE_ID = r"\b\d{6,10}\b"

# ---------------------------------------------------------------- what is asked
# Patterns of each kind of question.
COUNT_PATTERNS = (r"\bhow many\b", r"\bcount\b", r"\bnumber of\b", "กี่", "จำนวน", "นับ")
LEADING_VERIFY = (
    r"^\s*(?:is|are|was|were|does|do|did|can|could|should|will|would|has|have|had)\b",)
LIST_PATTERNS = (r"\blist\b", r"\bshow all\b", r"\ball\b", "รายการ", "รายชื่อ", "แสดง", "ทั้งหมด")
VERIFY_PATTERNS = (r"\bis\b", r"\bdoes\b", r"\bcan\b", r"\bexists?\b", "ไหม", "หรือไม่", "ใช่", "จริง")
COMPARE_PATTERNS = (r"\bcompare\b", r"\bdifference\b", r"\bvs\.?\b", "เปรียบเทียบ", "เทียบ", "ต่างกัน")
GREETING_PATTERNS = (r"^hi\b", r"^hello\b", r"^hey\b", "^สวัสดี")
GREETING_MAX_WORDS = 8

# Essential-medicine flag and category.
NLEM_PATTERNS = (r"\bnlem\b", r"\bed\b", r"\bned\b", "บัญชียาหลัก", "เบิก", "สิทธิ", "reimburse", "reimbursement")
NLEM_CATEGORY_PATTERNS = (
    ("ก", (r"บัญชี\s*ก", r"category\s*a", r"cat\s*a")),
    ("ข", (r"บัญชี\s*ข", r"category\s*b", r"cat\s*b")),
    ("ค", (r"บัญชี\s*ค", r"category\s*c", r"cat\s*c")),
    ("ง", (r"บัญชี\s*ง", r"category\s*d", r"cat\s*d")),
    ("จ", (r"บัญชี\s*จ", r"category\s*e", r"cat\s*e")),
)
# Questions set aside unless essential-medicine answers are enabled.
UNSUPPORTED_PATTERNS = (r"\bnlem\b", "บัญชียาหลัก", "เบิกได้", "เบิก", "reimburse", "reimbursement",
                        "essential medicines?", "national list")

# Words that never name an entity.
EN_STOPWORDS = ("what", "which", "with", "that", "this", "drug", "medicine", "please", "help", "show", "list",
                "count", "does", "is", "are", "can", "do", "did", "make", "made", "manufacture",
                "manufacturer", "tmtid")
ENTITY_NOISE = EN_STOPWORDS + ("drugs", "medicines", "data", "info", "query", "ยา", "ข้อมูล", "ขอ", "ระหว่าง",
                               "เปรียบเทียบ", "เปรย", "บเทยบ", "รายการ", "ทั้งหมด")
CONNECTORS = ("กับ", "กบ", "และ", "หรือ", "compare", "vs", "v.s.", "versus", "and", "or", "with")
ABSTRACT_HINTS = ("overview", "summary", "difference", "compare", "information", "อธิบาย", "สรุป", "ภาพรวม", "ข้อมูล")
DOMAIN_HINTS = ("nlem", "ed", "ned", "tmt", "vtm", "gp", "gpu", "tp", "tpu")
MAKER_CONTEXT = ("manufacturer", "produce", "produced", "made", "company", "ผู้ผลิต", "ผลิตโดย", "บริษัท")
ENGLISH_QUESTION_PARTS = ("how many", "what is", "overview of", "information about", "list of", "number of")
THAI_INTENT_PARTS = ("เปรียบเทียบ", "ระหว่าง", "ข้อมูล", "ขอ", "เปรย", "บเทยบ")
QUERY_LIKE_PARTS = ("drug information", "information about", "list drugs", "by manufacturer", "ข้อมูลยา", "รายการยา")
THAI_QUERY_NOISE = ("ผม", "ฉัน", "อยาก", "ขอ", "ชื่อ", "ทาง", "การ", "ค้า", "โรงงาน", "ผู้ผลิต", "ทั้งหมด", "รายการ", "อะไร")

# ---------------------------------------------------------------- anchors in the text
# Phrases whose tail names the thing asked about.
LOOKUP_PREFIX = (r"^\s*(?:drug\s+information\s+about|information\s+about|info\s+about)\s+(.+)$",
                 r"^\s*(?:ข้อมูลยา)\s+(.+)$")
SUBSTANCE_TAIL = (r"(?:list\s+drugs?\s+containing|drugs?\s+containing)\s+(.+)$", r"(?:ส่วนผสม)\s+(.+)$")
MANUFACTURER_TAIL = (r"(?:list\s+drugs?\s+by\s+manufacturer|by\s+manufacturer|manufacturer)\s+(.+)$",
                     r"(?:ผู้ผลิต|ผลิตโดย)\s+(.+)$")
LOOKUP_SUBSTANCE_TAIL = SUBSTANCE_TAIL + (
    r"(?:trade\s+name(?:s)?(?:\s+of)?|brand\s+name(?:s)?(?:\s+of)?)\s+(.+)$",
    r"(?:who\s+manufactures|manufacturer\s+of)\s+(.+)$",
    r"(?:ชื่อทางการค้า(?:ของยา)?|ยี่ห้อยา)\s*(.+)$",
    r"(?:โรงงานที่ผลิต|ผู้ผลิต)\s*(.+)$",
)
REQUEST_PREFIX = (r"^(?:trade\s+name(?:s)?(?:\s+of)?|brand\s+name(?:s)?(?:\s+of)?|who\s+manufactures|"
                  r"manufacturer\s+of)\s+")
DRUG_AFTER_WORD = r"(?:ยา|drug)\s+([A-Za-z][A-Za-z0-9\-]+(?:\s+\d+(?:\.\d+)?\s*(?:mg|mcg|g|ml|iu|%))?)"
DRUG_WITH_DOSE = r"([A-Za-z][A-Za-z0-9\-]+)\s+(\d+(?:\.\d+)?)\s*(mg|mcg|g|ml|iu|%)"
MANUFACTURER_REQUEST = ("manufacturer", "manufactures", "factory", "ผู้ผลิต", "บริษัท", "โรงงาน", "ผลิตโดย")
TRADE_NAME_REQUEST = ("trade name", "ชื่อทางการค้า")
COMPARE_SPLIT = r"\b(?:vs\.?|versus|and|or|with)\b|และ|หรือ|กับ|เทียบกับ"
PRODUCT_COUNT_HINTS = ("how many drugs", "produce", "products", "จำนวนยา", "ผลิต", "ยา")
HIERARCHY_COUNT_HINTS = ("all nodes", "all entities", "ทั้งหมด", "โหนด", "ในระบบ")
DEFAULT_LIST_TERM = "ยา"
DEFAULT_SEARCH_TERM = "drug"

# ---------------------------------------------------------------- text search terms
# Fixed values.
DOSE_TERM = (r"\d+\.?\d*\s*(?:mg|g|mL|mcg|IU|%|ml|MG|G|ML)"
             r"(?:/\d+\.?\d*\s*(?:mg|g|mL|mcg|IU|%|ml|MG|G|ML))?")
LATIN_TERM = r"[A-Za-z][A-Za-z0-9\-]*[A-Za-z0-9]|[A-Za-z]"
NUMBER_TERM = r"\d+\.?\d*"
THAI_TERM = r"[฀-๿]+"
LOOSE_TERM = r"[A-Za-z0-9][A-Za-z0-9\-\./%]*|[฀-๿]{2,}"
THAI_STOPWORDS = ("อะไร", "บ้าง", "ใคร", "ผลิต", "เป็น", "ยังไง", "อย่างไร", "ไหน", "ทำไม", "มี", "ได้", "และ", "หรือ",
                  "ที่", "ของ", "ใน", "จาก", "ให้", "กับ", "แสดง", "บอก", "หา", "ค้นหา", "ดู", "ต้องการ", "ขอ", "ช่วย")
TERM_NOISE = ("what", "which", "how", "many", "list", "show", "find", "search", "lookup", "overview",
              "information", "info", "data", "about", "does", "is", "are", "do", "did", "by", "of", "the", "a",
              "an", "products", "product", "drugs", "drug", "medications", "medication", "medicine",
              "medicines", "manufacturer", "manufacturers", "containing", "contain",
              "ข้อมูล", "รายการ", "รายชื่อ", "แสดง", "ค้นหา", "หา", "ขอ", "ช่วย", "อะไร", "อย่างไร", "ยังไง", "กี่", "จำนวน",
              "เปรียบเทียบ", "ระหว่าง", "ยา")
TERM_LIMIT = 4
SEED_TERM_LIMIT = 4

# ---------------------------------------------------------------- manufacturers
# Fixed values.
HOSPITAL = "โรงพยาบาล"
MANUFACTURER_ALIASES = (("gpo", "องค์การเภสัชกรรม"), ("องค์การ", "องค์การเภสัชกรรม"),
                        ("ไฟเซอร์", "Pfizer"), ("โนวาร์ตีส", "Novartis"))

# ---------------------------------------------------------------- entity labels
# Fixed values.
ENTITY_LABELS = ("BRAND", "DRUG", "MANUFACTURER", "FORM", "STRENGTH")
ENTITY_MIN_CONFIDENCE = 0.60
BRAND_CAP, MANUFACTURER_CAP, DRUG_CAP = 2, 2, 6
LATER_PART_FACTOR = 0.9
BIO_LABELS = ("O", "B-DRUG", "I-DRUG", "B-BRAND", "I-BRAND", "B-MANUFACTURER", "I-MANUFACTURER",
              "B-FORM", "I-FORM", "B-STRENGTH", "I-STRENGTH")

# ---------------------------------------------------------------- intents
# Fixed values.
ACTION_SUFFIXES = ("find", "check", "count")
ACTION_OF_SUFFIX = (("find", "lookup"), ("check", "verify"), ("count", "count"))
HOLDOUT_LABELS = ("manufacturer_check", "substance_count", "nlem_find", "hierarchy_check", "formula_count",
                  "general_find")
CONFIDENCE_FLOOR, MARGIN_FLOOR = 0.55, 0.03

# ---------------------------------------------------------------- answers
# Fixed values.
COUNT_ANSWER = "ผลการนับสำหรับคำถามนี้: %d รายการ"
COUNT_ANSWER_PLAIN = "ผลการนับ: %d รายการ"
COUNT_MISSING = "ไม่พบจำนวนที่เชื่อถือได้จากผลการค้นหา"
LIMIT_PATTERNS = (r"\btop\s*(\d+)\b", r"\b(\d+)\s*(?:items?|results?|names?)\b", r"(\d+)\s*(?:ชื่อ|รายการ|ตัว)", r"\b(\d+)\b")

# ---------------------------------------------------------------- token-labelling data
# Length bounds per entity label, and the most '+' signs allowed.
ENTITY_RULES = (("DRUG", 2, 80, None), ("BRAND", 2, 80, None), ("MANUFACTURER", 2, 60, None),
                ("FORM", 2, 40, None), ("STRENGTH", 2, 40, 1))
BLACKLIST = ("ราคา", "ผลข้างเคียง", "วิธีใช้", "ข้อห้าม", "ปฏิกิริยาระหว่างยา")
GROUP_WEIGHTS = (("general.retrieve", 0.20), ("manufacturer.mix", 0.20), ("ingredient.retrieve", 0.15),
                 ("formula.mix", 0.15), ("nlem.verify", 0.15), ("hierarchy.retrieve", 0.05),
                 ("short.practical", 0.10))
GROUP_KEYWORDS = (("nlem.verify", ("nlem", "เบิก", "บัญชียาหลัก")), ("manufacturer.mix", ("ผู้ผลิต", "บริษัท", "ผลิตโดย")))
OWNED_BY = "ของ"
TEMPLATE_PROFILE = "practical.thai_first"
# Id, group, target, strategy, text. Every template weighs 1.
TEMPLATES = (
    ("G01", "general.retrieve", "general", "retrieve", "ข้อมูลยา {DRUG}"),
    ("G02", "general.retrieve", "general", "retrieve", "ขอข้อมูลของ {BRAND}"),
    ("G03", "general.retrieve", "general", "retrieve", "{DRUG} คือยาอะไร"),
    ("G04", "general.retrieve", "general", "retrieve", "{BRAND} คือยาอะไร"),
    ("G05", "general.retrieve", "general", "retrieve", "รายละเอียดของ {DRUG} คืออะไร"),
    ("M01", "manufacturer.mix", "manufacturer", "retrieve", "{BRAND} ผลิตโดยบริษัทอะไร"),
    ("M02", "manufacturer.mix", "manufacturer", "retrieve", "ผู้ผลิตของ {BRAND} คือใคร"),
    ("M03", "manufacturer.mix", "manufacturer", "verify", "ยา {DRUG} ของ {MANUFACTURER} มีไหม"),
    ("M04", "manufacturer.mix", "manufacturer", "verify", "{BRAND} เป็นของ {MANUFACTURER} หรือไม่"),
    ("M05", "manufacturer.mix", "manufacturer", "verify", "{DRUG} ผลิตโดย {MANUFACTURER} ใช่ไหม"),
    ("I01", "ingredient.retrieve", "ingredient", "retrieve", "{BRAND} มีตัวยาสำคัญอะไร"),
    ("I02", "ingredient.retrieve", "ingredient", "retrieve", "ส่วนประกอบของ {DRUG} คืออะไร"),
    ("I03", "ingredient.retrieve", "ingredient", "retrieve", "{DRUG} มี active ingredient อะไร"),
    ("I04", "ingredient.retrieve", "ingredient", "retrieve", "{BRAND} {STRENGTH} มีสารสำคัญอะไร"),
    ("F01", "formula.mix", "formula", "retrieve", "{BRAND} มีรูปแบบยาอะไร"),
    ("F02", "formula.mix", "formula", "verify", "{DRUG} มีรูปแบบ {FORM} ไหม"),
    ("F03", "formula.mix", "formula", "verify", "{BRAND} เป็น {FORM} หรือไม่"),
    ("F04", "formula.mix", "formula", "verify", "{DRUG} {STRENGTH} มีในระบบไหม"),
    ("N01", "nlem.verify", "nlem", "verify", "{BRAND} เบิกได้ไหม"),
    ("N02", "nlem.verify", "nlem", "verify", "ยา {DRUG} อยู่ในบัญชียาหลักหรือไม่"),
    ("N03", "nlem.verify", "nlem", "verify", "{DRUG} {STRENGTH} เบิกได้หรือไม่"),
    ("N04", "nlem.verify", "nlem", "verify", "{BRAND} อยู่ใน NLEM ไหม"),
    ("N05", "nlem.verify", "nlem", "verify", "{DRUG} อยู่ในบัญชียาหลักหมวด ก หรือไม่"),
    ("H01", "hierarchy.retrieve", "hierarchy", "retrieve", "{BRAND} เป็นยาสามัญตัวไหน"),
    ("H02", "hierarchy.retrieve", "hierarchy", "retrieve", "{DRUG} มีชื่อการค้าอะไร"),
    ("H03", "hierarchy.retrieve", "hierarchy", "retrieve", "{BRAND} อยู่ในกลุ่มยาอะไร"),
    ("S01", "short.practical", "general", "retrieve", "{BRAND}"),
    ("S02", "short.practical", "general", "retrieve", "{DRUG}"),
    ("S03", "short.practical", "nlem", "verify", "{BRAND} เบิกได้ไหม"),
    ("S04", "short.practical", "manufacturer", "retrieve", "{DRUG} ของ {MANUFACTURER}"),
)

# ---------------------------------------------------------------- acceptance
# Metric, comparison, limit.
ACCEPTANCE = (
    ("overall_semantic_hit@10", ">=", 0.75), ("lookup_hit@10", ">=", 0.55), ("list_hit@10", ">=", 0.80),
    ("compare_hit@10", ">=", 0.85), ("overall_semantic_mrr", ">=", 0.55),
    ("overall_semantic_ndcg@10", ">=", 0.60), ("count_exact_match", ">=", 0.45), ("count_mape", "<=", 40.0),
    ("error_rate", "<=", 0.01), ("latency_p95_ms", "<=", 2500.0),
)
SEMANTIC_OPERATORS = ("lookup", "list", "analyze_compare", "compare")
COMPARE_OPERATORS = ("analyze_compare", "compare")

# ---------------------------------------------------------------- search profiles
# Target, levels, fields kept, most entities kept.
_NLEM_FIELDS = ("nlem", "nlem_category", "nlem_section")
SEARCH_PROFILES = (
    ("manufacturer", ("TP", "TPU"),
     ("trade_name", "manufacturer", "fsn", "tmtid", "level", "container_text") + _NLEM_FIELDS, 40),
    ("substance", ("SUBS", "VTM", "GP", "GPU", "TP", "TPU"),
     ("fsn", "active_substance", "active_substances", "strength", "tmtid", "level", "dosageform") + _NLEM_FIELDS, 60),
    ("nlem", ("GP",), ("fsn", "tmtid", "level") + _NLEM_FIELDS, 80),
    ("hierarchy", ("SUBS", "VTM", "GP", "GPU", "TP", "TPU"), ("level", "fsn", "tmtid") + _NLEM_FIELDS, 60),
    ("formula", ("GP", "GPU", "TP", "TPU"),
     ("trade_name", "manufacturer", "fsn", "tmtid", "level") + _NLEM_FIELDS, 50),
    ("general", ("SUBS", "VTM", "GP", "GPU", "TP", "TPU"),
     ("trade_name", "manufacturer", "fsn", "tmtid", "level") + _NLEM_FIELDS, 60),
)

# ---------------------------------------------------------------- query-set phrasing
# Question phrasings of the generated query sets.
ID_PHRASES = (("th", "TMTID %s คือยาอะไร"), ("en", "what is tmtid %s"))
NAME_PHRASES = (("th", "ข้อมูลยา %s"), ("en", "drug information about %s"))
SUBSTANCE_LIST_PHRASES = (("th", "รายการยาที่มีส่วนผสม %s"), ("en", "list drugs containing %s"))
SUBSTANCE_COUNT_PHRASE = ("th", "จำนวนยาที่มีส่วนผสม %s")
MANUFACTURER_LIST_PHRASES = (("th", "รายการยาของผู้ผลิต %s"), ("en", "list drugs by manufacturer %s"))
MANUFACTURER_COUNT_PHRASE = ("th", "จำนวนยาของผู้ผลิต %s")
CLAIM_PHRASE = ("th", "tmtid %s ผลิตโดย %s ใช่ไหม")
COMPARE_PHRASES = (("th", "เปรียบเทียบข้อมูลระหว่าง %s กับ %s"), ("en", "compare %s vs %s"))
PRODUCT_TOTAL_PHRASE = ("en", "how many drugs does TMT produce")
NODE_TOTAL_PHRASE = ("th", "จำนวนโหนดยาทั้งหมดในระบบ TMT")
ANCHOR_SUBSTANCE_PHRASES = (
    ("th", "trade_name", "ชื่อทางการค้าของยา %s มีอะไรบ้าง"), ("en", "trade_name", "what are the trade names of %s"),
    ("th", "manufacturer_by_substance", "ใครเป็นผู้ผลิตยา %s"), ("en", "manufacturer_by_substance", "who manufactures %s"))
ANCHOR_MANUFACTURER_PHRASES = (
    ("th", "manufacturer_lookup", "ข้อมูลยาที่ผลิตโดย %s"), ("en", "manufacturer_lookup", "drug information manufactured by %s"))

_WORD = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def rx(pattern: str, flags: str = "iU") -> str:
    """A Java pattern whose word edges are those of letters, digits and underscore.

    Java's own Unicode ``\\b`` also counts combining marks as word characters,
    which moves the edge behind Thai vowels and tone marks.
    """
    return f"(?{flags})" + pattern.replace(r"\b", _EDGE)
