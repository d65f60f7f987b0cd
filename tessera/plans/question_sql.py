"""SQL that reads questions the way the ``understanding`` operators do."""

from __future__ import annotations

from ..functions import lexicon as lx
from . import sql as S

EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
STOP = "[" + S.listing(lx.EN_STOPWORDS) + "]"
STOP_ALL = "[" + S.listing(lx.EN_STOPWORDS + lx.THAI_QUERY_NOISE) + "]"
HINTS = "[" + S.listing(lx.DOMAIN_HINTS) + "]"
DOSE = r"(?i)\d+(?:\.\d+)?\s*(?:mg|g|mcg|ml|iu|%)\b"


def usable(c: str) -> str:
    return f"CASE WHEN {c} <> '' AND NOT {S.holds(f'lower({c})', lx.QUERY_LIKE_PARTS)} THEN {c} END"


def extract(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {S.quote('(?i)' + pattern)}, {group})"


def maker_of(text: str, src: str) -> str:
    """(query_id, manufacturer) for a relation with a text column."""
    alias = "coalesce(" + ", ".join(f"CASE WHEN contains(lower({text}), {S.quote(a)}) THEN {S.quote(n)} END" for a, n in lx.MANUFACTURER_ALIASES) + ")"
    return f"""SELECT q.query_id, coalesce({alias}, w.m, s.m) AS manufacturer FROM {src} q
      LEFT JOIN (SELECT query_id, min_by(manufacturer, (p, manufacturer)) AS m FROM (SELECT query_id, UNNEST(ws) AS folded, generate_subscripts(ws, 1) AS p FROM (SELECT query_id, regexp_split_to_array(lower({text}), '[\\s,./()]+') AS ws FROM {src})) x
        JOIN maker_dim d USING (folded) WHERE length(folded) >= 2 GROUP BY query_id) w USING (query_id)
      LEFT JOIN (SELECT query_id, min_by(manufacturer, (-length(manufacturer), manufacturer)) AS m FROM {src} JOIN maker_dim d ON length(d.manufacturer) > 3 AND contains(lower({text}), d.folded) GROUP BY query_id) s USING (query_id)"""


def questions(src: str, p: str, drugs: str | None, *needs: str) -> None:
    """Fragments ``<p>_maker`` and ``<p>_read``: the structured row of every question of ``src``."""
    f = S.fragment
    f(f"{p}_maker", maker_of("question", src), "maker_dim", *needs)
    strategy = (f"CASE WHEN {S.found('q', lx.COUNT_PATTERNS)} THEN 'count' WHEN {S.found('q', lx.LEADING_VERIFY)} THEN 'verify' WHEN {S.found('q', lx.LIST_PATTERNS)} THEN 'list' "
                f"WHEN {S.found('q', lx.VERIFY_PATTERNS)} THEN 'verify' ELSE 'retrieve' END")
    prefixed = extract("question", EDGE_L + lx.PREFIXED_ID[2:-2] + EDGE_R, 1)
    bare = extract("question", EDGE_L + r"(\d{6,10})" + EDGE_R, 1)
    category = "CASE " + " ".join(f"WHEN {S.found('lower(question)', pats)} THEN '{letter}'" for letter, pats in lx.NLEM_CATEGORY_PATTERNS) + " END"
    f(f"{p}_basic", f"""SELECT *, {strategy} AS strategy, coalesce(nullif({prefixed}, ''), nullif({bare}, '')) AS id_lookup, {category} AS nlem_category,
        CASE WHEN {S.found('lower(question)', lx.NLEM_PATTERNS)} OR ({category}) IS NOT NULL THEN true END AS nlem_filter,
        {S.found('lower(trim(question))', lx.COMPARE_PATTERNS)} AS comparing, {S.found('lower(q)', lx.GREETING_PATTERNS)} AND len(string_split(q, ' ')) <= {lx.GREETING_MAX_WORDS} AS greeting
        FROM (SELECT query_id, trim(question) AS question, {S.squash('question')} AS q FROM {src})""", *needs)
    slots = "SELECT *, []::VARCHAR[] AS drugs" if drugs is None else f"SELECT b.*, coalesce(x.drugs, []) AS drugs"
    join = "" if drugs is None else f" LEFT JOIN {drugs} x USING (query_id)"
    tails = [usable(f"tail{i}") for i in range(3)]
    groups = (lx.LOOKUP_PREFIX, lx.SUBSTANCE_TAIL, lx.MANUFACTURER_TAIL)
    tail_cols = ", ".join(f"coalesce({S.first_tail('q', g)}, '') AS tail{i}" for i, g in enumerate(groups))
    f(f"{p}_cand", f"""SELECT *, {S.clean_tail(extract('q', lx.DRUG_AFTER_WORD, 1))} AS after_word, {S.clean_tail(
        f"{extract('q', lx.DRUG_WITH_DOSE, 1)} || ' ' || {extract('q', lx.DRUG_WITH_DOSE, 2)} || ' ' || {extract('q', lx.DRUG_WITH_DOSE, 3)}")} AS with_dose, {tail_cols},
        list_filter({S.tokens('q')}, lambda t: NOT list_contains({STOP_ALL}, lower(t)) AND NOT list_contains({S.tokens("lower(coalesce(manufacturer_filter, ''))")}, lower(t)) AND (length(t) >= 3 OR regexp_matches(t, '\\d'))) AS kept
        FROM (SELECT b.*, m.manufacturer AS manufacturer_filter FROM ({slots} FROM {p}_basic b{join}) b JOIN {p}_maker m USING (query_id))""", f"{p}_basic", f"{p}_maker", *([drugs] if drugs else []))
    latin = "list_position(list_transform(kept, lambda t: regexp_full_match(t, '[A-Za-z][A-Za-z0-9\\-]{2,}')), true)"
    f(f"{p}_term", f"""SELECT *, coalesce(id_lookup, list_filter(list_transform(drugs, lambda d: {S.clean_tail('d')}), lambda c: c <> '' AND NOT {S.holds('lower(c)', lx.QUERY_LIKE_PARTS)})[1], {', '.join(tails)}, {usable('after_word')}, {usable('with_dose')},
        CASE WHEN pos > 0 THEN CASE WHEN coalesce(regexp_full_match(kept[pos + 1], '\\d+(?:\\.\\d+)?'), false) THEN CASE WHEN coalesce(regexp_full_match(lower(kept[pos + 2]), '(?:{lx.DOSE_UNIT_ALT})'), false)
          THEN array_to_string(kept[pos:pos + 2], ' ') ELSE array_to_string(kept[pos:pos + 1], ' ') END ELSE kept[pos] END END,
        CASE WHEN len(kept) > 0 THEN array_to_string(kept[1:8], ' ') END, q) AS query FROM (SELECT *, {latin} AS pos FROM {p}_cand)""", f"{p}_cand")
    found = (f"list_concat(list_filter(toks, lambda t: regexp_matches(t, '(?i){lx.UNIT_TOKEN}') OR regexp_matches(t, '\\d') OR list_contains({HINTS}, t) OR (regexp_matches(t, '[A-Za-z]') AND length(t) >= 3 AND NOT list_contains({STOP}, t))), "
             f"{S.tokens(f'''array_to_string(regexp_extract_all(low, {S.quote(DOSE)}), ' ')''')}, list_filter([{prefixed}], lambda x: x <> ''), list_filter([{bare}], lambda x: x <> ''), "
             f"{S.tokens('''lower(coalesce(manufacturer_filter, ''))''')}, CASE WHEN nlem_filter THEN ['nlem'] ELSE [] END, CASE WHEN nlem_category IS NOT NULL THEN [nlem_category] ELSE [] END, "
             f"list_filter({S.tokens('''lower(array_to_string(drugs, ' '))''')}, lambda t: length(t) >= 2 OR regexp_matches(t, '\\d')))")
    f(f"{p}_prof", f"""SELECT *, len(toks) AS token_count, least(len(list_distinct({found})), len(toks)) AS entity_token_count,
        coalesce(least(len(list_distinct({found})), len(toks)) / nullif(len(toks), 0)::DOUBLE, 0) AS ratio,
        len(toks) > 0 AND ((len(toks) >= 10 AND NOT regexp_matches(low, '[A-Za-z0-9]')) OR {S.holds('low', lx.ABSTRACT_HINTS)}) AS is_abstract
        FROM (SELECT *, lower(question) AS low, {S.tokens('lower(question)')} AS toks FROM {p}_term)""", f"{p}_term")
    f(f"{p}_read", f"""SELECT * EXCLUDE (kept, toks, low), plan.m AS retrieval_mode, plan.v AS vector_weight, plan.t AS fulltext_weight,
        CASE WHEN nlem_filter THEN 'nlem' WHEN manufacturer_filter IS NOT NULL THEN 'manufacturer' ELSE 'general' END AS target_type,
        CASE WHEN comparing THEN 'compare' WHEN strategy IN ('count', 'list', 'verify') THEN strategy WHEN greeting THEN 'unknown' ELSE 'lookup' END AS action FROM (SELECT *, CASE
        WHEN id_lookup IS NOT NULL THEN {{'m': 'fulltext_heavy', 'v': 0.15::DOUBLE, 't': 0.85::DOUBLE}} WHEN strategy IN ('count', 'list') AND ratio >= 0.60 THEN {{'m': 'fulltext_heavy', 'v': 0.35::DOUBLE, 't': 0.65::DOUBLE}}
        WHEN strategy IN ('count', 'list') THEN {{'m': 'balanced', 'v': 0.5::DOUBLE, 't': 0.5::DOUBLE}} WHEN strategy = 'verify' AND ratio >= 0.60 AND NOT is_abstract THEN {{'m': 'fulltext_heavy', 'v': 0.4::DOUBLE, 't': 0.6::DOUBLE}}
        WHEN strategy = 'verify' AND ratio >= 0.35 AND ratio < 0.60 THEN {{'m': 'balanced', 'v': 0.5::DOUBLE, 't': 0.5::DOUBLE}} WHEN strategy = 'verify' THEN {{'m': 'vector_heavy', 'v': 0.6::DOUBLE, 't': 0.4::DOUBLE}}
        WHEN is_abstract OR ratio < 0.30 THEN {{'m': 'vector_heavy', 'v': 0.7::DOUBLE, 't': 0.3::DOUBLE}} WHEN ratio < 0.60 THEN {{'m': 'balanced', 'v': 0.55::DOUBLE, 't': 0.45::DOUBLE}}
        ELSE {{'m': 'fulltext_heavy', 'v': 0.4::DOUBLE, 't': 0.6::DOUBLE}} END AS plan FROM {p}_prof)""", f"{p}_prof")
    trade, factory = S.holds("lower(q)", lx.TRADE_NAME_REQUEST), S.holds("lower(q)", lx.MANUFACTURER_REQUEST)
    sub_tail, list_tail, maker_tail = (S.join_doses(f"coalesce({S.first_tail('q', g)}, '')") for g in (lx.LOOKUP_SUBSTANCE_TAIL, lx.SUBSTANCE_TAIL, lx.MANUFACTURER_TAIL))
    f(f"{p}_hint0", f"SELECT *, {sub_tail} AS sub_tail, {list_tail} AS list_tail, {maker_tail} AS maker_tail, {trade} AS wants_trade_name, {factory} AS wants_maker, {S.first_dose('question')} AS hint_dose, {S.join_doses('query')} AS query_doses FROM {p}_read", f"{p}_read")
    substance = "coalesce(nullif(drugs[1], ''), nullif(sub_tail, ''), query_doses)"
    bare_sub = S.join_doses(S.drop_doses(f"regexp_replace({substance}, {S.quote('(?i)' + lx.REQUEST_PREFIX)}, '')"))
    f(f"{p}_hints", f"""SELECT *, {bare_sub} AS hint_substance, coalesce(manufacturer_filter, maker_tail) AS hint_maker,
        (len(drugs) > 0 OR manufacturer_filter IS NOT NULL OR sub_tail <> '' OR maker_tail <> '') AND (wants_trade_name OR wants_maker) AS has_anchor FROM {p}_hint0""", f"{p}_hint0")
    list_sub = "CASE WHEN len(drugs) > 0 THEN drugs[1] ELSE list_tail END"
    f(f"{p}_lists", f"""SELECT * EXCLUDE (sub0), CASE WHEN sub0 = '' AND (wants_trade_name OR wants_makers) THEN query_doses ELSE sub0 END AS substance FROM (
        SELECT *, coalesce(nullif({S.drop_doses(list_sub)}, ''), {list_sub}) AS sub0, coalesce(manufacturer_filter, maker_tail) AS list_maker,
          coalesce(nullif(hint_dose, ''), {S.first_dose(list_sub)}) AS strength, wants_maker AND coalesce(manufacturer_filter, maker_tail) = '' AS wants_makers FROM {p}_hint0)""", f"{p}_hint0")
