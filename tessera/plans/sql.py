"""SQL fragments (DuckDB) that build the same catalogue and fixtures as ``fixtures``.

A fragment is a ``name AS (query)`` pair; ``query`` puts the fragments a
statement needs in front of it, in order of their dependencies.
"""

from __future__ import annotations

from ..functions import lexicon as lx
from ..schema import ANCHOR_LEVEL_ORDER, LEVELS

FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}


def fragment(name: str, sql: str, *needs: str) -> None:
    FRAGMENTS[name] = (needs, sql)


def query(select: str, *needs: str) -> str:
    """``WITH`` the needed fragments, then the statement."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for n in FRAGMENTS[name][0]:
            add(n)
        done.append(name)

    for n in needs:
        add(n)
    head = ",\n".join(f"{n} AS ({FRAGMENTS[n][1]})" for n in done)
    body = select.strip()
    if body.startswith(","):  # the statement adds fragments of its own
        return f"WITH {head}\n{body}"
    return f"WITH {head}\n{body}" if head else body


def quote(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listing(values) -> str:
    return ", ".join(quote(v) for v in values)


def _bounds(pattern: str) -> str:
    """A pattern with ``\\b``, for a found/not-found test in an engine whose ``\\b`` is ASCII-only."""
    out = pattern
    if out.startswith(r"\b"):
        out = r"(?:^|[^\p{L}\p{N}_])" + out[2:]
    if out.endswith(r"\b"):
        out = out[:-2] + r"(?:$|[^\p{L}\p{N}_])"
    return out.replace(r"\b", r"(?:$|[^\p{L}\p{N}_])")


def found(text: str, patterns) -> str:
    """SQL test: any of the patterns is found in ``text``."""
    return f"regexp_matches({text}, {quote('(?i)(?:' + '|'.join(_bounds(p) for p in patterns) + ')')})"


def holds(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(w)})" for w in words) + ")"


def squash(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g'))"


def join_doses(text: str) -> str:
    out = squash(text)
    for unit in lx.DOSE_UNITS:
        out = f"regexp_replace({out}, {quote(rf'({lx.NUMBER})' + chr(92) + 's*' + unit + chr(92) + 'b')}, {quote(chr(92) + '1' + unit)}, 'gi')"
    return out


MARKS = "' ,.;:()[]{}\"'''"


def strip_marks(text: str) -> str:
    return f"trim({text}, {MARKS})"


def clean_tail(text: str) -> str:
    inner = f"regexp_replace({strip_marks(squash(text))}, '\\s+', ' ', 'g')"
    return f"trim(regexp_replace({inner}, '\\?$', ''))"


def drop_doses(text: str) -> str:
    gone = f"regexp_replace({squash(text)}, {quote('(?i)' + lx.NUMBER + chr(92) + 's*(?:' + lx.DOSE_UNIT_ALL + ')' + chr(92) + 'b')}, '', 'g')"
    return strip_marks(f"regexp_replace({gone}, '\\s+', ' ', 'g')")


def first_dose(text: str) -> str:
    return join_doses(f"regexp_extract({text}, {quote('(?i)' + chr(92) + 'b' + lx.NUMBER + chr(92) + 's*(?:' + lx.DOSE_UNIT_ALT + ')' + chr(92) + 'b')})")


def first_tail(text: str, patterns) -> str:
    parts = [f"nullif({clean_tail(f'regexp_extract({squash(text)}, {quote("(?i)" + p)}, 1)')}, '')" for p in patterns]
    return "coalesce(" + ", ".join(parts) + ")"


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, {quote(lx.TOKEN)})"


def distinct_in_order(values: str) -> str:
    """Values that are not blank and whose lower-case form did not come earlier."""
    return (f"list_filter({values}, lambda v, i: v <> '' AND "
            f"list_position(list_transform({values}, lambda w: lower(w)), lower(v)) = i)")


def digest(seed: str, *cols: str) -> str:
    return "md5(concat_ws('|', " + ", ".join([quote(seed), *[f"CAST({c} AS VARCHAR)" for c in cols]]) + "))"


CONTAINS = ("fsn", "trade_name", "name", "generic_name", "active_substance")


def contains_any(term: str, columns=CONTAINS, alias: str = "n") -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({alias}.{c}, '')), {term})" for c in columns) + ")"


def keep_strength(strength: str, fsn: str) -> str:
    return (f"({strength} = '' OR contains(lower({fsn}), lower({strength})) OR "
            f"contains(replace(lower({fsn}), ' ', ''), replace(lower({strength}), ' ', '')))")


# ---------------------------------------------------------------- the catalogue
fragment("names", "SELECT p_name, CAST(5000000000000 + dense_rank() OVER (ORDER BY p_name) AS VARCHAR) AS vtm FROM (SELECT DISTINCT p_name FROM part)")
fragment("words", "SELECT word, CAST(6000000000000 + dense_rank() OVER (ORDER BY word) AS VARCHAR) AS subs FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS word FROM part)")
fragment("gp", "SELECT *, split_part(p_name, ' ', 2) AS word, CAST(p_partkey + 1000000 AS VARCHAR) AS gp, "
               "p_name || ' ' || p_size || ' mg ' || lower(p_type) AS gp_fsn, p_size || ' mg' AS dose, "
               "(p_size % 2 = 0) AS is_nlem, (['ก','ข','ค','ง','จ'])[p_size % 5 + 1] AS cat FROM part")
fragment("facts", "SELECT DISTINCT l_partkey, l_suppkey, l_returnflag, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS flag FROM lineitem")
fragment("maker", "SELECT s_suppkey, s_name || ', ' || n_name AS maker FROM supplier JOIN nation ON s_nationkey = n_nationkey")
fragment("trade", "SELECT f.*, g.p_name, g.word, g.dose, m.maker, g.p_brand || ' ' || g.p_name AS brand, "
                  "g.p_brand || ' ' || g.p_name || ' (' || m.maker || ') (' || g.word || ' ' || g.dose || ')' AS tp_fsn "
                  "FROM (SELECT DISTINCT l_partkey, l_suppkey, l_partkey * 1000000000 + l_suppkey AS pair FROM facts) f "
                  "JOIN gp g ON g.p_partkey = f.l_partkey JOIN maker m ON m.s_suppkey = f.l_suppkey", "facts", "gp", "maker")
_NODE = ("tmtid, level, name, fsn, trade_name, generic_name, manufacturer, active_substance, strength, dosageform, nlem, "
         "nlem_category, vec")
fragment("nodes", f"""
    SELECT tmtid AS node_id, {_NODE} FROM (
    SELECT subs AS tmtid, 'SUBS' AS level, word AS name, word || ' (SUBS)' AS fsn, NULL::VARCHAR AS trade_name,
           NULL::VARCHAR AS generic_name, NULL::VARCHAR AS manufacturer, NULL::VARCHAR AS active_substance,
           NULL::VARCHAR AS strength, NULL::VARCHAR AS dosageform, NULL::BOOLEAN AS nlem, NULL::VARCHAR AS nlem_category,
           NULL::FLOAT[] AS vec FROM words
    UNION ALL SELECT vtm, 'VTM', p_name, p_name || ' (VTM)', NULL, NULL, NULL, split_part(p_name, ' ', 2), NULL, NULL, NULL, NULL, NULL FROM names
    UNION ALL SELECT gp, 'GP', p_name, gp_fsn, NULL, p_name, NULL, word, dose, p_type, is_nlem, cat, e.embedding
              FROM gp LEFT JOIN embeddings e ON e.vec_id = gp.p_partkey
    UNION ALL SELECT CAST(l_partkey * 4 + flag + 20000000000000 AS VARCHAR), 'GPU', p_name, gp_fsn || ' ' || l_returnflag, NULL, p_name,
              NULL, word, dose, p_type, is_nlem, cat, NULL
              FROM (SELECT DISTINCT l_partkey, l_returnflag, flag FROM facts) u JOIN gp ON gp.p_partkey = u.l_partkey
    UNION ALL SELECT CAST(pair + 3000000000000000000 AS VARCHAR), 'TP', brand, tp_fsn, brand, p_name, maker, word, dose, NULL, NULL, NULL, NULL FROM trade
    UNION ALL SELECT CAST(t.pair * 4 + f.flag + 4000000000000000000 AS VARCHAR), 'TPU', brand, tp_fsn || ' ' || l_returnflag, brand, p_name, maker,
              word, dose, NULL, NULL, NULL, NULL
              FROM facts f JOIN trade t ON t.l_partkey = f.l_partkey AND t.l_suppkey = f.l_suppkey)""",
         "words", "names", "gp", "facts", "trade")
fragment("edges", """
    SELECT src_id, dst_id, type, src_id || '|' || type || '|' || dst_id AS edge_id FROM (
    SELECT UNNEST([{'src_id': a, 'dst_id': b, 'type': f}, {'src_id': b, 'dst_id': a, 'type': r}], recursive := true) FROM (
      SELECT w.subs AS a, n.vtm AS b, 'IS_ACTIVE_SUBSTANCE_OF' AS f, 'HAS_ACTIVE_SUBSTANCE' AS r FROM names n JOIN words w ON w.word = split_part(n.p_name, ' ', 2)
      UNION ALL SELECT g.gp, n.vtm, 'HAS_VTM', 'IS_VTM_OF' FROM gp g JOIN names n ON n.p_name = g.p_name
      UNION ALL SELECT DISTINCT CAST(l_partkey + 1000000 AS VARCHAR), CAST(l_partkey * 4 + flag + 20000000000000 AS VARCHAR), 'HAS_GENERIC_UNIT', 'IS_GENERIC_UNIT_OF' FROM facts
      UNION ALL SELECT DISTINCT CAST(l_partkey + 1000000 AS VARCHAR), CAST(l_partkey * 1000000000 + l_suppkey + 3000000000000000000 AS VARCHAR), 'HAS_TRADE_PRODUCT', 'IS_TRADE_PRODUCT_OF' FROM facts
      UNION ALL SELECT CAST(l_partkey * 1000000000 + l_suppkey + 3000000000000000000 AS VARCHAR), CAST((l_partkey * 1000000000 + l_suppkey) * 4 + flag + 4000000000000000000 AS VARCHAR), 'HAS_TRADE_UNIT', 'IS_UNIT_OF_TRADE_PRODUCT' FROM facts
      UNION ALL SELECT CAST(l_partkey * 4 + flag + 20000000000000 AS VARCHAR), CAST((l_partkey * 1000000000 + l_suppkey) * 4 + flag + 4000000000000000000 AS VARCHAR), 'HAS_TRADE_EQUIVALENT', 'IS_TRADE_EQUIVALENT_OF' FROM facts))""",
         "words", "names", "gp", "facts")

# ---------------------------------------------------------------- fixtures over it
_LEVEL_LIST = "[" + listing(LEVELS) + "]"
fragment("node_sample", f"SELECT *, row_number() OVER (PARTITION BY level ORDER BY {digest('q', 'tmtid')}, tmtid) AS r FROM nodes QUALIFY r <= 6", "nodes")
fragment("nation_sample", f"SELECT n_name, row_number() OVER (ORDER BY {digest('m', 'n_name')}, n_name) AS r FROM nation QUALIFY r <= 4")
fragment("requests", f"""
    SELECT 'r|' || tmtid AS query_id, coalesce(trade_name, name) AS text,
           CASE r WHEN 1 THEN {_LEVEL_LIST} WHEN 2 THEN ['TP', 'TPU'] WHEN 3 THEN ['GP'] ELSE NULL END AS levels,
           CASE WHEN r = 3 THEN true END AS f_nlem, CASE WHEN r = 3 AND level = 'GPU' THEN 'ก' END AS f_nlem_category,
           CASE WHEN r = 4 AND manufacturer IS NOT NULL THEN regexp_extract(manufacturer, '(NATION_\\d+)$', 1) END AS f_manufacturer,
           CASE WHEN r = 5 THEN tmtid END AS f_tmtid, [coalesce(generic_name, name)] AS seed_terms,
           0.4 AS v_weight, 0.35 AS t_weight, 0.25 AS g_weight, CASE WHEN r % 2 = 0 THEN 'lookup' ELSE 'retrieve' END AS strategy,
           10 AS k, 2 AS hops, tmtid FROM node_sample""", "node_sample")
PASSES = ("(q.levels IS NULL OR list_contains(q.levels, n.level)) AND (q.f_nlem IS NULL OR coalesce(n.nlem = q.f_nlem, false)) "
          "AND (q.f_nlem_category IS NULL OR coalesce(n.nlem_category = q.f_nlem_category, false)) "
          "AND (q.f_manufacturer IS NULL OR contains(lower(coalesce(n.manufacturer, '')), lower(q.f_manufacturer))) "
          "AND (q.f_tmtid IS NULL OR n.tmtid = q.f_tmtid)")
_TEMPLATES = """CASE p_partkey % 12
    WHEN 0 THEN 'what is tmtid ' || (p_partkey + 1000000) WHEN 1 THEN 'drug information about ' || p_name
    WHEN 2 THEN 'list drugs containing ' || word WHEN 3 THEN 'how many drugs containing ' || word || ' ' || p_size || ' mg'
    WHEN 4 THEN 'list drugs by manufacturer NATION_' || (p_partkey % 25) WHEN 5 THEN 'compare ' || word || ' vs ' || adj
    WHEN 6 THEN 'is ' || p_brand || ' ' || p_name || ' made by NATION_' || (p_partkey % 25) || '?'
    WHEN 7 THEN 'show all ' || lower(p_type) || ' ' || p_name || ' in category ' || letter
    WHEN 8 THEN 'hello ' || p_name WHEN 9 THEN 'does ' || p_name || ' ' || p_size || 'mg exist in the nlem list'
    WHEN 10 THEN 'what are the trade names of ' || word || ' ' || p_size || ' mg' ELSE 'who manufactures ' || p_name END"""
fragment("templated", f"SELECT 'p|' || p_partkey AS query_id, {_TEMPLATES} AS question FROM (SELECT *, split_part(p_name, ' ', 1) AS adj, "
                      "substr('abcde', CAST(p_size % 5 + 1 AS INTEGER), 1) AS letter FROM gp)", "gp")
fragment("asked", "SELECT query_id, question FROM templated UNION ALL SELECT 'c|' || conv_id || '|' || turn, text FROM conversations WHERE role = 'user'", "templated")
fragment("substances", "SELECT tmtid AS query_id, lower(name) AS substance FROM nodes WHERE level = 'SUBS'", "nodes")
fragment("makers", "SELECT DISTINCT manufacturer FROM nodes WHERE level = 'TP' AND manufacturer IS NOT NULL", "nodes")
_RAW = "(SELECT manufacturer FROM makers UNION ALL SELECT n_name FROM nation)"
fragment("maker_dim", f"SELECT DISTINCT manufacturer, lower(manufacturer) AS folded FROM (SELECT manufacturer FROM {_RAW} UNION ALL "
                      f"SELECT {squash('''regexp_replace(regexp_replace(manufacturer, ',\\s*[A-Z.]+$', ''), '\\s*\\([^)]*\\)\\s*', ' ', 'g')''')} FROM {_RAW}) "
                      f"WHERE trim(manufacturer) <> '' AND NOT contains(manufacturer, {quote(lx.HOSPITAL)})", "makers")

# ---------------------------------------------------------------- the tree below a substance
fragment("chain", """SELECT DISTINCT a.query_id, s.tmtid AS subs, v.tmtid AS vtm, g.tmtid AS gp FROM substances a
    JOIN nodes s ON s.level = 'SUBS' AND lower(s.name) = a.substance
    JOIN edges e1 ON e1.src_id = s.tmtid AND e1.type = 'IS_ACTIVE_SUBSTANCE_OF' JOIN nodes v ON v.tmtid = e1.dst_id AND v.level = 'VTM'
    JOIN edges e2 ON e2.dst_id = v.tmtid AND e2.type = 'HAS_VTM' JOIN nodes g ON g.tmtid = e2.src_id AND g.level = 'GP'""",
         "substances", "nodes", "edges")
fragment("members", """SELECT DISTINCT query_id, level, node_id FROM (
    SELECT query_id, 'SUBS' AS level, subs AS node_id FROM chain UNION ALL SELECT query_id, 'VTM', vtm FROM chain
    UNION ALL SELECT query_id, 'GP', gp FROM chain
    UNION ALL SELECT query_id, 'GPU', dst_id FROM chain JOIN edges ON src_id = gp AND type = 'HAS_GENERIC_UNIT'
    UNION ALL SELECT query_id, 'TP', dst_id FROM chain JOIN edges ON src_id = gp AND type = 'HAS_TRADE_PRODUCT'
    UNION ALL SELECT query_id, 'TPU', b.dst_id FROM chain JOIN edges a ON a.src_id = gp AND a.type = 'HAS_TRADE_PRODUCT'
              JOIN edges b ON b.src_id = a.dst_id AND b.type = 'HAS_TRADE_UNIT')""", "chain", "edges")
LEVEL_RANK = "CASE level " + " ".join(f"WHEN '{lv}' THEN {i + 1}" for i, lv in enumerate(ANCHOR_LEVEL_ORDER)) + " ELSE 7 END"
