"""SQL for a whole search over a table of requests, fragment by fragment.

``search(req, p, ...)`` adds fragments named ``<p>_...`` that work on the
relation ``req`` and ends with ``<p>_seeds``.
"""

from __future__ import annotations

from ..functions import lexicon as lx
from . import sql as S

WORDS = r"'[^\p{L}\p{M}\p{N}]+'"
S.fragment("docs", f"""SELECT node_id, words, ' ' || array_to_string(words, ' ') || ' ' AS doc, len(words) AS dl FROM (
    SELECT node_id, list_filter(regexp_split_to_array(lower(concat_ws(' ', name, fsn, trade_name, generic_name, active_substance, strength, dosageform, manufacturer)),
      {WORDS}), lambda w: w <> '') AS words FROM nodes)""", "nodes")
S.fragment("doc_stats", "SELECT count(*) AS n, avg(dl) AS mean_len FROM docs", "docs")
S.fragment("und", "SELECT src_id AS node_id, dst_id AS other_id, edge_id, type FROM edges UNION ALL SELECT dst_id, src_id, edge_id, type FROM edges", "edges")
S.fragment("degree", "SELECT node_id, count(*) AS deg FROM und GROUP BY node_id", "und")

NOISE = "[" + S.listing(lx.TERM_NOISE) + "]"
THAI = "[" + S.listing(lx.THAI_STOPWORDS) + "]"


def term_lists(source: str, text: str = "text") -> str:
    """Rows of ``source`` with ``terms``, the up to four most telling terms of ``text``; rows without any are left out."""
    def telling(values: str) -> str:
        return S.distinct_in_order(f"list_filter(list_transform({values}, lambda t: trim(t)), lambda t: NOT list_contains({NOISE}, lower(t)))")
    score = (f"(CASE WHEN regexp_matches(t, '[0-9]') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '[A-Za-z]') THEN 2 ELSE 0 END "
             f"+ CASE WHEN regexp_matches(t, '[฀-๿]') THEN 2 ELSE 0 END + least(4, length(t) // 4))")
    return f"""SELECT * EXCLUDE (doses, latin, numbers, thai, loose, kept), list_transform(list_sort(list_transform(kept, lambda t, i: {{'s': -{score}, 'i': i, 't': t}})), lambda x: x.t)[1:4] AS terms
      FROM (SELECT *, CASE WHEN len(kept0) > 0 THEN kept0 ELSE {telling('loose')} END AS kept FROM (
        SELECT *, {telling('list_concat(doses, latin, numbers, thai)')} AS kept0 FROM (
          SELECT *, list_filter(numbers0, lambda n: NOT list_bool_or(list_transform(doses, lambda dd: contains(dd, n)))
                    OR len(doses) = 0) AS numbers FROM (
            SELECT *, regexp_extract_all({text}, {S.quote(lx.DOSE_TERM)}, 0, 'i') AS doses,
              list_filter(regexp_extract_all({text}, {S.quote(lx.LATIN_TERM)}), lambda t: length(t) >= 2) AS latin,
              regexp_extract_all({text}, {S.quote(lx.NUMBER_TERM)}) AS numbers0,
              list_filter(regexp_extract_all({text}, {S.quote(lx.THAI_TERM)}), lambda t: length(t) > 1 AND NOT list_contains({THAI}, t)) AS thai,
              regexp_extract_all({text}, {S.quote(lx.LOOSE_TERM)}) AS loose FROM {source})))) WHERE len(kept) > 0"""


def search(req: str, p: str, vectors: str | None, *needs: str, limit: int = 20) -> None:
    """Register the fragments of a search over relation ``req`` (with its ``k`` already at least 8)."""
    f = S.fragment
    f(f"{p}_seedlists", f"""SELECT query_id, {S.distinct_in_order('raw')}[1:4] AS terms FROM (SELECT query_id, list_filter(list_concat([{S.squash('text')}],
        coalesce(seed_terms, []), [{S.squash('text')}, {S.squash('f_manufacturer')}, {S.squash('f_tmtid')}]), lambda t: length(t) >= 2) AS raw FROM {req})""", *needs)
    f(f"{p}_seedterms", f"SELECT query_id, UNNEST(terms) AS text, generate_subscripts(terms, 1) - 1 AS term_no FROM {p}_seedlists", f"{p}_seedlists")
    f(f"{p}_texts", f"SELECT text FROM {req} UNION SELECT text FROM {p}_seedterms", f"{p}_seedterms")
    f(f"{p}_termlists", term_lists(f"{p}_texts"), f"{p}_texts")
    f(f"{p}_terms", f"""SELECT DISTINCT text, UNNEST(CASE WHEN contains(trim(term), ' ') THEN [flat] ELSE string_split(flat, ' ') END) AS token FROM (
        SELECT text, term, trim(regexp_replace(lower(term), {WORDS}, ' ', 'g')) AS flat FROM (SELECT text, UNNEST(terms) AS term FROM {p}_termlists)) WHERE flat <> ''""", f"{p}_termlists")
    f(f"{p}_post", f"""SELECT token, node_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT node_id, dl, UNNEST(words) AS token FROM docs)
        WHERE token IN (SELECT token FROM {p}_terms) GROUP BY token, node_id
        UNION ALL SELECT t.token, d.node_id, CAST((length(replace(doc, ' ', '  ')) - length(replace(replace(doc, ' ', '  '), ph, ''))) / length(ph) AS BIGINT), d.dl
        FROM (SELECT DISTINCT token, ' ' || replace(token, ' ', '  ') || ' ' AS ph FROM {p}_terms WHERE contains(token, ' ')) t JOIN docs d ON contains(d.doc, ' ' || t.token || ' ')""", f"{p}_terms", "docs")
    f(f"{p}_idf", f"SELECT token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT token, count(*) AS df FROM {p}_post GROUP BY token), doc_stats", f"{p}_post", "doc_stats")
    f(f"{p}_hits", f"""SELECT text, node_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))), 9) AS score,
        row_number() OVER (PARTITION BY text ORDER BY round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean_len))), 9) DESC, node_id) AS rank
        FROM {p}_terms JOIN {p}_post USING (token) JOIN {p}_idf USING (token), doc_stats GROUP BY text, node_id QUALIFY rank <= {limit}""", f"{p}_terms", f"{p}_post", f"{p}_idf")
    f(f"{p}_t", f"""SELECT q.query_id, h.node_id, h.score AS t_score, row_number() OVER (PARTITION BY q.query_id ORDER BY h.rank) - 1 AS t_rank
        FROM {req} q JOIN {p}_hits h ON h.text = q.text AND h.rank <= greatest(2 * q.k, 12) JOIN nodes n ON n.node_id = h.node_id WHERE {S.PASSES}""", f"{p}_hits", "nodes")
    if vectors:
        f(f"{p}_vbest", f"""SELECT v.query_id, n.node_id, round(list_cosine_similarity(n.vec::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score,
            row_number() OVER (PARTITION BY v.query_id ORDER BY round(list_cosine_similarity(n.vec::DOUBLE[], v.embedding::DOUBLE[]), 9) DESC, n.node_id) AS rank
            FROM {vectors} v, nodes n WHERE n.vec IS NOT NULL QUALIFY rank <= {limit}""", "nodes", vectors)
        f(f"{p}_v", f"""SELECT q.query_id, b.node_id, b.score AS v_score, row_number() OVER (PARTITION BY q.query_id ORDER BY b.rank) - 1 AS v_rank
            FROM {req} q JOIN {p}_vbest b ON b.query_id = q.query_id AND b.rank <= greatest(2 * q.k, 12) JOIN nodes n ON n.node_id = b.node_id WHERE {S.PASSES}""", f"{p}_vbest")
    else:
        f(f"{p}_v", "SELECT NULL::VARCHAR AS query_id, NULL::VARCHAR AS node_id, NULL::DOUBLE AS v_score, NULL::BIGINT AS v_rank WHERE false")
    cols = ("name", "fsn", "trade_name", "generic_name", "active_substance", "manufacturer")
    f(f"{p}_literal", f"""SELECT t.text, n.node_id, row_number() OVER (PARTITION BY t.text ORDER BY {S.LEVEL_RANK}, coalesce(n.trade_name, n.fsn, n.name), n.node_id) - 1 AS rank
        FROM (SELECT DISTINCT lower(text) AS text FROM {p}_seedterms WHERE text NOT IN (SELECT text FROM {p}_hits)) t
        JOIN nodes n ON {S.contains_any('t.text', cols)} OR n.tmtid = t.text QUALIFY rank < {limit}""", f"{p}_hits", "nodes")
    f(f"{p}_bound", f"SELECT query_id, greatest(8, 2 * k, 12) AS n, lower(f_manufacturer) AS maker, f_tmtid AS id FROM {req}", *needs)
    f(f"{p}_pool", f"""SELECT s.query_id, h.node_id, h.score, h.rank - 1 AS rank, s.term_no AS source FROM {p}_seedterms s JOIN {p}_hits h ON h.text = s.text JOIN {p}_bound b ON b.query_id = s.query_id AND h.rank <= b.n
        UNION ALL SELECT s.query_id, l.node_id, 200.0 - l.rank, l.rank, s.term_no FROM {p}_seedterms s JOIN {p}_literal l ON l.text = lower(s.text) JOIN {p}_bound b ON b.query_id = s.query_id AND l.rank < b.n
          WHERE s.text NOT IN (SELECT text FROM {p}_hits)
        UNION ALL SELECT query_id, node_id, 350.0 - rank, rank, 90 FROM (SELECT b.query_id, b.n, x.node_id, row_number() OVER (PARTITION BY b.query_id ORDER BY x.node_id) - 1 AS rank
          FROM {p}_bound b JOIN nodes x ON b.maker <> '' AND x.level IN ('TP', 'TPU') AND contains(lower(x.manufacturer), b.maker)) WHERE rank < n
        UNION ALL SELECT b.query_id, x.node_id, 999.0, 0, 91 FROM {p}_bound b JOIN nodes x ON x.tmtid = b.id""", f"{p}_literal", f"{p}_bound")
    f(f"{p}_anchors", f"""SELECT * FROM (SELECT query_id, node_id, score, rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank, node_id) AS place FROM (
        SELECT * FROM {p}_pool QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY score DESC, source) = 1)) JOIN {p}_bound USING (query_id) WHERE place <= n""", f"{p}_pool")
    f(f"{p}_trails", f"""SELECT anchor, node_id, hop, count(*) AS paths FROM (
        SELECT DISTINCT node_id AS anchor, node_id, 0 AS hop FROM {p}_anchors
        UNION ALL SELECT a.node_id, e.other_id, 1 FROM (SELECT DISTINCT node_id FROM {p}_anchors) a JOIN und e ON e.node_id = a.node_id
        UNION ALL SELECT a.node_id, e2.other_id, 2 FROM (SELECT DISTINCT node_id FROM {p}_anchors) a JOIN und e1 ON e1.node_id = a.node_id
          JOIN und e2 ON e2.node_id = e1.other_id AND e2.edge_id <> e1.edge_id) GROUP BY ALL""", f"{p}_anchors", "und")
    f(f"{p}_g", f"""SELECT query_id, node_id, graph_hop, graph_support, 1.0 / (1 + graph_hop) + least(0.45, ln(1 + graph_support) / 6.0) AS g_score, g_rank FROM (
        SELECT q.query_id, q.k, n.node_id, x.graph_hop, x.graph_support, row_number() OVER (PARTITION BY q.query_id ORDER BY x.graph_hop, x.graph_support DESC, n.node_id) - 1 AS g_rank
        FROM (SELECT a.query_id, t.node_id, min(t.hop) AS graph_hop, CAST(sum(t.paths) AS BIGINT) AS graph_support FROM {p}_anchors a JOIN {req} r USING (query_id)
              JOIN {p}_trails t ON t.anchor = a.node_id AND t.hop <= r.hops GROUP BY ALL) x
        JOIN {req} q ON q.query_id = x.query_id JOIN nodes n ON n.node_id = x.node_id WHERE {S.PASSES}) WHERE g_rank < greatest(2 * k, 12)""", f"{p}_trails", "nodes")
    f(f"{p}_fused", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, v_rank, t_rank, g_rank, node_id) AS fused_rank FROM (
        SELECT c.query_id, c.node_id, c.v_rank, c.t_rank, c.g_rank, c.graph_hop, c.graph_support, q.k,
          round((greatest(0, q.v_weight) * CASE WHEN v_rank >= 9999 THEN 0 ELSE 1.0 / (61 + v_rank) END + greatest(0, q.t_weight) * CASE WHEN t_rank >= 9999 THEN 0 ELSE 1.0 / (61 + t_rank) END
          + greatest(0, q.g_weight) * CASE WHEN g_rank >= 9999 THEN 0 ELSE 1.0 / (61 + g_rank) END) / (q.v_weight + q.t_weight + q.g_weight), 12) AS rrf_score
        FROM (SELECT query_id, node_id, coalesce(min(v_rank), 9999) AS v_rank, coalesce(min(t_rank), 9999) AS t_rank, coalesce(min(g_rank), 9999) AS g_rank, min(graph_hop) AS graph_hop, max(graph_support) AS graph_support FROM (
          SELECT query_id, node_id, v_rank, NULL AS t_rank, NULL AS g_rank, NULL AS graph_hop, NULL AS graph_support FROM {p}_v
          UNION ALL SELECT query_id, node_id, NULL, t_rank, NULL, NULL, NULL FROM {p}_t
          UNION ALL SELECT query_id, node_id, NULL, NULL, g_rank, graph_hop, graph_support FROM {p}_g) GROUP BY query_id, node_id) c JOIN {req} q USING (query_id))
        QUALIFY fused_rank <= k""", f"{p}_v", f"{p}_t", f"{p}_g")
    equal = " OR ".join(f"lower(coalesce(n.{c}, '')) = q.term" for c in ("fsn", "trade_name", "name", "generic_name"))
    prefix = " OR ".join(f"starts_with(lower(coalesce(n.{c}, '')), q.term)" for c in ("fsn", "trade_name", "name", "generic_name"))
    f(f"{p}_exact", f"""SELECT query_id, node_id, pri, delta, row_number() OVER (PARTITION BY query_id ORDER BY pri, delta, node_id) - 1 AS exact_rank, k FROM (
        SELECT q.query_id, q.k, n.node_id, CASE WHEN {equal} THEN 0 WHEN {prefix} THEN 1 ELSE 2 END AS pri,
          abs(length(coalesce(n.fsn, n.trade_name, n.name, n.generic_name, '')) - length(q.term)) AS delta
        FROM (SELECT *, lower({S.squash('text')}) AS term FROM {req} WHERE strategy = 'lookup') q JOIN nodes n ON length(q.term) >= 3 AND {S.contains_any('q.term')} WHERE {S.PASSES})
        QUALIFY exact_rank < k""", "nodes", *needs)
    f(f"{p}_seeds", f"""SELECT query_id, node_id, v_rank, t_rank, g_rank, exact_rank, rrf_score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, v_rank, t_rank, g_rank, exact_rank, node_id) AS rank FROM (
          SELECT coalesce(f.query_id, x.query_id) AS query_id, coalesce(f.node_id, x.node_id) AS node_id, coalesce(v_rank, 9999) AS v_rank, coalesce(t_rank, 9999) AS t_rank,
            coalesce(g_rank, 9999) AS g_rank, coalesce(x.exact_rank, 9999) AS exact_rank,
            round(coalesce(f.rrf_score, 0) + CASE WHEN x.exact_rank IS NULL THEN 0 WHEN x.exact_rank = 0 THEN 0.45 ELSE greatest(0.15, 0.35 - x.exact_rank * 0.02) END, 12) AS rrf_score
          FROM {p}_fused f FULL OUTER JOIN {p}_exact x ON x.query_id = f.query_id AND x.node_id = f.node_id)) s
        JOIN (SELECT query_id AS qid, greatest(3 * k0, 24) AS cap FROM (SELECT query_id, {'k0' if p.startswith('b') else 'k AS k0'} FROM {req})) c ON c.qid = s.query_id WHERE rank <= cap""", f"{p}_fused", f"{p}_exact")


def paths(seeds: str, p: str, cap: int | None = 80) -> None:
    """Fragments ``<p>_paths``, ``<p>_ctx`` and ``<p>_rels`` of the context around ``seeds`` (query_id, node_id, rank, depth)."""
    limit = f"QUALIFY path_no <= {cap}" if cap else ""
    S.fragment(f"{p}_paths", f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, hop, e1, e2, e3) AS path_no FROM (
        SELECT s.query_id, s.rank, 1 AS hop, s.node_id AS n0, a.edge_id AS e1, a.other_id AS n1, NULL AS e2, NULL AS n2, NULL AS e3, NULL AS n3 FROM {seeds} s JOIN und a ON a.node_id = s.node_id
        UNION ALL SELECT s.query_id, s.rank, 2, s.node_id, a.edge_id, a.other_id, b.edge_id, b.other_id, NULL, NULL FROM {seeds} s JOIN und a ON a.node_id = s.node_id
          JOIN und b ON b.node_id = a.other_id AND b.edge_id <> a.edge_id WHERE s.depth >= 2
        UNION ALL SELECT s.query_id, s.rank, 3, s.node_id, a.edge_id, a.other_id, b.edge_id, b.other_id, c.edge_id, c.other_id FROM {seeds} s JOIN und a ON a.node_id = s.node_id
          JOIN und b ON b.node_id = a.other_id AND b.edge_id <> a.edge_id JOIN und c ON c.node_id = b.other_id AND c.edge_id <> a.edge_id AND c.edge_id <> b.edge_id WHERE s.depth >= 3) {limit}""", seeds, "und")
    S.fragment(f"{p}_ctx", f"""SELECT x.query_id, x.node_id, EXISTS (SELECT 1 FROM {seeds} s WHERE s.query_id = x.query_id AND s.node_id = x.node_id) AS is_seed, min(pos_at) AS found_at FROM (
        SELECT query_id, n0 AS node_id, path_no * 10 AS pos_at FROM {p}_paths UNION ALL SELECT query_id, n1, path_no * 10 + 1 FROM {p}_paths
        UNION ALL SELECT query_id, n2, path_no * 10 + 2 FROM {p}_paths WHERE n2 IS NOT NULL UNION ALL SELECT query_id, n3, path_no * 10 + 3 FROM {p}_paths WHERE n3 IS NOT NULL) x GROUP BY ALL""", f"{p}_paths")
    S.fragment(f"{p}_rels", f"""SELECT u.query_id, e.src_id AS start_id, e.type, e.dst_id AS end_id, min(pos_at) AS found_at FROM (
        SELECT query_id, e1 AS edge_id, path_no * 10 + 1 AS pos_at FROM {p}_paths UNION ALL SELECT query_id, e2, path_no * 10 + 2 FROM {p}_paths WHERE e2 IS NOT NULL
        UNION ALL SELECT query_id, e3, path_no * 10 + 3 FROM {p}_paths WHERE e3 IS NOT NULL) u
        JOIN edges e USING (edge_id) GROUP BY ALL""", f"{p}_paths", "edges")
