"""The queries that SQL can express, as DuckDB SQL over the same tables."""

from __future__ import annotations

SQL: dict[str, str] = {}

#: The unsigned CRC-32 of an ASCII text, bit by bit.
CRC = """xor(list_reduce(list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT),
   lambda c, b: list_reduce(range(8)::BIGINT[], lambda r, k: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(c, b)), 4294967295), 4294967295)"""

#: Levels, siblings and versions as recursive queries over all leaves.
SQL["op13_merkle_manifest"] = """WITH RECURSIVE
raw AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, text,
   list_transform([doc_id::VARCHAR, source, lang, n_chars::VARCHAR], lambda v: coalesce(strlen(v)::VARCHAR || ':' || v, '-')) AS fields FROM documents),
leaves AS (SELECT doc_id, tree, sha256(array_to_string(fields, '') || coalesce(strlen(text)::VARCHAR || ':' || text, '-')) AS leaf,
   CASE WHEN """ + CRC.format(text="doc_id::VARCHAR") + """ % 3 = 0 THEN sha256(array_to_string(fields, '') || coalesce(strlen(low)::VARCHAR || ':' || low, '-')) END AS other FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes(tree, level, pos, node, n) AS (SELECT tree, 0, pos, leaf, n FROM placed
   UNION ALL SELECT tree, level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 8, n),
subs AS (SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, node, n) AS (SELECT 0, pos, subroot, n FROM subs
   UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, pos // 8, n),
steps AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
   FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
above AS (SELECT a.level, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos < a.pos), '') AS l, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (WHERE b.pos > a.pos), '') AS r
   FROM tops a JOIN tops b ON a.level = b.level AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY ALL),
path AS (SELECT p.tree, p.pos, s.level, s.l, s.r FROM placed p JOIN steps s ON s.tree = p.tree AND s.pos = p.pos // (8 ** s.level)::BIGINT
   UNION ALL SELECT p.tree, p.pos, 1000 + s.level, s.l, s.r FROM placed p JOIN subs USING (tree) JOIN above s ON s.pos = subs.pos // (8 ** s.level)::BIGINT),
ways AS (SELECT tree, pos, list(l || '|' || r ORDER BY level) AS way, sha256(string_agg(l || r, '' ORDER BY level)) AS proof FROM path GROUP BY 1, 2),
ends AS (SELECT p.*, subs.subroot, (SELECT node FROM tops WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
   list_reduce(coalesce(way, []::VARCHAR[]), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2)), coalesce(other, leaf)) AS folded_root
   FROM placed p JOIN subs USING (tree) LEFT JOIN ways ON ways.tree = p.tree AND ways.pos = p.pos)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM ends"""


#: Per state after each row the least (cost, audit), row by row; then the audit is walked again for the lines.
_BLANKS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _least(*ways: str) -> str:
    return "list_min([" + ", ".join(ways) + "])"


def _way(frm: str, cost, edit: str, cond: str | None = None) -> str:
    w = f"{{'c': {frm}.c + {cost}, 'a': {frm}.a || '{edit}'}}"
    return f"CASE WHEN {cond} THEN {w} END" if cond else w


_OK = "fault NOT IN ('b', 'd')"
_SHORT = "(CASE WHEN fault = 't' THEN 5 ELSE 0 END)"


def _moves(frm: str, initial: str) -> list[str]:
    kept = _way(frm, _SHORT, "K", f"{_OK} AND initial = '{initial}'")
    return [kept] if initial == "s" else [kept, _way(frm, f"1 + {_SHORT}", "R", _OK)]


SQL["op11_conversation_repair"] = rf"""WITH RECURSIVE
plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS label FROM conversations),
drawn AS (SELECT *, {CRC.format(text='label')} % 20 AS kind FROM plain),
hurt AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
   unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE kind <> 0),
placed AS (SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, role, text, left(role, 1) AS initial, rtrim(text, {_BLANKS}) AS bare,
   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt),
rows AS (SELECT conv, turn, role, text, initial, i, lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair,
   CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
counts AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
   count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY 1),
best(conv, i, o, s, u, a) AS (
   SELECT conv, 0::BIGINT, {{'c': 0, 'a': ''}}, NULL::STRUCT(c INTEGER, a VARCHAR), {{'c': 5, 'a': 'I'}}, {{'c': 10, 'a': 'II'}} FROM counts
   UNION ALL SELECT conv, i, o, s, {_least("u", _way("o", 5, "I"), "CASE WHEN s IS NOT NULL THEN " + _way("s", 5, "I") + " END", _way("a", 5, "I"))},
      {_least("a", _way("u", 5, "I"), _way("o", 10, "II"), "CASE WHEN s IS NOT NULL THEN " + _way("s", 10, "II") + " END")}
   FROM (SELECT conv, b.i + 1 AS i, {_way("o", 2, "D")} AS o,
      {_least("CASE WHEN s IS NOT NULL THEN " + _way("s", 2, "D") + " END", *_moves("o", "s"))} AS s,
      {_least(_way("u", 2, "D"), *_moves("o", "u"), *["CASE WHEN s IS NOT NULL THEN " + m + " END" for m in _moves("s", "u")], *_moves("a", "u"))} AS u,
      {_least(_way("a", 2, "D"), *_moves("u", "a"))} AS a
      FROM best b JOIN rows r USING (conv) WHERE r.i = b.i + 1)),
chosen AS (SELECT conv, n, least(o, a) AS best FROM best JOIN counts USING (conv) WHERE i = n),
walk(conv, step, i, state, lines) AS (SELECT conv, 0, 0::BIGINT, '0', []::VARCHAR[] FROM chosen
   UNION ALL SELECT w.conv, step + 1, w.i + (edit <> 'I')::INT, CASE WHEN edit = 'D' THEN state WHEN edit = 'K' THEN initial WHEN state = 'u' THEN 'a' ELSE 'u' END,
      CASE WHEN edit = 'D' THEN lines WHEN edit = 'K' THEN list_append(lines, role || ':' || text)
         ELSE list_append(lines, CASE WHEN state = 'u' THEN 'assistant:' ELSE 'user:' END || CASE WHEN edit = 'R' THEN text ELSE '' END) END
   FROM (SELECT w.*, substr(best.a, step + 1, 1) AS edit FROM walk w JOIN chosen USING (conv) WHERE step < length(best.a)) w LEFT JOIN rows r ON r.conv = w.conv AND r.i = w.i + 1),
told AS (SELECT conv, best.c AS cost, best.a AS audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM chosen JOIN walk USING (conv) WHERE step = length(best.a))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
   coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN counts ON counts.conv = coalesce(c.conv_id::VARCHAR, '') LEFT JOIN told ON told.conv = counts.conv"""

#: All pairs of sets that share a shingle, counted exactly; components by reaching along links.
SQL["op12_near_dedup"] = r"""WITH RECURSIVE
split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
described AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS grams FROM split),
keyed AS (SELECT doc_id, len(grams) AS n_shingles, md5(array_to_string(list_sort(grams), chr(10))) AS k, grams FROM described),
sets AS (SELECT k, any_value(grams) AS grams, min(doc_id) AS first FROM keyed WHERE n_shingles > 0 GROUP BY 1),
held AS (SELECT k, len(grams) AS n, unnest(grams) AS gram FROM sets),
pairs AS (SELECT x.k AS a, y.k AS b, count(*) AS common, any_value(x.n) AS n, any_value(y.n) AS m FROM held x JOIN held y ON x.gram = y.gram AND x.k < y.k GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (n + m - common)),
facing AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(k, first) AS (SELECT k, first FROM sets UNION SELECT f.b, r.first FROM reach r JOIN facing f ON f.a = r.k),
roots AS (SELECT k, min(first) AS root FROM reach GROUP BY 1)
SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE root END AS component_id,
   doc_id IS NOT DISTINCT FROM CASE WHEN n_shingles = 0 THEN doc_id ELSE root END AS kept
FROM keyed LEFT JOIN roots USING (k)"""
