"""SQL for the text queries that SQL can express on whole tables."""

from __future__ import annotations

#: White space as characters, and as a class of regular expressions.
SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

LINES = """d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)"""

LINE_DEDUP = f"""WITH {LINES},
keyed AS (SELECT *, translate(trim(line, {SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
owned AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT k.doc_id, k.line, k.pos, o.owner IS NOT NULL AND k.doc_id > o.owner AS dropped FROM keyed k LEFT JOIN owned o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256 FROM judged GROUP BY doc_id"""

QUALITY = f"""WITH {LINES},
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '{WORD}') AS words FROM d),
place AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5) x),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM place) x WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2), (3), (4)) AS o(k) GROUP BY doc_id),
filled AS (SELECT doc_id, source, line, regexp_replace(regexp_replace(lower(trim(line, {SPACES})), '{GAP}', ' ', 'g'), '[0-9]+', '0', 'g') AS normal FROM line WHERE regexp_matches(line, '{WORD}')),
repeated AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM filled GROUP BY doc_id),
host AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
above AS (SELECT f.source, f.normal FROM filled f JOIN host h ON f.source = h.source GROUP BY f.source, f.normal, h.docs HAVING count(DISTINCT f.doc_id) > 10 AND count(DISTINCT f.doc_id) > 0.005 * h.docs),
lost AS (SELECT f.doc_id, sum(length(f.normal) - length(replace(f.normal, ' ', '')) + 1) AS n FROM filled f JOIN above a ON f.source = a.source AND f.normal = a.normal GROUP BY f.doc_id),
counted AS (SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, CAST(length(regexp_replace(w.text, '{GAP}', '', 'g')) AS BIGINT) AS word_chars, CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(l.n, 0) AS BIGINT) AS n_frequent_line_words FROM w LEFT JOIN repeated r ON w.doc_id = r.doc_id LEFT JOIN covered c ON w.doc_id = c.doc_id LEFT JOIN lost l ON w.doc_id = l.doc_id),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - n_frequent_line_words >= 0.5 * n_words AND n_words - n_frequent_line_words >= 10 AS kept, n_frequent_line_words FROM judged"""

REPEATS = f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
place AS (SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 49), ' ')) AS run FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50) x),
copied AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS least FROM place) x WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(0, 50)) AS k FROM copied) x),
word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
left_over AS (SELECT o.doc_id, o.word, o.i, g.i IS NOT NULL AS gone FROM word o LEFT JOIN gone g ON o.doc_id = g.doc_id AND o.i = g.i),
summed AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM left_over GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(s.n_removed, 0) AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256 FROM w LEFT JOIN summed s ON w.doc_id = s.doc_id"""


def _crc(value: str) -> str:
    """CRC-32 of a text of ASCII characters, bit by bit: a byte is mixed in, then eight steps (-1) follow."""
    marks = ", ".join(["-1"] * 8)
    steps = f"flatten(list_transform(range(1, length({value}) + 1), lambda i: [CAST(ascii(substr({value}, CAST(i AS BIGINT), 1)) AS BIGINT), {marks}]))"
    return f"xor(4294967295, list_reduce({steps}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, 4294967295))"


def _field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _climb(name: str, levels: int) -> str:
    """Tables name_1, name_2 ... over name_0 (key, idx, hash, n): every eight nodes in a run become one; a lone node stays."""
    step = "{name}_{k} AS (SELECT key, idx // 8 AS idx, CASE WHEN max(n) = 1 THEN max(hash) ELSE sha256(string_agg(hash, '' ORDER BY idx)) END AS hash, (max(n) + 7) // 8 AS n FROM {name}_{j} GROUP BY key, idx // 8)"
    return ", ".join(step.format(name=name, k=k, j=k - 1) for k in range(1, levels + 1))


def _descend(name: str, start: str, rows: str, levels: int) -> str:
    """From `start` (row id, key, idx, now, proof) up: the siblings of each level are joined on, and the row's own node is folded."""
    step = """{rows}_{k} AS (SELECT r.id, any_value(r.key) AS key, any_value(r.idx) // 8 AS idx,
  CASE WHEN any_value(s.n) = 1 THEN any_value(r.now) ELSE sha256(string_agg(CASE WHEN s.idx = r.idx THEN r.now ELSE s.hash END, '' ORDER BY s.idx)) END AS now,
  any_value(r.proof) || coalesce(string_agg(s.hash, '' ORDER BY s.idx) FILTER (WHERE s.idx <> r.idx), '') AS proof FROM {start} r JOIN {name}_{j} s ON r.key = s.key AND r.idx // 8 = s.idx // 8 GROUP BY r.id)"""
    return ", ".join(step.format(name=name, rows=rows, k=k, j=k - 1, start=start if k == 1 else f"{rows}_{k - 1}") for k in range(1, levels + 1))


#: Levels that are written out: 8^6 rows of a language, 8^2 languages; a table with more of either needs more.
UP, TOP = 6, 2
MERKLE = f"""WITH row_ AS (SELECT doc_id, row_number() OVER () AS id, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS key, {_leaf('text')} AS leaf,
  CASE WHEN {_crc('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf('text')} END AS now FROM documents),
leaf_ AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY key) AS n FROM row_),
node_0 AS (SELECT key, idx, leaf AS hash, n FROM leaf_), {_climb('node', UP)},
top_0 AS (SELECT '' AS key, key AS lang_key, row_number() OVER (ORDER BY key) - 1 AS idx, hash, count(*) OVER () AS n FROM node_{UP}), {_climb('top', TOP)},
start_ AS (SELECT id, key, idx, now, '' AS proof FROM leaf_), {_descend('node', 'start_', 'up', UP)},
turn_ AS (SELECT u.id, '' AS key, t.idx, u.now, u.proof, t.hash AS subroot FROM up_{UP} u JOIN top_0 t ON u.key = t.lang_key), {_descend('top', 'turn_', 'over', TOP)}
SELECT l.doc_id, l.leaf, t.subroot, r.hash AS root, sha256(o.proof) AS proof_sha256, o.now AS folded_root, o.now = r.hash AS verified
FROM leaf_ l JOIN turn_ t ON l.id = t.id JOIN over_{TOP} o ON l.id = o.id CROSS JOIN top_{TOP} r"""

NEIGHBOURS = """WITH RECURSIVE v AS (SELECT row_number() OVER () AS i, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.i AS a, b.i AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.e) = len(b.e) AND a.i <> b.i WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT a AS i, b AS j FROM link UNION SELECT r.i, l.b FROM reach r JOIN link l ON r.j = l.a),
least AS (SELECT r.i, min(v.vec_id) AS id FROM reach r JOIN v ON r.j = v.i GROUP BY r.i),
degree AS (SELECT a AS i, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0) AS n_links, least(v.vec_id, coalesce(l.id, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(l.id, v.vec_id)) AS kept FROM v LEFT JOIN degree d ON v.i = d.i LEFT JOIN least l ON v.i = l.i"""

DIVERGENCE = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
word AS (SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS everywhere FROM word GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
v AS (SELECT lang, count(*) AS terms, sum(everywhere) AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM word w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
every AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.everywhere, v.terms, v.total FROM grp g JOIN kept k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS own FROM every),
freq AS (SELECT lang, source, term, n, CAST(1 + (1000000000::HUGEINT * (n + 1)) // (own + terms) AS HUGEINT) AS p, CAST(1 + (1000000000::HUGEINT * (everywhere + 1)) // (total + terms) AS HUGEINT) AS q FROM summed),
pair AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM freq a JOIN freq b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
whole AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(p.value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
more AS (SELECT lang, source, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM freq WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM whole
UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM more) x WHERE rank <= 200"""

ORACLE_SQL = {
    "op4_cuckoo_line_dedup": LINE_DEDUP, "op9_host_line_frequency": QUALITY, "op10_winnowed_repeats": REPEATS, "op11_slot_pivot_manifest": MERKLE, "op12_p_stable_neighbours": NEIGHBOURS,
    "op13_source_divergence": DIVERGENCE}
