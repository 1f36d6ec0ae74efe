"""The same queries as SQL over the tables: common table expressions of the map, and a SELECT for each query."""

from __future__ import annotations

#: The map of labelled documents, as sources.bindings derives it, and the edges on it.
BASE = """
seen AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic, 'ev_' || CAST(d.doc_id AS VARCHAR) AS evidence_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
evidence AS (SELECT evidence_id, source AS paper_id, doc_id AS ev_seq, lang AS system, CASE WHEN n_chars >= 500 THEN 0.9 ELSE 0.4 END AS confidence,
  lower(source || ' document ' || CAST(doc_id AS VARCHAR) || ' ' || lang || ' text ' || CASE WHEN n_chars >= 2000 THEN 'extended' ELSE 'brief' END) AS haystack FROM seen),
dimension AS (SELECT evidence_id, 0 AS dim_seq, lang AS name, CAST(quality AS DOUBLE) AS value FROM seen UNION ALL SELECT evidence_id, 1, 'toxic_' || lang, CAST(toxic AS DOUBLE) FROM seen),
member AS (SELECT lang AS group_name, evidence_id, doc_id AS member_seq FROM seen),
per AS (SELECT source, lang, source || '_' || lang AS claim_id, count(*) AS n, CAST(sum(quality) AS BIGINT) AS q, CAST(sum(toxic) AS BIGINT) AS t, CAST(sum(n_chars) AS BIGINT) AS c, min(doc_id) AS first_doc FROM seen GROUP BY source, lang),
claim AS (SELECT claim_id, source AS paper_id, lang, first_doc AS claim_seq, CASE WHEN c >= 2000 * n THEN 'extended' ELSE 'brief' END AS keyword, 0.5 + CAST((200 * q + n) // (2 * n) AS DOUBLE) / 100.0 / 4 AS confidence FROM per),
lead AS (SELECT lang, 'ev_' || CAST(min(doc_id) AS VARCHAR) AS evidence_id FROM seen GROUP BY lang),
prediction AS (
  SELECT claim_id, 0 AS pred_seq, lang AS observable, CAST((200 * q + n) // (2 * n) AS DOUBLE) / 100.0 AS value, TRUE AS aimed FROM per
  UNION ALL SELECT claim_id, 1, 'toxic_' || lang, CAST((200 * t + n) // (2 * n) AS DOUBLE) / 100.0, FALSE FROM per WHERE t > 0
  UNION ALL SELECT claim_id, 2, lang, CAST((10 * q) // n AS DOUBLE) / 10.0, TRUE FROM per),
target AS (
  SELECT p.claim_id, p.pred_seq, p.value, s.doc_id AS place, s.evidence_id FROM prediction p JOIN seen s ON p.claim_id = s.source || '_' || s.lang WHERE p.pred_seq = 0
  UNION ALL SELECT p.claim_id, p.pred_seq, p.value, 0, l.evidence_id FROM prediction p JOIN per ON p.claim_id = per.claim_id JOIN lead l ON per.lang = l.lang WHERE p.pred_seq = 2),
matched AS (
  SELECT p.claim_id, p.pred_seq, p.observable, p.value AS pred_value, d.evidence_id, d.dim_seq FROM prediction p JOIN dimension d ON p.observable = d.name
  WHERE NOT p.aimed OR EXISTS (SELECT 1 FROM target t WHERE t.claim_id = p.claim_id AND t.pred_seq = p.pred_seq AND t.evidence_id = d.evidence_id)),
ranked AS (
  SELECT m.*, c.paper_id AS claim_paper, e.paper_id AS ev_paper, e.ev_seq, CASE WHEN c.paper_id = e.paper_id OR contains(e.haystack, c.keyword) THEN 'in_regime' ELSE 'out_of_regime' END AS regime_tag, least(c.confidence, e.confidence) AS confidence,
    row_number() OVER (PARTITION BY m.claim_id, m.evidence_id ORDER BY m.pred_seq, e.ev_seq, m.dim_seq) AS rn
  FROM matched m JOIN claim c ON m.claim_id = c.claim_id JOIN evidence e ON m.evidence_id = e.evidence_id),
base AS (SELECT claim_id || '__' || evidence_id AS edge_id, * FROM ranked WHERE rn = 1),
home AS (
  SELECT claim_id, group_name, home_evidence, home_value, paper_id FROM (
    SELECT t.claim_id, m.group_name, t.evidence_id AS home_evidence, t.value AS home_value, c.paper_id, row_number() OVER (PARTITION BY t.claim_id, m.group_name ORDER BY t.pred_seq, t.place) AS rn
    FROM target t JOIN claim c ON t.claim_id = c.claim_id JOIN evidence e ON t.evidence_id = e.evidence_id AND e.paper_id = c.paper_id JOIN member m ON t.evidence_id = m.evidence_id) h WHERE rn = 1),
semantic AS (
  SELECT h.claim_id || '__' || m.evidence_id || '__semantic' AS edge_id, h.claim_id, m.evidence_id, d.name AS observable, h.home_value AS pred_value, h.group_name, h.home_evidence, h.paper_id AS claim_paper, e.paper_id AS ev_paper
  FROM home h JOIN member m ON h.group_name = m.group_name AND m.evidence_id <> h.home_evidence JOIN evidence e ON m.evidence_id = e.evidence_id JOIN dimension d ON d.evidence_id = m.evidence_id AND d.dim_seq = 0
  WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.claim_id = h.claim_id AND t.evidence_id = m.evidence_id) AND NOT EXISTS (SELECT 1 FROM base b WHERE b.claim_id = h.claim_id AND b.evidence_id = m.evidence_id)),
edge AS (
  SELECT edge_id, claim_id, evidence_id, observable, pred_value, regime_tag, claim_paper, ev_paper, FALSE AS is_semantic FROM base
  UNION ALL SELECT edge_id, claim_id, evidence_id, observable, pred_value, 'out_of_regime', claim_paper, ev_paper, TRUE FROM semantic),
scored AS (SELECT e.*, d.value AS actual, 1.0 * e.pred_value + (1.0 - 1.0) * d.value AS predicted, e.pred_value - d.value AS residual, (e.pred_value - d.value) * (e.pred_value - d.value) AS residual_sq FROM edge e JOIN dimension d ON e.evidence_id = d.evidence_id AND e.observable = d.name),
stature AS (SELECT claim_id, count(DISTINCT ev_paper) AS stature FROM scored WHERE residual_sq <= 0.05 GROUP BY claim_id),
cost AS (SELECT c.claim_id, c.paper_id, coalesce(s.stature, 0) AS stature, c.paper_id IN ('src3', 'src7') AS incoming, CASE WHEN c.paper_id IN ('src3', 'src7') THEN 0.3 ELSE 1.0 + 8.0 * coalesce(s.stature, 0) END AS "lambda" FROM claim c LEFT JOIN stature s ON c.claim_id = s.claim_id),
miss AS (SELECT claim_id, sum(CASE WHEN regime_tag = 'in_regime' THEN residual_sq ELSE 0.0 END) AS r_in, sum(CASE WHEN regime_tag = 'in_regime' THEN 0.0 ELSE residual_sq END) AS r_out FROM scored GROUP BY claim_id),
priced AS (
  SELECT 'stature' AS model, 8.0 AS alpha, claim_id, incoming, "lambda" FROM cost UNION ALL SELECT 'flat', 0.0, claim_id, incoming, 1.0 FROM cost
  UNION ALL SELECT 'sweep', a.alpha, claim_id, incoming, CASE WHEN incoming THEN 0.3 ELSE 1.0 + a.alpha * stature END FROM cost, (VALUES (1.0), (2.0), (4.0), (6.0), (8.0), (10.0), (12.0)) AS a(alpha)),
tried AS (SELECT p.model, p.alpha, p.claim_id, p.incoming, p."lambda", m.r_in, m.r_out, s.s, m.r_in + s.s * s.s * m.r_out + p."lambda" * (s.s - 1.0) * (s.s - 1.0) AS score FROM priced p JOIN miss m ON p.claim_id = m.claim_id, (VALUES (1.0), (0.8), (0.6), (0.4), (0.2), (0.0)) AS s(s)),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, alpha, claim_id ORDER BY round(score, 9), s DESC) AS rn FROM tried) x WHERE rn = 1),
rewrite AS (SELECT model, alpha, claim_id, incoming, 1.0 AS from_out, CAST(s AS DOUBLE) AS to_out, 1.0 - s AS distance, r_in + r_out AS initial_residual, r_in + s * s * r_out AS final_residual, score AS objective, "lambda" FROM chosen),
final AS (SELECT e.*, CASE WHEN e.regime_tag = 'in_regime' THEN e.residual_sq ELSE r.to_out * r.to_out * e.residual_sq END AS final_sq FROM scored e JOIN rewrite r ON e.claim_id = r.claim_id AND r.model = 'stature')
"""

#: Stances, ideas and their relations.
IDEAS = """,
explicit AS (SELECT claim_id, group_name, evidence_id, value FROM (SELECT t.claim_id, m.group_name, t.evidence_id, t.value, row_number() OVER (PARTITION BY t.claim_id, m.group_name, t.evidence_id ORDER BY t.pred_seq DESC, t.place DESC) AS rn FROM target t JOIN member m ON t.evidence_id = m.evidence_id) x WHERE rn = 1),
vector AS (SELECT e.claim_id, e.group_name, string_agg(e.evidence_id || '=' || CAST(round(e.value, 2) AS VARCHAR), ',' ORDER BY e.evidence_id) AS signature FROM explicit e GROUP BY e.claim_id, e.group_name),
merged AS (SELECT v.group_name, c.paper_id, v.signature, string_agg(v.claim_id, ',' ORDER BY v.claim_id) AS claim_ids, min(c.claim_seq) AS first_seq, min(c.lang) AS systems, string_agg(DISTINCT c.keyword, ',' ORDER BY c.keyword) AS keywords, min(v.claim_id) AS any_claim FROM vector v JOIN claim c ON v.claim_id = c.claim_id GROUP BY v.group_name, c.paper_id, v.signature),
numbered AS (SELECT m.*, row_number() OVER (PARTITION BY m.group_name ORDER BY p.paper_seq, m.first_seq) AS idea_no FROM merged m JOIN (SELECT group_name, paper_id, min(first_seq) AS paper_seq FROM merged GROUP BY group_name, paper_id) p ON m.group_name = p.group_name AND m.paper_id = p.paper_id),
idea AS (SELECT 'idea_' || group_name || '_' || lpad(CAST(idea_no AS VARCHAR), 3, '0') AS idea_id, * FROM numbered),
held AS (SELECT i.idea_id, i.idea_no, i.group_name, e.evidence_id, e.value FROM idea i JOIN explicit e ON e.claim_id = i.any_claim AND e.group_name = i.group_name),
met AS (SELECT a.group_name, a.idea_id AS a, b.idea_id AS b, a.evidence_id, abs(a.value - b.value) < 0.05 AS agree FROM held a JOIN held b ON a.group_name = b.group_name AND a.evidence_id = b.evidence_id AND a.idea_no < b.idea_no),
pair AS (SELECT group_name, a, b, CASE WHEN count(*) FILTER (WHERE NOT agree) > 0 THEN 'contests' ELSE 'supports' END AS kind, CASE WHEN count(*) FILTER (WHERE NOT agree) > 0 THEN string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (WHERE NOT agree) ELSE string_agg(evidence_id, ',' ORDER BY evidence_id) FILTER (WHERE agree) END AS shared_at FROM met GROUP BY group_name, a, b),
relation AS (SELECT group_name, a AS idea_a, b AS idea_b, kind, shared_at FROM pair UNION ALL SELECT group_name, b, a, kind, shared_at FROM pair),
status AS (SELECT i.*, CASE WHEN i.paper_id IN ('src3', 'src7') AND count(*) OVER (PARTITION BY i.group_name, i.signature) = 1 THEN 'novel' WHEN EXISTS (SELECT 1 FROM relation r WHERE r.idea_a = i.idea_id AND r.kind = 'contests') THEN 'contested' ELSE 'established' END AS status FROM idea i),
subject AS (
  SELECT 'subject_' || lpad(CAST(row_number() OVER (ORDER BY group_name) AS VARCHAR), 2, '0') || '_' || group_name AS subject_id, group_name, 'Quality in ' || group_name AS title,
    (SELECT string_agg(DISTINCT k.keyword, ', ' ORDER BY k.keyword) FROM claim k WHERE k.lang = g.group_name) AS regime,
    (SELECT count(*) FROM status s WHERE s.group_name = g.group_name AND s.status = 'novel') AS novel, (SELECT count(*) FROM status s WHERE s.group_name = g.group_name AND s.status = 'contested') AS contested, (SELECT count(*) FROM status s WHERE s.group_name = g.group_name AND s.status = 'established') AS established,
    (SELECT string_agg(DISTINCT e.claim_id, ',' ORDER BY e.claim_id) FROM explicit e WHERE e.group_name = g.group_name) AS claims, (SELECT string_agg(DISTINCT s.paper_id, ',' ORDER BY s.paper_id) FROM status s WHERE s.group_name = g.group_name) AS papers,
    (SELECT count(DISTINCT e.evidence_id) FROM explicit e WHERE e.group_name = g.group_name) AS n_evidence
  FROM (SELECT DISTINCT group_name FROM member) g),
stance AS (
  SELECT claim_id, group_name, evidence_id, value, TRUE AS explicit FROM explicit
  UNION ALL SELECT h.claim_id, h.group_name, m.evidence_id, h.home_value, FALSE FROM home h JOIN member m ON h.group_name = m.group_name WHERE NOT EXISTS (SELECT 1 FROM explicit e WHERE e.claim_id = h.claim_id AND e.group_name = h.group_name AND e.evidence_id = m.evidence_id)),
paper_stance AS (
  WITH said AS (SELECT paper_id, group_name, evidence_id, value FROM (SELECT c.paper_id, e.group_name, e.evidence_id, e.value, row_number() OVER (PARTITION BY c.paper_id, e.group_name, e.evidence_id ORDER BY c.claim_seq DESC) AS rn FROM explicit e JOIN claim c ON e.claim_id = c.claim_id) x WHERE rn = 1),
  carried AS (SELECT paper_id, group_name, evidence_id, value FROM (SELECT c.paper_id, h.group_name, m.evidence_id, e.value, row_number() OVER (PARTITION BY c.paper_id, h.group_name, m.evidence_id ORDER BY c.claim_seq) AS rn FROM home h JOIN explicit e ON e.claim_id = h.claim_id AND e.group_name = h.group_name AND e.evidence_id = h.home_evidence JOIN claim c ON h.claim_id = c.claim_id JOIN member m ON m.group_name = h.group_name WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.claim_id = h.claim_id AND t.evidence_id = m.evidence_id)) x WHERE rn = 1)
  SELECT paper_id, group_name, evidence_id, value, TRUE AS explicit FROM said UNION ALL SELECT c.paper_id, c.group_name, c.evidence_id, c.value, FALSE FROM carried c WHERE NOT EXISTS (SELECT 1 FROM said s WHERE s.paper_id = c.paper_id AND s.group_name = c.group_name AND s.evidence_id = c.evidence_id)),
said AS (SELECT t.claim_id, c.paper_id, c.keyword, m.group_name, t.evidence_id, t.value, CASE WHEN t.value >= 0.5 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN d.value >= 0.5 THEN 'positive' ELSE 'negative' END AS actual FROM target t JOIN claim c ON t.claim_id = c.claim_id JOIN member m ON t.evidence_id = m.evidence_id JOIN dimension d ON d.evidence_id = t.evidence_id AND d.dim_seq = 0),
bucket AS (SELECT group_name, direction, count(DISTINCT paper_id) AS n_papers, string_agg(DISTINCT paper_id, ',' ORDER BY paper_id) AS papers, string_agg(DISTINCT keyword, ',' ORDER BY keyword) AS keywords,
  coalesce(string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) FILTER (WHERE actual = direction), '') AS supporting, coalesce(string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) FILTER (WHERE actual <> direction), '') AS contesting FROM said GROUP BY group_name, direction)
"""

#: The contribution of the incoming papers set into the rest: base edges of the spliced map.
SITUATED = """,
spliced AS (SELECT b.edge_id, b.claim_id, b.evidence_id, b.regime_tag, b.claim_paper, b.ev_paper, b.pred_value - d.value AS residual FROM base b JOIN dimension d ON b.evidence_id = d.evidence_id AND b.observable = d.name),
against AS (SELECT * FROM spliced WHERE ev_paper IN ('src3', 'src7') AND claim_paper NOT IN ('src3', 'src7') AND abs(residual) > 0.30),
sums AS (SELECT claim_id, sum(CASE WHEN regime_tag = 'in_regime' THEN residual * residual ELSE 0.0 END) AS r_in, sum(CASE WHEN regime_tag = 'in_regime' THEN 0.0 ELSE residual * residual END) AS r_out FROM spliced GROUP BY claim_id),
narrowed AS (SELECT claim_id, s FROM (SELECT m.claim_id, s.s, row_number() OVER (PARTITION BY m.claim_id ORDER BY round(m.r_in + s.s * s.s * m.r_out + (s.s - 1.0) * (s.s - 1.0), 9), s.s DESC) AS rn FROM sums m, (VALUES (1.0), (0.8), (0.6), (0.4), (0.2), (0.0)) AS s(s)) x WHERE rn = 1)
"""

PAIRS = "SELECT x.{k} AS a, y.{k} AS b, count(*) AS shared FROM {t} x JOIN {t} y ON x.group_name = y.group_name AND x.evidence_id = y.evidence_id AND x.{k} < y.{k} GROUP BY x.{k}, y.{k} HAVING count(*) >= 2 AND max(abs(x.value - y.value)) < 0.05"
OPS = 'SELECT claim_id, round(from_out, 6) AS from_out, round(to_out, 6) AS to_out, round(distance, 6) AS distance, round(initial_residual, 6) AS initial_residual, round(final_residual, 6) AS final_residual, round(objective, 6) AS objective, round("lambda", 6) AS "lambda" FROM rewrite WHERE to_out < 1.0 AND model = \'{}\''
NARROWING = "round(sum(CASE WHEN incoming THEN 0.0 ELSE from_out - to_out END), 6) AS prior_narrowing, round(sum(CASE WHEN incoming THEN from_out - to_out ELSE 0.0 END), 6) AS incoming_narrowing, round(sum(final_residual), 6) AS residual"
LISTED = "coalesce(string_agg({0}, ',' ORDER BY {0}) FILTER (WHERE {1}), '')"

_HYGIENE = f"""
carried AS (SELECT claim_id, {LISTED.format('evidence_id', 'TRUE')} AS propagated, {LISTED.format('evidence_id', 'residual_sq > 0.05')} AS contradicting, count(*) AS n, count(*) FILTER (WHERE residual_sq > 0.05) AS wrong FROM scored WHERE is_semantic GROUP BY claim_id),
hit AS (SELECT t.claim_id, m.group_name, count(DISTINCT t.evidence_id) AS hit, (SELECT count(*) FROM member x WHERE x.group_name = m.group_name) AS size FROM target t JOIN member m ON t.evidence_id = m.evidence_id GROUP BY t.claim_id, m.group_name),
touched AS (SELECT claim_id, {LISTED.format('group_name', 'TRUE')} AS groups_touched, {LISTED.format('group_name', 'hit = size')} AS groups_addressed FROM hit GROUP BY claim_id),
hygiene AS (SELECT c.claim_id, coalesce(k.propagated, '') AS propagated, coalesce(k.contradicting, '') AS contradicting, coalesce(t.groups_touched, '') AS groups_touched, coalesce(t.groups_addressed, '') AS groups_addressed,
  CASE WHEN coalesce(k.wrong, 0) > 0 AND k.wrong > k.n - k.wrong THEN 'implicit_headline' WHEN coalesce(k.n, 0) > 0 THEN 'consensus_aligned' WHEN t.groups_touched IS NOT NULL THEN 'scoped_explicit' ELSE 'not_applicable' END AS status FROM claim c LEFT JOIN carried k ON c.claim_id = k.claim_id LEFT JOIN touched t ON c.claim_id = t.claim_id)"""

_STEPS = "(VALUES ('novel', 0, 'literature', TRUE), ('novel', 1, 'experiment', FALSE), ('novel', 2, 'simulation', FALSE), ('contested', 0, 'theory', FALSE), ('contested', 1, 'simulation', FALSE), ('contested', 2, 'literature', FALSE), ('established', 0, 'experiment', FALSE), ('established', 1, 'theory', FALSE), ('established', 2, 'simulation', FALSE)) AS r(status, step_seq, kind, needs)"


#: Maximal cliques of a small graph: nodes with the same neighbours are one, and sets of the others grow in order of name.
_CLIQUES = """,
node AS ({nodes}), link AS ({pairs}),
adjacent AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
near AS (SELECT n, string_agg(m, '|' ORDER BY m) AS closed FROM (SELECT n, n AS m FROM node UNION SELECT a, b FROM adjacent) x GROUP BY n),
twin AS (SELECT n, min(n) OVER (PARTITION BY closed) AS rep FROM near),
around AS (SELECT t.rep, coalesce(list(DISTINCT o.rep) FILTER (WHERE o.rep <> t.rep), []) AS others FROM (SELECT DISTINCT rep FROM twin) t LEFT JOIN adjacent a ON a.a = t.rep LEFT JOIN twin o ON o.n = a.b GROUP BY t.rep),
grown AS (SELECT [rep] AS members, rep AS last, others AS common FROM around UNION ALL SELECT list_append(g.members, r.rep), r.rep, list_intersect(g.common, r.others) FROM grown g JOIN around r ON list_contains(g.common, r.rep) AND r.rep > g.last),
clique AS (SELECT list_sort(list(t.n)) AS members FROM (SELECT members AS reps, unnest(members) AS rep FROM grown WHERE len(common) = 0) g JOIN twin t ON g.rep = t.rep GROUP BY g.reps)"""
_CLAIM_CLIQUES = _CLIQUES.format(nodes="SELECT claim_id AS n FROM claim", pairs=PAIRS.format(k="claim_id", t="stance"))
_PAPER_CLIQUES = _CLIQUES.format(nodes="SELECT DISTINCT paper_id AS n FROM claim", pairs=PAIRS.format(k="paper_id", t="paper_stance"))

#: Suppliers' claims about parts: base and carried edges of the large map.
_PARTS = """WITH part_stat AS (SELECT l_partkey, p_brand, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, count(*) AS n, min(l_suppkey) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_partkey, p_brand),
      ev AS (SELECT l_partkey, p_brand, s, CASE WHEN r * (SELECT count(*) FROM lineitem) >= (SELECT sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) FROM lineitem) * n THEN 1.0 ELSE 0.0 END AS v FROM part_stat),
      c AS (SELECT l_suppkey, p_brand, CAST((200 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + count(*)) // (2 * count(*)) AS DOUBLE) / 100.0 AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, p_brand),
      ship AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
      b AS (SELECT c.l_suppkey, c.p_brand, e.l_partkey, e.s, (c.p - e.v) * (c.p - e.v) AS sq FROM c JOIN ship x ON c.l_suppkey = x.l_suppkey JOIN ev e ON x.l_partkey = e.l_partkey AND e.p_brand = c.p_brand),
      h AS (SELECT DISTINCT c.l_suppkey, c.p_brand, c.p FROM c JOIN ev e ON e.s = c.l_suppkey AND e.p_brand = c.p_brand),
      m AS (SELECT h.l_suppkey, h.p_brand, e.l_partkey, e.s, (h.p - e.v) * (h.p - e.v) AS sq FROM h JOIN ev e ON e.p_brand = h.p_brand WHERE NOT EXISTS (SELECT 1 FROM ship x WHERE x.l_suppkey = h.l_suppkey AND x.l_partkey = e.l_partkey)),
      every AS (SELECT *, s = l_suppkey AS own FROM b UNION ALL SELECT *, FALSE FROM m),
      backed AS (SELECT l_suppkey, p_brand, count(DISTINCT s) AS stature FROM every WHERE sq <= 0.05 GROUP BY l_suppkey, p_brand)"""


def _on_base(select: str, more: str = "") -> str:
    return f"WITH {BASE}{',' + more if more else ''} {select}"


def _prior() -> str:
    """BASE without the documents of incoming papers; what claims aim at stays."""
    start = "seen AS ("
    cut = BASE.index("),", BASE.index(start)) + 2
    seen = BASE[:cut].replace(start, "all_seen AS (") + " seen AS (SELECT * FROM all_seen WHERE source NOT IN ('src3', 'src7')),"
    return (seen + BASE[cut:]).replace("AS evidence_id FROM seen GROUP BY lang)", "AS evidence_id FROM all_seen GROUP BY lang)")


#: Files of documents, the paper each is of, and the bare claims of those that are of none.
_FILES = """,
file AS (SELECT lower(concat_ws('_', source, lang, CAST(doc_id AS VARCHAR))) AS stem, min(doc_id) AS file_seq FROM documents GROUP BY ALL),
rule AS (SELECT DISTINCT source FROM documents WHERE source NOT IN ('src3', 'src7')),
named AS (SELECT stem, min(source) AS paper_id FROM file JOIN rule ON contains(stem, lower(source || '_')) GROUP BY stem),
of_paper AS (SELECT stem, paper_id FROM named WHERE paper_id IN (SELECT paper_id FROM claim))"""


def _claim_history() -> str:
    """States of claims in both versions, and where they are not those of the version before."""
    said = "SELECT claim_id, to_out, final_residual, \"lambda\" FROM rewrite WHERE model = 'stature'"
    return f"""WITH old AS (WITH {_prior()} {said}), new AS (WITH {BASE} {said}),
      log AS (SELECT claim_id, 0 AS version, 1.0 AS to_out, NULL AS final_residual, NULL AS "lambda" FROM (SELECT DISTINCT source || '_' || lang AS claim_id FROM documents JOIN labels USING (doc_id)) c UNION ALL SELECT claim_id, 1, to_out, final_residual, "lambda" FROM old UNION ALL SELECT claim_id, 2, to_out, final_residual, "lambda" FROM new),
      told AS (SELECT *, lag(to_out) OVER (PARTITION BY claim_id ORDER BY version) AS from_out FROM log)
    SELECT claim_id, CAST(version AS BIGINT) AS version, round(CAST(from_out AS DOUBLE), 6) AS from_out, round(CAST(to_out AS DOUBLE), 6) AS to_out, round(CAST(final_residual AS DOUBLE), 6) AS final_residual, round(CAST("lambda" AS DOUBLE), 6) AS "lambda" FROM told WHERE version > 0 AND to_out <> from_out"""


def _changes() -> str:
    """The ideas of both versions, each from the same tables: the prior one without the documents of incoming papers."""
    whole, prior = f"{BASE}{IDEAS}", f"{_prior()}{IDEAS}"
    pairs = "SELECT r.group_name, a.paper_id AS paper_a, a.claim_ids AS claims_a, b.paper_id AS paper_b, b.claim_ids AS claims_b, r.kind FROM relation r JOIN idea a ON r.idea_a = a.idea_id JOIN idea b ON r.idea_b = b.idea_id WHERE (a.paper_id, a.claim_ids) < (b.paper_id, b.claim_ids)"
    said = "SELECT group_name, paper_id, claim_ids AS claims, status FROM status"
    return f"""WITH old_idea AS (WITH {prior} {said}), new_idea AS (WITH {whole} {said}), old_pair AS (WITH {prior} {pairs}), new_pair AS (WITH {whole} {pairs})
    SELECT CASE WHEN o.status IS NULL THEN 'idea_added' WHEN n.status IS NULL THEN 'idea_removed' ELSE 'status_changed' END AS change, coalesce(n.group_name, o.group_name) AS group_name, coalesce(n.paper_id, o.paper_id) AS paper_id, coalesce(n.claims, o.claims) AS claims,
      CAST(NULL AS VARCHAR) AS other_paper, CAST(NULL AS VARCHAR) AS other_claims, o.status AS before, n.status AS after
    FROM old_idea o FULL JOIN new_idea n ON o.group_name = n.group_name AND o.paper_id = n.paper_id AND o.claims = n.claims WHERE o.status IS DISTINCT FROM n.status
    UNION ALL SELECT CASE WHEN n.kind = 'contests' THEN 'contest_introduced' WHEN n.kind = 'supports' THEN 'support_introduced' WHEN o.kind = 'contests' THEN 'contest_gone' ELSE 'support_gone' END,
      coalesce(n.group_name, o.group_name), coalesce(n.paper_a, o.paper_a), coalesce(n.claims_a, o.claims_a), coalesce(n.paper_b, o.paper_b), coalesce(n.claims_b, o.claims_b), o.kind, n.kind
    FROM old_pair o FULL JOIN new_pair n ON o.group_name = n.group_name AND o.paper_a = n.paper_a AND o.claims_a = n.claims_a AND o.paper_b = n.paper_b AND o.claims_b = n.claims_b WHERE o.kind IS DISTINCT FROM n.kind"""


def _on_ideas(select: str, more: str = "") -> str:
    return f"WITH {'RECURSIVE ' if more else ''}{BASE}{IDEAS}{more} {select}"


def _situated(select: str) -> str:
    return f"WITH {BASE}{SITUATED} {select}"


ORACLE_SQL: dict[str, str] = {
    "run_summary": _on_base("""SELECT (SELECT count(*) FROM claim) AS claims, (SELECT count(DISTINCT paper_id) FROM claim) AS claim_papers, (SELECT count(*) FROM evidence) AS evidence, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM semantic) AS semantic_edges,
      (SELECT count(*) FROM final WHERE final_sq > 0.05) AS tensions, (SELECT count(*) FROM rewrite WHERE model = 'stature' AND to_out < 1.0) AS rewrites, (SELECT round(sum(residual_sq), 6) FROM scored) AS initial_residual, (SELECT round(sum(final_sq), 6) FROM final) AS final_residual,
      (SELECT round(coalesce(sum(distance), 0.0), 6) FROM rewrite WHERE model = 'stature') AS rewrite_distance"""),
    "observable_groups": _on_base("SELECT name AS observable, string_agg(evidence_id, ',' ORDER BY evidence_id) AS evidence_ids FROM dimension GROUP BY name"),
    "prediction_edges": _on_base("SELECT edge_id, claim_id, evidence_id, observable, regime_tag, round(pred_value, 6) AS pred_value, round(confidence, 6) AS confidence FROM base"),
    "home_predictions": _on_base("SELECT claim_id, group_name, home_evidence, round(home_value, 6) AS home_value FROM home"),
    "semantic_edges": _on_base("SELECT edge_id, group_name, home_evidence, observable, round(pred_value, 6) AS pred_value FROM semantic"),
    "scoped_semantic_edges": _on_base("SELECT edge_id, group_name FROM semantic WHERE claim_paper IN ('src3', 'src7')"),
    "edge_residuals": _on_base("SELECT edge_id, 1.0 AS strength, round(predicted, 6) AS predicted, round(residual, 6) AS residual, round(residual_sq, 6) AS residual_sq FROM scored"),
    "residual_totals": _on_base("SELECT round(coalesce(sum(residual_sq), 0.0), 6) AS residual_total FROM scored"),
    "stature": _on_base("SELECT claim_id, stature FROM stature"),
    "wired_stature": _on_base("SELECT claim_id, count(DISTINCT ev_paper) AS stature FROM scored GROUP BY claim_id"),
    "lambda_costs": _on_base('SELECT claim_id, stature, round("lambda", 6) AS "lambda" FROM cost'),
    "claim_rewrites": _on_base(OPS.format("stature")),
    "flat_rewrites": _on_base(OPS.format("flat")),
    "alpha_sweep": _on_base(f"SELECT alpha, {NARROWING} FROM rewrite WHERE model = 'sweep' GROUP BY alpha"),
    "cost_comparison": _on_base(f"""SELECT m.model, m.prior_narrowing, m.incoming_narrowing, m.residual, CASE WHEN m.prior_narrowing = 0 AND m.residual - f.residual > 0.5 THEN 'refused' WHEN f.prior_narrowing - m.prior_narrowing > 0.01 AND m.residual - f.residual > 0.1 THEN 'softened' ELSE 'unchanged' END AS verdict
      FROM (SELECT model, {NARROWING} FROM rewrite WHERE model <> 'sweep' GROUP BY model) m, (SELECT {NARROWING} FROM rewrite WHERE model = 'flat') f"""),
    "remaining_tensions": _on_base("SELECT edge_id, round(final_sq, 6) AS residual_sq FROM final WHERE final_sq > 0.05"),
    "resolved_tensions": _on_base("SELECT f.edge_id, round(f.residual_sq, 6) AS initial_sq, round(f.final_sq, 6) AS final_sq FROM final f JOIN rewrite r ON f.claim_id = r.claim_id AND r.model = 'stature' AND r.to_out < 1.0 WHERE f.residual_sq > 0.05 AND f.final_sq < 0.1"),
    "claim_hygiene": _on_base("SELECT claim_id, status, propagated, contradicting, groups_touched, groups_addressed FROM hygiene", _HYGIENE),
    "top_stature": _on_base("SELECT claim_id, stature FROM stature ORDER BY stature DESC, claim_id LIMIT 8"),
    "severity_buckets": _on_base("SELECT CASE WHEN final_sq >= 0.5 THEN 'high' WHEN final_sq >= 0.05 THEN 'mild' WHEN final_sq > 0 THEN 'tiny' ELSE 'zero' END AS severity, count(*) AS edges FROM final GROUP BY 1"),
    "edge_view": _on_base("""SELECT f.edge_id, f.claim_paper, f.ev_paper, f.regime_tag, f.is_semantic, coalesce(s.stature, 0) AS stature, h.status AS hygiene, p.colour, round(f.final_sq, 6) AS residual_sq FROM final f LEFT JOIN stature s ON f.claim_id = s.claim_id JOIN hygiene h ON f.claim_id = h.claim_id
      JOIN (SELECT paper_id, (row_number() OVER (ORDER BY paper_id) - 1) % 14 AS colour FROM (SELECT DISTINCT paper_id FROM claim) x) p ON f.claim_paper = p.paper_id""", _HYGIENE),
    "explicit_stance": _on_ideas("SELECT claim_id, group_name, evidence_id, round(value, 6) AS value FROM explicit"),
    "ideas": _on_ideas("SELECT i.idea_id, i.group_name, i.paper_id, i.paper_id || ' (' || i.claim_ids || '): ' || i.paper_id || ' in ' || i.group_name AS title, i.claim_ids, i.systems, i.keywords FROM idea i"),
    "idea_evidence": _on_ideas(f"SELECT h.idea_id, {LISTED.format('h.evidence_id', 'abs(h.value - d.value) < 0.05')} AS supporting, {LISTED.format('h.evidence_id', 'abs(h.value - d.value) >= 0.05')} AS contesting FROM held h JOIN dimension d ON h.evidence_id = d.evidence_id AND d.dim_seq = 0 GROUP BY h.idea_id"),
    "idea_relations": _on_ideas("SELECT idea_a, idea_b, kind, shared_at FROM relation"),
    "idea_status": _on_ideas("SELECT idea_id, status FROM status"),
    "subject_tensions": _on_ideas("""SELECT r.group_name, least(r.idea_a, r.idea_b) AS idea_one, greatest(r.idea_a, r.idea_b) AS idea_two, a.paper_id AS papers_yes, b.paper_id AS papers_no, r.shared_at FROM relation r JOIN (SELECT *, CASE status WHEN 'novel' THEN 0 WHEN 'contested' THEN 1 ELSE 2 END AS k FROM status) a ON r.idea_a = a.idea_id
      JOIN (SELECT *, CASE status WHEN 'novel' THEN 0 WHEN 'contested' THEN 1 ELSE 2 END AS k FROM status) b ON r.idea_b = b.idea_id WHERE r.kind = 'contests' AND (a.k < b.k OR (a.k = b.k AND a.idea_id < b.idea_id))"""),
    "subject_rollup": _on_ideas("SELECT subject_id, title, regime, novel, contested, established, claims, papers, n_evidence FROM subject"),
    "ungrouped": _on_ideas("""SELECT 'subject_' || lpad(CAST((SELECT count(*) FROM subject) + 1 AS VARCHAR), 2, '0') || '_ungrouped' AS subject_id, kind, id FROM (
      SELECT 'evidence' AS kind, evidence_id AS id FROM evidence e WHERE NOT EXISTS (SELECT 1 FROM explicit x WHERE x.evidence_id = e.evidence_id) UNION ALL SELECT 'claim', claim_id FROM claim c WHERE NOT EXISTS (SELECT 1 FROM explicit x WHERE x.claim_id = c.claim_id)) u"""),
    "next_steps": _on_ideas(f"SELECT s.idea_id, s.status, CAST(r.step_seq AS BIGINT) AS step_seq, r.kind FROM status s JOIN {_STEPS} ON s.status = r.status WHERE NOT r.needs OR EXISTS (SELECT 1 FROM relation x WHERE x.idea_a = s.idea_id AND x.kind = 'contests')"),
    "open_questions": _on_ideas("SELECT subject_id, priority, ideas FROM (SELECT subject_id, 'blocking' AS priority, novel AS ideas FROM subject UNION ALL SELECT subject_id, 'high', contested FROM subject UNION ALL SELECT subject_id, 'exploratory', novel + contested + established FROM subject) q WHERE ideas > 0"),
    "propagated_stance": _on_ideas("SELECT claim_id, group_name, evidence_id, explicit, round(value, 6) AS value FROM stance"),
    "coherence_pairs": _on_ideas(PAIRS.format(k="claim_id", t="stance")),
    "stance_equivalence": _on_ideas("SELECT count(*) AS size, string_agg(claim_id, ',' ORDER BY claim_id) AS members FROM (SELECT claim_id, string_agg(group_name || '/' || evidence_id || '=' || CAST(round(value, 2) AS VARCHAR), ',' ORDER BY group_name, evidence_id) AS v FROM stance GROUP BY claim_id) x GROUP BY v"),
    "paper_stance": _on_ideas("SELECT paper_id, group_name, evidence_id, explicit, round(value, 6) AS value FROM paper_stance"),
    "paper_coherence": _on_ideas(PAIRS.format(k="paper_id", t="paper_stance")),
    "direction_buckets": _on_ideas("SELECT group_name, direction, n_papers, papers, keywords, supporting, contesting FROM bucket"),
    "assertions": _on_ideas(f"""SELECT g.group_name, coalesce(y.papers, '') AS papers_yes, coalesce(n.papers, '') AS papers_no, y.papers IS NOT NULL AND n.papers IS NOT NULL AS in_tension,
      coalesce((SELECT string_agg(DISTINCT a.keyword, ',' ORDER BY a.keyword) FROM said a JOIN said b ON a.group_name = b.group_name AND a.keyword = b.keyword WHERE a.group_name = g.group_name AND a.direction = 'positive' AND b.direction = 'negative'), '') AS shared_keywords,
      coalesce((SELECT string_agg(DISTINCT a.paper_id, ',' ORDER BY a.paper_id) FROM said a JOIN said b ON a.group_name = b.group_name AND a.paper_id = b.paper_id WHERE a.group_name = g.group_name AND a.direction = 'positive' AND b.direction = 'negative'), '') AS shared_papers
      FROM (SELECT DISTINCT group_name FROM bucket) g LEFT JOIN bucket y ON y.group_name = g.group_name AND y.direction = 'positive' LEFT JOIN bucket n ON n.group_name = g.group_name AND n.direction = 'negative'"""),
    "contradictors": _situated("SELECT evidence_id, claim_id, claim_paper, round(residual, 3) AS residual FROM against"),
    "finding_verdicts": _situated(f"""SELECT e.evidence_id, coalesce(a.papers, 0) AS independent_papers, CASE WHEN coalesce(a.papers, 0) >= 2 THEN 'suspect' WHEN coalesce(a.claims, 0) > 0 THEN 'contested' ELSE 'credible' END AS verdict, coalesce(l.leans_on, '') AS leans_on FROM evidence e
      LEFT JOIN (SELECT evidence_id, count(DISTINCT claim_paper) AS papers, count(*) AS claims FROM against GROUP BY evidence_id) a ON e.evidence_id = a.evidence_id LEFT JOIN (SELECT evidence_id, {LISTED.format('claim_id', "claim_paper IN ('src3', 'src7')")} AS leans_on FROM spliced GROUP BY evidence_id) l ON e.evidence_id = l.evidence_id
      WHERE e.paper_id IN ('src3', 'src7')"""),
    "accommodated_tensions": _situated("SELECT edge_id, round(sq, 6) AS residual_sq FROM (SELECT s.edge_id, CASE WHEN s.regime_tag = 'in_regime' THEN 1.0 ELSE n.s * n.s END * s.residual * s.residual AS sq FROM spliced s JOIN narrowed n ON s.claim_id = n.claim_id) x WHERE sq > 0.05"),
    "source_spans": r"""SELECT doc_id, trim(regexp_replace(CASE WHEN place >= 0 THEN substring(text, greatest(place - 120, 0) + 1, place + 360 - greatest(place - 120, 0)) ELSE left(text, 360) END, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS span
      FROM (SELECT doc_id, text, coalesce(nullif(instr(lower(text), 'license'), 0), nullif(instr(lower(text), 'the'), 0), nullif(instr(lower(text), 'des'), 0), nullif(instr(lower(text), 'ung'), 0), nullif(instr(lower(text), 'que'), 0), 0) - 1 AS place FROM documents) d""",
    "subject_scope": _on_ideas("SELECT s.subject_id, coalesce(string_agg(DISTINCT i.systems, '; ' ORDER BY i.systems), '') AS system, CASE WHEN count(i.idea_id) > 0 THEN 'text' ELSE '' END AS framework, coalesce(min(s.regime), '') AS regime FROM subject s LEFT JOIN idea i ON s.group_name = i.group_name GROUP BY s.subject_id"),
    "idea_order": _on_ideas("SELECT group_name, row_number() OVER (PARTITION BY group_name ORDER BY CASE status WHEN 'novel' THEN 0 WHEN 'contested' THEN 1 ELSE 2 END, idea_id) AS place, idea_id, status FROM status"),
    "claim_history": _claim_history(),
    "seeded_predictions": f"""WITH {_prior()}{_FILES}
      SELECT c.claim_id, c.paper_id, CAST(p.pred_seq AS BIGINT) AS pred_seq, p.observable, CAST(CASE WHEN p.claim_id IS NULL THEN NULL ELSE (SELECT count(*) FROM target t WHERE t.claim_id = p.claim_id AND t.pred_seq = p.pred_seq) END AS BIGINT) AS targets, round(p.value, 6) AS value, round(c.confidence, 6) AS confidence
      FROM claim c LEFT JOIN prediction p ON c.claim_id = p.claim_id WHERE c.paper_id IN (SELECT paper_id FROM of_paper)
      UNION ALL SELECT stem || '_C01', stem, NULL, NULL, NULL, NULL, 0.25 FROM file WHERE stem NOT IN (SELECT stem FROM of_paper)""",
    "seeded_edges": f"WITH {_prior()}{_FILES} SELECT edge_id, claim_id, evidence_id, observable, regime_tag, round(pred_value, 6) AS pred_value, round(confidence, 6) AS confidence FROM base WHERE claim_paper IN (SELECT paper_id FROM of_paper) AND ev_paper IN (SELECT paper_id FROM of_paper)",
    "asked_as_of": """WITH s AS (SELECT user_id, ts, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts)
      SELECT q.event_id, q.user_id, s.event_id AS state_event_id, round(s.value, 6) AS state_value FROM (SELECT * FROM events WHERE event_type = 'error') q ASOF LEFT JOIN s ON q.user_id = s.user_id AND q.ts >= s.ts""",
    "event_changes": """SELECT event_id, user_id, event_type, was AS was_event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) e
      WHERE was IS NULL OR was <> event_type""",
    "located_goals": r"""WITH goal AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS goal, unnest(regexp_extract_all(lower(text), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM conversations WHERE role = 'user'),
      used AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM documents) w WHERE word IN (SELECT word FROM goal) GROUP BY doc_id, word),
      rarity AS (SELECT word, count(*) AS docs FROM used GROUP BY word),
      posting AS (SELECT u.doc_id, u.word, CAST(round(1000 * ln((SELECT count(DISTINCT doc_id) FROM documents) / CAST(r.docs AS DOUBLE))) AS BIGINT) * n // (n + 1) AS weight FROM used u JOIN rarity r ON u.word = r.word),
      scored AS (SELECT g.goal, p.doc_id, CAST(sum(p.weight) AS BIGINT) AS score, string_agg(p.word, ',' ORDER BY p.word) AS scope_words FROM goal g JOIN posting p ON g.word = p.word WHERE p.weight > 0 GROUP BY g.goal, p.doc_id)
      SELECT * FROM (SELECT goal, doc_id, score, row_number() OVER (PARTITION BY goal ORDER BY score DESC, doc_id) AS rank, scope_words FROM scored) r WHERE rank <= 3""",
    "needle_hits": """SELECT d.doc_id, b.needle, instr(d.text, b.needle) - 1 AS at FROM (SELECT doc_id, lower(text) AS text FROM documents) d
      JOIN (SELECT DISTINCT needle FROM (SELECT unnest(string_split(lower(text), chr(10))) AS needle FROM benchmark) l WHERE length(needle) >= 20) b ON contains(d.text, b.needle)""",
    "record_files": """SELECT doc_id, lang, length(text) AS text_chars, md5(text) AS text_md5, NULL AS problem, NULL AS rejected FROM documents
      UNION ALL SELECT NULL, NULL, NULL, NULL, 'no JSON', line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) b WHERE trim(line) <> ''""",
    "slugs": "SELECT p_partkey, left(trim(regexp_replace(lower(p_name || ' / ' || p_brand || ' / ' || p_type), '[^a-z0-9]+', '_', 'g'), '_'), 80) AS slug FROM part",
    "propagated_sums": _on_base("""SELECT e.claim_id, count(*) FILTER (WHERE NOT is_semantic) AS base_edges, count(*) FILTER (WHERE is_semantic) AS carried, count(*) FILTER (WHERE is_semantic AND residual_sq > 0.05) AS contradicting,
      count(DISTINCT ev_paper) FILTER (WHERE residual_sq <= 0.05) AS stature, round(coalesce(sum(residual_sq) FILTER (WHERE is_semantic), 0.0), 6) AS carried_sq FROM scored e GROUP BY e.claim_id"""),
    "stream_totals": _on_base("""SELECT claim_id, count(*) AS edges, count(DISTINCT ev_paper) FILTER (WHERE residual_sq <= 0.05) AS stature, round(sum(CASE WHEN regime_tag = 'in_regime' THEN residual_sq ELSE 0.0 END), 6) AS r_in, round(sum(CASE WHEN regime_tag = 'in_regime' THEN 0.0 ELSE residual_sq END), 6) AS r_out
      FROM scored WHERE NOT is_semantic GROUP BY claim_id"""),
    "map_changes": _changes(),
    "coherent_classes": _on_ideas(f"""SELECT c.claim_id, c.class, count(DISTINCT o.class) AS coherent_classes FROM (SELECT claim_id, min(claim_id) OVER (PARTITION BY v) AS class FROM (SELECT claim_id, string_agg(group_name || '/' || evidence_id || '=' || CAST(value AS VARCHAR), ',' ORDER BY group_name, evidence_id) AS v FROM stance GROUP BY claim_id) x) c
      LEFT JOIN ({PAIRS.format(k='claim_id', t='stance')}) p ON c.class IN (p.a, p.b)
      LEFT JOIN (SELECT claim_id, min(claim_id) OVER (PARTITION BY v) AS class FROM (SELECT claim_id, string_agg(group_name || '/' || evidence_id || '=' || CAST(value AS VARCHAR), ',' ORDER BY group_name, evidence_id) AS v FROM stance GROUP BY claim_id) y) o ON o.claim_id = CASE WHEN c.class = p.a THEN p.b ELSE p.a END AND o.class <> c.class GROUP BY c.claim_id, c.class"""),
    "map_cube": _on_base("""SELECT c.paper_id, h.status AS hygiene, c.paper_id IN ('src3', 'src7') AS incoming, GROUPING(c.paper_id, h.status, c.paper_id IN ('src3', 'src7')) AS level, count(*) AS claims, CAST(sum(coalesce(s.stature, 0)) AS BIGINT) AS stature, count(DISTINCT c.lang) AS groups
      FROM claim c LEFT JOIN stature s ON c.claim_id = s.claim_id JOIN hygiene h ON c.claim_id = h.claim_id GROUP BY CUBE (c.paper_id, h.status, c.paper_id IN ('src3', 'src7'))""", _HYGIENE),
    "living_status": _on_ideas("SELECT idea_id, status FROM status"),
    "living_relations": _on_ideas("SELECT idea_a, idea_b, kind, shared_at FROM relation"),
    "summed_rewrites": _on_base(OPS.format("stature")),
    "summed_hygiene": _on_base("SELECT claim_id, status FROM hygiene", _HYGIENE),
    "shipped_parts_hygiene": _PARTS + """, per AS (SELECT l_suppkey, p_brand, count(*) AS n, count(*) FILTER (WHERE sq > 0.05) AS wrong FROM m GROUP BY l_suppkey, p_brand)
      SELECT CASE WHEN wrong > 0 AND wrong > n - wrong THEN 'implicit_headline' WHEN n > 0 THEN 'consensus_aligned' ELSE 'scoped_explicit' END AS status, count(*) AS claims FROM c LEFT JOIN per p ON c.l_suppkey = p.l_suppkey AND c.p_brand = p.p_brand GROUP BY 1""",
    "shipped_parts_residuals": _PARTS + """ SELECT FALSE AS is_semantic, count(*) AS edges, round(sum(sq), 2) AS residual, count(DISTINCT CAST(l_suppkey AS VARCHAR) || p_brand) AS claims FROM b
      UNION ALL SELECT TRUE, count(*), round(sum(sq), 2), count(DISTINCT CAST(l_suppkey AS VARCHAR) || p_brand) FROM m""",
    "shipped_parts_stature": _PARTS + " SELECT stature, count(*) AS claims FROM backed GROUP BY stature",
    "shipped_parts_rewrites": _PARTS + """, missed AS (SELECT l_suppkey, p_brand, sum(CASE WHEN own THEN sq ELSE 0.0 END) AS r_in, sum(CASE WHEN own THEN 0.0 ELSE sq END) AS r_out FROM every GROUP BY l_suppkey, p_brand),
      tried AS (SELECT m.*, s.s, row_number() OVER (PARTITION BY m.l_suppkey, m.p_brand ORDER BY round(m.r_in + s.s * s.s * m.r_out + (1.0 + 8.0 * coalesce(k.stature, 0)) * (s.s - 1.0) * (s.s - 1.0), 9), s.s DESC) AS rn
        FROM missed m LEFT JOIN backed k ON m.l_suppkey = k.l_suppkey AND m.p_brand = k.p_brand, (VALUES (1.0), (0.8), (0.6), (0.4), (0.2), (0.0)) AS s(s))
      SELECT CAST(s AS DOUBLE) AS to_out, count(*) AS claims, round(sum(r_in + s * s * r_out), 2) AS final_residual FROM tried WHERE rn = 1 GROUP BY s""",
    "maximal_cliques": _on_ideas("SELECT array_to_string(members, '|') AS clique, CAST(len(members) AS BIGINT) AS size, row_number() OVER (ORDER BY len(members) DESC, members) AS rank FROM clique", _CLAIM_CLIQUES),
    "paper_cliques": _on_ideas("SELECT array_to_string(members, '|') AS clique, CAST(len(members) AS BIGINT) AS size, row_number() OVER (ORDER BY len(members) DESC, members) AS rank FROM clique", _PAPER_CLIQUES),
    "clique_residuals": _on_ideas("""SELECT u.clique, round(sum((u.value - d.value) * (u.value - d.value)), 6) AS residual_sq FROM (SELECT array_to_string(c.members, '|') AS clique, s.group_name, s.evidence_id, min_by(s.value, s.claim_id) AS value
      FROM (SELECT members, unnest(members) AS claim_id FROM clique) c JOIN stance s ON c.claim_id = s.claim_id GROUP BY c.members, s.group_name, s.evidence_id) u JOIN dimension d ON u.evidence_id = d.evidence_id AND d.dim_seq = 0 GROUP BY u.clique""", _CLAIM_CLIQUES),
    "clique_titles": _on_ideas("""SELECT array_to_string(c.members, '|') AS clique, min_by(k.paper_id || ' in ' || k.lang, k.claim_seq) AS title, string_agg(DISTINCT k.paper_id, ',' ORDER BY k.paper_id) AS papers, string_agg(DISTINCT k.keyword, ',' ORDER BY k.keyword) AS keywords
      FROM (SELECT members, unnest(members) AS claim_id FROM clique) c JOIN claim k ON c.claim_id = k.claim_id GROUP BY c.members""", _CLAIM_CLIQUES),
    "hygiene_counts": _on_base("SELECT status, count(*) AS claims FROM hygiene GROUP BY status", _HYGIENE),
    "claim_view": _on_base("""SELECT c.claim_id, c.paper_id, coalesce(s.stature, 0) AS stature, h.status AS hygiene, c.paper_id IN ('src3', 'src7') AS incoming, c.paper_id || ' in ' || c.lang || CASE WHEN r.to_out < 1.0 THEN ' (outside its regime at ' || printf('%.1f', r.to_out) || ')' ELSE '' END AS scoped_label
      FROM claim c LEFT JOIN stature s ON c.claim_id = s.claim_id JOIN hygiene h ON c.claim_id = h.claim_id LEFT JOIN rewrite r ON c.claim_id = r.claim_id AND r.model = 'stature'""", _HYGIENE),
    "evidence_view": _on_base("""SELECT e.evidence_id, e.paper_id, d.value, coalesce(f.edges, 0) AS edges, coalesce(f.tensions, 0) AS tensions FROM evidence e JOIN dimension d ON e.evidence_id = d.evidence_id AND d.dim_seq = 0
      LEFT JOIN (SELECT evidence_id, count(*) AS edges, count(*) FILTER (WHERE final_sq > 0.05) AS tensions FROM final GROUP BY evidence_id) f ON e.evidence_id = f.evidence_id"""),
    "paper_labels": _on_base("SELECT paper_id, upper(left(paper_id, 1)) || lower(substring(paper_id, 2)) AS label, paper_id IN ('src3', 'src7') AS incoming FROM (SELECT paper_id FROM claim UNION SELECT paper_id FROM evidence) p"),
    "surviving_edges": _on_base("SELECT evidence_id, claim_id, round(final_sq, 6) AS residual_sq FROM final WHERE NOT is_semantic AND final_sq > 0.0001 AND ev_paper IN ('src3', 'src7')"),
    "ungrouped_without_incoming": _on_ideas("""SELECT 'subject_' || lpad(CAST((SELECT count(*) FROM subject) + 1 AS VARCHAR), 2, '0') || '_ungrouped' AS subject_id, 'evidence' AS kind, evidence_id AS id FROM evidence e
      WHERE NOT EXISTS (SELECT 1 FROM explicit x JOIN claim c ON x.claim_id = c.claim_id WHERE x.evidence_id = e.evidence_id AND c.paper_id NOT IN ('src3', 'src7'))"""),
}
ORACLE_SQL["living_sums"] = ORACLE_SQL["propagated_sums"]
