"""DuckDB SQL for the queries of ``decks``, over the tables that their files are written from."""

_NODE = "node AS (SELECT o_orderkey + 1 AS id FROM orders)"
_MAT = """mat AS (SELECT s_suppkey + 1001 AS id, CASE WHEN s_nationkey < 5 THEN 'MAT_RIGID' ELSE 'MAT_ELASTIC' END AS keyword, CASE WHEN s_suppkey % 7 = 0 THEN 2 ELSE 1 END AS copies FROM supplier),
  site AS (SELECT id, keyword FROM mat UNION ALL SELECT id, 'MAT_RIGID' FROM mat WHERE copies = 2)"""
_PART = "prt AS (SELECT p_partkey + 1 AS pid, p_size AS secid, 1000 + p_partkey % 120 + 1 AS mid FROM part)"
_SEC = "sec AS (SELECT DISTINCT CAST(p_size AS BIGINT) AS id FROM part WHERE p_size <= 40 UNION SELECT 1000 + r_regionkey FROM region)"
_SHELL = """shell AS (SELECT l_orderkey * 10 + l_linenumber AS eid, l_partkey + 1 + CASE WHEN l_linenumber = 7 THEN 50 ELSE 0 END AS pid,
  l_orderkey + 1 AS n1, l_orderkey + 2 AS n2, l_orderkey + 51 AS n3, l_orderkey + 101 AS n4 FROM lineitem)"""
_RIGID = "rb AS (SELECT c_custkey + 1 AS pidl, (c_custkey % 50 + 1) * CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END AS pidc FROM customer)"
_ALL = f"{_NODE}, {_MAT}, {_PART}, {_SEC}, {_SHELL}, {_RIGID}"
_UNDEFINED = " — not defined in the deck"
_DANGLING = f"""bad AS (
  SELECT 'BOUNDARY_SPC_NODE' AS keyword, 'NID' AS field, 'Node' AS kind, c_custkey * 11 + 1 AS id FROM customer WHERE c_custkey * 11 + 1 NOT IN (SELECT id FROM node)
  UNION ALL SELECT 'PART', 'SECID', 'Section', secid FROM prt WHERE secid NOT IN (SELECT id FROM sec)
  UNION ALL SELECT 'PART', 'MID', 'Material', mid FROM prt WHERE mid NOT IN (SELECT id FROM site)
  UNION ALL SELECT 'CONSTRAINED_RIGID_BODIES', 'PIDL', 'Part', pidl FROM rb WHERE pidl NOT IN (SELECT pid FROM prt)
  UNION ALL SELECT 'CONSTRAINED_RIGID_BODIES', 'PIDC', 'Part', pidc FROM rb WHERE abs(pidc) NOT IN (SELECT pid FROM prt))"""
_CONN = """, conn AS (SELECT * FROM bad
  UNION ALL SELECT 'ELEMENT_SHELL', 'PID', 'Part', pid FROM shell WHERE pid NOT IN (SELECT pid FROM prt)
  UNION ALL SELECT 'ELEMENT_SHELL', upper(field), 'Node', id FROM (UNPIVOT (SELECT n1, n2, n3, n4 FROM shell) ON n1, n2, n3, n4 INTO NAME field VALUE id) WHERE id NOT IN (SELECT id FROM node))"""


def _findings(rule: str, severity: str, keyword: str, message: str, source: str, having: str = "") -> str:
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, {keyword} AS keyword, {message} AS message, count(*) AS n FROM {source} {having} GROUP BY ALL"


def _forbidden(keyword: str, source: str) -> str:
    return _findings(f"keyword_forbidden({keyword})", "Error", f"'{keyword.upper()}'", f"'keyword *{keyword.upper()} is not allowed here'", source)


_REFERS = f"keyword || '.' || field || ' references ' || kind || ' ' || id || '{_UNDEFINED}'"
_NATION = "n AS (SELECT n_nationkey AS k, n_regionkey AS r, 'nation_' || n_nationkey || '.k' AS name FROM nation)"
_DAY = """d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, value, user_id FROM events),
  s AS (SELECT day, row_number() OVER (ORDER BY day) AS k FROM (SELECT DISTINCT day FROM d)),
  t AS (SELECT * FROM (VALUES (0, 11, 'click'), (1, 12, 'error'), (2, 13, 'purchase'), (3, 14, 'view')) v(col, id, event_type)),
  c AS (SELECT printf('d%06d', s.k) AS state, CAST(s.k - 1 AS DOUBLE) AS time, t.col, CAST(t.id AS BIGINT) AS entity_id, t.event_type AS legend, s.day,
    CAST(count(d.value) AS DOUBLE) AS n, coalesce(max(d.value), 0e0) AS peak FROM s CROSS JOIN t LEFT JOIN d ON d.day = s.day AND d.event_type = t.event_type GROUP BY ALL),
  u AS (SELECT s.day, s.k, CAST(count(DISTINCT user_id) AS DOUBLE) AS users FROM s JOIN d ON d.day = s.day GROUP BY ALL)"""
_STATE = """g AS (SELECT s, q FROM range(1, 8) a(s) CROSS JOIN range(1, 51) b(q)),
  a AS (SELECT l_linenumber AS s, CAST(l_quantity AS INTEGER) AS q, count(*) AS n, max(l_partkey % 1000) AS p, max(l_suppkey % 1000) AS u, min(l_orderkey % 1000) AS o FROM lineitem GROUP BY 1, 2),
  e AS (SELECT CAST(g.s - 1 AS INTEGER) AS state, g.s / 2e0 AS time, CAST(g.q - 1 AS INTEGER) AS entity, 500 + g.q AS element_id, CAST(g.q % 5 + 1 AS INTEGER) AS part_index, 70 + g.q % 5 AS part_id,
    coalesce(n, 0) * 1e0 AS w0, coalesce(p, 0) * 1e0 AS w1, coalesce(u, 0) * 1e0 AS w2, coalesce(o, 0) * 1e0 AS w3, g.s * 1e0 AS w4, g.q * 1e0 AS w5, coalesce(n, 0) % 7 * 1e0 AS w6
    FROM g LEFT JOIN a ON a.s = g.s AND a.q = g.q)"""
_VM = "sqrt(5e-1 * ((w0-w1)*(w0-w1) + (w1-w2)*(w1-w2) + (w2-w0)*(w2-w0)) + 3e0 * (w3*w3 + w4*w4 + w5*w5))"

ORACLE = {
    "deck_nodes": "SELECT o_orderkey + 1 AS nid, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, o_custkey / 4e0 AS z FROM orders",
    "deck_shells": f"WITH {_SHELL} SELECT *, CAST(0 AS BIGINT) AS n5 FROM shell",
    "deck_parts": f"WITH {_PART} SELECT p_name AS heading, p_partkey + 1 AS pid, CAST(p_size AS BIGINT) AS secid, 1001 + p_partkey % 120 AS mid, CAST(0 AS BIGINT) AS eosid FROM part",
    "deck_constraints": "SELECT c_custkey * 11 + 1 AS nid, CAST(0 AS BIGINT) AS cid, CAST(c_nationkey % 3 AS BIGINT) AS dofx FROM customer",
    "deck_blocks": f"""WITH {_MAT}, {_SEC} SELECT 'PART' AS name, 'PART' AS base, 0 AS title_offset, count(*) AS n FROM part UNION ALL SELECT 'SECTION_SHELL', 'SECTION_SHELL', 0, count(*) FROM sec
      UNION ALL SELECT CASE keyword WHEN 'MAT_ELASTIC' THEN 'MAT_ELASTIC_TITLE' ELSE keyword END, keyword, CASE keyword WHEN 'MAT_ELASTIC' THEN 1 ELSE 0 END, count(*) FROM site GROUP BY keyword
      UNION ALL SELECT x, x, 0, n FROM (SELECT count(*) AS n FROM customer) CROSS JOIN (VALUES ('BOUNDARY_SPC_NODE'), ('CONSTRAINED_RIGID_BODIES')) v(x) UNION ALL SELECT 'CONTROL_TERMINATION', 'CONTROL_TERMINATION', 0, 1""",
    "deck_definition_census": f"WITH {_ALL} SELECT 'Node' AS kind, count(*) AS n FROM node UNION ALL SELECT 'Element', count(DISTINCT eid) FROM shell UNION ALL SELECT 'Part', count(*) FROM prt UNION ALL SELECT 'Section', count(*) FROM sec UNION ALL SELECT 'Material', count(DISTINCT id) FROM mat",
    "deck_references": f"""WITH {_PART}, {_RIGID}, r AS (SELECT 'BOUNDARY_SPC_NODE' AS keyword, 'NID' AS field, 'Node' AS kind, c_custkey * 11 + 1 AS id FROM customer UNION ALL SELECT 'PART', 'SECID', 'Section', secid FROM prt UNION ALL SELECT 'PART', 'MID', 'Material', mid FROM prt
      UNION ALL SELECT 'CONSTRAINED_RIGID_BODIES', 'PIDL', 'Part', pidl FROM rb UNION ALL SELECT 'CONSTRAINED_RIGID_BODIES', 'PIDC', 'Part', pidc FROM rb) SELECT keyword, field, kind, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM r GROUP BY ALL""",
    "deck_first_sites": f"WITH {_MAT} SELECT id, id - 1000 AS phys_id, keyword FROM mat",
    "rule_references_resolve": f"WITH {_ALL}, {_DANGLING} " + _findings("references_resolve", "Error", "keyword", _REFERS, "bad"),
    "rule_references_connectivity": f"WITH {_ALL}, {_DANGLING}{_CONN} " + _findings("references_resolve", "Error", "keyword", _REFERS, "conn"),
    "rule_duplicate_ids": f"WITH {_MAT}, b AS (SELECT * FROM site WHERE id IN (SELECT id FROM mat WHERE copies = 2)) " + _findings("duplicate_ids", "Error", "keyword", "'duplicate Material id ' || id || ' — defined by 2 keywords in the deck'", "b"),
    "rule_unreferenced_entities": f"""WITH {_MAT}, {_PART}, {_SEC}, b AS (SELECT keyword, 'Material' AS kind, id FROM mat WHERE id NOT IN (SELECT mid FROM prt) UNION ALL SELECT 'SECTION_SHELL', 'Section', id FROM sec WHERE id NOT IN (SELECT secid FROM prt)) """
    + _findings("unreferenced_entities", "Warning", "keyword", "kind || ' ' || id || ' is defined but never referenced'", "b"),
    "rigid_context": f"""WITH {_MAT}, {_PART}, {_RIGID}, r AS (SELECT 'PIDL' AS field, pidl AS id FROM rb UNION ALL SELECT 'PIDC', pidc FROM rb),
      b AS (SELECT field, r.id, mat.keyword AS m FROM r JOIN prt ON prt.pid = abs(r.id) JOIN mat ON mat.id = prt.mid WHERE mat.keyword <> 'MAT_RIGID') """
    + _findings("rigid_context", "Error", "'CONSTRAINED_RIGID_BODIES'", "'CONSTRAINED_RIGID_BODIES.' || field || ' references part ' || id || ', whose material *' || m || ' is not *MAT_RIGID'", "b"),
    "keyword_forbidden": f"WITH {_MAT}, b AS (SELECT * FROM site WHERE keyword = 'MAT_ELASTIC') " + _forbidden("mat_elastic", "b"),
    "field_forbidden_values": "WITH b AS (SELECT * FROM customer WHERE c_nationkey % 3 = 2) " + _findings("field_forbidden_values(BOUNDARY_SPC_NODE.dofx)", "Error", "'BOUNDARY_SPC_NODE'", "'dofx = 2 is forbidden'", "b"),
    "field_required_when": f"WITH {_PART}, b AS (SELECT * FROM prt WHERE secid > 30 AND mid > 1060) " + _findings("field_required(PART)", "Error", "'PART'", "'requires secid <= 30 when MID > 1060, got ' || secid", "b"),
    "rule_include_missing": "SELECT 'INCLUDE' AS keyword, CAST(0 AS BIGINT) AS line, 'include ''missing.k'' resolves to a missing file: ' AS said",
    "file_scope_only": _forbidden("PART", "part"),
    "file_scope_except": f"WITH {_SEC} " + _forbidden("SECTION_SHELL", "sec"),
    "severity_report": f"""WITH {_MAT}, {_PART}, {_SEC} SELECT 'Error' AS severity, 2 * count(*) AS n FROM mat WHERE copies = 2 UNION ALL SELECT 'Warning', count(*) FROM sec WHERE id NOT IN (SELECT secid FROM prt)
      UNION ALL SELECT 'Info', count(*) FROM site WHERE keyword = 'MAT_RIGID'""",
    "deck_totals": "SELECT true AS files, true AS bytes, CAST(1 AS BIGINT) AS missing",
    "entities": f"WITH {_SEC} SELECT id, CAST(2 AS BIGINT) AS elform FROM sec",
    "reference_follow": f"WITH {_MAT}, {_PART} SELECT pid, mid, keyword FROM prt JOIN mat ON mat.id = prt.mid",
    "include_tree_rollup": f"""WITH {_NATION} SELECT 'root.k' AS name, NULL AS parent, 0 AS depth, NULL AS kind, CAST(0 AS BIGINT) AS idnoff UNION ALL SELECT 'region_' || r_regionkey || '.k', 'root.k', 1, 'include_transform', 10000 * (r_regionkey + 1) FROM region
      UNION ALL SELECT name, 'region_' || r || '.k', 2, 'include_transform', 10000 * (r + 1) + 100 * (k + 1) FROM n""",
    "include_directives": f"""WITH {_NATION} SELECT 'include_path_relative' AS kind, 'sub' AS raw_path, true AS is_there, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'include_transform', 'region_' || r_regionkey || '.k', true, 1 FROM region UNION ALL SELECT 'include_transform', name, true, 1 FROM n""",
    "include_offsets": f"WITH {_NATION} SELECT 'Node' AS kind, CAST(k + 1 + 10000 * (r + 1) + 100 * (k + 1) AS BIGINT) AS id, CAST(k + 1 AS BIGINT) AS phys_id, CAST(3 AS BIGINT) AS line FROM n",
    "block_lines": f"WITH {_NATION} SELECT name, base, block_idx, line FROM n CROSS JOIN (VALUES ('NODE', 1, CAST(3 AS BIGINT)), ('BOUNDARY_SPC_NODE', 2, 6), ('BOUNDARY_SPC_NODE', 3, 9)) v(base, block_idx, line)",
    "finding_lines": f"WITH {_NATION} SELECT name, CAST(9 AS BIGINT) AS line, 'BOUNDARY_SPC_NODE.NID references Node 77{_UNDEFINED}' AS message FROM n WHERE 77 <> k + 1",
    "set_field": "SELECT CAST(nid AS BIGINT) AS nid, CAST(dofx AS BIGINT) AS dofx, CAST(0 AS BIGINT) AS dofy, CAST(7 AS BIGINT) AS dofz FROM (VALUES (1, 1), (77, 0)) v(nid, dofx)",
    "write_keyword_roundtrip": "SELECT l_partkey + 1 AS nid, max(l_extendedprice) AS x, max(l_tax) AS y, CAST(count(*) AS DOUBLE) AS z FROM lineitem GROUP BY 1",
    "user_schema": "SELECT s_suppkey AS wid, s_suppkey * 3 + 1 AS \"of\", CAST(printf('%.2f', s_acctbal) AS DOUBLE) AS first, CAST(s_nationkey AS DOUBLE) AS second, 't' || s_nationkey AS tag FROM supplier",
    "user_schema_polymorphic": f"SELECT 'VENDOR_LINK' AS keyword, 'VENDOR_LINK.OF references [Part, Material] ' || (s_suppkey * 3 + 1) || '{_UNDEFINED}' AS message FROM supplier WHERE s_suppkey * 3 + 1 NOT IN (SELECT p_partkey + 1 FROM part WHERE p_size > 10)",
    "batch_dangling": """WITH r AS (SELECT r_regionkey AS k, unnest([r_regionkey * 40 + 1, 5000 + r_regionkey * 40 + 1, 900000 + r_regionkey]) AS id FROM region)
      SELECT CAST(k AS INTEGER) AS deck_id, 'BOUNDARY_SPC_NODE' AS keyword, 'nid' AS field, 'Node' AS kind, CAST(id AS BIGINT) AS id FROM r WHERE id NOT IN (SELECT c_custkey + 1 + 5000 * (k % 2) FROM customer)""",
    "batch_duplicates": "SELECT CAST(r_regionkey AS INTEGER) AS deck_id, 'Curve' AS kind, CAST(7 AS BIGINT) AS id, CAST(r_regionkey + 1 AS BIGINT) AS n, CAST(r_regionkey + 1 AS BIGINT) AS sites FROM region WHERE r_regionkey > 0",
    "batch_census": "SELECT CAST(r_regionkey AS INTEGER) AS deck_id, 'Curve' AS kind, CAST(1 AS BIGINT) AS n FROM region UNION ALL SELECT CAST(r_regionkey AS INTEGER), 'Node', (SELECT count(*) FROM customer) FROM region",
    "batch_validate": """WITH r AS (SELECT r_regionkey AS k, unnest([r_regionkey * 40 + 1, 5000 + r_regionkey * 40 + 1, 900000 + r_regionkey]) AS id FROM region)
      SELECT CAST(k AS INTEGER) AS deck_id, 0 AS rule_seq, 'references_resolve' AS rule, 'Error' AS severity, count(*) AS n FROM r WHERE id NOT IN (SELECT c_custkey + 1 + 5000 * (k % 2) FROM customer) GROUP BY k
      UNION ALL SELECT CAST(r_regionkey AS INTEGER), 1, 'duplicate_ids', 'Error', CAST(r_regionkey + 1 AS BIGINT) FROM region WHERE r_regionkey > 0
      UNION ALL SELECT CAST(r_regionkey AS INTEGER), 2, 'keyword_forbidden(DEFINE_CURVE)', 'Error', CAST(r_regionkey + 1 AS BIGINT) FROM region""",
    "batch_stats": "SELECT true AS parsed, true AS uses",
    "binout_wide": f"WITH {_DAY} SELECT 'run1' AS run_id, state, time, col AS id, entity_id, n AS count, peak AS peak_value, users FROM c JOIN u ON u.day = c.day",
    "binout_long": f"""WITH {_DAY} SELECT state, time, col, entity_id, legend, 'count' AS var, n AS value FROM c
      UNION ALL SELECT printf('d%06d', k), CAST(k - 1 AS DOUBLE), 0, 11, 'click', 'users', users FROM u""",
    "binout_selected": f"WITH {_DAY} SELECT state, time, col, entity_id, peak AS value FROM c WHERE legend IN ('view', 'click')",
    "binout_time_series": f"WITH {_DAY} SELECT k - 1 AS i, CAST(k - 1 AS DOUBLE) AS time, users AS value FROM u",
    "binout_append": f"WITH {_DAY} SELECT state, col AS id, n AS count, users FROM c JOIN u ON u.day = c.day",
    "binout_metadata": f"WITH {_DAY} SELECT CAST(id AS BIGINT) AS id, event_type AS legend, 'events by day' AS title, channel FROM t CROSS JOIN (VALUES ('count'), ('peak value'), ('time'), ('users')) v(channel)",
    "plot_elements": f"WITH {_STATE} SELECT state, time, element_id, part_index, part_id, w0, w1, w2, w3, w4, w5, w6 FROM e",
    "plot_nodes": f"WITH {_STATE} SELECT state, time, CAST(1001 + entity AS BIGINT) AS node_id, entity + 1e0 AS x, 2e0 * (entity + 1) + state + 1 AS y, 2e0 * (state + 1) AS z FROM e",
    "plot_displacement": f"WITH {_STATE} SELECT state, entity, round(sqrt(5e0 * (state + 1) * (state + 1)), 9) AS value FROM e",
    "plot_velocity": f"WITH {_STATE} SELECT state, entity, state + 1e0 AS vz FROM e WHERE state IN (0, 6)",
    "plot_part_max": f"WITH {_STATE} SELECT state, time, max(w0) AS value FROM e WHERE part_id = 72 GROUP BY 1, 2",
    "plot_part_von_mises": f"WITH {_STATE} SELECT state, round(max({_VM}), 6) AS value FROM e WHERE part_index = 2 GROUP BY 1",
    "plot_part_percentile": f"WITH {_STATE} SELECT state, round(quantile_cont(w0, 0.75), 8) AS value FROM e WHERE part_index = 1 GROUP BY 1",
    "plot_part_fraction": f"WITH {_STATE} SELECT state, round(avg(CASE WHEN w6 > 3 THEN 1e0 ELSE 0e0 END), 9) AS value FROM e WHERE part_id = 74 GROUP BY 1",
    "plot_part_argmax": f"WITH {_STATE} SELECT state, arg_min(entity, (-w6, entity)) AS entity, max(w6) AS value FROM e WHERE part_id = 73 GROUP BY 1",
    "plot_part_elements": f"WITH {_STATE} SELECT state, entity, w6 AS value FROM e WHERE part_index = 5",
    "event_windows": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, max(value) AS peak FROM events GROUP BY 1, 2",
    "stream_peaks": "SELECT user_id, count(*) AS n, max(abs(value)) AS peak FROM events GROUP BY 1",
    "stream_states": f"WITH {_STATE} SELECT printf('d3plot%02d', state + 1) AS file, time, entity, w0 AS n FROM e",
}
