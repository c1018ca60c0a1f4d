"""DuckDB SQL for the queries of ``tables``."""

_SERIES = "s AS (SELECT user_id, event_type, value, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS i FROM events)"
_DEFS = """defs AS (
  SELECT 'Order' AS kind, CAST(o_orderkey AS BIGINT) AS id FROM orders UNION ALL SELECT 'Part', CAST(p_partkey AS BIGINT) FROM part
  UNION ALL SELECT 'Supplier', CAST(s_suppkey AS BIGINT) FROM supplier UNION ALL SELECT 'Customer', CAST(c_custkey AS BIGINT) FROM customer)"""
_TENSOR = """t AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity AS xx, l_extendedprice / 2e3 AS yy, l_discount * 2e2 AS zz,
  l_tax * 1e2 AS xy, (l_quantity - 25) * l_discount AS yz, l_extendedprice / 1e4 * l_tax AS zx FROM lineitem)"""
_VM = "sqrt(5e-1 * ((xx-yy)*(xx-yy) + (yy-zz)*(yy-zz) + (zz-xx)*(zz-xx)) + 3e0 * (xy*xy + yz*yz + zx*zx))"
_LOADS = "f AS (SELECT l_suppkey, l_quantity - 25e0 AS fx, l_extendedprice / 1e1 - 25e2 AS fz, l_discount * 1e3 - 5e1 AS my, l_tax * 1e3 AS mx FROM lineitem)"
_SCALE = "7390851332151607e-16"
_PRINCIPAL = f"""{_TENSOR}, z AS (SELECT l_orderkey, l_linenumber, {', '.join(f"{c} * {_SCALE} AS {c}" for c in ("xx", "yy", "zz", "xy", "yz", "zx"))} FROM t), q AS (SELECT *, (xx+yy+zz)/3e0 AS m, xy*xy + yz*yz + zx*zx AS p1 FROM z),
  p AS (SELECT *, sqrt(((xx-m)*(xx-m) + (yy-m)*(yy-m) + (zz-m)*(zz-m) + 2e0*p1)/6e0) AS p FROM q),
  b AS (SELECT *, ((xx-m)*((yy-m)*(zz-m) - yz*yz) - xy*(xy*(zz-m) - yz*zx) + zx*(xy*yz - (yy-m)*zx)) / (p*p*p) / 2e0 AS r FROM p),
  a AS (SELECT *, acos(greatest(-1e0, least(1e0, r))) / 3e0 AS phi FROM b),
  l AS (SELECT l_orderkey, l_linenumber,
    CASE WHEN p1 = 0 THEN greatest(xx, yy, zz) ELSE m + 2e0*p*cos(phi) END AS l1,
    CASE WHEN p1 = 0 THEN least(xx, yy, zz) ELSE m + 2e0*p*cos(phi + 2e0*pi()/3e0) END AS l3, 3e0*m AS tr FROM a)"""


def _layer_vm(k: int) -> str:
    c = [f"CAST(embedding[{8 * k + j}] AS DOUBLE)" for j in range(1, 7)]
    xx, yy, zz, xy, yz, zx = c
    return f"sqrt(5e-1*(({xx}-{yy})**2 + ({yy}-{zz})**2 + ({zz}-{xx})**2) + 3e0*({xy}**2 + {yz}**2 + {zx}**2))"


ORACLE = {
    "references_resolve": f"WITH {_DEFS} SELECT l_orderkey, l_linenumber, 'Order' AS kind, l_orderkey + 100 AS id FROM lineitem WHERE l_orderkey + 100 NOT IN (SELECT id FROM defs WHERE kind = 'Order')",
    "references_resolve_connectivity": f"""WITH {_DEFS}, r AS (SELECT 'Order' AS kind, l_orderkey + 100 AS id FROM lineitem UNION ALL SELECT 'Part', l_partkey + 50 FROM lineitem UNION ALL SELECT 'Supplier', l_suppkey FROM lineitem)
      SELECT kind, id, count(*) AS n_refs FROM r WHERE NOT EXISTS (SELECT 1 FROM defs d WHERE d.kind = r.kind AND d.id = r.id) GROUP BY kind, id""",
    "references_polymorphic": f"WITH {_DEFS}, r AS (SELECT DISTINCT l_partkey + l_suppkey AS ref_id FROM lineitem) SELECT ref_id FROM r WHERE ref_id NOT IN (SELECT id FROM defs WHERE kind IN ('Part', 'Customer'))",
    "references_untracked_kind": f"""WITH {_DEFS}, r AS (SELECT CASE WHEN l_linenumber = 1 THEN 'Order' ELSE 'Widget' END AS kind, l_orderkey + 100 AS id FROM lineitem)
      SELECT kind, count(*) AS n FROM r WHERE kind IN (SELECT kind FROM defs) AND NOT EXISTS (SELECT 1 FROM defs d WHERE d.kind = r.kind AND d.id = r.id) GROUP BY kind""",
    "duplicate_ids": "SELECT * FROM (SELECT 'Line:' || l_linenumber AS kind, l_orderkey AS id, l_partkey, count(*) OVER (PARTITION BY l_linenumber, l_orderkey) AS n FROM lineitem) WHERE n > 1",
    "unreferenced_entities": "SELECT 'Part' AS kind, p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 48)",
    "first_site_wins": "SELECT p_brand AS id, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) WHERE k = 1",
    "definition_census": f"WITH {_DEFS} SELECT kind, count(DISTINCT id) AS n FROM defs GROUP BY kind",
    "deck_diff": """WITH c AS (SELECT c_mktsegment AS seg, CAST(c_nationkey AS VARCHAR) AS kind, count(DISTINCT c_custkey) AS n FROM customer GROUP BY 1, 2)
      SELECT coalesce(a.kind, b.kind) AS kind, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM (SELECT * FROM c WHERE seg = 'BUILDING') a FULL OUTER JOIN (SELECT * FROM c WHERE seg = 'MACHINERY') b ON a.kind = b.kind""",
    "include_transform_apply": """WITH k AS (SELECT c_custkey, ['Node', 'Part', 'Curve', 'Section', 'NodeSet', 'Material'][c_custkey % 6 + 1] AS kind, c_custkey - 700 AS raw FROM customer)
      SELECT c_custkey, kind, CAST(sign(raw) * (abs(raw) + CASE kind WHEN 'Node' THEN 1000 WHEN 'Part' THEN 3000 WHEN 'Curve' THEN 6000 WHEN 'Section' THEN 8000 WHEN 'NodeSet' THEN 5000 ELSE 4000 END) AS BIGINT) AS logical_id FROM k""",
    "predicate_tree": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE (l_quantity >= 45 OR l_discount < 1e-2) AND l_linestatus <> 'O' GROUP BY 1, 2",
    "table_fixed_reparse": "SELECT p_partkey AS nid, CAST(printf('%.6f', p_retailprice) AS DOUBLE) AS x, CAST(p_size AS BIGINT) AS tc FROM part",
    "table_free_reparse": "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS nation, CAST(0 AS BIGINT) AS text, CAST(0 AS BIGINT) AS absent FROM supplier",
    "fortran_float_parse": """SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN round((n_nationkey + 25e-2) / 1e2, 6) WHEN 1 THEN round((n_nationkey + 25e-2) * 1e3, 6)
      WHEN 2 THEN round(-(n_nationkey + 25e-2) / 1e2, 6) WHEN 3 THEN NULL ELSE round((n_nationkey + 25e-2) * 1e1, 6) END AS x FROM nation""",
    "canonical_base": "SELECT p_partkey, replace(upper(p_type), ' ', '_') AS base FROM part",
    "integrate": f"WITH {_SERIES}, d AS (SELECT *, coalesce(1e-3 * (value + lag(value) OVER w) / 2e0, 0e0) AS a FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i, round(sum(a) OVER (PARTITION BY user_id ORDER BY i), 6) AS integral FROM d",
    "integrate_over": f"""WITH {_SERIES}, t AS (SELECT *, i * 1e-3 + i * i * 1e-5 AS t FROM s), d AS (SELECT *, coalesce((t - lag(t) OVER w) * (value + lag(value) OVER w) / 2e0, 0e0) AS a FROM t WINDOW w AS (PARTITION BY user_id ORDER BY i))
      SELECT user_id, i, round(sum(a) OVER (PARTITION BY user_id ORDER BY i), 8) AS integral FROM d""",
    "differentiate": f"""WITH {_SERIES}, d AS (SELECT *, lag(value) OVER w AS p, lead(value) OVER w AS n FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i))
      SELECT user_id, i, round(CASE WHEN p IS NULL AND n IS NULL THEN 0e0 WHEN p IS NULL THEN (n - value) / 1e-3 WHEN n IS NULL THEN (value - p) / 1e-3 ELSE (n - p) / 2e-3 END, 4) AS derivative FROM d""",
    "decimate": f"WITH {_SERIES} SELECT user_id, CAST(i // 4 AS BIGINT) AS i, value FROM s WHERE i % 4 = 0",
    "resample_linear": f"""WITH {_SERIES}, n AS (SELECT user_id, max(i) AS last FROM s GROUP BY 1), k AS (SELECT user_id, last, unnest(range(CAST(floor(last / 25e-1) AS BIGINT) + 1)) AS k FROM n)
      SELECT k.user_id, k.k AS i, round(CASE WHEN b.value IS NULL THEN a.value ELSE a.value * (1e0 - (k.k * 25e-1 - a.i)) + b.value * (k.k * 25e-1 - a.i) END, 6) AS value
      FROM k JOIN s a ON a.user_id = k.user_id AND a.i = CAST(floor(k.k * 25e-1) AS BIGINT) LEFT JOIN s b ON b.user_id = k.user_id AND b.i = a.i + 1""",
    "clip_3ms": f"WITH {_SERIES}, d AS (SELECT user_id, i, value, min(value) OVER (PARTITION BY user_id ORDER BY i ROWS 2 PRECEDING) AS low FROM s) SELECT user_id, coalesce(max(low) FILTER (i >= 2), min(value)) AS clip FROM d GROUP BY user_id",
    "severity_index": f"""WITH {_SERIES}, d AS (SELECT user_id, 1e-3 * (value ** 25e-1 + lag(value) OVER (PARTITION BY user_id ORDER BY i) ** 25e-1) / 2e0 AS a FROM s)
      SELECT user_id, round(coalesce(sum(a), 0), 4) AS severity_index FROM d GROUP BY user_id""",
    "hic15": f"""WITH {_SERIES}, d AS (SELECT user_id, i, coalesce(1e-3 * (value + lag(value) OVER w) / 2e0, 0e0) AS a FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
      v AS (SELECT user_id, i, sum(a) OVER (PARTITION BY user_id ORDER BY i) AS v FROM d)
      SELECT x.user_id, round(sqrt(max((y.v - x.v) ** 5 / (y.i - x.i) ** 3) / 1e-9), 4) AS hic15 FROM v x JOIN v y ON x.user_id = y.user_id AND y.i > x.i AND y.i <= x.i + 15 GROUP BY x.user_id""",
    "vc": f"""WITH {_SERIES}, z AS (SELECT user_id, i, value * {_SCALE} AS value FROM s), d AS (SELECT user_id, value, (8e0 * (lead(value, 1) OVER w - lag(value, 1) OVER w) - (lead(value, 2) OVER w - lag(value, 2) OVER w)) / 12e-3 AS r FROM z WINDOW w AS (PARTITION BY user_id ORDER BY i))
      SELECT user_id, round(coalesce(max(value / 229e-3 * r), 0), 5) AS vc FROM d GROUP BY user_id""",
    "nic": f"""WITH {_SERIES}, r AS (SELECT user_id, i, value * 5e-1 AS a FROM s), d AS (SELECT *, coalesce(1e-3 * (a + lag(a) OVER w) / 2e0, 0e0) AS g FROM r WINDOW w AS (PARTITION BY user_id ORDER BY i)),
      v AS (SELECT *, sum(g) OVER (PARTITION BY user_id ORDER BY i) AS v FROM d) SELECT user_id, round(max(2e-1 * a + v * v), 6) AS nic FROM v GROUP BY user_id""",
    "nij": f"""WITH {_LOADS}, m AS (SELECT *, my - 178e-4 * fx AS c FROM f)
      SELECT l_suppkey, round(greatest(0e0, max(fz / CASE WHEN fz <= 0 THEN -616e1 ELSE 6806e0 END + c / CASE WHEN c > 0 THEN 31e1 ELSE -135e0 END)), 6) AS nij FROM m GROUP BY l_suppkey""",
    "tibia_index": f"WITH {_LOADS} SELECT l_suppkey, round(max(abs(sqrt(mx*mx + my*my) / 225e0) + abs(fz / -359e2)), 6) AS tibia_index FROM f GROUP BY l_suppkey",
    "bric": f"WITH {_LOADS} SELECT l_suppkey, round(sqrt((max(abs(fx))/6625e-2)**2 + (max(abs(my))/5645e-2)**2 + (max(abs(mx))/4287e-2)**2), 6) AS bric FROM f GROUP BY l_suppkey",
    "ubric": f"""WITH {_LOADS}, p AS (SELECT l_suppkey, max(abs(fx))/6625e-2 AS w1, max(abs(my))/5645e-2 AS w2, max(abs(mx))/4287e-2 AS w3, max(abs(fz))/12e3 AS a1, max(abs(fx))/5e1 AS a2, max(abs(my))/4e1 AS a3 FROM f GROUP BY 1),
      t AS (SELECT l_suppkey, CASE WHEN w1 = 0 THEN a1 ELSE w1 + (a1-w1)*exp(-a1/w1) END AS t1, CASE WHEN w2 = 0 THEN a2 ELSE w2 + (a2-w2)*exp(-a2/w2) END AS t2, CASE WHEN w3 = 0 THEN a3 ELSE w3 + (a3-w3)*exp(-a3/w3) END AS t3 FROM p)
      SELECT l_suppkey, round(sqrt(t1*t1 + t2*t2 + t3*t3), 6) AS ubric FROM t""",
    "resultant": "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity*l_quantity + l_discount*l_discount + l_tax*l_tax), 6) AS resultant FROM lineitem",
    "time_series_extract": f"""WITH {_SERIES}, d AS (SELECT *, coalesce(1e-3 * (value + lag(value) OVER w) / 2e0, 0e0) AS a FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i))
      SELECT user_id, round(arg_max(value, i), 6) AS last, round(arg_min(value, i), 6) AS first, round(max(value), 6) AS max, round(min(value), 6) AS min, round(max(abs(value)), 6) AS abs_max, round(avg(value), 6) AS mean, round(sum(a), 6) AS integral FROM d GROUP BY user_id""",
    "von_mises": f"WITH {_TENSOR} SELECT l_orderkey, l_linenumber, round({_VM}, 6) AS von_mises FROM t",
    "pressure": f"WITH {_TENSOR} SELECT l_orderkey, l_linenumber, round(-(xx + yy + zz) / 3e0, 6) AS pressure FROM t",
    "triaxiality": f"WITH {_TENSOR}, v AS (SELECT *, {_VM} AS vm FROM t) SELECT l_orderkey, l_linenumber, round(CASE WHEN vm = 0 THEN 0e0 ELSE (xx + yy + zz) / 3e0 / vm END, 6) AS triaxiality FROM v",
    "principal": f"WITH {_PRINCIPAL} SELECT l_orderkey, l_linenumber, round(l1, 5) AS l1, round(tr - l1 - l3, 5) AS l2, round(l3, 5) AS l3 FROM l",
    "max_shear": f"WITH {_PRINCIPAL} SELECT l_orderkey, l_linenumber, round((l1 - l3) / 2e0, 5) AS max_shear FROM l",
    "part_max_history": f"WITH {_TENSOR} SELECT l_suppkey, l_linenumber, round(greatest(0e0, max({_VM})), 6) AS value FROM t GROUP BY 1, 2",
    "part_percentile_history": f"WITH {_TENSOR} SELECT l_suppkey, l_linenumber, round(quantile_cont(yy, 0.95), 8) AS value FROM t GROUP BY 1, 2",
    "part_failure_fraction": f"WITH {_TENSOR} SELECT l_suppkey, l_linenumber, round(avg(CASE WHEN yy > 2e1 THEN 1e0 ELSE 0e0 END), 9) AS value FROM t GROUP BY 1, 2",
    "part_argmax": """WITH t AS (SELECT l_suppkey, l_linenumber, l_partkey, l_quantity AS xx FROM lineitem), m AS (SELECT *, max(xx) OVER (PARTITION BY l_suppkey, l_linenumber) AS best FROM t)
      SELECT l_suppkey, l_linenumber, min(l_partkey) AS l_partkey, max(best) AS value FROM m WHERE xx = best GROUP BY 1, 2""",
    "shell_layer_max": f"SELECT vec_id, round(greatest({', '.join(_layer_vm(k) for k in range(8))}), 6) AS worst, round({_layer_vm(7)}, 6) AS top, round(greatest(0e0, {', '.join(f'CAST(embedding[{8 * k + 7}] AS DOUBLE)' for k in range(8))}), 6) AS strain FROM embeddings",
    "state_matrix_pivot": f"WITH {_SERIES} SELECT i, " + ", ".join(f"round(coalesce(sum(value) FILTER (event_type = '{c}'), 0e0), 6) AS {c}" for c in ("click", "error", "purchase", "view")) + " FROM s GROUP BY i",
    "census_rollup": "SELECT coalesce(seg, 'all') AS c_mktsegment, coalesce(nat, -1) AS c_nationkey, n, n_ids FROM (SELECT c_mktsegment AS seg, c_nationkey AS nat, count(*) AS n, count(DISTINCT c_custkey) AS n_ids FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey))",
    "top_peaks": f"WITH {_SERIES} SELECT user_id, i, value FROM s ORDER BY value DESC, user_id, i LIMIT 10",
    "ids_intersect": "SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'",
    "ids_except": "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 48",
    "files_distinct": "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1",
}
