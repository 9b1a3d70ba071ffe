"""The graph queries as SQL, for a check by another engine."""

from __future__ import annotations

E = """lines AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lines a JOIN lines b USING (l_orderkey) WHERE a.l_partkey < b.l_partkey)"""
CHAIN = """led AS (SELECT o_custkey AS a, lead(o_custkey) OVER (ORDER BY o_orderkey) AS b FROM orders),
e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM led WHERE a <> b)"""
SYM = "s AS (SELECT src AS v, dst AS u FROM e UNION ALL SELECT dst, src FROM e)"
DEG = "d AS (SELECT v, count(*) AS degree FROM s GROUP BY v)"
TRI = "t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst)"
K4 = "k4 AS (SELECT a, b, c, w.dst AS d FROM t JOIN e w ON w.src = c JOIN e x ON x.src = a AND x.dst = w.dst JOIN e y ON y.src = b AND y.dst = w.dst)"
K5 = "k5 AS (SELECT a, b, c, d, w.dst AS f FROM k4 JOIN e w ON w.src = d JOIN e x ON x.src = a AND x.dst = w.dst JOIN e y ON y.src = b AND y.dst = w.dst JOIN e z ON z.src = c AND z.dst = w.dst)"
HIST = "h AS (SELECT src, dst, CAST(CASE WHEN rn < m // 2 THEN 0 ELSE (rn - m // 2) // ((m - m // 2 + 3) // 4) + 1 END AS BIGINT) AS batch FROM (SELECT *, row_number() OVER (ORDER BY src, dst) - 1 AS rn, count(*) OVER () AS m FROM e))"
TTS = "tt AS (SELECT a, b, c, greatest(x.batch, y.batch, z.batch) AS ts, least(x.batch, y.batch, z.batch) AS ts0 FROM t JOIN h x ON x.src = a AND x.dst = b JOIN h y ON y.src = a AND y.dst = c JOIN h z ON z.src = b AND z.dst = c)"
N = "CAST(count(*) AS BIGINT)"
S = "CAST(sum({}) AS BIGINT)"


def q(select: str, *ctes: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {select}"


MOTIF3 = f"""SELECT 22 AS pattern_id, CAST((SELECT sum(degree * (degree - 1) // 2) FROM d) - 3 * (SELECT count(*) FROM t) AS BIGINT) AS cnt
UNION ALL SELECT 42, {N} FROM t"""
M4 = """te AS (SELECT src, dst, count(*) AS n FROM (SELECT a AS src, b AS dst FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t) GROUP BY ALL),
w AS (SELECT count(*) AS c FROM s x JOIN s y ON x.v = y.v AND x.u < y.u GROUP BY x.u, y.u),
n AS (SELECT (SELECT sum(degree * (degree - 1) * (degree - 2) // 6) FROM d) AS star,
  (SELECT sum((p.degree - 1) * (r.degree - 1)) FROM e JOIN d p ON p.v = src JOIN d r ON r.v = dst) - 3 * (SELECT count(*) FROM t) AS path,
  (SELECT sum(p.degree + r.degree + o.degree - 6) FROM t JOIN d p ON p.v = a JOIN d r ON r.v = b JOIN d o ON o.v = c) AS tail,
  (SELECT sum(c * (c - 1) // 2) // 2 FROM w) AS cyc, (SELECT sum(n * (n - 1) // 2) FROM te) AS dia, (SELECT count(*) FROM k4) AS n4),
m1 AS (SELECT *, dia - 6 * n4 AS m175 FROM n), m2 AS (SELECT *, cyc - m175 - 3 * n4 AS m170, tail - 4 * m175 - 12 * n4 AS m107 FROM m1),
m3 AS (SELECT *, star - m107 - 2 * m175 - 4 * n4 AS m87, path - 2 * m107 - 4 * m170 - 6 * m175 - 12 * n4 AS m90 FROM m2),
m AS (SELECT 87 AS pattern_id, m87 AS cnt FROM m3 UNION ALL SELECT 90, m90 FROM m3 UNION ALL SELECT 107, m107 FROM m3 UNION ALL SELECT 170, m170 FROM m3 UNION ALL SELECT 175, m175 FROM m3 UNION ALL SELECT 255, n4 FROM m3)"""
MOTIF4 = "SELECT pattern_id, CAST(cnt AS BIGINT) AS cnt FROM m WHERE cnt > 0"
KW = """k AS (SELECT v, v & 31 AS w FROM d WHERE v & 31 < 3),
adj AS (SELECT v, u FROM s),
k3 AS (SELECT x.v AS a, y.v AS b, z.v AS c,
  EXISTS (SELECT 1 FROM s WHERE s.v = x.v AND s.u = y.v) AS ab, EXISTS (SELECT 1 FROM s WHERE s.v = x.v AND s.u = z.v) AS ac, EXISTS (SELECT 1 FROM s WHERE s.v = y.v AND s.u = z.v) AS bc
  FROM k x, k y, k z WHERE x.w = 0 AND y.w = 1 AND z.w = 2),
c3 AS (SELECT a, b, c FROM k3 WHERE CAST(ab AS INT) + CAST(ac AS INT) + CAST(bc AS INT) >= 2),
near AS (SELECT a, b, c, ab, ac, bc, u AS d, bool_or(v = a) AS da, bool_or(v = b) AS db, bool_or(v = c) AS dc
  FROM k3 JOIN s ON s.v IN (a, b, c) WHERE u & 31 >= 3 GROUP BY ALL),
c4 AS (SELECT a, b, c, d FROM near WHERE (da OR (db AND ab) OR (dc AND ac) OR (db AND bc AND ac) OR (dc AND bc AND ab))
  AND (db OR (da AND ab) OR (dc AND bc) OR (da AND ac AND bc) OR (dc AND ac AND ab))
  AND (dc OR (da AND ac) OR (db AND bc) OR (da AND ab AND bc) OR (db AND ab AND ac)))"""
NAME3 = "array_to_string(list_sort([a, b, c]), '-')"
NAME4 = "array_to_string(list_sort([a, b, c, d]), '-')"
EPOCHS = "SELECT CAST(ts AS BIGINT) AS ts, {} AS found FROM {} GROUP BY ts"
DELTA3 = """g AS (SELECT 1 AS ts UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4),
dd AS (SELECT k AS upto, v, count(*) AS degree FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k) JOIN (SELECT src AS v, batch FROM h UNION ALL SELECT dst, batch FROM h) ON batch <= k GROUP BY ALL),
ww AS (SELECT upto, sum(degree * (degree - 1) // 2) AS n FROM dd GROUP BY upto),
t3 AS (SELECT k AS upto, count(ts) AS n FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k) LEFT JOIN tt ON ts <= k GROUP BY k),
cen AS (SELECT upto, 22 AS pattern_id, ww.n - 3 * t3.n AS n FROM ww JOIN t3 USING (upto) UNION ALL SELECT upto, 42, n FROM t3)"""
INDUCED3 = """p3 AS (SELECT x.v AS m, x.u AS p, y.u AS r FROM s x JOIN s y ON x.v = y.v AND x.u < y.u),
open3 AS (SELECT m, p, r FROM p3 WHERE NOT EXISTS (SELECT 1 FROM e WHERE src = p AND dst = r))"""
CORE = ", ".join(
    ["r0 AS (SELECT src, dst FROM e)"]
    + [f"g{i} AS MATERIALIZED (SELECT v FROM (SELECT src AS v FROM r{i - 1} UNION ALL SELECT dst FROM r{i - 1}) GROUP BY v HAVING count(*) >= 6), r{i} AS MATERIALIZED (SELECT src, dst FROM r{i - 1} WHERE src IN (SELECT v FROM g{i}) AND dst IN (SELECT v FROM g{i}))" for i in range(1, 25)]
)

KTS = "kk AS (SELECT a, b, c, d, greatest(p.batch, r.batch, o.batch, x.batch, y.batch, z.batch) AS ts, [p.batch, r.batch, o.batch, x.batch, y.batch, z.batch] AS every FROM k4 JOIN h p ON p.src = a AND p.dst = b JOIN h r ON r.src = a AND r.dst = c JOIN h o ON o.src = a AND o.dst = d JOIN h x ON x.src = b AND x.dst = c JOIN h y ON y.src = b AND y.dst = d JOIN h z ON z.src = c AND z.dst = d)"
STEPS = "(SELECT unnest([CAST(-1 AS BIGINT), 0, 1, 2, 3]) AS k)"
LABEL = "lab AS (SELECT p_partkey AS id, p_size % 3 AS label FROM part WHERE p_size < 50)"


def grown(table: str) -> str:
    """A stream's totals, from table (ts: the batch that completes a match)."""
    return f"SELECT k AS ts, CAST(CASE WHEN k < 0 THEN 0 ELSE (SELECT count(*) FROM {table} WHERE ts = k + 1) END AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed, CAST((SELECT count(*) FROM {table} WHERE ts <= k + 1) AS BIGINT) AS total FROM {STEPS}"


def sets(k: int, few: str) -> str:
    """s1 to sk: the connected sets of a graph f of the edges with few, as sorted lists; m: the edges in each of the last."""
    ctes = [f"f AS (SELECT src, dst FROM e WHERE {few})", "fs AS (SELECT src AS v, dst AS u FROM f UNION ALL SELECT dst, src FROM f)", "s2 AS (SELECT [src, dst] AS x FROM f)"]
    ctes += [f"s{i} AS (SELECT DISTINCT list_sort(list_append(x, u)) AS x FROM (SELECT x, unnest(x) AS v FROM s{i - 1}) JOIN fs USING (v) WHERE NOT list_contains(x, u))" for i in range(3, k + 1)]
    return ", ".join([*ctes, f"m AS (SELECT x, count(*) AS n FROM (SELECT x, unnest(x) AS src FROM s{k}) JOIN f USING (src) WHERE list_contains(x, dst) GROUP BY x)"])


def at_each_step(select: str, *ctes: str) -> str:
    """select by epoch, over e: the graph as of that epoch."""
    inner = ", ".join(ctes)
    return " UNION ALL ".join(f"SELECT CAST({t - 1} AS BIGINT) AS ts, ({select.format(with_=f'WITH e AS (SELECT src, dst FROM h WHERE batch <= {t}), {inner}')}) AS total" for t in range(5))


ORACLE: dict[str, str] = {
    "edges_copurchase_returned": q("SELECT src, dst FROM e", E),
    "edges_customer_chain": q("SELECT src, dst FROM e", CHAIN),
    "degree": q("SELECT v, degree FROM d", E, SYM, DEG),
    "degree_histogram": q(f"SELECT degree, {N} AS n_vertices FROM d GROUP BY degree", E, SYM, DEG),
    "adjacency_size": q(f"SELECT v, {N} AS n, {S.format('u')} AS sum_nb, min(u) AS first_nb FROM s GROUP BY v", E, SYM),
    "forward_edges": q(f"SELECT src AS v, {N} AS n, {S.format('dst')} AS sum_u FROM e GROUP BY src", E),
    "backward_edges": q(f"SELECT dst AS v, {N} AS n, {S.format('src')} AS sum_u FROM e GROUP BY dst", E),
    "in_degree_offsets": q("SELECT v, n, CAST(coalesce(sum(n) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM i", E, f"i AS (SELECT dst AS v, {N} AS n FROM e GROUP BY dst)"),
    "has_edge_probe": q("SELECT src AS a, dst AS b FROM e WHERE dst - src <= 50", E),
    "has_edge_ts_probe": q("SELECT src, dst, batch AS ts FROM h WHERE batch <= 2 AND dst - src <= 50", E, HIST),
    "triangle_count": q(f"SELECT {N} AS found FROM t", E, TRI),
    "triangle_count_chain": q(f"SELECT {N} AS found FROM t", CHAIN, TRI),
    "triangle_list": q("SELECT a, b, c FROM t", E, TRI),
    "triangle_per_vertex": q(f"SELECT v, {N} AS triangles FROM (SELECT a AS v FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY v", E, TRI),
    "triangle_per_edge": q(f"SELECT src, dst, {N} AS triangles FROM (SELECT a AS src, b AS dst FROM t UNION ALL SELECT a, c FROM t UNION ALL SELECT b, c FROM t) GROUP BY src, dst", E, TRI),
    "kclique3_count": q(f"SELECT {N} AS found FROM t", E, TRI),
    "kclique4_count": q(f"SELECT {N} AS found FROM k4", E, TRI, K4),
    "kclique5_count": q(f"SELECT {N} AS found FROM k5", E, TRI, K4, K5),
    "kclique4_list": q("SELECT a AS v0, b AS v1, c AS v2, d AS v3 FROM k4", E, TRI, K4),
    "color_clique3": q(f"SELECT {N} AS found FROM t WHERE a % 3 <> b % 3 AND a % 3 <> c % 3 AND b % 3 <> c % 3", E, TRI),
    "color_clique4": q(f"SELECT {N} AS found FROM k4 WHERE len(list_distinct([a % 4, b % 4, c % 4, d % 4])) = 4", E, TRI, K4),
    "motif3": q(MOTIF3, E, SYM, DEG, TRI),
    "motif4": q(MOTIF4, E, SYM, DEG, TRI, K4, M4),
    "motif3_closed_form": q(MOTIF3, E, SYM, DEG, TRI),
    "motif4_closed_form": q(MOTIF4, E, SYM, DEG, TRI, K4, M4),
    "distinct_patterns": q("SELECT CAST(count(*) AS BIGINT) AS n_patterns FROM m WHERE cnt > 0", E, SYM, DEG, TRI, K4, M4),
    "bfs_level_counts": q(f"SELECT 1 AS level, {N} AS cnt FROM d UNION ALL SELECT 2, {N} FROM e UNION ALL SELECT 3, CAST((SELECT sum(degree * (degree - 1) // 2) FROM d) - 2 * (SELECT count(*) FROM t) AS BIGINT)", E, SYM, DEG, TRI),
    "clique4_from_triangles": q(f"SELECT {N} AS found FROM k4", E, TRI, K4),
    "keyword_dist_2hop": q("SELECT v, w, min(d) AS d FROM (SELECT v, CAST(v & 31 AS INT) AS w, 0 AS d FROM d WHERE v & 31 < 3 UNION ALL SELECT v, CAST(u & 31 AS INT), 1 FROM s WHERE u & 31 < 3 UNION ALL SELECT x.v, CAST(y.u & 31 AS INT), 2 FROM s x JOIN s y ON x.u = y.v WHERE y.u & 31 < 3) GROUP BY v, w", E, SYM, DEG),
    "keyword_cover_k4": q(f"SELECT {NAME3} AS vertices FROM c3 UNION ALL SELECT {NAME4} FROM c4", E, SYM, DEG, KW),
    "keyword_minimal_k4": q(f"SELECT {NAME3} AS vertices FROM c3 UNION ALL SELECT {NAME4} FROM c4 ANTI JOIN c3 USING (a, b, c)", E, SYM, DEG, KW),
    "active_seeds_k4": q("SELECT src, dst FROM e JOIN d x ON x.v = src JOIN d y ON y.v = dst WHERE x.degree >= 3 AND y.degree >= 3", E, SYM, DEG),
    "kcore_prune": q("SELECT src, dst FROM r24", E, CORE),
    "replay_batch_sizes": q(f"SELECT batch, {N} AS n, {S.format('src')} AS sum_src FROM h GROUP BY batch", E, HIST),
    "snapshot_asof": q("SELECT src, dst, batch AS add_ts FROM h WHERE batch <= 2 AND NOT (batch = 0 AND (src + dst) % 2 = 0)", E, HIST),
    "delta_triangles_by_batch": q("SELECT g AS ts, CAST((SELECT count(*) FROM tt WHERE ts = g) AS BIGINT) AS found FROM (SELECT unnest([CAST(1 AS BIGINT), 2, 3, 4]) AS g)", E, TRI, HIST, TTS),
    "delta_clique4_by_batch": q("SELECT g AS ts, CAST((SELECT count(*) FROM kk WHERE ts = g) AS BIGINT) AS found FROM (SELECT unnest([CAST(1 AS BIGINT), 2, 3, 4]) AS g)", E, TRI, K4, HIST,
        "kk AS (SELECT greatest(p.batch, r.batch, o.batch, x.batch, y.batch, z.batch) AS ts FROM k4 JOIN h p ON p.src = a AND p.dst = b JOIN h r ON r.src = a AND r.dst = c JOIN h o ON o.src = a AND o.dst = d JOIN h x ON x.src = b AND x.dst = c JOIN h y ON y.src = b AND y.dst = d JOIN h z ON z.src = c AND z.dst = d)"),
    "delta_motif3_by_batch": q("SELECT n.pattern_id, CAST(n.n - o.n AS BIGINT) AS delta, CAST(g.ts AS BIGINT) AS ts FROM g JOIN cen n ON n.upto = g.ts JOIN cen o ON o.upto = g.ts - 1 AND o.pattern_id = n.pattern_id WHERE n.n <> o.n", E, TRI, HIST, TTS, DELTA3),
    "delete_triangles_by_batch": q("SELECT g AS ts, CAST((SELECT count(*) FROM td WHERE first_gone = g) AS BIGINT) AS found FROM (SELECT unnest([CAST(1 AS BIGINT), 2, 3, 4]) AS g)", E, TRI, HIST,
        "td AS (SELECT least(CASE WHEN x.batch BETWEEN 1 AND 4 THEN x.batch ELSE 99 END, CASE WHEN y.batch BETWEEN 1 AND 4 THEN y.batch ELSE 99 END, CASE WHEN z.batch BETWEEN 1 AND 4 THEN z.batch ELSE 99 END) AS first_gone FROM t JOIN h x ON x.src = a AND x.dst = b JOIN h y ON y.src = a AND y.dst = c JOIN h z ON z.src = b AND z.dst = c)"),
    "clique_changes_mixed": q(f"SELECT status, {N} AS n FROM ch GROUP BY status", E, TRI, HIST,
        "tb AS (SELECT [x.batch, y.batch, z.batch] AS b FROM t JOIN h x ON x.src = a AND x.dst = b JOIN h y ON y.src = a AND y.dst = c JOIN h z ON z.src = b AND z.dst = c)",
        "ch AS (SELECT 'add' AS status FROM tb WHERE list_contains(b, 4) AND NOT list_contains(b, 1) UNION ALL SELECT 'del' FROM tb WHERE list_contains(b, 1) AND NOT list_contains(b, 4))"),
    "neighbours_ts": q(f"SELECT 'all' AS side, v, {N} AS n, {S.format('u')} AS sum_u, {S.format('batch')} AS sum_ts FROM (SELECT src AS v, dst AS u, batch FROM o UNION ALL SELECT dst, src, batch FROM o) GROUP BY v UNION ALL SELECT 'above', src, {N}, {S.format('dst')}, {S.format('batch')} FROM o GROUP BY src UNION ALL SELECT 'below', dst, {N}, {S.format('src')}, {S.format('batch')} FROM o GROUP BY dst", E, HIST, "o AS (SELECT * FROM h WHERE batch <= 2)"),
    "binary_edges_read": q(f"SELECT v, min(pos) AS first, max(pos) AS last, {S.format('u')} AS sum_u FROM (SELECT v, u, row_number() OVER (ORDER BY v, u) - 1 AS pos FROM s) GROUP BY v", E, SYM),
    "binary_offsets_read": q("SELECT i.v, CAST((SELECT count(*) FROM s WHERE s.v < i.v) AS BIGINT) AS off FROM (SELECT CAST(unnest(range(0, (SELECT max(dst) FROM e) + 1)) AS BIGINT) AS v) i UNION ALL SELECT CAST(-1 AS BIGINT), CAST(0 AS BIGINT)", E, SYM),
    "binary_graph_triangles": q(f"SELECT {N} AS found FROM t", E, TRI),
    "text_edges_read": q("SELECT src, dst FROM e", E),
    "metadata_read": q("SELECT CAST(max(dst) + 1 AS BIGINT) AS vertices FROM e", E),
    "shuffled_replay_sizes": q(f"SELECT batch, {N} AS n FROM h GROUP BY batch", E, HIST),
    "motif5_by_edges": q(f"SELECT CAST(n AS INT) AS n_edges, {N} AS cnt FROM m GROUP BY n", E, sets(5, "src % 4 = 0 AND dst % 4 = 0")),
    "motif6_by_edges": q(f"SELECT CAST(n AS INT) AS n_edges, {N} AS cnt FROM m GROUP BY n", E, sets(6, "src % 8 = 0 AND dst % 8 = 0")),
    "induced_by_edges": q(MOTIF4, E, SYM, DEG, TRI, K4, M4),
    "keyword_dist_lines": q("SELECT concat(v, ':', ' ', coalesce(CAST(min(d) FILTER (WHERE w = 0) AS VARCHAR), '-'), ' ', coalesce(CAST(min(d) FILTER (WHERE w = 1) AS VARCHAR), '-'), ' ', coalesce(CAST(min(d) FILTER (WHERE w = 2) AS VARCHAR), '-')) AS line FROM (SELECT v, v & 31 AS w, 0 AS d FROM d WHERE v & 31 < 3 UNION ALL SELECT v, u & 31, 1 FROM s WHERE u & 31 < 3 UNION ALL SELECT x.v, y.u & 31, 2 FROM s x JOIN s y ON x.u = y.v WHERE y.u & 31 < 3) GROUP BY v", E, SYM, DEG),
    "labelled_color_clique3": q(f"SELECT {N} AS found FROM t JOIN lab x ON x.id = a JOIN lab y ON y.id = b JOIN lab z ON z.id = c WHERE x.label <> y.label AND x.label <> z.label AND y.label <> z.label", E, TRI, LABEL),
    "labelled_keyword_k3": q("SELECT array_to_string(x, '-') AS vertices FROM s3 WHERE (SELECT list_sort(list(label)) FROM lab WHERE list_contains(x, id)) = [0, 1, 2]", E, LABEL, sets(3, "src % 4 = 0 AND dst % 4 = 0")),
    "clique_new_edges": q(f"SELECT ts, CAST(n AS INT) AS n_new, {N} AS n FROM (SELECT ts, CAST(x.batch = ts AS INT) + CAST(y.batch = ts AS INT) + CAST(z.batch = ts AS INT) AS n FROM tt JOIN h x ON x.src = a AND x.dst = b JOIN h y ON y.src = a AND y.dst = c JOIN h z ON z.src = b AND z.dst = c WHERE ts >= 1) GROUP BY ts, n", E, TRI, HIST, TTS),
    "stream_color": q(grown("ct"), E, TRI, HIST, TTS, "ct AS (SELECT ts FROM tt WHERE a % 3 <> b % 3 AND a % 3 <> c % 3 AND b % 3 <> c % 3)"),
    "stream_keyword": q(at_each_step("{with_} SELECT CAST((SELECT count(*) FROM c3) + (SELECT count(*) FROM c4) AS BIGINT)", SYM, DEG, KW) + f" UNION ALL SELECT CAST(100 + d AS BIGINT), {N} FROM near2 GROUP BY d", E, HIST, SYM, DEG,
        "near2 AS (SELECT v, w, min(d) AS d FROM (SELECT v, v & 31 AS w, 0 AS d FROM d WHERE v & 31 < 3 UNION ALL SELECT v, u & 31, 1 FROM s WHERE u & 31 < 3 UNION ALL SELECT x.v, y.u & 31, 2 FROM s x JOIN s y ON x.u = y.v WHERE y.u & 31 < 3) GROUP BY v, w)"),
    "stream_kept_triangles": q("SELECT k AS ts, CAST((SELECT count(*) FROM h WHERE batch = k + 1) AS BIGINT) AS edges_added, CAST((SELECT count(*) FROM kk WHERE ts = k + 1) AS BIGINT) AS changes, CAST((SELECT count(*) FROM kk WHERE ts = k + 1 AND len(list_filter(every, lambda b: b = ts)) = 1) AS BIGINT) AS cache_hits FROM (SELECT unnest([CAST(0 AS BIGINT), 1, 2, 3]) AS k)", E, TRI, K4, HIST, KTS),
    "stream_pfilter": q(at_each_step("{with_} SELECT CAST((SELECT count(*) FROM t WHERE c - a <= 300 AND a % 2 = 1) + (SELECT count(*) FROM open3 WHERE greatest(m, p, r) - least(m, p, r) <= 300 AND least(m, p, r) % 2 = 1) AS BIGINT)", SYM, TRI, INDUCED3), E, HIST),
    "stream_symmetric": q(f"SELECT k AS ts, CAST((SELECT count(*) FROM kk WHERE ts <= k + 1 AND d - a <= 1000 AND (a + b + c + d) % 2 = 0) AS BIGINT) AS total FROM {STEPS}", E, TRI, K4, HIST, KTS),
    "stream_vertex_del": q("SELECT CAST(-1 AS BIGINT) AS ts, CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed, n0 AS total FROM n UNION ALL SELECT 0, 0, n0 - n1, n1 FROM n UNION ALL SELECT 1, 0, n1 - n2, n2 FROM n", E, TRI,
        "n AS (SELECT CAST(count(*) AS BIGINT) AS n0, CAST(count(*) FILTER (WHERE a % 10 <> 0 AND b % 10 <> 0 AND c % 10 <> 0) AS BIGINT) AS n1, CAST(count(*) FILTER (WHERE a % 10 <> 0 AND b % 10 <> 0 AND c % 10 <> 0 AND a % 7 <> 0 AND b % 7 <> 0 AND c % 7 <> 0) AS BIGINT) AS n2 FROM t)"),
    "stream_relabel": q(f"SELECT CAST(-1 AS BIGINT) AS ts, CAST(0 AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed, CAST(0 AS BIGINT) AS total UNION ALL SELECT 0, {N}, CAST(0 AS BIGINT), {N} FROM r WHERE was UNION ALL SELECT 1, CAST(count(*) FILTER (WHERE now AND NOT was) AS BIGINT), CAST(count(*) FILTER (WHERE was AND NOT now) AS BIGINT), CAST(count(*) FILTER (WHERE now) AS BIGINT) FROM r", E, TRI, LABEL,
        "r AS (SELECT len(list_distinct([x.label, y.label, z.label])) = 3 AS was, len(list_distinct([(x.label + CAST(a % 5 = 0 AS INT)) % 3, (y.label + CAST(b % 5 = 0 AS INT)) % 3, (z.label + CAST(c % 5 = 0 AS INT)) % 3])) = 3 AS now FROM t JOIN lab x ON x.id = a JOIN lab y ON y.id = b JOIN lab z ON z.id = c)"),
    "embedding_functions": q("SELECT '[' || a || ' ' || b || ' ' || c || '] ' || a || '-' || b || x || ', ' || a || '-' || c || y || ', ' || b || '-' || c || z AS line, CAST((x = ' old')::INT + (y = ' old')::INT AS INT) AS old0, CAST((x = ' old')::INT + (z = ' old')::INT AS INT) AS old1, CAST((y = ' old')::INT + (z = ' old')::INT AS INT) AS old2, z = ' new' AS bc_new, 2 AS n_left, 1 AS left_mask, CASE WHEN y = ' new' THEN 3 ELSE 1 END AS connected FROM ne", E, TRI, HIST, TTS,
        "ne AS (SELECT a, b, c, CASE WHEN x.batch = 4 THEN ' new' ELSE ' old' END AS x, CASE WHEN y.batch = 4 THEN ' new' ELSE ' old' END AS y, CASE WHEN z.batch = 4 THEN ' new' ELSE ' old' END AS z FROM tt JOIN h x ON x.src = a AND x.dst = b JOIN h y ON y.src = a AND y.dst = c JOIN h z ON z.src = b AND z.dst = c WHERE ts = 4)"),
    "miner_static": q(f"SELECT 0 AS algorithm, 0 AS pattern_id, {N} AS cnt FROM t UNION ALL SELECT 1, pattern_id, cnt FROM m3 UNION ALL SELECT 2, 0, {N} FROM t WHERE a % 3 <> b % 3 AND a % 3 <> c % 3 AND b % 3 <> c % 3 UNION ALL SELECT 3, 0, {N} FROM c3", E, SYM, DEG, TRI, KW, f"m3 AS ({MOTIF3})"),
    "miner_stream": q(f"SELECT epoch, status, {N} AS n, seen_by FROM (SELECT CAST(ts - 1 AS BIGINT) AS epoch, 'add' AS status FROM kk WHERE ts BETWEEN 1 AND 3 UNION ALL SELECT CAST(3 AS BIGINT), 'del' FROM kk WHERE ts <= 3 AND list_contains(every, 1)), (SELECT unnest(['callback', 'table']) AS seen_by) GROUP BY ALL", E, TRI, K4, HIST, KTS),
    "running_total": q("SELECT ts, found, CAST(sum(found) OVER (ORDER BY ts) AS BIGINT) AS total FROM p", E, TRI, HIST, TTS, f"p AS (SELECT ts, {N} AS found FROM tt GROUP BY ts)"),
    "stream_replay_triangles": q("SELECT k AS ts, CAST(CASE WHEN k < 0 THEN 0 ELSE (SELECT count(*) FROM tt WHERE ts = k + 1) END AS BIGINT) AS added, CAST(0 AS BIGINT) AS removed, CAST((SELECT count(*) FROM tt WHERE ts <= k + 1) AS BIGINT) AS total FROM (SELECT unnest([CAST(-1 AS BIGINT), 0, 1, 2, 3]) AS k)", E, TRI, HIST, TTS),
    "custom_pattern": q("SELECT list_sort([m, p, r])[1] AS a, list_sort([m, p, r])[2] AS b, list_sort([m, p, r])[3] AS c FROM open3 WHERE m % 2 = 1 AND p % 2 = 0 AND r % 2 = 0", E, SYM, INDUCED3),
    "custom_symmetric": q(f"SELECT {N} AS found FROM k4 WHERE d - a <= 1000", E, TRI, K4),
    # a mask's bits are (0,1), (0,2), (1,2): v0 is the least vertex, v1 the least neighbour that the canonical order starts from
    "embedding_masks": q(f"SELECT CAST(mask AS INT) AS mask, CAST(bit_count(CAST(mask AS INT)) AS INT) AS n_edges, CASE mask WHEN 5 THEN 1 ELSE 2 END AS d0, {N} AS cnt FROM em GROUP BY mask", E, SYM, TRI, INDUCED3,
        "em AS (SELECT 7 AS mask FROM t UNION ALL SELECT CASE WHEN m < p THEN 3 ELSE 5 END FROM open3)"),
}
