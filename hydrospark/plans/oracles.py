"""DuckDB SQL for the registered hydrology queries, built from shared parts."""

from __future__ import annotations

GRID = """
cells AS (SELECT CAST(o_orderkey % 100 AS INT) AS x, CAST(o_orderkey // 100 AS INT) AS y,
  (o_orderkey % 100) * 1.0 + (o_orderkey // 100) * 2.0 + o_totalprice / 100000.0 AS z FROM orders),
size AS (SELECT 100 AS w, CAST(max(o_orderkey) // 100 + 1 AS INT) AS h FROM orders),
off AS (SELECT * FROM (VALUES (1, 1, 0), (2, 1, -1), (3, 0, -1), (4, -1, -1), (5, -1, 0), (6, -1, 1), (7, 0, 1), (8, 1, 1)) AS t(dir, dx, dy)),
near AS (SELECT c.x, c.y, o.dir, n.x AS nx, n.y AS ny, n.z AS nz, (c.z - n.z) / CASE WHEN o.dir % 2 = 0 THEN sqrt(2.0) ELSE 1.0 END AS slope
  FROM cells c, off o JOIN cells n ON n.x = c.x + o.dx AND n.y = c.y + o.dy),
d8 AS (SELECT x, y, dir, slope, nx, ny FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY slope DESC, dir) AS r FROM near WHERE slope > 0) WHERE r = 1),
flow AS (SELECT c.y * 100 + c.x AS cell, d.ny * 100 + d.nx AS nxt, c.x, c.y, c.z, d.dir FROM cells c LEFT JOIN d8 d USING (x, y)),
dir128 AS (SELECT x, y, CASE WHEN x = 0 OR y = 0 THEN 0 WHEN dir IS NULL THEN 255
  ELSE [1, 128, 64, 32, 16, 8, 4, 2][dir] END AS dir128 FROM flow)"""
PATH = """
path(cell, ends) AS (SELECT cell, cell FROM flow UNION ALL SELECT p.cell, f.nxt FROM path p JOIN flow f ON p.ends = f.cell WHERE f.nxt IS NOT NULL),
acc AS (SELECT ends AS cell, count(*) AS acc FROM path GROUP BY ends)"""
LAKES = """
rect AS (SELECT k, w, h, (k * 37) % 90 + 2 AS x0, (k * 53) % ((SELECT h FROM size) - 10) + 2 AS y0, w * h AS area
  FROM (SELECT p_partkey // 40 AS k, 2 + p_size % 6 AS w, 2 + (p_size // 6) % 5 AS h FROM part WHERE p_partkey % 40 = 0)),
water AS (SELECT DISTINCT y * 100 + x AS cell, x, y FROM
  (SELECT x, unnest(range(y0, y0 + h)) AS y FROM (SELECT unnest(range(x0, x0 + w)) AS x, y0, h FROM rect)))"""
LABELS = """
touch AS (SELECT a.cell AS a, b.cell AS b FROM water a, off o JOIN water b ON b.x = a.x + o.dx AND b.y = a.y + o.dy),
reach(cell, other) AS (SELECT cell, cell FROM water UNION SELECT r.cell, t.b FROM reach r JOIN touch t ON r.other = t.a),
lake AS (SELECT w.cell, w.x, w.y, min(r.other) AS lake FROM water w JOIN reach r USING (cell) GROUP BY ALL)"""
BUFFER = """
buf AS (SELECT DISTINCT l.lake, l.x + o.dx AS x, l.y + o.dy AS y, (l.y + o.dy) * 100 + l.x + o.dx AS cell
  FROM lake l, off o, size s WHERE l.x + o.dx BETWEEN 0 AND 99 AND l.y + o.dy BETWEEN 0 AND s.h - 1
    AND (l.x + o.dx, l.y + o.dy) NOT IN (SELECT (x, y) FROM water))"""
DRY = """
dry AS (SELECT f.cell, CASE WHEN f.nxt IN (SELECT cell FROM water) THEN NULL ELSE f.nxt END AS nxt, f.nxt IN (SELECT cell FROM water) AS wet
  FROM flow f WHERE f.cell NOT IN (SELECT cell FROM water)),
walk(cell, ends) AS (SELECT cell, cell FROM dry UNION ALL SELECT p.cell, f.nxt FROM walk p JOIN dry f ON p.ends = f.cell WHERE f.nxt IS NOT NULL),
gate AS (SELECT b.lake, b.cell FROM buf b JOIN acc a USING (cell) JOIN dry d USING (cell) WHERE a.acc < {th} AND d.wet),
inflow AS (SELECT DISTINCT b.lake, b.cell, b.x, b.y FROM buf b JOIN walk p ON p.cell = b.cell JOIN gate g ON g.lake = b.lake AND g.cell = p.ends)"""
GROUPS = """
pair AS (SELECT a.lake, a.cell AS a, b.cell AS b FROM inflow a, off o JOIN inflow b ON b.x = a.x + o.dx AND b.y = a.y + o.dy
  WHERE a.lake = b.lake AND (o.dir % 2 = 1 OR NOT EXISTS (SELECT 1 FROM acc r WHERE r.acc >= {th} AND r.cell IN (a.y * 100 + b.x, b.y * 100 + a.x)))),
same(lake, cell, other) AS (SELECT lake, cell, cell FROM inflow UNION SELECT s.lake, s.cell, p.b FROM same s JOIN pair p ON p.lake = s.lake AND p.a = s.other),
grp AS (SELECT lake, cell, min(other) AS grp FROM same GROUP BY ALL),
ord AS (SELECT lake, max_acc, start, row_number() OVER (ORDER BY max_acc, lake) AS ord FROM (
  SELECT lake, max(acc) AS max_acc, arg_max(cell, acc * 1000000000 - cell) AS start FROM buf JOIN acc USING (cell) GROUP BY lake))"""
TH = 20
RIVER = f"river AS (SELECT f.cell, f.nxt, a.acc FROM flow f JOIN acc a USING (cell) WHERE a.acc >= {TH})"
REACH = """
fork AS (SELECT nxt, count(*) AS n FROM river WHERE nxt IS NOT NULL GROUP BY nxt),
link AS (SELECT r.cell, CASE WHEN f.n < 2 THEN r.nxt END AS nxt FROM river r LEFT JOIN fork f ON f.nxt = r.nxt),
chain(cell, ends) AS (SELECT cell, cell FROM link UNION ALL SELECT c.cell, l.nxt FROM chain c JOIN link l ON c.ends = l.cell WHERE l.nxt IS NOT NULL),
segment AS (SELECT c.cell, c.ends AS reach FROM chain c JOIN link l ON c.ends = l.cell WHERE l.nxt IS NULL)"""


def sql(*parts: str, select: str, **values) -> str:
    for key, value in values.items():
        parts = tuple(p.replace("{" + key + "}", str(value)) for p in parts)
        select = select.replace("{" + key + "}", str(value))
    return "WITH RECURSIVE " + ",".join(parts) + "\n" + select


SQL = {
    "f5_d8_direction": sql(GRID, select="SELECT x, y, dir, round(slope, 8) AS slope FROM d8"),
    "g2_flow_accumulation": sql(GRID, PATH, select="SELECT cell, acc FROM acc"),
    "c8_stream_threshold": sql(GRID, PATH, select=f"SELECT cell % 100 AS x, cell // 100 AS y, CASE WHEN acc >= {TH} THEN 1 ELSE 0 END AS s FROM acc"),
    "a14_river_record": sql(GRID, PATH, select=f"SELECT cell % 100 AS x, cell // 100 AS y, acc FROM acc WHERE acc >= {TH}"),
    "c1_reclass_128_to_8": sql(GRID, select="SELECT x, y, coalesce(list_position([1, 128, 64, 32, 16, 8, 4, 2], dir128), dir128) AS dir FROM dir128"),
    "c2_direction_reclass": sql(GRID, select="SELECT x, y, coalesce(list_position([1, 128, 64, 32, 16, 8, 4, 2], dir128), 0) AS dir, dir128 = 255 AS is_final FROM dir128"),
    "c3_reclass_range_table": sql(GRID, select="SELECT x, y, CASE WHEN z BETWEEN 0 AND 50 THEN 1.0 WHEN z BETWEEN 50 AND 120 THEN 2.0 WHEN z BETWEEN 100 AND 200 THEN 3.0 ELSE round(z, 8) END AS v FROM cells"),
    "c4_normalise_128": sql(GRID, select="SELECT x, y, CASE WHEN dir128 IN (247, -9, 255) THEN 0 ELSE dir128 END AS dir128 FROM dir128"),
    "c6_erase_mask": sql(GRID, LAKES, select="SELECT x, y, round(z, 8) AS z FROM cells WHERE (x, y) NOT IN (SELECT (x, y) FROM water)"),
    "c7_erase_layers": sql(GRID, PATH, LAKES, select=f"SELECT f.x, f.y, round(z, 8) AS z, coalesce(dir, 0) AS dir, acc, CASE WHEN acc >= {TH} THEN 1 ELSE 0 END AS s FROM flow f JOIN acc USING (cell) WHERE cell NOT IN (SELECT cell FROM water)"),
    "c9_recode_value": sql(GRID, LAKES, select="SELECT x, y, -9 AS v FROM water"),
    "f1_boundary_cells": sql(GRID, LAKES, select="""SELECT x, y FROM cells c WHERE (x, y) NOT IN (SELECT (x, y) FROM water) AND
        (SELECT count(*) FROM off o JOIN cells n ON n.x = c.x + o.dx AND n.y = c.y + o.dy WHERE (n.x, n.y) NOT IN (SELECT (x, y) FROM water)) < 8"""),
    "f2_headwater_cells": sql(GRID.replace("flow AS (", "flow AS MATERIALIZED ("), select="SELECT f.x, f.y FROM flow f ANTI JOIN (SELECT DISTINCT nxt FROM flow WHERE nxt IS NOT NULL) n ON n.nxt = f.cell"),
    "f3_coastal_trace_starts": sql(GRID, select="""
        SELECT d.x, d.y, 'seaside' AS kind, d.x + o.dx AS to_x, d.y + o.dy AS to_y FROM dir128 d JOIN off o ON o.dir = list_position([1, 128, 64, 32, 16, 8, 4, 2], d.dir128)
          JOIN dir128 t ON t.x = d.x + o.dx AND t.y = d.y + o.dy WHERE t.dir128 = 0
        UNION ALL SELECT x, y, 'final', x, y FROM dir128 WHERE dir128 = 255"""),
    "f6_lake_buffer": sql(GRID, LAKES, LABELS, BUFFER, select="SELECT lake, x, y FROM buf"),
    "g1_lake_components": sql(GRID, LAKES, LABELS, select="SELECT x, y, lake FROM lake"),
    "g9_lake_order": sql(GRID, PATH, LAKES, LABELS, BUFFER, "ord AS (SELECT lake, max(acc) AS max_acc, arg_max(cell, acc * 1000000000 - cell) AS start FROM buf JOIN acc USING (cell) GROUP BY lake)",
                         select="SELECT lake, max_acc, start, row_number() OVER (ORDER BY max_acc, lake) AS ord FROM ord"),
    "g10_slope_inflows": sql(GRID, PATH, LAKES, LABELS, BUFFER, DRY, select="SELECT lake, cell FROM inflow", th=TH),
    "g11_inflow_groups": sql(GRID, PATH, LAKES, LABELS, BUFFER, DRY, GROUPS, select="SELECT lake, cell, grp FROM grp", th=TH),
    "g12_slope_surface_group": sql(GRID, PATH, LAKES, LABELS, BUFFER, DRY, GROUPS, select="""
        SELECT p.cell, max(i.id) AS slope_id FROM walk p JOIN (SELECT g.cell, dense_rank() OVER (ORDER BY o.ord, g.grp) AS id FROM grp g JOIN ord o USING (lake)) i ON i.cell = p.ends GROUP BY p.cell""", th=TH),
    "g12_slope_surface_lake": sql(GRID, PATH, LAKES, LABELS, BUFFER, DRY, GROUPS, select="""
        SELECT p.cell, max(i.id) AS slope_id FROM walk p JOIN (SELECT g.cell, dense_rank() OVER (ORDER BY o.ord) AS id FROM grp g JOIN ord o USING (lake)) i ON i.cell = p.ends GROUP BY p.cell""", th=TH),
    "g13_slope_route": sql(GRID, PATH, LAKES, LABELS, BUFFER, DRY, GROUPS, "slow AS (SELECT d.cell, d.nxt FROM dry d JOIN acc USING (cell) WHERE acc < {th})",
                           "go(cell) AS (SELECT cell FROM slow WHERE cell IN (SELECT start FROM ord) UNION SELECT s2.cell FROM go JOIN slow s ON s.cell = go.cell JOIN slow s2 ON s2.cell = s.nxt)", select="SELECT cell FROM go", th=TH),
    "g6_sink_basins": sql(GRID, PATH, select="SELECT p.cell, p.ends AS label FROM path p JOIN flow f ON f.cell = p.ends WHERE f.nxt IS NULL"),
    "g6_indexed_upstream": sql(GRID, PATH, RIVER, REACH, select="SELECT ends AS outlet, cell FROM path WHERE ends IN (SELECT reach FROM segment)"),
    "g6_indexed_basins": sql(GRID, PATH, RIVER, REACH, "ended AS (SELECT cell, CASE WHEN cell NOT IN (SELECT reach FROM segment) THEN nxt END AS nxt FROM flow)",
                             "fall(cell, ends) AS (SELECT cell, cell FROM ended UNION ALL SELECT p.cell, f.nxt FROM fall p JOIN ended f ON p.ends = f.cell WHERE f.nxt IS NOT NULL)",
                             select="SELECT cell, ends AS label FROM fall WHERE ends IN (SELECT reach FROM segment)"),
    "g7_reaches": sql(GRID, PATH, RIVER, REACH, select="SELECT cell, reach FROM segment"),
    "g7_reach_tree": sql(GRID, PATH, RIVER, REACH, "down AS (SELECT r.cell AS reach, s.reach AS down_reach FROM river r JOIN (SELECT DISTINCT reach FROM segment) t ON t.reach = r.cell LEFT JOIN segment s ON s.cell = r.nxt)",
                         select="SELECT s.reach, count(*) AS n_cells, any_value(d.down_reach) AS down_reach, (SELECT count(*) FROM down u WHERE u.down_reach = s.reach) AS n_up FROM segment s JOIN down d USING (reach) GROUP BY s.reach"),
    "g7_watersheds": sql(GRID, PATH, RIVER, REACH, "slope AS (SELECT cell, CASE WHEN cell NOT IN (SELECT cell FROM river) THEN nxt END AS nxt FROM flow)",
                         "fall(cell, ends) AS (SELECT cell, cell FROM slope UNION ALL SELECT p.cell, f.nxt FROM fall p JOIN slope f ON p.ends = f.cell WHERE f.nxt IS NOT NULL)",
                         select="SELECT p.cell, s.reach AS watershed FROM fall p JOIN segment s ON s.cell = p.ends"),
    "g4_upstream_lengths": sql(GRID, "leg AS (SELECT cell, nxt, CASE WHEN dir IS NULL THEN 0 WHEN dir % 2 = 1 THEN 1.0 ELSE sqrt(2.0) END AS len FROM flow)",
                               "trip(cell, ends, dist) AS (SELECT cell, cell, CAST(0 AS DOUBLE) FROM leg UNION ALL SELECT t.cell, l.nxt, t.dist + l.len FROM trip t JOIN leg l ON t.ends = l.cell WHERE l.nxt IS NOT NULL)",
                               select="SELECT ends AS cell, round(max(dist), 6) AS longest, round(sum(CASE WHEN t.cell = t.ends THEN 0 ELSE l.len END), 6) AS total FROM trip t JOIN leg l ON l.cell = t.cell GROUP BY ends"),
}
SQL["f4_terminal_min_neighbour"] = sql(
    GRID, PATH, "fin AS (SELECT x, y FROM dir128 WHERE dir128 = 255)",
    """cand AS (SELECT f.x, f.y, -1 AS ord, 1 AS dir, acc FROM fin f JOIN acc ON acc.cell = f.y * 100 + f.x
        UNION ALL SELECT f.x, f.y, list_position([4, 3, 2, 5, 1, 6, 7, 8], o.dir) - 1, o.dir, acc FROM fin f, off o JOIN acc ON acc.cell = (f.y + o.dy) * 100 + f.x + o.dx
          WHERE f.x + o.dx BETWEEN 0 AND 99)""",
    select=f"SELECT x, y, dir, acc AS min_acc FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY acc, ord) AS r FROM cand) WHERE r = 1 AND acc < {TH}",
)

STEP128 = "[1, 128, 64, 32, 16, 8, 4, 2]"
START = f"""
starts AS (SELECT d.x, d.y, 'seaside' AS kind FROM dir128 d JOIN off o ON o.dir = list_position({STEP128}, d.dir128)
    JOIN dir128 t ON t.x = d.x + o.dx AND t.y = d.y + o.dy WHERE t.dir128 = 0
  UNION ALL SELECT x, y, 'final' FROM dir128 WHERE dir128 = 255)"""
DOCS = """
docs AS (SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS name, k,
  '{"type":"Feature","properties":{"DN":' || (k % 7) || ',"kind":"lake"},"geometry":{"type":"Polygon","coordinates":[[[' || x0 || ',' || y0 || '],[' || (x0 + w) || ',' || y0 || '],['
  || (x0 + w) || ',' || (y0 + h) || '],[' || x0 || ',' || (y0 + h) || '],[' || x0 || ',' || y0 || ']]]}}' AS doc FROM rect)"""
RING = """
line AS (
  SELECT k, i AS pos, x0 + i AS x, y0 AS y, w, h, x0, y0 FROM (SELECT *, unnest(range(0, w)) AS i FROM rect)
  UNION ALL SELECT k, w + i, x0 + w, y0 + i, w, h, x0, y0 FROM (SELECT *, unnest(range(0, h)) AS i FROM rect)
  UNION ALL SELECT k, w + h + i, x0 + w - i, y0 + h, w, h, x0, y0 FROM (SELECT *, unnest(range(0, w)) AS i FROM rect)
  UNION ALL SELECT k, 2 * w + h + i, x0, y0 + h - i, w, h, x0, y0 FROM (SELECT *, unnest(range(0, h)) AS i FROM rect))"""
INNER = """
inner_cells AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY pos) - 1 AS INT) AS pos, x, y FROM (
  SELECT k, pos, x, y FROM line WHERE pos BETWEEN 1 AND w - 1
  UNION ALL SELECT k, pos, x - 1, y FROM line WHERE pos BETWEEN w + 1 AND w + h - 1
  UNION ALL SELECT k, pos, x - 1, y - 1 FROM line WHERE pos BETWEEN w + h + 1 AND 2 * w + h - 1
  UNION ALL SELECT k, pos, x, y - 1 FROM line WHERE pos > 2 * w + h))"""
TRIANGLE = """
tri AS (SELECT 15.25 AS ax, h / 8 AS ay, 57.75 AS bx, h / 5 AS b_y, 22.25 AS cx, h * 3 / 5 AS c_y FROM (SELECT CAST(h AS DOUBLE) AS h FROM size)),
box AS (SELECT f.cell, f.x, f.y, f.z, f.dir, t.* FROM flow f, tri t WHERE f.x BETWEEN 15 AND 57 AND f.y BETWEEN floor(t.ay) AND ceil(t.c_y) - 1),
wide AS (SELECT b.*, a.acc, CASE WHEN w.cell IS NOT NULL THEN -99 END AS lakes FROM box b JOIN acc a USING (cell) LEFT JOIN water w USING (cell))"""
WIDE = "SELECT x, y, round(z, 8) AS dem, dir AS direction, acc AS accumulation, CAST(lakes AS INT) AS lakes FROM wide"
#: The cell's centre is on the same side of all three edges.
INSIDE = " AND ".join(
    f"({x2} - {x1}) * (y + 0.5 - {y1}) - ({y2} - {y1}) * (x + 0.5 - {x1}) > 0" for x1, y1, x2, y2 in (("ax", "ay", "bx", "b_y"), ("bx", "b_y", "cx", "c_y"), ("cx", "c_y", "ax", "ay"))
)
PIXELS = """
px AS (SELECT v, CAST(ceil((lon + 180.0) / 360.0 * {n} - 0.5) AS INT) AS a, CAST(ceil((lon + CAST(0.05 AS DOUBLE) + 180.0) / 360.0 * {n} - 0.5) AS INT) AS b,
  CAST(ceil((1 - ln(tan(radians(up)) + 1 / cos(radians(up))) / pi()) / 2 * {n} - 0.5) AS INT) AS c,
  CAST(ceil((1 - ln(tan(radians(lo)) + 1 / cos(radians(lo))) / pi()) / 2 * {n} - 0.5) AS INT) AS d
  FROM (SELECT v, lon, greatest(-85.05112878, least(85.05112878, lat)) AS up, greatest(-85.05112878, least(85.05112878, lat - CAST(0.05 AS DOUBLE))) AS lo FROM deg)),
pixel AS (SELECT x, unnest(range(c, d)) AS y, v FROM (SELECT unnest(range(a, b)) AS x, c, d, v FROM px WHERE a < b AND c < d))"""
AREAS = """
ranked AS (SELECT CAST(c_custkey AS VARCHAR) AS basin_id, abs(c_acctbal) AS area,
  row_number() OVER (ORDER BY abs(c_acctbal) DESC, CAST(c_custkey AS VARCHAR) DESC) AS rank FROM customer)"""
OUTLETS = "outlets AS (SELECT s_suppkey AS pos, s_acctbal AS acc FROM supplier)"
PFAF = f"""
sink AS (SELECT p.cell, p.ends AS basin FROM path p JOIN flow f ON f.cell = p.ends WHERE f.nxt IS NULL),
bc AS (SELECT s.basin, f.cell, f.nxt, a.acc FROM flow f JOIN sink s USING (cell) JOIN acc a USING (cell)),
bcr AS (SELECT * FROM bc WHERE acc >= {TH}),
main AS (SELECT nxt, cell FROM (SELECT *, row_number() OVER (PARTITION BY nxt ORDER BY acc DESC, cell) AS r FROM bcr WHERE nxt IS NOT NULL) WHERE r = 1),
stem(basin, cell) AS (SELECT basin, cell FROM bcr WHERE nxt IS NULL UNION ALL SELECT s.basin, m.cell FROM stem s JOIN main m ON m.nxt = s.cell),
trib AS (SELECT b.basin, b.cell, b.acc, j.acc AS stem_acc FROM bcr b JOIN stem s ON s.cell = b.nxt JOIN bc j ON j.cell = b.nxt WHERE b.cell NOT IN (SELECT cell FROM main)),
four AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY stem_acc DESC, cell) AS k FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY acc DESC, cell) AS r FROM trib) WHERE r <= 4),
stops AS (SELECT cell, 2 * k AS label FROM four
  UNION ALL SELECT s.cell, 1 + 2 * (SELECT count(*) FROM four t WHERE t.basin = s.basin AND t.stem_acc > b.acc) FROM stem s JOIN bc b USING (cell) WHERE s.basin IN (SELECT basin FROM four)),
run(cell, ends) AS (SELECT cell, cell FROM bc UNION ALL SELECT r.cell, b.nxt FROM run r JOIN bc b ON b.cell = r.ends WHERE b.nxt IS NOT NULL AND b.cell NOT IN (SELECT cell FROM stops)),
digits AS (SELECT b.basin, r.cell, CAST(s.label AS BIGINT) AS digit FROM run r JOIN stops s ON s.cell = r.ends JOIN bc b ON b.cell = r.cell)"""

#: Levels of division in ``h5_divide_levels``, and one of them: codes of level {i} to those of level {j}.
LEVELS = 4
LEVEL = f"""
cut{{i}} AS (SELECT c.pfaf AS basin, c.cell, CASE WHEN n.pfaf = c.pfaf THEN f.nxt END AS nxt, a.acc FROM pf{{i}} c JOIN flow f USING (cell) JOIN acc a USING (cell) LEFT JOIN pf{{i}} n ON n.cell = f.nxt),
rank{{i}} AS (SELECT basin, row_number() OVER (ORDER BY n DESC, basin DESC) AS r, count(*) OVER () AS c FROM (SELECT basin, count(*) AS n FROM cut{{i}} GROUP BY basin)),
bc{{i}} AS (SELECT b.* FROM cut{{i}} b JOIN rank{{i}} USING (basin) WHERE r <= CASE WHEN c // 4 + 1 < c THEN c // 4 + 1 ELSE 1 END),
bcr{{i}} AS (SELECT * FROM bc{{i}} WHERE acc >= {TH}),
main{{i}} AS (SELECT nxt, cell FROM (SELECT *, row_number() OVER (PARTITION BY nxt ORDER BY acc DESC, cell) AS r FROM bcr{{i}} WHERE nxt IS NOT NULL) WHERE r = 1),
stem{{i}}(basin, cell) AS (SELECT basin, cell FROM bcr{{i}} WHERE nxt IS NULL UNION ALL SELECT s.basin, m.cell FROM stem{{i}} s JOIN main{{i}} m ON m.nxt = s.cell),
trib{{i}} AS (SELECT b.basin, b.cell, b.acc, j.acc AS stem_acc FROM bcr{{i}} b JOIN stem{{i}} s ON s.cell = b.nxt JOIN bc{{i}} j ON j.cell = b.nxt WHERE b.cell NOT IN (SELECT cell FROM main{{i}})),
four{{i}} AS (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY stem_acc DESC, cell) AS k FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY acc DESC, cell) AS r FROM trib{{i}}) WHERE r <= 4),
stops{{i}} AS (SELECT cell, 2 * k AS label FROM four{{i}}
  UNION ALL SELECT s.cell, 1 + 2 * (SELECT count(*) FROM four{{i}} t WHERE t.basin = s.basin AND t.stem_acc > b.acc) FROM stem{{i}} s JOIN bc{{i}} b USING (cell) WHERE s.basin IN (SELECT basin FROM four{{i}})),
run{{i}}(cell, ends) AS (SELECT cell, cell FROM bc{{i}} UNION ALL SELECT r.cell, b.nxt FROM run{{i}} r JOIN bc{{i}} b ON b.cell = r.ends WHERE b.nxt IS NOT NULL AND b.cell NOT IN (SELECT cell FROM stops{{i}})),
pf{{j}} AS (SELECT c.cell, c.pfaf || coalesce(d.label, 1) AS pfaf FROM pf{{i}} c LEFT JOIN (SELECT r.cell, s.label FROM run{{i}} r JOIN stops{{i}} s ON s.cell = r.ends) d USING (cell))"""

SQL |= {
    "a1_signed_cells": sql(GRID, select="SELECT x, y, CASE WHEN dir128 > 127 THEN dir128 - 256 ELSE dir128 END AS v FROM dir128"),
    "a2_unsigned_cells": sql(GRID, select="SELECT x, y, dir128 AS v FROM dir128"),
    "a4_overlay": sql(GRID, LAKES, select="SELECT x, y, CASE WHEN (x, y) IN (SELECT (x, y) FROM water) THEN -99.0 ELSE round(z, 8) END AS z FROM cells"),
    "a6_tile_query": sql(GRID, PATH, LAKES, TRIANGLE, select=WIDE),
    "a7_tile_query_masked": sql(GRID, PATH, LAKES, TRIANGLE, select=f"{WIDE} WHERE {INSIDE}"),
    "a8_layer_extent": sql(GRID, select="SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, count(DISTINCT (x // 32, y // 32)) AS n_tiles, count(*) AS n_cells FROM cells"),
    "a9_pyramid": sql(GRID, PATH, select="SELECT level, CAST(cell % 100 AS INT) >> level AS x, CAST(cell // 100 AS INT) >> level AS y, max(acc) AS v FROM acc, (SELECT unnest(range(0, 6)) AS level) GROUP BY ALL"),
    "a11_mosaic_last_wins": """SELECT l_orderkey AS cell, l_quantity AS v FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1""",
    "a15_trace_from_record": sql(GRID, START, select="SELECT DISTINCT CASE WHEN kind = 'seaside' THEN x - 1 ELSE x END AS x, y, 1 AS v FROM starts WHERE kind = 'final' OR x > 0"),
    "a16_publish_layers": sql(GRID, PATH, select=f"SELECT cell % 100 AS x, cell // 100 AS y, 1 AS s FROM acc WHERE acc >= {TH}"),
    "b1_in_grid": sql(GRID, select="SELECT x, y, x - 1 BETWEEN 0 AND 99 AND y + 1 BETWEEN 0 AND (SELECT h FROM size) - 1 AS inside FROM cells"),
    "b2_downstream": sql(GRID, select="SELECT x, y, nx AS to_x, ny AS to_y FROM d8"),
    "b3_downstream_128": sql(GRID, select=f"SELECT d.x, d.y, d.x + o.dx AS to_x, d.y + o.dy AS to_y FROM dir128 d LEFT JOIN off o ON o.dir = list_position({STEP128}, d.dir128)"),
    "b4_neighbours": sql(GRID, select="SELECT x, y, list_position([4, 3, 2, 5, 1, 6, 7, 8], dir) - 1 AS ord, nx, ny FROM near"),
    "b5_neighbour_coordinates": sql(GRID, select="SELECT x, y, list_position([4, 3, 2, 5, 1, 6, 7, 8], dir) - 1 AS ord, (x + dx) * CAST(0.5 AS DOUBLE) AS nx, (y + dy) * CAST(-0.5 AS DOUBLE) + CAST(0 AS DOUBLE) AS ny FROM cells, off"),
    "b6_off_to_coord": sql(GRID, select="SELECT x, y, x * CAST(0.5 AS DOUBLE) - 1 AS cx, 50 - y * CAST(0.5 AS DOUBLE) AS cy FROM cells"),
    "b7_coord_to_off": sql(
        GRID,
        "p AS (SELECT x, y, ((x * CAST(0.3 AS DOUBLE) - 3) - -1) / CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS a, ((50 - y * CAST(0.3 AS DOUBLE)) - 50) / CAST(-0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS b FROM cells)",
        select="SELECT x, y, CAST(floor(a) AS INT) AS ox, CAST(floor(b) AS INT) AS oy, CAST(trunc(a) AS INT) AS tx, CAST(trunc(b) AS INT) AS ty FROM p",
    ),
    "b8_off_transform": sql(
        GRID,
        select="SELECT x, y, CAST(floor((x * CAST(0.5 AS DOUBLE) - 1 - 2) + CAST(0.5 AS DOUBLE)) AS INT) AS ox, CAST(floor((50 - y * CAST(0.5 AS DOUBLE) - 48) / -1 + CAST(0.5 AS DOUBLE)) AS INT) AS oy FROM cells",
    ),
    "b9_direction_between": sql(GRID, select="SELECT c.x, c.y, o.dir FROM cells c LEFT JOIN off o ON o.dx = c.y % 4 - 1 AND o.dy = c.x % 3 - 1"),
    "b10_is_water": sql(GRID, LAKES, select="SELECT x, y, CASE WHEN (x, y) IN (SELECT (x, y) FROM water) THEN 1 ELSE 0 END AS is_water FROM cells"),
    "b11_orientation": sql(GRID, select="SELECT c.x, c.y, coalesce(o.dir, 0) AS sector FROM cells c LEFT JOIN off o ON o.dx = sign(50 - c.x) AND o.dy = sign(7 - c.y)"),
    "b12_in_scale": sql(GRID, select="SELECT x, y, x BETWEEN 10 AND 60 AND y BETWEEN 5 AND 40 AS inside, x IN (10, 60) OR y IN (40, 5) AS edge FROM cells"),
    "b14_nodata_value": "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_size ELSE 0 END AS nodata FROM part",
    "d1_snapped_extent": sql(
        GRID, LAKES,
        "e AS (SELECT k, CAST(x0 + 0.25 AS DOUBLE) AS l, CAST(x0 + w AS DOUBLE) AS r, CAST(y0 AS DOUBLE) AS b, CAST(y0 + 0.75 + h AS DOUBLE) AS t FROM rect)",
        """s AS (SELECT k, l - (1 - (-l - floor(-l))) AS "left", r + (-r - floor(-r)) AS "right", b - (1 - ((0.5 - b) - floor(0.5 - b))) AS bottom, t + ((0.5 - t) - floor(0.5 - t)) AS top FROM e)""",
        select="""SELECT *, CAST(trunc(abs("right" - "left")) AS INT) + 1 AS nx, CAST(trunc(abs(top - bottom)) AS INT) + 1 AS ny FROM s""",
    ),
    "d2_rasterize_rects": sql(GRID, LAKES, select="SELECT fid, x, unnest(range(y0, y0 + h)) AS y, -99 AS v FROM (SELECT k AS fid, unnest(range(x0, x0 + w)) AS x, y0, h FROM rect)"),
    "d3_clip_touched": sql(GRID, LAKES, select="SELECT DISTINCT c.x, c.y, round(z, 8) AS z FROM cells c, rect WHERE x BETWEEN x0 AND x0 + w AND y BETWEEN y0 AND y0 + h"),
    "d4_clip_centre": sql(GRID, LAKES, select="SELECT c.x, c.y, round(z, 8) AS z FROM cells c JOIN water w ON w.x = c.x AND w.y = c.y"),
    "d5_polygonize_labels": sql(
        GRID, "band AS (SELECT y * 100 + x AS cell, x, y, CAST(floor(z / 4) AS INT) AS v FROM cells)",
        "side AS (SELECT a.cell AS a, b.cell AS b FROM band a, off o JOIN band b ON b.x = a.x + o.dx AND b.y = a.y + o.dy WHERE o.dir % 2 = 1 AND a.v = b.v)",
        "l(cell, other) AS (SELECT cell, cell FROM band UNION SELECT l.cell, s.b FROM l JOIN side s ON s.a = l.other)",
        select="SELECT x, y, v, min(other) AS label FROM band JOIN l USING (cell) GROUP BY ALL",
    ),
    "d6_filter_area": sql(GRID, LAKES, select="SELECT k, CAST(area AS VARCHAR) AS Lake_area FROM rect WHERE area > 12"),
    "d9_ring_area": sql(GRID, LAKES, select="SELECT k AS fid, round(6371007.2 * 6371007.2 * radians(w / 10) * (sin(radians((y0 + h) / 100)) - sin(radians(y0 / 100))) / 1e6, 4) AS km2 FROM rect"),
    "d10_polygon_rings": sql(
        GRID, LAKES,
        select="""SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS name, 0 AS part, 0 AS ring, pos, CAST(CASE WHEN pos IN (1, 2) THEN x0 + w ELSE x0 END AS DOUBLE) AS x, CAST(CASE WHEN pos IN (2, 3) THEN y0 + h ELSE y0 END AS DOUBLE) AS y
            FROM rect, (SELECT unnest(range(0, 5)) AS pos)""",
    ),
    "d11_main_ring": sql(GRID, LAKES, select="SELECT DISTINCT k % 7 AS fid, 0 AS part, 0 AS ring, 5 AS n_points, false AS has_holes FROM rect"),
    "d14_ring_orientation": sql(GRID, LAKES, select="SELECT k AS fid, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS clockwise FROM rect"),
    "d15_densify_ring": sql(GRID, LAKES, RING, select="SELECT k AS fid, pos, x, y FROM line UNION ALL SELECT k, 2 * (w + h), x0, y0 FROM rect"),
    "d16_inner_boundary": sql(GRID, LAKES, RING, INNER, select="SELECT k AS fid, pos, x, y FROM inner_cells"),
    "e1_geojson_merge": sql(
        GRID, LAKES, DOCS,
        """m AS (SELECT '{"type":"FeatureCollection","crs":{"type":"name","properties":{"name":"urn:ogc:def:crs:OGC:1.3:CRS84"}},"features":[' || string_agg(doc, ',' ORDER BY name) || ']}' AS doc FROM docs)""",
        select="SELECT md5(doc) AS digest, length(doc) AS chars FROM m",
    ),
    "e2_props_update": sql(GRID, LAKES, DOCS, select="""SELECT name, '{"DN":"' || name || '","kind":"lake","pfaf_id":"4' || name || '"}' AS props FROM docs"""),
    "e3_split_by_dn": sql(GRID, LAKES, select="SELECT CAST(k % 7 AS INT) AS dn, CASE WHEN count(*) > 1 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, count(*) AS n FROM rect GROUP BY 1"),
    "g3_repair_accumulation": sql(GRID, PATH, select="SELECT cell, acc FROM acc WHERE (cell % 100 // 10) % 3 = 1"),
    "g4_strahler_order": sql(
        GRID,
        """s(cell, strahler) USING KEY (cell) AS (SELECT cell, 1 FROM flow UNION
          SELECT c.nxt, c.o FROM (SELECT nxt, CASE WHEN count(*) FILTER (o = m) > 1 THEN m + 1 ELSE m END AS o FROM
            (SELECT f.nxt, u.strahler AS o, max(u.strahler) OVER (PARTITION BY f.nxt) AS m FROM flow f JOIN recurring.s u ON u.cell = f.cell
              WHERE f.nxt IN (SELECT g.nxt FROM s JOIN flow g ON g.cell = s.cell)) GROUP BY nxt, m) c
          JOIN recurring.s r ON r.cell = c.nxt WHERE c.o > r.strahler)""",
        select="SELECT cell, strahler FROM s",
    ),
    "g5_pit_fill": sql(
        GRID,
        """fill(cell, w) USING KEY (cell) AS (SELECT y * 100 + x, z FROM cells, size WHERE x IN (0, 99) OR y IN (0, size.h - 1) UNION
          SELECT n.ny * 100 + n.nx, min(greatest(n.nz, f.w)) FROM fill f JOIN near n ON n.y * 100 + n.x = f.cell LEFT JOIN recurring.fill r ON r.cell = n.ny * 100 + n.nx
          WHERE r.w IS NULL OR greatest(n.nz, f.w) < r.w GROUP BY 1)""",
        select="SELECT cell % 100 AS x, cell // 100 AS y, round(w, 8) AS filled FROM fill",
    ),
    "g8_lake_revision": sql(
        GRID, PATH, LAKES, RIVER,
        """t AS (SELECT r.cell, r.nxt, unnest(CASE WHEN abs(nxt - cell) = 100 THEN [CASE WHEN cell % 100 > 0 THEN cell - 1 END, CASE WHEN cell % 100 < 99 THEN cell + 1 END]
            WHEN abs(nxt - cell) = 1 THEN [cell - 100, cell + 100] ELSE [cell - cell % 100 + nxt % 100, nxt - nxt % 100 + cell % 100] END) AS beside FROM river r WHERE nxt IS NOT NULL)""",
        """wet(cell, one) USING KEY (cell) AS (SELECT cell, 1 FROM water UNION SELECT t.cell, 1 FROM t JOIN recurring.wet a ON a.cell = t.nxt JOIN recurring.wet b ON b.cell = t.beside
            WHERE t.cell NOT IN (SELECT cell FROM recurring.wet) AND (SELECT count(*) FROM wet) > 0)""",
        select="SELECT cell FROM wet",
    ),
    "h1_divide_variance": sql(
        AREAS, "p AS (SELECT CASE WHEN rank <= 5 THEN area / 9 ELSE area END AS a, CASE WHEN rank <= 5 THEN 9 ELSE 1 END AS t FROM ranked)",
        select="SELECT 5 AS n, CAST(sum(t) AS BIGINT) AS n_new, round(sum(a * t) / sum(t), 4) AS mean, round(sum(a * a * t) / sum(t) - (sum(a * t) / sum(t)) * (sum(a * t) / sum(t)), 2) AS variance, sum(t) > 3 * count(*) AS enough FROM p",
    ),
    "h2_basins_to_divide": sql(AREAS, select="SELECT * FROM ranked WHERE rank <= (SELECT CASE WHEN count(*) // 4 + 1 < count(*) THEN count(*) // 4 + 1 ELSE 1 END FROM ranked)"),
    "h3_pfafstetter_l1": sql(GRID, PATH, PFAF, select="SELECT CAST(basin AS VARCHAR) AS basin, cell, digit FROM digits"),
    "h4_divide_all": sql(GRID, PATH, PFAF, select="SELECT cell, CAST(basin AS VARCHAR) || digit AS pfaf FROM digits"),
    "h5_divide_level": sql(
        GRID, PATH, PFAF,
        "r AS (SELECT basin, row_number() OVER (ORDER BY n DESC, CAST(basin AS VARCHAR) DESC) AS r, count(*) OVER () AS c FROM (SELECT basin, count(*) AS n FROM bc GROUP BY basin))",
        select="SELECT b.cell, CAST(b.basin AS VARCHAR) || coalesce(CASE WHEN r.r <= r.c // 4 + 1 THEN d.digit END, 1) AS pfaf FROM bc b JOIN r ON r.basin = b.basin LEFT JOIN digits d ON d.cell = b.cell",
    ),
    "h5_divide_levels": sql(
        GRID, PATH, "pf0 AS (SELECT p.cell, CAST(p.ends AS VARCHAR) AS pfaf FROM path p JOIN flow f ON f.cell = p.ends WHERE f.nxt IS NULL)",
        *(LEVEL.replace("{i}", str(k)).replace("{j}", str(k + 1)) for k in range(LEVELS)), select=f"SELECT cell, pfaf FROM pf{LEVELS}",
    ),
    "h6_outlet_order": sql(
        OUTLETS,
        "g AS (SELECT pos, coalesce(pos - lag(pos) OVER (ORDER BY pos), pos + 1 + 20000 - 1 - max(pos) OVER ()) AS gap, row_number() OVER (ORDER BY pos) - 1 AS k, count(*) OVER () AS n FROM outlets)",
        "f AS (SELECT k AS f FROM g ORDER BY gap DESC, k LIMIT 1)",
        select="SELECT pos, gap, CAST((k - f + n) % n AS INT) AS ord FROM g, f",
    ),
    "h7_outlet_groups": sql(
        OUTLETS, "t AS (SELECT *, row_number() OVER (ORDER BY acc DESC, pos) <= 4 AS top FROM outlets)", "s AS (SELECT *, sum(CAST(top AS INT)) OVER (ORDER BY pos) AS s FROM t)",
        select="SELECT pos, CAST(CASE WHEN top THEN 2 * s ELSE 2 * s + 1 END AS INT) AS grp FROM s",
    ),
    "h9_spill_point": sql(
        GRID, LAKES, RING, INNER,
        """n AS (SELECT i.*, c.z, coalesce(lag(x) OVER o, last_value(x) OVER a) AS ax, coalesce(lag(y) OVER o, last_value(y) OVER a) AS ay, coalesce(lead(x) OVER o, first_value(x) OVER a) AS bx, coalesce(lead(y) OVER o, first_value(y) OVER a) AS b_y
          FROM inner_cells i JOIN cells c USING (x, y) WINDOW o AS (PARTITION BY k ORDER BY pos), a AS (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""",
        "low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY z, pos) AS r FROM n) WHERE r = 1)",
        """turn AS (SELECT l.k, l.x, l.y, coalesce(i.dir, 0) AS i, coalesce(o.dir, 0) AS o, coalesce(b.dir, 0) AS b FROM low l LEFT JOIN off i ON i.dx = sign(l.x - ax) AND i.dy = sign(l.y - ay)
          LEFT JOIN off o ON o.dx = sign(bx - l.x) AND o.dy = sign(b_y - l.y) LEFT JOIN off b ON b.dx = sign(l.x - bx) AND b.dy = sign(l.y - b_y))""",
        """code AS (SELECT k, x, y, coalesce(map {33: 5, 31: 4, 35: 6, 13: 4, 11: 3, 17: 2, 71: 2, 77: 1, 75: 8, 53: 6, 57: 8, 55: 7}[i * 10 + o], b) AS dir FROM turn)""",
        select="SELECT k AS fid, c.x, c.y, c.dir, c.x + f.dx AS to_x, c.y + f.dy AS to_y FROM code c LEFT JOIN off f ON f.dir = c.dir",
    ),
    "h8_coastal_division": sql(
        GRID, PATH,
        """ring AS (SELECT min(pos) AS pos, y * 100 + x AS cell FROM (
            SELECT i - 1 AS pos, i AS x, 0 AS y FROM (SELECT unnest(range(1, 100)) AS i)
            UNION ALL SELECT 99 + i - 1, 99, i FROM (SELECT unnest(range(1, h)) AS i FROM size)
            UNION ALL SELECT 99 + h - 1 + i - 1, 99 - i, h - 1 FROM (SELECT unnest(range(1, 100)) AS i, h FROM size)
            UNION ALL SELECT 198 + h - 1 + i - 1, 0, h - 1 - i FROM (SELECT unnest(range(1, h)) AS i, h FROM size)) GROUP BY cell)""",
        "outs AS (SELECT r.pos, r.cell, a.acc, (SELECT count(*) FROM (SELECT 1 FROM size, range(0, 198 + 2 * (h - 1)))) AS n FROM ring r JOIN flow f USING (cell) JOIN acc a USING (cell) WHERE f.nxt IS NULL)",
        "g AS (SELECT *, coalesce(pos - lag(pos) OVER (ORDER BY pos), pos + 1 + n - 1 - max(pos) OVER ()) AS gap, row_number() OVER (ORDER BY pos) - 1 AS k, count(*) OVER () AS c FROM outs)",
        "f1 AS (SELECT k AS f FROM g ORDER BY gap DESC, k LIMIT 1)",
        "o1 AS (SELECT cell, acc, (k - f + c) % c AS ord FROM g, f1)",
        "t1 AS (SELECT *, row_number() OVER (ORDER BY acc DESC, ord) <= 4 AS top FROM o1)",
        "s1 AS (SELECT *, sum(CAST(top AS INT)) OVER (ORDER BY ord) AS s FROM t1)",
        select="SELECT p.cell, CAST(CASE WHEN top THEN 2 * s ELSE 2 * s + 1 END AS INT) AS grp FROM path p JOIN s1 ON s1.cell = p.ends",
    ),
    "h10_lake_upstream": sql(
        GRID, PATH, LAKES, LABELS, BUFFER, DRY, GROUPS,
        select="""SELECT b.lake, f.cell, round(f.z, 8) AS z, f.nxt, a.acc FROM (SELECT p.cell, max(o.ord) AS ord FROM walk p JOIN inflow i ON i.cell = p.ends JOIN ord o USING (lake) GROUP BY p.cell) m
            JOIN ord b USING (ord) JOIN flow f USING (cell) JOIN acc a USING (cell)""",
        th="CAST('inf' AS DOUBLE)",
    ),
    "h11_drainage": sql(
        GRID, START, "mark AS (SELECT DISTINCT y * 100 + x AS cell FROM starts)",
        f"g AS (SELECT d.y * 100 + d.x AS cell, CASE WHEN d.x + o.dx BETWEEN 0 AND 99 AND d.y + o.dy BETWEEN 0 AND (SELECT h FROM size) - 1 THEN (d.y + o.dy) * 100 + d.x + o.dx END AS nxt FROM dir128 d LEFT JOIN off o ON o.dir = list_position({STEP128}, d.dir128))",
        "river AS (SELECT g.* FROM g JOIN mark USING (cell))",
        "fork AS (SELECT nxt, count(*) AS n FROM river WHERE nxt IS NOT NULL GROUP BY nxt)",
        "link AS (SELECT r.cell, CASE WHEN f.n < 2 AND r.nxt IN (SELECT cell FROM mark) THEN r.nxt END AS nxt FROM river r LEFT JOIN fork f ON f.nxt = r.nxt)",
        "chain(cell, ends) AS (SELECT cell, cell FROM link UNION ALL SELECT c.cell, l.nxt FROM chain c JOIN link l ON c.ends = l.cell WHERE l.nxt IS NOT NULL)",
        "segment AS (SELECT c.cell, c.ends AS reach FROM chain c JOIN link l ON c.ends = l.cell WHERE l.nxt IS NULL)",
        "fall(cell, ends) AS (SELECT cell, cell FROM g UNION ALL SELECT p.cell, f.nxt FROM fall p JOIN g f ON p.ends = f.cell WHERE f.nxt IS NOT NULL AND f.cell NOT IN (SELECT cell FROM mark))",
        select="SELECT p.cell, s.reach AS watershed FROM fall p JOIN segment s ON s.cell = p.ends",
    ),
}
REVISED = (
    LAKES.replace("water AS", "water0 AS"),
    RIVER,
    """t AS (SELECT r.cell, r.nxt, unnest(CASE WHEN abs(nxt - cell) = 100 THEN [CASE WHEN cell % 100 > 0 THEN cell - 1 END, CASE WHEN cell % 100 < 99 THEN cell + 1 END]
      WHEN abs(nxt - cell) = 1 THEN [cell - 100, cell + 100] ELSE [cell - cell % 100 + nxt % 100, nxt - nxt % 100 + cell % 100] END) AS beside FROM river r WHERE nxt IS NOT NULL)""",
    """wet(cell, one) USING KEY (cell) AS (SELECT cell, 1 FROM water0 UNION SELECT t.cell, 1 FROM t JOIN recurring.wet a ON a.cell = t.nxt JOIN recurring.wet b ON b.cell = t.beside
      WHERE t.cell NOT IN (SELECT cell FROM recurring.wet) AND (SELECT count(*) FROM wet) > 0)""",
    "water AS (SELECT cell, cell % 100 AS x, cell // 100 AS y FROM wet)",
)
SLOPES = "slopes AS (SELECT p.cell, max(i.id) AS slope_id FROM walk p JOIN (SELECT g.cell, dense_rank() OVER (ORDER BY o.ord, g.grp) AS id FROM grp g JOIN ord o USING (lake)) i ON i.cell = p.ends GROUP BY p.cell)"
SQL |= {
    "a3_float_cells": sql(GRID, select="SELECT x, y, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 3) AS v FROM cells"),
    "a5_copy_raster": sql(GRID, select="SELECT x, y, round(z, 8) AS z FROM cells"),
    "a12_geojson_rows": sql(GRID, LAKES, select="SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS name, CAST(k % 7 AS VARCHAR) AS dn, 'lake' AS kind, CAST(x0 AS DOUBLE) AS x, CAST(y0 AS DOUBLE) AS y FROM rect"),
    "a13_folder_batch": sql(GRID, LAKES, select="SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS file, 1 AS n, CAST(k % 7 AS VARCHAR) AS dn FROM rect"),
    "b13_on_edge": sql(GRID, select="SELECT x, y, x IN (0, 99) OR y IN (0, (SELECT h FROM size) - 1) AS edge FROM cells"),
    "c5_batch_reclass": sql(GRID, select=f"SELECT CASE WHEN x < 50 THEN 0 ELSE 1 END AS file_ord, x, y, CASE WHEN dir128 = 255 THEN -1 ELSE coalesce(list_position({STEP128}, dir128), dir128) END AS dir FROM dir128"),
    "d5_ring_measures": sql(
        GRID, "band AS (SELECT y * 100 + x AS cell, x, y, CAST(floor(z / 4) AS INT) AS v FROM cells)",
        "side AS (SELECT a.cell AS a, b.cell AS b FROM band a, off o JOIN band b ON b.x = a.x + o.dx AND b.y = a.y + o.dy WHERE o.dir % 2 = 1 AND a.v = b.v)",
        "l(cell, other) AS (SELECT cell, cell FROM band UNION SELECT l.cell, s.b FROM l JOIN side s ON s.a = l.other)",
        "m AS (SELECT cell, min(other) AS label FROM l GROUP BY cell)",
        select="SELECT label, CAST(sum(4 - (SELECT count(*) FROM side WHERE side.a = m.cell)) AS BIGINT) AS sides, 2 * count(*) AS twice_area FROM m GROUP BY label",
    ),
    "d12_splice_holes": sql(
        GRID, LAKES,
        """p AS (SELECT k, unnest(range(0, 8)) AS pos, CAST(x0 AS DOUBLE) AS a, CAST(y0 AS DOUBLE) AS b, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM rect)""",
        select="""SELECT k AS fid, pos, a + [0, w, w - 0.5, w - 0.25, w, w, 0, 0][pos + 1] AS x, b + [0, 0, 0.25, 0.5, 0, h, h, 0][pos + 1] AS y FROM p""",
    ),
    "d13_splice_outer_cells": sql(
        GRID, LAKES,
        """p AS (SELECT k, unnest(range(0, 9)) AS pos, CAST(x0 AS DOUBLE) AS a, CAST(y0 AS DOUBLE) AS b, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM rect)""",
        select="""SELECT k AS fid, 1 AS joints, pos, a + [0, w, w, w + 1, w + 1, w, w, 0, 0][pos + 1] AS x, b + [0, 0, h, h, h + 1, h + 1, h, h, 0][pos + 1] AS y FROM p""",
    ),
    "g15_water_slope": sql(
        GRID, PATH, LAKES, LABELS, BUFFER, DRY, GROUPS, SLOPES, "slow AS (SELECT d.cell, d.nxt FROM dry d JOIN acc USING (cell) WHERE acc < {th})",
        "go(cell) AS (SELECT cell FROM slow WHERE cell IN (SELECT start FROM ord) UNION SELECT s2.cell FROM go JOIN slow s ON s.cell = go.cell JOIN slow s2 ON s2.cell = s.nxt)",
        select="SELECT cell, v, CASE WHEN cell IN (SELECT cell FROM go) THEN 1 ELSE 0 END AS route FROM (SELECT cell, slope_id AS v FROM slopes UNION ALL SELECT cell, -99 FROM water)", th=TH,
    ),
    "p3_from_layers": sql(
        GRID, PATH, *REVISED, LABELS, BUFFER, DRY, GROUPS, SLOPES,
        select="SELECT cell % 100 AS x, cell // 100 AS y, v FROM (SELECT cell, slope_id AS v FROM slopes UNION ALL SELECT cell, -99 FROM water)", th=TH,
    ),
}
BOX = "greatest(0, least(x0 + w, 70) - greatest(x0, 20)) * greatest(0, least(y0 + h, (SELECT h FROM size) // 2) - greatest(y0, 10))"
SQL["d7_clip_extent"] = sql(GRID, LAKES, select=f"SELECT * FROM (SELECT k AS fid, CAST({BOX} AS DOUBLE) AS area FROM rect) WHERE area > 0")
SQL["d8_filter_clip"] = sql(GRID, LAKES, select=f"SELECT * FROM (SELECT k AS fid, CAST({BOX} AS DOUBLE) AS area FROM rect WHERE area > 12) WHERE area > 0")
# a lake is two boxes, the extent three; a lake's parts in the two arms hang together if it reaches the base
PARTS = """
m AS (SELECT greatest(h // 3, 12) AS m, h AS top FROM size),
arm AS (SELECT 1 AS arm, 20 AS ax, 35 AS bx, m AS ay, top AS by FROM m UNION ALL SELECT 2, 55, 70, m, top FROM m UNION ALL SELECT 3, 20, 70, 5, m FROM m),
box AS (SELECT k, area, CAST(x0 AS DOUBLE) AS ax, CAST(x0 + w AS DOUBLE) AS bx, CAST(y0 AS DOUBLE) AS ay, y0 + CAST(h AS DOUBLE) / 2 AS by FROM rect UNION ALL SELECT k, area, CAST(x0 AS DOUBLE), x0 + CAST(w AS DOUBLE) / 2, y0 + CAST(h AS DOUBLE) / 2, CAST(y0 + h AS DOUBLE) FROM rect),
met AS (SELECT k, any_value(b.area) AS size, arm, sum(greatest(CAST(0 AS DOUBLE), least(b.bx, a.bx) - greatest(b.ax, a.ax)) * greatest(CAST(0 AS DOUBLE), least(b.by, a.by) - greatest(b.ay, a.ay))) AS area
  FROM box b, arm a GROUP BY k, arm),
part AS (SELECT k AS fid, any_value(size) AS size, round(sum(area), 6) AS area, CASE WHEN max(CASE WHEN arm = 3 THEN area END) > 0 THEN 1 ELSE count(*) END AS parts FROM met WHERE area > 0 GROUP BY k)"""
SQL["d7_clip_polygon"] = sql(GRID, LAKES, PARTS, select="SELECT fid, CAST(area AS DOUBLE) AS area, CAST(parts AS INT) AS parts FROM part")
SQL["d8_filter_clip_polygon"] = sql(GRID, LAKES, PARTS, select="SELECT fid, CAST(area AS DOUBLE) AS area, CAST(parts AS INT) AS parts FROM part WHERE size > 12")
SQL["c3_reclass_long_table"] = sql(
    GRID, "t AS (SELECT c_custkey AS pos, abs(c_acctbal) / 50 AS low, abs(c_acctbal) / 50 + c_custkey % 7 * CAST(0.25 AS DOUBLE) AS high, CAST(c_custkey % 100 AS DOUBLE) AS new FROM customer)",
    "v AS (SELECT x, y, round(z, 8) AS v FROM cells)", "hit AS (SELECT x, y, arg_min(new, pos) AS new FROM v JOIN t ON v BETWEEN low AND high GROUP BY x, y)",
    select="SELECT x, y, coalesce(new, v) AS v FROM v LEFT JOIN hit USING (x, y)",
)
SQL["g3_tile_of_point"] = sql(
    GRID, LAKES, "p AS (SELECT p_partkey AS point, CAST(p_partkey % 199 AS DOUBLE) / 2 AS x, CAST(p_partkey * 7 % (2 * (SELECT h FROM size)) AS DOUBLE) / 2 AS y FROM part)",
    select="SELECT point, min(k) AS box FROM p LEFT JOIN rect ON p.x BETWEEN x0 AND x0 + w AND p.y BETWEEN y0 AND y0 + h GROUP BY point",
)
# the conic of EPSG:5243: its constants from the ellipsoid and the parallels, then four corners of each box
CONIC = """
e AS (SELECT sqrt(f * (2 - f)) AS e, radians(48 + CAST(2 AS DOUBLE) / 3) AS a, radians(53 + CAST(2 AS DOUBLE) / 3) AS b, radians(51) AS o FROM (SELECT 1 / 298.257222101::DOUBLE AS f)),
k1 AS (SELECT e, cos(a) / sqrt(1 - (e * sin(a)) ** 2) AS ma, cos(b) / sqrt(1 - (e * sin(b)) ** 2) AS mb,
  tan(pi() / 4 - a / 2) / ((1 - e * sin(a)) / (1 + e * sin(a))) ** (e / 2) AS ta, tan(pi() / 4 - b / 2) / ((1 - e * sin(b)) / (1 + e * sin(b))) ** (e / 2) AS tb,
  tan(pi() / 4 - o / 2) / ((1 - e * sin(o)) / (1 + e * sin(o))) ** (e / 2) AS t0 FROM e),
k2 AS (SELECT *, ln(ma / mb) / ln(ta / tb) AS n FROM k1),
k3 AS (SELECT *, 6378137 * ma / (n * ta ** n) AS f FROM k2),
corner AS (SELECT k AS fid, i, radians(CAST(CASE WHEN i IN (1, 2) THEN x0 + w ELSE x0 END AS DOUBLE) / 10 + 5 - 10.5::DOUBLE) AS lon, radians(CAST(CASE WHEN i IN (2, 3) THEN y0 + h ELSE y0 END AS DOUBLE) / 100 + 47) AS lat
  FROM rect, (SELECT unnest(range(0, 4)) AS i)),
r AS (SELECT fid, i, lon * n AS turn, f * (tan(pi() / 4 - lat / 2) / ((1 - e * sin(lat)) / (1 + e * sin(lat))) ** (e / 2)) ** n AS r, f * t0 ** n AS r0 FROM corner, k3),
p AS (SELECT fid, i, r * sin(turn) AS x, r0 - r * cos(turn) AS y FROM r)"""
SQL["d9_ring_area_conic"] = sql(
    GRID, LAKES, CONIC, select="""SELECT fid, round(abs(sum(p.x * q.y - q.x * p.y)) / 2 / 1e6, 4) AS km2, round(any_value(p.x) FILTER (p.i = 0), 3) AS x, round(any_value(p.y) FILTER (p.i = 0), 3) AS y,
      round(any_value(CAST(x0 AS DOUBLE) / 10 + 5), 9) AS lon, round(any_value(CAST(y0 AS DOUBLE) / 100 + 47), 9) AS lat
    FROM p JOIN p q USING (fid) JOIN rect ON k = fid WHERE q.i = (p.i + 1) % 4 GROUP BY fid""",
)
SQL["f1_boundary_blocks"] = SQL["f1_boundary_cells"]
SQL["f5_d8_blocks"] = SQL["f5_d8_direction"]
SQL["f6_lake_buffer_blocks"] = SQL["f6_lake_buffer"]
SQL["a4_write_cells"] = SQL["a4_overlay"]
FILLED = (
    GRID.split("near AS")[0].replace("cells AS", "cells0 AS").rstrip().rstrip(","),
    "near0 AS (SELECT c.x, c.y, n.x AS nx, n.y AS ny, n.z AS nz FROM cells0 c, off o JOIN cells0 n ON n.x = c.x + o.dx AND n.y = c.y + o.dy)",
    """fill(cell, w) USING KEY (cell) AS (SELECT y * 100 + x, z FROM cells0, size WHERE x IN (0, 99) OR y IN (0, size.h - 1) UNION
      SELECT n.ny * 100 + n.nx, min(greatest(n.nz, f.w)) FROM fill f JOIN near0 n ON n.y * 100 + n.x = f.cell LEFT JOIN recurring.fill r ON r.cell = n.ny * 100 + n.nx
      WHERE r.w IS NULL OR greatest(n.nz, f.w) < r.w GROUP BY 1)""",
    "cells AS (SELECT CAST(cell % 100 AS INT) AS x, CAST(cell // 100 AS INT) AS y, w AS z FROM fill)",
    "near AS" + GRID.split("near AS")[1].split("flow AS")[0].replace("d8 AS", "steep AS").rstrip().rstrip(","),
    "around AS (SELECT x, y, count(*) AS n, min(slope) AS rise FROM near GROUP BY x, y)",
    "level AS (SELECT x, y, n, rise FROM around ANTI JOIN steep USING (x, y))",
    """low AS (SELECT n.x, n.y, min(n.dir) AS dir FROM near n WHERE slope = 0
      AND ((nx, ny) IN (SELECT (x, y) FROM steep) OR (nx, ny) IN (SELECT (x, y) FROM level WHERE n < 8)) GROUP BY 1, 2)""",
    "flat AS (SELECT x, y, rise < 0 AS below, dir AS low FROM level LEFT JOIN low USING (x, y) WHERE n = 8)",
    *(
        f"""{name}(x, y, d) USING KEY (x, y) AS (SELECT x, y, 1 FROM flat WHERE {start} UNION
          SELECT n.nx, n.ny, min(t.d + 1) FROM {name} t JOIN near n ON n.x = t.x AND n.y = t.y AND n.slope = 0 JOIN flat f ON f.x = n.nx AND f.y = n.ny
          LEFT JOIN recurring.{name} r ON r.x = n.nx AND r.y = n.ny WHERE r.d IS NULL GROUP BY 1, 2)"""
        for name, start in (("towards", "low IS NOT NULL"), ("away", "below"))
    ),
    "grade AS (SELECT t.x, t.y, 2 * t.d - coalesce(a.d, 0) AS g FROM towards t LEFT JOIN away a USING (x, y))",
    """gentle AS (SELECT x, y, low AS dir FROM flat WHERE low IS NOT NULL UNION ALL
      SELECT f.x, f.y, arg_min(n.dir, g.g * 10 + n.dir) FROM flat f JOIN near n ON n.x = f.x AND n.y = f.y AND n.slope = 0 JOIN grade g ON g.x = n.nx AND g.y = n.ny
      WHERE low IS NULL GROUP BY 1, 2)""",
    "d8 AS (SELECT x, y, dir, slope, nx, ny FROM steep UNION ALL SELECT g.x, g.y, g.dir, 0.0, g.x + dx, g.y + dy FROM gentle g JOIN off USING (dir))",
    "flow AS" + GRID.split("flow AS")[1],
)
SQL["f5_drain_directions"] = sql(*FILLED, select="SELECT x, y, dir, round(slope, 8) AS slope FROM d8")
SQL["a13_folder_to_geojson"] = sql(
    GRID, LAKES, select="SELECT 'lakes' || (k % 3) AS file, lpad(CAST(k AS VARCHAR), 6, '0') AS name, CAST(k % 7 AS VARCHAR) AS dn, CAST(5 AS INT) AS n_points FROM rect"
)
SQL["p2_from_elevation"] = sql(
    *FILLED, PATH, *REVISED, LABELS, BUFFER, DRY, GROUPS, SLOPES,
    "gone AS (SELECT cell FROM slopes UNION SELECT cell FROM water)",
    "rest AS (SELECT cell, nxt FROM flow WHERE cell NOT IN (SELECT cell FROM gone))",
    "river2 AS (SELECT cell, nxt FROM river WHERE cell NOT IN (SELECT cell FROM gone))",
    "fork2 AS (SELECT nxt, count(*) AS n FROM river2 WHERE nxt IS NOT NULL GROUP BY nxt)",
    "link2 AS (SELECT r.cell, CASE WHEN f.n < 2 AND r.nxt IN (SELECT cell FROM river2) THEN r.nxt END AS nxt FROM river2 r LEFT JOIN fork2 f ON f.nxt = r.nxt)",
    "chain2(cell, ends) AS (SELECT cell, cell FROM link2 UNION ALL SELECT c.cell, l.nxt FROM chain2 c JOIN link2 l ON c.ends = l.cell WHERE l.nxt IS NOT NULL)",
    "segment2 AS (SELECT c.cell, c.ends AS reach FROM chain2 c JOIN link2 l ON c.ends = l.cell WHERE l.nxt IS NULL)",
    "fall2(cell, ends) AS (SELECT cell, cell FROM rest UNION ALL SELECT p.cell, f.nxt FROM fall2 p JOIN rest f ON p.ends = f.cell WHERE f.nxt IS NOT NULL AND f.cell NOT IN (SELECT cell FROM river2))",
    select="SELECT p.cell % 100 AS x, p.cell // 100 AS y, s.reach AS watershed FROM fall2 p JOIN segment2 s ON s.cell = p.ends", th=TH,
)
SQL["g16_watershed_recode"] = sql(
    GRID, PATH, LAKES, RIVER, REACH,
    "slope AS (SELECT cell, CASE WHEN cell NOT IN (SELECT cell FROM river) THEN nxt END AS nxt FROM flow)",
    "fall(cell, ends) AS (SELECT cell, cell FROM slope UNION ALL SELECT p.cell, f.nxt FROM fall p JOIN slope f ON p.ends = f.cell WHERE f.nxt IS NOT NULL)",
    "ws AS (SELECT p.cell, s.reach AS watershed FROM fall p JOIN segment s ON s.cell = p.ends)",
    "rpath(cell, ends) AS (SELECT cell, cell FROM river UNION ALL SELECT p.cell, r.nxt FROM rpath p JOIN river r ON r.cell = p.ends WHERE r.nxt IS NOT NULL)",
    "claim AS (SELECT p.ends AS cell, min((r.acc, r.cell)) AS head FROM rpath p JOIN river r ON r.cell = p.cell GROUP BY p.ends)",
    "piece AS (SELECT w.watershed, c.head, count(*) AS n FROM claim c JOIN ws w USING (cell) GROUP BY ALL)",
    "other AS (SELECT watershed, head FROM (SELECT *, row_number() OVER (PARTITION BY watershed ORDER BY n DESC, head) AS r FROM piece) WHERE r > 1)",
    "fresh AS (SELECT watershed, head, (SELECT max(watershed) FROM ws) + row_number() OVER (ORDER BY head, watershed) AS id FROM other)",
    "stop AS (SELECT c.cell, coalesce(f.id, -1) AS label FROM claim c JOIN ws w USING (cell) LEFT JOIN fresh f ON f.watershed = w.watershed AND f.head = c.head)",
    "stopped AS (SELECT * FROM stop UNION ALL SELECT cell, -1 FROM water WHERE cell NOT IN (SELECT cell FROM stop))",
    "down(cell, ends) AS (SELECT cell, cell FROM flow UNION ALL SELECT p.cell, f.nxt FROM down p JOIN flow f ON p.ends = f.cell WHERE f.nxt IS NOT NULL AND f.cell NOT IN (SELECT cell FROM stopped))",
    select="SELECT w.cell, coalesce(n.label, w.watershed) AS watershed FROM ws w LEFT JOIN (SELECT d.cell, s.label FROM down d JOIN stopped s ON s.cell = d.ends WHERE s.label >= 0) n ON n.cell = w.cell",
)

SQL["a9_web_mercator"] = sql(
    GRID, "deg AS (SELECT round(z, 8) AS v, 5.0 + x * CAST(0.05 AS DOUBLE) AS lon, 47.0 + y * CAST(-0.05 AS DOUBLE) AS lat FROM cells)", PIXELS, select="SELECT x, y, v FROM pixel", n=16384
)
SQL["a9_geotiff_layer"] = sql(
    GRID, LAKES, "deg AS (SELECT floor(c.z) AS v, 5.0 + c.x * CAST(0.05 AS DOUBLE) AS lon, 47.0 + c.y * CAST(-0.05 AS DOUBLE) AS lat FROM cells c JOIN water w ON w.x = c.x AND w.y = c.y)", PIXELS,
    select="SELECT level, x >> level AS x, y >> level AS y, max(v) AS v FROM pixel, (SELECT unnest(range(0, 3)) AS level) GROUP BY ALL", n=4096,
)
COLOUR = "'#' || upper(substr(replace(md5({key} || ':{seed}'), '0', ''), 1, 6))"
SQL["b15_colours"] = sql(GRID, LAKES, select=f"SELECT x, y, {COLOUR.format(key='(x * 1000 + y)', seed=7)} AS colour FROM water")
SQL["a10_tile_export"] = sql(
    GRID, PATH,
    "p AS (SELECT level, CAST(cell % 100 AS INT) >> level AS x, CAST(cell // 100 AS INT) >> level AS y, max(acc) AS v FROM acc, (SELECT unnest(range(0, 3)) AS level) GROUP BY ALL)",
    select=f"""SELECT 2 - level AS z, x // 32 AS tile_x, y // 32 AS tile_y, count(*) AS n, md5(string_agg(y || ' ' || x || ' ' || {COLOUR.format(key='v', seed=0)}, ',' ORDER BY y, x)) AS pixels_md5
        FROM p GROUP BY ALL""",
)
SQL["a12_shapefile_round"] = sql(GRID, LAKES, select="SELECT 'lakes' || (k % 3) AS file, lpad(CAST(k AS VARCHAR), 6, '0') AS name, CAST(k % 7 AS VARCHAR) AS dn, 5 AS n_points, CAST(area AS DOUBLE) AS area FROM rect")
SQL["a13_folder_to_shapefiles"] = sql(GRID, LAKES, select="SELECT lpad(CAST(k AS VARCHAR), 6, '0') AS file, 1 AS n_rings, CAST(k % 7 AS VARCHAR) AS dn, 'lake' AS kind FROM rect")
POINTS = """
above AS (SELECT ends AS cell, count(*) - 1 AS pos FROM chain GROUP BY ends),
point AS (SELECT s.reach, a.pos, s.cell FROM segment s JOIN above a USING (cell))"""
SQL["g7_reach_coordinates"] = sql(
    GRID, PATH, RIVER, REACH, POINTS,
    select="SELECT p.reach, p.pos, f.x * CAST(0.5 AS DOUBLE) - 1 AS cx, 50 - f.y * CAST(0.5 AS DOUBLE) AS cy, round(f.z, 8) AS z, a.acc FROM point p JOIN flow f USING (cell) JOIN acc a USING (cell)",
)
SQL["g7_stream_net"] = sql(
    GRID, PATH, RIVER, REACH, POINTS,
    "net AS (SELECT cell, CASE WHEN nxt IN (SELECT cell FROM river) THEN nxt END AS nxt FROM river)",
    """rank(cell, strahler) USING KEY (cell) AS (SELECT cell, 1 FROM net UNION
      SELECT c.nxt, c.o FROM (SELECT nxt, CASE WHEN count(*) FILTER (o = m) > 1 THEN m + 1 ELSE m END AS o FROM
        (SELECT f.nxt, u.strahler AS o, max(u.strahler) OVER (PARTITION BY f.nxt) AS m FROM net f JOIN recurring.rank u ON u.cell = f.cell
          WHERE f.nxt IN (SELECT g.nxt FROM rank JOIN net g ON g.cell = rank.cell)) GROUP BY nxt, m) c
      JOIN recurring.rank r ON r.cell = c.nxt WHERE c.o > r.strahler)""",
    "down AS (SELECT r.cell AS reach, s.reach AS down_reach FROM river r JOIN (SELECT DISTINCT reach FROM segment) t ON t.reach = r.cell LEFT JOIN segment s ON s.cell = r.nxt)",
    "line AS (SELECT reach, count(*) AS n_cells, arg_min(cell, pos) AS head, md5(string_agg(CAST(cell AS VARCHAR), ' ' ORDER BY pos)) AS line_md5 FROM point GROUP BY reach)",
    select="""SELECT l.reach, l.n_cells, d.down_reach, (SELECT count(*) FROM down u WHERE u.down_reach = l.reach) AS n_up, k.strahler, l.head, l.line_md5
        FROM line l JOIN down d USING (reach) JOIN rank k ON k.cell = l.reach""",
)
SQL["d5_polygonize_rings"] = sql(
    GRID, LAKES,
    "link AS (SELECT a.cell AS a, b.cell AS b FROM water a, off o JOIN water b ON b.x = a.x + o.dx AND b.y = a.y + o.dy WHERE o.dir % 2 = 1)",
    "l(cell, other) AS (SELECT cell, cell FROM water UNION SELECT l.cell, s.b FROM l JOIN link s ON s.a = l.other)",
    "area AS (SELECT w.cell, w.x, w.y, min(l.other) AS label FROM water w JOIN l USING (cell) GROUP BY ALL)",
    "turn AS (SELECT * FROM (VALUES (0, 0, -1, 0, 0, 1, 0), (1, 1, 0, 1, 0, 1, 1), (2, 0, 1, 1, 1, 0, 1), (3, -1, 0, 0, 1, 0, 0)) AS t(side, ox, oy, ax, ay, bx, b_y))",
    """border AS (SELECT a.label, t.side, (a.y + t.ay) * 101 + a.x + t.ax AS a, (a.y + t.b_y) * 101 + a.x + t.bx AS b FROM area a, turn t
      WHERE NOT EXISTS (SELECT 1 FROM water w WHERE w.x = a.x + t.ox AND w.y = a.y + t.oy))""",
    """succ AS (SELECT label, a, e, n FROM (SELECT p.label, p.a, p.a * 4 + p.side AS e, q.a * 4 + q.side AS n,
      row_number() OVER (PARTITION BY p.a, p.side ORDER BY list_position([1, 0, 3], (q.side - p.side + 4) % 4), q.side) AS r FROM border p JOIN border q ON q.label = p.label AND q.a = p.b) WHERE r = 1)""",
    "walk(ring, e, pos) AS (SELECT e, e, 0 FROM succ UNION ALL SELECT w.ring, s.n, w.pos + 1 FROM walk w JOIN succ s ON s.e = w.e WHERE s.n > w.ring)",
    "closed AS (SELECT w.ring, max(w.pos) + 1 AS n FROM walk w JOIN succ s ON s.e = w.e WHERE s.n = w.ring GROUP BY w.ring)",
    """point AS (SELECT s.label, w.ring, w.pos, s.a FROM walk w JOIN closed c USING (ring) JOIN succ s ON s.e = w.e
      UNION ALL SELECT s.label, c.ring, c.n, s.a FROM closed c JOIN succ s ON s.e = c.ring)""",
    select="SELECT 1 AS dn, label, ring, pos, a % 101 AS x, a // 101 AS y FROM point",
)
SQL["p1_flagship"] = sql(
    GRID.replace("flow AS", "flow0 AS").replace("FROM flow)", "FROM flow0)"),
    PATH.replace("FROM flow", "FROM flow0").replace("JOIN flow", "JOIN flow0").replace("acc AS", "acc0 AS"),
    "box AS (SELECT f.*, d.dir128, a.acc FROM flow0 f JOIN dir128 d USING (x, y) JOIN acc0 a USING (cell), size s WHERE f.x BETWEEN 10 AND 90 AND f.y BETWEEN 5 AND s.h - 5)",
    "low AS (SELECT b.cell, min(n.acc) AS least FROM box b JOIN box n ON abs(n.x - b.x) <= 1 AND abs(n.y - b.y) <= 1 WHERE b.dir128 = 255 GROUP BY b.cell)",
    "acc AS (SELECT b.cell, CASE WHEN l.least < {th} THEN greatest(b.acc, {th}) ELSE b.acc END AS acc FROM box b LEFT JOIN low l USING (cell))",
    "flow AS (SELECT cell, nxt, x, y, z, dir FROM box)",
    LAKES.replace("water AS", "water9 AS").replace("FROM rect)", "FROM rect WHERE area > 8)"),
    "water0 AS (SELECT w.* FROM water9 w, size s WHERE x BETWEEN 10 AND 90 AND y BETWEEN 5 AND s.h - 5)",
    *REVISED[1:], LABELS, BUFFER, DRY, GROUPS, SLOPES,
    select="SELECT cell % 100 AS x, cell // 100 AS y, v FROM (SELECT cell, slope_id AS v FROM slopes UNION ALL SELECT cell, -99 FROM water)", th=TH,
)
#: Columns whose integer width DuckDB infers differently: BIGINT columns, then INT columns, of each query.
WIDTHS = {
    "a9_pyramid": ("", "level x y"), "a9_web_mercator": ("", "x y"), "a9_geotiff_layer": ("", "level x y"), "a10_tile_export": ("", "z tile_x tile_y n"), "b15_colours": ("", "x y"),
    "g7_stream_net": ("reach down_reach head", ""), "g7_reach_coordinates": ("reach", ""), "d5_polygonize_rings": ("label ring", "pos x y"), "c9_recode_value": ("", "x y"), "d2_rasterize_rects": ("", "x y"), "d5_polygonize_labels": ("label", ""),
    "d5_ring_measures": ("label", ""), "d10_polygon_rings": ("", "pos"), "d12_splice_holes": ("", "pos"), "d13_splice_outer_cells": ("", "pos"), "d15_densify_ring": ("", "pos x y"),
    "d16_inner_boundary": ("", "x y"), "e1_geojson_merge": ("", "chars"), "e3_split_by_dn": ("", "n"), "f6_lake_buffer": ("", "x y"), "f6_lake_buffer_blocks": ("", "x y"), "g1_lake_components": ("", "x y"),
    "g2_flow_accumulation": ("cell", ""), "g3_repair_accumulation": ("cell", ""), "g4_strahler_order": ("cell", ""), "g4_upstream_lengths": ("cell", ""), "g6_sink_basins": ("cell label", ""),
    "g6_indexed_upstream": ("outlet cell", ""), "g6_indexed_basins": ("cell label", ""), "g7_reaches": ("cell reach", ""), "g7_reach_tree": ("reach down_reach", ""), "g7_watersheds": ("cell watershed", ""), "g12_slope_surface_group": ("cell", ""), "g12_slope_surface_lake": ("cell", ""),
    "g13_slope_route": ("cell", ""), "g15_water_slope": ("", "v"), "g16_watershed_recode": ("cell", ""), "h3_pfafstetter_l1": ("cell", "digit"), "h4_divide_all": ("cell", ""), "h5_divide_level": ("cell", ""), "h5_divide_levels": ("cell", ""),
    "h8_coastal_division": ("cell", ""), "h9_spill_point": ("", "x y to_x to_y"), "h10_lake_upstream": ("cell nxt", ""), "h11_drainage": ("cell watershed", ""), "p1_flagship": ("", "x y v"),
    "p2_from_elevation": ("watershed", ""), "p3_from_layers": ("", "x y v"),
}
for _name, (_long, _int) in WIDTHS.items():
    _casts = [f"CAST({c} AS BIGINT) AS {c}" for c in _long.split()] + [f"CAST({c} AS INT) AS {c}" for c in _int.split()]
    SQL[_name] = f"SELECT * REPLACE ({', '.join(_casts)}) FROM ({SQL[_name]})"
