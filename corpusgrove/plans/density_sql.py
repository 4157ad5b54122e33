"""The density clustering as DuckDB SQL, written from its definition (all pairs, one
merge at a time), to compare the distributed form with. For small inputs only."""

from __future__ import annotations


def density_cte(vec: str = "t.reduced", mcs: int = 5, k: int = 5) -> str:
    """CTEs from tr(row_id, vec): the exact mutual-reachability tree by Kruskal, one
    merge per recursion, then the condensed tree: lab(row_id, predict) and ctree."""
    return f"""dims AS (SELECT t.row_id, u.v, u.i FROM tr t, UNNEST({vec}) WITH ORDINALITY AS u(v, i)),
idx AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS i FROM tr),
d AS (SELECT a.row_id AS x, b.row_id AS y, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d
      FROM dims a JOIN dims b ON a.i = b.i AND a.row_id <> b.row_id GROUP BY 1, 2),
core AS (SELECT x, d AS c FROM d QUALIFY row_number() OVER (PARTITION BY x ORDER BY d, y) = {k}),
e AS MATERIALIZED (SELECT greatest(d.d, p.c, q.c) AS w, i.i AS a, j.i AS b FROM d JOIN core p ON p.x = d.x JOIN core q ON q.x = d.y
      JOIN idx i ON i.row_id = d.x JOIN idx j ON j.row_id = d.y WHERE i.i < j.i),
kruskal AS (
  SELECT 0::BIGINT AS step, (SELECT list(-i ORDER BY i) FROM idx) AS comp, NULL::DOUBLE AS w, NULL::BIGINT AS l, NULL::BIGINT AS r
  UNION ALL
  SELECT step + 1, list_transform(comp, lambda c: CASE WHEN c = comp[m.a] OR c = comp[m.b] THEN step + 1 ELSE c END), m.w, comp[m.a], comp[m.b]
  FROM (SELECT step, comp, min({{'w': e.w, 'a': e.a, 'b': e.b}}) AS m FROM kruskal, e WHERE comp[e.a] <> comp[e.b] GROUP BY step, comp)),
merges AS MATERIALIZED (SELECT step, 1 / w AS lam, l, r, len(list_filter(comp, lambda c: c = step)) AS size FROM kruskal WHERE step > 0),
node AS MATERIALIZED (SELECT n.*, coalesce(a.size, 1) AS sl, coalesce(b.size, 1) AS sr, (sl >= {mcs}) = (sr >= {mcs}) AS starts, sl >= {mcs} AND sr >= {mcs} AS splits
      FROM merges n LEFT JOIN merges a ON a.step = n.l LEFT JOIN merges b ON b.step = n.r),
seg AS (SELECT step, step AS seg FROM node WHERE size >= {mcs} AND starts
        UNION ALL SELECT node.step, seg.seg FROM seg JOIN node ON seg.step IN (node.l, node.r) AND NOT node.starts),
top AS (SELECT seg, max(step) AS last FROM seg GROUP BY seg),
segs AS MATERIALIZED (
  SELECT top.seg, any_value(p.step) AS parent, coalesce(any_value(p.lam), 0) AS birth, max(n.size) AS size,
         sum(n.lam * CASE WHEN n.starts THEN n.size WHEN n.sl >= {mcs} THEN n.sr ELSE n.sl END) - coalesce(any_value(p.lam), 0) * max(n.size) AS stab
  FROM top JOIN seg ON seg.seg = top.seg JOIN node n ON n.step = seg.step LEFT JOIN node p ON top.last IN (p.l, p.r) GROUP BY top.seg),
ord AS (SELECT s.seg, s.parent, s.stab, row_number() OVER (ORDER BY s.seg) AS i FROM segs s),
kid AS (SELECT p.i, list(c.i) AS kids FROM ord p JOIN ord c ON c.parent = p.seg GROUP BY p.i),
best AS (
  SELECT 0::BIGINT AS i, []::DOUBLE[] AS f, NULL::BOOLEAN AS won
  UNION ALL
  SELECT ord.i, list_append(f, CASE WHEN kids IS NULL THEN stab ELSE greatest(stab, f[kids[1]] + f[kids[2]]) END),
         ord.parent IS NOT NULL AND (kids IS NULL OR stab >= f[kids[1]] + f[kids[2]])
  FROM best JOIN ord ON ord.i = best.i + 1 LEFT JOIN kid ON kid.i = ord.i),
anc AS (SELECT seg, seg AS a FROM segs UNION ALL SELECT anc.seg, segs.parent FROM anc JOIN segs ON segs.seg = anc.a WHERE segs.parent IS NOT NULL),
chosen AS (SELECT anc.seg, max(anc.a) AS sel FROM anc JOIN ord ON ord.seg = anc.a JOIN best ON best.i = ord.i AND best.won GROUP BY anc.seg),
climb AS (SELECT -idx.i AS at, idx.row_id, 1::BIGINT AS size FROM idx
          UNION ALL SELECT n.step, climb.row_id, n.size FROM climb JOIN merges n ON climb.at IN (n.l, n.r) WHERE climb.size < {mcs}),
fell AS (SELECT climb.row_id, chosen.sel FROM climb JOIN seg ON seg.step = climb.at LEFT JOIN chosen ON chosen.seg = seg.seg WHERE climb.size >= {mcs}),
num AS (SELECT sel, row_number() OVER (ORDER BY birth, m) - 1 AS grp FROM (SELECT fell.sel, any_value(birth) AS birth, min(row_id) AS m FROM fell JOIN segs ON segs.seg = fell.sel GROUP BY fell.sel)),
lab AS MATERIALIZED (SELECT tr.row_id, coalesce(num.grp, -1)::INTEGER AS predict FROM tr LEFT JOIN fell USING (row_id) LEFT JOIN num USING (sel)),
sid AS (SELECT seg, row_number() OVER (ORDER BY birth, size DESC, seg) - 1 AS id FROM segs),
ctree AS MATERIALIZED (SELECT q.id AS parent, p.id AS child, s.birth AS lam, s.size, num.grp::INTEGER AS grp, s.stab
          FROM segs s JOIN sid p ON p.seg = s.seg JOIN sid q ON q.seg = s.parent LEFT JOIN num ON num.sel = s.seg)"""
