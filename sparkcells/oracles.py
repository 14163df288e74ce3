"""Independent SQL for the registered queries."""

from __future__ import annotations

import re

GENES = ["the", "of", "and", "der", "la", "un"]
CONDITIONS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
IN_GENES = "(" + ", ".join(f"'{g}'" for g in GENES) + ")"

# Documents as cells, tokens as genes.
D = """
d_cnt AS MATERIALIZED (SELECT doc_id::VARCHAR AS cell_id, tok AS gene, count(*)::DOUBLE AS n
  FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS tok FROM documents WHERE doc_id IS NOT NULL)
  WHERE regexp_full_match(tok, '[a-zà-ÿ]{2,12}') GROUP BY ALL),
d_tot AS (SELECT cell_id, sum(n) AS total FROM d_cnt GROUP BY 1),
expr AS MATERIALIZED (SELECT cell_id, gene, ln(1 + 1e4 * n / total) AS value FROM d_cnt JOIN d_tot USING (cell_id)
  WHERE gene IN (SELECT gene FROM d_cnt GROUP BY 1 HAVING count(*) >= 20)),
obs AS (SELECT doc_id::VARCHAR AS cell_id, lang, source, lang || '_' || (substr(source, 4, 9)::INT % 3)::VARCHAR AS lang3
  FROM documents WHERE doc_id IS NOT NULL),
sets AS (SELECT 'short' AS category, gene FROM (SELECT DISTINCT gene FROM expr) WHERE length(gene) <= 3
  UNION ALL SELECT 'with_n', gene FROM (SELECT DISTINCT gene FROM expr) WHERE contains(gene, 'n')),
n_all AS (SELECT count(*)::DOUBLE AS n_all FROM obs)"""

# Vectors as cells, dimensions as genes.
E = """
long AS (SELECT vec_id::VARCHAR AS cell_id, generate_subscripts(embedding, 1) - 1 AS k, unnest(embedding) AS x FROM embeddings),
expr AS (SELECT cell_id, 'd' || lpad(k::VARCHAR, 2, '0') AS gene, x::DOUBLE AS value FROM long WHERE x > 0),
obs AS (SELECT vec_id::VARCHAR AS cell_id, label::VARCHAR AS label, (label % 2)::VARCHAR AS l0, (label % 5)::VARCHAR AS l1,
  (vec_id % 5)::VARCHAR AS batch FROM embeddings),
coords AS (SELECT vec_id::VARCHAR AS cell_id, embedding::DOUBLE[] AS vec FROM embeddings),
dist AS (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.vec, b.vec) AS dist FROM coords a, coords b),
knn AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS place FROM dist) WHERE place <= 10),
knn_other AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS place FROM dist WHERE src <> dst) WHERE place <= 10),
shares AS (SELECT src AS cell_id, label AS grp, count(*) / 10.0 AS share FROM knn JOIN obs ON dst = obs.cell_id GROUP BY ALL),
paths AS (SELECT cell_id, 'g0@' || l0 || '|g1@' || l1 || '|g2@' || label AS path FROM obs),
large AS (SELECT path FROM paths GROUP BY 1 HAVING count(*) >= 50),
known AS (SELECT cell_id, CASE WHEN path IN (SELECT path FROM large) THEN path END AS path FROM paths)"""

# Customers as cells, brands as genes.
L = """
counts AS MATERIALIZED (SELECT o_custkey::VARCHAR AS cell_id, p_brand AS gene, sum(l_quantity) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
tot AS (SELECT cell_id, sum(n) AS total FROM counts GROUP BY 1),
expr AS MATERIALIZED (SELECT cell_id, gene, ln(1 + 1e4 * n / total) AS value FROM counts JOIN tot USING (cell_id)),
obs AS (SELECT c_custkey::VARCHAR AS cell_id, c_nationkey::VARCHAR AS nation, c_mktsegment AS segment FROM customer),
n_all AS (SELECT count(*)::DOUBLE AS n_all FROM obs)"""

V = """
obs AS (SELECT DISTINCT user_id::VARCHAR AS cell_id, (user_id % 6)::VARCHAR AS cluster FROM events)"""


def grid(label: str = "lang", exclude: str = "''", min_cells: int = 0, min_expr: int = 0, drop: int = 0, expr: str = "expr") -> str:
    """groups, sums and the dense grid."""
    return f"""
groups AS (SELECT {label} AS grp, count(*) AS n_cells FROM obs WHERE {label} NOT IN ({exclude}) GROUP BY 1 HAVING count(*) >= {drop}),
sums AS (SELECT {label} AS grp, gene, sum(value) AS total, count(*) AS n_expr FROM {expr} JOIN obs USING (cell_id) GROUP BY ALL),
grid0 AS (SELECT grp, gene, n_cells, CASE WHEN n_cells >= {min_cells} THEN coalesce(n_expr, 0) ELSE 0 END AS n_expr,
  CASE WHEN n_cells >= {min_cells} AND coalesce(n_expr, 0) >= {min_expr} THEN coalesce(total, 0) / n_cells ELSE 0 END AS mean
  FROM groups CROSS JOIN (SELECT DISTINCT gene FROM {expr}) LEFT JOIN sums USING (grp, gene)),
grid AS MATERIALIZED (SELECT *, n_expr / n_cells AS frac_expr,
  CASE WHEN max(mean) OVER (PARTITION BY gene) > 0 THEN mean / max(mean) OVER (PARTITION BY gene) ELSE 0 END AS mean_norm FROM grid0)"""


def near(k: int = 2) -> str:
    """The group graph: the k most similar profiles."""
    return f"""
norms AS (SELECT grp, sqrt(sum(mean * mean)) AS norm FROM grid GROUP BY 1),
weights AS MATERIALIZED (SELECT x.grp AS g1, y.grp AS g2, sum(x.mean * y.mean) / (any_value(p.norm) * any_value(q.norm)) AS weight
  FROM grid x JOIN grid y ON x.gene = y.gene AND x.grp <> y.grp AND x.mean <> 0 AND y.mean <> 0
  JOIN norms p ON p.grp = x.grp JOIN norms q ON q.grp = y.grp GROUP BY ALL),
topk AS (SELECT g1, g2 FROM (SELECT *, row_number() OVER (PARTITION BY g1 ORDER BY round(weight, 9) DESC, g2) AS place FROM weights WHERE weight > 0) WHERE place <= {k}),
edges AS MATERIALIZED (SELECT DISTINCT least(g1, g2) AS a, greatest(g1, g2) AS b FROM topk),
pairs AS MATERIALIZED (SELECT x.gene, CASE WHEN x.mean_norm >= y.mean_norm THEN b ELSE a END AS start,
  CASE WHEN x.mean_norm >= y.mean_norm THEN a ELSE b END AS finish, greatest(x.mean_norm, y.mean_norm) AS high,
  least(x.mean_norm, y.mean_norm) AS low, CASE WHEN x.mean_norm >= y.mean_norm THEN x.frac_expr ELSE y.frac_expr END AS frac
  FROM edges JOIN grid x ON x.grp = a JOIN grid y ON y.grp = b AND y.gene = x.gene)"""


def rises(thres: float = 3.0, low: float = 0.2) -> str:
    return f"""
fc AS MATERIALIZED (SELECT start, finish, gene, (high + 0.001) / (low + 0.001) AS fc, high - low AS delta FROM pairs
  WHERE high >= 0.05 AND high >= 0.5 AND frac >= 0.2 AND low <= {low} AND (high + 0.001) / (low + 0.001) >= {thres})"""


def levels(k: float = 2.0, sigma: str = "sd") -> str:
    spread = {"sd": "stddev_samp(mean_norm)", "iqr": "(quantile_cont(mean_norm, 0.75) - quantile_cont(mean_norm, 0.25)) / 1.349", "mad": "1.4826 * median(away)"}[sigma]
    return f"""
seeds AS (SELECT gene, grp, CASE WHEN min(m) = max(m) THEN min(m) ELSE 0 END AS l1 FROM
  (SELECT gene, start AS grp, -1 AS m FROM fc UNION ALL SELECT gene, finish, 1 FROM fc) GROUP BY ALL),
lab1 AS (SELECT gene, grp, mean_norm, coalesce(l1, 0) AS l1 FROM grid LEFT JOIN seeds USING (gene, grp) WHERE gene IN (SELECT gene FROM seeds)),
lab2 AS (SELECT *, CASE WHEN mean_norm >= min(CASE WHEN l1 = 1 THEN mean_norm END) OVER (PARTITION BY gene) THEN 1
  WHEN mean_norm <= max(CASE WHEN l1 = -1 THEN mean_norm END) OVER (PARTITION BY gene) THEN -1 ELSE 0 END AS l2 FROM lab1),
away AS (SELECT *, abs(mean_norm - median(mean_norm) OVER (PARTITION BY gene, l2)) AS away FROM lab2 WHERE l2 <> 0),
side AS (SELECT gene, l2, count(*) AS n, avg(mean_norm) AS m, CASE WHEN count(*) >= 2 THEN {spread} END AS s FROM away GROUP BY ALL),
limits AS (SELECT p.gene, p.m + {k} * p.s AS lower, q.m - {k} * q.s AS upper FROM side p JOIN side q ON p.gene = q.gene AND p.l2 = -1 AND q.l2 = 1
  WHERE p.n >= 3 AND q.n >= 3 AND q.m - p.m >= 0.2 AND p.m + {k} * p.s < q.m - {k} * q.s),
lab AS MATERIALIZED (SELECT gene, grp, mean_norm, l1, l2, CASE WHEN l2 <> 0 THEN l2 WHEN mean_norm >= upper THEN 1 WHEN mean_norm <= lower THEN -1 ELSE 0 END AS l3
  FROM lab2 LEFT JOIN limits USING (gene))"""


FEATURES = """
marks AS (SELECT gene, count(*) FILTER (WHERE l3 = -1) AS n_low, count(*) FILTER (WHERE l3 = 0) AS n_grey, count(*) FILTER (WHERE l3 = 1) AS n_high,
  min(CASE WHEN l3 = 1 THEN mean_norm END) - max(CASE WHEN l3 = -1 THEN mean_norm END) AS gap FROM lab GROUP BY 1),
features AS (SELECT * FROM marks JOIN (SELECT gene, max(fc) AS max_fc, avg(fc) AS mean_fc, max(delta) AS max_delta,
  avg(CASE WHEN delta > 0 THEN delta END) AS mean_delta, count(*) AS n_edges FROM fc GROUP BY 1) USING (gene))"""

DST = """
dst AS (SELECT grp, gene, coalesce(f, 0) AS max_fc_dst, coalesce(d, 0) AS max_delta_dst FROM grid LEFT JOIN
  (SELECT finish AS grp, gene, max((high + 0.001) / (low + 0.001)) AS f, max(high - low) AS d FROM pairs GROUP BY ALL) USING (grp, gene))"""


def cover(w: str = "n_cells", fall_back: str = "rest") -> str:
    return f"""
ways AS (SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges),
rests AS (SELECT grp, gene, frac_expr AS coverage, CASE WHEN sum({w}) OVER g - {w} > 0
  THEN (sum({w} * frac_expr) OVER g - {w} * frac_expr) / (sum({w}) OVER g - {w}) ELSE 0 END AS rest FROM grid WINDOW g AS (PARTITION BY gene)),
nears AS (SELECT u AS grp, gene, sum({w} * frac_expr) / sum({w}) AS near FROM ways JOIN grid ON grid.grp = v GROUP BY ALL),
cover AS (SELECT grp, gene, coverage, rest, coalesce(near, {fall_back}) AS neighbor FROM rests LEFT JOIN nears USING (grp, gene))"""


SCORES = """
inputs AS (SELECT lab.grp, lab.gene, max_fc_dst, max_delta_dst, coverage, rest, neighbor, gap, n_low, n_grey, n_high
  FROM lab LEFT JOIN dst USING (grp, gene) LEFT JOIN cover USING (grp, gene) LEFT JOIN features USING (gene) WHERE l3 = 1),
local AS (SELECT *, ln(1 + max_fc_dst) * ln(1 + max_delta_dst) * sqrt(coverage) * greatest(0, ln((coverage + 1e-9) / (0.5 * rest + 0.5 * neighbor + 1e-9))) AS local_score,
  (1 + gap) * (1 + ln(1 + n_low)) / ((1 + n_high) * (1 + 0.5 * n_grey) + 1e-9) AS global_score FROM inputs),
scored AS (SELECT *, CASE WHEN global_score >= 0 THEN local_score * sqrt(global_score) END AS specific_weight FROM local)"""


def ranks(score: str, grp: str = "grp") -> str:
    return f"row_number() OVER (PARTITION BY {grp} ORDER BY round({score}, 9) DESC NULLS LAST, gene) AS rank"


def simple(count: int, source: str = "grid", out: str = "elig") -> str:
    return f"""
{out} AS (SELECT * REPLACE (mean / top AS mean_norm) FROM (SELECT *, max(mean) OVER (PARTITION BY gene) AS top FROM {source} WHERE n_expr >= {count}) WHERE top > 0)"""


BY_BATCH = """
cells AS (SELECT lang AS grp, source AS batch, count(*) AS n_cells FROM obs GROUP BY ALL),
b_sums AS (SELECT lang AS grp, source AS batch, gene, sum(value) AS total, count(*) AS n_expr FROM expr JOIN obs USING (cell_id) GROUP BY ALL),
means AS MATERIALIZED (SELECT grp, batch, gene, n_cells, CASE WHEN n_cells >= 5 THEN coalesce(total, 0) / n_cells END AS mean, coalesce(n_expr, 0) / n_cells AS frac
  FROM cells CROSS JOIN (SELECT DISTINCT gene FROM {genes}) LEFT JOIN b_sums USING (grp, batch, gene))"""

CORR = """
sx AS (SELECT segment AS condition, gene, sum(value) AS s, sum(value * value) AS q FROM expr JOIN obs USING (cell_id) GROUP BY ALL),
sxy AS (SELECT segment AS condition, e.gene, sum(e.value * g.value) AS xy FROM expr e JOIN expr g ON g.cell_id = e.cell_id AND g.gene = 'Brand#11' JOIN obs ON obs.cell_id = e.cell_id GROUP BY ALL),
nn AS (SELECT segment AS condition, count(*)::DOUBLE AS n FROM obs GROUP BY 1),
corr AS MATERIALIZED (SELECT sx.condition, sx.gene, CASE WHEN sx.gene = 'Brand#11' THEN 1.0
    ELSE (coalesce(xy, 0) - g.s * sx.s / n) / sqrt((g.q - g.s * g.s / n) * (sx.q - sx.s * sx.s / n)) END AS corr
  FROM sx JOIN sx g ON g.condition = sx.condition AND g.gene = 'Brand#11' LEFT JOIN sxy ON sxy.condition = sx.condition AND sxy.gene = sx.gene JOIN nn ON nn.condition = sx.condition),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY condition ORDER BY round(corr, 9) DESC, gene) AS rank FROM corr
  WHERE corr IS NOT NULL AND gene <> 'Brand#11' AND corr < 1) WHERE rank <= 5),
matrix AS (SELECT gene, """ + ", ".join(f"coalesce(max(CASE WHEN condition = '{c}' THEN corr END), 0) AS \"{c}_corr\"" for c in CONDITIONS) + """ FROM corr WHERE gene IN (SELECT gene FROM top) GROUP BY 1)"""  # fmt: skip


def build(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS \"{n.split('.')[-1]}\"" for n in names)


D_EDGES = (D, grid(), near())
D3_EDGES = (D, grid("lang3"), near())
D3_ALL = (D, grid("lang3"), near(11))
D3_LEVELS = (*D3_ALL, rises(), levels())
D3_SCORES = (*D3_LEVELS, FEATURES, DST, cover(), SCORES)
PAIR = """
sums1 AS (SELECT gene, sum(value) AS s, sum(value * value) AS q FROM expr GROUP BY 1)"""
VARY = "({n} > 1 AND {vx} > 1e-12 * {qx} AND {vy} > 1e-12 * {qy})"
ONE = """
xy AS (SELECT e.gene, sum(e.value * g.value) AS xy FROM expr e JOIN expr g ON g.cell_id = e.cell_id AND g.gene = 'the' GROUP BY 1),
one0 AS (SELECT p.gene, CASE WHEN p.gene = 'the' THEN 1.0 WHEN g.q - g.s * g.s / n_all > 1e-12 * g.q AND p.q - p.s * p.s / n_all > 1e-12 * p.q
    THEN (coalesce(xy, 0) - g.s * p.s / n_all) / sqrt((g.q - g.s * g.s / n_all) * (p.q - p.s * p.s / n_all)) END AS corr, n_all
  FROM sums1 p LEFT JOIN xy USING (gene) CROSS JOIN n_all CROSS JOIN (SELECT * FROM sums1 WHERE gene = 'the') g),
one AS (SELECT *, CASE WHEN abs(corr) < 1 THEN corr * sqrt((n_all - 2) / (1 - corr * corr)) END AS t FROM one0)"""
GG = """
gg AS (SELECT p.gene AS a, q.gene AS b, (coalesce(xy, 0) - p.s * q.s / n_all) / sqrt((p.q - p.s * p.s / n_all) * (q.q - q.s * q.s / n_all)) AS corr
  FROM sums1 p JOIN sums1 q ON p.gene < q.gene CROSS JOIN n_all
  LEFT JOIN (SELECT x.gene AS a, y.gene AS b, sum(x.value * y.value) AS xy FROM expr x JOIN expr y USING (cell_id) WHERE x.gene < y.gene GROUP BY ALL) z ON z.a = p.gene AND z.b = q.gene)"""
ANNO = """
anno AS (SELECT gene, grp, (coalesce(total, 0) - s * n_cells / n_all) / sqrt((q - s * s / n_all) * (n_cells - n_cells::DOUBLE * n_cells / n_all)) AS corr
  FROM sums1 CROSS JOIN groups LEFT JOIN sums USING (gene, grp) CROSS JOIN n_all)"""
BINS = """
axes AS (SELECT cell_id, vec[1] AS x, vec[2] AS y, vec[3] AS z FROM coords),
lows AS (SELECT least(min(x), 0) AS lx, least(min(y), 0) AS ly, least(min(z), 0) AS lz FROM axes),
bins AS (SELECT cell_id, floor((x - lx) * 4 + 4)::BIGINT::VARCHAR || ':' || floor((y - ly) * 4 + 4)::BIGINT::VARCHAR || ':' || floor((z - lz) * 4 + 4)::BIGINT::VARCHAR AS bin
  FROM axes CROSS JOIN lows)"""
SINGLE = """
{out} AS (SELECT * FROM (SELECT *, mean_norm - coalesce(lead(mean_norm) OVER w, 0) AS score, row_number() OVER w AS place FROM {source}
  WINDOW w AS (PARTITION BY gene ORDER BY mean_norm DESC, grp)) WHERE place = 1 AND score > 0.2 AND mean >= 0.2 AND frac_expr >= 0.2)"""
TWO_LEVELS = (
    D, grid(), simple(10), SINGLE.format(out="m0", source="elig"),
    grid("lang3").replace("groups", "groups3").replace("sums", "sums3").replace("grid0", "g3_0").replace("grid AS", "grid3 AS"),
    simple(10, "grid3", "elig3"), SINGLE.format(out="m1", source="elig3"),
    f"""
lev AS (SELECT 'g0' AS resolution, grp, gene, {ranks('score')} FROM m0 UNION ALL SELECT 'g1', grp, gene, {ranks('score')} FROM m1)""",
)
SWEEP = (*D_EDGES, rises(1.0), """
lim AS (SELECT unnest([1.0, 2.0, 5.0, 20.0, 100.0, 5000.0]) AS threshold),
each AS (SELECT threshold, start, finish, count(*) AS pairs, count(DISTINCT gene) AS genes FROM fc JOIN lim ON fc >= threshold GROUP BY ALL),
cov AS (SELECT threshold, sum(pairs) AS n_pairs, count(*) AS n_edges_covered, median(genes) AS median_genes, min(genes) AS min_genes, max(genes) AS max_genes FROM each GROUP BY 1),
gen AS (SELECT threshold, count(DISTINCT gene) AS n_genes, count(DISTINCT CASE WHEN gene IN """ + IN_GENES + """ THEN gene END) AS gt_genes FROM fc JOIN lim ON fc >= threshold GROUP BY 1),
swept AS (SELECT threshold, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_genes, 0) AS n_genes, coalesce(n_edges_covered, 0) AS n_edges_covered,
  (SELECT count(*) FROM (SELECT DISTINCT start, finish FROM fc)) - coalesce(n_edges_covered, 0) AS n_edges_uncovered, coalesce(median_genes, 0) AS median_genes,
  coalesce(min_genes, 0) AS min_genes, coalesce(max_genes, 0) AS max_genes, coalesce(gt_genes, 0) AS gt_genes FROM lim LEFT JOIN cov USING (threshold) LEFT JOIN gen USING (threshold))""")  # fmt: skip
WELCH = (*D_EDGES, rises(), BY_BATCH.format(genes="fc"), """
side AS (SELECT grp, gene, count(mean) AS n, avg(mean) AS m, CASE WHEN count(mean) >= 2 THEN var_samp(mean) END AS v FROM means GROUP BY ALL),
tested AS (SELECT fc.*, coalesce(s.n, 0) AS n_s, coalesce(e.n, 0) AS n_e, e.m - s.m AS diff, s.v / s.n AS a, e.v / e.n AS b
  FROM fc LEFT JOIN side s ON s.grp = start AND s.gene = fc.gene LEFT JOIN side e ON e.grp = finish AND e.gene = fc.gene)""")  # fmt: skip



def level(label: str, name: str, gap: float = 0.02) -> tuple[str, ...]:
    """Single markers of one labelling of the vectors, as a table lev_<name>, and its grid."""
    own = (grid(label) + "," + simple(10) + "," + SINGLE.format(out="m", source="elig").replace("score > 0.2 AND mean >= 0.2", f"score > {gap} AND mean >= {gap}"))
    for word in ("groups", "sums", "grid0", "grid", "elig"):
        own = re.sub(rf"\b{word}\b", f"{word}_{name}", own)
    own = re.sub(r"\bm AS", f"m_{name} AS", own)
    return (own, f"""
lev_{name} AS (SELECT '{name}' AS resolution, grp, gene, {ranks('score')} FROM m_{name})""")


E_LEVELS = (E, *level("l0", "g0"), *level("l1", "g1"), *level("label", "g2"), """
lev AS (SELECT * FROM lev_g0 UNION ALL SELECT * FROM lev_g1 UNION ALL SELECT * FROM lev_g2),
top5 AS (SELECT * FROM lev WHERE rank <= 5)""")
# The paths of at least 20 cells; smaller ones take votes, in at most eight rounds here.
REASSIGN = """
large_n AS (SELECT path FROM paths GROUP BY 1 HAVING count(*) >= {least}),
v0 AS MATERIALIZED (SELECT cell_id, CASE WHEN path IN (SELECT path FROM large_n) THEN path END AS path FROM paths),""" + ",".join(f"""
b{k} AS (SELECT src, arg_min(path, (-n, path)) AS won FROM (SELECT src, w.path, count(*) AS n FROM knn JOIN v{k} o ON o.cell_id = src AND o.path IS NULL
  JOIN v{k} w ON w.cell_id = dst AND w.path IS NOT NULL WHERE src <> dst GROUP BY ALL) GROUP BY 1),
v{k + 1} AS MATERIALIZED (SELECT cell_id, coalesce(path, won) AS path FROM v{k} LEFT JOIN b{k} ON src = cell_id)""" for k in range(8)) + """,
sizes AS (SELECT path, count(*) AS n FROM v8 WHERE path IS NOT NULL GROUP BY 1),
ids AS (SELECT path, n, g0, g1, g2, (row_number() OVER (ORDER BY g0, g1, g2) - 1)::VARCHAR AS icls FROM
  (SELECT path, n, substr(string_split(path, '|')[1], 4) AS g0, substr(string_split(path, '|')[2], 4) AS g1, substr(string_split(path, '|')[3], 4) AS g2 FROM sizes))"""
COMPARE = (*E_LEVELS, REASSIGN.format(least=20), """
chosen AS (SELECT 'g0' AS resolution, 0 AS level, g0 AS grp FROM ids WHERE icls = '0' UNION ALL SELECT 'g1', 1, g1 FROM ids WHERE icls = '0' UNION ALL SELECT 'g2', 2, g2 FROM ids WHERE icls = '0'),
marks AS (SELECT gene, max((level = 0)::BIGINT) AS p0, max((level = 1)::BIGINT) AS p1, max((level = 2)::BIGINT) AS p2 FROM top5 JOIN chosen USING (resolution, grp) GROUP BY 1),
compared AS (SELECT *, row_number() OVER (ORDER BY p0 DESC, p1 DESC, p2 DESC, gene) AS place FROM marks)""")
STRIPS = """
labelled AS (SELECT 'g0' AS resolution, cell_id, l0 AS grp, batch FROM obs UNION ALL SELECT 'g1', cell_id, l1, batch FROM obs UNION ALL SELECT 'g2', cell_id, label, batch FROM obs),
cells AS (SELECT r.resolution, r.grp, b.batch, count(l.cell_id) AS n_cells FROM (SELECT DISTINCT resolution, grp FROM labelled) r CROSS JOIN (SELECT DISTINCT batch FROM obs) b
  LEFT JOIN labelled l ON l.resolution = r.resolution AND l.grp = r.grp AND l.batch = b.batch GROUP BY ALL),
totals AS (SELECT resolution, grp, batch, gene, sum(value) AS total FROM labelled JOIN expr USING (cell_id) GROUP BY ALL),
means AS (SELECT c.*, gene, CASE WHEN n_cells > 0 THEN coalesce(total, 0) / n_cells ELSE 0 END AS mean FROM cells c CROSS JOIN (SELECT DISTINCT gene FROM top5) LEFT JOIN totals USING (resolution, grp, batch, gene)),
shared AS (SELECT *, n_cells > 0 AS active, mean / CASE WHEN max(mean) OVER w > 0 THEN max(mean) OVER w ELSE 1 END AS share FROM means WINDOW w AS (PARTITION BY resolution, grp, gene)),
strips AS (SELECT *, row_number() OVER (PARTITION BY resolution, grp, gene ORDER BY active DESC, share DESC, batch) AS strip FROM shared)"""
MARK = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
SWEEP_AUTO = (*D_EDGES, rises(1.0), """
hi AS (SELECT greatest(quantile_cont(fc, 0.95), 2.0) AS high, (SELECT count(*) FROM (SELECT DISTINCT start, finish FROM fc)) AS total FROM fc),
coarse AS (SELECT k, CASE WHEN k = 9 THEN high ELSE 1.0 + (high - 1.0) * k / 9 END AS threshold FROM hi CROSS JOIN (SELECT unnest(range(10)) AS k)),
open AS (SELECT k, threshold, total - count(DISTINCT (start, finish)) FILTER (WHERE start IS NOT NULL) AS uncovered FROM coarse CROSS JOIN hi LEFT JOIN fc ON fc >= threshold GROUP BY k, threshold, total),
turn AS (SELECT min(k) FILTER (WHERE uncovered > 0) AS k FROM open),
ends AS (SELECT (SELECT threshold FROM coarse WHERE coarse.k = greatest(turn.k - 1, 0)) AS low, (SELECT threshold FROM coarse WHERE coarse.k = least(turn.k + 1, 9)) AS top FROM turn),
lims AS (SELECT CASE WHEN j = 9 THEN top ELSE low + (top - low) * j / 9 END AS threshold FROM ends CROSS JOIN (SELECT unnest(range(10)) AS j) WHERE low IS NOT NULL
  UNION SELECT threshold FROM coarse CROSS JOIN ends WHERE low IS NULL OR threshold > top),
cov AS (SELECT threshold, count(*) AS n_pairs, count(DISTINCT gene) AS n_genes, count(DISTINCT (start, finish)) AS n_edges_covered FROM lims JOIN fc ON fc >= threshold GROUP BY 1)""")

ORACLES: dict[str, str] = {
    "log1p_check": build(D) + " SELECT round(least(min(value), 0), 6) + 0.0 AS low, round(greatest(max(value), 0), 6) + 0.0 AS high, min(value) >= 0 AND max(value) <= 15 AS passes FROM expr",
    "value_check_scaled": build(L) + " SELECT round(least(min(value), 0), 6) + 0.0 AS low, round(greatest(max(value), 0), 6) + 0.0 AS high, min(value) >= 0 AND max(value) <= 30 AS passes FROM expr",
    "qc_metrics": build(L) + " SELECT cell_id, round(sum(n), 6) + 0.0 AS total_counts, count(*) AS n_genes, round(100 * coalesce(sum(n) FILTER (WHERE gene LIKE 'Brand#1%'), 0) / sum(n), 6) + 0.0 AS pct_mt FROM counts GROUP BY 1",
    "qc_filter": build(L) + " SELECT * FROM (SELECT cell_id, round(sum(n), 6) + 0.0 AS total_counts, count(*) AS n_genes, round(100 * coalesce(sum(n) FILTER (WHERE gene LIKE 'Brand#1%'), 0) / sum(n), 6) + 0.0 AS pct_mt FROM counts GROUP BY 1) WHERE total_counts > 200 AND n_genes > 8 AND n_genes < 24 AND pct_mt / 100 < 0.25",
    "normalize_log1p": build(L) + f" SELECT cell_id, gene, {r('value')} FROM expr",
    "remove_geneset": build(D) + " SELECT gene, count(*) AS n FROM expr WHERE gene NOT IN (SELECT gene FROM sets WHERE category = 'short') GROUP BY 1",
    "gene_filter": build(D) + " SELECT DISTINCT gene FROM expr WHERE gene NOT LIKE '%.%' AND gene NOT LIKE 'th%' AND gene NOT LIKE 'é%' AND length(gene) > 3 AND contains(gene, 'n')",
    "group_sizes": build(D) + " SELECT lang AS grp, row_number() OVER (ORDER BY lang) - 1 AS idx, count(*) AS n_cells FROM obs WHERE lang <> 'es' GROUP BY lang",
    "group_stats": build(D, grid()) + f" SELECT grp, gene, n_cells, n_expr, {r('mean', 'frac_expr')} FROM grid",
    "group_stats_min_cells": build(D, grid("lang3", min_cells=100)) + f" SELECT grp, gene, n_cells, n_expr, {r('mean')} FROM grid",
    "group_stats_drop_small": build(D, grid("lang3", drop=100)) + f" SELECT grp, gene, n_cells, n_expr, {r('mean')} FROM grid",
    "group_stats_min_expr": build(D, grid(min_expr=10, exclude="'es'")) + f" SELECT grp, gene, n_expr, {r('mean', 'mean_norm')} FROM grid",
    "group_stats_lineitem": build(L, grid("nation")) + f" SELECT grp, gene, n_cells, n_expr, {r('mean', 'frac_expr', 'mean_norm')} FROM grid",
    "mean_norm": build(D, grid()) + f" SELECT grp, gene, {r('mean_norm')} FROM grid",
    "scaled_layer_means": build(D, grid()) + " SELECT grp, gene, round(mean_norm, 6) + 0.0 AS mean FROM grid",
    "z_scores": build(L) + ", m AS (SELECT gene, sum(value) / any_value(n_all) AS mu, sqrt(greatest(0, sum(value * value) - any_value(n_all) * (sum(value) / any_value(n_all)) ** 2) / (any_value(n_all) - 1)) AS sd FROM expr CROSS JOIN n_all GROUP BY 1) SELECT cell_id, gene, round(least(2, (value - mu) / sd), 6) + 0.0 AS z, round(least(2, -mu / sd), 6) + 0.0 AS zero FROM expr JOIN m USING (gene)",
    "gene_dispersion": build(D, PAIR) + ", v AS (SELECT gene, s / n_all AS mean, greatest(0, q - s * s / n_all) / (n_all - 1) AS variance FROM sums1 CROSS JOIN n_all) SELECT gene, (SELECT count(*) FROM expr e WHERE e.gene = v.gene) AS detected, round(mean, 6) + 0.0 AS mean, round(variance, 6) + 0.0 AS variance, round(variance / mean, 6) + 0.0 AS dispersion FROM v",
    "variable_genes": build(D, PAIR) + ", v AS (SELECT gene, s / n_all AS mean, (q - s * s / n_all) / (n_all - 1) / (s / n_all) AS dispersion FROM sums1 CROSS JOIN n_all), c AS (SELECT gene, count(*) AS detected FROM expr GROUP BY 1) SELECT gene, detected, round(mean, 6) + 0.0 AS mean, round(dispersion, 6) + 0.0 AS dispersion FROM v JOIN c USING (gene) WHERE mean > 0.0125 AND mean < 1 AND dispersion > 5.5 AND detected >= 30",
    "dotplot_table": build(D.replace("obs AS (SELECT", "obs AS (SELECT * FROM (SELECT").replace("FROM documents WHERE doc_id IS NOT NULL),\nsets", "FROM documents WHERE doc_id IS NOT NULL) WHERE lang IN ('en', 'de', 'fr')),\nsets"), grid())
    + ", listed AS (SELECT * FROM (VALUES (0, 'words', 'the'), (1, 'words', 'der'), (2, 'words', 'the'), (4, 'more', 'la')) x(place, section, gene)) SELECT place, section, gene, grp, round(frac_expr, 6) + 0.0 AS size, round(mean_norm, 6) + 0.0 AS colour FROM listed JOIN grid USING (gene)",
    "simple_single": build(D, grid(), simple(10), SINGLE.format(out="m", source="elig")) + f" SELECT grp, gene, {r('score')}, {ranks('score')} FROM m",
    "simple_multiple": build(D, grid(), simple(3)) + ", st AS (SELECT *, lead(mean_norm) OVER w - mean_norm AS step, row_number() OVER w AS height FROM elig WINDOW w AS (PARTITION BY gene ORDER BY mean_norm, grp DESC)), f AS (SELECT gene, arg_max(grp, height) AS grp, arg_max(mean, height) AS mean, arg_max(frac_expr, height) AS frac, arg_min(step, height) FILTER (WHERE step > 0.2) AS score FROM st GROUP BY 1)"
    + f", m AS (SELECT * FROM f WHERE score IS NOT NULL AND mean >= 0.2 AND frac >= 0.2) SELECT grp, gene, {r('score')}, {ranks('score')} FROM m",
    "simple_negative": build(D, grid(), simple(1)) + f", m AS (SELECT * FROM (SELECT grp, gene, lead(mean_norm) OVER w - mean_norm AS score, row_number() OVER w AS place FROM elig WINDOW w AS (PARTITION BY gene ORDER BY mean_norm, grp DESC)) WHERE place = 1 AND score > 0.2) SELECT grp, gene, {r('score')}, {ranks('score')} FROM m",
    "simple_groups": build(D, grid(), simple(0)) + ", m AS (SELECT gene, min(CASE WHEN grp IN ('en', 'de') THEN mean_norm END) - max(CASE WHEN grp NOT IN ('en', 'de') THEN mean_norm END) AS score, min(CASE WHEN grp IN ('en', 'de') THEN mean END) AS least FROM elig GROUP BY 1) SELECT gene, round(score, 6) + 0.0 AS score FROM m WHERE score > 0.2 AND least >= 0.2",
    "topk_edges": build(*D3_EDGES) + f" SELECT g1, g2, {r('weight')} FROM weights WHERE EXISTS (SELECT 1 FROM edges WHERE a = least(g1, g2) AND b = greatest(g1, g2))",
    "group_graph": build(*D3_EDGES) + " SELECT a AS u, b AS v FROM edges UNION ALL SELECT b, a FROM edges",
    "fc_delta": build(*D_EDGES, rises()) + f" SELECT start, finish AS \"end\", gene, {r('fc', 'delta')} FROM fc",
    "edge_gene_matrix": build(*D_EDGES, rises()) + " SELECT start || '->' || finish AS edge, " + ", ".join(f"round(coalesce(max(CASE WHEN gene = '{g}' THEN fc END), 0), 6) + 0.0 AS \"{g}\"" for g in GENES) + " FROM fc GROUP BY 1",
    "gene_edge_map": build(*D_EDGES, rises()) + f" SELECT gene, start, finish AS \"end\", {r('fc')} FROM fc",
    "fc_bins": build(*D_EDGES, rises(1.0, 0.5)) + " SELECT start || '->' || finish AS edge, CASE WHEN fc >= 6 THEN 4 WHEN fc >= 5 THEN 3 WHEN fc >= 4 THEN 2 WHEN fc >= 3 THEN 1 ELSE 0 END::BIGINT AS bin, count(*) AS n FROM fc GROUP BY ALL",
    "dst_gene_max": build(*D_EDGES, DST) + " SELECT grp, gene, round(max_fc_dst, 6) + 0.0 AS max_fc, round(max_delta_dst, 6) + 0.0 AS max_delta FROM dst",
    "coverage": build(*D3_EDGES, cover()) + f" SELECT grp, gene, {r('coverage', 'rest', 'neighbor')} FROM cover",
    "coverage_unweighted": build(D, grid(), near(1), cover("1.0", "0")) + f" SELECT grp, gene, {r('coverage', 'rest', 'neighbor')} FROM cover",
    "label_levels_sd": build(*D3_LEVELS) + " SELECT gene, grp, l1::BIGINT AS l1, l2::BIGINT AS l2, l3::BIGINT AS l3 FROM lab",
    "label_levels_iqr": build(*D3_ALL, rises(), levels(1.0, "iqr")) + " SELECT gene, grp, l1::BIGINT AS l1, l2::BIGINT AS l2, l3::BIGINT AS l3 FROM lab",
    "label_levels_mad": build(*D3_ALL, rises(), levels(1.0, "mad")) + " SELECT gene, grp, l1::BIGINT AS l1, l2::BIGINT AS l2, l3::BIGINT AS l3 FROM lab",
    "gene_features": build(*D3_LEVELS, FEATURES) + f" SELECT gene, n_low, n_grey, n_high, n_edges, {r('max_fc', 'mean_fc', 'max_delta', 'mean_delta', 'gap')} FROM features",
    "marker_scores": build(*D3_SCORES) + f" SELECT grp, gene, {r('max_fc_dst', 'max_delta_dst', 'coverage', 'rest', 'neighbor', 'local_score', 'global_score', 'specific_weight')} FROM scored",
    "marker_rank": build(*D3_SCORES) + f" SELECT grp, gene, round(specific_weight, 6) + 0.0 AS score, {ranks('specific_weight')} FROM scored",
    "marker_counts": build(*D3_SCORES) + " SELECT groups.grp, count(scored.gene) AS n FROM groups LEFT JOIN scored ON scored.grp = groups.grp GROUP BY 1",
    "fc_sweep": build(*SWEEP) + " SELECT round(threshold, 6) + 0.0 AS threshold, round(median_genes, 6) + 0.0 AS median_genes, n_pairs::BIGINT AS n_pairs, n_genes, n_edges_covered, n_edges_uncovered, min_genes, max_genes, gt_genes FROM swept",
    "fc_suggest": build(*SWEEP) + " SELECT coalesce(max(CASE WHEN n_edges_uncovered = 0 THEN threshold END), min(threshold))::DOUBLE AS suggested FROM swept",
    "batch_group_mean": build(D, BY_BATCH.format(genes=f"(SELECT unnest([{', '.join(repr(g) for g in GENES)}]) AS gene)")) + f" SELECT grp, batch, gene, n_cells, {r('mean', 'frac')} FROM means",
    "batch_detail": build(*D_EDGES, rises(), BY_BATCH.format(genes="fc")) + ", e AS (SELECT DISTINCT start, finish FROM fc WHERE finish = 'en' AND gene = 'the') SELECT start, finish AS \"end\", side, batch, n_cells, round(mean, 6) + 0.0 AS mean FROM (SELECT start, finish, 'start' AS side, start AS grp FROM e UNION ALL SELECT start, finish, 'end', finish FROM e) JOIN means USING (grp) WHERE gene = 'the'",
    "welch_t": build(*WELCH) + " SELECT start, finish AS \"end\", gene, CASE WHEN n_s >= 3 AND n_e >= 3 AND a + b > 0 THEN round(diff / sqrt(a + b), 6) + 0.0 END AS t, CASE WHEN n_s >= 3 AND n_e >= 3 AND a + b > 0 THEN round((a + b) * (a + b) / (a * a / (n_s - 1) + b * b / (n_e - 1)), 6) + 0.0 END AS df, n_s AS ttest_n_start, n_e AS ttest_n_end FROM tested",
    "batch_strips": build(E) + ", c AS (SELECT label AS grp, batch, count(*) AS n FROM obs GROUP BY ALL), g AS (SELECT grp, batch, coalesce(n, 0) AS n_cells FROM (SELECT DISTINCT label AS grp FROM obs) CROSS JOIN (SELECT DISTINCT batch FROM obs) LEFT JOIN c USING (grp, batch)), s AS (SELECT label AS grp, batch, gene, sum(value) AS total FROM expr JOIN obs USING (cell_id) GROUP BY ALL), m AS (SELECT grp, gene, batch, n_cells, n_cells > 0 AS active, CASE WHEN n_cells > 0 THEN coalesce(total, 0) / n_cells ELSE 0 END AS mean FROM g CROSS JOIN (SELECT unnest(['d00', 'd07']) AS gene) LEFT JOIN s USING (grp, batch, gene)), h AS (SELECT *, mean / CASE WHEN max(mean) OVER (PARTITION BY grp, gene) > 0 THEN max(mean) OVER (PARTITION BY grp, gene) ELSE 1 END AS share FROM m) SELECT grp, gene, batch, n_cells, active, row_number() OVER (PARTITION BY grp, gene ORDER BY active DESC, share DESC, batch) AS place, round(mean, 6) + 0.0 AS mean, round(share, 6) + 0.0 AS share FROM h",
    "corr_one_vs_all": build(D, PAIR, ONE) + f" SELECT gene, {r('corr', 't')} FROM one",
    "corr_matrix_outer": build(L, CORR) + " SELECT gene, " + ", ".join(f"round(max(CASE WHEN condition = '{c}' THEN corr END), 6) + 0.0 AS \"{c}_corr\"" for c in CONDITIONS) + " FROM corr GROUP BY 1",
    "top_genes": build(L, CORR) + f" SELECT condition, gene, {r('corr')}, rank FROM top",
    "feature_matrix": build(L, CORR) + " SELECT gene, " + ", ".join(f"round(\"{c}_corr\", 6) + 0.0 AS \"{c}_corr\"" for c in CONDITIONS) + " FROM matrix",
    "gene_network": build(L, CORR) + ", p AS (SELECT x.gene AS src, y.gene AS dst, sqrt(" + " + ".join(f"(x.\"{c}_corr\" - y.\"{c}_corr\") ** 2" for c in CONDITIONS) + ") AS dist FROM matrix x JOIN matrix y ON x.gene <> y.gene), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS place FROM p) WHERE place <= 3) SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(min(dist), 6) + 0.0 AS dist, round(1 / (min(dist) + 1e-6), 6) + 0.0 AS weight FROM k GROUP BY 1, 2",
    "corr_gene_gene": build(D, PAIR, GG) + f" SELECT a, b, {r('corr')} FROM gg",
    "network_edges": build(D, PAIR, GG) + f" SELECT a, b, {r('corr')} FROM gg WHERE corr >= 0.3",
    "anno_gene_corr": build(D, grid(), PAIR, ANNO) + f" SELECT gene, grp, {r('corr')} FROM anno",
    "anno_gene_colour": build(D, grid(), PAIR, ANNO) + ", b AS (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY corr DESC, grp) AS place FROM anno) SELECT gene, CASE WHEN corr > 0.4 THEN grp END AS grp, round(corr, 6) + 0.0 AS corr FROM b WHERE place = 1",
    "knn_cells": build(E) + f" SELECT src, dst, {r('dist')}, place FROM knn",
    "impute_neighbor": build(E) + " SELECT src AS cell_id, gene, round(sum(value) / 10, 6) + 0.0 AS value FROM knn JOIN expr ON dst = cell_id GROUP BY 1, 2",
    "impute_anno": build(E) + " SELECT cell_id, grp, round(share, 6) + 0.0 AS share FROM shares",
    "group_connectivity": build(E) + ", bt AS (SELECT p.label AS g1, q.label AS g2, count(*) AS n FROM knn_other JOIN obs p ON p.cell_id = src JOIN obs q ON q.cell_id = dst GROUP BY ALL), sz AS (SELECT label AS grp, count(*) AS c FROM obs GROUP BY 1), en AS (SELECT g1 AS grp, sum(n) AS e FROM bt GROUP BY 1), g AS (SELECT grp, c, coalesce(e, 0) AS e FROM sz LEFT JOIN en USING (grp)), bo AS (SELECT g1, g2, sum(n) AS n FROM (SELECT g1, g2, n FROM bt WHERE g1 <> g2 UNION ALL SELECT g2, g1, n FROM bt WHERE g1 <> g2) GROUP BY ALL) SELECT g1, g2, round(least(1, n / ((p.e * q.c + q.e * p.c) / ((SELECT sum(c) FROM sz) - 1))), 6) + 0.0 AS weight FROM bo JOIN g p ON p.grp = g1 JOIN g q ON q.grp = g2",
    "grid_bins": build(E, BINS) + " SELECT cell_id, bin FROM bins",
    "grid_bin_counts": build(E, BINS) + " SELECT bin, count(*) AS n FROM bins GROUP BY 1",
    "hierarchy_paths": build(E) + " SELECT path, count(*) AS n FROM paths GROUP BY 1",
    "hierarchy_small_paths": build(E) + " SELECT cell_id, path FROM known",
    "hierarchy_vote": build(E) + ", v AS (SELECT src, w.path, count(*) AS n FROM knn JOIN known o ON o.cell_id = src AND o.path IS NULL JOIN known w ON w.cell_id = dst AND w.path IS NOT NULL WHERE src <> dst GROUP BY ALL), b AS (SELECT src, path AS won FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, path) AS place FROM v) WHERE place = 1) SELECT cell_id, coalesce(path, won) AS path FROM known LEFT JOIN b ON src = cell_id",
    "path_ids": build(E) + ", c AS (SELECT path, count(*) AS n FROM known WHERE path IS NOT NULL GROUP BY 1), s AS (SELECT path, n, substr(string_split(path, '|')[1], 4) AS g0, substr(string_split(path, '|')[2], 4) AS g1, substr(string_split(path, '|')[3], 4) AS g2 FROM c) SELECT path, g0, g1, g2, n, (row_number() OVER (ORDER BY g0, g1, g2) - 1)::VARCHAR AS icls FROM s",
    "marker_rank_topn": build(*TWO_LEVELS) + ", k AS (SELECT resolution, grp, gene, row_number() OVER (PARTITION BY resolution, grp ORDER BY rank, gene) AS rank FROM lev WHERE gene NOT LIKE 'th%') SELECT * FROM k WHERE rank <= 8",
    "compare_presence": build(*TWO_LEVELS) + ", k AS (SELECT * FROM lev WHERE rank <= 20), p AS (SELECT gene, max((resolution = 'g0' AND grp = 'en')::BIGINT) AS p0, max((resolution = 'g1' AND grp = 'en_0')::BIGINT) AS p1, max((resolution = 'g1' AND grp = 'en_1')::BIGINT) AS p2 FROM k GROUP BY 1) SELECT gene, p0, p1, p2, row_number() OVER (ORDER BY p0 DESC, p1 DESC, p2 DESC, gene) AS place FROM p WHERE p0 + p1 + p2 > 0",
    "icls_centroids": build(E) + " SELECT label AS grp, round(median(vec[1]), 6) + 0.0 AS x, round(median(vec[2]), 6) + 0.0 AS y FROM coords JOIN obs USING (cell_id) GROUP BY 1",
    "group_order": "WITH g AS (SELECT DISTINCT label::VARCHAR AS grp FROM embeddings UNION SELECT DISTINCT lang FROM documents) SELECT grp, row_number() OVER (ORDER BY try_cast(grp AS BIGINT) NULLS LAST, grp) AS place FROM g",
    "annotator_update": build(V) + " SELECT cell_id, cluster, CASE WHEN cluster IN ('3', '4') THEN 'mid' WHEN cluster IN ('1', '2') THEN 'low' WHEN cluster = '5' THEN 'top' ELSE 'unknown' END AS label FROM obs",
    "annotator_summary": build(V) + " SELECT CASE WHEN cluster IN ('0', '1') THEN 'first' ELSE cluster END AS label, count(*) AS n FROM obs GROUP BY 1",
    "update_label": build(V) + " SELECT cell_id, CASE WHEN cell_id::BIGINT % 3 = 0 AND cluster <> '4' THEN 'c' || cluster ELSE 'unknown' END AS label FROM obs",
    "remove_minor": build(D) + " SELECT cell_id, lang3, CASE WHEN count(*) OVER (PARTITION BY lang3) >= 100 THEN lang3 ELSE 'none' END AS lang3_major FROM obs",
    "fill_columns": "WITH d AS (SELECT doc_id::VARCHAR AS cell_id, lang, source, lang || '_' || (substr(source, 4, 9)::INT % 3)::VARCHAR AS lang3 FROM documents WHERE lang = 'es') SELECT DISTINCT user_id::VARCHAR AS cell_id, (user_id % 6)::VARCHAR AS cluster, 'nan' AS lang, 'nan' AS source, 'nan' AS lang3 FROM events UNION ALL SELECT cell_id, 'nan', lang, source, lang3 FROM d",
    "predict_high": build(E) + " SELECT cell_id, coalesce(arg_max(grp, grp::INT) FILTER (WHERE share > 0.25), 'None') AS label FROM shares GROUP BY 1",
    "select_groups": build(D) + " SELECT lang, count(*) AS n FROM obs WHERE lang NOT IN ('es', 'fr') GROUP BY 1",
    "common_genes": build(D) + " SELECT gene FROM expr JOIN obs USING (cell_id) WHERE lang IN ('en', 'fr') GROUP BY 1 HAVING count(DISTINCT lang) = 2",
    "roc_auc": build(E) + ", sh AS (SELECT src AS cell_id, label AS grp, count(*) / 10.0 AS share FROM knn_other JOIN obs ON dst = obs.cell_id GROUP BY ALL), ev AS (SELECT o.cell_id, c.grp AS class, coalesce(share, 0) AS p, o.label = c.grp AS hit FROM obs o CROSS JOIN (SELECT DISTINCT label AS grp FROM obs) c LEFT JOIN sh ON sh.cell_id = o.cell_id AND sh.grp = c.grp) SELECT x.class, round(avg(CASE WHEN x.p > y.p THEN 1.0 WHEN x.p = y.p THEN 0.5 ELSE 0.0 END), 6) + 0.0 AS auc FROM ev x JOIN ev y ON x.class = y.class AND x.hit AND NOT y.hit GROUP BY 1",
    "event_counts": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM events GROUP BY 1, 2",
    "rank_genes": build(D, grid(), PAIR) + ", qs AS (SELECT lang AS grp, gene, sum(value * value) AS own_q FROM expr JOIN obs USING (cell_id) GROUP BY ALL), d AS (SELECT grp, gene, n_cells::DOUBLE AS n, (SELECT sum(n_cells) FROM groups) - n_cells AS m, coalesce(total, 0) AS a_s, coalesce(own_q, 0) AS a_q, s - coalesce(total, 0) AS b_s, q - coalesce(own_q, 0) AS b_q FROM groups CROSS JOIN sums1 LEFT JOIN sums USING (grp, gene) LEFT JOIN qs USING (grp, gene)), v AS (SELECT *, a_s / n - b_s / m AS step, greatest(0, a_q - a_s * a_s / n) / (n - 1) / n AS a, greatest(0, b_q - b_s * b_s / m) / (m - 1) / m AS b FROM d) SELECT grp, gene, round(step / sqrt(a + b), 6) + 0.0 AS t, round((a + b) * (a + b) / (a * a / (n - 1) + b * b / (m - 1)), 6) + 0.0 AS df FROM v",
    "normalize_zero_fill": build(D) + f" SELECT o.cell_id, lang, g.gene, round(coalesce(value, 0), 6) + 0.0 AS value FROM obs o CROSS JOIN (SELECT unnest([{', '.join(repr(g) for g in GENES)}]) AS gene) g LEFT JOIN expr e ON e.cell_id = o.cell_id AND e.gene = g.gene WHERE lang IN ('en', 'de')",
    "bundled_gene_sets": "SELECT category, n::BIGINT AS n, n_distinct::BIGINT AS n_distinct FROM (VALUES ('cc_genes_s', 43, 43), ('cc_genes_m', 55, 54), ('B_follicular', 10, 10), ('B_memory', 10, 10), ('B_naive', 10, 10), ('B_plasma', 10, 10)) x(category, n, n_distinct)",
    "fc_sweep_auto": build(*SWEEP_AUTO) + " SELECT round(threshold, 6) + 0.0 AS threshold, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_genes, 0) AS n_genes, coalesce(n_edges_covered, 0) AS n_edges_covered, total - coalesce(n_edges_covered, 0) AS n_edges_uncovered FROM lims CROSS JOIN hi LEFT JOIN cov USING (threshold)",
    "grid_sample": build(E, BINS) + " SELECT cell_id, bin FROM (SELECT *, count(*) OVER (PARTITION BY bin) AS n, row_number() OVER (PARTITION BY bin ORDER BY substr(md5('0:' || cell_id), 1, 15), cell_id) AS place FROM bins) WHERE n >= 2 AND place <= 5",
    "class_sample": build(D) + f", c AS (SELECT cell_id, lang AS grp, {MARK.format("'0:' || cell_id")} AS mark, count(*) OVER (PARTITION BY lang) AS n FROM obs WHERE lang IS NOT NULL), p AS (SELECT cell_id, grp, count(*) OVER (PARTITION BY grp) AS n, row_number() OVER (PARTITION BY grp ORDER BY mark, cell_id) AS place FROM c WHERE mark < least(1.0, 3200.0 / n) * 1152921504606846976.0), w AS (SELECT grp, n, unnest(range(50))::INT AS draw FROM (SELECT DISTINCT grp, n FROM p)) SELECT draw, p.grp, cell_id FROM w JOIN p ON p.grp = w.grp AND place = {MARK.format("'0:' || w.grp || ':' || draw::VARCHAR")} % w.n + 1",
    "hierarchy_reassign": build(E, REASSIGN.format(least=50)) + " SELECT cell_id, icls FROM v8 LEFT JOIN ids USING (path)",
    "hierarchy_compare": build(*COMPARE) + " SELECT gene, p0, p1, p2, place FROM compared",
    "hierarchy_compare_batch": build(*COMPARE, STRIPS) + ", x AS (SELECT place, gene, level, resolution, grp, CASE level WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS present FROM compared CROSS JOIN chosen) SELECT gene, x.grp, batch, n_cells, active, place, level::BIGINT AS level, present, strip, round(share, 6) + 0.0 AS share FROM x JOIN strips USING (resolution, grp, gene)",
    "viewer_payload": build(*E_LEVELS, "known20 AS (SELECT cell_id, path FROM paths WHERE path IN (SELECT path FROM paths GROUP BY 1 HAVING count(*) >= 20)), sz AS (SELECT path, count(*) AS n FROM known20 GROUP BY 1), ix AS (SELECT path, n, g0, g1, g2, (row_number() OVER (ORDER BY g0, g1, g2) - 1)::VARCHAR AS icls FROM (SELECT path, n, substr(string_split(path, '|')[1], 4) AS g0, substr(string_split(path, '|')[2], 4) AS g1, substr(string_split(path, '|')[3], 4) AS g2 FROM sz)), xy AS (SELECT path, median(vec[1]) AS x, median(vec[2]) AS y FROM known20 JOIN coords USING (cell_id) GROUP BY 1), gs AS (SELECT resolution, grp, string_agg(gene, ',' ORDER BY rank, gene) AS genes FROM top5 GROUP BY 1, 2)")
    + " SELECT icls, path, n, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, " + ", ".join(f"coalesce(s{k}.genes, '') AS genes_g{k}" for k in range(3)) + " FROM ix JOIN xy USING (path) " + " ".join(f"LEFT JOIN gs s{k} ON s{k}.resolution = 'g{k}' AND s{k}.grp = g{k}" for k in range(3)),
    "roc_points": build(E) + ", sh AS (SELECT src AS cell_id, count(*) / 10.0 AS share FROM knn_other JOIN obs ON dst = obs.cell_id WHERE label = '3' GROUP BY 1), ev AS (SELECT coalesce(share, 0) AS p, label = '3' AS hit FROM obs LEFT JOIN sh USING (cell_id)) SELECT round(t.p, 6) + 0.0 AS threshold, round(count(*) FILTER (WHERE NOT hit AND ev.p >= t.p) / greatest(1, count(*) FILTER (WHERE NOT hit)), 6) + 0.0 AS fpr, round(count(*) FILTER (WHERE hit AND ev.p >= t.p) / greatest(1, count(*) FILTER (WHERE hit)), 6) + 0.0 AS tpr FROM (SELECT DISTINCT p FROM ev) t CROSS JOIN ev GROUP BY t.p",
    "resolve_expression": build(L) + " SELECT 'raw' AS source, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM expr",
    "qc_mito": build(L) + " SELECT cell_id, round(sum(n), 6) + 0.0 AS total_counts, count(*) AS n_genes, round(100 * coalesce(sum(n) FILTER (WHERE gene LIKE 'Brand#1%'), 0) / sum(n), 6) + 0.0 AS pct_mt FROM counts GROUP BY 1",
    "read_process": build(L) + ", q AS (SELECT cell_id, sum(n) AS t, count(*) AS g, coalesce(sum(n) FILTER (WHERE gene LIKE 'Brand#1%'), 0) / sum(n) AS mt FROM counts GROUP BY 1) SELECT cell_id, CASE WHEN gene LIKE 'Brand#1%' THEN 'MT-' || gene ELSE gene END AS gene, round(n, 6) + 0.0 AS n FROM counts JOIN q USING (cell_id) WHERE t > 200 AND g > 8 AND g < 24 AND mt < 0.25",
    "process_total": build(L) + " SELECT cell_id, gene, round(1e4 * n / total, 6) + 0.0 AS value FROM counts JOIN tot USING (cell_id)",
    "process_variable": build(D) + ", e AS (SELECT cell_id, gene, ln(1 + 1e4 * n / total) AS value FROM d_cnt JOIN d_tot USING (cell_id)), k AS (SELECT count(*)::DOUBLE AS k FROM d_tot), s AS (SELECT gene, sum(value) / any_value(k) AS m, greatest(0, sum(value * value) - sum(value) * sum(value) / any_value(k)) / (any_value(k) - 1) AS v, count(*) AS n, sum(value) AS total FROM e CROSS JOIN k GROUP BY 1) SELECT gene, n, round(total, 6) + 0.0 AS total FROM s WHERE m > 0.0125 AND m < 3 AND v / m > 0.5 AND gene NOT IN ('the', 'of')",
    "process_scaled": build(L) + ", c AS (SELECT count(DISTINCT cell_id) AS c FROM counts) SELECT 'expr' AS name, count(*) AS n FROM expr UNION ALL SELECT 'scaled', count(*) FROM expr UNION ALL SELECT 'pca', c FROM c UNION ALL SELECT 'knn', c * 3 FROM c",
    "simple_markers": build(D, grid(), simple(10), SINGLE.format(out="m", source="elig")) + f" SELECT * FROM (SELECT grp, gene, {r('score')}, {ranks('score')} FROM m) WHERE grp = 'en' AND rank <= 10",
    "corr_store": build(L, CORR) + f" SELECT condition, gene, round(corr, 6) + 0.0 AS corr, round(corr * sqrt((n - 2) / (1 - corr * corr)), 6) + 0.0 AS t, n::BIGINT AS n FROM corr JOIN nn USING (condition) WHERE condition IN ('BUILDING', 'MACHINERY') AND gene <> 'Brand#11'",
    "clustermap_genes": build(L, CORR) + " SELECT gene, " + ", ".join(f"round(\"{c}_corr\", 6) + 0.0 AS \"{c}_corr\"" for c in CONDITIONS) + " FROM matrix ORDER BY round((" + " + ".join(f"abs(\"{c}_corr\")" for c in CONDITIONS) + ") / 5, 9) DESC, gene LIMIT 7",
    "graph_nodes": build(D, grid("lang3")) + " SELECT grp, n_cells, round(sqrt(n_cells) * 10, 6) + 0.0 AS size FROM groups",
    "graph_gene_edges": build(*D3_ALL, rises()) + ", w AS (SELECT a AS start, b AS finish FROM edges UNION ALL SELECT b, a FROM edges) SELECT w.start, w.finish AS \"end\", round(fc, 6) + 0.0 AS fc, CASE WHEN fc >= 6 THEN 4 WHEN fc >= 5 THEN 3 WHEN fc >= 4 THEN 2 WHEN fc >= 3 THEN 1 ELSE 0 END::BIGINT AS bin FROM w LEFT JOIN fc ON fc.start = w.start AND fc.finish = w.finish AND gene = 'der'",
    "node_cast": build(E, grid("label"), near()) + " SELECT a::BIGINT AS a, b::BIGINT AS b FROM edges",
    "marker_rank_fn": build(*D3_SCORES) + f" SELECT * FROM (SELECT grp, gene, round(local_score, 6) + 0.0 AS score, {ranks('local_score')} FROM scored) WHERE rank <= 10",
    "drawn_values": build(E) + " SELECT o.cell_id, g.gene, round(vec[1], 6) + 0.0 AS x, round(vec[2], 6) + 0.0 AS y, round(coalesce(value, 0), 6) + 0.0 AS value FROM obs o JOIN coords USING (cell_id) CROSS JOIN (SELECT unnest(['d00', 'd07', 'none']) AS gene) g LEFT JOIN expr e ON e.cell_id = o.cell_id AND e.gene = g.gene WHERE label NOT IN ('0', '1')",
    "node_colours": build(D, grid("lang3")) + " SELECT grp, round(mean_norm, 6) + 0.0 AS value, round(coalesce((mean_norm - min(mean_norm) OVER ()) / nullif(max(mean_norm) OVER () - min(mean_norm) OVER (), 0), 0), 6) + 0.0 AS colour FROM grid WHERE gene = 'der'",
    "gene_network_cosine": build(L, CORR) + ", p AS (SELECT x.gene AS src, y.gene AS dst, 1 - (" + " + ".join(f"x.\"{c}_corr\" * y.\"{c}_corr\"" for c in CONDITIONS) + ") / (sqrt(" + " + ".join(f"x.\"{c}_corr\" ** 2" for c in CONDITIONS) + ") * sqrt(" + " + ".join(f"y.\"{c}_corr\" ** 2" for c in CONDITIONS) + ")) AS dist FROM matrix x JOIN matrix y ON x.gene <> y.gene), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS place FROM p) WHERE place <= 3) SELECT least(src, dst) AS a, greatest(src, dst) AS b, round(min(dist), 6) + 0.0 AS dist FROM k GROUP BY 1, 2",
    "knn_probed": build(E) + f" SELECT src, dst, {r('dist')}, place FROM knn",
}
ORACLES["corr_store_network"] = ORACLES["gene_network"]
