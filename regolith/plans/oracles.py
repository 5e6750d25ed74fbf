"""SQL for the registered queries that SQL can express, over the driver's tables."""

from __future__ import annotations

import math

from ..operators.fits import affine_sql
from ..operators.metrics import COARSE, GRADES
from ..sources.adapters import PIXELS_SQL, sql_of
from .queries import FRAME, HYPOTHESES

ORACLES: dict[str, str] = {}
_SUMS = ("count(*)::DOUBLE AS n, sum(x) AS sx, sum(y) AS sy, sum(u) AS su, sum(v) AS sv, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy, "
         "sum(x * u) AS sxu, sum(y * u) AS syu, sum(x * v) AS sxv, sum(y * v) AS syv")  # fmt: skip
_OWN = {"n": "1", "sx": "x", "sy": "y", "su": "u", "sv": "v", "sxx": "x * x", "syy": "y * y", "sxy": "x * y", "sxu": "x * u", "syu": "y * u", "sxv": "x * v", "syv": "y * v"}
_DEN = "(sxx - sx * sx / n + syy - sy * sy / n)"
_RE, _IM = f"(sxu - sx * su / n + syv - sy * sv / n) / {_DEN}", f"(sxv - sx * sv / n - (syu - sy * su / n)) / {_DEN}"


def fx(e: str, scale: str = "1e4") -> str:
    return f"CAST(floor(({e}) * {scale} + 0.5) AS BIGINT)"


def _dist(a: str, b: str, p: tuple[str, str] = ("cx", "cy"), q: tuple[str, str] = ("cx", "cy")) -> str:
    return f"sqrt(({a}.{p[0]} - {b}.{q[0]}) * ({a}.{p[0]} - {b}.{q[0]}) + ({a}.{p[1]} - {b}.{q[1]}) * ({a}.{p[1]} - {b}.{q[1]}))"


def _same(k: float) -> str:
    return f"{_dist('a', 'b')} < {k} * greatest(a.r, b.r) AND a.r / b.r > 0.6 AND a.r / b.r < 1.67"


_BASE = f"ref AS ({sql_of('craters_ref')}), tgt AS ({sql_of('craters_tgt')})"
_DET, _ANN = f"det AS ({sql_of('detections')})", f"ann AS ({sql_of('annotations')})"
_NODES, _GRID, _PX = f"nodes AS ({sql_of('residual_nodes')})", f"grid AS ({sql_of('geo_grid')})", f"px AS ({PIXELS_SQL})"


def put(name: str, select: str, *ctes: str, recursive: bool = False) -> None:
    ORACLES[name] = f"WITH {'RECURSIVE ' * recursive}{', '.join(ctes)} {select}" if ctes else select


put("crater_select_pattern", f"""SELECT image_id, crater_id, row_number() OVER (PARTITION BY image_id ORDER BY r DESC, crater_id) AS rank FROM ref
WHERE r >= 8 AND r <= 0.35 * {FRAME} AND cx - 0.7 * r >= 0 AND cy - 0.7 * r >= 0 AND cx + 0.7 * r <= {FRAME} AND cy + 0.7 * r <= {FRAME} QUALIFY rank <= 80""", _BASE)
put("crater_same_pairs", f"SELECT a.image_id, a.det_id AS i, b.det_id AS j FROM det a JOIN det b ON a.image_id = b.image_id AND a.det_id < b.det_id AND {_same(0.5)}", _DET)
for name, word in (("crater_unlabelled_anti", "NOT EXISTS"), ("crater_labelled_semi", "EXISTS")):
    put(name, f"SELECT det_id, image_id FROM det a WHERE {word} (SELECT 1 FROM ann b WHERE a.image_id = b.image_id AND {_same(0.7)})", _DET, _ANN)


def _knn(src: str) -> str:
    return f"""SELECT image_id, i, j, d, row_number() OVER (PARTITION BY image_id, i ORDER BY d, j) AS rank FROM (
    SELECT a.image_id, a.crater_id AS i, b.crater_id AS j, {_dist('a', 'b')} AS d FROM {src} a JOIN {src} b ON a.image_id = b.image_id AND a.crater_id <> b.crater_id) p QUALIFY rank <= 8"""


put("knn_neighbours", f"SELECT image_id, i, j, {fx('d')} AS d, rank FROM ({_knn('ref')}) k", _BASE)

_TRUTH = "truth AS (SELECT DISTINCT image_id, 0.9396926207859084e0 * 0.8e0 AS re, 0.3420201433256687e0 * 0.8e0 AS im, 60e0 AS tx, 90e0 AS ty, 0.8e0 AS s FROM ref)"


def _near(name: str, sims: str, keys: str, thr: str, low: float, high: float) -> str:
    """CTEs: `name`_near (nearest, then tested) and `name` (one to one). Targets beyond the largest distance that any test accepts are left out early."""
    own = ", ".join("p." + k for k in keys.split(", "))
    return f"""{name}_pts AS (SELECT {', '.join('s.' + k for k in keys.split(', '))}, c.crater_id AS i, s.re * c.cx - s.im * c.cy + s.tx AS px, s.im * c.cx + s.re * c.cy + s.ty AS py, c.r, s.s FROM {sims} s JOIN ref c ON s.image_id = c.image_id),
{name}_all AS (SELECT {own}, p.i, t.crater_id AS j, t.r / (p.r * p.s) AS ratio, t.r AS rb, {_dist('p', 't', ('px', 'py'))} AS d FROM {name}_pts p JOIN thr h ON h.image_id = p.image_id
    JOIN tgt t ON p.image_id = t.image_id AND abs(p.px - t.cx) <= h.reach AND abs(p.py - t.cy) <= h.reach),
{name}_one AS (SELECT * FROM {name}_all QUALIFY row_number() OVER (PARTITION BY {keys}, i ORDER BY d, j) = 1),
{name}_near AS (SELECT n.* FROM {name}_one n JOIN thr USING (image_id) WHERE d < greatest({thr}, 0.3 * rb) AND ratio > {low} AND ratio < {high}),
{name} AS (SELECT * FROM {name}_near QUALIFY row_number() OVER (PARTITION BY {keys}, j ORDER BY d, i) = 1)"""


_THR = "thr AS (SELECT image_id, greatest(5e0, 0.1 * median(r)) AS thr, greatest(5e0, 0.1 * median(r), 0.3 * max(r)) AS reach FROM tgt GROUP BY image_id)"
_FIX = _near("m", "truth", "image_id", "5e0", 0.72, 1.39)
_MATCH = _near("m", "truth", "image_id", "thr", 0.72, 1.39)
put("nearest_join_sized", f"SELECT image_id, i, j, {fx('d')} AS d FROM m_near", _BASE, _TRUTH, _THR, _FIX)
put("one_to_one_pairs", f"SELECT image_id, i, j, {fx('d')} AS d FROM m", _BASE, _TRUTH, _THR, _FIX)
put("point_in_circle", f"""SELECT p.image_id, p.crater_id AS point_id, arg_min(c.crater_id, (c.r, c.crater_id)) AS crater_id FROM tgt p JOIN ref c ON p.image_id = c.image_id AND {_dist('p', 'c')} < 1.1 * c.r
GROUP BY p.image_id, p.crater_id""", _BASE)


def _tri(name: str, src: str, corners: str, side: float) -> str:
    """CTE `name` of described triangles from corners (image_id, lo, mid, hi)."""
    return f"""{name}_c AS ({corners}),
{name}_s AS (SELECT c.*, p.cx AS x0, p.cy AS y0, p.r AS r0, q.cx AS x1, q.cy AS y1, q.r AS r1, o.cx AS x2, o.cy AS y2, o.r AS r2 FROM {name}_c c
    JOIN {src} p ON p.image_id = c.image_id AND p.crater_id = lo JOIN {src} q ON q.image_id = c.image_id AND q.crater_id = mid JOIN {src} o ON o.image_id = c.image_id AND o.crater_id = hi),
{name}_o AS (SELECT *, list_sort([{{'s': sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)), 'v': lo, 'r': r0, 'x': x0, 'y': y0}}, {{'s': sqrt((x0 - x2) * (x0 - x2) + (y0 - y2) * (y0 - y2)), 'v': mid, 'r': r1, 'x': x1, 'y': y1}},
    {{'s': sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)), 'v': hi, 'r': r2, 'x': x2, 'y': y2}}]) AS c, abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) / 2e0 AS area FROM {name}_s),
{name} AS (SELECT image_id, lo, mid, hi, c, c[1].v AS v0, c[2].v AS v1, c[3].v AS v2, c[1].s / c[3].s AS d0, c[2].s / c[3].s AS d1, c[1].r / c[3].s AS d2, c[2].r / c[3].s AS d3, c[3].r / c[3].s AS d4,
    row_number() OVER (PARTITION BY image_id ORDER BY lo, mid, hi) AS tri FROM {name}_o WHERE c[1].s / c[3].s > {side} AND area / (c[3].s * c[3].s) > 0.05)"""


def _knn_tri(name: str, src: str) -> str:
    corners = f"""SELECT DISTINCT image_id, l[1] AS lo, l[2] AS mid, l[3] AS hi FROM (SELECT a.image_id, list_sort([a.i, a.j, b.j]) AS l FROM {name}_k a JOIN {name}_k b ON a.image_id = b.image_id AND a.i = b.i AND a.j < b.j) t"""
    return f"{name}_k AS ({_knn(src)}), {_tri(name, src, corners, 0.22)}"


_SHOWN = f"image_id, lo, mid, hi, v0, v1, v2, {', '.join(f'{fx(c)} AS {c}' for c in ('d0', 'd1', 'd2', 'd3', 'd4'))}"
put("triangles_knn", f"SELECT {_SHOWN} FROM ta", _BASE, _knn_tri("ta", "ref"))
_TOP = "top AS (SELECT * FROM ref QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY r DESC, crater_id) <= 45)"
_ALL = "SELECT a.image_id, a.crater_id AS lo, b.crater_id AS mid, c.crater_id AS hi FROM top a JOIN top b ON a.image_id = b.image_id AND a.crater_id < b.crater_id JOIN top c ON c.image_id = b.image_id AND b.crater_id < c.crater_id"
put("triangles_all", f"SELECT {_SHOWN} FROM ta", _BASE, _TOP, _tri("ta", "ref", _ALL, 0.2))

_DIFF = "greatest(abs(a.d0 - b.d0), abs(a.d1 - b.d1), abs(a.d2 - b.d2), abs(a.d3 - b.d3), abs(a.d4 - b.d4))"
_ALIKE = f"{_knn_tri('ta', 'ref')}, {_knn_tri('tb', 'tgt')}, alike AS (SELECT a.image_id, a.tri AS i, b.tri AS j, {_DIFF} AS diff, a.c AS ca, b.c AS cb FROM ta a JOIN tb b ON a.image_id = b.image_id AND {_DIFF} <= 0.06)"
_HYP = f"hyp AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY diff, i, j) AS hyp FROM alike QUALIFY hyp <= {HYPOTHESES})"
put("lookalike_join", f"SELECT image_id, i, j, {fx('diff', '1e6')} AS diff FROM alike", _BASE, _ALIKE)
put("top_hypotheses", f"SELECT image_id, hyp, i, j, {fx('diff', '1e6')} AS diff FROM hyp", _BASE, _ALIKE, _HYP)


def _sim(name: str, pairs: str, keys: str) -> str:
    return f"""{name}_q AS (SELECT {keys}, {_SUMS} FROM {pairs} GROUP BY {keys}), {name}_r AS (SELECT *, {_RE} AS re, {_IM} AS im FROM {name}_q WHERE n >= 2 AND {_DEN} > 1e-9),
{name} AS (SELECT {keys}, CAST(n AS BIGINT) AS n, re, im, (su - re * sx + im * sy) / n AS tx, (sv - im * sx - re * sy) / n AS ty, sqrt(re * re + im * im) AS s FROM {name}_r)"""


def _placed(name: str, pairs: str) -> str:
    return f"""{name} AS (SELECT p.image_id, p.i, p.j, a.cx AS x, a.cy AS y, b.cx AS u, b.cy AS v FROM {pairs} p JOIN ref a ON a.image_id = p.image_id AND a.crater_id = p.i JOIN tgt b ON b.image_id = p.image_id AND b.crater_id = p.j)"""


def _fixed(names: str, scale: str = "1e4") -> str:
    return ", ".join(f"{fx(c, scale)} AS {c}" for c in names.split())


_PAIRS = (_BASE, _TRUTH, _THR, _MATCH, _placed("pl", "m"))
put("fit_similarity", f"SELECT image_id, n, {_fixed('re im tx ty s')} FROM sim", *_PAIRS, _sim("sim", "pl", "image_id"))
put("fit_affine", f"SELECT image_id, CAST(n AS BIGINT) AS n, {', '.join(f'{fx(e, '1e3')} AS {k}' for k, e in affine_sql().items())} FROM q", *_PAIRS, f"q AS (SELECT image_id, {_SUMS} FROM pl GROUP BY image_id)")
_ERR = "err AS (SELECT p.image_id, s.s, sqrt((re * x - im * y + tx - u) * (re * x - im * y + tx - u) + (im * x + re * y + ty - v) * (im * x + re * y + ty - v)) AS e FROM {0} p JOIN {1} s USING (image_id))"
_STATS = "st AS (SELECT image_id, count(*) AS n, sqrt(avg(e * e)) AS rmse_tgt, sqrt(avg(e * e)) / max(s) AS rmse_ref, median(e) AS median_tgt, max(e) AS max_tgt FROM err GROUP BY image_id)"
put("residual_stats", f"SELECT image_id, n, {_fixed('rmse_tgt rmse_ref median_tgt max_tgt')} FROM st", *_PAIRS, _sim("sim", "pl", "image_id"), _ERR.format("pl", "sim"), _STATS)
_FOLD = f"q AS (SELECT image_id, {_SUMS} FROM pl GROUP BY image_id), fold AS (SELECT image_id, x, y, u, v, q.n AS n_all, {', '.join(f'q.{k} - {e} AS {k}' for k, e in _OWN.items())} FROM pl JOIN q USING (image_id))"
_LOO_S = f"""ls_a AS (SELECT *, CASE WHEN {_DEN} > 1e-9 THEN {_RE} END AS re, CASE WHEN {_DEN} > 1e-9 THEN {_IM} END AS im FROM fold),
ls_e AS (SELECT image_id, n_all, re * x - im * y + (su - re * sx + im * sy) / n - u AS eu, im * x + re * y + (sv - im * sx - re * sy) / n - v AS ev FROM ls_a),
ls AS (SELECT image_id, CAST(max(n_all) AS BIGINT) AS n, CASE WHEN max(n_all) >= 3 THEN sqrt(avg(eu * eu + ev * ev)) END AS loo_rmse FROM ls_e GROUP BY image_id)"""
_LOO_A = f"""la_a AS (SELECT *, {', '.join(f'{e} AS {k}' for k, e in affine_sql().items())} FROM fold),
la_e AS (SELECT image_id, n_all, a00 * x + a01 * y + a02 - u AS eu, a10 * x + a11 * y + a12 - v AS ev FROM la_a),
la AS (SELECT image_id, CAST(max(n_all) AS BIGINT) AS n, CASE WHEN max(n_all) >= 4 THEN sqrt(avg(eu * eu + ev * ev)) END AS loo_rmse FROM la_e GROUP BY image_id)"""
put("loo_similarity", f"SELECT image_id, n, {fx('loo_rmse')} AS loo_rmse FROM ls", *_PAIRS, _FOLD, _LOO_S)
put("loo_affine", f"SELECT image_id, n, {fx('loo_rmse', '1e3')} AS loo_rmse FROM la", *_PAIRS, _FOLD, _LOO_A)
_SWITCH = "la.loo_rmse < 0.85 * ls.loo_rmse AND la.n >= 6"
put("model_choice", f"""SELECT ls.image_id, ls.n, CASE WHEN {_SWITCH} THEN 'affine' ELSE 'similarity' END AS model, {fx(f'CASE WHEN {_SWITCH} THEN la.loo_rmse ELSE ls.loo_rmse END', '1e3')} AS loo_rmse
FROM ls LEFT JOIN la USING (image_id)""", *_PAIRS, _FOLD, _LOO_S, _LOO_A)

_CORNERS = "hp AS (SELECT image_id, hyp, unnest([1, 2, 3]) AS k, ca, cb FROM hyp), hc AS (SELECT image_id, hyp, ca[k].x AS x, ca[k].y AS y, cb[k].x AS u, cb[k].y AS v FROM hp)"
_COLLECTED = (_BASE, _ALIKE, _HYP, _CORNERS, _sim("hs", "hc", "image_id, hyp"), "hv AS (SELECT * FROM hs WHERE s > 0.05 AND s < 20)", _THR, _near("m", "hv", "image_id, hyp", "thr", 0.72, 1.39))
_COUNT, _BEST = "SELECT image_id, hyp, count(*) AS n_pairs FROM m GROUP BY image_id, hyp", "best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n_pairs DESC, hyp) = 1)"
_VOTES = (*_COLLECTED, f"every_vote AS ({_COUNT})",
          f"""seen AS (SELECT v.image_id, v.hyp, n_pairs, count(*) FILTER (re * cx - im * cy + tx > -0.05 * {FRAME} AND re * cx - im * cy + tx < 1.05 * {FRAME} AND im * cx + re * cy + ty > -0.05 * {FRAME}
              AND im * cx + re * cy + ty < 1.05 * {FRAME} AND r * s >= 0.8 * 8) AS n_seen FROM every_vote v JOIN hv h USING (image_id, hyp) JOIN ref ON ref.image_id = v.image_id WHERE n_pairs >= 14 GROUP BY ALL)""",
          "halt AS (SELECT image_id, min(hyp) AS last FROM seen JOIN (SELECT image_id, count(*) AS n_tgt FROM tgt GROUP BY image_id) USING (image_id) WHERE n_pairs >= 0.85 * least(n_tgt, n_seen) GROUP BY image_id)",
          "votes AS (SELECT v.image_id, hyp, n_pairs FROM every_vote v LEFT JOIN halt USING (image_id) WHERE last IS NULL OR hyp <= last)", _BEST)
put("hypothesis_votes", "SELECT * FROM every_vote", *_VOTES)
#: No hypothesis ends its image's votes.
_WHOLE = (*_COLLECTED, f"votes AS ({_COUNT})", _BEST)
put("hypothesis_winner", "SELECT * FROM best", *_WHOLE)
put("zoom_uniqueness", f"""SELECT image_id, n_best, n_second, {fx('n_best / greatest(n_best, n_second, 1)')} AS uniqueness FROM (SELECT b.image_id, max(b.n_pairs) AS n_best,
    coalesce(max(v.n_pairs) FILTER (abs(ln(o.s / h.s)) > 0.25), 0) AS n_second FROM best b JOIN hv h USING (image_id, hyp) JOIN votes v ON v.image_id = b.image_id JOIN hv o ON o.image_id = v.image_id AND o.hyp = v.hyp GROUP BY b.image_id) q""", *_WHOLE)


def _round(k: int) -> list[str]:
    """CTEs of refit round k: p{k} are its pairs, and run{k} the images that go on."""
    return [
        _placed(f"pl{k}", f"(SELECT * FROM p{k - 1} WHERE image_id IN (FROM run{k - 1}))"), _sim(f"f{k}", f"pl{k}", "image_id"), _near(f"m{k}", f"f{k}", "image_id", "greatest(3e0, 0.6 * thr)", 0.78, 1.28),
        f"run{k} AS (SELECT image_id FROM (SELECT image_id, count(*) AS a FROM p{k - 1} GROUP BY image_id) x JOIN (SELECT image_id, count(*) AS b FROM m{k} GROUP BY image_id) y USING (image_id) WHERE a >= 3 AND b >= 3 AND b >= a - 1)",
        f"p{k} AS (SELECT image_id, i, j FROM m{k} WHERE image_id IN (FROM run{k}) UNION ALL SELECT image_id, i, j FROM p{k - 1} WHERE image_id NOT IN (FROM run{k}))"]


put("match_pair", f"""SELECT f.image_id, st.n AS n_inliers, {fx('f.s', '1e3')} AS scale, {fx('degrees(atan2(f.im, f.re))', '1e3')} AS rotation_deg, {fx('f.tx', '1e3')} AS tx, {fx('f.ty', '1e3')} AS ty,
{fx('rmse_tgt', '1e3')} AS rmse_tgt, {fx('rmse_ref', '1e3')} AS rmse_ref, {fx('loo_rmse', '1e3')} AS heldout_tgt, {fx('st.n / greatest(st.n, n_second, 1)')} AS uniqueness FROM st JOIN f USING (image_id) JOIN ls USING (image_id) JOIN sec USING (image_id) WHERE st.n >= 4""", *_VOTES,
    "sec AS (SELECT b.image_id, coalesce(max(v.n_pairs) FILTER (abs(ln(o.s / h.s)) > 0.25), 0) AS n_second FROM best b JOIN hv h USING (image_id, hyp) JOIN votes v ON v.image_id = b.image_id JOIN hv o ON o.image_id = v.image_id AND o.hyp = v.hyp GROUP BY b.image_id)",
    "p0 AS (SELECT m.image_id, i, j FROM m JOIN best USING (image_id, hyp) WHERE n_pairs >= 4)", "run0 AS (SELECT DISTINCT image_id FROM p0)", *(c for k in range(1, 5) for c in _round(k)),
    _placed("pl", "p4"), _sim("f", "pl", "image_id"), _ERR.format("pl", "f"), _STATS, _FOLD, _LOO_S)
put("confidence_ladder", f"""SELECT image_id, CAST(k AS BIGINT) AS rung, {fx('c')} AS conf_min, n FROM (SELECT image_id, k, c, count(*) AS n FROM det, (VALUES (0, 0.5e0), (1, 0.4e0), (2, 0.3e0), (3, 0.25e0)) b(k, c)
WHERE conf >= c GROUP BY image_id, k, c HAVING count(*) >= 60) q QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY k) = 1""", _DET)
_INSIDE = f"{{0}} > -0.05 * {FRAME} AND {{0}} < 1.05 * {FRAME} AND {{1}} > -0.05 * {FRAME} AND {{1}} < 1.05 * {FRAME}"
put("visible_inlier_ratio", f"""SELECT image_id, va.n AS n_visible_ref, vb.n AS n_visible_tgt, {fx('c.n / greatest(1, least(va.n, vb.n))')} AS inlier_ratio FROM va JOIN vb USING (image_id) JOIN (SELECT image_id, count(*) AS n FROM m GROUP BY image_id) c USING (image_id)""", *_PAIRS,
    f"va AS (SELECT image_id, count(*) FILTER ({_INSIDE.format('re * cx - im * cy + tx', 'im * cx + re * cy + ty')} AND r * s >= 0.8 * 8) AS n FROM ref JOIN truth USING (image_id) GROUP BY image_id)",
    f"vb AS (SELECT image_id, count(*) FILTER ({_INSIDE.format('(re * (cx - tx) + im * (cy - ty)) / (s * s)', '(re * (cy - ty) - im * (cx - tx)) / (s * s)')} AND r / s >= 0.8 * 8) AS n FROM tgt JOIN truth USING (image_id) GROUP BY image_id)")
put("coverage_3x3", f"""SELECT image_id, count(DISTINCT floor(v * 3 / {FRAME}) * 3 + floor(u * 3 / {FRAME})) AS n_hit, {fx(f'count(DISTINCT floor(v * 3 / {FRAME}) * 3 + floor(u * 3 / {FRAME})) / 9e0')} AS coverage
FROM pl WHERE u >= 0 AND u < {FRAME} AND v >= 0 AND v < {FRAME} GROUP BY image_id""", *_PAIRS)
_TRIM = """e AS (SELECT *, sqrt(dx * dx + dy * dy) AS e FROM nodes), md AS (SELECT pair_id, median(e) AS med FROM e GROUP BY pair_id),
bd AS (SELECT pair_id, greatest(1.5e0, max(med) + 4 * greatest(1.4826e0 * median(abs(e - med)), 0.2e0)) AS bound FROM e JOIN md USING (pair_id) GROUP BY pair_id),
tr AS (SELECT pair_id, count(*) AS n, count(*) FILTER (e <= bound) AS n_kept, sqrt(avg(e * e) FILTER (e <= bound)) AS rms, sqrt(avg(e * e)) AS rms_all,
    median(e) AS median, max(e) FILTER (e <= bound) AS most, avg((e <= 0.5)::DOUBLE) AS within_half, avg((e <= 1)::DOUBLE) AS within_one FROM e JOIN bd USING (pair_id) GROUP BY pair_id)"""
put("mad_trim", f"SELECT pair_id, n, n_kept, {_fixed('rms rms_all median most within_half within_one')} FROM tr", _NODES, _TRIM)
put("quality_grade", f"SELECT pair_id, CASE {' '.join(f'WHEN px <= {b} THEN {chr(39)}{g}{chr(39)}' for b, g in GRADES)} ELSE '{COARSE}' END AS grade FROM (SELECT pair_id, CASE WHEN n_kept >= 8 THEN rms ELSE rms_all END AS px FROM tr) t", _NODES, _TRIM)
_CAND = ("nn AS (SELECT image_id, i, j, d, angle, row_number() OVER (PARTITION BY image_id, i ORDER BY d, j) AS n FROM (SELECT a.image_id, a.crater_id AS i, b.crater_id AS j, " + _dist("a", "b") + " AS d, atan2(b.cy - a.cy, b.cx - a.cx) AS angle "
         "FROM ref a JOIN ref b ON a.image_id = b.image_id AND a.crater_id <> b.crater_id AND b.r >= 0.15 * a.r) q QUALIFY n <= 5)",
         "gp AS (SELECT *, coalesce(lead(angle) OVER (PARTITION BY image_id, i ORDER BY angle), min(angle) OVER (PARTITION BY image_id, i) + 2 * pi()) - angle AS gap FROM nn)",
         "rk AS (SELECT image_id, crater_id AS i, (row_number() OVER (PARTITION BY image_id ORDER BY r, crater_id) - 1) / greatest(count(*) OVER (PARTITION BY image_id) - 1, 1) AS k FROM ref)",
         "cd AS (SELECT g.image_id, g.i, list(j ORDER BY n) AS members, max(d) AS extent, 0.45 * (1 - max(gap) / (2 * pi())) + 0.25 * least(1, count(*) / 5) + 0.30 * max(k) AS quality FROM gp g JOIN rk USING (image_id, i) GROUP BY g.image_id, g.i HAVING count(*) >= 3)")
put("pattern_candidates", f"SELECT image_id, i, array_to_string(members, ',') AS members, {fx('quality')} AS quality, {fx('extent')} AS extent FROM cd", _BASE, *_CAND)
put("pattern_signature", f"""SELECT pattern_id, CAST(m AS BIGINT) AS m, CASE WHEN m = 0 THEN 0 ELSE {fx('(dy * ux - dx * uy) / (ud * ud)', '1e3')} END AS sx, CASE WHEN m = 0 THEN 0 ELSE {fx('-(dx * ux + dy * uy) / (ud * ud)', '1e3')} END AS sy, {fx('r / ud', '1e3')} AS sr FROM rel JOIN nr USING (pattern_id)""",
    _BASE, *_CAND, "pm AS (SELECT image_id, i AS pattern_id, unnest(list_prepend(i, members)) AS c, unnest(range(len(members) + 1)) AS m FROM cd)",
    "pt AS (SELECT pattern_id, m, cx AS x, cy AS y, r FROM pm JOIN ref ON ref.image_id = pm.image_id AND crater_id = c)",
    "rel AS (SELECT p.pattern_id, p.m, p.r, p.x - a.x AS dx, p.y - a.y AS dy, sqrt((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y)) AS d FROM pt p JOIN pt a ON a.pattern_id = p.pattern_id AND a.m = 0)",
    "nr AS (SELECT pattern_id, dx AS ux, dy AS uy, d AS ud FROM rel WHERE m > 0 QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY d, m) = 1)")
put("star_deviation", f"""SELECT image_id, centre, {fx('avg(sqrt((ap - bp) * (ap - bp) + (aq - bq) * (aq - bq)))')} AS deviation FROM (SELECT image_id, centre, (x * nx + y * ny) / (nx * nx + ny * ny) AS ap, (y * nx - x * ny) / (nx * nx + ny * ny) AS aq,
    (u * nu + v * nv) / (nu * nu + nv * nv) AS bp, (v * nu - u * nv) / (nu * nu + nv * nv) AS bq FROM (SELECT s.image_id, s.i AS centre, p.x - c.x AS x, p.y - c.y AS y, p.u - c.u AS u, p.v - c.v AS v, f.x - c.x AS nx, f.y - c.y AS ny, f.u - c.u AS nu, f.v - c.v AS nv
    FROM ch s JOIN pl p ON p.image_id = s.image_id AND p.i = s.j JOIN pl c ON c.image_id = s.image_id AND c.i = s.i JOIN ch e ON e.image_id = s.image_id AND e.rank = 1 JOIN pl f ON f.image_id = e.image_id AND f.i = e.j) q) w GROUP BY image_id, centre""", *_PAIRS,
    f"pr AS (SELECT a.image_id, a.i, a.ra AS r, b.i AS j, {_dist('a', 'b', ('x', 'y'), ('x', 'y'))} AS d FROM (SELECT pl.*, ref.r AS ra FROM pl JOIN ref ON ref.image_id = pl.image_id AND crater_id = i) a JOIN pl b ON a.image_id = b.image_id)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, i ORDER BY d, j) AS n FROM pr), th AS (SELECT image_id, i, max(d) FILTER (n <= 4) AS third FROM rk GROUP BY image_id, i)",
    "sc AS (SELECT image_id, i, count(*) FILTER (d < 4 * third + 1e-9) + 0.02e0 * max(r) AS score FROM rk JOIN th USING (image_id, i) GROUP BY image_id, i)",
    "be AS (SELECT image_id, i FROM sc QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, i) = 1)",
    "ch AS (SELECT pr.image_id, pr.i, pr.j, row_number() OVER (PARTITION BY pr.image_id ORDER BY d, j) AS rank FROM pr JOIN be USING (image_id, i) WHERE pr.i <> pr.j QUALIFY rank <= 7)")
put("star_select", """SELECT image_id, i AS centre, j, row_number() OVER (PARTITION BY image_id ORDER BY d, j) AS rank FROM pr JOIN be USING (image_id, i) WHERE i <> j QUALIFY rank <= 7""", _BASE,
    f"pr AS (SELECT a.image_id, a.crater_id AS i, a.r, b.crater_id AS j, {_dist('a', 'b')} AS d FROM ref a JOIN ref b ON a.image_id = b.image_id)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY image_id, i ORDER BY d, j) AS n FROM pr), th AS (SELECT image_id, i, max(d) FILTER (n <= 4) AS third FROM rk GROUP BY image_id, i)",
    "sc AS (SELECT image_id, i, count(*) FILTER (d < 4 * third + 1e-9) + 0.02e0 * max(r) AS score FROM rk JOIN th USING (image_id, i) GROUP BY image_id, i)",
    "be AS (SELECT image_id, i FROM sc QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY score DESC, i) = 1)")


def _gauss(sigma: float) -> list[float]:
    """Weights of a Gaussian over 8 sigma + 1 pixels, rounded to an odd number."""
    half = (round(sigma * 8 + 1) | 1) // 2
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [x / sum(w) for x in w]


def _mirror(e: str, n: str) -> str:
    """An index within 0 .. n - 1 for one beyond: mirrored at the border pixels, which aren't repeated."""
    period = f"greatest(2 * ({n} - 1), 1)"
    m = f"(((({e}) % {period}) + {period}) % {period})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {period} - {m} END"


_SIZE = "sz AS (SELECT image_id, max(y) + 1 AS hh, max(x) + 1 AS ww FROM px GROUP BY image_id)"


def _taps(name: str, src: str, weights: list[float], axis: str, columns: dict[str, str]) -> str:
    """CTE: weighted sums along an axis, for each of columns (new name: expression of the source s), beside the place."""
    half, n = len(weights) // 2, "ww" if axis == "x" else "hh"
    taps = ", ".join(f"({k - half}, {w!r}::DOUBLE)" for k, w in enumerate(weights) if w)
    sums = ", ".join(f"sum(k.w * {e}) AS {c}" for c, e in columns.items())
    other = "y" if axis == "x" else "x"
    return f"""{name}_t AS (SELECT p.image_id, p.y, p.x, k.w, {_mirror(f'p.{axis} + k.o', f'z.{n}')} AS at FROM px p JOIN sz z USING (image_id), (VALUES {taps}) k(o, w)),
{name} AS (SELECT k.image_id, k.y, k.x, {sums} FROM {name}_t k JOIN {src} s ON s.image_id = k.image_id AND s.{axis} = k.at AND s.{other} = k.{other} GROUP BY k.image_id, k.y, k.x)"""


_SMOOTH, _SLOPE = [1.0, 2.0, 1.0], [-1.0, 0.0, 1.0]
_SOBEL = (_PX, _SIZE, _taps("s1", "px", _SLOPE, "x", {"dx": "s.v"}), _taps("s2", "px", _SMOOTH, "x", {"sx": "s.v"}), _taps("s3", "s1", _SMOOTH, "y", {"gx0": "s.dx"}), _taps("s4", "s2", _SLOPE, "y", {"gy0": "s.sx"}),
          "sb AS (SELECT image_id, y, x, gx0 / 8 AS gx, gy0 / 8 AS gy, sqrt(gx0 / 8 * (gx0 / 8) + gy0 / 8 * (gy0 / 8)) AS mag FROM s3 JOIN s4 USING (image_id, y, x))")
put("sobel_gradient", f"SELECT image_id, y, x, {_fixed('gx gy mag', '1e6')} FROM sb", *_SOBEL)
put("gradient_p95", f"SELECT image_id, {fx('quantile_cont(mag, 0.95) + 1e-6', '1e6')} AS g95 FROM sb GROUP BY image_id", *_SOBEL)
put("gauss_blur", f"SELECT image_id, y, x, {fx('w', '1e6')} AS v FROM b2", _PX, _SIZE, _taps("b1", "px", _gauss(1.2), "x", {"u": "s.v"}), _taps("b2", "b1", _gauss(1.2), "y", {"w": "s.u"}))
put("local_contrast", f"SELECT image_id, y, x, {fx('(v - m) / sqrt(greatest(q - m * m, 4))', '1e6')} AS v FROM px JOIN b2 USING (image_id, y, x)", _PX, _SIZE,
    _taps("b1", "px", _gauss(20.0), "x", {"m": "s.v", "q": "s.v * s.v"}), _taps("b2", "b1", _gauss(20.0), "y", {"m": "s.m", "q": "s.q"}))
_FIVE = [1 / 16, 4 / 16, 6 / 16, 4 / 16, 1 / 16]
put("pyramid_level", f"SELECT image_id, y // 2 AS y, x // 2 AS x, {fx('w', '1e6')} AS v FROM b2 WHERE x % 2 = 0 AND y % 2 = 0", _PX, _SIZE, _taps("b1", "px", _FIVE, "x", {"u": "s.v"}), _taps("b2", "b1", _FIVE, "y", {"w": "s.u"}))
put("erode_min", f"SELECT image_id, y, x, {fx('min(m) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)', '1e6')} AS v FROM r", _PX,
    "r AS (SELECT *, min(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM px)")
put("bilinear_sample", f"""SELECT c.image_id, point_id, {fx('CASE WHEN count(v) = count(*) THEN sum(c.w * v) END', '1e6')} AS value FROM c LEFT JOIN px ON px.image_id = c.image_id AND px.x = c.xx AND px.y = c.yy WHERE c.w > 0 GROUP BY c.image_id, point_id""",
    _BASE, _PX, "p AS (SELECT crater_id % 5 AS image_id, crater_id AS point_id, cx * 0.08e0 AS x, cy * 0.12e0 AS y FROM ref)",
    "c AS (SELECT image_id, point_id, floor(x) + dx AS xx, floor(y) + dy AS yy, (CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) AS w FROM p, range(2) a(dx), range(2) b(dy))")
_HARM = ", ".join(f"{fx(f'sqrt(pow(sum(v * cos(angle * (2 * pi() * {k} / 64))), 2) + pow(sum(v * sin(angle * (2 * pi() * {k} / 64))), 2)) / 64', '1e5')} AS h{k}" for k in range(1, 5))
put("ring_harmonics", f"SELECT vec_id, {fx('avg(v)', '1e5')} AS mean, {fx('stddev_pop(v)', '1e5')} AS std, {_HARM} FROM (SELECT image_id * 100 + y AS vec_id, x AS angle, v FROM px) r GROUP BY vec_id", _PX)
put("ncc_patches", f"SELECT vec_id, shift, {fx('score')} AS score FROM (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, shift) = 1) b WHERE score >= 0.3", _PX,
    "r AS (SELECT image_id * 100 + y AS vec_id, x, v FROM px)", "sc AS (SELECT a.vec_id, shift, corr(a.v, b.v) AS score FROM r a JOIN r b ON b.vec_id = a.vec_id + 1, range(-8, 9) s(shift) WHERE a.x >= 16 AND a.x < 48 AND b.x = a.x + shift GROUP BY a.vec_id, shift)")
put("descriptor_ratio_test", f"SELECT image_id, i, j, {fx('d')} AS d FROM (SELECT *, lead(d) OVER w AS second, row_number() OVER w AS n FROM di WINDOW w AS (PARTITION BY image_id, i ORDER BY d, j)) q WHERE n = 1 AND d < 0.8 * second", _PX,
    "other AS (SELECT image_id, y, x, v + CASE WHEN y % 3 = 0 THEN 9e-1 ELSE 1e-2 END * ((y * 7 + x * 13) % 11 - 5) AS v FROM px)",
    "di AS (SELECT a.image_id, a.y AS i, b.y AS j, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM px a JOIN other b ON b.image_id = a.image_id AND a.x = b.x GROUP BY a.image_id, a.y, b.y)")
_KK = "2e0 * 1737400 / (1 + sin(radians(-60e0)) * sin(radians(lat)) + cos(radians(-60e0)) * cos(radians(lat)) * cos(radians(lon - 25)))"
put("stereo_roundtrip", f"SELECT image_id, pixel, scan, {_fixed('x y', '1e0')}, {fx('lon * 1e4 + 0.06', '1e0')} AS lon, {fx('lat * 1e4 + 0.06', '1e0')} AS lat FROM f", _GRID,
    f"f AS (SELECT image_id, pixel, scan, lon, lat, {_KK} * cos(radians(lat)) * sin(radians(lon - 25)) AS x, {_KK} * (cos(radians(-60e0)) * sin(radians(lat)) - sin(radians(-60e0)) * cos(radians(lat)) * cos(radians(lon - 25))) AS y FROM grid)")
put("circular_mean_lon", f"SELECT image_id, {fx('degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon)))))', '1e5')} AS lon0, {fx('avg(lat)', '1e5')} AS lat0 FROM grid GROUP BY image_id", _GRID)
put("great_circle_diff", f"SELECT image_id, count(*) AS n, {fx('avg(m)', '1e1')} AS mean, {fx('median(m)', '1e1')} AS median, {fx('max(m)', '1e1')} AS most FROM g GROUP BY image_id", _GRID,
    "g AS (SELECT image_id, 1737400 * acos(least(1e0, greatest(-1e0, sin(radians(lat)) * sin(radians(lat + 0.02)) + cos(radians(lat)) * cos(radians(lat + 0.02)) * cos(radians(lon - (lon + 0.01)))))) AS m FROM grid)")
put("capture_gap_days", f"""SELECT event_id AS pair_id, {fx('abs(t - lag(t) OVER w) / 86400e6')} AS days, {fx('abs(sun - lag(sun) OVER w)')} AS d_sun_elevation_deg, CAST(NULL AS BIGINT) AS d_sun_azimuth_deg, {fx('abs(inc - lag(inc) OVER w)')} AS d_incidence_angle_deg
FROM (SELECT user_id, event_id, epoch_us(ts) AS t, value % 90 AS sun, (event_id % 60)::DOUBLE AS inc FROM events) e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id) QUALIFY lag(t) OVER w IS NOT NULL""")
put("training_assembly", f"""SELECT image_id, 'positive' AS origin, 6 * count(*) AS n, 6e0 * count(*) AS weight FROM ann WHERE label = 1 GROUP BY image_id UNION ALL
SELECT image_id, 'negative', 4 * count(*), 4e0 * count(*) FROM ann WHERE label = 0 GROUP BY image_id UNION ALL
SELECT image_id, 'unlabelled', n, round(CASE WHEN complete THEN 1e0 ELSE 0.3e0 END * n, 6) FROM (SELECT f.image_id, complete, least(count(*), CASE WHEN complete THEN greatest(200, 24 * p) ELSE greatest(30, 12 * p) END) AS n
    FROM (SELECT * FROM det a WHERE NOT EXISTS (SELECT 1 FROM ann b WHERE a.image_id = b.image_id AND {_same(0.7)})) f
    JOIN (SELECT image_id, count(*) FILTER (label = 1) AS p, bool_and(toxic = 0) AS complete FROM ann GROUP BY image_id) i USING (image_id) GROUP BY f.image_id, complete, p) u""", _DET, _ANN)

_K = "2e0 * 1737400 / (1 + sin(radians(lat0)) * sin(radians(lat)) + cos(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))"


def _placed_ll(name: str, points: str, grid: str) -> list[str]:
    """CTEs up to name (image_id, point_id, lon, lat): points (image_id, point_id, px, py) bilinear in a grid."""
    return [
        f"{name}_mid AS (SELECT image_id, degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) AS lon0, avg(lat) AS lat0 FROM {grid} GROUP BY image_id)",
        f"{name}_xy AS (SELECT image_id, pixel, scan, {_K} * cos(radians(lat)) * sin(radians(lon - lon0)) AS gx, {_K} * (cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0))) AS gy FROM {grid} JOIN {name}_mid USING (image_id))",
        f"{name}_ax AS (SELECT image_id, list_sort(list(DISTINCT pixel)) AS ps, list_sort(list(DISTINCT scan)) AS ss FROM {grid} GROUP BY image_id)",
        f"{name}_lo AS (SELECT *, least(len(list_filter(ps, lambda v: v <= px)), len(ps) - 1) AS a, least(len(list_filter(ss, lambda v: v <= py)), len(ss) - 1) AS b FROM {points} JOIN {name}_ax USING (image_id))",
        f"{name}_co AS (SELECT image_id, point_id, ps[a + i] AS p, ss[b + j] AS s, (CASE WHEN i = 1 THEN (px - ps[a]) / (ps[a + 1] - ps[a]) ELSE 1 - (px - ps[a]) / (ps[a + 1] - ps[a]) END) * (CASE WHEN j = 1 THEN (py - ss[b]) / (ss[b + 1] - ss[b]) ELSE 1 - (py - ss[b]) / (ss[b + 1] - ss[b]) END) AS w FROM {name}_lo, range(2) x(i), range(2) y(j) WHERE a >= 1 AND b >= 1 AND px <= ps[a + 1] AND py <= ss[b + 1])",
        f"{name}_su AS (SELECT c.image_id, point_id, sum(w * gx) AS x, sum(w * gy) AS y FROM {name}_co c JOIN {name}_xy g ON g.image_id = c.image_id AND pixel = p AND scan = s GROUP BY ALL HAVING count(*) = 4)",
        f"{name}_cc AS (SELECT *, sqrt(x * x + y * y) AS rho, 2 * atan(sqrt(x * x + y * y) / (2 * 1737400e0)) AS c FROM {name}_su JOIN {name}_mid USING (image_id))",
        f"""{name} AS (SELECT image_id, point_id, lon0 + degrees(atan2(x * sin(c), greatest(rho, 1e-12) * cos(radians(lat0)) * cos(c) - y * sin(radians(lat0)) * sin(c))) AS lon,
        degrees(asin(cos(c) * sin(radians(lat0)) + y * sin(c) * cos(radians(lat0)) / greatest(rho, 1e-12))) AS lat FROM {name}_cc)"""]  # fmt: skip


put("grid_interpolate", f"""SELECT image_id, point_id, {fx('CASE WHEN lon < 0 THEN lon + 360 ELSE lon END', '1e5')} AS lon, {fx('lat', '1e5')} AS lat FROM ref_p LEFT JOIN ll USING (image_id, point_id)""", _BASE, _GRID,
    "ref_p AS (SELECT image_id, crater_id AS point_id, cx AS px, cy AS py FROM ref)", *_placed_ll("ll", "ref_p", "grid"))
# A node of the target's frame of 501 x 501 in work pixels (u, v), taken back to the reference's (x, y) by the transform's inverse, and both to their grids' own pixels.
_NODE = "unnest(list_distinct(range(0, 501, 50) || [500]))"
put("official_grid_difference", f"""SELECT image_id, count(m) AS n, {_fixed("mean median largest", "1e0")} FROM (SELECT image_id, m, avg(m) OVER w AS mean, median(m) OVER w AS median, max(m) OVER w AS largest FROM apart WINDOW w AS (PARTITION BY image_id)) q GROUP BY ALL""", _BASE, _GRID, _TRUTH,
    "off AS (SELECT image_id, pixel // 2 AS pixel, scan // 2 AS scan, lon + 0.01e0 + pixel * 0.00001e0 AS lon, lat - 0.02e0 AS lat FROM grid)",
    f"lines AS (SELECT image_id, px, {_NODE} AS py FROM (SELECT image_id, {_NODE} AS px FROM truth) t)",
    "uv AS (SELECT image_id, px * 1000 + py AS point_id, (px + 0.5) * 1200 / 501e0 * 0.8e0 - 0.5 AS u, (py + 0.5) * 1100 / 501e0 * 0.8e0 - 0.5 AS v FROM lines)",
    "own AS (SELECT image_id, point_id, ((re * (u - tx) + im * (v - ty)) / (s * s) + 0.5) / 0.9e0 - 0.5 AS px, ((re * (v - ty) - im * (u - tx)) / (s * s) + 0.5) / 0.9e0 - 0.5 AS py FROM uv JOIN truth USING (image_id))",
    "their AS (SELECT image_id, point_id, (u + 0.5) / 0.8e0 * 501 / 1200e0 - 0.5 AS px, (v + 0.5) / 0.8e0 * 501 / 1100e0 - 0.5 AS py FROM uv)",
    *_placed_ll("mine", "own", "grid"), *_placed_ll("official", "their", "off"),
    """apart AS (SELECT uv.image_id, CASE WHEN m.lat IS NOT NULL AND o.lat IS NOT NULL THEN 1737400 * acos(least(1e0, greatest(-1e0, sin(radians(o.lat)) * sin(radians(m.lat)) + cos(radians(o.lat)) * cos(radians(m.lat)) * cos(radians(o.lon - m.lon))))) END AS m
    FROM uv LEFT JOIN mine m USING (image_id, point_id) LEFT JOIN official o USING (image_id, point_id))""")  # fmt: skip
put("axis_pairs", "SELECT DISTINCT 'image' || image_id AS file, 'Line' AS axis, CAST(image_id * 10 AS INTEGER) AS elements FROM ref", _BASE)
put("xml_facts", "SELECT DISTINCT 'image' || image_id AS file, 'urn:' || image_id AS product_id, 'Image ' || image_id AS title, '2020-01-' || lpad((image_id % 28 + 1)::VARCHAR, 2, '0') || 'T00:00:00Z' AS start_time, image_id * 0.5e0 AS sun_elevation_deg, image_id::DOUBLE AS orbit FROM ref", _BASE)

# One detection after the other, by rank, joins the list of those kept unless it is one crater with some of them.
_AT = "sqrt((a[j].x - a[k + 1].x) * (a[j].x - a[k + 1].x) + (a[j].y - a[k + 1].y) * (a[j].y - a[k + 1].y)) < 0.5 * greatest(a[j].r, a[k + 1].r) AND a[j].r / a[k + 1].r > 0.6 AND a[j].r / a[k + 1].r < 1.67"
put("nms_detections", "SELECT image_id, d.id AS det_id, d.conf AS conf FROM (SELECT g.image_id, unnest(list_transform(kept, lambda j: a[j])) AS d FROM go g JOIN arr USING (image_id) WHERE k = len(a)) q", _DET,
    "arr AS (SELECT image_id, list({'x': cx, 'y': cy, 'r': r, 'id': det_id, 'conf': conf} ORDER BY conf DESC, det_id) AS a FROM det GROUP BY image_id)",
    f"go AS (SELECT image_id, 1 AS k, [1] AS kept FROM arr UNION ALL SELECT g.image_id, k + 1, CASE WHEN len(list_filter(kept, lambda j: {_AT})) > 0 THEN kept ELSE list_append(kept, k + 1) END FROM go g JOIN arr USING (image_id) WHERE k < len(a))", recursive=True)

# One crater after the other takes the nearest free detection of about its size, if that is near enough.
_FREE = "list_sort(list_transform(list_filter(dets, lambda x: abs(x.r / t[k + 1].r - 1) < 0.3 AND NOT list_contains(used, x.id)), lambda x: {'d': sqrt((x.x - t[k + 1].x) * (x.x - t[k + 1].x) + (x.y - t[k + 1].y) * (x.y - t[k + 1].y)), 'id': x.id}))[1]"
put("score_detections", f"SELECT image_id, crater_id, det_id, {fx('d')} AS d FROM go WHERE det_id IS NOT NULL", _BASE, _DET,
    "arr AS (SELECT image_id, (SELECT list({'x': cx, 'y': cy, 'r': r, 'id': det_id}) FROM det WHERE det.image_id = ref.image_id) AS dets, list({'x': cx, 'y': cy, 'r': r, 'id': crater_id} ORDER BY crater_id) AS t FROM ref GROUP BY image_id)",
    f"""go AS (SELECT image_id, 0 AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS crater_id, CAST(NULL AS BIGINT) AS det_id, CAST(NULL AS DOUBLE) AS d FROM arr UNION ALL
    SELECT image_id, k + 1, CASE WHEN best.d < 0.25 * t[k + 1].r THEN list_append(used, best.id) ELSE used END, t[k + 1].id, CASE WHEN best.d < 0.25 * t[k + 1].r THEN best.id END, best.d
    FROM (SELECT g.*, t, {_FREE} AS best FROM go g JOIN arr USING (image_id) WHERE k < len(t)) q)""", recursive=True)  # fmt: skip

# One candidate after the other, by falling quality, is taken while there are fewer than four, if it shares at most one crater with each taken and stands apart.
_APART = "len(list_intersect(list_prepend(c[j].i, c[j].members), list_prepend(c[k + 1].i, c[k + 1].members))) >= 2 OR sqrt((c[j].x - c[k + 1].x) * (c[j].x - c[k + 1].x) + (c[j].y - c[k + 1].y) * (c[j].y - c[k + 1].y)) < 0.6 * greatest(c[j].extent, c[k + 1].extent)"
put("pattern_propose", f"SELECT image_id, p.i AS i, array_to_string(p.members, ',') AS members, {fx('p.quality')} AS quality, {fx('p.extent')} AS extent FROM (SELECT image_id, unnest(list_transform(kept, lambda j: c[j])) AS p FROM go JOIN arr USING (image_id) WHERE k = len(c)) q", _BASE, *_CAND,
    "arr AS (SELECT cd.image_id, list({'i': i, 'members': members, 'quality': quality, 'extent': extent, 'x': cx, 'y': cy} ORDER BY quality DESC, i) AS c FROM cd JOIN ref ON ref.image_id = cd.image_id AND ref.crater_id = cd.i GROUP BY cd.image_id)",
    f"go AS (SELECT image_id, 1 AS k, [1] AS kept FROM arr UNION ALL SELECT g.image_id, k + 1, CASE WHEN len(kept) = 4 OR len(list_filter(kept, lambda j: {_APART})) > 0 THEN kept ELSE list_append(kept, k + 1) END FROM go g JOIN arr USING (image_id) WHERE k < len(c))", recursive=True)


def _turn(a: str, b: str, c: str) -> str:
    """Positive where c lies to the left of the way from a to b."""
    return f"(({b}.x - {a}.x) * ({c}.y - {a}.y) - ({b}.y - {a}.y) * ({c}.x - {a}.x))"


def _hull(name: str, points: str) -> list[str]:
    """CTEs: name_e (image_id, ux, uy, wx, wy), the hull's sides, each from a point to the next on it, and name (image_id, area). A side has all points on its left."""
    return [
        f"{name}_p AS (SELECT DISTINCT image_id, round(x, 9) AS x, round(y, 9) AS y FROM {points})",
        f"{name}_s AS (SELECT a.image_id, a.x AS ux, a.y AS uy, b.x AS wx, b.y AS wy FROM {name}_p a JOIN {name}_p b ON a.image_id = b.image_id AND (a.x <> b.x OR a.y <> b.y) JOIN {name}_p c ON c.image_id = a.image_id GROUP BY ALL HAVING min({_turn('a', 'b', 'c')}) > -1e-6)",
        f"{name}_e AS (SELECT * FROM {name}_s QUALIFY row_number() OVER (PARTITION BY image_id, ux, uy ORDER BY (wx - ux) * (wx - ux) + (wy - uy) * (wy - uy)) = 1)",
        f"{name} AS (SELECT image_id, abs(sum(ux * wy - wx * uy)) / 2 AS area FROM {name}_e GROUP BY image_id)"]


def _cut(name: str, points: str, hull: str, w: str, h: str) -> str:
    """A CTE of the corners of a hull's part in a frame: points inside, the frame's corners inside the hull, and crossings of its sides with the frame's."""
    inside = lambda x, y: f"{x} >= 0 AND {x} <= {w} AND {y} >= 0 AND {y} <= {h}"
    cross = lambda at, a, b, u, v: f"SELECT image_id, {u} AS x, {v} AS y FROM (SELECT *, ({at} - {a}) / ({b} - {a}) AS t FROM {hull}_e WHERE ({a} < {at}) <> ({b} < {at})) q"
    way_x, way_y = "ux + t * (wx - ux)", "uy + t * (wy - uy)"
    sides = " UNION ALL ".join([cross("0", "ux", "wx", "0e0", way_y), cross(w, "ux", "wx", w, way_y), cross("0", "uy", "wy", way_x, "0e0"), cross(h, "uy", "wy", way_x, h)])
    return f"""{name} AS (SELECT image_id, x, y FROM {points} WHERE {inside("x", "y")} UNION ALL SELECT image_id, x, y FROM ({sides}) s WHERE {inside("x", "y")} UNION ALL
    SELECT image_id, x, y FROM {hull}_e e, (VALUES (0e0, 0e0), ({w}, 0e0), ({w}, {h}), (0e0, {h})) c(x, y) GROUP BY ALL HAVING min((wx - ux) * (y - uy) - (wy - uy) * (x - ux)) >= 0)"""


_W = f"{FRAME:.1f}e0".replace(".0e0", "e0")
put("hull_area", f"SELECT image_id, n, {fx('coalesce(area, 0)', '1e1')} AS hull_area, {fx(f'coalesce(area, 0) / ({_W} * {_W})')} AS frame_share FROM (SELECT image_id, count(*) AS n FROM pl GROUP BY image_id) c LEFT JOIN part USING (image_id)", *_PAIRS,
    "uv AS (SELECT image_id, u AS x, v AS y FROM pl)", *_hull("whole", "uv"), _cut("corners", "uv", "whole", _W, _W), *_hull("part", "corners"))
put("pair_geometry", f"SELECT image_id, {fx('o.area', '1e1')} AS overlap_area, {fx(f'o.area / ({_W} * {_W})')} AS overlap_share, {fx('h.area / o.area')} AS hull_share, {fx('hit / n_cells')} AS coverage FROM over o JOIN hull h USING (image_id) JOIN cov USING (image_id)", *_PAIRS, _sim("sim", "pl", "image_id"),
    f"quad AS (SELECT image_id, (re * (x - tx) + im * (y - ty)) / (s * s) AS x, (re * (y - ty) - im * (x - tx)) / (s * s) AS y FROM sim, (VALUES (0e0, 0e0), ({_W}, 0e0), ({_W}, {_W}), (0e0, {_W})) c(x, y))",
    *_hull("target", "quad"), _cut("corners", "quad", "target", _W, _W), *_hull("over", "corners"), "xy AS (SELECT image_id, x, y FROM pl)", *_hull("hull", "xy"),
    "box AS (SELECT image_id, min(x) AS x0, min(y) AS y0, (max(x) - min(x)) / 3 AS w, (max(y) - min(y)) / 3 AS h FROM corners GROUP BY image_id)",
    "cells AS (SELECT image_id, i, j, x0 + i * w AS x, y0 + j * h AS y, w, h FROM box, range(3) a(i), range(3) b(j))",
    "good AS (SELECT c.image_id, i, j, x, y, w, h FROM cells c JOIN over_e e USING (image_id) GROUP BY ALL HAVING min((wx - ux) * (y + h / 2 - uy) - (wy - uy) * (x + w / 2 - ux)) >= -1e-6)",
    "cov AS (SELECT image_id, count(*) AS n_cells, count(*) FILTER (EXISTS (SELECT 1 FROM pl p WHERE p.image_id = g.image_id AND p.x >= g.x AND p.x < g.x + g.w AND p.y >= g.y AND p.y < g.y + g.h))::DOUBLE AS hit FROM good g GROUP BY image_id)")

put("shrunk_images", f"SELECT image_id, CAST(ny AS BIGINT) AS y, CAST(nx AS BIGINT) AS x, {fx('sum(wy * wx * v) / sum(wy * wx)', '1e6')} AS v FROM over GROUP BY image_id, ny, nx", _PX,
    "size AS (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w, least(1e0, 45e0 / greatest(max(y) + 1, max(x) + 1)) AS f FROM px GROUP BY image_id)",
    "part AS (SELECT image_id, floor(h * f + 0.5) / h AS fy, floor(w * f + 0.5) / w AS fx FROM size)",
    "axis AS (SELECT px.image_id, y, x, v, fy, fx, unnest([floor(y * fy + 1e-9), floor(y * fy + 1e-9) + 1]) AS ny FROM px JOIN part USING (image_id))",
    "axes AS (SELECT *, unnest([floor(x * fx + 1e-9), floor(x * fx + 1e-9) + 1]) AS nx FROM axis)",
    "over AS (SELECT *, least((y + 1) * fy, ny + 1) - greatest(y * fy, ny) AS wy, least((x + 1) * fx, nx + 1) - greatest(x * fx, nx) AS wx FROM axes WHERE least((y + 1) * fy, ny + 1) - greatest(y * fy, ny) > 1e-9 AND least((x + 1) * fx, nx + 1) - greatest(x * fx, nx) > 1e-9)")
# As for suppression, but by number, and what is drawn or marked counts first; here the radius of the newer one stands above.
_KNOWN = "sqrt((p.x - a[k + 1].x) * (p.x - a[k + 1].x) + (p.y - a[k + 1].y) * (p.y - a[k + 1].y)) < 0.5 * greatest(p.r, a[k + 1].r) AND a[k + 1].r / p.r > 0.6 AND a[k + 1].r / p.r < 1.67"
put("known_craters", f"SELECT image_id, {fx('cx')} AS cx, {fx('cy')} AS cy, {fx('r')} AS r, 'manual' AS source FROM ann WHERE label = 1 UNION ALL SELECT image_id, {fx('p.x')}, {fx('p.y')}, {fx('p.r')}, 'ml' FROM (SELECT image_id, unnest(kept) AS p FROM go JOIN arr USING (image_id) WHERE k = len(a)) q", _DET, _ANN,
    "drawn AS (SELECT image_id, list({'x': cx, 'y': cy, 'r': r}) AS d FROM ann GROUP BY image_id)",
    "arr AS (SELECT det.image_id, list({'x': cx, 'y': cy, 'r': r} ORDER BY det_id) AS a, any_value(coalesce(d, [])) AS d FROM det LEFT JOIN drawn USING (image_id) WHERE conf >= 0.25 GROUP BY det.image_id)",
    f"go AS (SELECT image_id, 0 AS k, a[1:0] AS kept FROM arr UNION ALL SELECT g.image_id, k + 1, CASE WHEN len(list_filter(kept || d, lambda p: {_KNOWN})) > 0 THEN kept ELSE list_append(kept, a[k + 1]) END FROM go g JOIN arr USING (image_id) WHERE k < len(a))", recursive=True)
