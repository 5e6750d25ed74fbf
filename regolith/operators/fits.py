"""Least-squares transforms as aggregates, batched over any number of groups.

A point pair is (x, y) -> (u, v). A similarity is (re, im, tx, ty): u = re x - im y + tx, v = im x + re y + ty, never a reflection.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MOMENTS = {"n": "1e0", "sx": "x", "sy": "y", "su": "u", "sv": "v", "sxx": "x * x", "syy": "y * y", "sxy": "x * y", "sxu": "x * u", "syu": "y * u", "sxv": "x * v", "syv": "y * v"}


def moments(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return pairs.groupBy(*keys).agg(*(F.sum(F.expr(e)).alias(k) for k, e in _MOMENTS.items()))


def _similarity() -> dict[str, str]:
    n = "nullif(n, 0e0)"  # in ANSI mode a shared division fails even where its result is not used
    den = f"(sxx - sx * sx / {n} + syy - sy * sy / {n})"
    re, im = (f"({e}) / nullif({den}, 0e0)" for e in (f"sxu - sx * su / {n} + syv - sy * sv / {n}", f"sxv - sx * sv / {n} - (syu - sy * su / {n})"))
    return {"den": den, "re": re, "im": im}


def solve_similarity(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, re, im, tx, ty, s; null where all points coincide."""
    e = _similarity()
    out = sums.where("n >= 2").selectExpr(*keys, "n", "sx", "sy", "su", "sv", f"CASE WHEN {e['den']} > 1e-9 THEN {e['re']} END AS re", f"CASE WHEN {e['den']} > 1e-9 THEN {e['im']} END AS im")
    return out.selectExpr(*keys, "CAST(n AS BIGINT) AS n", "re", "im", "(su - re * sx + im * sy) / n AS tx", "(sv - im * sx - re * sy) / n AS ty", "sqrt(re * re + im * im) AS s")


def fit_similarity(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return solve_similarity(moments(pairs, keys), keys)


def _det3(m: Sequence[str]) -> str:
    a, b, c, d, e, f, g, h, i = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def affine_sql() -> dict[str, str]:
    """Cramer's rule on the normal equations, about the first moments' origin."""
    m = ["sxx", "sxy", "sx", "sxy", "syy", "sy", "sx", "sy", "n"]
    det = _det3(m)
    out = {}
    for row, right in (("0", ("sxu", "syu", "su")), ("1", ("sxv", "syv", "sv"))):
        for col in range(3):
            own = list(m)
            own[col], own[col + 3], own[col + 6] = right
            out[f"a{row}{col}"] = f"CASE WHEN abs({det}) > 1e-9 THEN {_det3(own)} / nullif({det}, 0e0) END"
    return out


def solve_affine(sums: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n and a00..a12: u = a00 x + a01 y + a02, v = a10 x + a11 y + a12; null where the points lie on a line."""
    return sums.where("n >= 3").selectExpr(*keys, "CAST(n AS BIGINT) AS n", *(f"{e} AS {k}" for k, e in affine_sql().items()))


def fit_affine(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    return solve_affine(moments(pairs, keys), keys)


def from_two(ax: Column, ay: Column, bx: Column, by: Column, au: Column, av: Column, bu: Column, bv: Column) -> tuple[Column, Column, Column, Column]:
    """re, im, tx, ty of the similarity that takes two points to two others."""
    dx, dy, du, dv = bx - ax, by - ay, bu - au, bv - av
    den = dx * dx + dy * dy
    re, im = (dx * du + dy * dv) / den, (dx * dv - dy * du) / den
    return re, im, au - re * ax + im * ay, av - im * ax - re * ay


def moved(df: DataFrame, x: str = "x", y: str = "y", to: tuple[str, str] = ("px", "py")) -> DataFrame:
    """df, which has a similarity's columns, with the transformed point."""
    return df.withColumns({to[0]: F.expr(f"re * {x} - im * {y} + tx"), to[1]: F.expr(f"im * {x} + re * {y} + ty")})


def inverse(sim: DataFrame) -> DataFrame:
    """The similarity that undoes each."""
    den = "(re * re + im * im)"
    out = sim.withColumns({"r_": F.expr(f"re / {den}"), "i_": F.expr(f"-im / {den}")})
    return out.withColumns({"x_": F.expr("-(r_ * tx - i_ * ty)"), "y_": F.expr("-(i_ * tx + r_ * ty)")}).drop("re", "im", "tx", "ty").withColumnsRenamed({"r_": "re", "i_": "im", "x_": "tx", "y_": "ty"})


def leave_one_out(pairs: DataFrame, keys: Sequence[str], model: str = "similarity", least: int = 2) -> DataFrame:
    """keys, n, loo_rmse: each pair is predicted by the fit to the others, whose sums are the group's less its own; null with fewer than least + 1 pairs or
    where no fold can be fitted. No pair is joined with another."""
    if model == "homography":
        return _loo_homography(pairs, keys, least)
    sums = moments(pairs, keys)
    own = {k: f"{k} - {e}" for k, e in _MOMENTS.items()}
    both = pairs.join(sums.hint("merge"), list(keys)).selectExpr(*keys, "x", "y", "u", "v", "n AS n_all", *(f"{e} AS {k}" for k, e in own.items()))
    if model == "similarity":
        e = _similarity()
        fold = both.selectExpr("*", f"CASE WHEN {e['den']} > 1e-9 THEN {e['re']} END AS re", f"CASE WHEN {e['den']} > 1e-9 THEN {e['im']} END AS im")
        error = fold.selectExpr(*keys, "n_all", "re * x - im * y + (su - re * sx + im * sy) / nullif(n, 0e0) - u AS eu", "im * x + re * y + (sv - im * sx - re * sy) / nullif(n, 0e0) - v AS ev")
    else:
        fold = both.selectExpr("*", *(f"{e} AS {k}" for k, e in affine_sql().items()))
        error = fold.selectExpr(*keys, "n_all", "a00 * x + a01 * y + a02 - u AS eu", "a10 * x + a11 * y + a12 - v AS ev")
    return error.groupBy(*keys).agg(F.max("n_all").cast("bigint").alias("n"), F.sqrt(F.avg(F.expr("eu * eu + ev * ev"))).alias("rmse")).selectExpr(*keys, "n", f"CASE WHEN n >= {least} + 1 THEN rmse END AS loo_rmse")


def choose_model(loo: dict[str, DataFrame], keys: Sequence[str], least: dict[str, int] | None = None) -> DataFrame:
    """keys, n, model, loo_rmse. From similarity on, the next model is taken if its error is below 0.85 of the current one's and n is its least number + 3."""
    least = least or {"similarity": 2, "affine": 3, "homography": 4}
    out = None
    for m, df in loo.items():
        own = df.select(*keys, F.col("n").alias(f"n_{m}"), F.col("loo_rmse").alias(f"e_{m}"))
        out = own if out is None else out.join(own.hint("merge"), list(keys), "left")
    first, *others = loo
    out = out.withColumns({"n": F.col(f"n_{first}"), "model": F.lit(first), "loo_rmse": F.col(f"e_{first}")})
    for m in others:
        better = F.coalesce((F.col(f"e_{m}") < 0.85 * F.col("loo_rmse")) & (F.col("n") >= least[m] + 3), F.lit(False))
        out = out.withColumns({"model": F.when(better, F.lit(m)).otherwise(F.col("model")), "loo_rmse": F.when(better, F.col(f"e_{m}")).otherwise(F.col("loo_rmse"))})
    return out.select(*keys, "n", "model", "loo_rmse")


def homography(xy: np.ndarray, uv: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 matrix by the direct linear method on normalised points; None for fewer than four or degenerate ones."""
    if len(xy) < 4:
        return None

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mid = p.mean(0)
        scale = np.sqrt(2) / max(np.hypot(*(p - mid).T).mean(), 1e-12)
        return (p - mid) * scale, np.array([[scale, 0, -scale * mid[0]], [0, scale, -scale * mid[1]], [0, 0, 1]])

    a, ta = normal(xy)
    b, tb = normal(uv)
    one, nil = np.ones(len(a)), np.zeros((len(a), 3))
    p = np.column_stack([a, one])
    rows = np.vstack([np.hstack([p, nil, -b[:, :1] * p]), np.hstack([nil, p, -b[:, 1:] * p])])
    _, size, vt = np.linalg.svd(rows)
    if len(size) >= 9 and size[7] < 1e-10:
        return None
    h = np.linalg.inv(tb) @ vt[-1].reshape(3, 3) @ ta
    return polished(h / h[2, 2], xy, uv) if abs(h[2, 2]) > 1e-12 else None


def polished(h: np.ndarray, xy: np.ndarray, uv: np.ndarray, steps: int = 10) -> np.ndarray:
    """h after up to `steps` damped Gauss-Newton steps on the distances in the target; with four points it is exact already."""
    if len(xy) == 4:
        return h
    p, damp = np.column_stack([xy, np.ones(len(xy))]), 1e-3
    off = lambda h: (p @ h.T)[:, :2] / (p @ h.T)[:, 2:] - uv
    e = off(h)
    for _ in range(steps):
        q = p @ h.T
        w, nil = p / q[:, 2:], np.zeros_like(p)
        slope = np.concatenate([np.hstack([w, nil, -w[:, :2] * (q[:, :1] / q[:, 2:])]), np.hstack([nil, w, -w[:, :2] * (q[:, 1:2] / q[:, 2:])])])
        normal, right = slope.T @ slope, slope.T @ e.T.ravel()
        new = h - np.append(np.linalg.lstsq(normal + damp * np.diag(np.diag(normal)), right, rcond=None)[0], 0).reshape(3, 3)
        fresh = off(new)
        if not np.isfinite(fresh).all() or (fresh**2).sum() >= (e**2).sum():
            damp *= 10
        else:
            h, e, damp = new, fresh, damp / 10
    return h


def _loo_homography(pairs: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """As leave_one_out(). A group is one image pair's matches."""
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        xy, uv = pdf[["x", "y"]].to_numpy(), pdf[["u", "v"]].to_numpy()
        errors = []
        for i in range(len(xy) if len(xy) > least else 0):
            keep = np.arange(len(xy)) != i
            h = homography(xy[keep], uv[keep])
            if h is not None:
                q = h @ [*xy[i], 1]
                errors.append(((q[:2] / q[2] - uv[i]) ** 2).sum())
        return pd.DataFrame([(*key, len(pdf), float(np.sqrt(np.mean(errors))) if errors else None)], columns=[*keys, "n", "loo_rmse"])

    return pairs.groupBy(*keys).applyInPandas(run, f"{kinds}, n bigint, loo_rmse double")


def fit_homography(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n and t00..t22; null where there is none. A group is one image pair's matches."""
    names = [f"t{i}{j}" for i in range(3) for j in range(3)]
    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        h = homography(pdf[["x", "y"]].to_numpy(), pdf[["u", "v"]].to_numpy())
        return pd.DataFrame([(*key, len(pdf), *(h.ravel() if h is not None else [None] * 9))], columns=[*keys, "n", *names])

    return pairs.groupBy(*keys).applyInPandas(run, f"{kinds}, n bigint, {', '.join(f'{x} double' for x in names)}")
