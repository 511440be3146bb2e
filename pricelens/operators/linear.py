"""Closed-form linear estimators from one distributed Gram aggregation.

Plan: pass 1 computes column means and population sds (one ``agg``); pass 2 computes the
*centred* cross-product matrix of [1, v1, …, vk] per group (fold / segment) in one ``groupBy``.
The shuffle carries groups × (k+1)² numbers, independent of the row count. Everything after that —
OLS, the three 2SLS forms, first-stage F statistics, over-identification and Durbin-Wu-Hausman
tests, per-fold CV — is p×p linear algebra on the driver (pseudo-inverse, so zero-variance
instruments are tolerated and reported, T21). Only the robust sandwich (form C) needs a second
pass, which again aggregates (k+1)² sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.operators.aggregates import f_upper_p, t_two_sided_p


# --- the Gram aggregation ------------------------------------------------------------------------

def column_moments(df: DataFrame, cols: Sequence[str]) -> dict:
    """Pass 1: mean and population sd of each column over complete rows (one-row scalars)."""
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
                 F.count(F.lit(1)).alias("n")).first()
    return {"n": row["n"], "mean": np.array([row[f"m{i}"] or 0.0 for i in range(len(cols))], dtype=float),
            "sd": np.array([row[f"s{i}"] or 0.0 for i in range(len(cols))], dtype=float)}


def gram_frame(df: DataFrame, cols: Sequence[str], means: np.ndarray, group_cols: Sequence[str] = ()) -> DataFrame:
    """Pass 2 (lazy): per group n and the upper triangle of Σ z zᵀ, z = [1, v - mean]."""
    z = [F.lit(1.0)] + [(F.col(c).cast("double") - F.lit(float(m))) for c, m in zip(cols, means)]
    k = len(z)
    sums = [F.sum(z[i] * z[j]).alias(f"g_{i}_{j}") for i in range(k) for j in range(i, k)]
    return df.groupBy(*group_cols).agg(*sums)


def _to_matrix(row, k: int) -> np.ndarray:
    g = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"] or 0.0
    return g


def collect_grams(df: DataFrame, cols: Sequence[str], group_cols: Sequence[str] = (), moments: dict | None = None):
    """Run passes 1-2 on complete rows; returns (moments, {group_key: Gram})."""
    clean = df.select(*group_cols, *cols).na.drop(subset=list(cols))
    mom = moments or column_moments(clean, cols)
    rows = gram_frame(clean, cols, mom["mean"], group_cols).collect()  # groups × (k+1)² numbers
    k = len(cols) + 1
    out = {tuple(r[g] for g in group_cols): _to_matrix(r, k) for r in rows}
    return mom, out


# --- algebra on a centred Gram -------------------------------------------------------------------

@dataclass
class Gram:
    """Centred Gram of [1, cols…]; index 0 is the intercept."""
    cols: list
    G: np.ndarray
    mean: np.ndarray
    sd: np.ndarray = field(default=None)

    @property
    def n(self) -> float:
        return self.G[0, 0]

    def idx(self, names: Sequence[str]) -> list:
        return [self.cols.index(c) + 1 for c in names]

    def sub(self, rows, cols_=None) -> np.ndarray:
        cols_ = rows if cols_ is None else cols_
        return self.G[np.ix_(rows, cols_)]

    def __sub__(self, other: "Gram") -> "Gram":
        return Gram(self.cols, self.G - other.G, self.mean, self.sd)

    def __add__(self, other: "Gram") -> "Gram":
        return Gram(self.cols, self.G + other.G, self.mean, self.sd)


@dataclass
class Fit:
    names: list          # regressor names (no intercept)
    coef: np.ndarray     # slopes in original units
    intercept: float
    ssr: float
    sst: float
    n: float
    cov_unscaled: np.ndarray  # (XᵀX)⁻¹ incl. intercept, centred basis

    @property
    def r2(self) -> float:
        return 1.0 - self.ssr / self.sst if self.sst > 0 else float("nan")

    @property
    def k(self) -> int:
        return len(self.names)

    def se(self) -> np.ndarray:
        dof = self.n - self.k - 1
        s2 = self.ssr / dof if dof > 0 else float("nan")
        return np.sqrt(np.clip(np.diag(self.cov_unscaled)[1:] * s2, 0, None))

    def f_overall(self) -> float:
        dof = self.n - self.k - 1
        r2 = self.r2
        return (r2 / self.k) / ((1 - r2) / dof) if self.k and dof > 0 and r2 < 1 else 0.0


def solve(G: np.ndarray, design: np.ndarray, target: np.ndarray) -> tuple:
    """Regress target = Vᵀt on design = V·D (linear maps of the Gram basis V = [1, v…]).

    Columns are scaled to unit length first, so that a large unit (money beside shares) costs no digits.
    Returns (β in the design basis, SSR, (DᵀGD)⁺)."""
    A = design.T @ G @ design
    b = design.T @ G @ target
    size = np.sqrt(np.clip(np.diag(A), 0, None))
    scale = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    inv = np.linalg.pinv(A * np.outer(scale, scale), rcond=1e-12) * np.outer(scale, scale)
    beta = inv @ b
    ssr = float(target @ G @ target - 2 * beta @ b + beta @ A @ beta)
    return beta, max(ssr, 0.0), inv


def _basis(gr: Gram, names: Sequence[str]) -> np.ndarray:
    d = np.zeros((len(gr.cols) + 1, len(names) + 1))
    d[0, 0] = 1.0
    for j, i in enumerate(gr.idx(names)):
        d[i, j + 1] = 1.0
    return d


def _unit(gr: Gram, name: str) -> np.ndarray:
    t = np.zeros(len(gr.cols) + 1)
    t[gr.idx([name])[0]] = 1.0
    return t


def _sst(gr: Gram, t: np.ndarray) -> float:
    # centred around the fitted mean: Σ(t - t̄)² = tᵀGt - (Σt)²/n
    s = t @ gr.G[:, 0]
    return float(t @ gr.G @ t - s * s / gr.n)


def _intercept(gr: Gram, design: np.ndarray, beta: np.ndarray, target: np.ndarray) -> float:
    """Intercept in original units = prediction at v = 0. The basis holds v − mean, so the origin
    is [1, −mean]; the target itself was centred, so its mean shift is added back."""
    origin = np.concatenate([[1.0], -gr.mean])
    return float(origin @ design @ beta + target @ np.concatenate([[0.0], gr.mean]))


def ols(gr: Gram, y: str, xs: Sequence[str]) -> Fit:
    """M2: OLS of y on xs with intercept."""
    D = _basis(gr, xs)
    t = _unit(gr, y)
    beta, ssr, inv = solve(gr.G, D, t)
    return Fit(list(xs), beta[1:], _intercept(gr, D, beta, t), ssr, _sst(gr, t), gr.n, inv)


def standardised_coefs(fit: Fit, gr: Gram) -> np.ndarray:
    """M1/M2: coefficients on features scaled by the population sd (constant column → scale 1, T11)."""
    sd = np.array([gr.sd[gr.cols.index(c)] for c in fit.names])
    return fit.coef * np.where(sd > 0, sd, 1.0)


@dataclass
class IVResult:
    effect: float
    se: float
    t: float
    p: float
    first_stage_r2: float
    first_stage_f: float          # form A: overall F of the first stage
    first_stage_f_form_b: float   # form B: (R²/#instruments)/((1-R²)/(n-#instruments-1))
    partial_f: float              # form C: F test of the excluded instruments
    partial_f_p: float
    second_stage_r2: float
    structural_r2: float
    n: float
    coef: np.ndarray
    names: list
    intercept: float
    dropped: list
    sargan_j: float = float("nan")
    sargan_p: float = float("nan")
    dwh_t: float = float("nan")
    dwh_p: float = float("nan")


def tsls(gr: Gram, y: str, endog: str, instruments: Sequence[str], controls: Sequence[str]) -> IVResult:
    """M3-M6: two-stage least squares and its diagnostics, all from one Gram."""
    dropped = [z for z in instruments if gr.sd is not None and gr.sd[gr.cols.index(z)] == 0]
    ivs = [z for z in instruments if z not in dropped]
    if not ivs:  # form B's fallback: a constant-0 instrument identifies nothing
        ivs = []
    t_y, t_T = _unit(gr, y), _unit(gr, endog)
    A = _basis(gr, list(ivs) + list(controls))           # first-stage design [1, Z, W]
    pi, ssr1, _ = solve(gr.G, A, t_T)
    n = gr.n
    fs = Fit(list(ivs) + list(controls), pi[1:], 0.0, ssr1, _sst(gr, t_T), n, None)
    r2_1 = fs.r2
    k_iv = len(ivs)
    f_b = (r2_1 / k_iv) / ((1 - r2_1) / (n - k_iv - 1)) if k_iv and r2_1 < 1 else 0.0
    # restricted first stage (controls only) for the partial F on the excluded instruments
    Wd = _basis(gr, list(controls))
    _, ssr_r, _ = solve(gr.G, Wd, t_T)
    dof_full = n - (len(ivs) + len(controls)) - 1
    partial_f = ((ssr_r - ssr1) / k_iv) / (ssr1 / dof_full) if k_iv and dof_full > 0 and ssr1 > 0 else 0.0
    # second stage on [1, T̂, W]: T̂ = A·π is a linear map of the basis
    That = A @ pi
    D2 = np.column_stack([_basis(gr, [])[:, 0], That] + [_unit(gr, c) for c in controls])
    beta, ssr2, inv2 = solve(gr.G, D2, t_y)
    sst_y = _sst(gr, t_y)
    k2 = 1 + len(controls)
    dof2 = n - k2 - 1
    s2 = ssr2 / dof2 if dof2 > 0 else float("nan")
    se = float(np.sqrt(max(inv2[1, 1] * s2, 0.0)))
    eff = float(beta[1])
    t = eff / se if se > 0 else float("nan")
    # structural residuals u = y - [1, T, W]·β (actual T)
    Ds = np.column_stack([_basis(gr, [])[:, 0], t_T] + [_unit(gr, c) for c in controls])
    u = t_y - Ds @ beta
    uu = float(u @ gr.G @ u)
    res = IVResult(eff, se, t, t_two_sided_p(t, dof2), r2_1, fs.f_overall(), f_b, partial_f,
                   f_upper_p(partial_f, k_iv, dof_full) if k_iv else float("nan"),
                   1.0 - ssr2 / sst_y if sst_y > 0 else float("nan"),
                   1.0 - uu / sst_y if sst_y > 0 else float("nan"), n, beta[1:], [endog] + list(controls),
                   _intercept(gr, Ds, beta, t_y), dropped)
    # M6 over-identification: J = n·R² of u on all instruments [1, Z, W]
    if k_iv > 1:
        _, ssr_u, _ = solve(gr.G, A, u)
        sst_u = _sst(gr, u)
        r2u = 1.0 - ssr_u / sst_u if sst_u > 0 else 0.0
        res.sargan_j = n * r2u
        q = k_iv - 1
        # chi-square(q) upper tail = regularised upper gamma; via the F limit with large dof
        res.sargan_p = f_upper_p(res.sargan_j / q, q, 1e9)
    # M6 Durbin-Wu-Hausman (control function): t of v̂ = T - T̂ in y ~ [1, T, W, v̂]
    vhat = t_T - That
    Dc = np.column_stack([Ds, vhat])
    bc, ssrc, invc = solve(gr.G, Dc, t_y)
    dofc = n - Dc.shape[1]
    sc = np.sqrt(max(invc[-1, -1] * ssrc / dofc, 0.0)) if dofc > 0 else float("nan")
    res.dwh_t = float(bc[-1] / sc) if sc and sc > 0 else float("nan")
    res.dwh_p = t_two_sided_p(res.dwh_t, dofc)
    return res


def robust_cov(df: DataFrame, gr: Gram, res: IVResult, y: str, endog: str, instruments: Sequence[str],
               controls: Sequence[str]) -> np.ndarray:
    """M5: heteroskedasticity-robust (HC0) covariance of the 2SLS β with structural residuals.

    One more aggregation: Σ u²·d̂ d̂ᵀ with d̂ = [1, T̂, W], T̂ from the first stage."""
    ivs = [z for z in instruments if z not in res.dropped]
    A = _basis(gr, list(ivs) + list(controls))
    pi, _, _ = solve(gr.G, A, _unit(gr, endog))
    That = A @ pi
    D2 = np.column_stack([_basis(gr, [])[:, 0], That] + [_unit(gr, c) for c in controls])
    Ds = np.column_stack([_basis(gr, [])[:, 0], _unit(gr, endog)] + [_unit(gr, c) for c in controls])
    beta, _, inv2 = solve(gr.G, D2, _unit(gr, y))
    u_vec = _unit(gr, y) - Ds @ beta
    z = [F.lit(1.0)] + [(F.col(c).cast("double") - F.lit(float(m))) for c, m in zip(gr.cols, gr.mean)]
    dot = lambda w: sum((F.lit(float(w[i])) * z[i] for i in range(len(z)) if w[i] != 0), F.lit(0.0))
    u = dot(u_vec)
    d = [dot(D2[:, j]) for j in range(D2.shape[1])]
    k = len(d)
    row = df.select(*gr.cols).na.drop().agg(
        *[F.sum(u * u * d[i] * d[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = row[f"m_{i}_{j}"] or 0.0
    return inv2 @ meat @ inv2


def fold_grams(df: DataFrame, cols: Sequence[str], fold_col: str) -> tuple:
    """One ``groupBy(fold)`` gives every fold's Gram; train Gram = total − fold."""
    mom, per = collect_grams(df, cols, [fold_col])
    grams = {k[0]: Gram(list(cols), g, mom["mean"], mom["sd"]) for k, g in per.items()}
    return mom, grams


def predict_expr(fit: Fit) -> "F.Column":
    """Linear predictor as a column expression (coefficients are literals: a broadcast by value)."""
    expr = F.lit(float(fit.intercept))
    for c, b in zip(fit.names, fit.coef):
        expr = expr + F.lit(float(b)) * F.col(c).cast("double")
    return expr


def fit_gram(df: DataFrame, cols: Sequence[str]) -> Gram:
    mom, per = collect_grams(df, cols)
    return Gram(list(cols), per[()], mom["mean"], mom["sd"])
