"""Gram estimators against NumPy on known-truth data (OLS biased, IV not)."""

import math

import numpy as np
import pandas as pd
import pytest

from pricelens.operators import linear as L
from pricelens.operators.aggregates import f_upper_p, t_two_sided_p


@pytest.fixture(scope="module")
def iv_data(spark):
    rng = np.random.default_rng(0)
    n = 4000
    z1 = rng.integers(0, 2, n).astype(float)
    z2 = rng.normal(size=n)
    w = rng.normal(size=n)
    u = rng.normal(size=n)
    t = 1.0 + 0.8 * z1 + 0.5 * z2 + 0.3 * w + u + rng.normal(size=n)
    y = 2.0 - 1.5 * t + 0.7 * w + 2 * u + rng.normal(size=n)
    pdf = pd.DataFrame(dict(y=y, T=t, z1=z1, z2=z2, w=w, c0=np.zeros(n)))
    return spark.createDataFrame(pdf), pdf


def test_ols_matches_lstsq(iv_data):
    df, pdf = iv_data
    gr = L.fit_gram(df, ["T", "w", "y"])
    fit = L.ols(gr, "y", ["T", "w"])
    X = np.column_stack([np.ones(len(pdf)), pdf["T"], pdf["w"]])
    b = np.linalg.lstsq(X, pdf["y"], rcond=None)[0]
    np.testing.assert_allclose([fit.intercept, *fit.coef], b, rtol=1e-8)


def test_2sls_matches_two_stage_numpy_and_drops_constant(iv_data):
    df, pdf = iv_data
    gr = L.fit_gram(df, ["T", "w", "z1", "z2", "c0", "y"])
    res = L.tsls(gr, "y", "T", ["z1", "z2", "c0"], ["w"])
    A = np.column_stack([np.ones(len(pdf)), pdf["z1"], pdf["z2"], pdf["w"]])
    that = A @ np.linalg.lstsq(A, pdf["T"], rcond=None)[0]
    b = np.linalg.lstsq(np.column_stack([np.ones(len(pdf)), that, pdf["w"]]), pdf["y"], rcond=None)[0]
    np.testing.assert_allclose([res.intercept, *res.coef], b, rtol=1e-8)
    assert res.dropped == ["c0"]
    assert abs(res.effect + 1.5) < 0.15            # IV recovers the truth
    ols = L.ols(gr, "y", ["T", "w"])
    assert abs(ols.coef[0] + 1.5) > 0.3             # OLS is biased by the confounder
    assert res.first_stage_f > 10 and res.partial_f > 10


def test_fold_grams_sum_to_total(spark, iv_data):
    from pyspark.sql import functions as F
    df, _ = iv_data
    folded = df.withColumn("fold", (F.monotonically_increasing_id() % 5).cast("int"))
    mom, grams = L.fold_grams(folded, ["T", "y"], "fold")
    total = L.fit_gram(folded, ["T", "y"])
    s = sum(g.G for g in grams.values())
    np.testing.assert_allclose(s, total.G, rtol=1e-9, atol=1e-6)


def test_rescaling_a_feature_leaves_fit_unchanged(spark, iv_data):
    from pyspark.sql import functions as F
    df, _ = iv_data
    a = L.ols(L.fit_gram(df, ["T", "w", "y"]), "y", ["T", "w"])
    b = L.ols(L.fit_gram(df.withColumn("w", F.col("w") * 1000), ["T", "w", "y"]), "y", ["T", "w"])
    np.testing.assert_allclose(a.coef[0], b.coef[0], rtol=1e-9)
    np.testing.assert_allclose(a.coef[1], b.coef[1] * 1000, rtol=1e-9)


def test_p_values_against_table_values():
    assert abs(t_two_sided_p(2.0, 10) - 0.0734) < 1e-4
    assert abs(t_two_sided_p(1.96, 1e6) - 0.05) < 1e-4
    assert abs(f_upper_p(4.0, 2, 20) - 0.0346) < 1e-4


def test_robust_errors_and_diagnostics_match_numpy(iv_data):
    df, pdf = iv_data
    gr = L.fit_gram(df, ["T", "w", "z1", "z2", "c0", "y"])
    ivs, n = ["z1", "z2", "c0"], len(pdf)
    res = L.tsls(gr, "y", "T", ivs, ["w"])
    one, t, w, y = np.ones(n), pdf["T"].to_numpy(), pdf["w"].to_numpy(), pdf["y"].to_numpy()
    A = np.column_stack([one, pdf["z1"], pdf["z2"], w])
    that = A @ np.linalg.lstsq(A, t, rcond=None)[0]
    X, H = np.column_stack([one, t, w]), np.column_stack([one, that, w])
    b = np.linalg.lstsq(H, y, rcond=None)[0]
    u = y - X @ b
    bread = np.linalg.inv(H.T @ H)
    hc0 = bread @ (H * (u ** 2)[:, None]).T @ H @ bread
    got = L.robust_cov(df, gr, res, "y", "T", ivs, ["w"])
    np.testing.assert_allclose(np.diag(got)[1:], np.diag(hc0)[1:], rtol=1e-7)
    # the naive form uses the residuals of the second stage itself
    second = y - H @ b
    np.testing.assert_allclose(res.se, np.sqrt(second @ second / (n - 3) * bread[1, 1]), rtol=1e-7)
    # partial F: both instruments against the first stage without them
    ssr = lambda D, v: float(np.sum((v - D @ np.linalg.lstsq(D, v, rcond=None)[0]) ** 2))
    full, less = ssr(A, t), ssr(np.column_stack([one, w]), t)
    np.testing.assert_allclose(res.partial_f, (less - full) / 2 / (full / (n - 4)), rtol=1e-7)
    # Sargan: n times the R2 of the structural residuals on all instruments, chi-squared with one degree of freedom
    j = n * (1 - ssr(A, u) / np.sum((u - u.mean()) ** 2))
    np.testing.assert_allclose(res.sargan_j, j, rtol=1e-5)
    np.testing.assert_allclose(res.sargan_p, math.erfc(math.sqrt(j / 2)), rtol=1e-4)
    # Durbin-Wu-Hausman: t of the first stage's residual beside the price; the price is endogenous here
    D = np.column_stack([one, t, w, t - that])
    c, s2 = np.linalg.lstsq(D, y, rcond=None)[0], ssr(D, y) / (n - 4)
    np.testing.assert_allclose(res.dwh_t, c[3] / math.sqrt(s2 * np.linalg.inv(D.T @ D)[3, 3]), rtol=1e-6)
    assert abs(res.dwh_t) > 3


def test_registered_2sls_rows_match_numpy(spark, sf_dir):
    from pricelens.plans import q_model as q
    from pricelens.plans.common import features
    cols = [q.TARGET, q.TREATMENT, *q.CONTROLS, *q.INSTRUMENTS]
    pdf = features(spark, sf_dir).select(*cols).na.drop().toPandas().astype(float)
    ivs = [z for z in q.INSTRUMENTS if pdf[z].std(ddof=0) > 0]
    n, y, t = len(pdf), pdf[q.TARGET].to_numpy(), pdf[q.TREATMENT].to_numpy()
    centre = lambda c: pdf[c].to_numpy() - pdf[c].mean()
    W = np.column_stack([centre(c) for c in q.CONTROLS])
    A = np.column_stack([np.ones(n), *[centre(z) for z in ivs], W])
    that = A @ np.linalg.lstsq(A, t, rcond=None)[0]
    H = np.column_stack([np.ones(n), that, W])
    b = np.linalg.lstsq(H, y, rcond=None)[0]
    u = y - np.column_stack([np.ones(n), t, W]) @ b
    bread = np.linalg.inv(H.T @ H)
    se = np.sqrt(np.diag(bread @ (H * (u ** 2)[:, None]).T @ H @ bread))
    got = {r["term"]: r for r in q.m5_iv_robust(spark, sf_dir).collect()}
    for i, name in enumerate([q.TREATMENT, *q.CONTROLS], start=1):
        np.testing.assert_allclose([got[name]["value"], got[name]["robust_se"]], [b[i], se[i]], rtol=1e-5)
    diag = q.m6_iv_diagnostics(spark, sf_dir).first()
    fitted = A @ np.linalg.lstsq(A, u, rcond=None)[0]
    np.testing.assert_allclose(diag["sargan_j"], n * (1 - np.sum((u - fitted) ** 2) / np.sum((u - u.mean()) ** 2)), rtol=1e-4, atol=1e-6)
    if len(ivs) == 3:
        np.testing.assert_allclose(diag["sargan_p"], math.exp(-diag["sargan_j"] / 2), rtol=1e-4)
