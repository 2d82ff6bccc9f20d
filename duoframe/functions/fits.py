"""Small bounded least-squares fits on a few hundred histogram points."""

from __future__ import annotations

import numpy as np


def moffat(x, amp, mu, alpha, beta):
    return amp * (1.0 + ((x - mu) / alpha) ** 2) ** (-beta)


def gauss(x, amp, mu, sigma):
    return amp * np.exp(-0.5 * ((x - mu) / sigma) ** 2)


def bounded_fit(model, x, y, start, low, high, rounds: int = 300) -> np.ndarray | None:
    """Damped least squares with the parameters kept inside their bounds; None if it diverges."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    low, high = np.asarray(low, float), np.asarray(high, float)
    p = np.clip(np.asarray(start, float), low, high)
    scale = np.maximum(np.abs(p), 1e-3)
    res = model(x, *p) - y
    cost, damp = float(res @ res), 1e-3
    for _ in range(rounds):
        step = 1e-7 * scale
        # one-sided differences that stay inside the bounds
        sign = np.where(p + step > high, -1.0, 1.0)
        jac = np.stack([
            (model(x, *(p + sign[i] * step[i] * np.eye(len(p))[i])) - y - res) / (sign[i] * step[i]) for i in range(len(p))
        ], axis=1)
        grad, hess = jac.T @ res, jac.T @ jac
        # a parameter that sits on a bound and wants to leave is held
        free = ~(((p <= low) & (grad > 0)) | ((p >= high) & (grad < 0)))
        if not free.any():
            break
        h = hess[np.ix_(free, free)]
        moved = False
        while damp < 1e12:
            d = np.zeros(len(p))
            try:
                d[free] = -np.linalg.solve(h + damp * np.diag(np.maximum(np.diag(h), 1e-30)), grad[free])
            except np.linalg.LinAlgError:
                damp *= 10
                continue
            q = np.clip(p + d, low, high)
            r = model(x, *q) - y
            c = float(r @ r)
            if np.isfinite(c) and c < cost:
                moved = True
                break
            damp *= 4
        if not moved:
            break
        gain = (cost - c) / max(cost, 1e-300)
        p, res, cost, damp = q, r, c, max(damp / 9, 1e-12)
        scale = np.maximum(np.abs(p), 1e-3)
        if gain < 1e-14:
            break
    return p if np.all(np.isfinite(p)) else None


def fit_moffat(x, y, mu0: float, lo: float, hi: float):
    """(amp, mu, alpha, beta), or None when there are too few points or no fit."""
    if len(x) <= 5 or np.max(y) <= 0:
        return None
    start = [float(np.max(y)), mu0, max(mu0 - lo, 0.1) / 3.0, 2.5]
    return bounded_fit(moffat, x, y, start, [0, lo, 1e-6, 1.0], [np.inf, hi, max(hi - lo, 2e-6), 20.0])


def fit_gauss(x, y, mu0: float, lo: float):
    """(amp, mu, |sigma|), or None."""
    if len(x) <= 5 or np.max(y) <= 0:
        return None
    start = [float(np.max(y)), mu0, max((mu0 - lo) / 2.0, 1e-6)]
    p = bounded_fit(gauss, x, y, start, [-np.inf, -np.inf, 1e-9], [np.inf, np.inf, np.inf])
    return None if p is None else np.array([p[0], p[1], abs(p[2])])
