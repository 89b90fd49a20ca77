"""Logistic regression by damped Newton steps."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: np.ndarray, steps: int = 60) -> np.ndarray:
    """The weights of least penalized loss. Steps are halved until the loss falls, so the fit cannot run away."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step, t = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty * w), 1.0
        while (new := loss(w + t * step)) > now and t > 1e-6:
            t /= 2
        if new >= now:
            break
        w, done, now = w + t * step, now - new < 1e-9 * (1 + abs(now)), new
        if done:
            break
    return w
