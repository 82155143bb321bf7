"""Small dense logistic regression for models fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Standardised features, ridge penalty, Newton steps; predicts the probability of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 30) -> None:
        x = np.asarray(x, float)
        self.prior = float(np.clip((y * 1.0).sum() + 0.5, 0.5, None) / (len(y) + 1.0))
        self.mean, self.scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.scale = np.where(self.scale > 1e-9, self.scale, 1.0)
        self.theta = np.zeros(x.shape[1] + 1)
        self.theta[-1] = np.log(self.prior / (1 - self.prior))
        if not len(x) or y.min() == y.max():
            return
        a = self._design(x)
        w = np.ones(len(x)) if weight is None else weight
        penalty = np.full(a.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ self.theta, -35, 35)))
            gradient = a.T @ (w * (p - y)) + penalty * self.theta
            hessian = (a * (w * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            self.theta -= step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._design(np.asarray(x, float)) @ self.theta, -35, 35)))
