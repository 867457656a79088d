"""Largest eigenvalues of a symmetric matrix by contour integration (FEAST).

An interval of eigenvalues is the inside of a circle in the complex plane.  Quadrature over
the circle of the solutions of ``(z - V) X = Y`` projects Y onto the eigenvectors of the
eigenvalues inside; Rayleigh-Ritz on the projected space gives these, and both are repeated
until the residuals vanish.  Inertia counts, the number of negative pivots of ``V - s``, say
how many eigenvalues lie beyond s; they choose the intervals and verify that none is missed.
"""

from __future__ import annotations

import numpy as np

NODES = 8
ROUNDS = 40
# Residuals relative to the norm of the matrix.
CONVERGED = 1e-13
# Eigenvalues looked for in one interval, as far as gaps allow.
PER_INTERVAL = 16


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of a similar tridiagonal matrix (Householder)."""
    a = a.copy()
    n = len(a)
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        x[0] += np.copysign(np.linalg.norm(x), x[0])
        size = x @ x
        if size == 0:
            continue
        part = a[k + 1 :, k + 1 :]
        p = part @ x * (2 / size)
        p -= x * ((p @ x) / size)
        part -= np.outer(x, p) + np.outer(p, x)
        row = a[k + 1 :, k]
        row -= x * (2 * (x @ row) / size)
        a[k, k + 1 :] = row
    return np.diag(a).copy(), np.diag(a, -1).copy()


class Inertia:
    """Counts of eigenvalues, from the signs of the pivots of the shifted matrix."""

    def __init__(self, matrix: np.ndarray):
        self.diagonal, off = tridiagonal(matrix)
        self.squares = np.concatenate(([0.0], off * off))
        reach = np.abs(np.append(off, 0)) + np.abs(np.concatenate(([0.0], off)))
        self.low = float((self.diagonal - reach).min())
        self.high = float((self.diagonal + reach).max())
        self.tiny = np.finfo(float).tiny / np.finfo(float).eps

    def above(self, shift: float) -> int:
        """How many eigenvalues are greater than ``shift``."""
        count, pivot = 0, 1.0
        for d, square in zip(self.diagonal.tolist(), self.squares.tolist(), strict=True):
            pivot = d - shift - square / pivot
            if abs(pivot) < self.tiny:
                pivot = -self.tiny
            count += pivot > 0
        return count

    def value(self, rank: int) -> float:
        """The eigenvalue of this rank from above, from 1, by bisection."""
        low, high = self.low, self.high
        while True:
            middle = (low + high) / 2
            if not low < middle < high:
                return middle
            low, high = (middle, high) if self.above(middle) >= rank else (low, middle)


def project(matrix: np.ndarray, low: float, high: float, y: np.ndarray) -> np.ndarray:
    """Quadrature of the resolvent applied to ``y`` over the circle through low and high.

    The matrix is real, so the upper half of the circle stands for both."""
    centre, radius = (low + high) / 2, (high - low) / 2
    points, weights = np.polynomial.legendre.leggauss(NODES)
    out = np.zeros_like(y)
    for x, w in zip(points, weights, strict=True):
        turn = np.exp(0.5j * np.pi * (1 - x))
        solved = np.linalg.solve((centre + radius * turn) * np.eye(len(matrix)) - matrix, y)
        out += (0.5 * w * radius * turn * solved).real
    return out


def rayleigh_ritz(matrix: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    q, _ = np.linalg.qr(space)
    small = q.T @ matrix @ q
    values, turned = np.linalg.eigh((small + small.T) / 2)
    return values, q @ turned


def inside(
    matrix: np.ndarray, inertia: Inertia, low: float, high: float
) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues between low and high with their vectors, as many as inertia counts."""
    d, wanted = len(matrix), inertia.above(low) - inertia.above(high)
    norm = max(abs(inertia.low), abs(inertia.high))
    size = min(d, wanted + max(4, wanted // 2))
    while True:
        space = np.random.default_rng(size).normal(size=(d, size))
        before = np.inf
        for _ in range(ROUNDS):
            # Twice orthogonal: a projection leaves almost nothing of what lies outside.
            near = np.linalg.qr(project(matrix, low, high, space))[0]
            values, vectors = rayleigh_ritz(matrix, near)
            space = vectors
            found = np.flatnonzero((values > low) & (values < high))
            residual = np.abs(matrix @ vectors[:, found] - vectors[:, found] * values[found])
            worst = float(residual.max(initial=0.0)) / norm
            if len(found) == wanted and (worst < CONVERGED or worst < 1e-11 and worst > before / 2):
                return values[found], vectors[:, found]
            before = worst
        if size == d:
            raise ArithmeticError(f"{wanted} eigenvalues counted, {len(found)} found")
        size = min(d, 2 * size)


def largest(matrix: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest positive eigenvalues, falling, and unit eigenvectors in columns.

    Eigenvalues that rounding cannot tell from 0 are left out, so there may be fewer.
    """
    d = len(matrix)
    scale = float(np.abs(matrix).max(initial=0.0))
    if scale == 0.0 or count < 1:
        return np.zeros(0), np.zeros((d, 0))
    matrix = matrix / scale
    inertia = Inertia(matrix)
    norm = max(abs(inertia.low), abs(inertia.high))
    noise = 8 * d * np.finfo(float).eps * norm
    wanted = min(count, inertia.above(noise))
    # Borders in the middle of gaps; equal eigenvalues stay together.
    ranked = [inertia.value(r) for r in range(1, min(d, wanted + 1) + 1)]
    margin = 1e-6 * norm
    borders, taken = [ranked[0] + max(margin, 0.05 * abs(ranked[0]))], 0
    for r in range(1, wanted + 1):
        lower = ranked[r] if r < len(ranked) else min(0.0, inertia.low) - margin
        gap = ranked[r - 1] - lower
        if (r - taken >= PER_INTERVAL and gap > 1e-3 * ranked[0]) or r == wanted:
            taken = r
            while gap <= 4 * noise and len(ranked) < d:
                ranked.append(inertia.value(len(ranked) + 1))
                gap = ranked[-2] - ranked[-1]
                lower = ranked[-1]
            if gap <= 4 * noise:
                lower, gap = ranked[-1] - 2 * margin, 2 * margin
            borders.append(lower + gap / 2)
    parts = [
        inside(matrix, inertia, low, high)
        for high, low in zip(borders, borders[1:], strict=False)
    ]
    values, vectors = rayleigh_ritz(matrix, np.hstack([v for _, v in parts]))
    order = np.argsort(-values, kind="stable")[:wanted]
    return values[order] * scale, vectors[:, order]
