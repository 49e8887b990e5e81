"""Eigenvectors of a symmetric matrix: a float32 solution refined by matrix products in higher precision.

Ogita and Aishima's iteration corrects all eigenvectors at once: from R = I - X'X and S = X'AX follow the
eigenvalues s_ii / (1 - r_ii) and a correction X E with e_ij = (s_ij + l_j r_ij) / (l_j - l_i), or r_ij / 2
where the two eigenvalues can't be told apart. It converges quadratically while the gaps are resolved.
Vectors of a cluster are only right as a subspace then, so each cluster gets a sub-solve: the matrix, shifted
by the cluster's mean, is projected on its vectors, that small problem is solved in double and rotates them, and
the iteration goes on, which now sees the gaps inside the cluster. Products are in ``longdouble``.
"""

from __future__ import annotations

import numpy as np

#: Quadratic convergence from single precision needs three or four rounds; clusters as many again.
ROUNDS = 24


def correction(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(X E, eigenvalues, threshold under which two eigenvalues count as one)."""
    r = np.eye(len(a), dtype=x.dtype) - x.T @ x
    s = x.T @ (a @ x)
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    delta = float(2 * (np.linalg.norm(off.astype(float)) + np.linalg.norm(a.astype(float)) * np.linalg.norm(r.astype(float))))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > delta
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x @ e, values, delta


def clusters(values: np.ndarray, delta: float) -> list[np.ndarray]:
    """Indices of eigenvalues that follow each other within ``delta``, of clusters of two or more."""
    order = np.argsort(-values)
    cuts = np.flatnonzero(-np.diff(values[order]) > delta) + 1
    return [part for part in np.split(order, cuts) if len(part) > 1]


def sub_solve(a: np.ndarray, x: np.ndarray, part: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The vectors of a cluster, rotated to eigenvectors of the matrix projected on them."""
    mean = values[part].mean()
    v = x[:, part]
    small = v.T @ (a @ v - mean * v)
    scale = np.abs(small).max()
    if scale == 0:
        return v
    _, turn = np.linalg.eigh(((small + small.T) / (2 * scale)).astype(np.float64))
    return v @ turn[:, ::-1].astype(x.dtype)


def eigen(matrix: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision.

    Equal eigenvalues give some orthonormal basis of their space. The empty and the zero matrix are allowed.
    """
    n = len(matrix)
    scale = float(np.abs(matrix).max()) if n else 0.0
    if scale == 0:
        return np.zeros(n), np.eye(n)
    a = np.asarray(matrix, np.longdouble) / scale
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1][:, ::-1].astype(np.longdouble)
    best = np.inf
    solved: set[bytes] = set()
    for _ in range(rounds):
        step, values, delta = correction(a, x)
        x = x + step
        size = float(np.abs(step).max())
        stuck = size < 1e-12 or size > best / 2
        best = min(best, size)
        if not stuck:
            continue
        again = False
        for part in clusters(values, delta):
            if (key := np.sort(part).tobytes()) not in solved:
                solved.add(key)
                x[:, part] = sub_solve(a, x, part, values)
                again = True
        if not again and size < 1e-15:
            break
        best = np.inf
    for _ in range(4):  # what is left of the last rotation's rounding
        x = x + x @ (np.eye(n, dtype=x.dtype) - x.T @ x) / 2
    values = np.diag(x.T @ (a @ x)) / np.diag(x.T @ x)
    order = np.argsort(-values, kind="stable")
    x = x[:, order] / np.sqrt((x[:, order] ** 2).sum(axis=0))
    return (values[order] * scale).astype(np.float64), x.astype(np.float64)
