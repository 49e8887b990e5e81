"""Learned rotated binary codes: directions are rotated so that their signs lose little (iterative quantisation)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Codes:
    """Rotations (one per 64-bit word of a code, each learned from its own start) and the largest norm."""

    rotation: np.ndarray  # (dim + 1, bits)
    longest: float
    slack: float = 2.0

    @property
    def bits(self) -> int:
        return self.rotation.shape[1]

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Codes of index rows as (n, bits/16) words of 16 bits. The added coordinate makes all norms equal."""
        rest = np.sqrt(np.maximum(self.longest ** 2 - (x * x).sum(axis=1), 0))
        return self._signs(np.concatenate([x, rest[:, None]], axis=1))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return self._signs(np.concatenate([q, np.zeros((len(q), 1))], axis=1))

    def _signs(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.rotation > 0, axis=1).view(np.uint16)

    def expected(self, cosine: np.ndarray) -> np.ndarray:
        """Share of differing bits of two vectors at this cosine."""
        return np.arccos(np.clip(cosine, -1, 1)) / np.pi

    def radius(self, cosine: np.ndarray) -> np.ndarray:
        """Bits within which the code of a vector at least this near is found, but for a small chance."""
        p = self.expected(cosine)
        return np.minimum(np.floor(self.bits * p + self.slack * np.sqrt(self.bits * p * (1 - p)) + 1), self.bits)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of codes, all of ``a`` with all of ``b``."""
    out = np.zeros((len(a), len(b)), np.int32)
    for k in range(a.shape[1]):
        out += np.bitwise_count(a[:, k][:, None] ^ b[:, k][None, :])
    return out


def learn(sample: np.ndarray, longest: float, bits: int = 128, rounds: int = 20, seed: int = 11) -> Codes:
    """Alternate between signs and the rotation that fits them best, on the sample; then measure the slack."""
    dim = sample.shape[1] + 1
    rng = np.random.default_rng(seed)
    rest = np.sqrt(np.maximum(longest ** 2 - (sample * sample).sum(axis=1), 0))
    x = np.concatenate([sample, rest[:, None]], axis=1)
    blocks = []
    while sum(b.shape[1] for b in blocks) < bits:
        r = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ vt
        blocks.append(r)
    codes = Codes(np.concatenate(blocks, axis=1)[:, :bits], longest)
    # widen the radius until it holds 99 % of the nearest pairs of the sample
    q = sample[:512]
    scores = q @ sample.T
    np.fill_diagonal(scores, -np.inf)
    k = min(20, len(sample) - 1)
    if k > 0:
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        cosine = np.take_along_axis(scores, near, 1) / (np.linalg.norm(q, axis=1)[:, None] * longest)
        found = np.take_along_axis(distances(codes.of_queries(q), codes.of_rows(sample)), near, 1)
        p = codes.expected(cosine)
        over = (found - bits * p) / np.sqrt(np.maximum(bits * p * (1 - p), 1))
        codes.slack = float(max(2.0, np.quantile(over, 0.99)))
    return codes
