"""A bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The sequence is one run of letters between two blanks, as UTF-8 bytes; every byte position gets label
probabilities. Sequences are handled in groups of equal length, so no padding is needed.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 16


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class ByteGru:
    """Parameters: per direction an input table (256, 3H) and a recurrent matrix (H, 3H), then the output layer."""

    def __init__(self, n_labels: int, hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = self.hidden = hidden
        draw = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"xf": draw(256, 3 * h), "uf": draw(h, 3 * h), "xb": draw(256, 3 * h), "ub": draw(h, 3 * h),
                  "v": draw(2 * h, n_labels), "c": np.zeros(n_labels, np.float32)}

    def _run(self, seq: np.ndarray, x: np.ndarray, u: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (T, B, H) of one direction; ``keep`` collects what the way back needs."""
        h = self.hidden
        state = np.zeros((len(seq), h), np.float32)
        out = np.empty((seq.shape[1], len(seq), h), np.float32)
        for t in range(seq.shape[1]):
            a, b = x[seq[:, t]], state @ u
            gates = _sigmoid(a[:, :2 * h] + b[:, :2 * h])
            z, r = gates[:, :h], gates[:, h:]
            n = np.tanh(a[:, 2 * h:] + r * b[:, 2 * h:])
            new = n + z * (state - n)
            if keep is not None:
                keep.append((state, z, r, n, b[:, 2 * h:]))
            out[t] = state = new
        return out

    def states(self, seq: np.ndarray) -> np.ndarray:
        back = self._run(seq[:, ::-1], self.p["xb"], self.p["ub"])[::-1]
        return np.concatenate([self._run(seq, self.p["xf"], self.p["uf"]), back], axis=2)

    def probabilities(self, seq: np.ndarray) -> np.ndarray:
        """(T, B, labels) of sequences (B, T) of bytes."""
        logits = self.states(seq) @ self.p["v"] + self.p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=2, keepdims=True)

    def _back(self, seq, x, u, kept, d_out):
        """Backpropagation through time of one direction: gradients of its table and matrix."""
        h = self.hidden
        d_u = np.zeros_like(u)
        d_x = np.zeros_like(x)
        eye = np.eye(256, dtype=np.float32)
        carry = np.zeros_like(d_out[0])
        for t in range(seq.shape[1] - 1, -1, -1):
            state, z, r, n, b_n = kept[t]
            d = d_out[t] + carry
            d_n = d * (1 - z) * (1 - n * n)
            d_z = d * (state - n) * z * (1 - z)
            d_r = d_n * b_n * r * (1 - r)
            d_b = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_u += state.T @ d_b
            d_x += eye[seq[:, t]].T @ np.concatenate([d_z, d_r, d_n], axis=1)
            carry = d * z + d_b @ u.T
        return d_x, d_u

    def gradients(self, seq: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions, every position labelled like its sequence."""
        h, p = self.hidden, self.p
        kept_f, kept_b = [], []
        rev = seq[:, ::-1]
        f = self._run(seq, p["xf"], p["uf"], kept_f)
        b = self._run(rev, p["xb"], p["ub"], kept_b)
        s = np.concatenate([f, b[::-1]], axis=2)
        logits = s @ p["v"] + p["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        rows = np.arange(len(seq))
        loss = float(-np.log(prob[:, rows, label] + 1e-9).mean())
        prob[:, rows, label] -= 1
        prob /= prob.shape[0] * prob.shape[1]
        g = {"v": np.einsum("tbh,tbk->hk", s, prob), "c": prob.sum(axis=(0, 1))}
        d = prob @ p["v"].T
        g["xf"], g["uf"] = self._back(seq, p["xf"], p["uf"], kept_f, d[:, :, :h])
        g["xb"], g["ub"] = self._back(rev, p["xb"], p["ub"], kept_b, d[::-1, :, h:])
        return loss, g

    def fit(self, groups: list[tuple[np.ndarray, np.ndarray]], epochs: int = 4, batch: int = 256,
            rate: float = 0.01, seed: int = 7) -> float:
        """Adam over groups of equal length: (sequences, labels). Returns the last epoch's mean loss."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, loss = 0, 0.0
        for epoch in range(epochs):
            todo = []
            for seq, label in groups:
                order = rng.permutation(len(seq))
                todo += [(seq[order[i:i + batch]], label[order[i:i + batch]]) for i in range(0, len(seq), batch)]
            losses = []
            for k in rng.permutation(len(todo)):
                one, g = self.gradients(*todo[k])
                losses.append(one)
                step += 1
                lr = rate * (0.5 ** epoch) * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
                for key, grad in g.items():
                    m[key] += 0.1 * (grad - m[key])
                    v[key] += 0.001 * (grad * grad - v[key])
                    self.p[key] -= (lr * m[key] / (np.sqrt(v[key]) + 1e-8)).astype(np.float32)
            loss = float(np.mean(losses)) if losses else 0.0
        return loss
