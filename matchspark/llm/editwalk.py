"""Randomised edit embedding: one shared random walk turns edit distance into Hamming distance.

At step j the walk writes the character under its pointer and moves on by 0 or 1, as a random bit
shared by all texts for (j, character) says. Equal stretches of two texts bring their walks together
again soon after an edit, so most of what they write from then on agrees, step by step.

Only sampled steps are kept: ``SAMPLES`` per scale, a scale being the steps that a text of up to 2**t
characters needs. A sample is one byte, a hash of the four characters read from the pointer on; 0 says
the walk has ended. A fingerprint holds the scale of its text and the two next ones, so texts whose
lengths differ up to fourfold share a scale.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SAMPLES = 64
SCALES = 3
_FIRST, _LAST = 4, 40
_END = 63  # class of the end of a text; the walk stays there
_READ = 4


def scale_of(n_chars: int) -> int:
    return max(_FIRST, int(n_chars - 1).bit_length() if n_chars > 1 else 0)


@lru_cache(maxsize=64)
def steps_of(scale: int) -> np.ndarray:
    """The sampled steps of a scale, ascending."""
    rng = np.random.default_rng(1000 + scale)
    return np.sort(rng.integers(0, 2 << scale, SAMPLES))


@lru_cache(maxsize=8)
def _moves(block: int, size: int) -> np.ndarray:
    """Random words for the steps of a block: bit c says whether class c moves on."""
    words = np.random.default_rng([77, block]).integers(0, 2**63, size, dtype=np.uint64)
    return words & np.uint64(~(1 << _END) & (2**64 - 1))


_CLASS = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(_END)
_CLASS = _CLASS.astype(np.uint8)


def classes(text: str) -> np.ndarray:
    """A text as character classes 0..62, one per code point."""
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return _CLASS[(codes ^ (codes >> np.uint32(16)) * np.uint32(40503)) & np.uint32(0xFFFF)]


def embed(texts: list[np.ndarray]) -> list[bytes]:
    """Fingerprints of texts given as classes: the scale, then ``SCALES`` times ``SAMPLES`` bytes."""
    if not texts:
        return []
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    end = np.full(_READ, _END, np.uint8)
    data = np.concatenate([x for i in order for x in (texts[i], end)])
    size = np.array([len(texts[i]) for i in order], np.int64)
    start = np.concatenate([[0], np.cumsum(size + _READ)[:-1]])
    stop = start + size
    scales = [scale_of(int(n)) for n in size]
    top = max(scales) + SCALES - 1
    taken = {}  # step -> rows of the record that want it
    for s in range(_FIRST, top + 1):
        for k, j in enumerate(steps_of(s).tolist()):
            taken.setdefault(j, []).append((s - _FIRST) * SAMPLES + k)
    record = np.zeros(((top - _FIRST + 1) * SAMPLES, len(texts)), np.uint8)
    lanes = np.flatnonzero(size > 0)
    place, last = start[lanes], stop[lanes]
    wanted = sorted(taken)
    block = 1 << 12
    step, w = 0, 0
    while len(lanes) and w < len(wanted):
        words = _moves(step // block, block)
        for j in range(step, step + block):
            if w < len(wanted) and wanted[w] == j:
                value = data[place].astype(np.uint32)
                alive = value != _END
                for r in range(1, _READ):
                    value = value * np.uint32(67) + data[np.minimum(place + r, last)]
                value = (value * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(255) + np.uint32(1)
                record[np.ix_(taken[j], lanes)] = np.where(alive, value, 0).astype(np.uint8)
                w += 1
            place += (words[j - step] >> data[place]).astype(np.int64) & 1
        step += block
        going = place < last
        if not going.all():
            lanes, place, last = lanes[going], place[going], last[going]
    out = [b""] * len(texts)
    for lane, i in enumerate(order):
        a = (scales[lane] - _FIRST) * SAMPLES
        out[i] = bytes([scales[lane]]) + record[a:a + SCALES * SAMPLES, lane].tobytes()
    return out


def likeness(a: bytes, b: bytes) -> float:
    """Share of the samples of the longer text's scale that agree, samples past both ends left out."""
    if a == b:
        return 1.0
    scale = max(a[0], b[0])
    if min(a[0], b[0]) + SCALES <= scale:
        return 0.0  # lengths differ more than fourfold
    x, y = (np.frombuffer(f, np.uint8, SAMPLES, 1 + (scale - f[0]) * SAMPLES) for f in (a, b))
    some = (x > 0) | (y > 0)
    return float((x == y)[some].mean()) if some.any() else float(a == b)
