"""Sets of word shingles as 64-bit numbers, computed with numpy over many texts at once."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit; each ``salt`` is another one."""
    x = x + np.uint64((_BASE * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size, base = 1 << (n - 1).bit_length(), _BASE | 1
            for name, step in (("up", base), ("down", pow(base, -1, 2**64))):
                steps = np.full(size, step, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word and the number of the text that it is in."""
    lengths = np.array([len(t) + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = _SPACE[data]
    edges = np.diff(np.r_[True, space].astype(np.int8))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return hashes, np.searchsorted(np.cumsum(lengths), starts, side="right")


def shingle_sets(texts: list[str | bytes | None], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct shingles; with fewer words the whole text is one, without words none.

    Words are what stands between ASCII white space once A-Z are lowered.
    """
    raw = [(t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace")).lower() for t in texts]
    out: list[np.ndarray] = []
    at = 0
    while at < len(raw):  # blocks of a few MB, or one longer text
        end, size = at, 0
        while end < len(raw) and (end == at or size + len(raw[end]) <= 4 << 20):
            size += len(raw[end]) + 1
            end += 1
        hashes, owner = word_hashes(raw[at:end])
        bounds = np.searchsorted(owner, np.arange(end - at + 1))
        rolled = hashes[: max(0, len(hashes) - width + 1)]
        for k in range(1, width):
            rolled = mix(rolled * np.uint64(3) + hashes[k : k + len(rolled)], k)
        for i in range(end - at):
            a, b = bounds[i], bounds[i + 1]
            if b - a >= width:
                s = np.sort(rolled[a : b - width + 1])
                out.append(s[np.r_[True, s[1:] != s[:-1]]])
            elif b > a:
                whole = np.full(1, b - a, np.uint64)
                for h in hashes[a:b]:
                    whole = mix(whole * np.uint64(3) + h, 99)
                out.append(whole)
            else:
                out.append(np.empty(0, np.uint64))
        at = end
    return out
