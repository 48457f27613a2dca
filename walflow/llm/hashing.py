"""Vectorised hashes over bytes and words, shared by the text operators.

All functions work on one bounded slice of documents at a time; ``slices`` cuts
Arrow batches so that a slice holds at most ``SLICE_BYTES`` of text (or one
single longer text).
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Odd multipliers of the two polynomial hashes and of the finaliser.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
SLICE_BYTES = 2_000_000

_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(n + n // 8 + 1, b, dtype=U)
            row[0] = 1
            out.append(np.multiply.accumulate(row))
        have = _POWERS[base] = (out[0], out[1])
        if len(have[0]) > 4 * SLICE_BYTES:  # a single huge text: do not keep its tables
            del _POWERS[base]
    return have[0][:n], have[1][:n]


def forget_powers() -> None:
    """Tens of MB that a worker would keep between tasks."""
    _POWERS.clear()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


class Rolling:
    """Hashes of any run [i, j) of a sequence of 64-bit values, equal runs having equal hashes."""

    def __init__(self, values: np.ndarray, base: int):
        up, down = _powers(base, len(values) + 1)
        self.down = down
        self.sums = np.zeros(len(values) + 1, dtype=U)
        np.cumsum((values.astype(U) + U(1)) * up[:-1], out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def every(self, width: int) -> np.ndarray:
        """The run hash at each start with `width` values left."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, dtype=U)
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


#: The separators of `[^\x20\x09-\x0D]+`, as a table over bytes.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


#: Everything in ASCII but letters and digits, for word matching that ignores punctuation.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in UTF-8 bytes."""
    gap = np.ones(len(data) + 2, dtype=bool)
    gap[1:-1] = separator[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def window_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values (van Herk), one per window start."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def slices(lengths: np.ndarray, most: int = SLICE_BYTES):
    """Row ranges [a, b) whose lengths sum to at most `most`, or single rows."""
    a, total = 0, 0
    for i, n in enumerate(lengths):
        if i > a and total + n > most:
            yield a, i
            a, total = i, 0
        total += int(n)
    if len(lengths) > a:
        yield a, len(lengths)
