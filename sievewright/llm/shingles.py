"""Weighted word shingles and their probability Jaccard similarity, for use inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
CACHE = 100_000


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = value
        return value


_HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.copy()
    t = x >> np.uint64(30)
    x ^= t
    x *= np.uint64(0xBF58476D1CE4E5B9)
    np.right_shift(x, np.uint64(27), out=t)
    x ^= t
    x *= np.uint64(0x94D049BB133111EB)
    np.right_shift(x, np.uint64(31), out=t)
    x ^= t
    return x


def shingles(text: str | None, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of the lower-cased text and how often each occurs.

    A text with fewer words than a shingle is one shingle; one without words has none.
    """
    found = (text or "").lower().encode().split()
    n = len(found)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashed = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, n)
    width, length = min(size, n), max(1, n - size + 1)
    joined = np.zeros(length, np.uint64)
    for k in range(width):
        joined = mix(joined * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + length] + np.uint64(k + 1))
    return np.unique(joined, return_counts=True)


def weights(counts: np.ndarray) -> np.ndarray:
    """A shingle's weight: 1 for one occurrence, growing with the logarithm of the count."""
    return 1.0 + np.log(counts)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact J_P = sum over shared i of 1 / sum over j of max(x_j / x_i, y_j / y_i).

    Sorted by y / x, the inner sums are prefix sums of x and suffix sums of y. Two empty texts have 1.
    """
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    shared, ia, ib = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    wa, wb = weights(a[1]), weights(b[1])
    x, y = wa[ia], wb[ib]
    only_x, only_y = wa.sum() - x.sum(), wb.sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    below = only_x + np.cumsum(x) - x
    above = only_y + np.cumsum(y[::-1])[::-1]
    return float(np.sum(1.0 / (below / x + above / y)))


def prob_minhash(hashes: np.ndarray, weight: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash signature: the shingle that reaches each register first.

    Every shingle sends a Poisson process of arrivals, at a rate of its weight, to random registers;
    its process ends once it is later than the latest register. Equal shingles send equal streams
    whatever text they stand in, so two signatures agree in a register with probability J_P.
    """
    first = np.full(registers, np.inf)
    holder = np.zeros(registers, np.uint64)
    mean = 1.0 / weight
    live, at = hashes, np.zeros(len(hashes))
    step, latest, filling = 0, np.inf, int(registers * (np.log(registers) + 2.5))
    while len(live):
        burst = -(-filling // len(live)) if latest == np.inf else 2
        number = np.arange(step + 1, step + 1 + burst, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        drawn = mix(live[:, None] + number[None, :])
        # The low 24 bits choose the register, the high 40 the waiting time.
        where = (((drawn & np.uint64(0xFFFFFF)) * np.uint64(registers)) >> np.uint64(24)).astype(np.int64).ravel()
        times = (drawn >> np.uint64(24)).astype(np.float64)
        times += 0.5
        times *= 2.0**-40
        np.log(times, out=times)
        times *= -mean[:, None]
        np.cumsum(times, axis=1, out=times)
        times += at[:, None]
        at, flat = times[:, -1].copy(), times.ravel()
        early = np.flatnonzero(flat < first[where])
        spot, when = where[early], flat[early]
        np.minimum.at(first, spot, when)
        won = when == first[spot]
        holder[spot[won]] = live[early[won] // burst]
        latest, step = first.max(), step + burst
        stay = at < latest
        live, at, mean = live[stay], at[stay], mean[stay]
    return holder


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit key per band of the signature."""
    rows = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def sketch(signature: np.ndarray) -> list[int]:
    """Four bits of each register, in signed 64-bit words."""
    low = mix(signature)[: len(signature) // 2 * 2] & np.uint64(15)
    halves = (low[::2] | (low[1::2] << np.uint64(4))).astype(np.uint8)
    return np.frombuffer(np.pad(halves, (0, -len(halves) % 8)).tobytes(), np.int64).tolist()
