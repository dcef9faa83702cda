"""Vectorised 64-bit hashes of words and word sequences.

A word's hash is the sum of a random value per byte times a power of an odd base, divided by the power at the word's
start; all of it wraps modulo 2**64, so hashes of all words of a buffer come from one running sum. Modulo a power of two
some pairs of long, self-similar words agree whatever the base, so a second sum of the same form modulo a prime goes
into the hash as well.
"""

from __future__ import annotations

import numpy as np

PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_VALUE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []
PRIME = (1 << 31) - 1
_PRIME_BASE = 1_483_642_871
_prime_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * PIECE)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def _prime_power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo PRIME."""
    if not _prime_powers or len(_prime_powers[0]) < n:
        size = 1 << max(n, 2 * PIECE).bit_length()
        _prime_powers[:] = []
        for base in (_PRIME_BASE, pow(_PRIME_BASE, -1, PRIME)):
            out, step = np.ones(1, np.uint64), base
            while len(out) < size:
                out = np.concatenate((out, out * np.uint64(step) % np.uint64(PRIME)))
                step = step * step % PRIME
            _prime_powers.append(out)
    return _prime_powers[0], _prime_powers[1]


def prime_sums(buf: np.ndarray) -> np.ndarray:
    """Running sums of (byte + 1) * power, which do not wrap: terms stay below 2**39, reduced to 2**31 in long buffers."""
    terms = (buf.astype(np.uint64) + np.uint64(1)) * _prime_power(len(buf) + 1)[0][: len(buf)]
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(terms if len(buf) < 1 << 24 else terms % np.uint64(PRIME), out=total[1:])
    return total


def prime_hash(total: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p = np.uint64(PRIME)
    return (total[end] - total[start]) % p * _prime_power(len(total))[1][start] % p


def _piece(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(buf) + 2, bool)
    space[1:-1] = _SPACE[buf]
    at = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = at[::2], at[1::2]
    power, inverse = _power(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_VALUE[buf] * power[: len(buf)], out=total[1:])
    other = prime_hash(prime_sums(buf), starts, ends)
    return starts, mix((total[ends] - total[starts]) * inverse[starts] ^ mix(other))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions and hashes of all words (runs other than space and 0x09 to 0x0D), in order."""
    n = len(data)
    if n <= PIECE:
        return _piece(np.frombuffer(data, np.uint8))
    buf, at, starts, hashes = np.frombuffer(data, np.uint8), 0, [], []
    while at < n:
        end = min(n, at + PIECE)
        if end < n:  # cut at a space; a longer word widens the piece
            back = np.flatnonzero(_SPACE[buf[at:end]])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = end
                while ahead < n and not _SPACE[buf[ahead : ahead + PIECE]].any():
                    ahead += PIECE
                end = n if ahead >= n else ahead + int(np.argmax(_SPACE[buf[ahead : ahead + PIECE]])) + 1
        s, h = _piece(buf[at:end])
        starts.append(s + at)
        hashes.append(h)
        at = end
    return np.concatenate(starts), np.concatenate(hashes)


_STEP = [0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165]


def sequence_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words; with fewer words, but not none, of the whole sequence."""
    n = len(words)
    if not n:
        return words
    k_now = min(k, n)
    out = np.full(n - k_now + 1, 0x2545F4914F6CDD1D * k_now % (1 << 64), np.uint64)
    for j in range(k_now):
        out += mix(words[j : n - k_now + 1 + j] ^ np.uint64(_STEP[j % 8])) * np.uint64(_STEP[(j + 3) % 8] + 2 * (j // 8))
    return mix(out)
