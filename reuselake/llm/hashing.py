"""Rolling hashes over whole batches of text with numpy: words, passages and shingles without per-row Python."""

from __future__ import annotations

import hashlib

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

#: ASCII white space, the separators of words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x.astype(np.uint64) ^ mix(np.array([salt], np.uint64)))


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS[kind]
    if len(have) < n:
        factor = np.full(max(n, 1 << 20), _STEP if kind == "up" else _BACK)
        factor[0] = 1
        have = _POWERS[kind] = np.cumprod(factor)
    return have[:n]


class Rolling:
    """Hash of any span of a symbol sequence in constant time; equal spans have equal hashes.

    Sums are modulo 2**64, where certain pairs of spans of a thousand symbols (Thue-Morse sequences) agree whatever the seed. Use
    ``distinct_spans`` or ``PrimeRolling`` where longer spans must be told apart.
    """

    def __init__(self, symbols: np.ndarray, seed: int = 1):
        n = len(symbols)
        if symbols.dtype == np.uint8:
            values = salted(np.arange(256, dtype=np.uint64), seed)[symbols]
        else:
            values = salted(symbols.astype(np.uint64), seed)
        values *= _powers("up", n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values, out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        down = _powers("down", len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * down[start])

    def windows(self, length: int) -> np.ndarray:
        """Hash of every span of ``length`` symbols."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[length:] - self.sums[:n]) * _powers("down", n))


#: Spans up to here are told apart by sums modulo 2**64.
SHORT = 128


def distinct_spans(rolling: Rolling, data: bytes, begin: np.ndarray, end: np.ndarray, width: int = 1) -> np.ndarray:
    """Hashes of spans; those longer than ``SHORT`` symbols, of ``width`` bytes each, are hashed from their bytes in ``data``."""
    out = rolling.spans(begin, end)
    for k in np.nonzero(end - begin > SHORT)[0].tolist():
        out[k] = digest_64(data[width * int(begin[k]) : width * int(end[k])])
    return out


def digest_64(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


class PrimeRolling:
    """As ``Rolling``, by sums modulo two primes below 2**31, so that spans of any length are told apart; of up to 2**32 symbols."""

    _PRIMES = (2**31 - 1, 2**31 - 19)

    def __init__(self, symbols: np.ndarray, seed: int = 1):
        n, values = len(symbols), salted(symbols.astype(np.uint64), seed)
        self.n, self.parts = n, []
        for k, prime in enumerate(self._PRIMES):
            p = np.uint64(prime)
            base = 2**20 + int(salted(np.array([seed], np.uint64), k)[0] % np.uint64(2**30))
            power = np.ones(n + 1, np.uint64)
            have = 1
            while have <= n:
                power[have : 2 * have] = power[: min(have, n + 1 - have)] * np.uint64(pow(base, have, prime)) % p
                have *= 2
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((values >> np.uint64(32 * k)) % p * power[:n] % p, out=sums[1:])
            down = power[::-1] * np.uint64(pow(base, -n, prime)) % p  # undoes the powers of the places before a span
            self.parts.append((p, down, sums))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = ((sums[end] - sums[start]) % p * down[start] % p for p, down, sums in self.parts)
        return mix((one << np.uint64(31)) | two)

    def windows(self, length: int) -> np.ndarray:
        start = np.arange(max(self.n - length + 1, 0))
        return self.spans(start, start + length)


def join_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with one blank after each text, and where each text starts (and the end)."""
    joined = np.frombuffer(b" ".join(texts) + b" ", np.uint8) if texts else np.zeros(0, np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return joined, starts


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word (run without white space) of all texts in order, and each text's first word (and the end)."""
    joined, starts = join_texts(texts)
    inside = ~SPACE[joined]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    return distinct_spans(Rolling(joined), joined.data, begin, end), np.searchsorted(begin, starts)
