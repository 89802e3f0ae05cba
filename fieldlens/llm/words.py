"""Words between ASCII white space, lower-cased in A-Z only, and their 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """UTF-8 words of ``text``; white space is space and the characters 9 to 13."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


class WordHashes:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = 500_000):
        self.limit, self.known = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.limit:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), "u8", len(words))
