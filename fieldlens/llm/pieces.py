"""Exact reuse of encodings: a text is cut where no token can cross, and each distinct piece is encoded once per worker."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

_LOOSE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
_SLICE_CHARS = 2_000_000
_LIMIT = 400_000


def cut(text: str) -> tuple[str, list[str]]:
    """``text`` cut before each space that follows a non-space; the space in front of every later piece is left out.

    A pre-token of the byte-level pattern never holds a space behind a non-space, and a run of white space stays in one piece,
    so the pre-tokens of the pieces are those of the text.
    """
    if _LOOSE.search(text):
        head, *tail = _CUT.split(text)
        return head, [t[1:] for t in tail]
    head, *tail = text.split(" ")
    return head, tail


class PieceCache:
    """Encodings of distinct pieces. When a generation of ``limit`` pieces is full it becomes the old one, from which pieces met again move on;
    so frequent pieces stay, and at most two generations and one slice of texts are held."""

    def __init__(self, encode: Callable[[list[str]], Iterable], limit: int = _LIMIT):
        self.encode, self.limit = encode, limit
        self.young: dict[str, dict] = {"": {}, " ": {}}
        self.old: dict[str, dict] = {"": {}, " ": {}}

    def _learn(self, space: str, found: set[str]) -> dict:
        if len(self.young[space]) > self.limit:
            self.old[space], self.young[space] = self.young[space], {}
        young, old = self.young[space], self.old[space]
        missing = found.difference(young)
        if old:
            again = missing.intersection(old)
            young.update(zip(again, map(old.__getitem__, again)))
            missing -= again
        new = list(missing)
        young.update(zip(new, self.encode([space + p for p in new] if space else new)))
        return young

    def of(self, pieces: set[str]) -> dict:
        """Encodings of these pieces and maybe of others; every piece has one space in front."""
        return self._learn(" ", pieces)

    def whole(self, pieces: set[str]) -> dict:
        """As ``of``, for pieces without a space in front."""
        return self._learn("", pieces)

    def lookup(self, texts: list[str]) -> list[tuple[object, list]]:
        """Encodings of the first piece and of the later pieces of each text."""
        cuts = [cut(t) for t in texts]
        heads = self._learn("", {h for h, _ in cuts})
        tail = self._learn(" ", set().union(*(t for _, t in cuts))).__getitem__
        return [(heads[h], list(map(tail, t))) for h, t in cuts]


def slices(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of bounded size (one long text may be a run of its own), with their first position."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > _SLICE_CHARS:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]
