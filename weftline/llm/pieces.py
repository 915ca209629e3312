"""A bounded memory of what pieces of text encode to."""

from __future__ import annotations

from collections.abc import Callable, Iterable


class Memo:
    """A bounded memory of function values, in two generations.

    When the young generation is full it becomes the old one and the old one is
    dropped, so frequent pieces stay and memory is bounded by twice `most`.
    """

    def __init__(self, encode: Callable[[list[str]], Iterable], most: int = 750_000):
        self.encode, self.most = encode, most
        self.young: dict = {}
        self.old: dict = {}

    def learn(self, pieces: set[str]) -> dict:
        """Values of at least these pieces."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        missing = [p for p in pieces if p not in young]
        if old:
            young.update([(p, old[p]) for p in missing if p in old])
            missing = [p for p in missing if p not in old]
        young.update(zip(missing, self.encode(missing), strict=True))
        return young
