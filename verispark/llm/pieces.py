"""Splitting text ahead of byte-pair tokenizers, with a bounded cache per Python worker."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Both byte-level vocabularies cut a text before a space that a non-space follows, whatever
#: stands around it, so the parts between such places can be tokenized one by one.
_CUT = re.compile(r" (?=\S)").split
_RUN = re.compile(r" (?:\s|\Z)").search


def chunks(text: str) -> list[str]:
    """Parts of a text, in order; every part but the first has lost one leading space."""
    return _CUT(text) if _RUN(text) else text.split(" ")


class PieceCache:
    """Packed ids of text parts.

    ``encode`` maps a list of parts to a list of packed id strings.  Parts are kept in two generations:
    when the younger holds half of ``limit`` parts it becomes the older, whose parts come back as
    they are met, so common parts stay and memory does not grow with the corpus.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 1_000_000) -> None:
        self.encode, self.limit, self.known, self.older = encode, limit, {}, {}

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of whole texts; a null text has none."""
        if len(self.known) > self.limit // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        split = [chunks(t) if t else [""] for t in texts]
        heads = self.encode([parts.pop(0) for parts in split])
        missing: set[str] = set()
        for parts in split:
            missing |= set(parts).difference(known)
        known.update({p: older[p] for p in missing if p in older})
        todo = [p for p in missing if p not in older]
        if todo:
            known.update(zip(todo, self.encode([" " + p for p in todo]), strict=True))
        return [head + b"".join(map(known.__getitem__, parts)) for head, parts in zip(heads, split, strict=True)]
