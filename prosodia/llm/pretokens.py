"""Pre-tokens of byte-level vocabularies and what is counted or encoded once for each distinct one."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import regex

KEPT_CHARS, KEPT, PART = 64, 120_000, 1 << 17


class Once:
    """``of(batch)`` for each distinct pre-token, computed once per worker: a bounded dictionary that is emptied when it
    is full. Very long pre-tokens stay for one text only."""

    def __init__(self, of):
        self.of, self.known, self.passing = of, {}, []

    def learn(self, pretokens) -> dict:
        """A dictionary that has every one of ``pretokens``, up to the next call."""
        known = self.known
        for p in self.passing:
            del known[p]
        self.passing = []
        if len(known) > KEPT:
            known.clear()
        new = [p for p in set(pretokens) if p not in known]
        if new:
            known.update(zip(new, self.of(new), strict=True))
            self.passing = [p for p in new if len(p) > KEPT_CHARS]
        return known


def splitter(pattern: str):
    return regex.compile(pattern).findall


def parts(texts: Iterable[list[str]]) -> Iterator[list[list[str]]]:
    """Split texts by the few hundred thousand pre-tokens, so that what is new in them is looked up together."""
    part, size = [], 0
    for found in texts:
        part.append(found)
        size += len(found)
        if size >= PART:
            yield part
            part, size = [], 0
    if part:
        yield part
