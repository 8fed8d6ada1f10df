"""Words of byte-level tokenizers, each encoded once in a task.

A byte-level tokenizer cuts a text by its pattern and encodes each match for itself, so the tokens
of a text are those of its matches. The matches are found here only in texts of characters whose
classes no Unicode version changed; the library cuts all others itself.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import regex

#: Fixed value: the pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]*")
#: Entries of the memory of a task; when full it starts anew, which costs time only.
MOST = 200_000
GROUP = 1 << 20


class Memory:
    """Values of matches, computed for many new ones at once."""

    def __init__(self, compute: Callable[[list[str]], list], pattern: str = PATTERN):
        self.compute, self.known, self.find = compute, {}, regex.compile(pattern).findall

    def forget(self) -> None:
        """At the end of a task, as workers live longer and other tasks need the room."""
        self.known = {}

    def values(self, texts: Iterable[str]) -> Iterator[list]:
        """For each text the values of its matches; texts are taken in groups of about GROUP characters."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text)
            if size >= GROUP:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, texts: list[str]) -> Iterator[list]:
        matches = [self.find(t) for t in texts]
        if len(self.known) > MOST:
            self.known = {}
        fresh = set()
        for found in matches:
            fresh.update(found)
        fresh = list(fresh - self.known.keys())
        self.known.update(zip(fresh, self.compute(fresh)) if fresh else ())
        for found in matches:
            yield list(map(self.known.__getitem__, found))
