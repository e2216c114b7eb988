"""Cutting texts into chunks that a tokenizer can never join, so that each distinct chunk is tokenized once.

A cut stands before each space or line feed that follows a character that is no white space. No piece of the
tokenizers used here crosses such a place (byte-level pre-tokenizing starts a piece there; a piece vocabulary is
checked for it), so the ids of a text are the ids of its chunks, one after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable

_UNEVEN = re.compile(r"\s[ \n]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Longest chunk and number of chunks that a worker remembers.
LONGEST, MOST = 48, 500_000


def cut(text: str) -> list[str]:
    """The first chunk, then keys of the others.

    A key stands for itself if it starts with a space or a line feed, and else for itself with a space in front:
    so most keys are what split() gives.
    """
    if text[:1] in (" ", "\n") or _UNEVEN.search(text):
        return _CUT.split(text)
    return text.replace("\n", " \n").split(" ")


def chunk(key: str) -> str:
    return key if key[:1] in (" ", "\n") and key else " " + key


class Table(dict):
    """What encode gives for each distinct chunk, by key.

    Bounded: renew(), called between batches, starts a new generation once there are `most`, and what is still in use
    moves on from the one before. Chunks of over `longest` characters aren't remembered.
    """

    def __init__(self, encode: Callable[[str], object], longest: int = LONGEST, most: int = MOST):
        super().__init__()
        self.encode, self.longest, self.most, self.old = encode, longest, most, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.encode(chunk(key))
        if len(key) <= self.longest:
            self[key] = value
        return value

    def renew(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()

    def forget(self) -> None:
        """At the end of a task: a worker goes on to other stages and shouldn't hold a table meanwhile."""
        self.clear()
        self.old = {}
