"""Words and checksums of UTF-8 buffers by tables over bytes, for whole Arrow batches at once.

A word is a run of digits, letters and bytes of other than ASCII characters; A-Z count as a-z.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Bytes that separate words: [\x00-\x2F\x3A-\x60\x7B-\x7F] of the lowered text.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: Words longer than this end one by one instead of in step.
IN_STEP = 64


def _table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1).astype(np.uint32)  # the reversed polynomial of CRC-32
    return crc


_CRC = _table()


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lowered bytes, start and end of each word, and the n + 1 word offsets of the texts that off cuts raw into.

    Each byte's class comes from a table; words begin and end where neighbouring classes differ. No word spans texts.
    """
    low = _LOWER[raw]
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _IS_WORD[low]
    edge = np.diff(inside)
    opens, closes = edge[:-1] == 1, edge[1:] == -1  # at the first and at the last byte of a word
    cuts = off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    both = cuts[(inside[cuts] == 1) & (inside[cuts + 1] == 1)]  # a text ends in a word and the next begins with one
    opens[both] = True
    closes[both - 1] = True
    starts = np.flatnonzero(opens)
    return low, starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, off)


def _advance(state: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC states moved over [start, end) each: all go one byte at a time together, the longest first, so that those at work are a prefix."""
    sizes = ends - starts
    step = np.minimum(sizes, IN_STEP + 1).astype(np.uint8)
    order = np.argsort(IN_STEP + 1 - step, kind="stable")
    at, crc = starts[order], state[order]
    live = len(order) - np.cumsum(np.bincount(step, minlength=IN_STEP + 2))[: IN_STEP + 1]  # how many are longer than 0, 1, ... bytes
    long = int(live[IN_STEP])
    for i in order[:long].tolist():  # the library's loop over the same bytes
        state[i] = zlib.crc32(low[starts[i] : ends[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    at, crc = at[long:], crc[long:]
    for j in range(IN_STEP):
        n = int(live[j]) - long
        if n <= 0:
            break
        crc[:n] = _CRC[(crc[:n] ^ low[at[:n] + j]) & 255] ^ (crc[:n] >> 8)
    state[order[long:]] = crc
    return state


def run_crcs(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, word_off: np.ndarray, longest: int = 1) -> list[np.ndarray]:
    """For each length 1 to longest: the CRC-32 of each run of so many words of one text, joined by one space, in the order of first words.

    A run of k words goes on from the state of its first k - 1.
    """
    out = []
    state = _advance(np.full(len(starts), 0xFFFFFFFF, np.uint32), low, starts, ends)
    first = np.arange(len(starts))
    text = np.repeat(np.arange(len(word_off) - 1), np.diff(word_off))
    for k in range(1, longest + 1):
        if k > 1:
            more = np.flatnonzero(first + k - 1 < word_off[text[first] + 1])
            first, state = first[more], state[more]
            state = _CRC[(state ^ np.uint32(0x20)) & 255] ^ (state >> 8)
            state = _advance(state, low, starts[first + k - 1], ends[first + k - 1])
        out.append(state ^ np.uint32(0xFFFFFFFF))
    return out


def run_counts(word_off: np.ndarray, length: int) -> np.ndarray:
    """Runs of so many words in each text."""
    return np.maximum(np.diff(word_off) - length + 1, 0)
