"""Words of a text and their hashes, on whole byte arrays at once."""

from __future__ import annotations

from functools import cache

import numpy as np

_P = 0x5851F42D4C957F2D
_PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.concatenate([np.ones(1, np.uint64), np.full(_PIECE, _P, np.uint64)]).cumprod(dtype=np.uint64)
        down = np.concatenate([np.ones(1, np.uint64), np.full(_PIECE, pow(_P, -1, 1 << 64), np.uint64)]).cumprod(dtype=np.uint64)
    return up, down


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)


def _runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of one non-zero kind."""
    change = np.flatnonzero(np.diff(np.concatenate([[0], kind, [0]])))
    starts, ends = change, np.append(change[1:], len(kind))
    held = np.zeros(0, np.int64) if not len(kind) else starts[:-1] if starts.size and starts[-1] == len(kind) else starts
    ends = ends[: held.size]
    filled = kind[held] != 0
    return held[filled], ends[filled]


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges with A-Z lower-cased; equal ranges have equal hashes wherever they stand."""
    out = np.zeros(len(starts), np.uint64)
    up, down = _powers()
    i = 0
    while i < len(starts):  # bounded pieces that end between words
        base = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, base + _PIECE, side="right")))
        part = _LOWER[raw[base : ends[j - 1]]].astype(np.uint64) + np.uint64(1)
        if part.size > _PIECE:  # one word longer than a piece
            h = 0
            for at in range(0, part.size, _PIECE):
                block = part[at : at + _PIECE]
                h = (h * 0x100000001B3 + int((block * up[: block.size]).sum(dtype=np.uint64))) & 0xFFFFFFFFFFFFFFFF
            out[i] = h
        else:
            sums = np.concatenate([np.zeros(1, np.uint64), (part * up[: part.size]).cumsum(dtype=np.uint64)])
            a, b = starts[i:j] - base, ends[i:j] - base
            out[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return mix(out)


def words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's bytes, and starts and ends of its words; digits keep single dots and commas between them."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kind = _WORD[raw]
    if raw.size > 2:
        digit = _DIGIT[raw]
        kind[1:-1] |= ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & digit[:-2] & digit[2:]
    starts, ends = _runs(kind.astype(np.int8))
    return raw, starts, ends


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's bytes, and starts and ends of its runs of word bytes and of runs of marks."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    kind = np.where(_SPACE[raw], 0, np.where(_WORD[raw], 1, 2)).astype(np.int8)
    starts, ends = _runs(kind)
    return raw, starts, ends


def digits_only(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which ranges hold no letter."""
    count = np.concatenate([[0], np.cumsum(_DIGIT[raw] | (raw == 46) | (raw == 44))])
    return (count[ends] - count[starts] == ends - starts) & _DIGIT[raw[starts]]


def hash_of(word: str) -> int:
    """The hash that `word_hashes` gives a word."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])
