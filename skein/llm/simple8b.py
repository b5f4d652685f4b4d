"""Simple-8b: runs of integers packed into 64-bit words, each with a 4-bit selector.

A word's selector says how many integers of how many bits its low 60 bits hold. Integers of
over 60 bits are escaped: their word has selector 0 and the value itself stands in a list of
exceptions, in order. Words hold nothing else, so a decoder knows every word's count from its
selector and scatters all words of one selector at once.

Values are coded in frames of ``FRAME``, each starting on a word of its own. All frames of an
array advance together, one word at a time, so the greedy choice, which depends on where the
word before it ended, still runs over whole columns.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the coding: (count, bits) by selector from 2 on; selector 0 escapes one integer, 1 is unused.
PACKINGS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
FRAME = 2048
#: Columns that the widest word may reach beyond a frame.
PAD = 60
SELECTOR = {count: k + 2 for k, (count, _) in enumerate(PACKINGS)}
COUNTS = np.array([1, 0] + [count for count, _ in PACKINGS], np.int64)


def _grid(values: np.ndarray, frames: int) -> np.ndarray:
    flat = np.zeros(frames * FRAME, values.dtype)
    flat[: len(values)] = values
    grid = np.zeros((frames, FRAME + PAD), values.dtype)
    grid[:, :FRAME] = flat.reshape(frames, FRAME)
    return grid


def _steps(grid: np.ndarray) -> np.ndarray:
    """How many values a word takes that starts at each place: the most that fit."""
    step = np.ones((len(grid), FRAME), np.uint8)
    most, width = grid, 1  # the largest of the next `width` values
    for count, bits in reversed(PACKINGS[:-1]):
        while width < count:
            more = min(width, count - width)
            most = np.maximum(most[:, : most.shape[1] - more], most[:, more:])
            width += more
        fits = most[:, :FRAME] < (1 << bits) if bits < 8 * grid.itemsize else np.ones((len(grid), FRAME), bool)
        if not fits.any():
            break  # nor do more values in fewer bits
        step[fits] = count
    return step


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(words, words per frame, exceptions)`` of unsigned integers."""
    n = len(values)
    frames = -(-n // FRAME)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if values.max() < 1 << 16:
        values = values.astype(np.uint16)  # the narrowest columns that hold them
    grid = _grid(values, frames)
    step = _steps(grid).ravel()
    chosen = np.zeros(frames * FRAME, bool)
    at = np.arange(frames) * FRAME
    ends = np.minimum(at + FRAME, n)
    while len(at):
        chosen[at] = True
        at = at + step[at]
        live = at < ends
        if not live.all():
            at, ends = at[live], ends[live]
    starts = np.flatnonzero(chosen)
    counts = step[starts]
    frame = starts // FRAME
    place = starts + frame * PAD  # the same place in the padded grid
    flat = grid.ravel()
    words = np.zeros(len(starts), np.uint64)
    exceptions = np.zeros(0, np.uint64)
    for count, bits in PACKINGS:
        rows = np.flatnonzero(counts == count)
        if not len(rows):
            continue
        if count == 1:
            wide = flat[place[rows]].astype(np.uint64) >= np.uint64(1 << 60)
            exceptions = flat[place[rows[wide]]].astype(np.uint64)
            rows = rows[~wide]
        first = place[rows]
        packed = np.full(len(rows), SELECTOR[count] << 60, np.uint64)
        for j in range(count):
            packed |= flat[first + j].astype(np.uint64) << np.uint64(j * bits)
        words[rows] = packed
    return words, np.bincount(frame, minlength=frames), exceptions


def decode(words: np.ndarray, frame_words: np.ndarray, exceptions: np.ndarray, n: int, dtype=np.uint64) -> np.ndarray:
    """The ``n`` integers that the words of these frames hold."""
    frames = len(frame_words)
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    before = np.cumsum(counts) - counts
    frame = np.repeat(np.arange(frames), frame_words)
    heads = np.cumsum(frame_words) - frame_words
    place = before - before[heads][frame] + frame * (FRAME + PAD) if len(words) else before
    out = np.zeros(frames * (FRAME + PAD), dtype)
    for count, bits in PACKINGS:
        rows = np.flatnonzero(selectors == SELECTOR[count])
        first, own, mask = place[rows], words[rows], np.uint64((1 << bits) - 1)
        for j in range(count if len(rows) else 0):
            out[first + j] = (own >> np.uint64(j * bits)) & mask
    out[place[selectors == 0]] = exceptions
    return np.ascontiguousarray(out.reshape(frames, FRAME + PAD)[:, :FRAME]).ravel()[:n]
