"""Suffix automata over words, and matching statistics against them."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """All substrings of the sequences added so far, in states linear in their length.

    ``lengths`` and ``links`` are each state's longest substring and suffix link, ``first`` is
    where its substrings ended for the first time; transitions are one dictionary per state.
    Sequences are added one after another and share states.
    """

    __slots__ = ("first", "lengths", "links", "steps")

    def __init__(self, sequences: Iterable[Sequence] = ()):
        self.lengths, self.links, self.steps, self.first = [0], [-1], [{}], [None]
        for s in sequences:
            self.add(s)

    def __len__(self) -> int:
        return len(self.lengths)

    def _state(self, length: int, link: int, steps: dict, first=None) -> int:
        self.lengths.append(length)
        self.links.append(link)
        self.steps.append(steps)
        self.first.append(first)
        return len(self.lengths) - 1

    def _split(self, p: int, word, q: int) -> int:
        """A state for the shorter substrings of ``q``, which ``p`` and its suffixes reach by ``word``."""
        short = self._state(self.lengths[p] + 1, self.links[q], dict(self.steps[q]), self.first[q])
        while p >= 0 and self.steps[p].get(word) == q:
            self.steps[p][word] = short
            p = self.links[p]
        self.links[q] = short
        return short

    def _add(self, last: int, word, end) -> int:
        """The state of the sequence so far and ``word``, which ends at ``end``."""
        lengths, links, steps = self.lengths, self.links, self.steps
        q = steps[last].get(word)
        if q is not None:  # an earlier sequence went this way
            return q if lengths[q] == lengths[last] + 1 else self._split(last, word, q)
        now = self._state(lengths[last] + 1, 0, {}, end)
        p = last
        while p >= 0 and word not in steps[p]:
            steps[p][word] = now
            p = links[p]
        if p >= 0:
            q = steps[p][word]
            links[now] = q if lengths[q] == lengths[p] + 1 else self._split(p, word, q)
        return now

    def add(self, sequence: Sequence) -> None:
        last = 0
        for word in sequence:
            last = self._add(last, word, None)

    def repeats(self, sequence: Sequence, n: int, doc: int, start: int) -> list[int]:
        """Adds a sequence that starts at a place of a document; gives the starts in it of windows of ``n`` that were first somewhere else.

        That may be an earlier sequence or earlier in this one. Sequences come in the order of their places.
        """
        lengths, links, first, last, out = self.lengths, self.links, self.first, 0, []
        for k, word in enumerate(sequence):
            end = (doc, start + k)
            last = self._add(last, word, end)
            if k + 1 < n:
                continue
            state = last
            while lengths[links[state]] >= n:  # down to the state that holds the window itself
                state = links[state]
            if first[state] != end:
                out.append(k - n + 1)
        return out

    def statistics(self, sequence: Sequence) -> list[int]:
        """For each place, how many words up to it occur in a row in what was added."""
        lengths, links, steps = self.lengths, self.links, self.steps
        state, size, out = 0, 0, []
        for word in sequence:
            while state and word not in steps[state]:
                state = links[state]
                size = lengths[state]
            to = steps[state].get(word)
            if to is None:
                size = 0
            else:
                state, size = to, size + 1
            out.append(size)
        return out


def spans(statistics: Sequence[int], n: int) -> list[tuple[int, int]]:
    """Maximal spans ``(start, end)`` whose every window of ``n`` places is matched; a window ends where at least ``n`` words match."""
    out: list[tuple[int, int]] = []
    for end, size in enumerate(statistics, 1):
        if size >= n:
            if out and out[-1][1] == end - 1:
                out[-1] = (out[-1][0], end)
            else:
                out.append((end - n, end))
    return out
