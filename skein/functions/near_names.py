"""Names near to runs of characters, found in arrays: counts of characters choose pairs, the indel similarity decides.

Each insertion or deletion changes one count of characters by one. So a run that may differ from
a name by ``e`` of them has counts, by any grouping of characters, at most ``e`` away from the
name's in sum. A band of names of like lengths lists all counts that its names allow; the counts
of a run are one difference of two running sums, and a lookup finds its names. Counts of 32 finer
groups prune pairs, and what is left is scored. Nothing similar is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np

from skein.functions.similarity import indel_ratio

ODD = np.uint64(0x9E3779B97F4A7C15)  # 2**64 over the golden ratio
#: Counts that a band lists, about; groups that it tells apart at most; runs looked up at a time.
LISTED, GROUPS, AT_ONCE = 400_000, 16, 1 << 18
#: Characters that are not ASCII but have lower-case forms that are; all others that are not ASCII share one class.
ODD_CASE = (0x130, 0x212A)
LOWER = np.array([ord(chr(c).lower()) for c in range(128)] + [128], np.uint8)
#: The sum of the distances from 8 of four 4-bit fields.
FAR = sum(np.abs((np.arange(1 << 16) >> 4 * f & 15) - 8) for f in range(4)).astype(np.uint8)
EIGHTS = np.uint64(0x8888888888888888)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def classes_of(codes: np.ndarray) -> np.ndarray:
    return LOWER[np.minimum(codes, 128)]


def edits(n, m, cutoff: float):
    """How many insertions and deletions strings of these lengths may differ by at the cutoff."""
    return np.floor((1 - cutoff / 100.0) * (n + m) + 1e-9).astype(np.int64)


def lengths(m: int, cutoff: float) -> tuple[int, int]:
    """Least and largest length that can reach the cutoff with length ``m``: 2 min / (a + b) >= cutoff / 100."""
    low, high = cutoff / (200.0 - cutoff), (200.0 - cutoff) / cutoff
    return max(1, math.ceil(m * low - 1e-9)), math.floor(m * high + 1e-9)


@lru_cache(maxsize=64)
def _changes(groups: int, most: int) -> np.ndarray:
    """All changes of ``groups`` counts by ``most`` in sum at most, a row each."""
    out = np.zeros((1, 0), np.int16)
    for _ in range(groups):
        left = most - np.abs(out).sum(1)
        out = np.concatenate([np.column_stack([out[left >= abs(d)], np.full(int((left >= abs(d)).sum()), d, np.int16)]) for d in range(-most, most + 1)])
    return out


def _n_changes(groups: int, most: int) -> int:
    return sum(2**i * math.comb(groups, i) * math.comb(most, i) for i in range(min(groups, most) + 1))


class _Band:
    """Names of like lengths, their counts and the counts that may be near to them."""

    def __init__(self, own: list[int], classes: list[np.ndarray], most: int, cutoff: float):
        self.most = most
        groups = max([1] + [k for k in range(1, GROUPS + 1) if _n_changes(k, most) * len(own) <= LISTED])
        # common characters are dealt evenly
        seen = Counter({c: 0 for c in range(129)})
        for i in own:
            seen.update(classes[i].tolist())
        load, group = [0] * groups, np.zeros(129, np.int64)
        for c, times in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
            group[c] = load.index(min(load))
            load[group[c]] += times
        unit = np.uint64(1) << (np.arange(groups, dtype=np.uint64) * np.uint64(64 // groups))
        self.weights = unit[group]
        changes = _changes(groups, most)
        far, more = np.abs(changes).sum(1), changes.sum(1)
        with np.errstate(over="ignore"):
            shift = (changes.astype(np.int64).view(np.uint64) * unit).sum(1, dtype=np.uint64)
            keys, ids, spans = [], [], [lengths(len(classes[i]), cutoff) for i in own]
            for i in own:
                m = len(classes[i])
                counts = np.bincount(group[classes[i]], minlength=groups)
                may = np.flatnonzero((far <= edits(m + more, m, cutoff)) & (m + more >= 1) & (counts + changes >= 0).all(1))
                keys.append(shift[may] + self.weights[classes[i]].sum(dtype=np.uint64))
                ids.append(np.full(len(may), i, np.int32))
        self.low, self.high = min(a for a, _ in spans), max(b for _, b in spans)
        found, names = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(found, kind="stable")
        self.names = names[order]
        self.found, first = np.unique(found[order], return_index=True)
        self.first = np.append(first, len(order))
        self.bits = max(10, int(len(self.found) * 16).bit_length())
        mark = np.zeros(1 << self.bits, bool)
        mark[self._slot(self.found)] = True
        self.mark = np.packbits(mark)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of runs and of names whose counts may be near."""
        with np.errstate(over="ignore"):
            keys = sums[b] - sums[a]
        slot = self._slot(keys)
        runs = np.flatnonzero(self.mark[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1)
        place = np.minimum(np.searchsorted(self.found, keys[runs]), len(self.found) - 1)
        right = self.found[place] == keys[runs]
        runs, place = runs[right], place[right]
        size = self.first[place + 1] - self.first[place]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[place] - (ends - size), size)
        return np.repeat(runs, size), self.names[at]


def _running(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


class NearNames:
    """Lower-case ``keys``, none empty, by number; of equally near ones the least number wins."""

    def __init__(self, keys: list[str], cutoff: float):
        self.keys, self.cutoff = keys, cutoff
        classes = [classes_of(codes_of(k)) for k in keys]
        self.sizes = np.array([len(k) for k in keys], np.int64)
        # 32 finer groups, in two words of 4-bit fields
        fine = np.arange(129) % 32
        unit = np.uint64(1) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
        self.fine = [np.where(fine // 16 == half, unit[fine % 16], np.uint64(0)) for half in (0, 1)]
        self.counts = [np.array([w[c].sum(dtype=np.uint64) for c in classes], np.uint64) for w in self.fine]
        by_most: dict[int, list[int]] = {}
        for i, c in enumerate(classes):
            most = int(edits(lengths(len(c), cutoff)[1], len(c), cutoff))
            by_most.setdefault(next((r for r in (0, 1, 2, 3, 4, 5, 6, 8, 10) if most <= r), 1 << most.bit_length()), []).append(i)
        self.bands = [_Band(own, classes, most, cutoff) for most, own in sorted(by_most.items())]
        self.high = max((b.high for b in self.bands), default=0)

    def best(self, text: str, codes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, float]]:
        """Run, name and score of the most similar name of at least the cutoff of each run ``text[a:b]``, of those that have one."""
        classes = classes_of(codes)
        fine = [_running(w[classes]) for w in self.fine]
        out: dict[int, tuple[float, int]] = {}
        known: dict[tuple[str, int], float] = {}
        odd = np.flatnonzero(np.isin(codes, ODD_CASE))
        strange = np.searchsorted(odd, a) < np.searchsorted(odd, b) if len(odd) else np.zeros(len(a), bool)

        def score(run: int, names) -> None:
            own = text[a[run] : b[run]].lower()
            for i in names:
                found = known.get((own, i))
                if found is None:
                    found = known[own, i] = indel_ratio(own, self.keys[i])
                if found >= self.cutoff:
                    out[run] = min(out.get(run, (1.0, 0)), (-found, i))

        # lower case may be longer, never shorter
        for run in np.flatnonzero(strange & (b - a <= self.high)).tolist():
            score(run, range(len(self.keys)))
        size = b - a
        for band in self.bands:
            sums = _running(band.weights[classes])
            fits = np.flatnonzero((size >= band.low) & (size <= band.high) & ~strange)
            for k in range(0, len(fits), AT_ONCE):
                some = fits[k : k + AT_ONCE]
                runs, names = band.pairs(sums, a[some], b[some])
                runs = some[runs]
                near = edits(size[runs], self.sizes[names], self.cutoff)
                if band.most <= 7:  # so that no field overflows in pairs that are near
                    far = np.zeros(len(runs), np.int64)
                    with np.errstate(over="ignore"):
                        for running, counts in zip(fine, self.counts, strict=True):
                            apart = running[b[runs]] - running[a[runs]] - counts[names] + EIGHTS
                            far += FAR[apart.view("<u2").reshape(-1, 4)].sum(1, dtype=np.int64)
                    chosen = far <= near
                    runs, names = runs[chosen], names[chosen]
                for run, i in zip(runs.tolist(), names.tolist(), strict=True):
                    score(run, (i,))
        return [(run, i, -s) for run, (s, i) in sorted(out.items())]
