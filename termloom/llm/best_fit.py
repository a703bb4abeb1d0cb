"""Best-fit decreasing over counts of lengths, with a segment tree indexed by remaining capacity."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass


class CapacityTree:
    """Segment tree over remaining capacities 0..capacity: which of them some open window has."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.used = [0] * (2 * self.leaves)

    def set(self, remaining: int, present: bool) -> None:
        node = self.leaves + remaining
        if self.used[node] == present:
            return
        step = 1 if present else -1
        while node:
            self.used[node] += step
            node >>= 1

    def tightest(self, length: int) -> int | None:
        """Smallest remaining capacity of at least ``length``."""
        node = self.leaves + length
        if self.used[node]:
            return length
        while node > 1:
            if node % 2 == 0 and self.used[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.used[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None


@dataclass(frozen=True)
class Placement:
    """Pieces of ``length`` with ranks ``rank .. rank + count - 1``: ``per_window`` of them one after the other in
    each window from ``window`` on, the first at ``offset``."""

    length: int
    rank: int
    count: int
    window: int
    offset: int
    per_window: int


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Placements of all pieces, and the number of windows.

    Windows with the same remaining capacity are handled as ranges, so the work depends on the number of
    different lengths and remaining capacities, not on the number of pieces.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    tree, open_windows = CapacityTree(capacity), defaultdict(list)
    placements: list[Placement] = []
    windows = 0

    def reopen(remaining: int, window: int, number: int) -> None:
        if remaining and number:
            open_windows[remaining].append((window, number))
            tree.set(remaining, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = tree.tightest(length)
            if remaining is None:
                remaining, window, number = capacity, windows, -(-left // (capacity // length))
                windows += number
            else:
                window, number = open_windows[remaining].pop()
                tree.set(remaining, bool(open_windows[remaining]))
            per_window = remaining // length
            full = min(number, left // per_window)
            partly = min(left - full * per_window, per_window - 1) if full < number else 0
            taken = full * per_window + partly
            placements.append(Placement(length, rank, taken, window, capacity - remaining, per_window))
            reopen(remaining - per_window * length, window, full)
            if partly:
                reopen(remaining - partly * length, window + full, 1)
            used = full + bool(partly)
            reopen(remaining, window + used, number - used)
            rank, left = rank + taken, left - taken
    return placements, windows
