"""Hierarchical navigable small-world graph over one shard of vectors, as flat arrays.

Nodes are numbered by descending level, so layer l is a prefix of the nodes and its links are one array of shape
(nodes of the layer, links). Nodes are inserted in that order, a batch at a time: each node of the batch searches
the graph of all earlier batches, and is also compared with the nodes before it in its own batch. Of what it finds,
the usual heuristic keeps those that are nearer to the node than to any kept one. A node that has been given more
links back than it has room for is pruned by the same heuristic.

Many searches go through the graph in step, as rows of arrays: each step opens the nearest unopened nodes of every
row's beam. Distances are sums of squared differences, not products of whole vectors, so that those within a dense
cluster keep their digits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Rows that are handled at a time.
BLOCK = 256
#: Pairs whose distances are computed at a time.
CHUNK = 1 << 10
#: Nodes of each row's beam that a step opens.
OPENED = 8
#: Bytes of the marks of the nodes that each of a number of searches has met.
MARKS = 1 << 26
#: Beam on the way down through the layers above.
DESCENT = 4
#: Nearest nodes of a batch that a node of the same batch is offered.
PEERS = 16


def levels(hashes: np.ndarray, links: int) -> np.ndarray:
    """Level of each node, geometric with ratio 1/links, from a uniform 64-bit hash."""
    uniform = (hashes.astype(np.uint64) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.floor(-np.log(np.maximum(uniform, 2.0**-54)) / np.log(links)).astype(np.int64)


def select(vectors: np.ndarray, base: np.ndarray, near: np.ndarray, distance: np.ndarray, most: int) -> np.ndarray:
    """Of the candidates of each row (nearest first, -1 for none) of nodes ``base``, at most ``most`` spread ones,
    then nearest others."""
    out = np.full((len(near), most), -1, np.int32)
    for a in range(0, len(near), BLOCK):
        own, gap = near[a : a + BLOCK], distance[a : a + BLOCK]
        known = vectors[np.maximum(own, 0)] - vectors[base[a : a + BLOCK], None, :]
        square = np.einsum("bcd,bcd->bc", known, known)
        apart = square[:, :, None] + square[:, None, :] - 2 * np.matmul(known, known.transpose(0, 2, 1))
        kept, number, valid = np.zeros(own.shape, bool), np.zeros(len(own), np.int64), own >= 0
        for c in range(own.shape[1]):
            crowded = ((apart[:, c, :] < gap[:, c, None]) & kept).any(axis=1)
            kept[:, c] = valid[:, c] & ~crowded & (number < most)
            number += kept[:, c]
        order = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :most]
        chosen = np.take_along_axis(own, order, axis=1)
        out[a : a + len(own), : chosen.shape[1]] = chosen
    return out


def _gaps(vectors: np.ndarray, nodes: np.ndarray, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, in chunks that the processor's cache holds."""
    out = np.empty(len(nodes), vectors.dtype)
    left = np.empty((min(CHUNK, len(nodes)), vectors.shape[1]), vectors.dtype)
    right = np.empty_like(left)
    for a in range(0, len(nodes), CHUNK):
        n = min(CHUNK, len(nodes) - a)
        np.take(vectors, nodes[a : a + n], axis=0, out=left[:n], mode="clip")
        np.take(queries, rows[a : a + n], axis=0, out=right[:n], mode="clip")
        np.subtract(left[:n], right[:n], out=left[:n])
        np.einsum("nd,nd->n", left[:n], left[:n], out=out[a : a + n])
    return out


def _ragged(rows: np.ndarray, height: int) -> tuple[np.ndarray, int]:
    """Place of each entry in its row, and the most entries of a row; ``rows`` is sorted."""
    counts = np.bincount(rows, minlength=height)
    return np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts), int(counts.max(initial=0))


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Near nodes of each query in one layer, and their squared distances: arrays (queries, beam), nearest first,
    -1 and infinity where there are fewer. ``entry`` has the nodes where each query starts, -1 for none."""
    height, width = len(queries), max(beam, entry.shape[1])
    nodes = np.full((height, width), -1, np.int32)
    gaps = np.full((height, width), np.inf, vectors.dtype)
    nodes[:, : entry.shape[1]] = entry
    row, place = np.nonzero(nodes >= 0)
    gaps[row, place] = _gaps(vectors, nodes[row, place], queries, row)
    if width > beam:
        order = np.argsort(gaps, axis=1, kind="stable")[:, :beam]
        nodes, gaps = np.take_along_axis(nodes, order, axis=1), np.take_along_axis(gaps, order, axis=1)
    opened = nodes < 0
    met = np.zeros((height, len(links)), bool)
    row, place = np.nonzero(nodes >= 0)
    met[row, nodes[row, place]] = True
    live, step = np.arange(height), min(OPENED, beam)
    out_nodes, out_gaps = nodes.copy(), gaps.copy()
    while len(live):
        open_gaps = np.where(opened, np.inf, gaps)
        pick = np.argpartition(open_gaps, step - 1, axis=1)[:, :step] if step < beam else np.tile(np.arange(beam), (len(live), 1))
        active = np.isfinite(np.take_along_axis(open_gaps, pick, axis=1))
        going = active.any(axis=1)
        if not going.all():
            ended = live[~going]
            out_nodes[ended], out_gaps[ended] = nodes[~going], gaps[~going]
            live, nodes, gaps, opened, pick, active = (x[going] for x in (live, nodes, gaps, opened, pick, active))
            if not len(live):
                break
        np.put_along_axis(opened, pick, True, axis=1)
        at = np.where(active, np.take_along_axis(nodes, pick, axis=1), -1)
        offered = np.where(at[:, :, None] >= 0, links[at], -1).reshape(len(live), -1)
        offered.sort(axis=1)
        fresh = offered >= 0
        fresh[:, 1:] &= offered[:, 1:] != offered[:, :-1]
        row, place = np.nonzero(fresh)
        node = offered[row, place]
        new = ~met[live[row], node]
        row, node = row[new], node[new]
        met[live[row], node] = True
        gap = _gaps(vectors, node, queries, live[row])
        better = gap < gaps.max(axis=1)[row]
        row, node, gap = row[better], node[better], gap[better]
        if not len(row):
            continue
        place, most = _ragged(row, len(live))
        more_nodes, more_gaps = np.full((len(live), most), -1, np.int32), np.full((len(live), most), np.inf, gaps.dtype)
        more_nodes[row, place], more_gaps[row, place] = node, gap
        all_gaps = np.concatenate([gaps, more_gaps], axis=1)
        part = np.argpartition(all_gaps, beam - 1, axis=1)[:, :beam]
        gaps = np.take_along_axis(all_gaps, part, axis=1)
        nodes = np.take_along_axis(np.concatenate([nodes, more_nodes], axis=1), part, axis=1)
        opened = np.take_along_axis(np.concatenate([opened, more_nodes < 0], axis=1), part, axis=1)
    order = np.argsort(out_gaps, axis=1, kind="stable")
    return np.take_along_axis(out_nodes, order, axis=1), np.take_along_axis(out_gaps, order, axis=1)


def at_once(nodes: int, most: int) -> int:
    """Searches that go through a graph of so many nodes in step."""
    return max(32, min(most, MARKS // max(1, nodes)))


class Layer:
    """Links of one layer while it grows: room for ``slack`` more than ``most`` before a node is pruned."""

    def __init__(self, vectors: np.ndarray, size: int, most: int, slack: int) -> None:
        self.vectors, self.most, self.slack = vectors, most, slack
        self.links = np.full((size, most + slack), -1, np.int32)
        self.number = np.zeros(size, np.int64)

    def nearest_of(self, rows: np.ndarray, node: np.ndarray, base: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray]:
        """Candidates (row, node) as arrays (rows, ``wide``), nearest first."""
        gap = _gaps(self.vectors, node, self.vectors, base[rows])
        order = np.lexsort((node, gap, rows))
        rows, node, gap = rows[order], node[order], gap[order]
        place, _ = _ragged(rows, len(base))
        few = place < wide
        near, distance = np.full((len(base), wide), -1, np.int32), np.full((len(base), wide), np.inf, self.vectors.dtype)
        near[rows[few], place[few]], distance[rows[few], place[few]] = node[few], gap[few]
        return near, distance

    def connect(self, nodes: np.ndarray, chosen: np.ndarray) -> None:
        """Link new ``nodes`` to those in their rows of ``chosen``, and back."""
        self.links[nodes, : chosen.shape[1]] = chosen
        self.number[nodes] = (chosen >= 0).sum(axis=1)
        row, place = np.nonzero(chosen >= 0)
        target, source = chosen[row, place].astype(np.int64), nodes[row]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        told, back = np.unique(target, return_inverse=True)
        place, _ = _ragged(back, len(told))
        room = (self.number[told] + np.bincount(back, minlength=len(told))) <= self.links.shape[1]
        fits = room[back]
        self.links[target[fits], self.number[target[fits]] + place[fits]] = source[fits]
        self.number[told[room]] += np.bincount(back, minlength=len(told))[room]
        full = np.flatnonzero(~room)
        if len(full):
            held_row, held_place = np.nonzero(self.links[told[full]] >= 0)
            held = self.links[told[full]][held_row, held_place]
            renumbered = np.full(len(told), -1)
            renumbered[full] = np.arange(len(full))
            rows = np.concatenate([held_row, renumbered[back[~fits]]])
            self.prune(told[full], rows, np.concatenate([held, source[~fits].astype(np.int32)]))

    def prune(self, base: np.ndarray, rows: np.ndarray, node: np.ndarray) -> None:
        near, distance = self.nearest_of(rows, node, base, self.most + 2 * self.slack)
        kept = select(self.vectors, base, near, distance, self.most)
        self.links[base] = -1
        self.links[base, : self.most] = kept
        self.number[base] = (kept >= 0).sum(axis=1)

    def finish(self, before: np.ndarray) -> np.ndarray:
        """The links, ``most`` of a node. ``before`` has a near earlier node of each."""
        over = np.flatnonzero(self.number > self.most)
        for a in range(0, len(over), 1 << 14):
            base = over[a : a + (1 << 14)]
            row, place = np.nonzero(self.links[base] >= 0)
            self.prune(base, row, self.links[base][row, place])
        out = np.ascontiguousarray(self.links[:, : self.most])
        for _ in range(3):  # a node that none links to gets a link from its nearest earlier one
            reached = np.zeros(len(out), bool)
            reached[out[out >= 0]] = True
            lost = np.flatnonzero(~reached & (before >= 0))
            if not len(lost):
                break
            out[before[lost], self.most - 1] = lost
        return out


def _peers(vectors: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest earlier nodes within a batch, and their squared distances."""
    own = vectors[a:b].astype(np.float64) - vectors[a]
    square = np.einsum("nd,nd->n", own, own)
    gap = square[:, None] + square[None, :] - 2 * (own @ own.T)
    gap[np.triu_indices(b - a)] = np.inf
    k = min(PEERS, b - a)
    near = np.argpartition(gap, k - 1, axis=1)[:, :k]
    distance = np.take_along_axis(gap, near, axis=1)
    return np.where(np.isfinite(distance), near + a, -1).astype(np.int32), np.maximum(distance, 0).astype(vectors.dtype)


@dataclass
class Graph:
    """``links[l]``: flat neighbour array of layer l, -1 for none."""

    vectors: np.ndarray
    links: list[np.ndarray]

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Up to ``beam`` near nodes of each query, nearest first, -1 for none: array (queries, beam)."""
        out = np.full((len(queries), beam), -1, np.int32)
        rows = at_once(len(self.vectors), BLOCK)
        for a in range(0, len(queries), rows):
            part = queries[a : a + rows].astype(self.vectors.dtype)
            at = np.zeros((len(part), 1), np.int32)
            for layer in reversed(self.links[1:]):
                at, _ = beam_search(self.vectors, layer, part, at, DESCENT)
            out[a : a + len(part)], _ = beam_search(self.vectors, self.links[0], part, at, beam)
        return out


def build(vectors: np.ndarray, level: np.ndarray, links: int = 16, width: int = 48, batch: int = 512) -> Graph:
    """Graph of ``vectors``, which must be sorted by descending ``level``."""
    n, top = len(vectors), int(level[0]) if len(level) else 0
    sizes = [int((level >= layer).sum()) for layer in range(top + 1)]
    layers = [Layer(vectors, size, 2 * links if i == 0 else links, links) for i, size in enumerate(sizes)]
    before = [np.full(size, -1, np.int64) for size in sizes]
    a = min(1, n)  # the first node has nothing to be linked to
    while a < n:
        b = min(n, a + min(at_once(n, batch), a))
        queries, at = vectors[a:b], np.zeros((b - a, 1), np.int32)
        near, distance = _peers(vectors, a, b)
        for number in range(top, -1, -1):
            layer, m = layers[number], min(b, sizes[number]) - a
            beam = width if m > 0 else DESCENT
            found, gaps = beam_search(vectors, layer.links, queries, at, beam)
            at = found[:, :DESCENT]
            if m > 0:
                both = np.concatenate([found[:m], near[:m]], axis=1)
                apart = np.concatenate([gaps[:m], np.where(near[:m] >= 0, distance[:m], np.inf)], axis=1)
                order = np.argsort(apart, axis=1, kind="stable")[:, :width]
                both, apart = np.take_along_axis(both, order, axis=1), np.take_along_axis(apart, order, axis=1)
                nodes = np.arange(a, a + m)
                before[number][nodes] = both[:, 0]
                layer.connect(nodes, select(vectors, nodes, both, apart, links))
        a = b
    return Graph(vectors, [layer.finish(own) for layer, own in zip(layers, before, strict=True)])
