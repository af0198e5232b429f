"""Weighted acyclic automata over integer labels: minimal transducers from phrases to counts.

A phrase is a row of labels, padded with 0 at its end. The automaton is deterministic and minimal: phrases share
prefixes as paths, and states with the same continuations and counts are one state. Counts sit on the arc that ends a
phrase. All inner work is over NumPy arrays; Python touches each state once.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


def sort_phrases(paths: np.ndarray) -> np.ndarray:
    """Row order by labels, first label first; a phrase comes before its continuations."""
    return np.lexsort(paths.T[::-1])


def tally(paths: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases in ascending order with their summed counts."""
    if not len(paths):
        return paths, counts
    order = sort_phrases(paths)
    paths, counts = paths[order], counts[order]
    new = np.ones(len(paths), bool)
    new[1:] = (paths[1:] != paths[:-1]).any(axis=1)
    at = np.flatnonzero(new)
    return paths[at], np.add.reduceat(counts, at)


def merged(blocks: list[tuple[np.ndarray, np.ndarray]], rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct phrases of ascending blocks with their summed counts, in ascending parts from about ``rows`` rows.

    A block's phrases are distinct, so a part has at most ``rows`` rows and one step of each block more.
    """
    blocks = [b for b in blocks if len(b[0])]
    if not blocks:
        return
    step = max(1, rows // len(blocks))
    picked = np.concatenate([paths[step::step] for paths, _ in blocks])
    bounds = picked[sort_phrases(picked)][len(blocks) - 1 :: len(blocks)].tolist()
    at = [0] * len(blocks)
    for bound in [*bounds, None]:
        to = [
            len(paths) if bound is None else bisect_left(range(len(paths)), bound, lo=a, key=lambda i, p=paths: p[i].tolist())
            for (paths, _), a in zip(blocks, at)
        ]
        if to != at:
            yield tally(*(np.concatenate([x[a:b] for x, a, b in zip(column, at, to)]) for column in zip(*blocks)))
        at = to


def prefix_counts(paths: np.ndarray, counts: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of all prefixes of ``low`` labels and more of distinct ascending phrases: (phrases, counts), unsorted."""
    size = (paths != 0).sum(axis=1)
    out, sums = [], []
    for m in range(low, paths.shape[1] + 1):
        held = paths[size >= m].copy()
        held[:, m:] = 0
        n = counts[size >= m]
        if len(held):
            new = np.ones(len(held), bool)
            new[1:] = (held[1:] != held[:-1]).any(axis=1)
            at = np.flatnonzero(new)
            out.append(held[at])
            sums.append(np.add.reduceat(n, at))
    return (np.concatenate(out), np.concatenate(sums)) if out else (paths[:0], counts[:0])


class Transducer(NamedTuple):
    """Arcs of state s are first[s]:first[s + 1], labels ascending; state 0 ends, the last state is the start."""

    first: np.ndarray
    label: np.ndarray
    weight: np.ndarray  # count of the phrase that ends with the arc; 0 if it is only a beginning
    target: np.ndarray

    def pack(self) -> bytes:
        return struct.pack("<2q", len(self.first), len(self.label)) + b"".join(
            np.ascontiguousarray(a, k).tobytes() for a, k in zip(self, ("<i8", "<u8", "<i8", "<i4")))

    @staticmethod
    def unpack(raw: bytes) -> Transducer:
        states, arcs = struct.unpack_from("<2q", raw)
        at, out = 16, []
        for n, k in zip((states, arcs, arcs, arcs), ("<i8", "<u8", "<i8", "<i4")):
            out.append(np.frombuffer(raw, k, n, at))
            at += out[-1].nbytes
        return Transducer(*out)

    def phrases(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Accepted phrases as rows of ``depth`` labels, with their counts; in no order."""
        state, path = np.array([len(self.first) - 2]), np.zeros((1, depth), np.uint64)
        out, sums = [], []
        for d in range(depth):
            row, arc = _expand(self.first, state)
            path = path[row]
            path[:, d] = self.label[arc]
            ends = self.weight[arc] > 0
            out.append(path[ends])
            sums.append(self.weight[arc][ends])
            state = self.target[arc].astype(np.int64)
        return np.concatenate(out), np.concatenate(sums)


def _expand(first: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the states all arcs: (place in ``state``, arc)."""
    many = first[state + 1] - first[state]
    row = np.repeat(np.arange(len(state)), many)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[state][row]


class Builder:
    """Incremental construction from phrases in ascending order.

    ``add`` takes ascending blocks of distinct phrases; two blocks share no first label. When a block is closed, nothing
    can follow under its first labels, so all their states are frozen: a state whose arcs are already in the register
    is replaced by the registered one, others are registered. Only the start state stays open.
    """

    def __init__(self) -> None:
        self.register: dict[bytes, int] = {b"": 0}
        self.arcs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
        self.start: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, paths: np.ndarray, counts: np.ndarray) -> None:
        if not len(paths):
            return
        depth = paths.shape[1]
        size = (paths != 0).sum(axis=1)
        begins = np.ones(paths.shape, bool)
        begins[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
        begins &= np.arange(depth) < size[:, None]
        target = None
        for d in range(depth, 0, -1):  # arcs into the prefixes of d labels
            at = np.flatnonzero(begins[:, d - 1])
            label, weight = paths[at, d - 1], np.where(size[at] == d, counts[at], 0)
            if target is None:
                target = np.zeros(len(at), np.int32)
            if d == 1:
                self.start.append((label, weight, target))
                return
            above = np.flatnonzero(begins[:, d - 2])  # prefixes of d - 1 labels; those with arcs get a state
            parent = np.searchsorted(above, at, "right") - 1
            state = np.zeros(len(above), np.int32)
            if len(at):
                cuts = np.flatnonzero(np.diff(parent)) + 1
                bounds = [0, *cuts.tolist(), len(at)]
                for a, b in zip(bounds[:-1], bounds[1:]):
                    state[parent[a]] = self._freeze(label[a:b], weight[a:b], target[a:b])
            target = state

    def _freeze(self, label: np.ndarray, weight: np.ndarray, target: np.ndarray) -> int:
        key = label.tobytes() + weight.tobytes() + target.tobytes()
        known = self.register.get(key)
        if known is None:
            known = self.register[key] = len(self.arcs)
            self.arcs.append((label, weight, target))
        return known

    def finish(self) -> Transducer:
        arcs = self.arcs
        if self.start:
            arcs = [*arcs, tuple(np.concatenate(x) for x in zip(*self.start))]
        else:
            arcs = [*arcs, arcs[0]]
        first = np.concatenate([[0], np.cumsum([len(a[0]) for a in arcs])])
        return Transducer(first, *(np.concatenate([a[i] for a in arcs]) for i in range(3)))


def build(paths: np.ndarray, counts: np.ndarray) -> Transducer:
    """Minimal transducer of distinct ascending phrases."""
    b = Builder()
    b.add(paths, counts)
    return b.finish()


def union(parts: list[Transducer], depth: int, least: int = 1) -> Transducer:
    """One minimal transducer of all phrases of ``parts``, counts summed; sums below ``least`` are dropped."""
    paths, counts = tally(*(np.concatenate(x) for x in zip(*(t.phrases(depth) for t in parts))))
    return build(paths[counts >= least], counts[counts >= least])


def compose(asked: Transducer, counts: Transducer, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The phrases that both accept, with the counts of the second: both are walked together, arc by equal arc."""
    names = np.unique(counts.label)
    state_of = np.repeat(np.arange(len(counts.first) - 1), np.diff(counts.first))
    keys = state_of * (len(names) + 1) + np.searchsorted(names, counts.label)
    left, right = np.array([len(asked.first) - 2]), np.array([len(counts.first) - 2])
    path, out, sums = np.zeros((1, depth), np.uint64), [], []
    for d in range(depth):
        row, arc = _expand(asked.first, left)
        label = asked.label[arc]
        name = np.searchsorted(names, label)
        met = name < len(names)
        met[met] = names[name[met]] == label[met]
        row, arc, name = row[met], arc[met], name[met]
        want = right[row] * (len(names) + 1) + name
        at = np.searchsorted(keys, want)
        met = at < len(keys)
        met[met] = keys[at[met]] == want[met]
        row, arc, at = row[met], arc[met], at[met]
        path = path[row]
        path[:, d] = asked.label[arc]
        ends = (asked.weight[arc] > 0) & (counts.weight[at] > 0)
        out.append(path[ends])
        sums.append(counts.weight[at][ends])
        left, right = asked.target[arc].astype(np.int64), counts.target[at].astype(np.int64)
    return np.concatenate(out), np.concatenate(sums)
