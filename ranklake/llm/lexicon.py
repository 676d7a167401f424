"""A minimal acyclic transducer from words to sequences of token ids.

Words are inserted in byte order, and states with equal futures are merged as
soon as no later word can change them, so common suffixes are stored once.  An
arc carries the number of words that sort before it within its state; the sum
along a path is the word's rank, which indexes the table of id sequences.  All
parts are flat arrays in one buffer that can be mapped into memory.
"""

from __future__ import annotations

import mmap
import os

import numpy as np

HEAD = np.dtype([("arcs", "<i8"), ("words", "<i8"), ("ids", "<i8"), ("root", "<i8")])


def compile_words(entries: dict[bytes, list[int]]) -> bytes:
    """The transducer of the given words, as one buffer.  Empty words are left out."""
    register: dict[tuple, int] = {}
    arcs_of: list[tuple] = []  # by state: ((byte, target), ...), final
    below: list[int] = []  # by state: accepted words

    def state_of(node: list) -> int:
        key = (node[0], tuple(node[1]))
        at = register.get(key)
        if at is None:
            at = register[key] = len(arcs_of)
            arcs_of.append(key)
            below.append(int(key[0]) + sum(below[t] for _, t in key[1]))
        return at

    words = sorted(w for w in entries if w)
    path: list[list] = [[False, []]]  # the nodes that the last word runs through
    last = b""
    for w in [*words, None]:
        keep = len(os.path.commonprefix([last, w])) if w is not None else 0
        while len(path) > keep + 1:
            at = state_of(path.pop())
            path[-1][1].append((last[len(path) - 1], at))
        if w is None:
            break
        path.extend([False, []] for _ in w[keep:])
        path[-1][0] = True
        last = w
    root = state_of(path[0])
    keys, targets, weights = [], [], []
    for s, (final, arcs) in enumerate(arcs_of):
        before = int(final)
        for b, t in arcs:
            keys.append(s << 8 | b)
            targets.append(t)
            weights.append(before)
            before += below[t]
    sizes = [len(entries[w]) for w in words]
    head = np.array([(len(keys), len(words), sum(sizes), root)], dtype=HEAD)
    finals = np.array([f for f, _ in arcs_of] or [False], dtype=np.uint8)
    pad = bytes(-len(finals) % 8)
    return b"".join([
        head.tobytes(),
        np.array(len(finals), "<i8").tobytes(),
        np.array(keys, "<i8").tobytes(),
        np.array(targets, "<i8").tobytes(),
        np.array(weights, "<i8").tobytes(),
        np.concatenate([[0], np.cumsum(sizes, dtype="<i8")]).astype("<i8").tobytes(),
        finals.tobytes() + pad,
        np.array([i for w in words for i in entries[w]], "<u4").tobytes(),
    ])


def mapped(buffer: bytes) -> memoryview:
    """The buffer in a memory-mapped file that has no name on any disk."""
    fd = os.memfd_create("lexicon")
    try:
        os.write(fd, b"\0") if not buffer else None
        view = memoryview(buffer)
        while len(view):
            view = view[os.write(fd, view) :]
        return memoryview(mmap.mmap(fd, 0, prot=mmap.PROT_READ))
    finally:
        os.close(fd)


class Places:
    """Where each of distinct keys (at least 0) stands in a list, by open addressing; many are looked up at once."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(8, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.places = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = np.flatnonzero(self.keys[slot] < 0)
            own, first = np.unique(slot[free], return_index=True)
            self.keys[own], self.places[own] = keys[left[free[first]]], left[free[first]]
            lost = np.ones(len(left), bool)
            lost[free[first]] = False
            left, slot = left[lost], slot[lost] + 1 & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        slot = self.slots(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.places[slot], -1)
        go = np.flatnonzero((found != keys) & (found >= 0))
        slot = slot[go]
        while len(go):
            slot = slot + 1 & self.mask
            found, wanted = self.keys[slot], keys[go]
            out[go] = np.where(found == wanted, self.places[slot], -1)
            more = (found != wanted) & (found >= 0)
            go, slot = go[more], slot[more]
        return out


class Lexicon:
    """Looks many words up at once in a mapped buffer."""

    def __init__(self, buffer) -> None:
        head = np.frombuffer(buffer, HEAD, 1)[0]
        at = HEAD.itemsize

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(buffer, kind, n, at)
            at += out.nbytes
            return out

        states = int(take("<i8", 1)[0])
        self.root, self.words = int(head["root"]), int(head["words"])
        self.keys, self.targets, self.weights = (take("<i8", int(head["arcs"])) for _ in range(3))
        self.offsets = take("<i8", self.words + 1)
        self.finals = take("u1", states)
        at += -states % 8
        self.ids = take("<u4", int(head["ids"]))
        self.arcs = Places(self.keys)

    def ranks(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For words data[start : start + size]: each one's rank, or -1."""
        out = np.full(len(starts), -1, np.int64)
        if not self.words or not len(starts):
            return out
        rows = np.flatnonzero(sizes > 0)
        state = np.full(len(rows), self.root, np.int64)
        rank = np.zeros(len(rows), np.int64)
        begin, size = starts[rows].astype(np.int64), sizes[rows]
        step = 0
        while len(rows):
            key = state << 8 | data[begin + step]
            arc = self.arcs.of(key)
            alive = arc >= 0
            rows, arc, begin, size = rows[alive], arc[alive], begin[alive], size[alive]
            state, rank = self.targets[arc], rank[alive] + self.weights[arc]
            step += 1
            ended = size == step
            done = ended & (self.finals[state] == 1)
            out[rows[done]] = rank[done]
            go = ~ended
            rows, state, rank, begin, size = rows[go], state[go], rank[go], begin[go], size[go]
        return out
