"""A minimal acyclic transducer: byte strings to their ranks in sorted order.

States with equal continuations are shared. An arc carries how many words sort before
those behind it, so the sum along a path is the word's rank, which addresses its ids.
"""

from __future__ import annotations

import numpy as np


def compile_words(words: list[bytes]) -> dict[str, np.ndarray]:
    """Dense tables over byte classes: next state (-1: none), arc output, final flags.

    ``words`` must be sorted, distinct and not empty strings.
    """
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of a finished state: (final, ((byte, state), ...))

    def finished(final: bool, out: list[tuple[int, int]]) -> int:
        shape = (final, tuple(out))
        if shape not in register:
            register[shape] = len(arcs)
            arcs.append(shape)
        return register[shape]

    path: list[list] = [[False, []]]  # open states of the last word: [final, arcs]
    last = b""
    for word in [*words, b""]:
        common = 0
        while common < min(len(word), len(last)) and word[common] == last[common]:
            common += 1
        while len(path) > common + 1:
            final, out = path.pop()
            path[-1][1].append((last[len(path) - 1], finished(final, out)))
        for _ in word[common:]:
            path.append([False, []])
        if word:
            path[-1][0] = True
        last = word
    root = finished(*path[0])

    below = np.zeros(len(arcs), np.int64)  # words behind a state; children come first
    for state, (final, out) in enumerate(arcs):
        below[state] = final + sum(int(below[s]) for _, s in out)
    used = sorted({b for _, out in arcs for b, _ in out})
    classes = np.full(256, len(used), np.int32)
    classes[used] = np.arange(len(used), dtype=np.int32)
    width = len(used) + 1  # the last class has no arc
    target = np.full((len(arcs), width), -1, np.int32)
    output = np.zeros((len(arcs), width), np.int32)
    for state, (final, out) in enumerate(arcs):
        before = int(final)
        for b, s in out:
            target[state, classes[b]], output[state, classes[b]] = s, before
            before += int(below[s])
    finals = np.array([final for final, _ in arcs], np.int32)
    return {
        "target": target.ravel(), "output": output.ravel(), "final": finals,
        "classes": classes, "shape": np.array([root, width, max(map(len, words), default=0)], np.int32),
    }


def ranks(tables: dict[str, np.ndarray], data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The rank of each byte range, -1 if it is no word; all ranges walk together, byte by byte."""
    root, width, longest = (int(x) for x in tables["shape"])
    target, output, final = tables["target"], tables["output"], tables["final"]
    length = end - start
    out = np.full(len(start), -1, np.int64)
    at = np.flatnonzero((length > 0) & (length <= longest))
    classes = tables["classes"][data]
    place, left = start[at], length[at]
    state, total = np.full(len(at), root, np.int64), np.zeros(len(at), np.int64)
    while len(at):
        arc = state * width + classes[place]
        total += output[arc]
        state = target[arc].astype(np.int64)
        left = left - 1
        place = place + 1
        done = np.flatnonzero((left == 0) & (state >= 0))
        hit = done[final[state[done]] != 0]
        out[at[hit]] = total[hit]
        go = np.flatnonzero((left > 0) & (state >= 0))
        at, place, left, state, total = at[go], place[go], left[go], state[go], total[go]
    return out
