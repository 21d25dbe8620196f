"""SuperMinHash signatures of many sets at once.

Each element draws a random permutation of the slots and a rank per step; slot
p[j] gets the least j + r over all elements, so within a step the slots are
covered by permutations and not independently, which lowers the variance. As
the step outweighs the fraction, a set is finished at the first step after
which all its slots are filled: larger sets stop early.
"""

from __future__ import annotations

import numpy as np

STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(elements: np.ndarray, of: np.ndarray, n_sets: int, slots: int) -> np.ndarray:
    """(n_sets, slots) of step << 32 | fraction. elements: hashes, of: the set of each, ascending. Repeats change nothing."""
    out = np.full(n_sets * slots, np.iinfo(np.uint64).max, np.uint64)
    table = out.reshape(n_sets, slots)
    small = np.uint8 if slots <= 256 else np.uint16
    order = np.tile(np.arange(slots, dtype=small), (len(elements), 1))
    state = elements.astype(np.uint64)
    for j in range(slots):
        if not len(state):
            break
        draw = mix(state + np.uint64((j + 1) * int(STEP) & (1 << 64) - 1))
        swap = j + ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(state))
        slot = order[row, swap]
        order[row, swap] = order[:, j]
        np.minimum.at(out, of * slots + slot, np.uint64(j) << np.uint64(32) | draw >> np.uint64(32))
        open_sets = table.max(axis=1) >= np.uint64(j + 1) << np.uint64(32)
        going = open_sets[of]
        if going.sum() < 0.7 * len(going):
            state, of, order = state[going], of[going], order[going]
    return table


def bands(table: np.ndarray, n: int) -> np.ndarray:
    """(sets, n) hashes of n equal groups of slots, distinct by group."""
    rows = table.shape[1] // n
    out = np.zeros((len(table), n), np.uint64) + (np.arange(n, dtype=np.uint64) + np.uint64(1)) * STEP
    for r in range(rows):
        out = mix(out ^ table[:, r : n * rows : rows]) + STEP
    return out
