"""The numpy core of context-tree weighting over bytes.

A text is its bytes and an end. A symbol is up to nine binary decisions: whether the text ends here, and if not, the eight bits of the
byte. Each decision has a context tree of its own, whose contexts are the bytes before, up to ``depth``; before the text stand zeros. A node of a
tree holds how often each bit followed its context; its Krichevsky-Trofimov estimate and its children's weighted probabilities mix to its
weighted probability, half and half. Given the training counts, the probability of a bit is the mix of the estimates of all depths on its
path, each with the posterior weight of stopping there; below the deepest node that training has seen nothing is mixed in.

A key is a context and a symbol (nine bits): the byte before first (highest), then the one before that, and so on, the symbol
last. Keys in order so stand by context, and a key's context of depth d is its d highest bytes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from .bundles import runs

LN_HALF = np.log(0.5)
END, DECISIONS = 256, 9
SYMBOL = np.uint64(511)


def keys_of(data: np.ndarray, offsets: np.ndarray, depth: int) -> np.ndarray:
    """The keys of some texts, end to end: of each its bytes and its end."""
    m = len(offsets) - 1
    at = np.arange(len(data)) + np.repeat(np.arange(m) * (depth + 1) + depth, np.diff(offsets))
    laid, own = np.zeros(len(data) + m * (depth + 1), np.uint64), np.zeros(len(data) + m * (depth + 1), bool)
    ends = offsets[1:] + np.arange(1, m + 1) * (depth + 1) - 1
    laid[at] = data
    own[at] = own[ends] = True
    key = np.zeros(len(laid), np.uint64)
    for d in range(1, depth + 1):
        key[d:] |= laid[:-d] << np.uint64(8 * (depth - d) + 9)
    laid[ends] = END
    return (key | laid)[own]


def ln_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 6.0
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y
    p = x * (x + 1)
    p *= (x + 2) * (x + 3)
    p *= (x + 4) * (x + 5)
    return out - np.log(p)


def ln_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ln_gamma(a + 0.5) + ln_gamma(b + 0.5) - ln_gamma(a + b + 1.0) - 1.1447298858494002


@dataclass
class Level:
    """The nodes of one depth and decision: sorted (context << 9 | path), counts, the sum of the children's ln P_w, ln P_w, and the weight of stopping."""

    nodes: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    below: np.ndarray | None
    ln_pw: np.ndarray
    stop: np.ndarray

    def of(self, which: np.ndarray) -> Level:
        return Level(*(None if x is None else x[which] for x in (self.nodes, self.zeros, self.ones, self.below, self.ln_pw, self.stop)))


def level(nodes: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None = None) -> Level:
    """below: None at the deepest contexts."""
    kt = ln_kt(zeros, ones)
    if below is None:
        return Level(nodes, zeros, ones, None, kt, np.ones(len(nodes)))
    pw = np.logaddexp(kt + LN_HALF, below + LN_HALF)
    return Level(nodes, zeros, ones, below, pw, np.exp(kt + LN_HALF - pw))


def above(child: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(parents' nodes, zeros, ones, below): what is known of the parents from these children."""
    parent = child.nodes >> np.uint64(17) << np.uint64(9) | child.nodes & SYMBOL
    order = np.argsort(parent)
    cut, _ = runs(parent[order])
    return parent[order[cut]], *(np.add.reduceat(x[order], cut) if len(cut) else np.zeros(0) for x in (child.zeros, child.ones, child.ln_pw))


def decided(key: np.ndarray, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which keys come to decision j, the paths to it, their bits)."""
    symbol = key & SYMBOL
    if j == 0:
        return np.arange(len(key)), np.ones(len(key), np.uint64), symbol == END
    own = np.flatnonzero(symbol < END)
    symbol = symbol[own]
    return own, symbol >> np.uint64(9 - j) | np.uint64(1 << (j - 1)), (symbol >> np.uint64(8 - j) & np.uint64(1)).astype(bool)


def tree(key: np.ndarray, n: np.ndarray, j: int, depth: int, top: int) -> dict[int, Level]:
    """The levels from ``top`` to ``depth`` of decision j, weighed from below; key and n: training keys, each once, in order, and their counts."""
    own, path, bit = decided(key, j)
    node, n = (key[own] & ~SYMBOL) | path, n[own].astype(float)
    cut, _ = runs(node)
    ones, every = (np.add.reduceat(x, cut) if len(cut) else np.zeros(0) for x in (n * bit, n))
    out = {depth: level(node[cut], every - ones, ones)}
    for d in range(depth - 1, top - 1, -1):
        out[d] = level(*above(out[d + 1]))
    return out


def mixed(key: np.ndarray, depth: int, levels: Callable[[int], dict[int, Level]]) -> np.ndarray:
    """ln P of each key's symbol after its context; ``levels``: the levels 0 to depth of a decision."""
    total = np.zeros(len(key))
    for j in range(DECISIONS):
        held = levels(j)
        own, path, bit = decided(key, j)
        p, rest, last = np.zeros(len(own)), np.ones(len(own)), np.full(len(own), 0.5)
        live = np.arange(len(own))
        for d in range(depth + 1):
            nodes = held[d].nodes
            if not len(nodes) or not len(live):
                break
            want = key[own[live]] >> np.uint64(8 * (depth - d) + 9) << np.uint64(9) | path[live]
            at = np.minimum(np.searchsorted(nodes, want), len(nodes) - 1)
            hit = nodes[at] == want
            live, at = live[hit], at[hit]
            a, b = held[d].zeros[at], held[d].ones[at]
            kt, stop = (np.where(bit[live], b, a) + 0.5) / (a + b + 1.0), held[d].stop[at]
            p[live] += rest[live] * stop * kt
            rest[live] *= 1 - stop
            last[live] = kt
        total[own] += np.log(p + rest * last)
    return total


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with its total."""
    order = np.argsort(key)
    key, n = key[order], n[order]
    cut, _ = runs(key)
    return key[cut], np.add.reduceat(n, cut) if len(cut) else n
