"""A run-length index over short texts, in numpy, for matching statistics up to 50 bytes.

The rows of the index are the 50-byte strings of the texts, in the order of their bytes; equal strings stand together, the one that comes
last in the texts first. What is kept of that order is the run-compressed Burrows-Wheeler transform: a run ends where the byte before
the strings changes, where the step to the row of the string one to the left changes, or where several equal strings begin or end. Of a run,
the index has its start, its byte, its step, and the sampled position of its end.

Streaming goes through all texts from right to left together, a step of the transform each time, and finds the run of each row by
search. At every position the matching statistic that matters is whether the next 50 bytes are also elsewhere, and where first: the
end of their rows ends a run, whose sample is that place.
"""

from __future__ import annotations

import numpy as np

LENGTH = 50
START = np.uint16(256)  # before a text's first byte


def dense(key: np.ndarray) -> np.ndarray:
    """The ranks of some numbers: 0 for the smallest, equal ones alike."""
    order = np.argsort(key)
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
    return rank


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place, as a number in their order; zeros stand after the data."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data),), ">u8", padded, strides=(1,)).astype(np.uint64)


class RunIndex:
    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: bytes of the texts, end to end; a text under 50 bytes has no row."""
        sizes = np.diff(offsets)
        self.data, self.offsets, self.rows = data, offsets, np.maximum(sizes - LENGTH + 1, 0)
        n = int(self.rows.sum())
        base = np.cumsum(self.rows) - self.rows
        self.base = base  # of a text's rows among all, by place
        place = np.arange(n) + np.repeat(offsets[:-1] - base, self.rows)  # of each string
        left = np.repeat(np.arange(len(sizes)), self.rows)
        rank = dense(words(data))
        for size in (8, 16):  # ranks of 16 and then 32 bytes; those that run beyond a text aren't used
            after = np.zeros(len(data), np.uint32)
            after[: max(0, len(data) - size)] = rank[size:]
            rank = dense(rank.astype(np.uint64) << np.uint64(32) | after)
        name = dense(rank[place].astype(np.uint64) << np.uint64(32) | rank[place + LENGTH - 32])
        key = np.sort(name.astype(np.uint64) << np.uint64(32) | np.arange(n - 1, -1, -1, dtype=np.uint64))
        order = n - 1 - (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # row -> string
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        first = place == offsets[left]
        before = np.where(first, START, data[place - 1].astype(np.uint16))[order]
        step = np.where(first[order], 0, row[order - 1] - np.arange(n))
        last = np.append(np.diff(key >> np.uint64(32)) != 0, True)[:n]
        several = ~(last & np.append(True, last[:-1])[:n])
        head = np.ones(n, bool)
        head[1:] = (before[1:] != before[:-1]) | (step[1:] != step[:-1]) | last[:-1] & (several[1:] | several[:-1])
        self.starts = np.flatnonzero(head)
        self.bytes, self.steps, self.several = before[self.starts], step[self.starts], several[self.starts]
        ends = np.append(self.starts[1:], n) - 1 if n else self.starts
        self.samples = order[ends]
        self.closing = np.flatnonzero(last[ends] & several[ends])  # the runs that end equal strings
        self.at_end = row[base[self.rows > 0] + self.rows[self.rows > 0] - 1]  # the rows that streaming begins with
        self.n = n

    @property
    def runs(self) -> int:
        return len(self.starts)

    def stream(self) -> np.ndarray:
        """For each string of the texts, text by text, the first string that is equal to it."""
        out = np.zeros(self.n, np.int64)
        at, full = self.at_end, np.flatnonzero(self.rows)
        order = np.argsort(self.rows[full], kind="stable")
        at, sizes, to = at[order], self.rows[full][order], (self.base + self.rows - 1)[full][order]
        back = 0
        while len(at):
            run = np.searchsorted(self.starts, at, "right") - 1
            out[to - back] = to - back
            held = np.flatnonzero(self.several[run])
            out[(to - back)[held]] = self.samples[self.closing[np.searchsorted(self.closing, run[held])]]
            back += 1
            skip = int(np.searchsorted(sizes, back, "right"))
            at, sizes, to = (at + self.steps[run])[skip:], sizes[skip:], to[skip:]
        return out
