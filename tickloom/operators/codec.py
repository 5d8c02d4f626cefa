"""Packed series: timestamps as deltas of deltas, values as exclusive ors with the one before, in bits.

Parquet's encodings serve storage; this codec serves exchange in the packed format. A series' chunk is packed in one call from lists of
(value, width); chunks are packed and unpacked a partition at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..plans.model import CHUNK_SECONDS, MAX_TS

PACKED = "series_id long, chunk_start long, n int, ts_bits int, val_bits int, blob binary"
UNPACKED = "series_id long, chunk_start long, seq long, ts long, val double"
#: (least, greatest, prefix, prefix bits, bits, bias) of a delta of deltas.
BANDS = ((-63, 64, 0b10, 2, 7, 63), (-255, 256, 0b110, 3, 9, 255), (-2047, 2048, 0b1110, 4, 12, 2047), (-(2**31) + 1, 2**31, 0b1111, 4, 32, 2**31 - 1))


class ParseError(ValueError):
    """Bits that are no packed series."""


def lay(values: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """The low ``width`` bits of each value, highest first, as an array of bits."""
    widths = np.asarray(widths, np.int64)
    ends = np.cumsum(widths)
    shift = np.repeat(ends, widths) - 1 - np.arange(int(ends[-1]) if len(ends) else 0)
    return ((np.repeat(np.asarray(values, np.uint64), widths) >> shift.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)


Fields = tuple[list[int], list[int]]  # values and their widths


def timestamp_fields(ts: list[int]) -> Fields:
    if ts and (min(ts) < 0 or max(ts) > MAX_TS):
        raise ValueError("a timestamp is out of range")
    if not ts:
        return [], []
    header = ts[0] - ts[0] % CHUNK_SECONDS
    values, widths, last, delta = [header, ts[0] - header], [32, 14], ts[0], ts[0] - header
    for t in ts[1:]:
        d, delta, last = t - last - delta, t - last, t
        if d == 0:
            values.append(0)
            widths.append(1)
            continue
        for low, high, prefix, size, bits, bias in BANDS:
            if low <= d <= high:
                values.append(prefix << bits | (d + bias))
                widths.append(size + bits)
                break
        else:
            raise ValueError("timestamps are too far apart")
    return values, widths


def value_fields(val: np.ndarray) -> Fields:
    raw = np.array(val, np.float64)
    raw[np.isnan(raw)] = np.nan  # one NaN for all
    values, widths, lead, trail, last = [], [], 64, 64, 0
    for i, x in enumerate(raw.view(np.uint64).tolist()):
        if not i:
            values.append(x)
            widths.append(64)
        elif (y := x ^ last) == 0:
            values.append(0)
            widths.append(1)
        else:
            zeros, right = min(31, 64 - y.bit_length()), min(63, (y & -y).bit_length() - 1)
            if lead + trail < 64 and zeros >= lead and right >= trail:
                values.append(0b10)
                widths.append(2)
            else:
                lead, trail = zeros, right
                values.append(0b11 << 11 | lead << 6 | trail)
                widths.append(13)
            values.append(y >> trail)
            widths.append(64 - lead - trail)
        last = x
    return values, widths


def timestamp_bits(ts: np.ndarray) -> np.ndarray:
    values, widths = timestamp_fields(np.asarray(ts, np.int64).tolist())
    return lay(np.array(values, np.uint64), widths)


def value_bits(val: np.ndarray) -> np.ndarray:
    values, widths = value_fields(val)
    return lay(np.array(values, np.uint64), widths)


class Bits:
    def __init__(self, body: bytes, used: int):
        self.left = used
        self.number = int.from_bytes(body, "big") >> (8 * len(body) - used)

    def read(self, n: int) -> int:
        if n > self.left:
            raise ParseError("the bits end early")
        self.left -= n
        return (self.number >> self.left) & ((1 << n) - 1)

    def band(self, most: int) -> int:
        """How many ones stand before a zero, ``most`` at most."""
        n = 0
        while n < most and self.read(1):
            n += 1
        return n


def read_timestamps(r: Bits, n: int) -> list[int]:
    out = []
    if n:
        header = r.read(32)
        delta = r.read(14)
        out.append(header + delta)
    for _ in range(n - 1):
        if k := r.band(4):
            _, _, _, _, size, bias = BANDS[k - 1]
            delta += r.read(size) - bias
        out.append(out[-1] + delta)
    return out


def read_values(r: Bits, n: int) -> list[float]:
    raw, lead, trail = [], 64, 64
    for i in range(n):
        if not i:
            raw.append(r.read(64))
        elif not r.read(1):
            raw.append(raw[-1])
        else:
            if r.read(1):
                lead, trail = r.read(5), r.read(6)
            if lead + trail >= 64:
                raise ParseError("a value has no bits")
            raw.append(raw[-1] ^ r.read(64 - lead - trail) << trail)
    return np.array(raw, np.uint64).view(np.float64).tolist()


def stream(fields: Fields) -> bytes:
    """A count of whole words, the bits used of the last, and the words. A few fields are joined as one number, many as an array of bits."""
    values, widths = fields
    n = sum(widths)
    words = -(-n // 64)
    if len(values) <= 256:
        number = 0
        for v, w in zip(values, widths, strict=True):
            number = number << w | v
        body = (number << (64 * words - n)).to_bytes(8 * words, "big")
    else:
        full = np.zeros(words * 64, np.uint8)
        full[:n] = lay(np.array(values, np.uint64), widths)
        body = np.packbits(full).tobytes()
    return words.to_bytes(4, "big") + (n - 64 * max(0, words - 1)).to_bytes(1, "big") + body


def packed(ts: np.ndarray, val: np.ndarray) -> tuple[int, int, int, bytes]:
    """(points, bits of timestamps, bits of values, the packed series)."""
    a, b = timestamp_fields(np.asarray(ts, np.int64).tolist()), value_fields(val)
    return len(ts), sum(a[1]), sum(b[1]), len(ts).to_bytes(4, "big") + stream(a) + stream(b)


def pack(ts: np.ndarray, val: np.ndarray) -> bytes:
    return packed(ts, val)[3]


def unpack(blob: bytes) -> tuple[list[int], list[float]] | None:
    """The points of a packed series, None if the bytes are none."""
    try:
        n, at, parts = int.from_bytes(blob[:4], "big"), 4, []
        for _ in range(2):
            words, used = int.from_bytes(blob[at : at + 4], "big"), blob[at + 4]
            body = blob[at + 5 : at + 5 + 8 * words]
            if len(body) != 8 * words:
                return None
            if used > 64:
                return None
            parts.append(Bits(body, 64 * max(0, words - 1) + used))
            at += 5 + 8 * words
        return read_timestamps(parts[0], n), read_values(parts[1], n)
    except (ParseError, IndexError):
        return None


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(series, chunk, ts, val) of rows sorted by series, chunk and seq; a run may go on in the next batch."""
    held: list[tuple] = []
    for batch in batches:
        s, c, ts, val = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        cut = np.append(np.flatnonzero(np.diff(s, prepend=s[:1] - 1) | np.diff(c, prepend=c[:1] - 1)), len(s))
        for a, b in zip(cut, cut[1:], strict=False):
            if held and (held[0][0], held[0][1]) != (s[a], c[a]):
                yield *held[0][:2], np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])
                held = []
            held.append((s[a], c[a], ts[a:b], val[a:b]))
    if held:
        yield *held[0][:2], np.concatenate([h[2] for h in held]), np.concatenate([h[3] for h in held])


def batched(rows: Iterator[tuple], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


PACKED_TYPE = pa.schema([("series_id", pa.int64()), ("chunk_start", pa.int64()), ("n", pa.int32()), ("ts_bits", pa.int32()), ("val_bits", pa.int32()), ("blob", pa.binary())])
UNPACKED_TYPE = pa.schema([("series_id", pa.int64()), ("chunk_start", pa.int64()), ("seq", pa.int64()), ("ts", pa.int64()), ("val", pa.float64())])


def pack_chunks(points: DataFrame) -> DataFrame:
    """PACKED rows from (series_id, chunk_start, seq, ts, val): one shuffle and sort by series and chunk, then a pass over each
    partition. A run is one series' two hours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for s, c, ts, val in runs(batches):
                yield s, c, *packed(ts, val)

        yield from batched(rows(), PACKED_TYPE, 4096)

    ranged = points.repartition("series_id", "chunk_start").sortWithinPartitions("series_id", "chunk_start", "seq")
    return ranged.select("series_id", "chunk_start", "ts", "val").mapInArrow(run, PACKED)


def unpack_chunks(packed: DataFrame) -> DataFrame:
    """The points of packed rows; ``seq`` counts within the row. Rows that can't be read give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for s, c, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    if (found := unpack(blob)) is not None:
                        for k, (t, v) in enumerate(zip(*found, strict=True)):
                            yield s, c, k, t, v

        yield from batched(rows(), UNPACKED_TYPE, 16_384)

    return packed.select("series_id", "chunk_start", "blob").mapInArrow(run, UNPACKED)
