"""Texts in bundles of some megabytes, written once to the shared folder.

Later passes find the same texts together without hashing them again, in tasks of bounded size: a bundle is cut by bytes and rows as they
come, so that neither equal rows nor one id of many rows make a bundle larger. A longer text is a bundle of its own. A first
message of each bundle is written in the same pass. Messages are packed numpy arrays for a part (shard) of some key space.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise, utf8

BUNDLE, ROWS = 8 << 20, 1 << 19
MESSAGE = "bundle long, kind int, shard int, a binary, b binary, c binary, d binary"
MESSAGE_TYPE = pa.schema([("bundle", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), *[(c, pa.binary()) for c in "abcd"]])
TEXT = -1  # the kind of rows that hold a text


class Texts:
    """The texts of a bundle, in their order."""

    def __init__(self, bundle: int, ids: pa.Array, flags: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.bundle, self.ids, self.flags, self.data, self.offsets = bundle, ids, flags, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, rows: pa.Table) -> Texts:
        """From the rows of a bundle as they come out of a shuffle."""
        order = pa.array(np.argsort(rows["place"].to_numpy()))
        ids, flags, texts = (whole(rows[c]).take(order) for c in ("id", "flag", "text"))
        return cls(rows["bundle"][0].as_py(), ids, flags.to_numpy(zero_copy_only=False).astype(bool), *utf8(texts))


def whole(x: pa.ChunkedArray) -> pa.Array:
    x = x.combine_chunks()
    return x if isinstance(x, pa.Array) else x.chunk(0)


def bundled(docs: DataFrame, id_col: str, text_col: str, ask: Callable[[Texts], list[dict]], flag: Column | None = None, *, tag: str, most: int = BUNDLE, by_id: bool = False) -> tuple[DataFrame, DataFrame]:
    """((bundle, place, id, flag, text), the bundles' messages); a null text counts as empty. ``by_id``: a bundle's texts are in the order of
    their ids, null last."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), (F.lit(True) if flag is None else flag).alias("flag"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size, count = TaskContext.get().partitionId(), 0, [], 0, 0

        def out() -> Iterator[pa.RecordBatch]:
            ids, texts, flags = (pa.concat_arrays(x) for x in zip(*held, strict=True))
            if by_id:
                order = pc.sort_indices(ids, null_placement="at_end")
                ids, texts, flags = ids.take(order), texts.take(order), flags.take(order)
            n, bundle = len(ids), (part << 32) + k
            own = {"bundle": pa.array(np.full(n, bundle)), "kind": pa.array(np.full(n, TEXT, np.int32)), "place": pa.array(np.arange(n, dtype=np.int32)), "id": ids, "flag": flags, "text": texts}
            yield from aligned(pa.table(own), ids.type)
            yield from aligned(messages(ask(Texts(bundle, ids, flags.to_numpy(zero_copy_only=False).astype(bool), *utf8(texts)))), ids.type)

        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for a, b in chunks(offsets, most):
                n = int(offsets[b] - offsets[a])
                if held and (size + n > most or count + b - a > ROWS):
                    yield from out()
                    k, held, size, count = k + 1, [], 0, 0
                held.append([c.slice(a, b - a) for c in batch.columns])
                size, count = size + n, count + b - a
        if held:
            yield from out()

    def aligned(rows: pa.Table, kind: pa.DataType) -> list[pa.RecordBatch]:
        schema = pa.schema([*MESSAGE_TYPE, ("place", pa.int32()), ("id", kind), ("flag", pa.bool_()), ("text", pa.binary())])
        return pa.table({f.name: rows[f.name] if f.name in rows.column_names else pa.nulls(rows.num_rows, f.type) for f in schema}, schema).to_batches()

    written = materialise(rows.mapInArrow(run, f"{MESSAGE}, place int, id {kind}, flag boolean, text binary"), tag, partition_by="kind", compression="zstd")
    texts = written.filter(F.col("kind") == TEXT).select("bundle", "place", "id", "flag", "text")
    asked = written.filter(F.col("kind") != TEXT).select(*MESSAGE_TYPE.names)
    asked._shared_path = written._shared_path
    return texts, asked


def planes(x: np.ndarray) -> bytes:
    """Numbers by byte planes, which compress better on their way."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def numbers(data: bytes | pa.Buffer, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    """The numbers of all rows' planes, end to end."""
    return np.concatenate([np.zeros(0, kind), *(numbers(x.as_buffer(), kind) for x in table[name])])


def messages(found: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(found, MESSAGE_TYPE)


def kind_of(table: pa.Table, kind: int) -> pa.Table:
    """The messages of a kind, in the order of their shards."""
    return table.filter(pc.equal(table["kind"], kind)).sort_by("shard") if table.num_rows else table


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, sizes) of the runs of equal numbers."""
    cut = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return cut, np.diff(np.append(cut, len(x)))
