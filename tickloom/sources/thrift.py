"""Messages in Thrift's binary protocol: struct {1: list<string> messages; 2: string host; 3: string filename}."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE = T.StructType([T.StructField("messages", T.ArrayType(T.StringType())), T.StructField("host", T.StringType()), T.StructField("filename", T.StringType())])
BOOL, BYTE, DOUBLE, I16, I32, I64, STRING, STRUCT, MAP, SET, LIST = 2, 3, 4, 6, 8, 10, 11, 12, 13, 14, 15
FIXED = {BOOL: 1, BYTE: 1, DOUBLE: 8, I16: 2, I32: 4, I64: 8}

DEPTH = 64


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise ValueError("the message ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str) -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]

    def text(self) -> str:
        return self.take(self.number(">i")).decode()

    def skip(self, kind: int, depth: int = 0) -> None:
        if depth > DEPTH:
            raise ValueError("the message is nested too deep")
        if kind in FIXED:
            self.take(FIXED[kind])
        elif kind == STRING:
            self.take(self.number(">i"))
        elif kind in (LIST, SET):
            inner, n = self.number(">b"), self.number(">i")
            for _ in range(n):
                self.skip(inner, depth + 1)
        elif kind == MAP:
            key, value, n = self.number(">b"), self.number(">b"), self.number(">i")
            for _ in range(n):
                self.skip(key, depth + 1)
                self.skip(value, depth + 1)
        elif kind == STRUCT:
            while inner := self.number(">b"):
                self.number(">h")
                self.skip(inner, depth + 1)
        else:
            raise ValueError(f"no such type: {kind}")


def decode(data: bytes | None) -> dict | None:
    """The message, or None for bytes that are none; fields that aren't known are skipped."""
    if data is None:
        return None
    try:
        r, out = Reader(bytes(data)), {"messages": None, "host": None, "filename": None}
        while kind := r.number(">b"):
            field = r.number(">h")
            if field == 1 and kind == LIST:
                inner, n = r.number(">b"), r.number(">i")
                if inner != STRING or n < 0:
                    return None
                out["messages"] = [r.text() for _ in range(n)]
            elif field in (2, 3) and kind == STRING:
                out["host" if field == 2 else "filename"] = r.text()
            else:
                r.skip(kind)
        return out if out["messages"] is not None else None
    except (ValueError, struct.error):
        return None


def encode(messages: list[str], host: str | None = None, filename: str | None = None) -> bytes:
    def text(x: str) -> bytes:
        return struct.pack(">i", len(x.encode())) + x.encode()

    out = struct.pack(">bhbi", LIST, 1, STRING, len(messages)) + b"".join(map(text, messages))
    for field, value in ((2, host), (3, filename)):
        if value is not None:
            out += struct.pack(">bh", STRING, field) + text(value)
    return out + b"\0"


def _decode(data: pd.Series) -> pd.DataFrame:
    found = [decode(x) or {"messages": None, "host": None, "filename": None} for x in data]
    return pd.DataFrame(found, columns=["messages", "host", "filename"])


def decode_messages(column: Column | str) -> Column:
    """Messages of binary values; of bytes that are none, the messages are null, and the other rows go on."""
    return F.pandas_udf(_decode, MESSAGE)(F.col(column) if isinstance(column, str) else column)
