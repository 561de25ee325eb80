"""Rows as named MessagePack maps, and back."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Fixed values of the format: the first byte of a value by kind and size, smallest sizes first.
_SIZED = {"str": ((31, 0xA0), (0xFF, 0xD9), (0xFFFF, 0xDA), (0xFFFFFFFF, 0xDB)), "bin": ((0xFF, 0xC4), (0xFFFF, 0xC5), (0xFFFFFFFF, 0xC6)), "list": ((15, 0x90), (0xFFFF, 0xDC), (0xFFFFFFFF, 0xDD)), "map": ((15, 0x80), (0xFFFF, 0xDE), (0xFFFFFFFF, 0xDF))}
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_LENGTHS = {0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}


def _head(kind: str, size: int) -> bytes:
    for most, code in _SIZED[kind]:
        if size <= most:
            return bytes([code | size]) if most < 32 else bytes([code]) + size.to_bytes(most.bit_length() // 8, "big")
    raise ValueError(f"a {kind} of {size} is too large")


def pack(value) -> bytes:
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        if -32 <= value < 128:
            return struct.pack(">b", value)
        codes = (0xCC, 0xCD, 0xCE, 0xCF) if value >= 0 else (0xD0, 0xD1, 0xD2, 0xD3)
        for code in codes:
            try:
                return bytes([code]) + struct.pack(_NUMBERS[code], value)
            except struct.error:
                continue
        raise ValueError(f"{value} has more than 64 bits")
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode("utf-8", "surrogatepass")
        return _head("str", len(raw)) + raw
    if isinstance(value, bytes):
        return _head("bin", len(value)) + value
    if isinstance(value, dict):
        return _head("map", len(value)) + b"".join(pack(x) for item in value.items() for x in item)
    if isinstance(value, list | tuple):
        return _head("list", len(value)) + b"".join(map(pack, value))
    raise TypeError(f"{type(value).__name__} has no MessagePack form here")


def unpack(data: bytes):
    """The one value that ``data`` holds; ValueError if it is cut off, holds more, or has an unknown kind."""
    value, end = _value(data, 0)
    if end != len(data):
        raise ValueError(f"{len(data) - end} bytes after the value")
    return value


def _take(data: bytes, at: int, size: int) -> bytes:
    if at + size > len(data):
        raise ValueError("the value is cut off")
    return data[at : at + size]


def _value(data: bytes, at: int):
    code = _take(data, at, 1)[0]
    at += 1
    if code < 0x80 or code >= 0xE0:
        return code - (256 if code >= 0xE0 else 0), at
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
    if code in _NUMBERS:
        size = struct.calcsize(_NUMBERS[code])
        return struct.unpack(_NUMBERS[code], _take(data, at, size))[0], at + size
    if code in _LENGTHS:
        kind, form = _LENGTHS[code]
        size = struct.calcsize(form)
        n, at = struct.unpack(form, _take(data, at, size))[0], at + size
    elif code < 0xC0:
        kind, n = ("map", code & 15) if code < 0x90 else ("list", code & 15) if code < 0xA0 else ("str", code & 31)
    else:
        raise ValueError(f"kind {code:#x} isn't known here")
    if kind in ("str", "bin"):
        raw = _take(data, at, n)
        return (raw.decode("utf-8", "surrogatepass") if kind == "str" else raw), at + n
    found = []
    for _ in range(n * (2 if kind == "map" else 1)):
        x, at = _value(data, at)
        found.append(x)
    return (dict(zip(found[::2], found[1::2], strict=True)) if kind == "map" else found), at


def to_msgpack(df: DataFrame) -> DataFrame:
    """One column ``value`` with each row as a map by column name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack(r) for r in batch.to_pylist()], pa.binary())], ["value"])

    return df.mapInArrow(run, "value binary")


def from_msgpack(df: DataFrame, schema: T.StructType, value_col: str = "value") -> DataFrame:
    """Rows of a schema; columns that a map lacks are null, others that it has are ignored."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([unpack(v) for v in batch.column(0).to_pylist()], arrow)

    return df.select(value_col).filter(f"`{value_col}` is not null").mapInArrow(run, schema)
