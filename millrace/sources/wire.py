"""Event records in the protocol-buffer wire format, plain or compressed.

Fields are numbered in column order from 1: integers and booleans as varints
(zigzag), doubles as 64-bit values, text and bytes length-delimited.  NULL is
an absent field.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _varint(n: int) -> bytes:
    out = bytearray()
    while True:
        b = n & 0x7F
        n >>= 7
        if n:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 0x7F) << shift
        if not b & 0x80:
            return value, at
        shift += 7


def encode_record(values: list) -> bytes:
    out = []
    for number, v in enumerate(values, 1):
        if v is None:
            continue
        if isinstance(v, bool) or isinstance(v, int):
            n = int(v)
            out.append(_varint(number << 3) + _varint((n << 1) ^ (n >> 63)))
        elif isinstance(v, float):
            out.append(_varint(number << 3 | 1) + struct.pack("<d", v))
        else:
            raw = v.encode() if isinstance(v, str) else bytes(v)
            out.append(_varint(number << 3 | 2) + _varint(len(raw)) + raw)
    return b"".join(out)


def decode_record(data: bytes) -> dict[int, object]:
    out: dict[int, object] = {}
    at = 0
    while at < len(data):
        tag, at = _read_varint(data, at)
        number, kind = tag >> 3, tag & 7
        if kind == 0:
            n, at = _read_varint(data, at)
            out[number] = (n >> 1) ^ -(n & 1)
        elif kind == 1:
            out[number] = struct.unpack_from("<d", data, at)[0]
            at += 8
        elif kind == 2:
            size, at = _read_varint(data, at)
            out[number] = data[at : at + size]
            at += size
        else:
            raise ValueError(f"unknown wire type {kind}")
    return out


def encode(df: DataFrame, compressed: bool = False, name: str = "event") -> DataFrame:
    """One binary column with the record of each row."""

    def run(batches):
        for pdf in batches:
            rows = pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None)
            data = [encode_record([x.item() if hasattr(x, "item") else x for x in r]) for r in rows]
            yield pd.DataFrame({name: [zlib.compress(d) if compressed else d for d in data]})

    return df.mapInPandas(run, T.StructType([T.StructField(name, T.BinaryType())]))


def decode(df: DataFrame, column: str, schema: T.StructType, compressed: bool = False) -> DataFrame:
    """The rows of a binary column."""
    fields = schema.fields

    def value(raw, kind):
        if raw is None:
            return None
        if isinstance(kind, T.StringType):
            return raw.decode()
        if isinstance(kind, T.BooleanType):
            return bool(raw)
        return raw

    def run(batches):
        for pdf in batches:
            rows = [decode_record(zlib.decompress(d) if compressed else bytes(d)) for d in pdf[column] if d is not None]
            yield pd.DataFrame({f.name: pd.Series([value(r.get(i), f.dataType) for r in rows], dtype=object) for i, f in enumerate(fields, 1)})

    return df.select(column).mapInPandas(run, schema)

