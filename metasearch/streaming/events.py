"""Raw event buffers of the kernel as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: The version of the event format, sizes of its parts, event bits, and the role of a location by its type.
VERSION, HEADER, INFO, HANDLE_AT = 3, 24, 4, 12
BITS = {
    0x4: "ATTRIB", 0x8: "CLOSE_WRITE", 0x40: "MOVED_FROM", 0x80: "MOVED_TO", 0x100: "CREATE", 0x200: "DELETE", 0x4000: "Q_OVERFLOW",
    0x10000000: "RENAME", 0x40000000: "ONDIR",
}
ROLES = {1: "Object", 2: "Current", 3: "Current", 10: "Old", 12: "New"}
NAMELESS = (1, 3)


def events(buffer: bytes) -> list[dict]:
    """One row for each location of each event (one without a role if there is none): mask, role, handle, name. Damage raises."""
    found, at = [], 0
    while at < len(buffer):
        if len(buffer) - at < HEADER:
            raise ValueError("a cut event")
        size, version, _, header, mask = struct.unpack_from("<IBBHQ", buffer, at)
        if version != VERSION or header < HEADER or size < header or at + size > len(buffer):
            raise ValueError("an invalid event")
        bits, places, end, info = [name for bit, name in BITS.items() if mask & bit], [], at + size, at + header
        while info < end:
            if end - info < INFO:
                raise ValueError("a cut location")
            kind, _, length = struct.unpack_from("<BBH", buffer, info)
            if length < INFO or info + length > end:
                raise ValueError("an invalid location")
            if kind in ROLES:
                places.append({"mask": bits, "role": ROLES[kind], **location(buffer[info : info + length], kind not in NAMELESS)})
            info += length
        found += places or [{"mask": bits, "role": None, "handle": None, "name": None}]
        at = end
    return found


def location(data: bytes, named: bool) -> dict:
    if len(data) < HANDLE_AT + 8:
        raise ValueError("a cut handle")
    end = HANDLE_AT + 8 + struct.unpack_from("<I", data, HANDLE_AT)[0]
    if end > len(data):
        raise ValueError("a handle beyond its location")
    name = None
    if named:
        text, nul, _ = data[end:].partition(b"\0")
        if not nul:
            raise ValueError("a name without end")
        name = text.decode("utf-8", "replace")
    return {"handle": data[HANDLE_AT:end], "name": name}


def parse(buffers: DataFrame) -> DataFrame:
    """(seq, mask, role, handle, name) from (seq, data): one kernel read a row."""
    schema = pa.schema([("seq", pa.int64()), ("mask", pa.list_(pa.string())), ("role", pa.string()), ("handle", pa.binary()), ("name", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"seq": s, **e} for s, d in zip(batch.column("seq").to_pylist(), batch.column("data").to_pylist(), strict=True) for e in events(d)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return buffers.select("seq", "data").mapInArrow(run, "seq bigint, mask array<string>, role string, handle binary, name string")
