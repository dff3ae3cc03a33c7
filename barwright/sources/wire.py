"""Wire formats: FIX tag=value text, length-prefixed binary frames, and raw JSON records with checksums."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOH = "\x01"
#: A frame's payload: event id, symbol, quantity, price; big-endian.
FRAME = ">qqid"
FRAME_SCHEMA = "stream long, position int, event_id long, symbol long, k int, value double, rest long"


def checksum(body: Column) -> Column:
    """FIX checksum: sum of the characters' codes modulo 256 (ASCII messages)."""
    return F.aggregate(F.transform(F.split(body, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x) % 256


def parse_fix(raw: Column) -> Column:
    """map of tags to values; of a repeated tag the last."""
    pairs = F.filter(F.split(raw, SOH), lambda x: F.contains(x, F.lit("=")))
    keys, values = F.transform(pairs, lambda x: F.split_part(x, F.lit("="), F.lit(1))), F.transform(pairs, lambda x: F.regexp_replace(x, "^[^=]*=", ""))
    return F.map_from_arrays(keys, values)


def read_frames(streams: DataFrame) -> DataFrame:
    """Frames of (stream, body binary), each a two-byte length and a payload; ``rest`` counts bytes of a cut-off tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, at, n = body.as_py() or b"", 0, 0
                while at + 2 <= len(raw):
                    size = int.from_bytes(raw[at : at + 2], "big")
                    if at + 2 + size > len(raw) or size != struct.calcsize(FRAME):
                        break
                    event, symbol, k, value = struct.unpack_from(FRAME, raw, at + 2)
                    rows.append((name, n, event, symbol, k, value, None))
                    at, n = at + 2 + size, n + 1
                if at < len(raw):
                    rows.append((name, n, None, None, None, None, len(raw) - at))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int64()]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [f.split(" ")[0] for f in FRAME_SCHEMA.split(", ")])

    return streams.mapInArrow(run, FRAME_SCHEMA)


def write_frames(rows: DataFrame, stream: str, order: str) -> DataFrame:
    """(stream, body) of rows (event_id, symbol, k, value), one body per stream and day so that none grows without end."""

    def run(key, table):
        table = table.sort_by(order)
        cols = [table.column(c).to_pylist() for c in ("event_id", "symbol", "k", "value")]
        head = struct.calcsize(FRAME).to_bytes(2, "big")
        body = b"".join(head + struct.pack(FRAME, *r) for r in zip(*cols))
        return pa.table({"stream": pa.array([key[0].as_py()], pa.int64()), "body": pa.array([body], pa.binary())})

    return rows.groupBy(stream, "day").applyInArrow(run, "stream long, body binary")
