"""Arrays as compressed binary cells, for exchanges of many small numbers."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays of unsigned integers, byte planes apart, compressed (a higher `level` packs better and slower)."""
    out = [struct.pack("<I", len(arrays))]
    for x in arrays:
        most = int(x.max()) if len(x) else 0
        width = 1 if most < 256 else 2 if most < 65536 else 4 if most < 1 << 32 else 8
        planes = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
        out += [struct.pack("<QI", len(x), width), planes.tobytes()]
    raw = b"".join(out)
    return struct.pack("<Q", len(raw)) + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def unpack(raw: bytes) -> list[np.ndarray]:
    (size,) = struct.unpack_from("<Q", raw)
    data = pa.decompress(raw[8:], size, "zstd", asbytes=True)
    (count,), at, out = struct.unpack_from("<I", data), 4, []
    for _ in range(count):
        n, width = struct.unpack_from("<QI", data, at)
        planes = np.frombuffer(data, np.uint8, n * width, at + 12).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 12 + n * width
    return out


def value(batch: pa.RecordBatch | pa.Table, name: str, i: int) -> bytes:
    return batch.column(batch.schema.get_field_index(name))[i].as_py()
