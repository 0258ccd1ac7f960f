"""Sorted fingerprints and counts of a block of documents, packed for the shuffle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KEY_BITS = 56


def _planes(values: np.ndarray, width: int) -> bytes:
    wide = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(wide[:, :width].T).tobytes()


def _from_planes(blob: bytes, width: int) -> np.ndarray:
    n = len(blob) // width
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :width] = np.frombuffer(blob, np.uint8).reshape(width, n).T
    return wide.reshape(-1).view("<u8").astype(np.uint64)


def pack_keys(keys: np.ndarray, bits: int = KEY_BITS) -> bytes:
    """Sorted keys as differences, byte plane by byte plane: the high planes are zeros that compress away."""
    return _planes(np.diff(keys, prepend=np.uint64(0)), bits // 8)


def unpack_keys(blob: bytes, bits: int = KEY_BITS) -> np.ndarray:
    return np.cumsum(_from_planes(blob, bits // 8), dtype=np.uint64)


def pack_counts(values: np.ndarray) -> bytes:
    """Whole numbers, most of them small, in as many byte planes as the largest needs: their number, the width, the planes."""
    wide = values.astype("<u8")
    width = max(1, (int(wide.max(initial=0)).bit_length() + 7) // 8)
    return len(wide).to_bytes(8, "little") + bytes([width]) + pa.compress(_planes(wide, width), codec="zstd", asbytes=True)


def unpack_counts(blob: bytes) -> np.ndarray:
    width = blob[8]
    size = width * int.from_bytes(blob[:8], "little")
    return _from_planes(pa.decompress(blob[9:], decompressed_size=size, codec="zstd", asbytes=True), width).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int, bits: int = KEY_BITS) -> np.ndarray:
    """Which of the equal ranges of the key space holds each key."""
    return ((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)


def ranges(keys: np.ndarray, buckets: int, bits: int = KEY_BITS) -> list[tuple[int, int, int]]:
    """(bucket, start, stop) of the slices of sorted keys that fall into the same range of the key space."""
    place = bucket_of(keys, buckets, bits)
    cuts = np.flatnonzero(np.diff(place)) + 1
    starts = [0, *cuts.tolist()]
    return [(int(place[a]), a, b) for a, b in zip(starts, [*cuts.tolist(), len(keys)]) if a < b]


def bucket_count(docs: DataFrame, text: str, bytes_each: int = 8 << 20) -> int:
    """As many buckets as there are ``bytes_each`` of text, so the keys of a bucket stay bounded."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(32, int(total // bytes_each))
