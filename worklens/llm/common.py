"""Helpers shared by the operators: words and fingerprints of whole texts, held-out rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, functions as F

#: A word is a run of anything but ASCII white space, as in the contracts of the queries.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept."""
    return F.translate(text, UPPER, LOWER)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column bears it, whatever its case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def in_fold(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text leaves the remainder; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus == remainder


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 8 << 20, max_rows: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about ``max_bytes`` of text or one row, and of ``max_rows`` rows at most."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        part = np.cumsum(sizes.to_numpy(zero_copy_only=False)) // max_bytes
        for first in range(0, batch.num_rows, max_rows):
            last = min(first + max_rows, batch.num_rows)
            cuts = [first, *(first + np.flatnonzero(np.diff(part[first:last])) + 1).tolist(), last]
            for start, stop in zip(cuts, cuts[1:]):
                yield batch.slice(start, stop - start)


class Words:
    """The lower-cased words of a batch of texts, as codes into their distinct words.

    ``offsets[i]:offsets[i + 1]`` are the words of row i; null and blank texts have none.
    """

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts, "")
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat, bounds = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
        bounds -= bounds[0]
        full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
        kept = np.concatenate(([0], np.cumsum(full, dtype=np.int64)))
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.distinct: pa.Array = coded.dictionary
        self.codes: np.ndarray = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.offsets: np.ndarray = kept[bounds]

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def fingerprints(strings: pa.Array) -> np.ndarray:
    """64-bit xxHash of each string."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s) for s in strings.to_pylist()), dtype=np.uint64, count=len(strings))


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit integers mixed, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
