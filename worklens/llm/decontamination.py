"""Benchmark decontamination: exact pieces by pigeonhole, verified by bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from worklens.llm.common import slices

_BLANKS = {c: " " for c in range(0x09, 0x0E)}


def folded(text: str) -> str:
    """Lower case, every white space a blank; positions stay those of the text."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.translate(_BLANKS)


def substring_distance(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to a substring of the text, and where the first such substring ends.

    Myers' bit-parallel recurrence: one column of the edit matrix is two integers
    of vertical differences.
    """
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        equal = masks.get(c, 0)
        vertical = equal | minus
        horizontal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def located(pattern: str, text: str) -> tuple[int, int, int]:
    """Least distance with start and end of the shortest best substring that ends first."""
    distance, end = substring_distance(pattern, text)
    _, back = substring_distance(pattern[::-1], text[:end][::-1])
    return distance, end - back, end


@dataclass(frozen=True)
class Segment:
    """Some consecutive pieces of an item; an occurrence within the item's budget has one of them within ``budget``."""

    start: int
    stop: int
    budget: int


def segments(length: int, budget: int) -> list[list[Segment]]:
    """For each of the ``budget + 1`` pieces: itself and the segments around it, up to the whole item.

    Two neighbouring segments of a and b pieces hold a - 1 and b - 1 errors at most, or
    together more than a + b - 1; so an occurrence shows in an exact piece whose chain of
    enclosing segments all stay within budget.
    """
    cuts = [i * length // (budget + 1) for i in range(budget + 2)]
    chains: list[list[Segment]] = [[] for _ in range(budget + 1)]

    def split(first: int, last: int) -> None:
        own = Segment(cuts[first], cuts[last], last - first - 1)
        if last - first > 1:
            middle = (first + last) // 2
            split(first, middle)
            split(middle, last)
        for piece in range(first, last):
            chains[piece].append(own)

    split(0, budget + 1)
    return chains


class PieceIndex:
    """Pieces of all items in one automaton."""

    def __init__(self, items: Sequence[tuple[object, str]], error_rate: float):
        self.items: list[tuple[object, str, int, list[list[Segment]]]] = []
        places: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            plain = folded(text).strip()
            if not plain:
                continue
            budget = min(int(len(plain) * error_rate), len(plain) - 1)
            chains = segments(len(plain), budget)
            for i, chain in enumerate(chains):
                places.setdefault(plain[chain[0].start : chain[0].stop], []).append((len(self.items), i))
            self.items.append((item_id, plain, budget, chains))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in places.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if places:
            self.automaton.make_automaton()
        self.empty = not places

    def find(self, text: str) -> list[tuple[object, int, int, int]]:
        """(item, start, end, distance) of the occurrences in a text, overlapping ones of an item as the best."""
        if self.empty or not text:
            return []
        plain = folded(text)
        hits: list[tuple[int, int, int, int]] = []
        done: dict[int, int] = {}
        failed: set[tuple[int, int]] = set()
        for last, (size, owners) in self.automaton.iter(plain):
            start = last + 1 - size
            for k, i in owners:
                _, item, budget, chains = self.items[k]
                chain = chains[i]
                origin = start - chain[0].start
                # Inside an occurrence that was found already, or where the same alignment failed as a whole.
                if last < done.get(k, -1) or (k, origin) in failed:
                    continue
                if origin >= 0 and plain.startswith(item, origin):
                    hits.append((k, origin, origin + len(item), 0))
                    done[k] = origin + len(item)
                    continue
                for part in chain[1:]:
                    low = max(0, origin + part.start - part.budget)
                    window = plain[low : origin + part.stop + part.budget]
                    if part is not chain[-1]:
                        if substring_distance(item[part.start : part.stop], window)[0] > part.budget:
                            break
                        continue
                    distance, begin, end = located(item, window)
                    if distance > budget:
                        failed.add((k, origin))
                        break
                    hits.append((k, low + begin, low + end, distance))
                    done[k] = low + end
        return self._merged(hits)

    def _merged(self, hits: list[tuple[int, int, int, int]]) -> list[tuple[object, int, int, int]]:
        out: list[tuple[int, int, int, int]] = []
        for k, start, end, distance in sorted(hits):
            if out and out[-1][0] == k and start < out[-1][2]:
                if distance < out[-1][3]:
                    out[-1] = (k, start, end, distance)
                continue
            out.append((k, start, end, distance))
        return [(self.items[k][0], start, end, distance) for k, start, end, distance in out]


def item_batches(items: DataFrame, item_id: str, text: str, batch_bytes: int) -> list[list[tuple[object, str]]]:
    """The test items in lists of about ``batch_bytes`` at most, each small enough to be sent to every worker."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter(F.length(F.trim("t")) > 0)
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    n = int(-(-total // batch_bytes))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(max(1, n)))
    return [[tuple(r) for r in rows.filter(part == p).collect()] for p in range(n)]


def benchmark_hits(
    docs: DataFrame,
    items: DataFrame,
    error_rate: float = 1 / 16,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    batch_bytes: int = 8 << 20,
) -> DataFrame:
    """Where documents hold test items: (doc_id, item_id, start, end, distance).

    An item occurs where a substring of the document is within ``error_rate`` of the
    item's characters in edit distance, both in lower case and with white space as
    blanks; start and end are character positions in the document. Of overlapping
    occurrences of an item the best is given, else all. Null and blank items occur
    nowhere, null and empty documents hold nothing; repeated documents and items give
    repeated rows. Other columns are not looked at. Whole texts are searched.

    Items go to the workers in lists of ``batch_bytes``; a longer benchmark takes more
    passes over the documents. No document is shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    item_kind = items.select(F.col(item_id).alias("item_id")).schema["item_id"]
    schema = T.StructType(
        [rows.schema["doc_id"], item_kind, *(T.StructField(c, T.LongType()) for c in ("start", "end", "distance"))]
    )

    def hits_of(batch_items: list[tuple[object, str]]) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = PieceIndex(batch_items, error_rate)
            for batch in slices(batches, "text"):
                places, found = [], []
                for place, body in enumerate(batch.column("text").to_pylist()):
                    for hit in index.find(body):
                        places.append(place)
                        found.append(hit)
                ids = batch.column("doc_id").take(pa.array(places, pa.int64()))
                columns = list(zip(*found)) or [()] * 4
                kinds = [_arrow(item_kind.dataType), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(c, kind) for c, kind in zip(columns, kinds))], names=schema.names
                )

        return rows.mapInArrow(search, schema)

    found = [hits_of(b) for b in item_batches(items, item_id, text, batch_bytes)]
    if not found:
        return docs.sparkSession.createDataFrame([], schema)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    error_rate: float = 1 / 16,
    item_id: str = "item_id",
    text: str = "text",
    batch_bytes: int = 8 << 20,
) -> DataFrame:
    """The documents that hold no test item, with all their columns; those with a null text stay."""
    out = docs
    for listed in item_batches(items, item_id, text, batch_bytes):
        out = out.mapInArrow(_without(listed, error_rate, text), docs.schema)
    return out


def _without(listed: list[tuple[object, str]], error_rate: float, text: str):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = PieceIndex(listed, error_rate)
        for batch in slices(batches, text):
            bodies = batch.column(batch.schema.get_field_index(text)).to_pylist()
            clean = np.fromiter((not index.find(b) for b in bodies), dtype=bool, count=len(bodies))
            yield batch.filter(pa.array(clean))

    return keep
