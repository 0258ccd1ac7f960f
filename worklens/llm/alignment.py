"""Alignment of two tokenizers over a corpus, scored through an inverted index of bitmaps.

Where tokens of A and B cover a common byte they are linked. For every id pair an inverted
posting holds a bitmap of the documents that link it (places in an array where few, bits
where many) and bit planes of how often they do. Bitmaps of the parts of a block are OR-merged;
their population counts are the document counts, those of the planes the link counts. The
counts of all blocks are added in two levels, the best pairs of each B id are marked, and the
postings carry the scores back to their documents.

Ids of A are those of ``" " + text``, ids of B those of the text, which its model prefixes itself;
strings of special tokens are ordinary text. Null and empty texts, and texts that the tokens of A or
B do not spell exactly, have no tokens. Texts are never cut; rows are told apart by place, so null or
repeated ids are fine, and the columns kept travel in a struct, whatever their names.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from worklens.llm.blobs import pack_counts, pack_keys, unpack_counts, unpack_keys
from worklens.llm.common import mixed, slices
from worklens.llm.piece_bpe import taken
from worklens.session import new_shared_path, written

#: A block of documents shares one set of postings: so much text or so many rows at most, read in slices.
BLOCK_BYTES, BLOCK_ROWS, SLICE_BYTES = 24 << 20, 1 << 16, 1 << 20
#: More documents than this in a block have their places as bits.
DENSE = BLOCK_ROWS // 16
#: Groups of B ids; their pairs, bounded by the two vocabularies, are counted together.
BUCKETS = 32
#: Blocks whose counts are added, or whose postings are scored, by one task.
TOGETHER = 64
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


class Alignment(NamedTuple):
    """documents: the chosen columns, counts, n_best and count_sum; pairs: a, b, links, documents, best."""

    documents: DataFrame
    pairs: DataFrame


class Tokenizers:
    """Both tokenizers with the bytes of their ids."""

    def __init__(self, json_a: str, proto_b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(json_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=proto_b)
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in printable}
        byte_of.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))})
        size = self.a.get_vocab_size(with_added_tokens=True)
        shown_a = [bytes(byte_of.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(size)]
        shown_b = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            shown_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.size_b = len(shown_b)
        self.bytes_a, self.offsets_a = _flat(shown_a)
        self.bytes_b, self.offsets_b = _flat(shown_b)
        # Decimal ids, each followed by one of the three separators.
        self.names, self.name_offsets = _flat([f"{i}{s}".encode() for i in range(max(size, self.size_b)) for s in ",|;"])

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids of A and B with their offsets."""
        a = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        return *_flat_ids(a), *_flat_ids(self.b.encode(texts, num_threads=1))


def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))


def _flat_ids(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))
    return np.fromiter((i for r in rows for i in r), np.int64, count=offsets[-1]), offsets


@lru_cache(maxsize=1)
def tokenizers_of(json_a: str, proto_b: bytes) -> Tokenizers:
    """Both tokenizers, built once in every worker."""
    return Tokenizers(json_a, proto_b)


def _spelt(data: np.ndarray, ends: np.ndarray, bounds: np.ndarray, want: np.ndarray, want_bounds: np.ndarray) -> np.ndarray:
    """Whether the tokens of each text spell exactly its bytes."""
    good = np.diff(ends[bounds]) == np.diff(want_bounds)
    rows = np.flatnonzero(good)
    mine, cuts = taken(data, ends[bounds], rows)
    its, _ = taken(want, want_bounds, rows)
    wrong = np.flatnonzero(mine != its)
    good[rows[np.unique(np.searchsorted(cuts, wrong, side="right") - 1)]] = False
    return good


class Links:
    """Groups and links of a list of texts."""

    def __init__(self, tok: Tokenizers, texts: list[str | None]):
        n = len(texts)
        rows = np.array([i for i, t in enumerate(texts) if t], dtype=np.int64)
        asked = [texts[i] for i in rows.tolist()]
        ids_a, off_a, ids_b, off_b = tok.ids(asked)
        want, want_bounds = _flat([f" {t}".encode() for t in asked])
        data_a, ends_a = taken(tok.bytes_a, tok.offsets_a, ids_a)
        data_b, ends_b = taken(tok.bytes_b, tok.offsets_b, ids_b)
        good = _spelt(data_a, ends_a, off_a, want, want_bounds) & _spelt(data_b, ends_b, off_b, want, want_bounds)
        kept = np.flatnonzero(good)
        a, bounds_a = taken(ids_a, off_a, kept)
        b, bounds_b = taken(ids_b, off_b, kept)
        self.counts = np.zeros((4, n), dtype=np.int64)
        rows = rows[kept]
        self.counts[0, rows], self.counts[1, rows] = np.diff(bounds_a), np.diff(bounds_b)

        # Tokens of both lie end to end over the same bytes, so ends can be compared across all texts.
        end_a, end_b = np.cumsum(np.diff(tok.offsets_a)[a]), np.cumsum(np.diff(tok.offsets_b)[b])
        total = int(end_a[-1]) if len(end_a) else 0
        is_a, is_b = np.zeros(total + 1, dtype=bool), np.zeros(total + 1, dtype=bool)
        is_a[end_a], is_b[end_b] = True, True
        cuts, common = np.flatnonzero(is_a | is_b), is_a & is_b
        self.a = a[np.cumsum(is_a)[cuts] - is_a[cuts]]
        self.b = b[np.cumsum(is_b)[cuts] - is_b[cuts]]
        text_ends = end_a[bounds_a[1:] - 1] if len(kept) else np.zeros(0, np.int64)
        place = np.searchsorted(text_ends, cuts)
        self.row = rows[place]
        self.counts[3] = np.bincount(self.row, minlength=n)
        self.counts[2] = np.bincount(rows[np.searchsorted(text_ends, np.flatnonzero(common))], minlength=n)

        group = np.cumsum(common)
        group_a, group_b = group[end_a] - common[end_a], group[end_b] - common[end_b]
        spot_a = np.arange(len(a)) + np.searchsorted(group_b, group_a, side="left")
        spot_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        name = np.empty(len(a) + len(b), dtype=np.int64)
        name[spot_a] = a * 3 + (np.diff(group_a, append=-1) != 0)
        name[spot_b] = b * 3 + 2 * (np.diff(group_b, append=-1) != 0)
        data, ends = taken(tok.names, tok.name_offsets, name)
        last = ends[(bounds_a + bounds_b)[1:]] - 1
        written_out = np.ones(len(data), dtype=bool)
        written_out[last] = False
        sizes = np.zeros(n, dtype=np.int64)
        sizes[rows] = np.diff(ends[bounds_a + bounds_b]) - 1
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.groups = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(data[written_out].copy())).cast(pa.string())


# --- postings


def posting(a: np.ndarray, b: np.ndarray, place: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (pair, place) codes of links, and how often each occurs."""
    pair = a.astype(np.uint64) * np.uint64(size_b) + b.astype(np.uint64)
    return np.unique(pair << np.uint64(16) | place.astype(np.uint64), return_counts=True)


def or_merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The postings of several parts of a block as one: bitmaps united, multiplicities added."""
    codes = np.concatenate([c for c, _ in parts])
    order = np.argsort(codes, kind="stable")
    codes, times = codes[order], np.concatenate([m for _, m in parts])[order]
    starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(times, starts) if len(starts) else times


def packed(codes: np.ndarray, times: np.ndarray) -> dict[str, bytes]:
    """Postings as compressed bitmaps and planes: pairs, their document counts, places, bits of multiplicities."""
    pair, place = codes >> np.uint64(16), (codes & np.uint64(0xFFFF)).astype("<u2")
    starts = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    sizes = np.diff(np.append(starts, len(pair)))
    many = sizes > DENSE
    maps = []
    for start, size in zip(starts[many].tolist(), sizes[many].tolist()):
        bits = np.zeros(BLOCK_ROWS, dtype=np.uint8)
        bits[place[start : start + size]] = 1
        maps.append(np.packbits(bits).tobytes())
    few = place[np.repeat(~many, sizes)]
    planes = [np.packbits((times >> k & 1).astype(np.uint8)).tobytes() for k in range(max(1, int(times.max()).bit_length()))]
    squeeze = {"codec": "zstd", "asbytes": True}
    return {
        "pairs": pack_keys(pair[starts], 32),
        "documents": pack_counts(sizes),
        "places": _sized(few.tobytes(), squeeze),
        "maps": _sized(b"".join(maps), squeeze),
        "planes": len(planes).to_bytes(1, "little") + _sized(b"".join(planes), squeeze),
    }


def _sized(data: bytes, squeeze: dict) -> bytes:
    return len(data).to_bytes(8, "little") + (pa.compress(data, **squeeze) if data else b"")


def _unsized(blob: bytes) -> bytes:
    size = int.from_bytes(blob[:8], "little")
    return pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def planes_of(blob: bytes, n: int) -> list[np.ndarray]:
    """The bits of each plane of multiplicities."""
    count, data = blob[0], np.frombuffer(_unsized(blob[1:]), np.uint8)
    return [np.unpackbits(part, count=n) for part in data.reshape(count, -1)]


def link_counts(sizes: np.ndarray, planes: list[np.ndarray]) -> np.ndarray:
    """Links of every pair: the population counts of its part of each plane, weighted."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return sum(np.add.reduceat(bits.astype(np.int64), starts) << k for k, bits in enumerate(planes))


def places_of(sizes: np.ndarray, places: bytes, maps: bytes) -> np.ndarray:
    """Places of the documents of all pairs, in the order of the pairs."""
    many = np.repeat(sizes > DENSE, sizes)
    out = np.empty(len(many), dtype=np.int64)
    out[~many] = np.frombuffer(_unsized(places), "<u2")
    bits = np.frombuffer(_unsized(maps), np.uint8).reshape(-1, BLOCK_ROWS // 8)
    if len(bits):
        out[many] = np.concatenate([np.flatnonzero(np.unpackbits(row)) for row in bits])
    return out


def _bucket(b: np.ndarray) -> np.ndarray:
    return mixed(b.astype(np.uint64)) % np.uint64(BUCKETS)


POSTING = "bucket int, pairs binary, documents binary, places binary, maps binary, planes binary"
COUNTED = "bucket int, pairs binary, documents binary, links binary"


def _aligned(batches: Iterator[pa.RecordBatch], tok: Tokenizers, row_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Rows of documents with their groups, and after each block the rows of its postings."""
    context = TaskContext.get()
    number, place, held, parts = (context.partitionId() if context else 0) << 32, 0, 0, []
    blobs = POSTING.replace(" binary", "").replace(" int", "").split(", ")[1:]
    names = ["block", "place", "row", *COUNTS, "groups", "bucket", *blobs]
    kinds = [pa.int64(), pa.int32(), row_type, *[pa.int64()] * 4, pa.string(), pa.int32(), *[pa.binary()] * len(blobs)]

    def table(n: int, columns: dict) -> pa.RecordBatch:
        arrays = [columns[c] if c in columns else pa.nulls(n, kind) for c, kind in zip(names, kinds)]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def close() -> Iterator[pa.RecordBatch]:
        codes, times = or_merged(parts)
        bucket = _bucket((codes >> np.uint64(16)) % np.uint64(tok.size_b))
        for k in range(BUCKETS):
            mine = bucket == k
            if mine.any():
                blob = packed(codes[mine], times[mine])
                yield table(1, {"block": pa.array([number]), "bucket": pa.array([k], pa.int32()), **{c: pa.array([blob[c]], pa.binary()) for c in blobs}})

    for batch in slices(batches, "text", SLICE_BYTES, BLOCK_ROWS // 16):
        texts = batch.column("text")
        size, n = pc.sum(pc.binary_length(texts)).as_py() or 0, batch.num_rows
        if parts and (held + size > BLOCK_BYTES or place + n > BLOCK_ROWS):
            yield from close()
            number, place, held, parts = number + 1, 0, 0, []
        links = Links(tok, texts.to_pylist())
        parts.append(posting(links.a, links.b, place + links.row, tok.size_b))
        yield table(
            n,
            {
                "block": pa.array(np.full(n, number)),
                "place": pa.array(np.arange(place, place + n), pa.int32()),
                "row": batch.column("row"),
                **dict(zip(COUNTS, map(pa.array, links.counts))),
                "groups": links.groups,
            },
        )
        place, held = place + n, held + size
    if parts:
        yield from close()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings reduced to the document and link counts of their pairs."""
    for batch in batches:
        links = []
        for documents, planes in zip(batch.column("documents").to_pylist(), batch.column("planes").to_pylist()):
            sizes = unpack_counts(documents)
            links.append(pack_counts(link_counts(sizes, planes_of(planes, int(sizes.sum())))))
        kept = [batch.column(c) for c in ("block", "bucket", "pairs", "documents")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(links, pa.binary())], names=["block", "bucket", "pairs", "documents", "links"])


def _summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs with their document and link counts, added up over the rows of a bucket."""
    pairs = [unpack_keys(p, 32) for p in table.column("pairs").to_pylist()]
    distinct, at = np.unique(np.concatenate(pairs), return_inverse=True)
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(distinct)))
    sums = []
    for column in ("documents", "links"):
        values = np.concatenate([unpack_counts(v) for v in table.column(column).to_pylist()])
        sums.append(np.add.reduceat(values[order], starts))
    return distinct, sums[0], sums[1]


def _part_sums(table: pa.Table) -> pa.Table:
    pairs, documents, links = _summed(table)
    row = {"bucket": [table.column("bucket")[0].as_py()], "pairs": [pack_keys(pairs, 32)], "documents": [pack_counts(documents)], "links": [pack_counts(links)]}
    return pa.table(row, schema=pa.schema([("bucket", pa.int32()), ("pairs", pa.binary()), ("documents", pa.binary()), ("links", pa.binary())]))


def best_of(b: np.ndarray, links: np.ndarray) -> np.ndarray:
    """Whether each pair has the most links of its B id."""
    ids, at = np.unique(b, return_inverse=True)
    most = np.zeros(len(ids), dtype=np.int64)
    np.maximum.at(most, at, links)
    return links == most[at]


def align(
    docs: DataFrame, json_path: str, model_path: str, text: str = "text", keep: list[str] | None = None, columns: list[Column | str] | None = None
) -> Alignment:
    """Groups, links and pair scores of all documents, and the scores of the pairs.

    ``keep`` names the columns of ``docs`` that go along (all, if not given, but those that bear a new name). ``columns`` chooses from them,
    the counts n_a, n_b, n_groups, n_links and the text ``groups`` (``a1,a2|b1;...``; empty without tokens) what
    the result has besides n_best and count_sum, so that large columns need not travel further. The
    vocabularies of ``json_path`` (A, byte-level BPE) and ``model_path`` (B, pieces) go to the workers. Tokens
    are computed and written when this is called; so are the counts.
    """
    made_here = {*COUNTS, "groups", "n_best", "count_sum"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made_here]
    with open(json_path, encoding="utf-8") as a, open(model_path, "rb") as b:
        vocabularies = a.read(), b.read()
    # A struct of no column cannot be, so an unread mark is always in it.
    row = F.struct(F.lit(True).alias("_there"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)])
    source = docs.select(row.alias("row"), F.col(text).cast("string").alias("text"))
    row_type = source.schema["row"].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None
        for batch in batches:
            tok = tok or tokenizers_of(*vocabularies)
            yield from _aligned(_and_rest(batch, batches), tok, batch.schema.field("row").type)

    schema = f"block long, place int, row {row_type}, " + ", ".join(f"{c} long" for c in COUNTS) + f", groups string, {POSTING}"
    made = _written_small(source.mapInArrow(tokens, schema), "alignment")
    postings = made.filter("bucket is not null").select("block", *[f.split()[0] for f in POSTING.split(", ")])
    rows = made.filter("bucket is null")

    counts = postings.select("block", "bucket", "pairs", "documents", "planes").mapInArrow(_counted, f"block long, {COUNTED}")
    blocks = rows.agg(F.count_distinct("block")).first()[0]
    salts = max(1, -(-blocks // TOGETHER))
    salt = F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")
    sums = counts.groupBy("bucket", salt.alias("salt")).applyInArrow(_part_sums, COUNTED)
    if salts > 1:
        sums = sums.groupBy("bucket").applyInArrow(_part_sums, COUNTED)
    sums = written(sums, "pair-counts")

    size_b = _vocabulary_size(vocabularies[1])
    stream = postings.select(salt.alias("salt"), F.lit(1).alias("kind"), "block", "bucket", "pairs", "documents", "places", "maps", "planes").unionByName(
        sums.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "bucket", "pairs", "documents", "links"),
        allowMissingColumns=True,
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the scores of the documents of each posting; the scores of a bucket come before its postings."""
        bucket, pairs, links, best = None, None, None, None
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    bucket, pairs, links = r["bucket"], unpack_keys(r["pairs"], 32), unpack_counts(r["links"])
                    best = best_of(pairs % np.uint64(size_b), links)
                    continue
                if r["bucket"] != bucket:
                    raise RuntimeError("postings without counts")
                sizes = unpack_counts(r["documents"])
                at = np.searchsorted(pairs, unpack_keys(r["pairs"], 32))
                place = places_of(sizes, r["places"], r["maps"])
                times = sum(bits.astype(np.int64) << k for k, bits in enumerate(planes_of(r["planes"], len(place))))
                order = np.argsort(place, kind="stable")
                starts = np.flatnonzero(np.diff(place[order], prepend=-1))
                sums_of = [np.add.reduceat((np.repeat(v[at], sizes) * times)[order], starts) for v in (best.astype(np.int64), links)]
                blob = [pack_keys(place[order][starts].astype(np.uint64), 32), *map(pack_counts, sums_of)]
                arrays = [pa.array([r["block"]]), *[pa.array([b], pa.binary()) for b in blob]]
                yield pa.RecordBatch.from_arrays(arrays, names=["block", "places", "best", "sums"])

    ordered = stream.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")
    returned = ordered.mapInArrow(scored, "block long, places binary, best binary, sums binary")

    def added(table: pa.Table) -> pa.Table:
        """Scores of the documents of one block over all buckets."""
        total = np.zeros((2, BLOCK_ROWS), dtype=np.int64)
        for places, best, sums in zip(*[table.column(c).to_pylist() for c in ("places", "best", "sums")]):
            at = unpack_keys(places, 32).astype(np.int64)
            total[0, at] += unpack_counts(best)
            total[1, at] += unpack_counts(sums)
        at = np.flatnonzero(total[1])
        block = np.full(len(at), table.column("block")[0].as_py())
        return pa.table({"_block": block, "_place": pa.array(at, pa.int32()), "n_best": total[0, at], "count_sum": total[1, at]})

    scores = returned.groupBy("block").applyInArrow(added, "_block long, _place int, n_best long, count_sum long")
    own = [F.col("block").alias("_aligned_block"), F.col("place").alias("_aligned_place")]
    named = rows.select(*own, *[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], *COUNTS, "groups")
    own = ["_aligned_block", "_aligned_place"]
    chosen = named.select(*own, *(columns if columns is not None else [*kept, *COUNTS, "groups"]))
    fields = [c for c in chosen.columns if c not in own]
    result = chosen.join(scores, (F.col(own[0]) == F.col("_block")) & (F.col(own[1]) == F.col("_place")), "left")
    zero = F.lit(0).cast("long")
    documents = result.select(*fields, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
    return Alignment(documents, _pair_rows(sums, size_b))


def _pair_rows(sums: DataFrame, size_b: int) -> DataFrame:
    """One row per id pair."""

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, documents, links in zip(*[batch.column(c).to_pylist() for c in ("pairs", "documents", "links")]):
                keys, counts = unpack_keys(pairs, 32), unpack_counts(links)
                b = (keys % np.uint64(size_b)).astype(np.int32)
                columns = [(keys // np.uint64(size_b)).astype(np.int32), b, counts, unpack_counts(documents), best_of(b, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "links", "documents", "best"])

    return sums.mapInArrow(shown, "a int, b int, links long, documents long, best boolean")


def _and_rest(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _vocabulary_size(proto: bytes) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto).vocab_size()


def _written_small(df: DataFrame, name: str) -> DataFrame:
    """As ``written``, with the slower codec that keeps long group texts small."""
    path = new_shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
