"""Encoding and decoding with a byte-fallback BPE piece model by vectorised merge rounds.

A block of texts is cut into words, each distinct word is merged once: its symbols
lie in flat arrays, and in every round each word merges all pairs of its best rank,
leftmost first, until no word holds a pair of the vocabulary.

Null and empty texts have the end id only and decode to empty text. Texts are never
cut; a very long one is a block of its own. Repeated rows, null or repeated ids and
extra columns pass through; of the columns only those named ``into`` are replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, types as T

from worklens.llm.common import slices

#: The mark that stands for a space inside pieces.
SPACE = "▁"
#: Rank of a pair that is no piece.
NEVER = np.iinfo(np.int32).max
#: A word of more symbols whose ties need single steps is merged with a heap instead.
LONG_TIES = 256
BLOCK_BYTES = 4 << 20


def taken(flat: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ragged rows asked for, one after the other, and their offsets."""
    sizes = (offsets[1:] - offsets[:-1])[rows]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    index = np.arange(ends[-1]) + np.repeat(offsets[:-1][rows] - ends[:-1], sizes)
    return flat[index], ends


class PieceModel:
    """The tables of a piece model: symbols, mergeable pairs with ranks, bytes of every id."""

    def __init__(self, proto: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(proto)
        norm, trainer = spec.normalizer_spec, spec.trainer_spec
        plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
        if not (plain and norm.escape_whitespaces and trainer.byte_fallback and trainer.model_type == trainer.BPE):
            raise ValueError("only BPE models with byte fallback, a dummy prefix and no normalisation are supported")
        if trainer.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces, or white space as suffix, are not supported")
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size, self.end = model.vocab_size(), model.eos_id()
        pieces = [p.piece for p in spec.pieces]
        normal = {p.piece: i for i, p in enumerate(spec.pieces) if p.type == 1}
        # Characters of pieces that are no piece themselves still take part in merges.
        symbols = dict(normal)
        for char in sorted({c for p in normal for c in p} - set(normal)):
            symbols[char] = len(pieces) + len(symbols) - len(normal)
        self.symbols = len(pieces) + len(symbols) - len(normal)

        scores = np.array([-p.score for p in spec.pieces])
        rank_of = np.unique(scores, return_inverse=True)[1]
        rows = []
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if left is not None and right is not None:
                    rows.append((left * self.symbols + right, rank_of[i], i))
        rows.sort()
        table = np.array(rows, dtype=np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_ranks, self.pair_pieces = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)

        chars = sorted((ord(c), i) for c, i in symbols.items() if len(c) == 1)
        self.chars = np.array([c for c, _ in chars], dtype=np.int64)
        self.char_symbols = np.array([i for _, i in chars], dtype=np.int32)
        long = [[ord(c) for c in p] for p in normal if len(p) > 1]
        self.pairs_alone = np.unique([p[0] << 21 | p[1] for p in long if len(p) == 2])
        self.triples = np.unique([p[i] << 42 | p[i + 1] << 21 | p[i + 2] for p in long for i in range(len(p) - 2)])
        self.inner_space = any(a != SPACE and b == SPACE for p in normal for a, b in zip(p, p[1:]))

        self.byte_ids = np.zeros(256, dtype=np.int32)
        shown = []
        self.is_byte = np.zeros(self.size, dtype=bool)
        for i, p in enumerate(spec.pieces):
            if p.type == 6:
                self.byte_ids[int(p.piece[3:5], 16)] = i
                self.is_byte[i] = True
                shown.append(bytes([int(p.piece[3:5], 16)]))
            else:
                shown.append(b"" if p.type == 3 else b" \xe2\x81\x87 " if p.type == 2 else p.piece.replace(SPACE, " ").encode())
        self.id_bytes = np.frombuffer(b"".join(shown), np.uint8)
        self.id_offsets = np.concatenate(([0], np.cumsum([len(s) for s in shown])))
        self.opens = np.array([p.startswith(SPACE) for p in pieces])

    # --- encoding

    def _looked_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the table, or -1."""
        key = left.astype(np.int64) * self.symbols + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, at, -1)

    def _ranks(self, at: np.ndarray) -> np.ndarray:
        return np.where(at < 0, NEVER, self.pair_ranks[at])

    def _segments(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where symbols can never merge with what stands before: no piece holds the characters around that place."""
        starts = first.copy()
        if len(points) < 2:
            return starts
        pair = points[:-1] << 21 | points[1:]
        crossed = np.isin(pair, self.pairs_alone)
        known = np.isin(points[:-2] << 42 | points[1:-1] << 21 | points[2:], self.triples)
        crossed[1:] |= known
        crossed[:-1] |= known
        starts[1:] |= ~crossed
        return starts

    def merged(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Symbols at the place of their first character, -2 at other places, -1 for characters of no piece.

        ``first`` marks the first character of every word.
        """
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        sym = np.where(self.chars[at] == points, self.char_symbols[at], -1).astype(np.int32)
        out = np.full(len(points), -2, dtype=np.int32)
        pos = np.arange(len(points))
        seg = np.cumsum(self._segments(points, first))
        pair = self._pairs(sym, seg)
        while len(sym):
            rank = self._ranks(pair)
            starts = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1])))
            sizes = np.diff(np.append(starts, len(seg)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < NEVER, sizes)
            if not live.all():
                out[pos[~live]] = sym[~live]
                sym, seg, pos, pair, rank = sym[live], seg[live], pos[live], pair[live], rank[live]
                sizes, best = sizes[best < NEVER], best[best < NEVER]
                if not len(sym):
                    break
            number = np.repeat(np.arange(len(sizes)), sizes)
            chosen = np.flatnonzero(rank == best[number])
            # Of overlapping pairs in a row, the first, the third, and so on.
            place = np.arange(len(chosen))
            run = np.maximum.accumulate(np.where(np.diff(chosen, prepend=-2) != 1, place, 0))
            chosen = chosen[(place - run) % 2 == 0]
            after = self._joined(sym, seg, pair, chosen)
            early = self._early(sym, pair, number, best, chosen, after)
            if early.any():
                # A merge makes a pair that comes before the others, or ties with them: one step at a time there.
                lone = np.concatenate(([True], np.diff(number[chosen]) != 0))
                slow = early & (sizes > LONG_TIES)
                chosen = chosen[(~early[number[chosen]] | lone) & ~slow[number[chosen]]]
                if slow.any():
                    apart = slow[number]
                    for k in np.flatnonzero(slow):
                        self._one_by_one(sym[number == k], pos[number == k], out)
                    kept = ~apart
                    chosen = (np.cumsum(kept) - 1)[chosen]
                    sym, seg, pos, pair = sym[kept], seg[kept], pos[kept], pair[kept]
                    if not len(sym):
                        break
                after = self._joined(sym, seg, pair, chosen)
            gone = np.ones(len(pos), dtype=bool)
            gone[chosen + 1] = False
            sym, seg, pair = after
            pos = pos[gone]
        return out

    def _pairs(self, sym: np.ndarray, seg: np.ndarray) -> np.ndarray:
        """Table places of every symbol with the next one of its segment."""
        pair = np.full(len(sym), -1, dtype=np.int64)
        if len(sym) > 1:
            inside = seg[1:] == seg[:-1]
            pair[:-1][inside] = self._looked_up(sym[:-1][inside], sym[1:][inside])
        return pair

    def _joined(self, sym: np.ndarray, seg: np.ndarray, pair: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, segments and pairs once the chosen pairs are merged."""
        sym = sym.copy()
        sym[chosen] = self.pair_pieces[pair[chosen]]
        kept = np.ones(len(sym), dtype=bool)
        kept[chosen + 1] = False
        sym, seg, pair = sym[kept], seg[kept], pair[kept]
        at = chosen - np.arange(len(chosen))
        touched = np.unique(np.concatenate((at, at[at > 0] - 1)))
        touched = touched[touched < len(sym) - 1]
        inside = seg[touched] == seg[touched + 1]
        pair[touched] = -1
        pair[touched[inside]] = self._looked_up(sym[touched[inside]], sym[touched[inside] + 1])
        if len(pair):
            pair[-1] = -1
        return sym, seg, pair

    def _early(self, sym, pair, number, best, chosen, after) -> np.ndarray:
        """Segments in which merging all chosen pairs at once is not what merging them one by one gives."""
        early = np.zeros(len(best), dtype=bool)
        new_pair = after[2]
        at = chosen - np.arange(len(chosen))
        segment = number[chosen]
        early[segment[self._ranks(new_pair[at]) <= best[segment]]] = True
        left = at > 0
        early[segment[left][self._ranks(new_pair[at[left] - 1]) <= best[segment[left]]]] = True
        # Between two merges, the first new symbol stands beside what the second takes.
        close = np.flatnonzero(np.diff(chosen) == 2)
        close = close[segment[close] == segment[close + 1]]
        between = self._ranks(self._looked_up(self.pair_pieces[pair[chosen[close]]], sym[chosen[close] + 2]))
        early[segment[close][between <= best[segment[close]]]] = True
        return early

    def _one_by_one(self, sym: np.ndarray, pos: np.ndarray, out: np.ndarray) -> None:
        """Merge one segment in single steps, best rank and then leftmost first."""
        symbols, n = sym.tolist(), len(sym)
        after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(pairs: list[tuple[int, int]]) -> None:
            if pairs:
                places = self._looked_up(np.array([symbols[i] for i, _ in pairs]), np.array([symbols[j] for _, j in pairs]))
                for (i, j), at in zip(pairs, places.tolist()):
                    if at >= 0:
                        heapq.heappush(heap, (int(self.pair_ranks[at]), i, symbols[i], symbols[j], int(self.pair_pieces[at])))

        offer([(i, i + 1) for i in range(n - 1)])
        while heap:
            _, i, left, right, piece = heapq.heappop(heap)
            j = after[i]
            if gone[i] or symbols[i] != left or j >= n or symbols[j] != right:
                continue
            symbols[i], gone[j], after[i] = piece, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer([(before[i], i)] * (before[i] >= 0) + [(i, after[i])] * (after[i] < n))
        for i in range(n):
            if not gone[i]:
                out[pos[i]] = symbols[i]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every text, the end id last, and their offsets."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), SPACE, " ")
        empty, space = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
        texts = pc.if_else(pc.equal(texts, empty), empty, pc.binary_join_element_wise(space, texts, empty))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[bounds[0] : bounds[-1]] if buffer else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        is_space = data == 32
        starts = np.zeros(len(data), dtype=bool)
        if not self.inner_space:
            starts[1:] = is_space[1:] & ~is_space[:-1]
        starts[bounds[:-1][np.diff(bounds) > 0]] = True
        starts = np.flatnonzero(starts)
        offsets = np.append(starts, len(data))
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        ids, id_offsets = self._encode_words(words.dictionary)
        flat, ends = taken(ids, id_offsets, words.indices.to_numpy(zero_copy_only=False))
        ends = ends[np.searchsorted(starts, bounds)]
        sizes, n = np.diff(ends), len(texts)
        out = np.full(len(flat) + n, self.end, dtype=np.int32)
        out[np.arange(len(flat)) + np.repeat(np.arange(n), sizes)] = flat
        return out, ends + np.arange(n + 1)

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word, and their offsets."""
        offsets = np.frombuffer(words.buffers()[1], np.int64)[: len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == 32] = ord(SPACE)
        before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        first = np.zeros(len(points), dtype=bool)
        first[before[offsets[:-1]]] = True
        sym = self.merged(points, first)
        # Characters of no piece are written as their bytes.
        char_starts = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        loose = (sym == -1) | (sym >= self.size)
        sizes = np.where(loose, np.diff(char_starts), (sym >= 0).astype(np.int64))
        ends = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.empty(ends[-1], dtype=np.int32)
        whole = (sym >= 0) & ~loose
        ids[ends[:-1][whole]] = sym[whole]
        places = np.flatnonzero(loose)
        loose_bytes, _ = taken(data, char_starts, places)
        where, _ = taken(np.arange(len(ids)), ends, places)
        ids[where] = self.byte_ids[loose_bytes]
        return ids, ends[before[offsets]]

    # --- decoding

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The text of every row of ids; bytes that are no UTF-8 become replacement characters."""
        data, ends = taken(self.id_bytes, self.id_offsets, ids)
        rows = len(offsets) - 1
        shown = np.diff(ends) > 0
        # The space that encoding put in front of a text goes again.
        at = np.append(np.flatnonzero(shown), len(ids))
        lead = at[np.searchsorted(at, offsets[:-1])]
        has = lead < offsets[1:]
        opens = np.zeros(rows, dtype=bool)
        opens[has] = self.opens[ids[lead[has]]]
        kept = np.ones(len(data), dtype=bool)
        kept[ends[lead[opens]]] = False
        bounds = np.concatenate(([0], np.cumsum(kept)))[ends[offsets]]
        data = np.ascontiguousarray(data[kept])
        texts = pa.LargeStringArray.from_buffers(rows, pa.py_buffer(bounds), pa.py_buffer(data))
        # An id without text parts the bytes of a character; only a last one does not.
        broken = np.zeros(rows, dtype=bool)
        inner = np.flatnonzero(~shown)
        row = np.searchsorted(offsets, inner, side="right") - 1
        broken[row[inner + 1 < offsets[row + 1]]] = True
        try:
            texts.validate(full=True)
        except pa.ArrowInvalid:
            broken |= np.array([not _is_text(data[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
        if broken.any():
            whole = [t if t is None else t.decode() for t in pc.if_else(pa.array(broken), None, texts.cast(pa.large_binary())).to_pylist()]
            texts = pa.array([self._mended(ids[offsets[i] : offsets[i + 1]], bool(opens[i])) if t is None else t for i, t in enumerate(whole)], pa.large_string())
        return texts

    def _mended(self, ids: np.ndarray, opens: bool) -> str:
        """Decoded one by one: runs of byte ids are characters, and each byte that is part of none a replacement character."""
        parts: list[str] = []
        run = b""
        for i in [*ids.tolist(), None]:
            shown = b"" if i is None else self.id_bytes[self.id_offsets[i] : self.id_offsets[i + 1]].tobytes()
            if i is not None and self.is_byte[i]:
                run += shown
                continue
            while run:
                try:
                    parts.append(run.decode())
                    run = b""
                except UnicodeDecodeError as error:
                    parts.append(run[: error.start].decode() + "\N{REPLACEMENT CHARACTER}")
                    run = run[error.start + 1 :]
            parts.append(shown.decode())
        text = "".join(parts)
        return text[1:] if opens else text


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def piece_model(proto: bytes) -> PieceModel:
    """The tables of a model, built once in every worker."""
    return PieceModel(proto)


def with_pieces(docs: DataFrame, model_path: str, text: str = "text", into: tuple[str, str] = ("piece_ids", "decoded")) -> DataFrame:
    """The rows with the ids of each text (the end id last) and the text that the ids decode to.

    ``model_path`` names a piece model on the driver; its bytes, bounded by the
    vocabulary, go to the workers.
    """
    with open(model_path, "rb") as file:
        proto = file.read()
    kept = docs.drop(*into)
    fields = [T.StructField(into[0], T.ArrayType(T.IntegerType(), False), False), T.StructField(into[1], T.StringType(), False)]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(proto)
        for batch in slices(batches, text, BLOCK_BYTES):
            ids, offsets = model.encode(batch.column(batch.schema.get_field_index(text)))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            columns = [*batch.columns, lists, model.decode(ids, offsets).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *into])

    return kept.mapInArrow(encode, T.StructType([*kept.schema.fields, *fields]))
