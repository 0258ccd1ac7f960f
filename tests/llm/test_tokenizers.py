"""Piece encoding against its library, and the alignment of two tokenizers against plain code."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from worklens.llm import alignment, piece_bpe
from worklens.llm.queries import BYTE_MODEL, PIECE_MODEL, REGISTRY

PATH_A, PATH_B = public_tokenizers.path(BYTE_MODEL), public_tokenizers.path(PIECE_MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
ODD = [
    None, "", " ", "   ", "a", "  a  b ", "▁", "▁▁x ▁", "\x00a\n\n\t\r", "<s></s><unk><0x41><|endoftext|>", "é🙂漢字 naïve",
    " " * 700 + "x" + " " * 300, "ab" * 2000, "aaaa " * 50, "﻿x​́", "The quick brown fox, isn't it?  12,345.67",
]


def random_texts(seed, n):
    rng = random.Random(seed)
    alphabets = ("ab ", " ▁a", "abcdefgh \n", "the quick brown fox ", "éèaü🙂漢 字́▁", "0123456789+/abcXYZ", "   \r\n\ttin")
    return ["".join(rng.choice(rng.choice(alphabets)) for _ in range(rng.randint(0, 200))) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    with open(PATH_B, "rb") as file:
        return piece_bpe.piece_model(file.read())


@pytest.mark.parametrize("single", [0, 1 << 30])
def test_pieces_equal_the_library(model, monkeypatch, single):
    """Words with tied ranks go step by step, in rounds or with a heap."""
    monkeypatch.setattr(piece_bpe, "LONG_TIES", single)
    texts = [*ODD, *random_texts(3, 300)]
    ids, offsets = model.encode(pa.array(texts, pa.string()))
    want = LIBRARY.encode([t or "" for t in texts], add_eos=True)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == want
    assert model.decode(ids, offsets).to_pylist() == [LIBRARY.decode(w) for w in want]


def test_any_ids_decode_as_in_the_library(model):
    rng = random.Random(8)
    rows = [[rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2]) for _ in range(rng.randint(0, 12))] for _ in range(400)]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    got = model.decode(np.array([i for r in rows for i in r], dtype=np.int64), offsets).to_pylist()
    assert got == [LIBRARY.decode(r) for r in rows]


def test_piece_query_equals_the_library(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, and columns that have the names of the new ones."""
    texts = [*ODD, *random_texts(4, 100), "word " * 400_000, "x" * 300_000]
    rows = [(i if i % 7 else None, t, 1) for i, t in enumerate(texts)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, decoded int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, REGISTRY["op11_piece_bpe"][0](spark, str(tmp_path)).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = LIBRARY.encode(text or "", add_eos=True)
        digests = [hashlib.sha256(s.encode()).hexdigest() for s in (" ".join(map(str, ids)), LIBRARY.decode(ids))]
        want.append((i, len(ids), *digests))
    assert got == sorted(want, key=str)
    none = spark.createDataFrame([], "text string, n int")
    assert piece_bpe.with_pieces(none, PATH_B).collect() == []


# --- alignment


def plain_alignment(texts):
    """Per text: counts, groups and scores; and the counts of all pairs."""
    a_model = Tokenizer.from_file(PATH_A)
    a_model.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in printable}
    byte_of.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)})
    all_links, shown = [], []
    for text in texts:
        want = f" {text or ''}".encode()
        a = a_model.encode(f" {text or ''}", add_special_tokens=False).ids
        b = LIBRARY.encode(text or "")
        size_a = [bytes(byte_of[c] for c in a_model.id_to_token(i)) for i in a]
        size_b = [bytes([int(LIBRARY.id_to_piece(i)[3:5], 16)]) if LIBRARY.is_byte(i) else LIBRARY.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(size_a) != want or b"".join(size_b) != want:
            all_links.append([])
            shown.append((0, 0, 0, ""))
            continue
        ends_a, ends_b = (np.cumsum([len(t) for t in s]).tolist() for s in (size_a, size_b))
        spans_a, spans_b = (list(zip([0, *e[:-1]], e)) for e in (ends_a, ends_b))
        all_links.append([(x, y) for x, (s, e) in zip(a, spans_a) for y, (u, v) in zip(b, spans_b) if s < v and u < e])
        groups, last = [], 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            parts = [",".join(str(x) for x, e in zip(ids, ends) if last < e <= cut) for ids, ends in ((a, ends_a), (b, ends_b))]
            groups.append("|".join(parts))
            last = cut
        shown.append((len(a), len(b), len(groups), ";".join(groups)))
    links, documents = Counter(p for row in all_links for p in row), Counter(p for row in all_links for p in set(row))
    most = defaultdict(int)
    for (_, y), n in links.items():
        most[y] = max(most[y], n)
    out = []
    for (n_a, n_b, n_groups, groups), row in zip(shown, all_links):
        best = sum(links[p] == most[p[1]] for p in row)
        out.append((n_a, n_b, n_groups, len(row), groups, best, sum(links[p] for p in row)))
    return out, {p: (n, documents[p], n == most[p[1]]) for p, n in links.items()}


@pytest.mark.parametrize("block_rows,dense", [(1 << 16, 4096), (32, 2)])
def test_alignment_equals_plain_code(spark, monkeypatch, block_rows, dense):
    """One block and many, places and bits; nulls, repeated rows, and columns named like the operator's own."""
    monkeypatch.setattr(alignment, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(alignment, "DENSE", dense)
    monkeypatch.setattr(alignment, "TOGETHER", 3)
    texts = [*ODD, *random_texts(5, 60), *["the same text again"] * 40]
    want, pairs = plain_alignment(texts)
    docs = spark.createDataFrame([(i % 50 or None, t, i) for i, t in enumerate(texts)], "block long, text string, row int")
    result = alignment.align(docs, PATH_A, PATH_B)
    fields = [*alignment.COUNTS, "groups", "n_best", "count_sum"]
    assert [tuple(r) for r in result.documents.orderBy("row").select("row", *fields).collect()] == [(i, *w) for i, w in enumerate(want)]
    assert {(r.a, r.b): (r.links, r.documents, r.best) for r in result.pairs.collect()} == pairs


def test_alignment_query(spark, tmp_path):
    """Digests, ids that are null or repeat, a long text, and an empty table."""
    texts = [*ODD[:6], *random_texts(6, 30), "long words " * 20_000]
    rows = [(i % 20 or None, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    result = REGISTRY["op13_pair_bitmaps"][0](spark, str(tmp_path))
    want = []
    # The plain version compares all tokens of a text with each other, so the long text is checked by its counts.
    for (i, t), (n_a, n_b, n_groups, n_links, groups, *_) in zip(rows[:-1], plain_alignment(texts[:-1])[0]):
        want.append((i, n_a, n_b, n_groups, n_links, hashlib.sha256(groups.encode()).hexdigest() if n_links else ""))
    got = [tuple(r) for r in result.select("doc_id", *alignment.COUNTS, "groups_sha256").collect()]
    long = [g for g in got if g[1] > 20_000]
    assert len(long) == 1 and long[0][4] == long[0][1] + long[0][2] - long[0][3]
    assert sorted([g for g in got if g not in long], key=str) == sorted(want, key=str)
    none = alignment.align(spark.createDataFrame([], "text string"), PATH_A, PATH_B)
    assert none.documents.count() == 0 and none.pairs.count() == 0
