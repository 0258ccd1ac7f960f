"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from worklens.llm import conversation_repair
from worklens.llm.queries import REGISTRY, damaged

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def least_repair(rows):
    """(cost, audit, lines) by trying every edit at every place; rows: (initial, role, text, must go, truncated)."""
    user, assistant = (2, "user:"), (3, "assistant:")
    best = {(0, 0): (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(3):
            for q in range(4):
                if (i, q) in best:
                    cost, audit, lines = best[i, q]
                    to, line = assistant if q == 2 else user
                    offer = (cost + 2, audit + "I", (*lines, line))
                    best[i, to] = min(best.get((i, to), offer), offer)
        if i == len(rows):
            break
        initial, role, text, gone, cut = rows[i]
        for q in range(4):
            if (i, q) not in best:
                continue
            cost, audit, lines = best[i, q]
            offers = [(q, (cost + 3, audit + "D", lines))]
            if not gone:
                if (initial, q) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                    offers.append(({"s": 1, "u": 2, "a": 3}[initial], (cost + cut, audit + "K", (*lines, f"{role}:{text}"))))
                to, name = (3, "assistant") if q == 2 else (2, "user")
                offers.append((to, (cost + 2 + cut, audit + "R", (*lines, f"{name}:{text}"))))
            for to, offer in offers:
                best[i + 1, to] = min(best.get((i + 1, to), offer), offer)
    return min(best[len(rows), q] for q in (0, 3) if (len(rows), q) in best)


def by_hand(rows):
    """One result per conversation, as the query gives it, for rows after damage."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or " " if role != "" else "", text if text is not None else " "))
    out = {}
    for conv, members in groups.items():
        members.sort()
        seen, faults, cooked = set(), [], []
        for _, _, role, text in members:
            bare = text.rstrip(WHITE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            faults.append(fault)
            cooked.append((role[:1], role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        turns = [t for there, t, _, _ in members if there]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(cooked, cooked[1:]))
        cost, audit, lines = least_repair(cooked)
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest)
    return out


def repaired(spark, rows):
    result = conversation_repair.repair(spark.createDataFrame(rows, SCHEMA))
    digests = {r[0]: tuple(r)[1:] for r in conversation_repair.digests(result.edits).collect()}
    return {r[0]: (*tuple(r)[1:], *digests[r[0]]) for r in result.summary.collect()}


def conversations(seed, n, longest):
    rng = random.Random(seed)
    texts = ["Yes.", "Why?", "no", "", " \t", "So!\n", "cut (", "x.\ny"]
    rows = []
    for conv in range(n):
        for k in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Sam"])
            text = rng.choice([*texts, None, *[f"t{rng.randint(0, 50)}." for _ in range(12)]])
            rows.append((conv if conv else None, rng.choice([k, k, k + 1, None]), role, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,n,longest,segment", [(1, 150, 8, 512), (2, 60, 30, 4), (3, 60, 12, 1)])
def test_repair_equals_a_plain_search(spark, monkeypatch, seed, n, longest, segment):
    """Nulls, blanks, ties of turns, repeated rows and odd roles; short segments cut every conversation."""
    monkeypatch.setattr(conversation_repair, "SEGMENT", segment)
    rows = conversations(seed, n, longest)
    assert repaired(spark, rows) == by_hand(rows)


def test_one_conversation_of_many_messages(spark):
    rng = random.Random(9)
    rows = [(7, k, rng.choice(["user", "assistant", "assistant", "system"]), f"message {k if rng.random() < 0.9 else 0}.") for k in range(3000)]
    assert repaired(spark, rows) == by_hand(rows)


def test_empty_table_and_clashing_columns(spark):
    none = conversation_repair.repair(spark.createDataFrame([], SCHEMA))
    assert none.summary.count() == 0 and conversation_repair.digests(none.edits).count() == 0
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", "a", 2)], SCHEMA + ", conv string, position int")
    assert [tuple(r)[:2] for r in conversation_repair.repair(rows).summary.collect()] == [(1, 0)]


def test_query_equals_damage_and_repair_by_hand(spark, tmp_path):
    rows = conversations(5, 200, 9)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    hurt = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        hurt += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    want = by_hand(hurt)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {r[0]: tuple(r)[1:] for r in REGISTRY["op12_conversation_repair"][0](spark, str(tmp_path)).collect()}
    assert got == {conv: want.get(conv, nothing) for conv, *_ in rows}
    assert damaged(spark.createDataFrame(rows, SCHEMA)).count() == len(hurt)
