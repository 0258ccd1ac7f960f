"""Language-model scoring: a hierarchical Pitman-Yor model of word pairs, seated by Gibbs sampling.

Every word is a context with a restaurant of its own; all of them share the
restaurant of single words as parent, whose base is uniform over the vocabulary.
A word pair seen c times sits at t tables of its context's restaurant, and each
table is one customer of the parent. The work is dealt three ways: blocks of
documents, buckets of word pairs and buckets of words, each of bounded size,
which exchange packed arrays. A block sends every distinct word and pair once,
so neither a frequent word nor a frequent pair makes one task large.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from worklens.llm.blobs import bucket_count, bucket_of, pack_counts, pack_keys, ranges, unpack_counts, unpack_keys
from worklens.llm.common import Words, fingerprints, mixed, slices
from worklens.session import written

#: Rows of the exchanges. ``home`` is the bucket or block a row goes to, ``origin`` the one it comes from.
FIELDS = [("kind", pa.string()), ("home", pa.int64()), ("origin", pa.int64()), ("ids", pa.list_(pa.int64()))]
FIELDS += [(name, pa.binary()) for name in "abcd"] + [("totals", pa.list_(pa.int64()))]
ARROW = pa.schema(FIELDS)
SCHEMA = "kind string, home long, origin long, ids array<long>, a binary, b binary, c binary, d binary, totals array<long>"
#: The end of a text; no word contains white space.
END = "\n"
PAIR_BITS = 64
#: So many customers of a dish are seated one by one before arrivals are skipped.
ONE_BY_ONE = 32
#: So few dishes are finished one by one, in runs of so many customers.
FEW, RUN = 32, 4096
_INVERSE = tuple(np.uint64(pow(m, -1, 1 << 64)) for m in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9))


def row(kind: str, home: int, origin: int = 0, ids=None, a=None, b=None, c=None, d=None, totals=None) -> dict:
    return {"kind": kind, "home": home, "origin": origin, "ids": ids, "a": a, "b": b, "c": c, "d": d, "totals": totals}


def table_of(rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=ARROW)


def of_kind(group: pa.Table, kind: str) -> list[dict]:
    return group.filter(pa.compute.equal(group.column("kind"), kind)).to_pylist()


def unmixed(x: np.ndarray) -> np.ndarray:
    """The inverse of ``mixed``."""
    x = x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))
    x = x * _INVERSE[0]
    x = x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))
    x = x * _INVERSE[1]
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def discount(once: int, twice: int) -> float:
    """Share of mass that a customer leaves for new words, from how many counts are one and two."""
    return min(0.95, max(0.05, once / max(1, once + 2 * twice)))


def tables_drawn(rng: np.random.Generator, customers: np.ndarray, d: float, strength: np.ndarray) -> np.ndarray:
    """Number of tables after seating the customers one by one in a Chinese restaurant of its own.

    With i customers at t tables the next opens one with probability
    (strength + d t) / (strength + i). Dishes are sorted by customers, so those still
    being seated are a leading slice. After the first customers, arrivals up to the next
    doubling of i are skipped by a geometric draw with the probability at its start and
    thinned to the true one.
    """
    order = np.argsort(-customers, kind="stable")
    size, s, tables = customers[order], strength[order], np.ones(len(customers), dtype=np.int64)
    for i in range(1, ONE_BY_ONE):
        n = int(np.searchsorted(-size, -i, side="left"))
        if not n:
            break
        tables[:n] += rng.random(n) * (s[:n] + i) < s[:n] + d * tables[:n]
    active = np.arange(int(np.searchsorted(-size, -ONE_BY_ONE, side="left")))
    seated = np.full(len(active), ONE_BY_ONE, dtype=np.int64)
    while len(active) > FEW:
        i, t, own = seated[active], tables[active], s[active]
        most = (own + d * t) / (own + i)
        with np.errstate(divide="ignore"):
            gap = np.log(1.0 - rng.random(len(active))) / np.log1p(-np.minimum(most, 1 - 1e-12))
        stop = np.minimum(2 * i, size[active])
        at = i + np.minimum(gap, stop - i).astype(np.int64)
        inside = at < stop
        opened = inside & (rng.random(len(active)) * (own + at) < (own + i))
        tables[active] += opened
        seated[active] = np.where(inside, at + 1, stop)
        active = active[seated[active] < size[active]]
    for dish in active.tolist():
        tables[dish] = _seated_in_runs(rng, int(seated[dish]), int(size[dish]), int(tables[dish]), d, float(s[dish]))
    out = np.empty_like(tables)
    out[order] = tables
    return out


def _seated_in_runs(rng: np.random.Generator, seated: int, customers: int, tables: int, d: float, strength: float) -> int:
    """Tables of one large dish: many customers at once.

    Whether a customer opens a table depends on the tables opened before, which only
    make it likelier; repeating the run with the tables found so far therefore rises to
    the very outcome of seating one after the other.
    """
    while seated < customers:
        i = np.arange(seated, min(customers, seated + RUN))
        drawn = rng.random(len(i)) * (strength + i)
        opened = drawn < strength + d * tables
        while True:
            before = np.cumsum(opened) - opened
            more = drawn < strength + d * (tables + before)
            if (more == opened).all():
                break
            opened = more
        tables += int(opened.sum())
        seated += len(i)
    return tables


def reseated(
    rng: np.random.Generator, customers: np.ndarray, tables: np.ndarray, d: float, theta: float, others: np.ndarray, base: np.ndarray
) -> np.ndarray:
    """One Gibbs step for the tables of every dish, given the other dishes' tables and the parent's probability.

    All customers of a dish stand up and are seated anew in a restaurant of nearly the
    right strength; the proposal is accepted by the Metropolis ratio of the true weight
    base^t (theta + d others) ... (theta + d (others + t - 1)) to the proposal's.
    """
    strength = base * (theta + d * (others + 1)) - d
    fresh = tables_drawn(rng, customers, d, strength)

    moved = np.flatnonzero(fresh != tables)
    base, others, strength = base[moved], others[moved], strength[moved]

    def log_weight(t: np.ndarray) -> np.ndarray:
        out = np.zeros(len(t))
        active = np.flatnonzero(t > 1)
        j = 1
        while len(active) > FEW:
            out[active] += np.log(base[active] * (theta + d * (others[active] + j))) - np.log(strength[active] + d * j)
            j += 1
            active = active[t[active] > j]
        for k in active.tolist():
            rest = np.arange(j, t[k])
            out[k] += (np.log(base[k] * (theta + d * (others[k] + rest))) - np.log(strength[k] + d * rest)).sum()
        return out

    refused = np.log(1.0 - rng.random(len(moved))) > log_weight(fresh[moved]) - log_weight(tables[moved])
    fresh[moved[refused]] = tables[moved[refused]]
    return fresh


@dataclass(frozen=True)
class Setup:
    """Parameters and global numbers, all of fixed size."""

    buckets: int
    burn_in: int
    samples: int
    seed: int
    theta: float = 1.0
    tokens: int = 0
    vocabulary: int = 0
    d_pair: float = 0.5
    d_word: float = 0.5
    word_customers: tuple[int, ...] = ()
    word_tables: tuple[int, ...] = ()


def _coded(setup: Setup):
    """Documents to blocks: words of the block as sorted fingerprints, texts as places among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        end = fingerprints(pa.array([END]))[0]
        for batch in slices(batches, "text"):
            block += 1
            words = Words(batch.column("text"))
            keys = np.append(fingerprints(words.distinct), end) >> np.uint64(8)
            distinct, place = np.unique(keys, return_inverse=True)
            lengths = np.diff(words.offsets) + 1
            codes = np.full(int(lengths.sum()), place[-1], dtype=np.int64)
            inside = np.ones(len(codes), dtype=bool)
            inside[np.cumsum(lengths) - 1] = False
            codes[inside] = place[words.codes]
            train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.uint8)
            out = row(
                "block", block, block, batch.column("doc_id").to_pylist(),
                pack_keys(distinct), pack_counts(codes), pack_counts(lengths), train.tobytes(),
            )
            yield pa.RecordBatch.from_pylist([out], schema=ARROW)

    return run


class Block:
    def __init__(self, packed: dict):
        self.ids = packed["ids"]
        self.words = unpack_keys(packed["a"])
        self.codes = unpack_counts(packed["b"])
        self.lengths = unpack_counts(packed["c"])
        self.train = np.frombuffer(packed["d"], np.uint8).astype(bool)
        self.docs = np.repeat(np.arange(len(self.lengths)), self.lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (context, word) pairs as sorted keys, and the place of each token's pair."""
        end = np.searchsorted(self.words, fingerprints(pa.array([END]))[0] >> np.uint64(8))
        context = np.concatenate(([end], self.codes[:-1]))
        local, place = np.unique(context * len(self.words) + self.codes, return_inverse=True)
        short = self.words >> np.uint64(24)
        keys = mixed(short[local // len(self.words)] << np.uint64(32) | short[local % len(self.words)])
        order = np.argsort(keys)
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        return keys[order], rank[place]


def _block_words(setup: Setup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.to_pylist():
                block = Block(packed)
                counts = np.bincount(block.codes[block.train[block.docs]], minlength=len(block.words))
                out = [
                    row("words", bucket, packed["home"], a=pack_keys(block.words[x:y]), b=pack_counts(counts[x:y]))
                    for bucket, x, y in ranges(block.words, setup.buckets)
                ]
                yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return run


def _word_counts(group: pa.Table) -> pa.Table:
    """Training counts of a bucket's words; each block gets those of its words."""
    rows = group.to_pylist()
    home = rows[0]["home"]
    keys = [unpack_keys(r["a"]) for r in rows]
    key = np.concatenate(keys)
    distinct, place = np.unique(key, return_inverse=True)
    total = np.bincount(place, np.concatenate([unpack_counts(r["b"]) for r in rows]), len(distinct)).astype(np.int64)
    short, slot = np.unique(distinct >> np.uint64(24), return_inverse=True)
    contexts = np.bincount(slot, total, len(short)).astype(np.int64)
    out = [row("vocabulary", home, a=pack_keys(short), b=pack_counts(contexts), totals=[int(total.sum()), int((total > 0).sum())])]
    at = 0
    for r, k in zip(rows, keys):
        mine = place[at : at + len(k)]
        at += len(k)
        out.append(row("asked", home, r["origin"], a=pack_keys(slot[mine].astype(np.uint64)), b=pack_counts(total[mine])))
    return table_of(out)


def _block_pairs(setup: Setup):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.to_pylist():
                block = Block(packed)
                keys, place = block.pairs()
                counts = np.bincount(place[block.train[block.docs]], minlength=len(keys))
                out = [
                    row("pairs", bucket, packed["home"], a=pack_keys(keys[x:y], PAIR_BITS), b=pack_counts(counts[x:y]))
                    for bucket, x, y in ranges(keys, setup.buckets, PAIR_BITS)
                ]
                yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return run


def _summed(ids: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    distinct, place = np.unique(ids, return_inverse=True)
    return distinct, [np.bincount(place, v, len(distinct)).astype(np.int64) for v in values]


def _to_words(kind: str, ids: np.ndarray, values: list[np.ndarray], setup: Setup, origin: int) -> list[dict]:
    """Sums per word, dealt to the buckets of the words."""
    distinct, sums = _summed(ids, values)
    return [
        row(kind, bucket, origin, a=pack_keys(distinct[x:y]), b=pack_counts(np.concatenate([s[x:y] for s in sums])))
        for bucket, x, y in ranges(distinct << np.uint64(24), setup.buckets)
    ]


def _pair_counts(setup: Setup):
    """Counts of a bucket's pairs: what one table each gives the words, and the pairs that can have more."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        home = rows[0]["home"]
        keys = [unpack_keys(r["a"], PAIR_BITS) for r in rows]
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack_counts(r["b"]) for r in rows]), len(distinct)).astype(np.int64)
        plain = unmixed(distinct)
        context, word = plain >> np.uint64(32), plain & np.uint64(0xFFFFFFFF)
        seen, many = total > 0, np.flatnonzero(total > 1)
        out = [
            row("seats", home, a=context[many].astype("<u4").tobytes(), b=word[many].astype("<u4").tobytes(), c=pack_counts(total[many]),
                totals=[int((total == 1).sum()), int((total == 2).sum())])
        ]
        one = [np.ones(int(seen.sum()), dtype=np.int64)]
        out += _to_words("tables", context[seen], one, setup, home) + _to_words("customers", word[seen], one, setup, home)
        for kind, ids in (("ask_tables", context[many]), ("ask_customers", word[many])):
            ids = np.unique(ids)
            out += [row(kind, b, home, a=pack_keys(ids[x:y])) for b, x, y in ranges(ids << np.uint64(24), setup.buckets)]
        # 0: not in training, 1: once, 2 and more: place among the pairs that can have several tables.
        code = np.minimum(total, 1)
        code[many] = 2 + np.arange(len(many))
        at = 0
        for r, k in zip(rows, keys):
            out.append(row("reply", home, r["origin"], a=pack_counts(code[place[at : at + len(k)]])))
            at += len(k)
        return table_of(out)

    return run


def _first_seating(group: pa.Table) -> pa.Table:
    """Tables and parent customers of a bucket's words at one table for every pair; answers to the pair buckets."""
    home = group.column("home")[0].as_py()
    known = of_kind(group, "vocabulary")[0]
    ids, contexts = unpack_keys(known["a"]), unpack_counts(known["b"])
    sums = {}
    for kind in ("tables", "customers"):
        sums[kind] = np.zeros(len(ids), dtype=np.int64)
        for r in of_kind(group, kind):
            sums[kind][np.searchsorted(ids, unpack_keys(r["a"]))] += unpack_counts(r["b"])
    customers = sums["customers"]
    totals = [int(customers.sum()), int((customers > 0).sum()), int((customers == 1).sum()), int((customers == 2).sum())]
    out = [row("vocabulary", home, a=known["a"], b=pack_counts(contexts), c=pack_counts(sums["tables"]), d=pack_counts(customers), totals=totals)]
    for kind in ("tables", "customers"):
        for r in of_kind(group, f"ask_{kind}"):
            told = sums[kind][np.searchsorted(ids, unpack_keys(r["a"]))]
            out.append(row(f"told_{kind}", r["origin"], home, a=r["a"], b=pack_counts(told)))
    return table_of(out)


def _seated(setup: Setup):
    """Gibbs sweeps over a bucket's pairs; mean tables go back to the blocks, the samples' tables to the words."""

    def run(group: pa.Table) -> pa.Table:
        home = group.column("home")[0].as_py()
        seats = of_kind(group, "seats")[0]
        context, word = (np.frombuffer(seats[c], "<u4").astype(np.uint64) for c in "ab")
        count = unpack_counts(seats["c"])
        told = {}
        for kind in ("tables", "customers"):
            rows = sorted(of_kind(group, f"told_{kind}"), key=lambda r: r["origin"])
            ids = [unpack_keys(r["a"]) for r in rows]
            told[kind] = (
                np.concatenate(ids) if ids else np.empty(0, np.uint64),
                np.concatenate([unpack_counts(r["b"]) for r in rows]) if rows else np.empty(0, np.int64),
            )
        out: list[dict] = []
        mean = np.zeros(len(count), dtype=np.int64)
        if len(count):
            tables_of = told["tables"][1][np.searchsorted(told["tables"][0], context)]
            customers_of = told["customers"][1][np.searchsorted(told["customers"][0], word)]
            all_customers, all_tables = setup.word_customers[0], setup.word_tables[0]
            parent = (np.maximum(customers_of - setup.d_word, 0) + (setup.theta + setup.d_word * all_tables) / (setup.vocabulary + 1)) / (
                setup.theta + all_customers
            )
            rng = np.random.default_rng((setup.seed, home))
            tables, kept = np.ones(len(count), dtype=np.int64), []
            slot = np.unique(context, return_inverse=True)[1]
            for sweep in range(setup.burn_in + setup.samples):
                # Other tables of the context: those of this bucket as they are now, the rest as they were told.
                moved = np.bincount(slot, tables - 1)[slot]
                others = np.maximum(tables_of + moved - tables, 0)
                tables = reseated(rng, count, tables, setup.d_pair, setup.theta, others, parent)
                if sweep >= setup.burn_in:
                    kept.append(tables)
            mean = np.sum(kept, axis=0)
            more = [t - 1 for t in kept]
            changed = np.flatnonzero(np.max(more, axis=0) > 0)
            out += _to_words("tables", context[changed], [m[changed] for m in more], setup, home)
            out += _to_words("customers", word[changed], [m[changed] for m in more], setup, home)
        # Count and tables summed over the samples, for codes 0 and 1 as well.
        counts = np.concatenate(([0, 1], count))
        seated = np.concatenate(([0, setup.samples], mean))
        for r in of_kind(group, "reply"):
            code = unpack_counts(r["a"])
            out.append(row("pairs", r["origin"], home, a=pack_counts(counts[code]), b=pack_counts(seated[code])))
        return table_of(out)

    return run


def _parent_seated(setup: Setup):
    """Seating of the shared parent for every sample; its numbers go to the blocks that asked for the words."""

    def run(group: pa.Table) -> pa.Table:
        home = group.column("home")[0].as_py()
        known = of_kind(group, "vocabulary")[0]
        ids, contexts = unpack_keys(known["a"]), unpack_counts(known["b"])
        s = setup.samples
        sums = {"tables": np.tile(unpack_counts(known["c"]), (s, 1)), "customers": np.tile(unpack_counts(known["d"]), (s, 1))}
        for kind in sums:
            for r in of_kind(group, kind):
                sums[kind][:, np.searchsorted(ids, unpack_keys(r["a"]))] += unpack_counts(r["b"]).reshape(s, -1)
        rng = np.random.default_rng((setup.seed, 1, home))
        base = np.full(len(ids), 1.0 / (setup.vocabulary + 1))
        parent = []
        for customers in sums["customers"]:
            tables = np.minimum(customers, 1)
            dishes = np.flatnonzero(customers > 1)
            for _ in range(setup.burn_in + 1):
                others = np.full(len(dishes), max(setup.word_tables[0] - 1, 0))
                tables[dishes] = reseated(
                    rng, customers[dishes], tables[dishes], setup.d_word, setup.theta, others, base[dishes]
                )
            parent.append(tables)
        stats = np.stack([contexts, *sums["tables"], *sums["customers"], *parent])
        out = [row("totals", home, totals=[*(int(c.sum()) for c in sums["customers"]), *(int(t.sum()) for t in parent)])]
        for r in of_kind(group, "asked"):
            slot = unpack_keys(r["a"]).astype(np.int64)
            out.append(row("words", r["origin"], home, a=r["b"], b=pack_counts(stats[:, slot].reshape(-1))))
        return table_of(out)

    return run


def _scored(setup: Setup):
    """Scores of a block's documents from the numbers of its words and pairs."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("train", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
         ("base_score", pa.float64()), ("score", pa.float64())]
    )

    def run(group: pa.Table) -> pa.Table:
        block = Block(of_kind(group, "block")[0])
        s, theta = setup.samples, setup.theta
        words = sorted(of_kind(group, "words"), key=lambda r: r["origin"])
        count = np.concatenate([unpack_counts(r["a"]) for r in words])
        stats = np.concatenate([unpack_counts(r["b"]).reshape(1 + 3 * s, -1) for r in words], axis=1)
        pairs = sorted(of_kind(group, "pairs"), key=lambda r: r["origin"])
        pair_count = np.concatenate([unpack_counts(r["a"]) for r in pairs])
        pair_tables = np.concatenate([unpack_counts(r["b"]) for r in pairs]) / s
        _, place = block.pairs()
        n, v = setup.tokens, setup.vocabulary
        base = np.log10((count + 1) / (n + 1 * (v + 1)))

        contexts, tables, customers, parents = stats[0], stats[1 : 1 + s], stats[1 + s : 1 + 2 * s], stats[1 + 2 * s :]
        end = np.searchsorted(block.words, fingerprints(pa.array([END]))[0] >> np.uint64(8))
        before = np.concatenate(([end], block.codes[:-1]))
        backed = np.zeros(len(block.codes))
        for i in range(s):
            whole = theta + setup.word_customers[i]
            single = (customers[i] - setup.d_word * parents[i]) / whole
            single = single + (theta + setup.d_word * setup.word_tables[i]) / whole / (v + 1)
            open_mass = np.minimum((theta + setup.d_pair * tables[i]) / (theta + contexts), 1.0)
            backed += open_mass[before] * single[block.codes] / s
        own = np.maximum(pair_count - setup.d_pair * pair_tables, 0)[place] / (theta + contexts[before])
        log = np.log10(own + backed)
        rows = len(block.lengths)

        def per_doc(x: np.ndarray) -> np.ndarray:
            return np.bincount(block.docs, x, rows)

        return pa.table(
            [
                pa.array(block.ids, pa.int64()), pa.array(block.train), pa.array(block.lengths),
                pa.array(per_doc(count[block.codes] > 0).astype(np.int64)), pa.array(per_doc(base[block.codes])), pa.array(per_doc(log)),
            ],
            schema=schema,
        )

    return run


def score_documents(
    docs: DataFrame,
    train: Column,
    doc_id: str = "doc_id",
    text: str = "text",
    burn_in: int = 3,
    samples: int = 3,
    seed: int = 11,
) -> DataFrame:
    """Log probability of every document under a model of the documents for which ``train`` holds.

    Result, one row per document: (doc_id, train, n_tokens, n_known, train_tokens,
    base_score, score). Tokens are the lower-cased words and one end; a null or blank
    text is the end alone. base_score is the add-one unigram log10 probability; score
    the log10 probability of the model, averaged over ``samples`` seatings after
    ``burn_in`` sweeps; 10 ** (-score / n_tokens) is the perplexity. A null ``train``
    counts as not. Repeated rows count and score as often as they occur. Without
    training documents all counts are 0 and words are uniform. Other columns are not
    looked at.

    Counts cover all documents. Base counts tell words apart by 56 bits of their
    fingerprint, the restaurants by 32: words that agree in those share a restaurant.
    Within a bucket sweeps follow each other as the sampler demands; other buckets are
    seen as they were when the sweeps began.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    setup = Setup(bucket_count(rows, "text"), burn_in, samples, seed)

    def renewed(**numbers) -> Setup:
        return Setup(**{**setup.__dict__, **numbers})

    def only(df: DataFrame, *kinds: str) -> DataFrame:
        return df.filter(F.col("kind").isin(*kinds))

    def totals(df: DataFrame, kind: str, n: int) -> list[int]:
        sums = only(df, kind).agg(*(F.sum(F.col("totals")[i]) for i in range(n))).first()
        return [int(x or 0) for x in sums]

    blocks = written(rows.mapInArrow(_coded(setup), SCHEMA), "lm-blocks")
    counted = blocks.mapInArrow(_block_words(setup), SCHEMA).groupBy("home").applyInArrow(_word_counts, SCHEMA)
    vocabulary = written(counted, "lm-words")
    tokens, known = totals(vocabulary, "vocabulary", 2)
    paired = blocks.mapInArrow(_block_pairs(setup), SCHEMA).groupBy("home").applyInArrow(_pair_counts(setup), SCHEMA)
    pairs = written(paired, "lm-pairs")
    once, twice = totals(pairs, "seats", 2)
    to_words = only(pairs, "tables", "customers", "ask_tables", "ask_customers").union(only(vocabulary, "vocabulary"))
    first = written(to_words.groupBy("home").applyInArrow(_first_seating, SCHEMA), "lm-first-seating")
    customers, tables, words_once, words_twice = totals(first, "vocabulary", 4)
    setup = renewed(
        tokens=tokens, vocabulary=known, d_pair=discount(once, twice), d_word=discount(words_once, words_twice),
        word_customers=(customers,), word_tables=(tables,),
    )
    to_pairs = only(pairs, "seats", "reply").union(only(first, "told_tables", "told_customers"))
    seated = written(to_pairs.groupBy("home").applyInArrow(_seated(setup), SCHEMA), "lm-seating")
    to_words = only(seated, "tables", "customers").union(only(first, "vocabulary")).union(only(vocabulary, "asked"))
    parent = written(to_words.groupBy("home").applyInArrow(_parent_seated(setup), SCHEMA), "lm-parent")
    sums = totals(parent, "totals", 2 * samples)
    setup = renewed(word_customers=tuple(sums[:samples]), word_tables=tuple(sums[samples:]))
    to_blocks = blocks.union(only(seated, "pairs")).union(only(parent, "words"))
    scored = to_blocks.groupBy("home").applyInArrow(
        _scored(setup), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
