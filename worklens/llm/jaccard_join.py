"""N-gram Jaccard join: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from worklens.llm.blobs import KEY_BITS, bucket_count, pack_keys, ranges, unpack_keys
from worklens.llm.common import WORD, Words, fingerprints, mixed, slices, unused
from worklens.llm.components import components
from worklens.session import written

ENTRY, DOCS, OWNERS = 0, 1, 2
MANY = 65535
HISTOGRAM = 16
#: Numbers of 64 bits that note which slices of the key space a set's shared n-grams fall into.
LANES = 32
#: A frequent n-gram's sets are dealt to tasks of so many.
HOT_SETS = 512
SCHEMA = "kind int, bucket int, chunk long, ids array<long>, digests array<binary>, a binary, b binary, c binary"
KINDS = pa.schema(
    [("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("digests", pa.list_(pa.binary())), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())]
)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and row of every distinct word n-gram of every text, by rising fingerprint.

    A text of fewer words has its whole word sequence as the only n-gram.
    """
    words = Words(texts)
    if not len(words.codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word, rows = fingerprints(words.distinct)[words.codes], words.rows()
    lengths = np.diff(words.offsets)
    at = np.flatnonzero(np.arange(len(word)) + width <= words.offsets[1:][rows])
    key = np.full(len(at), width, dtype=np.uint64)
    for k in range(width):
        key = mixed(key + word[at + k])
    keys, owners = [key], [rows[at]]
    for short in range(1, width):
        own = np.flatnonzero(lengths == short)
        first = words.offsets[:-1][own]
        key = np.full(len(own), short, dtype=np.uint64)
        for k in range(short):
            key = mixed(key + word[first + k])
        keys.append(key)
        owners.append(own)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owner.astype(np.uint32), kind="stable")
    order = order[np.argsort(key[order], kind="stable")]
    key, owner = key[order], owner[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[new], owner[new]


def set_signatures(key: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 128-bit signature of each row's set; equal sets have equal signatures."""
    sizes = np.bincount(owner, minlength=rows)
    order = np.argsort(owner.astype(np.uint32), kind="stable")
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    out = np.zeros((rows, 2), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    for side, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0676A9A99)):
        parts = mixed(key[order] ^ np.uint64(salt))
        if len(full):
            out[full, side] = np.add.reduceat(parts, starts[full])
    return sizes, out


def _blocks(buckets: int, width: int):
    """One block of documents to its packed n-grams: an entry for each distinct n-gram of the block.

    Of documents with equal sets in a block only one is packed. An n-gram of one
    document carries its place; the places of one that several hold stay with the
    block, so even the most frequent n-gram sends one entry per block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text"):
            chunk += 1
            rows = batch.num_rows
            key, owner = shingle_sets(batch.column("text"), width)
            sizes, signatures = set_signatures(key, owner, rows)
            places: dict[bytes, int] = {}
            place = np.full(rows, -1, dtype=np.int32)
            first = np.zeros(rows, dtype=bool)
            for i in np.flatnonzero(sizes).tolist():
                signature = signatures[i].tobytes()
                first[i] = signature not in places
                place[i] = places.setdefault(signature, len(places))
            held = np.array([sizes[i] for i in np.flatnonzero(first)], dtype=np.int32)
            ids, digests = batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()
            out = [(DOCS, chunk % buckets, chunk, ids, digests, place.tobytes(), held.tobytes(), b"".join(places))]
            keep = first[owner]
            short, owner = key[keep] >> np.uint64(64 - KEY_BITS), place[owner[keep]]
            start = np.flatnonzero(np.concatenate(([True], short[1:] != short[:-1]))) if len(short) else np.empty(0, np.int64)
            count = np.diff(np.append(start, len(short)))
            single = np.where(count == 1, owner[start] if len(start) else owner, MANY).astype(np.uint16)
            shared = np.repeat(count > 1, count)
            distinct = short[start]
            out.append(
                (OWNERS, chunk % buckets, chunk, None, None, pack_keys(distinct[count > 1]), owner[shared].astype(np.uint16).tobytes(), count[count > 1].astype(np.uint32).tobytes())
            )
            for bucket, a, b in ranges(distinct, buckets):
                more = count[a:b][count[a:b] > 1].astype(np.uint32)
                out.append((ENTRY, bucket, chunk, None, None, pack_keys(distinct[a:b]), single[a:b].tobytes(), more.tobytes()))
            yield pa.RecordBatch.from_pylist([dict(zip(KINDS.names, r)) for r in out], schema=KINDS)

    return run


def _frequencies(group: pa.Table) -> pa.Table:
    """Document frequencies of a bucket's n-grams; those of two documents or more go back to their blocks."""
    kinds = group.column("kind").to_numpy()
    passed = group.filter(pa.array(kinds != ENTRY))
    rows = group.filter(pa.array(kinds == ENTRY))
    if not rows.num_rows:
        return passed
    chunks = rows.column("chunk").to_numpy()
    keys = [unpack_keys(b) for b in rows.column("a").to_pylist()]
    owner = np.frombuffer(b"".join(rows.column("b").to_pylist()), np.uint16)
    source = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key = np.concatenate(keys)
    count = np.ones(len(key), dtype=np.int64)
    count[owner == MANY] = np.frombuffer(b"".join(rows.column("c").to_pylist()), np.uint32)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    start = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
    total = np.add.reduceat(count[order], start)
    frequency = np.empty(len(key), dtype=np.int64)
    frequency[order] = np.repeat(total, np.diff(np.append(start, len(key))))
    out = []
    bounds = np.searchsorted(source, np.arange(len(keys) + 1))
    for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
        met = np.flatnonzero(frequency[a:b] > 1)
        if len(met):
            capped = np.minimum(frequency[a:b][met], 2**32 - 1).astype(np.uint32)
            out.append((ENTRY, 0, int(chunks[i]), None, None, pack_keys(key[a:b][met]), owner[a:b][met].tobytes(), capped.tobytes()))
    made = pa.Table.from_pylist([dict(zip(KINDS.names, r)) for r in out], schema=KINDS)
    return pa.concat_tables([passed.cast(KINDS), made])


def _prefix(n: int, numerator: int, denominator: int) -> int:
    """How many of a set's first n-grams must hold one that it shares with any partner.

    A partner shares at least the threshold's part of the set, rounded up.
    """
    return n - -(-numerator * n // denominator) + 1


def _sets(numerator: int, denominator: int):
    """Per block: its documents with set size and signature, and every set that shares a prefix n-gram, rarest first."""

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_numpy()
        docs = group.filter(pa.array(kinds == DOCS)).to_pylist()[0]
        place, held = np.frombuffer(docs["a"], np.int32), np.frombuffer(docs["b"], np.int32)
        signatures = [docs["c"][i : i + 16] for i in range(0, len(docs["c"]), 16)]
        sizes = np.where(place >= 0, held[place] if len(held) else 0, 0)
        out_ids = docs["ids"]
        out_sig = [signatures[p] if p >= 0 else None for p in place.tolist()]

        key, owner, frequency = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        entries = group.filter(pa.array(kinds == ENTRY))
        if entries.num_rows:
            key = np.concatenate([unpack_keys(b) for b in entries.column("a").to_pylist()])
            owner = np.frombuffer(b"".join(entries.column("b").to_pylist()), np.uint16).astype(np.int64)
            frequency = np.frombuffer(b"".join(entries.column("c").to_pylist()), np.uint32).astype(np.int64)
            many = np.flatnonzero(owner == MANY)
            if len(many):
                kept = group.filter(pa.array(kinds == OWNERS)).to_pylist()[0]
                names, counts = unpack_keys(kept["a"]), np.frombuffer(kept["c"], np.uint32).astype(np.int64)
                holders = np.frombuffer(kept["b"], np.uint16).astype(np.int64)
                at = np.searchsorted(names, key[many])
                starts = np.concatenate(([0], np.cumsum(counts)))
                picked = np.concatenate([holders[starts[i] : starts[i + 1]] for i in at.tolist()])
                rest = np.flatnonzero(owner != MANY)
                key = np.concatenate([key[rest], np.repeat(key[many], counts[at])])
                frequency = np.concatenate([frequency[rest], np.repeat(frequency[many], counts[at])])
                owner = np.concatenate([owner[rest], picked])
        order = np.lexsort((key, frequency, owner))
        key, owner = key[order].astype(np.int64), owner[order]
        bounds = np.searchsorted(owner, np.arange(len(held) + 1))
        starts, stops, alone, sizes_of, names = [], [], [], [], []
        for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist())):
            n, own = int(held[i]), int(held[i]) - (b - a)
            if _prefix(n, numerator, denominator) > own:
                starts.append(a)
                stops.append(b)
                alone.append(own)
                sizes_of.append(n)
                names.append(signatures[i])
        blank, none = [None] * len(out_ids), [None] * len(names)
        flat = np.concatenate([key[a:b] for a, b in zip(starts, stops)]) if names else np.empty(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(np.subtract(stops, starts)))).astype(np.int32)
        histogram = [np.bincount(key[a:b] & (HISTOGRAM - 1), minlength=HISTOGRAM).tolist() for a, b in zip(starts, stops)]
        table = {
            "doc_id": pa.array([*out_ids, *none], pa.int64()),
            "digest": pa.array([*docs["digests"], *none], pa.binary()),
            "signature": pa.array([*out_sig, *names], pa.binary()),
            "n": pa.array([*sizes.tolist(), *sizes_of], pa.int64()),
            "alone": pa.array([*blank, *alone], pa.int32()),
            "keys": pa.concat_arrays([pa.array(blank, pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, flat)]),
            "histogram": pa.array([*blank, *histogram], pa.list_(pa.int32())),
            "bits": pa.concat_arrays([pa.array(blank, pa.list_(pa.int64())), _bitmaps(key, starts, stops)]),
        }
        return pa.table(table)

    return run


SETS = "doc_id long, digest binary, signature binary, n long, alone int, keys array<long>, histogram array<int>, bits array<long>"


def _bitmaps(key: np.ndarray, starts: list[int], stops: list[int]) -> pa.Array:
    """For every set, a bit for each slice of the key space that one of its n-grams falls into."""
    out = np.zeros((len(starts), LANES), dtype=np.int64)
    slot = (mixed(key.astype(np.uint64)) & np.uint64(64 * LANES - 1)).astype(np.int64)
    for i, (a, b) in enumerate(zip(starts, stops)):
        marks = np.zeros(64 * LANES, dtype=np.uint8)
        marks[slot[a:b]] = 1
        out[i] = np.packbits(marks).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1) * LANES, pa.int32()), pa.array(out.ravel()))


def _verified(pairs: DataFrame, sets: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """The pairs (a, b) of sets that reach the threshold; each pair is intersected once.

    The suffix filter comes first, on a few numbers per set: the overlap is bounded by
    the parts of both sets that fall into the same slice of the key space. Only sets of
    pairs that pass are fetched.
    """
    def both(columns: list[str], pairs: DataFrame, sets: DataFrame) -> DataFrame:
        for name in "ab":
            side = sets.select(F.col("rep").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in columns))
            pairs = pairs.join(side, name)
        return pairs

    least = F.zip_with("histogram_a", "histogram_b", lambda x, y: F.least(x, y))
    most = F.aggregate(least, F.lit(0).cast("int"), lambda total, x: total + x)
    passing = both(["n", "histogram"], pairs.select("a", "b"), sets).withColumn("most", most)
    reach = F.expr(f"{denominator} * most >= {numerator} * (n_a + n_b - most)")
    passing = written(passing.filter(reach).select("a", "b", (F.col("n_a") + F.col("n_b")).alias("total")), "filtered-pairs")
    wanted = written(passing.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted-sets")
    fetched = written(sets.select("rep", "keys").join(wanted, "rep", "left_semi"), "fetched-sets")
    joined = both(["keys"], passing, fetched).withColumn("overlap", F.size(F.array_intersect("keys_a", "keys_b")))
    return joined.filter(F.expr(f"{denominator} * overlap >= {numerator} * (total - overlap)")).select("a", "b")


def _sizes_fit(numerator: int, denominator: int, x: str, y: str):
    """Length filter: the smaller set must be at least the threshold's share of the larger."""
    return (denominator * F.least(x, y)) >= (numerator * F.greatest(x, y))


def _positions_fit(numerator: int, denominator: int, x: str, y: str, x_end: str = "", y_end: str = ""):
    """Positional filter on one common n-gram, of several alike the last.

    ``at`` n-grams that others have too stand before it in a set and ``rest`` behind it;
    those that no other set has cannot be shared and count for neither.
    """
    one, two = (lambda c: F.col(f"{x}{c}{x_end}")), (lambda c: F.col(f"{y}{c}{y_end}"))
    most = F.least(one("at"), two("at")) + 1 + F.least(one("rest"), two("rest"))
    return denominator * most >= numerator * (one("n") + two("n") - most)


def _bits_fit(numerator: int, denominator: int):
    """Bitmap filter: slices that only one of two sets has bound its overlap, exactly, from above.

    Every such slice holds an n-gram that the other set lacks, so the overlap is at most
    the set's shared n-grams less those slices.
    """
    lanes = range(LANES)
    only_a = sum((F.bit_count(F.col(f"bit{i}_a").bitwiseAND(F.bitwise_not(F.col(f"bit{i}_b")))) for i in lanes[1:]), F.bit_count(F.col("bit0_a").bitwiseAND(F.bitwise_not(F.col("bit0_b")))))
    only_b = sum((F.bit_count(F.col(f"bit{i}_b").bitwiseAND(F.bitwise_not(F.col(f"bit{i}_a")))) for i in lanes[1:]), F.bit_count(F.col("bit0_b").bitwiseAND(F.bitwise_not(F.col("bit0_a")))))
    most = F.least(F.col("shared_a") - only_a, F.col("shared_b") - only_b)
    return denominator * most >= numerator * (F.col("n_a") + F.col("n_b") - most)


def _linked(
    rows: DataFrame, numerator: int = 80, denominator: int = 100, width: int = 5, pivot_rounds: int = 2, pivots: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, digest, text) to (doc_id, digest, n, signature) of each and (signature, root) of the sets that can be linked.

    Equal sets become one. N-grams are ordered by document frequency over the whole
    table, rarest first; only those that two blocks or documents share can link and
    leave their block's pass. Documents that share a prefix n-gram are candidates. They
    first meet a few pivots of the n-gram, which joins large groups without their pairs;
    then every remaining pair of different components that shares a prefix n-gram and
    passes the length, positional, bitmap and suffix filters is verified. No candidate is left
    out, and what a pair could add to a known component need not be looked at.
    """
    buckets = bucket_count(rows, "text")
    blocks = rows.mapInArrow(_blocks(buckets, width), SCHEMA)
    met = blocks.groupBy("bucket").applyInArrow(_frequencies, SCHEMA)
    sets = written(met.groupBy("chunk").applyInArrow(_sets(numerator, denominator), SETS), "shingle-sets")

    members = sets.filter(F.col("alone").isNull()).select("doc_id", "digest", "n", "signature")
    reps = sets.filter(F.col("alone").isNotNull()).drop("doc_id", "digest").dropDuplicates(["signature"])
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "set-classes")
    length = F.expr(f"n - ({numerator} * n + {denominator - 1}) div {denominator} + 1 - alone").cast("int")
    prefix = written(
        reps.select("rep", "n", "alone", F.posexplode(F.slice("keys", F.lit(1), length)).alias("at", "key")).select(
            "key", "rep", "n", "at", (F.col("n") - F.col("alone") - F.col("at") - 1).alias("rest")
        ),
        "prefix-ngrams",
    )

    # N-grams with the same sets make the same pairs, as those of a shared passage do: they become one.
    holders = prefix.groupBy("key").agg(
        F.count(F.lit(1)).alias("sets"),
        F.bit_xor(F.xxhash64("rep")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit(1), F.col("rep"))).alias("y"),
    )
    alike = holders.filter("sets > 1").select("key", F.xxhash64("sets", "x", "y").alias("same"))
    # Copies in other blocks had made some n-grams look shared; those that one set holds alone count for nothing.
    place = F.row_number().over(Window.partitionBy("rep").orderBy("at")) - 1
    prefix = written(
        prefix.join(alike, "key")
        .withColumn("at", place)
        .groupBy(F.col("same").alias("key"), "rep", "n")
        .agg(F.count(F.lit(1)).alias("times"), F.max("at").alias("at"), F.min("rest").alias("rest")),
        "prefix-groups",
    )

    links, roots = None, None
    for turn in range(pivot_rounds + 1):
        placed = prefix.withColumn("root", F.col("rep"))
        if roots is not None:
            placed = prefix.join(roots, F.col("rep") == F.col("node"), "left").select(
                *prefix.columns, F.coalesce("root", "rep").alias("root")
            )
        # Only n-grams of several components can still link something new.
        # The first pivot is the most central set, that with the fewest n-grams of its own: edited
        # copies have some, what they were copied from has none. Later ones are drawn from parts.
        draw = F.struct(
            F.pmod(F.xxhash64("rep", F.pmod("key", F.lit(pivots)), F.lit(turn)), F.lit(1 + 2 * turn)).alias("part"),
            ((F.col("n") - F.col("at") - F.col("rest")) / F.col("n")).alias("own"),
            F.xxhash64("rep").alias("tie"),
        )
        keys = placed.groupBy("key").agg(
            F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("rep", "n", "at", "rest", "root"), draw).alias("pivot")
        )
        keys = keys.filter("low <> high").drop("low", "high")
        if turn < pivot_rounds:
            pairs = (
                placed.join(keys, "key")
                .filter("root <> pivot.root")
                .filter(_sizes_fit(numerator, denominator, "n", "pivot.n"))
                .filter(_positions_fit(numerator, denominator, "", "pivot."))
                .select(F.least("rep", "pivot.rep").alias("a"), F.greatest("rep", "pivot.rep").alias("b"))
                .distinct()
            )
        else:
            # A hot n-gram's sets are cut into parts on one side, and the other side meets each part.
            parts = (1 + F.floor(F.col("sets") / HOT_SETS)).cast("int")
            sizes = placed.join(keys.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("sets"))
            open_rows = placed.join(sizes.select("key", parts.alias("parts")), "key")
            bits = reps.select("rep", F.size("keys").alias("shared"), *[F.get("bits", F.lit(i)).alias(f"bit{i}") for i in range(LANES)])
            open_rows = written(open_rows.join(bits, "rep"), "open-ngrams")
            carried = ["rep", "n", "times", "at", "rest", "root", "shared", *[f"bit{i}" for i in range(LANES)]]
            part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
            left = open_rows.select("key", part.alias("part"), *(F.col(c).alias(f"{c}_a") for c in carried))
            every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
            right = open_rows.select("key", every, *(F.col(c).alias(f"{c}_b") for c in carried))
            met_pairs = left.join(right, ["key", "part"]).filter(
                (F.col("rep_a") < F.col("rep_b"))
                & (F.col("root_a") != F.col("root_b"))
                & _sizes_fit(numerator, denominator, "n_a", "n_b")
                & _positions_fit(numerator, denominator, "", "", "_a", "_b")
                & _bits_fit(numerator, denominator)
            )
            # Once the matches of a pair are together, what precedes the last one is known exactly.
            pairs = (
                met_pairs.groupBy(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "n_a", "n_b")
                .agg(F.sum("times_a").alias("common"), F.min("rest_a").alias("rest_a"), F.min("rest_b").alias("rest_b"))
                .withColumn("most", F.col("common") + F.least("rest_a", "rest_b"))
                .filter(F.expr(f"{denominator} * most >= {numerator} * (n_a + n_b - most)"))
            )
        pairs = written(pairs.select("a", "b"), "candidates")
        if pairs.isEmpty():
            if turn < pivot_rounds:
                continue
            break
        found = written(_verified(pairs, reps, numerator, denominator), "links")
        links = found if links is None else links.union(found)
        roots = written(components(links), "roots")

    known = reps.select("signature", "rep")
    if roots is None:
        return members, known.withColumnRenamed("rep", "root")
    known = known.join(roots, F.col("rep") == F.col("node"), "left").select("signature", F.coalesce("root", "rep").alias("root"))
    return members, known


def jaccard_components(
    docs: DataFrame,
    numerator: int = 80,
    denominator: int = 100,
    width: int = 5,
    doc_id: str = "doc_id",
    text: str = "text",
    pivot_rounds: int = 2,
    pivots: int = 4,
) -> DataFrame:
    """Near-duplicate components: (doc_id, n_shingles, component_id), one row per document.

    Two documents are linked when their sets of word n-grams have a Jaccard similarity
    of ``numerator / denominator`` or more; component_id is the smallest id that a
    document reaches by links. A text of fewer words than ``width`` has its whole
    sequence as the one n-gram; null and blank texts have none, link with nothing and
    are their own component. Repeated rows keep a row each. A null id takes part; its
    component is the smallest id it reaches, or null. Other columns are not looked at.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.lit(None).cast("binary").alias("digest"),
        F.col(text).cast("string").alias("text"),
    )
    members, known = _linked(rows, numerator, denominator, width, pivot_rounds, pivots)
    classes = members.filter(F.col("signature").isNotNull()).groupBy("signature").agg(F.min("doc_id").alias("lowest"))
    lowest = classes.join(known, "signature").groupBy("root").agg(F.min("lowest").alias("reached"))
    reached = known.join(lowest, "root").select("signature", "reached")
    classes = classes.join(reached, "signature", "left").select("signature", F.coalesce("reached", "lowest").alias("lowest"))
    classes = written(classes, "components")
    joined = members.join(classes, "signature", "left")
    component = F.when(F.col("signature").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, with all their columns, one row of every component: that with the smallest id.

    Rows count, not ids: different texts of one id, or without an id, are documents of their
    own. A null id comes after all others; of one id the text whose digest is smallest stays,
    of rows with the same id and text one. Every row with a null or blank text stays.
    """
    id_, digest, turn, kept_id, kept_digest = unused(docs.columns, "_id", "_digest", "_turn", "_kept", "_kept_digest")
    own = {id_: F.col(doc_id).cast("long"), digest: F.unhex(F.md5(F.col(text).cast("string")))}
    rows = docs.select(own[id_].alias("doc_id"), own[digest].alias("digest"), F.col(text).cast("string").alias("text"))
    members, known = _linked(rows, **options)
    copies = members.filter(F.col("signature").isNotNull()).groupBy("signature", "doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest", "rows")
    first = copies.groupBy("signature").agg(F.min(order).alias("first")).join(known, "signature", "left")
    # A set that can link with none is a component of its own.
    first = first.groupBy("root", F.when(F.col("root").isNull(), F.col("signature"))).agg(F.min("first").alias("first"))
    kept = written(first.select(F.col("first.doc_id").alias(kept_id), F.col("first.digest").alias(kept_digest), "first.rows"), "kept-rows")

    worded = F.coalesce(F.col(text).cast("string").rlike(WORD), F.lit(False))
    marked = docs.filter(worded).withColumns(own)
    same = F.col(id_).eqNullSafe(F.col(kept_id)) & (F.col(digest) == F.col(kept_digest))
    out = docs.filter(~worded).unionByName(marked.join(kept.filter("rows = 1"), same, "left_semi").drop(*own))
    often = kept.filter("rows > 1")
    if often.isEmpty():
        return out
    # Written, so that a join with many copies of one row can be split before they are ranked.
    repeated = written(marked.join(often, same, "left_semi"), "repeated-rows")
    plain = [f.name for f in docs.schema if not re.search("map|variant", f.dataType.simpleString())]
    rank = F.row_number().over(Window.partitionBy(*own).orderBy(F.xxhash64(*plain)))
    return out.unionByName(repeated.withColumn(turn, rank).filter(F.col(turn) == 1).drop(*own, turn))
