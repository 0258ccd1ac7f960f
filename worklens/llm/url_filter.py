"""URL filters: a sorted array of 64-bit digests, memory-mapped and probed by binary search."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from worklens.llm.common import ascii_lower
from worklens.session import written

ALLOW, BLOCK = "allow", "block"


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Host and path of every url; both empty without ``://``."""
    rest = F.expr(f"substr(`{url}`, locate('://', `{url}`) + 3)")
    known = F.col(url).contains("://")
    return pages.withColumns(
        {
            "host": F.when(known, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(""),
            "path": F.when(known, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(""),
        }
    )


class DigestIndex:
    """Rules as sorted digests with the full strings behind them.

    The digests, string bounds and strings lie in one unlinked temporary file of
    the worker that is memory-mapped; it vanishes with the process. Keys of
    equal digest lie side by side and are told apart by their strings.
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]], digest=xxhash.xxh64_intdigest):
        self.digest = digest
        verdicts: dict[bytes, str] = {}
        for host, path, verdict in rules:
            key = f"{host}\0{path}".encode()
            verdicts[key] = BLOCK if BLOCK in (verdict, verdicts.get(key)) else verdict
        entries = sorted((digest(key), key) for key in verdicts)
        self.lengths = sorted({len(key.split(b"\0", 1)[1].decode()) for key in verdicts})
        self.longest = max((len(key.split(b"\0", 1)[0].decode()) for key in verdicts), default=0)
        n = len(entries)
        bounds = np.cumsum([0, *(len(key) for _, key in entries)]).astype(np.int64)
        file = tempfile.TemporaryFile()
        file.write(np.array([d for d, _ in entries], dtype=np.uint64).tobytes())
        file.write(bounds.tobytes())
        file.write(b"".join(key for _, key in entries) + b"\0")
        file.flush()
        self.digests = np.memmap(file, np.uint64, "r", 0, (n,)) if n else np.empty(0, np.uint64)
        self.bounds = np.memmap(file, np.int64, "r", 8 * n, (n + 1,))
        self.strings = np.memmap(file, np.uint8, "r", 16 * n + 8, (int(bounds[-1]) + 1,))
        self.blocked = np.array([verdicts[key] == BLOCK for _, key in entries], dtype=bool)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The entry of each key, or -1."""
        found = np.full(len(keys), -1, dtype=np.int64)
        n = len(self.digests)
        if not n or not keys:
            return found
        wanted = np.fromiter((self.digest(key) for key in keys), dtype=np.uint64, count=len(keys))
        first = np.searchsorted(self.digests, wanted)
        hits = np.flatnonzero((first < n) & (self.digests[np.minimum(first, n - 1)] == wanted))
        for i in hits.tolist():
            at = int(first[i])
            while at < n and self.digests[at] == wanted[i]:
                if self.strings[self.bounds[at] : self.bounds[at + 1]].tobytes() == keys[i]:
                    found[i] = at
                    break
                at += 1
        return found

    def rule(self, entry: int) -> str:
        return self.strings[self.bounds[entry] : self.bounds[entry + 1]].tobytes().decode().replace("\0", "", 1)


def candidates(host: str, path: str, lengths: list[int], longest: int) -> Iterator[tuple[str, str]]:
    """The host and its parents, each with every prefix of the path that has the length of a rule's.

    Only parents of up to ``longest`` characters, the longest host of a rule, can be one's: the others are
    skipped at once, so a host of very many labels costs no more than a short one.
    """
    if len(host) > longest:
        dot = host.find(".", len(host) - longest - 1)
        host = host[dot + 1 :] if dot >= 0 else ""
    while host:
        for n in lengths:
            if n <= len(path):
                yield host, path[:n]
        _, dot, host = host.partition(".")
        if not dot:
            break


def judge(index: DigestIndex, hosts: list[str], paths: list[str], lengths: list[int]) -> tuple[list, list]:
    """Rule and verdict of each (host, path): the longest rule, of equal ones that with the longer host."""
    keys: dict[tuple[str, str], int] = {}
    per_row = []
    for host, path in zip(hosts, paths):
        per_row.append([keys.setdefault(c, len(keys)) for c in candidates(host, path, lengths, index.longest)])
    listed = list(keys)
    found = index.find([f"{h}\0{p}".encode() for h, p in listed])
    rules, verdicts = [], []
    for own in per_row:
        best = max(
            ((len(listed[k][0]) + len(listed[k][1]), len(listed[k][0]), k) for k in own if found[k] >= 0),
            default=None,
        )
        entry = -1 if best is None else int(found[best[2]])
        rules.append(None if entry < 0 else index.rule(entry))
        verdicts.append(None if entry < 0 else (BLOCK if index.blocked[entry] else ALLOW))
    return rules, verdicts


def url_verdicts(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    default: str = ALLOW,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """Every page with ``host``, ``path``, ``rule`` and ``verdict`` added.

    A rule (host, path, verdict) fits its host and all subdomains where the url's
    path starts with the rule's; the longest rule wins, of equally long ones that
    with the longer host. Equal rules that disagree block. Without a rule the
    verdict is ``default``. Null urls, and urls without ``://``, have an empty host
    and path, which no rule fits. Columns of ``pages`` with an added name are
    replaced; repeated pages are judged alike; rules with a null part are left out.

    Rule lists of up to ``broadcast_bytes`` go to every worker as one index. Longer
    lists stay distributed: distinct candidate keys and rules are dealt by digest,
    each slice is an index of its own, and the hits are joined back.
    """
    rows = with_host_and_path(pages.drop("host", "path", "rule", "verdict"), url)
    clean = rules.select(
        ascii_lower(F.col("host")).alias("host"), F.col("path"), F.col("verdict")
    ).dropna()
    size = clean.agg(F.sum(F.octet_length("host") + F.octet_length("path") + 32)).first()[0] or 0
    if size <= broadcast_bytes:
        judged = _with_broadcast_index(rows, clean)
    else:
        judged = _with_sliced_index(rows, clean, int(size), broadcast_bytes)
    return judged.withColumn("verdict", F.coalesce("verdict", F.lit(default)))


@lru_cache(maxsize=1)
def _index_of(rules: tuple) -> DigestIndex:
    """The index of a rule list, sorted and mapped once in every worker."""
    return DigestIndex(rules)


def _with_broadcast_index(rows: DataFrame, rules: DataFrame) -> DataFrame:
    listed = tuple(tuple(r) for r in rules.collect())

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index_of(listed)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, verdict = judge(index, hosts, paths, index.lengths)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=[*batch.schema.names, "rule", "verdict"],
            )

    added = [T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())]
    return rows.mapInArrow(probe, T.StructType([*rows.schema.fields, *added]))


def _with_sliced_index(rows: DataFrame, rules: DataFrame, size: int, slice_bytes: int) -> DataFrame:
    # The number of distinct lengths is bounded by the longest path of a rule.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    longest = rules.agg(F.max(F.length("host"))).first()[0] or 0
    n = max(64, 4 * (size // max(1, slice_bytes)))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, str, str]] = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist()):
                out += [(host, path, h, p) for h, p in candidates(host, path, lengths, longest)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string()) for c in columns], names=["host", "path", "key_host", "key_path"]
            )

    urls = rows.select("host", "path").distinct()
    wanted = urls.mapInArrow(listed, "host string, path string, key_host string, key_path string")
    slot = F.pmod(F.xxhash64("key_host", "key_path"), F.lit(n))
    keys = wanted.select("key_host", "key_path").distinct().withColumn("slot", slot)
    dealt = rules.select(F.col("host").alias("key_host"), F.col("path").alias("key_path"), "verdict").withColumn("slot", slot)

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        index = DigestIndex(zip(*(right.column(c).to_pylist() for c in ("key_host", "key_path", "verdict"))))
        hosts, paths = left.column("key_host").to_pylist(), left.column("key_path").to_pylist()
        entry = index.find([f"{h}\0{p}".encode() for h, p in zip(hosts, paths)])
        hits = [i for i, e in enumerate(entry.tolist()) if e >= 0]
        return pa.table(
            {
                "key_host": pa.array([hosts[i] for i in hits], pa.string()),
                "key_path": pa.array([paths[i] for i in hits], pa.string()),
                "verdict": pa.array([BLOCK if index.blocked[entry[i]] else ALLOW for i in hits], pa.string()),
            }
        )

    hits = (
        keys.groupBy("slot")
        .cogroup(dealt.groupBy("slot"))
        .applyInArrow(probe, "key_host string, key_path string, verdict string")
    )
    order = F.struct(F.length(F.concat("key_host", "key_path")), F.length("key_host"))
    best = (
        wanted.join(written(hits, "url-hits"), ["key_host", "key_path"])
        .groupBy("host", "path")
        .agg(F.max_by(F.struct(F.concat("key_host", "key_path").alias("rule"), "verdict"), order).alias("best"))
    )
    return rows.join(best, ["host", "path"], "left").select(
        *rows.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")
    )
